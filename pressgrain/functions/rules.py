"""Rule-shaped columns: freshness, slots, reader types, claim cleaning, metric checks, timestamps, JSON fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pressgrain.functions import columns as C, text as X

# fixed values: labels that may not appear in a public comparison
IDEOLOGY_MARKERS = ("진보", "보수", "좌파", "우파", "좌편향", "우편향", "우익", "좌익")
# fixed values: inline citation group, e.g. [P2S3] or (p1:s4, p2:s1)
EVIDENCE_TOKENS = r"(?i)\s*[\[(]\s*p\d+\s*[:.,-]?\s*s\d+(?:\s*[,;]\s*p\d+\s*[:.,-]?\s*s\d+)*\s*[\])]"


def parse_timestamp_flexible(text: Column) -> Column:
    """ISO or mail-style time as UTC; a time without a zone is local (UTC+9)."""
    t = F.trim(text)
    iso = F.regexp_replace(F.regexp_replace(t, "Z$", "+00:00"), r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2})(?=$|[+-])", "$1T$2:00")
    iso = F.regexp_replace(F.regexp_replace(iso, r"^(\d{4}-\d{2}-\d{2}) ", "$1T"), r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00")
    iso = F.regexp_replace(iso, r"\.\d+", "")
    has_zone = iso.rlike(r"[+-]\d{2}:\d{2}$")
    iso_utc = _shift(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss"), r"^(.{19})", F.when(has_zone, F.regexp_extract(iso, r"([+-]\d{2}:?\d{2})$", 1)).otherwise("+09:00"))
    mail = F.regexp_replace(t, r"^[A-Za-z]{3},\s*", "")
    zone = F.regexp_extract(mail, r"([+-]\d{4}|GMT|UTC)$", 1)
    offset = F.when(zone.isin("GMT", "UTC"), "+00:00").when(zone == "", "+09:00").otherwise(F.regexp_replace(zone, r"^([+-]\d{2})(\d{2})$", "$1:$2"))
    mail_utc = _shift(mail, F.lit("d MMM yyyy HH:mm:ss"), r"^(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2})", offset)
    return F.coalesce(iso_utc, mail_utc)


def _shift(text: Column, fmt: Column, part: str, offset: Column) -> Column:
    local = F.try_to_timestamp(F.nullif(F.regexp_extract(text, part, 1), F.lit("")), fmt).cast("timestamp_ntz")
    sign = F.when(F.left(offset, F.lit(1)) == "-", -1).otherwise(1)
    minutes = sign * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, -2, 2).try_cast("int"))
    return local - F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def freshness_status(target_date: Column, data_as_of: Column, collection_status: Column, latest_sources: Column, configured: Column, now: Column) -> Column:
    """struct(status, stale_days)."""
    stale = F.greatest(F.date_diff(F.to_date(C.kst_date(now)), F.to_date(target_date)), F.lit(0))
    partial = (collection_status == "partial") | ((latest_sources > 0) & (configured > 0) & (latest_sources < configured))
    status = (
        F.when(target_date.isNull(), "pending")
        .when(F.coalesce(partial, F.lit(False)), "partial")
        .when(stale > 0, "stale")
        .when(data_as_of.isNull() | (now - data_as_of > F.expr("INTERVAL 24 HOURS")), "delayed")
        .otherwise("normal"))
    return F.struct(status.alias("status"), F.when(status.isin("stale", "delayed", "normal"), stale).alias("stale_days"))


def schedule_slot(ts: Column, hours: Sequence[int]) -> Column:
    """Index of the last scheduled local hour not after the hour of ``ts``; before the first one, the last slot."""
    hour = F.hour(ts + F.expr(f"INTERVAL {C.KST_HOURS} HOURS"))
    slots = F.array(*[F.when(F.lit(h) <= hour, F.lit(i)) for i, h in enumerate(hours)])
    return F.coalesce(F.array_max(F.array_compact(slots)), F.lit(len(hours) - 1)).cast("bigint")


def next_attempt_status(attempts: Column, maximum: int) -> Column:
    return F.when(attempts >= maximum, "terminal").otherwise("retry_wait")


def body_retry_delay_ms(previous_attempts: Column, base_ms: int = 900_000, cap_ms: int = 86_400_000) -> Column:
    """Second form: the shift is capped at 6."""
    return F.least(F.lit(cap_ms).cast("bigint"), F.lit(base_ms) * F.pow(F.lit(2.0), F.least(previous_attempts, F.lit(6))).cast("bigint"))


def variant_key(dimension: Column, family: Column, paraphrase: Column, code: Column, prefix: str = "semantic") -> Column:
    """Family key when there is a well-formed one, else the normalized meaning, else the code."""
    meaning = F.trim(F.regexp_replace(F.lower(X.nfkc(paraphrase)), r"[^\p{L}\p{N}_]+", " "))
    return (
        F.when(family.rlike("^[a-z0-9_]{2,80}$"), F.concat_ws(":", F.lit(prefix), dimension, F.lit("family"), family))
        .when(meaning != "", F.concat_ws(":", F.lit(prefix), dimension, meaning))
        .otherwise(code))


def subject_order(text: Column, rules: Sequence[tuple[str, str]], limit: int | None = None) -> Column:
    """Subject labels by first match position, then rule order; the first is the narrowed subject."""
    hits = F.array_compact(F.array(*[
        F.when(F.regexp_instr(text, F.lit(p)) > 0, F.struct(F.regexp_instr(text, F.lit(p)).alias("at"), F.lit(i).alias("rank"), F.lit(label).alias("label")))
        for i, (label, p) in enumerate(rules)]))
    labels = F.array_distinct(F.transform(F.array_sort(hits), lambda h: h["label"]))
    return labels if limit is None else F.slice(labels, 1, limit)


def reader_type(answers: DataFrame, axes: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Letter code of each reader from (reader_id, axis, answer a/b): ``axes`` lists (axis, letter a, letter b)."""
    counts = answers.groupBy("reader_id").agg(*[
        f for axis, _, _ in axes for f in (
            F.count_if((F.col("axis") == axis) & (F.col("answer") == "a")).alias(f"{axis}_a"),
            F.count_if((F.col("axis") == axis) & (F.col("answer") == "b")).alias(f"{axis}_b"))])
    code = F.concat(*[F.when(F.col(f"{axis}_a") >= F.col(f"{axis}_b"), a).otherwise(b) for axis, a, b in axes])
    return counts.withColumn("reader_type", code)


def strip_evidence_tokens(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, EVIDENCE_TOKENS, ""), r"[ \t]{2,}", " ")
    return F.trim(F.regexp_replace(out, r"[ \t]+([,.;])", "$1"))


def clean_claim_text(text: Column, limit: int | None = 280) -> Column:
    """No inline citations, single spaces, at most ``limit`` characters."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), EVIDENCE_TOKENS, ""), r"\s+", " "))
    return clean if limit is None else F.left(clean, F.lit(limit))


def marker_block(text: Column, ideology: Sequence[str] = IDEOLOGY_MARKERS, internal: Sequence[str] = ()) -> Column:
    """Which kind of marker keeps a text from publication, or null."""
    def has(words: Sequence[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | text.contains(w)
        return out

    return F.when(has(ideology), "ideology").when(has(internal), "internal_code")


def metric_rule_check(rules: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every rule (name, operator, value) with its metric; a missing metric or unknown operator fails."""
    j = rules.join(metrics, "name", "left")
    a, v, op = F.col("actual"), F.col("value"), F.col("operator")
    known = op.isin("gte", "lte", "gt", "lt", "eq") & v.isNotNull()
    ok = F.when(op == "gte", a >= v).when(op == "lte", a <= v).when(op == "gt", a > v).when(op == "lt", a < v).otherwise(a == v)
    reason = F.when(~known, "threshold_rule_invalid").when(a.isNull(), "metric_missing")
    return j.select("name", "operator", "value", "actual", F.coalesce(known & a.isNotNull() & ok, F.lit(False)).alias("passed"), reason.alias("reason"))


def json_ld_field(html: Column, keys: Sequence[str]) -> Column:
    """First string value of any of ``keys`` at any depth of the page's JSON-LD blocks, in key order."""
    blocks = F.concat_ws("\n", F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1)))
    found = [F.nullif(F.regexp_extract(blocks, rf'"{k}"\s*:\s*"((?:[^"\\]|\\.)*)"', 1), F.lit("")) for k in keys]
    return F.coalesce(*found)
