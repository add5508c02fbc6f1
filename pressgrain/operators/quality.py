"""Quality gates, contracts and evaluation metrics. A check returns its violations as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pressgrain.functions import columns as C, rules as R
from pressgrain.operators.predicates import publishable_title


def _failed(df: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """Long (keys, rule) rows of the rules whose condition holds."""
    names = F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()]))
    return df.select(*keys, F.explode(names).alias("rule"))


def evidence_lineage(paragraph: Column, sentence: Column, sha: Column) -> Column:
    """Locator positive and fingerprint well formed."""
    return F.coalesce((paragraph > 0) & (sentence > 0) & sha.rlike(C.HEX64), F.lit(False))


def receipt_valid(receipts: DataFrame, model: str, prompt: str) -> DataFrame:
    """Receipts complete and issued for the expected model and prompt."""
    ok = (
        (F.trim(F.coalesce("receipt_key", F.lit(""))) != "") & (F.col("model") == model) & (F.col("prompt") == prompt)
        & F.coalesce(F.col("response_sha256").rlike(C.HEX64), F.lit(False)) & F.col("issued_at").isNotNull())
    return receipts.withColumn("valid", F.coalesce(ok, F.lit(False)))


def gate_violations(issues: DataFrame, articles: DataFrame, profiles: DataFrame, bundles: DataFrame, expected: int) -> DataFrame:
    """Rule failures of a candidate publication, per issue; run-level failures carry a null issue."""
    titled = publishable_title(F.col("title"))
    own = _failed(issues, ["issue_id"], {
        "title": titled.isNotNull(), "score": ~F.coalesce(F.col("agenda_score") > 0, F.lit(False)), "outlets": ~F.coalesce(F.col("outlet_count") >= 2, F.lit(False))})
    counts = articles.groupBy("issue_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(~evidence_lineage(F.col("paragraph"), F.col("sentence"), F.col("sentence_sha256"))).alias("_bad"))
    art = _failed(issues.select("issue_id").join(counts, "issue_id", "left"), ["issue_id"], {
        "articles": F.coalesce("_n", F.lit(0)) < 3, "evidence": F.coalesce("_bad", F.lit(0)) > 0})
    good = profiles.filter((F.col("status") == "succeeded") & F.col("receipt_valid")).select("issue_id", "article_id")
    unverified = articles.select("issue_id", "article_id").join(good, ["issue_id", "article_id"], "left_anti").select("issue_id", F.lit("unverified_profile").alias("rule"))
    lone = bundles.join(issues.select("issue_id"), "issue_id", "left_anti").select("issue_id", F.lit("extra_bundle").alias("rule"))
    none = issues.join(bundles.filter(F.col("status") == "succeeded"), "issue_id", "left_anti").select("issue_id", F.lit("missing_bundle").alias("rule"))
    n = issues.agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") != expected).select(F.lit(None).cast(dict(issues.dtypes)["issue_id"]).alias("issue_id"), F.lit("issue_count").alias("rule"))
    out = own
    for df in (art, unverified.distinct(), lone, none, n):
        out = out.unionByName(df)
    return out


def verified_bundle(profiles: DataFrame) -> DataFrame:
    """An issue's bundle is verified when all its profiles succeeded and carry evidence."""
    return profiles.groupBy("issue_id").agg(
        F.count(F.lit(1)).alias("profiles"), F.bool_and((F.col("status") == "succeeded") & (F.col("evidence_count") > 0)).alias("verified"))


def live_publishable(manifest: DataFrame, fallback_prefix: str = "fallback-") -> DataFrame:
    return manifest.filter((F.col("articles") >= 3) & (F.col("outlets") >= 2) & ~F.col("payload_key").contains(fallback_prefix))


def release_gate(rules: DataFrame, metrics: DataFrame, datasets: DataFrame) -> DataFrame:
    """One row: number of rules, failed rules, datasets not ready, and the verdict."""
    checked = R.metric_rule_check(rules, metrics)
    not_ready = datasets.agg(F.count_if(~F.col("ready"))).scalar()
    s = checked.agg(F.count(F.lit(1)).alias("rules"), F.count_if(~F.col("passed")).alias("failed"))
    return s.withColumn("datasets_not_ready", not_ready).withColumn("released", (F.col("failed") == 0) & (F.col("datasets_not_ready") == 0))


def holdout_audit(records: DataFrame) -> DataFrame:
    """Annotation contract violations per record."""
    done = F.col("status").isin("labeled", "adjudicated")
    people = F.col("annotators")
    return _failed(records, ["record_id"], {
        "kind_not_real": F.col("kind") != "real",
        "not_locked": (F.col("split") != "locked_holdout") | ~F.coalesce("locked", F.lit(False)),
        "raw_content": F.col("body_present"),
        "annotators": done & ((F.size(people) != 2) | (F.size(F.array_distinct(people)) != 2)),
        "adjudication": done & ~F.coalesce("adjudicated", F.lit(False)),
        "agreement": done & F.col("agreement").isNull()})


def slo_check(metrics: DataFrame, budgets: DataFrame) -> DataFrame:
    """Metrics above their budget; a missing metric counts as a breach."""
    j = budgets.join(metrics, "name", "left")
    return j.select("name", "budget", "actual", (F.col("actual").isNull() | (F.col("actual") > F.col("budget"))).alias("breached"))


def issue_state(clusters: DataFrame, profiles: DataFrame) -> DataFrame:
    """succeeded only if the cluster and all its profiles succeeded; partial if some did."""
    p = profiles.groupBy("issue_id").agg(F.count(F.lit(1)).alias("profiles"), F.count_if(F.col("status") == "succeeded").alias("succeeded"))
    n, ok = F.coalesce("profiles", F.lit(0)), F.coalesce("succeeded", F.lit(0))
    state = F.when((F.col("cluster_status") == "succeeded") & (n > 0) & (ok == n), "succeeded").when(ok > 0, "partial").otherwise("failed")
    return clusters.join(p, "issue_id", "left").select("issue_id", n.alias("profiles"), ok.alias("succeeded"), state.alias("state"))


def constraint_violations(rows: DataFrame, checks: dict[str, Column], unique: Sequence[Sequence[str]] = (), foreign: dict[str, tuple[str, DataFrame]] | None = None) -> DataFrame:
    """CHECK, UNIQUE and FOREIGN KEY violations as counts per constraint."""
    one = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(True))).alias(n) for n, ok in checks.items()])
    out = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("constraint_name"), F.col(n).alias("violations")) for n in checks])).alias("x")).select("x.*")
    for keys in unique:
        dup = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).agg(F.count(F.lit(1)).alias("violations"))
        out = out.unionByName(dup.select(F.lit("unique_" + "_".join(keys)).alias("constraint_name"), "violations"))
    for name, (key, target) in (foreign or {}).items():
        lone = rows.filter(F.col(key).isNotNull()).join(target.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("violations"))
        out = out.unionByName(lone.select(F.lit(name).alias("constraint_name"), "violations"))
    return out


def summary_payload_violations(summaries: DataFrame, variants: DataFrame, members: DataFrame, title_cap: int = 120, text_cap: int = 280) -> DataFrame:
    """Rows that break the summary contract: domains, lengths, one to four variants, ids inside the group."""
    n = variants.groupBy("issue_id").agg(F.count(F.lit(1)).alias("_v"))
    own = _failed(summaries.join(n, "issue_id", "left"), ["issue_id"], {
        "decision": ~F.col("decision").isin("same_event", "split", "uncertain"), "coherence": ~F.col("coherence").isin("high", "medium", "low"),
        "title_length": ~F.length("title").between(1, title_cap), "text_length": F.length("text") > text_cap,
        "variant_count": ~F.coalesce("_v", F.lit(0)).between(1, 4)})
    foreign = variants.join(members.select("issue_id", "article_id"), ["issue_id", "article_id"], "left_anti").select("issue_id", F.lit("foreign_article").alias("rule")).distinct()
    return own.unionByName(foreign)


def summary_fallback(summaries: DataFrame, violations: DataFrame) -> DataFrame:
    """Failing summaries fall back to review."""
    bad = violations.select("issue_id").distinct().withColumn("_bad", F.lit(True))
    return summaries.join(bad, "issue_id", "left").select("issue_id", F.when(F.col("_bad"), "review_needed").otherwise(F.col("decision")).alias("decision"))


def lineage_consistent(profiles: DataFrame, columns: Sequence[str], signatures: DataFrame, approvals: DataFrame) -> DataFrame:
    """All profiles of an issue share each lineage value, and its exact URL set is approved."""
    one = profiles.groupBy("issue_id").agg(*[F.count_distinct(c).alias(c) for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & (F.col(c) == 1)
    ok = approvals.select("set_digest").distinct().withColumn("_ok", F.lit(True))
    j = one.join(signatures.select("issue_id", "set_digest"), "issue_id", "left").join(ok, "set_digest", "left")
    return j.select("issue_id", same.alias("same_lineage"), F.coalesce("_ok", F.lit(False)).alias("approved"), (same & F.coalesce("_ok", F.lit(False))).alias("consistent"))


def comparison_contract(patterns: DataFrame, lenses: DataFrame, evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """Structural violations of a public comparison: ranges, non-empty ids, unknown evidence claims."""
    p = _failed(patterns, ["issue_id"], {
        "empty_variant": F.coalesce(F.trim("variant_key"), F.lit("")) == "", "article_count": ~F.coalesce(F.col("article_count") >= 1, F.lit(False)),
        "outlets_exceed_articles": F.size("outlets") > F.col("article_count")})
    l = _failed(lenses, ["issue_id"], {"gap_range": ~F.coalesce(F.col("presence_gap").between(0, 1), F.lit(False))})
    e = evidence.join(claims.select("claim_id"), "claim_id", "left_anti").select("issue_id", F.lit("unknown_claim").alias("rule"))
    return p.unionByName(l).unionByName(e)


def panel_contract(panel: DataFrame, endpoints: DataFrame, dailies: int, broadcasters: int, daily: str = "daily", broadcast: str = "broadcast") -> DataFrame:
    """Violations of the source panel: duplicates, type counts, sources without endpoints, bad limits."""
    dup = panel.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("source_id", F.lit("duplicate").alias("rule"))
    types = panel.groupBy("source_type").agg(F.count_distinct("source_id").alias("_n"))
    wanted = F.when(F.col("source_type") == daily, dailies).when(F.col("source_type") == broadcast, broadcasters).otherwise(0)
    off = types.filter(F.col("_n") != wanted).select(F.lit(None).cast("string").alias("source_id"), F.concat(F.lit("count_"), "source_type").alias("rule"))
    bare = panel.select("source_id").distinct().join(endpoints.select("source_id"), "source_id", "left_anti").withColumn("rule", F.lit("no_endpoint"))
    limit = endpoints.filter(~F.coalesce(F.col("max_records") > 0, F.lit(False))).select("source_id", F.lit("limit").alias("rule"))
    return dup.unionByName(off).unionByName(bare).unionByName(limit)


# -- evaluation -----------------------------------------------------------------------------------

def pairwise_metrics(confusion: DataFrame) -> DataFrame:
    """Precision, recall, F1 and merge rates from pair counts, with the conventions for empty sides."""
    tp, fp, fn = (F.col(c) for c in ("shared_pairs", "false_pairs", "missed_pairs"))
    no_gold = (tp + fn) == 0
    precision = F.coalesce(C.ratio(tp, tp + fp), F.when(no_gold, 1.0).otherwise(0.0))
    recall = F.coalesce(C.ratio(tp, tp + fn), F.lit(1.0))
    f1 = F.coalesce(C.ratio(precision * recall * 2.0, precision + recall), F.lit(0.0))
    return confusion.select(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
                            F.coalesce(C.ratio(fp, tp + fp), F.lit(0.0)).alias("over_merge"), F.coalesce(C.ratio(fn, tp + fn), F.lit(0.0)).alias("under_merge"))


def multilabel_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One-vs-rest precision, recall and F1 per label, from (case_id, label) rows."""
    g = gold.select("case_id", "label").distinct().withColumn("_g", F.lit(1))
    p = predicted.select("case_id", "label").distinct().withColumn("_p", F.lit(1))
    c = g.join(p, ["case_id", "label"], "full_outer").groupBy("label").agg(
        F.count_if(F.col("_g").isNotNull() & F.col("_p").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    precision = F.coalesce(C.ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.when(F.col("fn") == 0, 1.0).otherwise(0.0))
    recall = F.coalesce(C.ratio(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(1.0))
    return c.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", F.coalesce(C.ratio(F.col("precision") * F.col("recall") * 2.0, F.col("precision") + F.col("recall")), F.lit(0.0)))


def multilabel_macro_f1(gold: DataFrame, predicted: DataFrame, gold_cases: DataFrame, predicted_cases: DataFrame) -> DataFrame:
    """Macro F1 over labels; ``mismatched_cases`` counts cases present on one side only (must be 0)."""
    from pressgrain.operators.joins import missing_keys

    bad = missing_keys(gold_cases, predicted_cases, "case_id").agg(F.count(F.lit(1))).scalar()
    return multilabel_scores(gold, predicted).agg(F.count(F.lit(1)).alias("labels"), F.avg("f1").alias("macro_f1")).withColumn("mismatched_cases", bad)


def gold_partition_errors(gold: DataFrame) -> DataFrame:
    """Articles in several gold clusters, or repeated inside one."""
    per = gold.groupBy("article_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("groups"))
    return per.filter(F.col("n") > 1).select("article_id", F.when(F.col("groups") > 1, "overlapping").otherwise("duplicate").alias("error"))
