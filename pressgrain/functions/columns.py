"""Scalar building blocks as ``Column`` expressions; everything stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KST_HOURS = 9

# fixed values: tracking parameters each URL profile removes, besides utm_*
TRACKING_PARAMS = {
    "import": ("fbclid", "gclid"),
    "discovery": ("fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "cooper", "plink", "ref", "spm"),
    "crawler": ("fbclid", "gclid", "ref", "source"),
    "trial": ("ref", "source", "fbclid", "gclid"),
}
SORTED_PROFILES = ("import", "discovery")
HTTPS_ONLY_PROFILES = ("import", "crawler")

# fixed values: homepage zone weights
ZONE_WEIGHTS = {"top": 100, "main": 82, "section": 58, "list": 35}

# fixed values: agenda score weights, in percent

HEX64 = "^[0-9a-f]{64}$"


def half_up(c: Column, digits: int = 0) -> Column:
    """Round with halves toward +infinity, so that both engines and browsers agree bit for bit."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def ratio(num: Column, den: Column, default: Column | None = None) -> Column:
    """num / den, null (or ``default``) when the denominator is zero."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if default is None else F.coalesce(out, default)


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def kst_date(ts: Column) -> Column:
    """Business date (UTC+9, no daylight saving) of a UTC timestamp."""
    return F.date_format(ts + F.expr(f"INTERVAL {KST_HOURS} HOURS"), "yyyy-MM-dd")


def kst_day_bounds(day: str) -> tuple[Column, Column]:
    """Half-open UTC bounds of a business day, as literals that push down to the scan."""
    start = F.expr(f"timestamp_ntz'{day} 00:00:00' - INTERVAL {KST_HOURS} HOURS")
    return start, start + F.expr("INTERVAL 24 HOURS")


def in_kst_days(ts: Column, first: str, last: str | None = None) -> Column:
    lo, _ = kst_day_bounds(first)
    _, hi = kst_day_bounds(last or first)
    return (ts >= lo) & (ts < hi)


# -- URLs ---------------------------------------------------------------------------------------

def url_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"\.$", "")


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def canonical_url(url: Column, profile: str = "import") -> Column:
    """One canonicalizer with four profiles: they differ in tracking list, query order and http handling.

    Null for a URL the profile rejects (no host, or plain http where only https is accepted).
    """
    blocked = "^(?:utm_.*|" + "|".join(TRACKING_PARAMS[profile]) + ")$"
    raw_query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(
        F.split(raw_query, "&"),
        lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(blocked),
    )
    if profile in SORTED_PROFILES:
        kept = F.array_sort(kept)
    query = F.concat_ws("&", kept)
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]*:(\d+)", 1)
    port_part = F.when((port == "") | (port == "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    query_part = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))
    out = F.concat(F.lit("https://"), url_host(url), port_part, url_path(url), query_part)
    if profile == "trial":
        out = F.regexp_replace(out, "/$", "")
    scheme = "^https://" if profile in HTTPS_ONLY_PROFILES else "^https?://"
    return F.when(F.lower(url).rlike(scheme) & (url_host(url) != ""), out)


def article_id_from_url(url: Column, provider: str | None = None) -> Column:
    if provider is None:
        return F.left(F.sha2(url, 256), F.lit(32))
    return F.sha2(F.concat(F.lit(provider + ":"), url), 256)


def host_suffixes(host: Column) -> Column:
    """All dot-suffixes of a host, so a subdomain test becomes an equi join."""
    parts = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))),
    )


# -- hashes -------------------------------------------------------------------------------------

def body_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def analysis_key(url: Column, sha: Column, version: str) -> Column:
    return F.concat_ws("|", url, sha, F.lit(version))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON object with keys in binary order; string values only, quotes and backslashes escaped."""
    parts = []
    for name in sorted(fields):
        text = F.regexp_replace(F.regexp_replace(fields[name], r"\\", r"\\\\"), '"', r'\\"')
        parts.append(F.concat(F.lit(f'"{name}":"'), text, F.lit('"')))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_digest(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def analysis_fingerprint(article_id: Column, body_sha: Column, model: str, prompt: str, schema: int, approval: Column | None = None) -> Column:
    """Body-free identity of one analysis request: digest of a key-sorted compact JSON object."""
    quoted = {"approval": approval if approval is not None else F.lit(""), "article_id": article_id, "body_hash": F.coalesce(body_sha, F.lit("")),
              "model": F.lit(model), "prompt": F.lit(prompt)}
    return F.sha2(F.concat(F.regexp_replace(canonical_json(quoted), "}$", ","), F.lit(f'"schema":{schema}}}')), 256)


def evidence_fingerprint(article_id: Column, sentence: Column, prefix: str = "evidence:v1") -> Column:
    return F.sha2(F.concat_ws(":", F.lit(prefix), article_id.cast("string"), sentence), 256)


def evidence_fingerprint_located(article_id: Column, paragraph: Column, number: Column, sentence: Column,
                                 prefix: str = "evidence:v2") -> Column:
    return F.sha2(F.concat_ws(":", F.lit(prefix), article_id.cast("string"), paragraph.cast("string"),
                              number.cast("string"), sentence), 256)


def claim_id(article_id: Column, dimension: Column, variant: Column, voice: Column, prefix: str = "claim:v1") -> Column:
    return F.sha2(F.concat_ws(":", F.lit(prefix), article_id.cast("string"), dimension, variant, voice), 256)


# -- scores -------------------------------------------------------------------------------------

def zone_weight(zone: Column) -> Column:
    out = F.when(zone == "top", 100.0)
    for name, value in list(ZONE_WEIGHTS.items())[1:]:
        out = out.when(zone == name, float(value))
    return out


def coverage_factor(sources: Column, configured: Column) -> Column:
    share = sources.cast("double") / F.greatest(configured, F.lit(1)).cast("double")
    return F.least(F.lit(1.0), F.lit(0.45) + share * F.lit(0.8))


def weighted_agenda_score(diversity: Column, volume: Column, placement: Column, follow_up: Column,
                          sources: Column, configured: Column) -> Column:
    """Weights are renormalized over the components that were observed."""
    parts = [(diversity, 0.55), (volume, 0.25), (placement, 0.15), (follow_up, 0.05)]
    total = sum((F.coalesce(v * F.lit(w), F.lit(0.0)) for v, w in parts), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for v, w in parts), F.lit(0.0))
    return half_up(F.try_divide(total, weight) * coverage_factor(sources, configured), 1)


def scoped_score(sources: Column, articles: Column, configured: int) -> Column:
    base = sources * F.lit(60.0) / F.lit(float(configured)) + F.least(articles, F.lit(10)) * F.lit(4.0)
    return half_up(base * F.least(F.lit(1.0), F.lit(0.45) + sources * F.lit(0.8) / F.lit(float(configured))), 1)


def retry_delay_ms(attempt: Column, base_ms: int, cap_ms: int) -> Column:
    """min(cap, base * 2^(n-1)); the shift is bounded first, so large attempt numbers cannot overflow."""
    shift = F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(30))
    return F.least(F.lit(cap_ms).cast("bigint"), (F.lit(float(base_ms)) * F.pow(F.lit(2.0), shift)).cast("bigint"))


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)), F.lit(0.0))


def blended_similarity(title: Column, content: Column, bodies: Column) -> Column:
    return F.when(bodies, half_up(title * 0.65 + content * 0.35, 3)).otherwise(title)


def hangul_final(word: Column) -> Column:
    """Index of the final consonant of the last syllable; 0 when open or not Hangul."""
    cp = F.ascii(F.right(word, F.lit(1)))
    return F.when((cp >= 44032) & (cp <= 55203), F.pmod(cp - 44032, F.lit(28))).otherwise(F.lit(0))


def hangul_particle(word: Column, closed: str, opened: str) -> Column:
    return F.concat(word, F.when(hangul_final(word) > 0, F.lit(closed)).otherwise(F.lit(opened)))


# fixed values: placement aliases
PLACEMENT_ALIASES = {
    "top": ("top", "최상단"),
    "main": ("main", "메인"),
    "section": ("section", "섹션"),
    "list": ("list", "목록"),
}


def placement_alias(raw: Column) -> Column:
    key = F.lower(F.trim(raw))
    out = F.when(key.isin(*PLACEMENT_ALIASES["top"]), "top")
    for zone in ("main", "section", "list"):
        out = out.when(key.isin(*PLACEMENT_ALIASES[zone]), zone)
    return out


# fixed values: contact details that send a comment to moderation
EMAIL_PATTERN = r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
PHONE_PATTERN = r"\b[0-9]{2,3}[- .][0-9]{3,4}[- .][0-9]{4}\b"


def needs_moderation(text: Column) -> Column:
    return text.rlike(EMAIL_PATTERN) | text.rlike(PHONE_PATTERN)
