"""Article bodies from a table of crawled pages.

One Arrow pass parses each page into candidate texts; everything that decides between candidates
(cleaning, statistics, quality, choice) is column work on the candidate table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pressgrain.functions import columns as C, rules as R, text as X
from pressgrain.operators.common import top_per_key
from pressgrain.session import cut_lineage
from pressgrain.sources.feeds import feed_rows

# fixed values: markup classes of the extractor
BLOCK_TAGS = frozenset("address article aside blockquote div figcaption figure h1 h2 h3 h4 h5 h6 li main p section table td tr".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REMOVED_TAGS = frozenset("button canvas dialog footer form header iframe nav noscript script style svg template".split())
NOISE = (
    r"(?:^|[\s_-])(?:ad(?:vert(?:isement|ising)?)?|banner|breadcrumb|caption|comment|copyright|floating|journalist|keyword|login|most[-_ ]?viewed"
    r"|newsletter|paywall|photo|popular|ranking|reaction|recommend(?:ed)?|related|reporter|share|social|sns|subscribe|subscription|tag[-_ ]?list"
    r"|toolbar|utility)(?:$|[\s_-])"
)
BODY_ATTRIBUTE = (
    r"(?:^|[\s_-])(?:article[-_ ]?(?:body|content|text)|articlebody(?:content)?|article[-_ ]?view[-_ ]?content(?:[-_ ]?div)?|content[-_ ]?body"
    r"|news[-_ ]?(?:article[-_ ]?)?(?:body|content|text)|newsbody|news[-_ ]?body[-_ ]?id|story[-_ ]?(?:body|content)|view[-_ ]?content)(?:$|[\s_-])"
)
META_BODY_KEYS = ("articlebody", "articlecontent", "newsbody", "storybody")
STATE_SCRIPT_IDS = ("__next_data__", "__nuxt_data__", "__apollo_state__", "__initial_state__")
IDENTITY_ATTRIBUTES = ("id", "class", "role", "data-component", "data-testid", "data-module")
STRATEGY_BONUS = {"json-ld": 0.15, "source-selector": 0.13, "itemprop": 0.13, "body-selector": 0.11, "script-state": 0.09, "article": 0.06, "body-meta": 0.04}
MIN_CHARS, MAX_CHARS, MIN_QUALITY = 280, 200_000, 0.54

# fixed values: lines that are page furniture
BOILERPLATE_LINES = (
    r"^(?:홈|메뉴|로그인|회원가입|구독|공유|댓글|인쇄|글자크기|다크모드)$",
    r"^(?:관련|추천|인기|주요|많이\s*본)\s*(?:기사|뉴스)$",
    r"^(?:이전|다음)\s*(?:기사|뉴스)$",
    r"^[가-힣]{2,5}\s*기자(?:\s*[|·]\s*[\w.+-]+@[\w.-]+)?$",
    r"^[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}$",
    r"(?i)(?:무단\s*전재|재배포\s*금지|저작권자\s*©|all rights reserved)",
    r"^(?:제보|문의)\s*[:：]",
)
BOILERPLATE_WORDS = r"(?i)많이\s*본\s*뉴스|관련\s*기사|로그인|회원가입|뉴스레터|추천\s*기사|무단\s*전재"
# fixed values: wording of restricted pages
RESTRICTED_TEXTS = (
    r"(?i)유료\s*(?:회원|구독자)?\s*(?:전용|기사|콘텐츠)",
    r"(?i)(?:회원|구독자)\s*전용\s*(?:기사|콘텐츠)",
    r"(?i)(?:로그인|구독)\s*(?:후|해야)\s*(?:기사|본문|내용|콘텐츠).{0,20}(?:읽|보|이용)",
    r"(?i)기사(?:의)?\s*(?:나머지|전체|전문).{0,24}(?:구독|로그인)",
    r"(?i)(?:기사를|계속)\s*읽으시려면.{0,24}(?:구독|로그인)",
    r"(?i)이\s*콘텐츠는.{0,20}(?:유료|구독자|회원)\s*(?:전용)?",
    r"(?i)(?:premium|subscriber)[ -]only\s+(?:article|content)",
    r"(?i)(?:subscribe|sign in|log in)\s+to\s+(?:continue|read)",
)
# fixed values: topic of a page section
SECTION_TOPICS = (
    ("politics", "(?i)정치|politics|government|assembly"),
    ("economy", "(?i)경제|economy|business|finance|industry"),
    ("society", "(?i)사회|society|national|local|education|health"),
    ("international", "(?i)국제|세계|international|world|foreign|global"),
)

_AMP = "\ue000"  # stands for the ampersand while parsing, so that entities are decoded once, as columns


class _Candidates(HTMLParser):
    """Collects candidate texts of one page: each open candidate keeps its own buffer and skip depth."""

    def __init__(self, source_pattern: str | None):
        super().__init__(convert_charrefs=False)
        self.noise, self.body = re.compile(NOISE, re.I), re.compile(BODY_ATTRIBUTE, re.I)
        self.own = re.compile(source_pattern, re.I) if source_pattern else None
        self.stack: list[tuple[str, bool, list[dict]]] = []
        self.open: list[dict] = []
        self.done: list[tuple[str, int, str, int]] = []
        self.order = 0
        self.anchors = 0
        self.script: tuple[str, str] | None = None

    def _emit(self, strategy: str, text: str, anchor_chars: int = 0, order: int | None = None) -> None:
        self.done.append((strategy, self.order if order is None else order, text, anchor_chars))

    def _text(self, data: str) -> None:
        for c in self.open:
            if not c["skip"]:
                c["parts"].append(data)
                if self.anchors and not data.isspace():
                    c["anchor"] += len("".join(data.split()))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, closed=True)

    def handle_starttag(self, tag, attrs, closed=False):
        self.order += 1
        a = {k: (v or "") for k, v in attrs}
        identity = " ".join(a[k] for k in IDENTITY_ATTRIBUTES if a.get(k))
        if tag == "meta":
            key = re.sub("[^a-z]", "", " ".join(a.get(k, "") for k in ("name", "property", "itemprop")).lower())
            if key in META_BODY_KEYS and a.get("content"):
                self._emit("body-meta", a["content"])
        for k in ("data-article-body", "data-news-body"):
            if a.get(k):
                self._emit("body-meta", a[k])
        removed = tag in REMOVED_TAGS or bool(self.noise.search(identity))
        if tag in VOID_TAGS or closed:
            self._text("\n" if tag in ("br", "hr") or tag in BLOCK_TAGS else " ")
            return
        self._text("\n" if tag in BLOCK_TAGS else " ")
        if removed:
            for c in self.open:
                c["skip"] += 1
        outer = list(self.open) if removed else []
        strategies = [s for s, hit in (
            ("source-selector", self.own and self.own.search(identity)),
            ("itemprop", re.search(r"(?:^|\s)articleBody(?:\s|$)", a.get("itemprop", ""), re.I)),
            ("body-selector", self.body.search(identity)),
            ("article", tag == "article")) if hit]
        mine = [{"strategy": s, "order": self.order, "parts": [], "anchor": 0, "skip": 0} for s in strategies]
        self.open += mine
        self.stack.append((tag, removed, outer, mine))
        if tag == "a":
            self.anchors += 1
        if tag == "script":
            self.script = (a.get("type", "").lower(), a.get("id", "").lower())

    def handle_endtag(self, tag):
        if tag == "script":
            self.script = None
        if not any(t == tag for t, *_ in self.stack):
            return
        while self.stack:
            name, _, outer, mine = self.stack.pop()
            for c in outer:
                c["skip"] -= 1
            if name == "a":
                self.anchors -= 1
            for c in mine:
                self.open.remove(c)
                if name == tag:
                    self._emit(c["strategy"], "".join(c["parts"]), c["anchor"], c["order"])
            if name == tag:
                break
        self._text("\n" if tag in BLOCK_TAGS else " ")

    def handle_data(self, data):
        if self.script is not None:
            kind, ident = self.script
            if kind.startswith("application/ld+json") or kind == "application/json" or ident in STATE_SCRIPT_IDS:
                for body in article_bodies(data.replace(_AMP, "&"), kind.startswith("application/ld+json")):
                    self._emit("json-ld" if kind.startswith("application/ld+json") else "script-state", body)
            return
        self._text(data)


def article_bodies(text: str, linked_data: bool) -> list[str]:
    """String bodies at any depth of a JSON document; linked data must be typed as an article."""
    try:
        todo = [json.loads(text.strip().removeprefix("<!--").removesuffix("-->"))]
    except ValueError:
        return []
    found = []
    while todo:
        node = todo.pop(0)
        if isinstance(node, list):
            todo = node + todo
        elif isinstance(node, dict):
            kind = node.get("@type", "")
            typed = "Article" in (" ".join(map(str, kind)) if isinstance(kind, list) else str(kind))
            if isinstance(node.get("articleBody"), str) and (typed or not linked_data):
                found.append(node["articleBody"])
            todo = [v for v in node.values() if isinstance(v, dict | list)] + todo
    return found


def body_candidates(pages: DataFrame, source_pattern: str | None = None) -> DataFrame:
    """Candidate texts of every page, tagged with the strategy that found them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for pid, page in zip(pdf["page_id"], pdf["html"], strict=True):
                parser = _Candidates(source_pattern)
                parser.feed((page or "").replace("&", _AMP))
                parser.close()
                rows += [(pid, s, o, unicodedata.normalize("NFC", x.replace(_AMP, "&")), n) for s, o, x, n in parser.done]
            yield pd.DataFrame(rows, columns=["page_id", "strategy", "source_offset", "raw_text", "anchor_chars"])

    return pages.select("page_id", "html").mapInPandas(
        run, "page_id bigint, strategy string, source_offset bigint, raw_text string, anchor_chars bigint")


def article_lines(text: Column) -> Column:
    """Trimmed non-empty lines without page furniture."""
    clean = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), "\x00", "")
    lines = F.transform(F.split(clean, "\n"), lambda x: F.trim(F.regexp_replace(x, "[\t  ]+", " ")))
    furniture = "|".join(f"(?:{p})" for p in BOILERPLATE_LINES)
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(furniture))


def clean_candidates(candidates: DataFrame) -> DataFrame:
    """Body text of each candidate: entities decoded, furniture and immediately repeated lines dropped."""
    decoded = candidates.withColumn("_d", X.decode_entities(F.col("raw_text")))
    lines = decoded.withColumn("_l", article_lines(F.col("_d")))
    prev = F.concat(F.array(F.lit(None).cast("string")), F.slice("_l", 1, F.greatest(F.size("_l") - 1, F.lit(0))))
    kept = F.filter(F.arrays_zip(F.col("_l").alias("cur"), prev.alias("prev")), lambda p: ~p["cur"].eqNullSafe(p["prev"]))
    return lines.withColumn("body_text", F.array_join(F.transform(kept, lambda p: p["cur"]), "\n")).drop("_d", "_l", "raw_text")


def text_statistics(df: DataFrame) -> DataFrame:
    """Shape of each body text, from ``body_text`` and ``anchor_chars``."""
    body = F.col("body_text")
    compact = F.length(F.regexp_replace(body, r"\s", ""))
    lines = F.filter(F.split(body, "\n"), lambda x: x != "")
    long_lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= 20)
    n = F.greatest(F.size(lines), F.lit(1))
    out = df.withColumns({"_c": compact.cast("bigint"), "_lines": lines, "_long": long_lines})
    return out.withColumns({
        "chars": F.length(body).cast("bigint"),
        "meaningful_ratio": F.coalesce(C.ratio(F.regexp_count(body, F.lit(r"[\p{L}\p{N}]")), F.col("_c")), F.lit(0.0)),
        "sentence_signals": (F.regexp_count(body, F.lit("[.!?。！？](?:[\"'”’)]|$|\\s)")) + F.regexp_count(body, F.lit(r"[가-힣](?:다|요|죠|음|함)[.!?](?:\s|$)"))).cast("bigint"),
        "paragraphs": F.size(F.filter(F.split(body, "\n"), lambda x: F.length(x) >= 35)).cast("bigint"),
        "anchor_ratio": F.coalesce(C.ratio(F.col("anchor_chars"), F.col("_c")), F.lit(1.0)),
        "short_line_ratio": F.size(F.filter("_lines", lambda x: F.length(x) < 18)).cast("double") / F.greatest(F.size("_lines"), F.lit(1)),
        "boilerplate_hits": F.regexp_count(body, F.lit(BOILERPLATE_WORDS)).cast("bigint"),
        "repeated_line_ratio": F.when(F.size("_long") < 2, F.lit(0.0)).otherwise(
            (F.size("_long") - F.size(F.array_distinct("_long"))).cast("double") / F.size("_long")),
    }).drop("_c", "_lines", "_long")


def _clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def quality_score(stats: DataFrame) -> DataFrame:
    """Additive quality in [0, 1]; zero outside the length limits."""
    n = F.col("chars")
    length = F.when(n < 450, 0.08).when(n < 800, 0.16).when(n < 1500, 0.23).when(n < 8000, 0.28).otherwise(0.25)
    bonus = F.when(F.col("strategy") == "json-ld", STRATEGY_BONUS["json-ld"])
    for name, value in STRATEGY_BONUS.items():
        if name != "json-ld":
            bonus = bonus.when(F.col("strategy") == name, value)
    score = (
        F.lit(0.2) + length + _clamp(F.col("sentence_signals") / 10) * 0.12 + _clamp(F.col("paragraphs") / 5) * 0.1
        + _clamp((F.col("meaningful_ratio") - 0.45) / 0.4) * 0.17 + F.coalesce(bonus, F.lit(0.0))
        - _clamp((F.col("anchor_ratio") - 0.08) / 0.42) * 0.28 - _clamp((F.col("short_line_ratio") - 0.45) / 0.45) * 0.1
        - _clamp(F.col("boilerplate_hits") / 5) * 0.18 - F.col("repeated_line_ratio") * 0.18)
    return stats.withColumn("quality", F.when(n.between(MIN_CHARS, MAX_CHARS), _clamp(score)).otherwise(0.0))


def best_body(scored: DataFrame, min_quality: float = MIN_QUALITY) -> DataFrame:
    """Best candidate per page: repeats (same head and tail) keep their best quality, then quality,
    length and position decide; pages without an acceptable candidate are left out."""
    fp = F.sha2(F.concat(F.left("body_text", F.lit(320)), F.right("body_text", F.lit(160))), 256)
    rows = scored.filter(F.col("body_text") != "").withColumn("_fp", fp)
    unique = top_per_key(rows, ["page_id", "_fp"], [F.col("quality").desc(), F.col("source_offset")])
    best = top_per_key(unique, ["page_id"], [F.col("quality").desc(), F.col("chars").desc(), F.col("source_offset")])
    return best.filter(F.col("quality") >= min_quality).drop("_fp")


def page_text(html: Column) -> Column:
    """Visible text of a page by tag stripping, for restriction checks."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    for tag in sorted(REMOVED_TAGS):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "<[^>]+>", " "), r"\s+", " "))


def access_restricted(pages: DataFrame, patterns=RESTRICTED_TEXTS) -> DataFrame:
    """Structured or visible paywall flags of each page."""
    df = pages.select("page_id", "html", page_text(F.col("html")).alias("_t"))
    linked = F.col("html").rlike(r'(?i)"isAccessibleForFree"\s*:\s*"?false')
    meta = F.col("html").rlike(r"""(?i)<meta\b[^>]*isAccessibleForFree[^>]*content\s*=\s*["']?\s*false|<meta\b[^>]*content\s*=\s*["']?\s*false[^>]*isAccessibleForFree""")
    hits = sum((F.col("_t").rlike(p).cast("int") for p in patterns), F.lit(0))
    return df.select("page_id", (linked | meta).alias("structured"), ((hits >= 2) & (F.length("_t") < 3000)).alias("visible"))


def extract_page_body(pages: DataFrame, source_pattern: str | None = None) -> DataFrame:
    """Best body text, strategy and quality of each open page."""
    # both stages are written out once: the filters on them would otherwise be pushed below the regular
    # expressions they test and repeat them for every reference
    flags = cut_lineage(access_restricted(pages))
    open_pages = pages.join(flags.filter(F.col("structured") | F.col("visible")).select("page_id"), "page_id", "left_anti")
    blocked = "|".join(f"(?:{p})" for p in RESTRICTED_TEXTS)
    cleaned = cut_lineage(clean_candidates(body_candidates(open_pages, source_pattern)))
    # one restricted candidate withholds its page; same partitioning as the choice that follows
    walled = F.max(F.col("body_text").rlike(blocked)).over(Window.partitionBy("page_id"))
    scored = quality_score(text_statistics(cleaned.withColumn("_walled", walled).filter(~F.col("_walled")).drop("_walled")))
    return best_body(scored).select("page_id", "body_text", "strategy", C.half_up(F.col("quality"), 3).alias("quality"))


def page_topic(html: Column) -> Column:
    """Topic from the page's declared section; a section outside the four topics is excluded, none is null."""
    section = R.json_ld_field(html, ["articleSection"])
    return F.when(section.isNotNull(), X.first_rule(section, SECTION_TOPICS, "excluded"))


def title_lineage(pages: DataFrame, feed_title: Column | None = None) -> DataFrame:
    """Headline with the place it came from: linked data, og:title, title element, feed."""
    og = F.nullif(F.trim(F.regexp_extract("html", r"""(?is)<meta\b[^>]*property\s*=\s*["']og:title["'][^>]*content\s*=\s*["']([^"']*)["']""", 1)), F.lit(""))
    element = F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title>", 1)), F.lit(""))
    sources = [("jsonld_headline", R.json_ld_field(F.col("html"), ["headline"])), ("og_title", og), ("html_title", element)]
    if feed_title is not None:
        sources.append(("rss_title", F.nullif(F.trim(feed_title), F.lit(""))))
    label = F.when(sources[0][1].isNotNull(), sources[0][0])
    for name, col in sources[1:]:
        label = label.when(col.isNotNull(), name)
    title = X.decode_entities(F.coalesce(*[c for _, c in sources], F.lit("")))
    return pages.select("page_id", title.alias("title"), label.otherwise("title_unavailable").alias("title_source"))


def feed_entries(docs: DataFrame, kind: str, text: str = "html") -> DataFrame:
    """Entries (title, url, published_at text) of feeds, sitemaps, sitemap indexes or pages of links."""
    if kind != "links":
        return feed_rows(docs, kind, "page_id", text)
    rows = docs.select("page_id", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))).alias("position", "_b"))
    href = F.regexp_extract("_b", r"""(?is)^<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']""", 1)
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("_b", r"(?is)^<a\b[^>]*>|</a>$", ""), "<[^>]+>", " "), r"\s+", " "))
    out = rows.select("page_id", F.col("position").cast("bigint").alias("position"), X.decode_entities(title).alias("title"), href.alias("url"), F.lit(None).cast("string").alias("published"))
    return out.filter((F.col("title") != "") & (F.col("url") != ""))
