"""Text columns: normalization, tokens, sentences, morphology. Word lists are parameters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from pressgrain.lexicons import korean as K

# characters for which compatibility normalization changes nothing
STABLE = r"^[\x00-\x7F]*+(?:[À-ÖØ-öø-ÿ가-힣一-龥–—‘’“”·]++[\x00-\x7F]*+)*+$"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(text: Column) -> Column:
    """Compatibility normalization; only texts that can change are sent to Python (Arrow batches)."""
    # a text of as many bytes as characters is ASCII; the regular expression need not look at it
    return F.coalesce(_nfkc(F.when((F.octet_length(text) != F.length(text)) & ~text.rlike(STABLE), text)), text)


def any_of(words: Sequence[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is named there."""
    return F.transform(F.array(value), then)[0]


# fixed value: white space of a regular expression
BLANKS = " \t\n\x0b\f\r"


def _holds(*parts: str) -> Callable[[Column], Column]:
    def test(x: Column) -> Column:
        out = F.contains(x, F.lit(parts[0]))
        for p in parts[1:]:
            out = out | F.contains(x, F.lit(p))
        return out

    return test


def _replaced(pattern: str, repl: str, needs: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(needs(x), F.regexp_replace(x, pattern, repl)).otherwise(x)


def strip(text: Column) -> Column:
    """Text without the white space at its ends. Only a text that has some among its last characters is searched for it."""
    return let(F.ltrim(text, F.lit(BLANKS)), lambda x: F.when(F.right(x, F.lit(3)).rlike(r"\s"), F.regexp_replace(x, r"\s+$", "")).otherwise(x))


def normalize_text(text: Column) -> Column:
    """Strip scripts, styles, tags and zero-width characters; collapse blanks and blank lines.

    A step runs only on texts that hold what it needs at least, which is far cheaper to look for.
    """
    steps = (
        (r"\r\n?", "\n", _holds("\r")),
        (r"(?is)<script\b[^>]*>.*?</script>", " ", _holds("<")),
        (r"(?is)<style\b[^>]*>.*?</style>", " ", _holds("<")),
        (r"<[^>]+>", " ", _holds("<")),
        ("[​-‍﻿]", "", lambda x: F.octet_length(x) != F.length(x)),
        (r"[ \t]+", " ", _holds("  ", "\t")),
        (r" *\n *", "\n", _holds(" \n", "\n ")),
        (r"\n{3,}", "\n\n", _holds("\n\n\n")),
    )
    out = text
    for pattern, repl, needs in steps:
        out = let(out, _replaced(pattern, repl, needs))
    return strip(out)


def _letters(text: Column, between: str) -> Column:
    """Lower-case text with ``between`` for all that is neither digit nor letter. A class of narrow characters is looked up in one table, the wide one
    in a chain of tests that takes nine times as long, so only texts with Hangul are searched for that."""
    return let(text, lambda x: F.when((F.octet_length(x) == F.length(x)) | ~x.rlike("[가-힣]"), F.regexp_replace(x, "[^0-9a-z]+", between)).otherwise(
        F.regexp_replace(x, "[^0-9a-z가-힣]+", between)))


def title_key(title: Column) -> Column:
    """Key under which equal headlines meet: letters and digits only, lower case."""
    return _letters(F.lower(nfkc(title)), "")


def candidate_title_key(title: Column, tokens: int = 3) -> Column:
    """First words of a headline, for cheap candidate groups."""
    words = F.split(F.regexp_replace(F.lower(title), "[^0-9a-z가-힣 ]+", " "), " ")
    return F.array_join(F.slice(F.filter(words, lambda w: F.length(w) >= 2), 1, tokens), " ")


def clean_token(token: Column, particles: Sequence[str] = K.TOKEN_PARTICLES) -> Column:
    bare = F.regexp_replace(token, "^[0-9]+|[0-9]+$", "")
    return F.regexp_replace(bare, any_of(particles) + "$", "")


def title_tokens(title: Column, stopwords: Sequence[str] = K.STOPWORDS, roles: Sequence[str] = K.ROLE_SUFFIXES) -> Column:
    """Distinct tokens of the whole title in order; compounds ending in a role word also give stem and role."""
    flat = F.regexp_replace(F.lower(nfkc(title)), r"\[[^\]]*\]|\([^)]*\)", " ")
    words = F.split(_letters(flat, " "), " ")
    kept = F.filter(F.transform(words, lambda w: clean_token(w)), lambda w: (F.length(w) >= 2) & ~w.isin(*stopwords))
    compound = "^(.{2,}?)(" + "|".join(roles) + ")$"

    def expand(w: Column) -> Column:
        stem = F.regexp_extract(w, compound, 1)
        return F.when(stem != "", F.array(w, stem, F.regexp_extract(w, compound, 2))).otherwise(F.array(w))

    return F.array_distinct(F.flatten(F.transform(kept, expand)))


def _cleaned_words(body: Column, particles: Sequence[str] = K.TOKEN_PARTICLES) -> Column:
    """Words of a text, each as ``clean_token`` leaves it. The text is cleaned as a whole, where a word ends at a blank, so no pattern runs for each word."""
    plain = let(F.lower(nfkc(body)), _replaced(r"https?://\S+", " ", _holds("http")))
    bare = let(_letters(plain, " "), lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, "(?<![^ ])[0-9]+|[0-9]+(?![^ ])", "")).otherwise(x))
    # the particles are Hangul or words like these; a text of as many bytes as characters has none of the former
    narrow = any(p.isascii() for p in particles)
    ends = any_of(particles) + "(?![^ ])"
    return F.split(let(bare, lambda x: F.regexp_replace(x, ends, "") if narrow else _replaced(ends, "", lambda y: F.octet_length(y) != F.length(y))(x)), " ")


def body_words(body: Column, stopwords: Sequence[str] = K.BODY_STOPWORDS) -> Column:
    """All countable body words, in order and with repeats."""
    return F.filter(_cleaned_words(body), lambda w: (F.length(w) >= 2) & ~w.isin(*stopwords))


def distinct_body_words(body: Column, stopwords: Sequence[str] = K.BODY_STOPWORDS) -> Column:
    """The distinct ones of ``body_words``."""
    return F.filter(F.array_distinct(_cleaned_words(body)), lambda w: (F.length(w) >= 2) & ~w.isin(*stopwords))


def actors(title: Column, pattern: str = K.ACTOR_PATTERN) -> Column:
    return F.array_distinct(F.regexp_extract_all(title, F.lit(pattern), F.lit(1)))


def classes_containing(text: Column, classes: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Names of the classes any of whose words occurs in the text."""
    def hit(words: Sequence[str]) -> Column:
        out = text.contains(words[0])
        for w in words[1:]:
            out = out | text.contains(w)
        return out

    return F.array_compact(F.array(*[F.when(hit(words), F.lit(name)) for name, words in classes]))


def concepts(title: Column, rules: Sequence[tuple[str, Sequence[str]]] = K.CONCEPTS) -> Column:
    """Concept keys all of whose patterns match."""
    def hit(patterns: Sequence[str]) -> Column:
        out = title.rlike(patterns[0])
        for p in patterns[1:]:
            out = out & title.rlike(p)
        return out

    return F.array_compact(F.array(*[F.when(hit(p), F.lit(k)) for k, p in rules]))


def first_rule(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Code of the first rule whose pattern matches."""
    out = F.when(text.rlike(rules[0][1]), rules[0][0])
    for code, pattern in rules[1:]:
        out = out.when(text.rlike(pattern), code)
    return out.otherwise(default) if default is not None else out


def most_matches(text: Column, rules: Sequence[tuple[str, str]], minimum: Column | int = 1) -> Column:
    """Code with the most matches; the earlier rule wins ties; null below ``minimum``."""
    scored = F.array(*[
        F.struct(F.regexp_count(text, F.lit(p)).alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, (c, p) in enumerate(rules)])
    best = F.array_max(scored)
    return F.when(best["n"] >= minimum, best["c"])


def category_classify(section: Column, title: Column, section_rules=K.SECTION_CATEGORIES, title_rules=K.TITLE_CATEGORIES) -> Column:
    """Section decides first, then the category with most title keywords; null means not an agenda article."""
    by_section = F.when(section.rlike(section_rules[0][1]), section_rules[0][0])
    for name, pattern in section_rules[1:]:
        by_section = by_section.when(section.rlike(pattern), name)
    return (
        F.when(section.rlike(K.SPORTS_SECTION) | title.rlike(K.SPORTS_TITLE), K.CATEGORY_SPORTS)
        .when(section.rlike(K.EXCLUDED_SECTION), F.lit(None).cast("string"))
        .when(section.rlike(K.TECH_SECTION) & ~title.rlike(K.PUBLIC_TECH_TITLE), K.CATEGORY_TECH)
        .otherwise(F.coalesce(by_section, most_matches(title, title_rules)))
    )


def hard_negative_sides(title: Column, rules: Sequence[tuple[str, str]] = K.HARD_NEGATIVES) -> tuple[Column, Column]:
    """Indices of the rules whose first / second pattern matches; a pair splits when sides cross."""
    first = F.array_compact(F.array(*[F.when(title.rlike(a), F.lit(i)) for i, (a, _) in enumerate(rules)]))
    second = F.array_compact(F.array(*[F.when(title.rlike(b), F.lit(i)) for i, (_, b) in enumerate(rules)]))
    return first, second


def headline_text(title: Column) -> Column:
    """Title without brackets, by-line, quotes and runs of punctuation."""
    out = title
    for pattern, repl in (
        (r"\[[^\]]*\]|\([^)]*\)|<[^>]*>", " "),
        (r"^[0-9가-힣A-Za-z]+\s*기자\s*=", ""),
        ("[\"'“”‘’]", " "),
        (r"[`()\[\]]", " "),
        (r"[.?!…:\-]+", " "),
        (r"\s+", " "),
    ):
        out = F.regexp_replace(out, pattern, repl)
    return F.trim(out)


def headline_cleanup(title: Column, cap: int = 58) -> Column:
    """Readable headline: the cleaned title without nested repeats, of bounded length."""
    words = F.filter(F.split(headline_text(title), " "), lambda w: w != "")

    def step(acc: Column, w: Column) -> Column:
        prev = F.try_element_at(acc, F.lit(-1))
        nested = (
            (F.length(w) >= 2) & (F.length(prev) >= 2) & (F.endswith(prev, w) | F.endswith(w, prev))
            & (F.abs(F.length(w) - F.length(prev)) <= 2))
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(w))
        return (
            F.when(F.size(acc) == 0, F.array(w))
            .when(prev == w, acc)
            .when(nested, F.when(F.length(w) > F.length(prev), longer).otherwise(acc))
            .otherwise(F.concat(acc, F.array(w)))
        )

    text = F.array_join(F.aggregate(words, F.array().cast("array<string>"), step), " ")
    text = F.trim(F.regexp_replace(text, r"\s+(?:관련\s+)?이슈$", ""))
    clause = F.trim(F.regexp_extract(text, r"^(.*?)(?:\s*[|·]\s*|\s+[―–—]\s+)", 1))
    cut = F.concat(F.rtrim(F.left(text, F.lit(cap - 1))), F.lit("…"))
    return F.when(F.length(text) <= cap, text).when(F.length(clause).between(10, cap), clause).otherwise(cut)


# fixed values: named entities of the decoder
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&hellip;", "…"), ("&ldquo;", "“"),
    ("&rdquo;", "”"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&mdash;", "—"), ("&ndash;", "–"), ("&middot;", "·"),
)


_ENTITY = re.compile("&(#x[0-9a-f]+|#[0-9]+|amp|" + "|".join(n[1:-1] for n, _ in ENTITIES) + ");", re.I)
_BY_NAME = {n[1:-1]: c for n, c in ENTITIES} | {"amp": "&"}


def decode_entities_text(value: str) -> str:
    """Single-pass decoder used where numeric entities occur."""
    def one(m: re.Match) -> str:
        name = m.group(1).lower()
        try:
            if name.startswith("#x"):
                return chr(int(name[2:], 16))
            if name.startswith("#"):
                return chr(int(name[1:]))
        except (ValueError, OverflowError):
            return m.group(0)
        return _BY_NAME[name]

    return _ENTITY.sub(one, value)


@F.pandas_udf(StringType())
def _numeric_entities(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else decode_entities_text(v))


def decode_entities(text: Column) -> Column:
    """Named entities by replacement; only texts with numeric entities are sent to Python."""
    out = text
    for name, char in ENTITIES:
        out = F.regexp_replace(out, "(?i)" + name, char)
    named = F.regexp_replace(out, "(?i)&amp;", "&")
    return F.coalesce(_numeric_entities(F.when(text.rlike("&#"), text)), named)


# -- sentences ------------------------------------------------------------------------------------

SENTENCE = "[^.!?。！？]+(?:[.!?。！？]+[\"”’]?)?"
# for texts without the wide marks; a class of narrow ones only is looked up in one table
NARROW_SENTENCE = "[^.!?]+(?:[.!?]+[\"”’]?)?"


def paragraphs(normalized: Column) -> Column:
    """Blank-line paragraphs; a text without blank lines falls back to its lines."""
    one_block = ~F.contains(normalized, F.lit("\n\n")) & F.contains(normalized, F.lit("\n"))
    return F.filter(F.split(normalized, F.when(one_block, F.lit("\n+")).otherwise(F.lit("\n{2,}"))), lambda p: p != "")


def sentences_of(paragraph: Column) -> Column:
    """Sentences of at least two characters; a paragraph that has none stays whole."""
    wide, narrow = (F.regexp_extract_all(paragraph, F.lit(p), F.lit(0)) for p in (SENTENCE, NARROW_SENTENCE))
    found = F.transform(F.when(_holds("。", "！", "？")(paragraph), wide).otherwise(narrow), lambda s: strip(s))
    return F.filter(found, lambda s: F.length(s) >= 2)


# -- morphology -----------------------------------------------------------------------------------

def morph_units(text: Column) -> Column:
    return units_of(nfkc(text))


def units_of(normal: Column) -> Column:
    """Units of a text in compatibility normal form."""
    # an address can only begin where no character of one stands before it, unless the last match ended there
    address = r"https?://\S+|www\.\S+|(?:(?<![\w.+-])|\G)[\w.+-]+@[\w.-]+\.[a-z]{2,}"
    clean = let(F.lower(normal), _replaced(address, " ", _holds("http", "www.", "@")))
    # zero-width characters part units as any other character that is in none
    return F.regexp_extract_all(clean, F.lit(r"[가-힣]+|[a-z]+(?:[.-][a-z]+)*|[0-9]+(?:[.,][0-9]+)*"), F.lit(0))


def predicate_lemma(surface: Column) -> Column:
    """Dictionary form of a predicate, or null. One regular expression per rule group."""
    out = F.when(surface.isin(*K.NEGATION_LEMMAS), surface)
    for lemma, forms in K.PREDICATE_FORMS:
        out = out.when(surface.rlike(f"^(?:{forms})$"), lemma)
    out = (
        out.when(surface.rlike(K.NEGATION_FORM), F.when(surface.startswith("아니"), "아니다").when(surface.startswith("못하"), "못하다")
                 .when(surface.startswith("없"), "없다").otherwise("않다"))
    )
    stem = f"^({'|'.join(K.PREDICATE_STEMS)})(?:{K.STEM_ENDINGS})*$"
    generic = f"^([가-힣]{{2,}}?)(?:{K.GENERIC_PREDICATE_ENDINGS})$"
    return out.when(surface.rlike(stem), F.concat(F.regexp_extract(surface, stem, 1), F.lit("하다"))).when(
        surface.rlike(generic), F.concat(F.regexp_extract(surface, generic, 1), F.lit("하다")))


def morph_struct(surface: Column) -> Column:
    """array<struct<surface, lemma, pos>> of one unit: a Hangul unit may split into stem and particle."""
    def tok(s: Column, lemma: Column, pos: Column) -> Column:
        return F.struct(s.alias("surface"), lemma.alias("lemma"), pos.alias("pos"))

    def hangul(s: Column) -> Column:
        longest = f"^(.+?)({'|'.join(sorted(K.MORPH_PARTICLES, key=len, reverse=True))})$"
        stem, particle = F.regexp_extract(s, longest, 1), F.regexp_extract(s, longest, 2)
        lemma, stem_lemma = predicate_lemma(s), predicate_lemma(stem)
        return (
            F.when(s.isin(*K.MORPH_PARTICLES), F.array(tok(s, s, F.lit("particle"))))
            .when(lemma.isNotNull(), F.array(tok(s, lemma, F.lit("predicate"))))
            .when(stem != "", F.array(
                tok(stem, F.coalesce(stem_lemma, stem), F.when(stem_lemma.isNotNull(), "predicate").otherwise("noun")),
                tok(particle, particle, F.lit("particle"))))
            .otherwise(F.array(tok(s, s, F.lit("noun")))))

    # the many rules for Hangul stand apart: in one expression with the others they are too much code for the JVM to compile
    first = F.left(surface, F.lit(1))
    return (
        F.when(first.between("0", "9"), F.array(tok(surface, F.replace(surface, F.lit(","), F.lit("")), F.lit("number"))))
        .when(first.between("a", "z"), F.array(tok(surface, surface, F.lit("foreign"))))
        .otherwise(let(surface, hangul)))


def is_content(lemma: Column, pos: Column, stopwords: Sequence[str] = K.CONTENT_STOPWORDS) -> Column:
    return pos.isin("noun", "predicate", "foreign") & F.length(lemma).between(2, 20) & ~_holds("http", "www.", "@")(lemma) & ~lemma.isin(*stopwords)
