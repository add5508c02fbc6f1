"""Event clustering: articles of one run (a business day) into issues.

The unit of clustering is a headline: articles of a run whose normalized titles are equal always belong
together, so any number of copies is one weighted unit. Units meet in pairs of blocks, an ordered rule
list decides whether two units may be the same event, and complete-link clusters are grown in id order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pressgrain.functions import columns as C, text as X
from pressgrain.lexicons import korean as K
from pressgrain.operators import pairs as P
from pressgrain.session import cut_lineage


@dataclass(frozen=True)
class Lexicon:
    """Word lists and rules of the clustering; the defaults are Korean."""

    stopwords: Sequence[str] = K.STOPWORDS
    body_stopwords: Sequence[str] = K.BODY_STOPWORDS
    generic: Sequence[str] = K.GENERIC_EVENT_TOKENS
    roles: Sequence[str] = K.ROLE_SUFFIXES
    distinctive: Sequence[str] = K.DISTINCTIVE_EVENT_TOKENS
    actor_pattern: str = K.ACTOR_PATTERN
    actions: Sequence = K.ACTIONS
    concepts: Sequence = K.CONCEPTS
    hard_negatives: Sequence = K.HARD_NEGATIVES
    section_categories: Sequence = K.SECTION_CATEGORIES
    title_categories: Sequence = K.TITLE_CATEGORIES


def _article_base(articles: DataFrame, lex: Lexicon) -> DataFrame:
    """Features of the title and distinct body words of every article that has a category (the others are not agenda articles)."""
    title = X.nfkc(F.col("title"))
    first, second = X.hard_negative_sides(F.col("title"), lex.hard_negatives)
    df = articles.withColumn("category", X.category_classify(F.col("section"), F.col("title"), lex.section_categories, lex.title_categories))
    return df.filter(F.col("category").isNotNull()).select(
        "run", "article_id", "category",
        F.length("title").alias("title_chars"),
        # a title without any key character is like no other title
        F.when(X.title_key(F.col("title")) != "", X.title_key(F.col("title"))).otherwise(F.concat(F.lit("#"), F.col("article_id").cast("string"))).alias("title_key"),
        X.title_tokens(F.col("title"), lex.stopwords, lex.roles).alias("t"),
        X.actors(title, lex.actor_pattern).alias("actors"),
        X.concepts(title, lex.concepts).alias("concepts"),
        X.classes_containing(F.concat_ws(" ", title, "body_text"), lex.actions).alias("actions"),
        first.alias("hn1"), second.alias("hn2"),
        X.distinct_body_words(F.col("body_text"), lex.body_stopwords).alias("words"),
    )


def frequent_tokens(base: DataFrame) -> DataFrame:
    """(run, dropped, common): body tokens too common in the run, and those among the others that are no anchors, since only rare ones are.

    The limits follow the number of articles of the run, so however many these are, only as many tokens are frequent as articles have on average, some fifty times.
    """
    sizes = base.groupBy("run").agg(F.count(F.lit(1)).alias("_articles"))
    df = base.select("run", F.explode("words").alias("token")).groupBy("run", "token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 3).join(sizes, "run")
    limit = lambda least, share: F.greatest(F.lit(least), F.ceil(F.col("_articles") * F.lit(share)))
    often = df.filter(F.col("df") > limit(3, 0.02)).withColumn("_drop", F.col("df") > limit(5, 0.08))
    lists = often.groupBy("run").agg(F.collect_list(F.when(F.col("_drop"), F.col("token"))).alias("dropped"), F.collect_list(F.when(~F.col("_drop"), F.col("token"))).alias("common"))
    return cut_lineage(lists)


def _body_tokens(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """``rows`` with b, the body tokens of ``words`` that are not too common in the run, and k, its anchors, both sorted."""
    known = rows.join(frequent, "run", "left")
    kept = known.withColumn("b", F.when(F.col("dropped").isNull(), F.col("words")).otherwise(F.array_except("words", "dropped")))
    rare = kept.withColumn("k", F.when(F.col("common").isNull(), F.col("b")).otherwise(F.array_except("b", "common")))
    return rare.withColumns({"b": F.array_sort("b"), "k": F.array_sort("k")}).drop("words", "dropped", "common")


def headline_units(articles: DataFrame, lex: Lexicon = Lexicon()) -> tuple[DataFrame, DataFrame]:
    """(units, membership): one unit per (run, normalized title), named and titled by its first article.

    Its body tokens and actions are those of all articles with that headline. The texts are read once; articles move once, to those of their headline, and are
    written out with their words, so later steps never go back to the texts. Only the words of headlines with several articles move once more. What
    follows from the tokens of a unit is not written but worked out where it is read.
    """
    same = Window.partitionBy("run", "title_key")
    base = cut_lineage(_article_base(articles, lex).withColumns({"unit_id": F.min("article_id").over(same), "weight": F.count(F.lit(1)).over(same)}))
    membership = base.select("run", "unit_id", "article_id")
    frequent = frequent_tokens(base)
    alone = base.filter("weight = 1").withColumn("actions", F.array_sort("actions")).drop("article_id", "title_key")
    several = base.filter("weight > 1")
    words = several.select("run", "unit_id", F.explode("words").alias("token")).groupBy("run", "unit_id").agg(F.collect_set("token").alias("words"))
    actions = several.groupBy("run", "unit_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("actions")))).alias("actions"))
    empty = F.array().cast("array<string>")
    carriers = several.filter("article_id = unit_id").drop("words", "actions", "article_id", "title_key").join(actions, ["run", "unit_id"]).join(words, ["run", "unit_id"], "left")
    whole = alone.unionByName(carriers.withColumn("words", F.coalesce("words", empty)))
    whole = whole.withColumn("words", F.coalesce("words", empty))
    units = cut_lineage(_body_tokens(whole, frequent))
    units = units.withColumn("c", F.array_union("t", "b"))
    units = units.withColumn("d", F.filter("c", lambda x: ~x.isin(*lex.generic)))
    units = units.withColumn("topic", F.filter("d", lambda x: ~x.isin(*lex.roles)))
    return units.withColumns({
        "idx": F.when(F.size("d") > 0, F.col("d")).otherwise(F.col("t")),
        "distinctive": F.filter("topic", lambda x: x.isin(*lex.distinctive))}), membership


def token_pairs(units: DataFrame) -> DataFrame:
    """Unit pairs (src after dst in id order) sharing a token or concept, with the counts they share."""
    return P.shared(units)


def _jaccard(shared: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return shared / np.maximum(one + other - shared, 1)


def _alike(shared: dict, one: dict, other: dict) -> np.ndarray:
    bodies = (one["body"] > 0) & (other["body"] > 0)
    return (shared["shared_concepts"] > 0) | (_jaccard(shared["shared_title"], one["title"], other["title"]) >= 0.15) | (bodies & (_jaccard(shared["shared_all"], one["all"], other["all"]) >= 0.10))


def _decidable(shared: dict, one: dict, other: dict) -> np.ndarray:
    strong = (shared["shared_concepts"] > 0) | (shared["shared_anchors"] >= 2) | (_jaccard(shared["shared_title"], one["title"], other["title"]) >= 0.15)
    return _alike(shared, one, other) & (strong | (_jaccard(shared["shared_all"], one["all"], other["all"]) >= 0.2495))


def similar_pairs(units: DataFrame) -> DataFrame:
    """The pairs of ``token_pairs`` that have a feature every rule asks for (see ``pair_features``):
    a shared concept, a title similarity of .15 or a content similarity of .10. They carry shared_topic and what ``pair_features`` asks for as well."""
    return P.shared(units, _alike, related=True, traits=True)


def event_pairs(units: DataFrame) -> DataFrame:
    """The pairs of ``similar_pairs`` that some rule may find compatible.

    Of the rules that join, 4 needs a shared concept; 8 (by its second condition), 10 and 11 need two shared anchors; 8 (by its first) and 12 a
    title similarity of .15; 14 a blended similarity of .25, rounded to three digits, and so .2495 in title or content.
    """
    return P.shared(units, _decidable, related=True, traits=True)


def pair_features(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """Similarities and shared event features of each pair that can pass any rule.

    A pair sharing no concept needs a title similarity of .15 or a content similarity of .10 in every
    rule. ``similar_pairs`` and ``event_pairs`` carry all that is asked of a pair; pairs that do not are joined with their units.
    """
    p = pairs if "same_category" in pairs.columns else _joined_traits(units, pairs)
    bodies = (F.col("nb1") > 0) & (F.col("nb2") > 0)
    tj = F.coalesce(C.ratio(F.col("shared_title"), F.col("nt1") + F.col("nt2") - F.col("shared_title")), F.lit(0.0))
    cj = F.when(bodies, F.coalesce(C.ratio(F.col("shared_all"), F.col("nc1") + F.col("nc2") - F.col("shared_all")), F.lit(0.0)))
    p = p.withColumns({"title_jaccard": tj, "content_jaccard": cj})
    p = p.withColumns({
        "similarity": C.blended_similarity(F.col("title_jaccard"), F.coalesce("content_jaccard", F.lit(0.0)), bodies),
        "overlap": F.col("shared_title") + F.when(bodies, F.col("shared_all")).otherwise(0)})
    possible = (F.col("shared_concepts") > 0) | (F.col("title_jaccard") >= 0.15) | (F.coalesce("content_jaccard", F.lit(0.0)) >= 0.10)
    return p.filter(possible)


def _joined_traits(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with the columns of ``pairs.TRAIT_COLUMNS`` and shared_topic, read from their units."""
    sizes = [F.size(c).alias(f"n{c}") for c in "tbcd"]
    cols = (*P.TRAITS, "topic", "nt", "nb", "nc", "nd")
    of_unit = units.select("run", "unit_id", *P.TRAITS, "topic", *sizes)
    left, right = (of_unit.select("run", F.col("unit_id").alias(end), *[F.col(c).alias(f"{s}_{c}") for c in cols]) for s, end in (("l", "src"), ("r", "dst")))
    p = pairs.join(left, ["run", "src"]).join(right, ["run", "dst"])
    both = lambda c: F.size(F.array_intersect(f"l_{c}", f"r_{c}"))
    p = p.withColumns({
        "shared_topic": related_count(F.col("l_topic"), F.col("r_topic")),
        "shared_distinctive": prefix_count(F.col("l_distinctive"), F.col("r_distinctive"), 0),
        "shared_actors": both("actors"), "shared_actions": both("actions"),
        **{f"{n}{i}": F.col(f"{s}_{n}") for n in ("nt", "nb", "nc", "nd") for i, s in ((1, "l"), (2, "r"))},
        **{f"{n}_{end}": F.size(f"{s}_{n}") for n in ("actors", "actions", "distinctive") for end, s in (("left", "l"), ("right", "r"))},
        "same_category": F.col("l_category") == F.col("r_category"),
        "hard_negative": F.arrays_overlap("l_hn1", "r_hn2") | F.arrays_overlap("l_hn2", "r_hn1"),
    })
    return p.drop(*[f"{s}_{c}" for s in "lr" for c in cols])


def _prefixes(tokens: Column, min_extra: int) -> Column:
    """All prefixes of at least two characters that leave ``min_extra`` more characters."""
    long = F.filter(tokens, lambda t: F.length(t) >= 2 + min_extra)
    cut = F.flatten(F.transform(long, lambda t: F.transform(F.sequence(F.lit(2), F.length(t) - min_extra), lambda i: F.left(t, i))))
    return F.array_distinct(cut)


def prefix_count(left: Column, right: Column, min_extra: int) -> Column:
    """Left tokens equal to, a prefix of, or extending a right token. Set operations on prefix sets
    replace the comparison of every left token with every right token."""
    shorter = F.array_intersect(left, F.array_union(right, _prefixes(right, min_extra)))
    stems = F.array_intersect(_prefixes(left, min_extra), right)
    longer = F.filter(left, lambda t: F.exists(stems, lambda s: F.startswith(t, s) & (F.length(t) >= F.length(s) + min_extra)))
    return F.size(F.array_union(shorter, longer))


def related_count(left: Column, right: Column) -> Column:
    """max(exact, related) shared topic tokens; two exact ones settle every rule, so the prefix sets are
    only built for pairs with fewer."""
    exact = F.size(F.array_intersect(left, right))
    return F.when(exact >= 2, exact).otherwise(F.greatest(exact, prefix_count(left, right, 2)))


def compatible_event(features: DataFrame) -> DataFrame:
    """Which rule of the ordered list decides each pair, and how."""
    c = F.col
    cj, tj, j = F.coalesce("content_jaccard", F.lit(-1.0)), c("title_jaccard"), c("similarity")
    identity = F.greatest("shared_discriminators", "shared_topic")
    staged = (
        ((c("shared_topic") >= 1) & (identity >= 2) & (tj >= 0.15) & (c("shared_title") >= 3) & ((c("shared_actors") >= 1) | (c("shared_topic") >= 2)))
        | ((c("shared_anchors") >= 2) & (c("shared_title") >= 1)))
    one_sided = lambda n, s: (c(f"{n}_left") > 0) & (c(f"{n}_right") > 0) & (c(s) == 0)
    df = features.withColumn("_staged", staged)
    s = c("_staged")
    rule = (
        F.when(c("hard_negative"), -2)
        .when(~c("same_category"), -3)
        .when(c("shared_concepts") > 0, 4)
        .when(one_sided("actors", "shared_actors"), -5)
        .when(one_sided("distinctive", "shared_distinctive"), -6)
        .when(one_sided("actions", "shared_actions") & ~s, -7)
        .when(s & (c("shared_title") >= 3) & (tj >= 0.18), 8)
        .when((c("actors_left") >= 2) & (c("actors_right") >= 2) & (c("shared_discriminators") < 1), -9)
        .when((c("shared_anchors") >= 3) & (cj >= 0.18) & (c("shared_actions") > 0), 10)
        .when((c("shared_anchors") >= 2) & (c("shared_title") >= 1) & (cj >= 0.10), 11)
        .when((c("shared_anchors") >= 1) & (c("shared_body") >= 4) & (c("shared_title") >= 2) & (tj >= 0.15) & (cj >= 0.14), 12)
        .when((c("actors_left") != c("actors_right")) & (j < 0.35), -13)
        .when((c("overlap") >= 2) & (c("shared_topic") >= 1) & (j >= 0.25), 14)
        .otherwise(-14))
    return df.withColumn("rule", F.abs(rule)).withColumn("compatible", rule > 0).drop("_staged")


def compatible_edges(units: DataFrame) -> DataFrame:
    """Compatible unit pairs: (run, src, dst, similarity, indexed) - ``indexed`` when they share an index token."""
    decided = compatible_event(pair_features(units, event_pairs(units))).filter("compatible")
    # a unit made of generic tokens only is indexed by its title tokens
    indexed = (F.col("shared_discriminators") > 0) | ((F.col("nd1") == 0) & (F.col("nd2") == 0) & (F.col("shared_title") > 0))
    return decided.select("run", "src", "dst", "similarity", indexed.alias("indexed"))


def _forests(edges: DataFrame) -> DataFrame:
    """(run, src, dst): of the edges of each task, those to the smallest node of what they tie together; a node has one edge a task at most."""
    kind, run_kind = dict(edges.dtypes)["src"], dict(edges.dtypes)["run"]

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}
        types: list = []

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            types = [c.type for c in batch.columns]
            for run, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                a, b = (run, a), (run, b)
                a, b = top(up.setdefault(a, a)), top(up.setdefault(b, b))
                if a != b:
                    up[max(a, b)] = min(a, b)
        tied = [(*x, top(x)[1]) for x in up if up[x] != x]
        for i in range(0, len(tied), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*tied[i : i + (1 << 16)]), types, strict=True)], ["run", "src", "dst"])

    return edges.select("run", "src", "dst").mapInArrow(tie, f"run {run_kind}, src {kind}, dst {kind}")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(run, node, component): component is the smallest node id. What the edges of a task tie together is found there first, so no more edges are left than
    nodes a task. Minimum labels spread along these and each round also jumps to the label's own label, so long chains shorten quickly. Every round is a
    reliable checkpoint."""
    edges = cut_lineage(_forests(edges))
    both = edges.select("run", F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("run", F.col("dst").alias("a"), F.col("src").alias("b")))
    both = cut_lineage(both.distinct())
    labels = cut_lineage(both.groupBy("run", F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    for _ in range(max_rounds):
        seen = both.join(labels.select("run", F.col("node").alias("b"), F.col("component").alias("cb")), ["run", "b"])
        near = seen.groupBy("run", F.col("a").alias("node")).agg(F.min("cb").alias("_near"))
        step = labels.join(near, ["run", "node"]).select("run", "node", "component", F.least("component", "_near").alias("_next"))
        jump = step.join(step.select("run", F.col("node").alias("_next"), F.col("_next").alias("_jump")), ["run", "_next"])
        moved = cut_lineage(jump.select("run", "node", F.col("component").alias("_old"), F.least("_next", "_jump").alias("component")))
        labels = moved.drop("_old")
        if moved.filter(F.col("_old") != F.col("component")).limit(1).count() == 0:
            return labels
    raise RuntimeError("components did not settle")


class Growth:
    """Complete-link clusters of one component, grown unit by unit in id order.

    A unit comes with its links to earlier units only, and what the choice of later units needs is summed up as it enters. So nothing is kept
    of a link but that sum, and what is held grows with the units of the component, not with its links.
    """

    def __init__(self, by_size: bool = False):
        self.by_size = by_size
        self.units: list = []
        self.place: dict = {}
        self.home: list[int] = []
        self.weight: list[int] = []
        self.penalty: list[float] = []
        self.tokens: list = []
        # similarity to the other articles of the cluster: a sum and what rounding took from it
        self.near: list[tuple[float, float]] = []
        self.members: dict[int, list[int]] = {}
        self.total: dict[int, int] = {}
        self._stands: dict[int, int] = {}
        self._words: dict[int, set] = {}

    def _representative(self, c: int) -> int:
        if c not in self._stands:
            least = max(1, self.total[c] - 1)
            fitness = lambda m: max((self.weight[m] - 1 + sum(self.near[m])) / least - self.penalty[m], -1.0)
            self._stands[c] = min(self.members[c], key=lambda m: (-fitness(m), m))
        return self._stands[c]

    def _own(self, u: int) -> set:
        lists, row = self.tokens[u]
        return set(lists[row].as_py() or ())

    def _shared(self, own: set, c: int) -> int:
        if c not in self._words:
            self._words[c] = set().union(*[self._own(m) for m in self.members[c]])
        return len(own & self._words[c])

    def _chosen(self, fits: list[int], near: dict[int, float], own: Callable[[], set]) -> int:
        if len(fits) == 1:
            return fits[0]
        if self.by_size:
            return min(fits, key=lambda c: (-self.total[c], c))
        alike = {c: near[self._representative(c)] for c in fits}
        most = max(alike.values())
        tied = [c for c in fits if alike[c] == most]
        if len(tied) == 1:
            return tied[0]
        words = own()
        return min(tied, key=lambda c: (-self._shared(words, c), c))

    def enter(self, unit, weight: int, title_chars: int, tokens: tuple, earlier: list, similarity: list, indexed: list):
        """The unit that names the cluster ``unit`` enters; ``tokens`` are a list column and a row of it."""
        u = len(self.units)
        places = [self.place[v] for v in earlier]
        met = Counter(map(self.home.__getitem__, places))
        fits = [c for c, n in met.items() if n == len(self.members[c])]
        if fits and not self.by_size:
            named = {self.home[p] for p, i in zip(places, indexed, strict=True) if i}
            fits = [c for c in fits if c in named]
        self.units.append(unit)
        self.place[unit] = u
        self.weight.append(weight)
        self.penalty.append(max(0, title_chars - 70) / 500)
        self.tokens.append(tokens)
        near = dict(zip(places, similarity, strict=True)) if fits else {}
        c = self._chosen(fits, near, lambda: self._own(u)) if fits else u
        fellows = self.members.setdefault(c, [])
        own = (0.0, 0.0)
        if not self.by_size:
            for m in fellows:
                self.near[m] = _add(self.near[m], near[m] * weight)
                own = _add(own, near[m] * self.weight[m])
        self.near.append(own)
        self.home.append(c)
        fellows.append(u)
        self.total[c] = self.total.get(c, 0) + weight
        self._stands.pop(c, None)
        if c in self._words:
            self._words[c] |= self._own(u)
        return self.units[c]


def _add(total: tuple[float, float], x: float) -> tuple[float, float]:
    """A compensated sum and one more: (sum, what rounding took from it)."""
    high, low = total
    t = high + x
    return t, low + ((high - t) + x if abs(high) >= abs(x) else (x - t) + high)


def _grown(rows: DataFrame, by_size: bool) -> DataFrame:
    """(run, unit_id, cluster_id) of units with run, component, weight, title_chars, idx and ``near``, their links (v, sim, indexed) to earlier ones.

    The units of a component follow one another in id order through one task.
    """
    kind, run_kind = dict(rows.dtypes)["unit_id"], dict(rows.dtypes)["run"]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, growth = None, Growth(by_size)
        for batch in batches:
            near, idx = batch.column("near"), batch.column("idx")
            v, sim, indexed = near.values.flatten()
            ends = near.offsets.to_pylist()
            homes = []
            for i, row in enumerate(zip(*[batch.column(n).to_pylist() for n in ("run", "component", "unit_id", "weight", "title_chars")], strict=True)):
                if row[:2] != key:
                    key, growth = row[:2], Growth(by_size)
                part = slice(ends[i], ends[i + 1])
                homes.append(growth.enter(*row[2:], (idx, i), v[part].to_pylist(), sim[part].to_pylist(), indexed[part].to_pylist()))
            ids = batch.column("unit_id")
            yield pa.RecordBatch.from_arrays([batch.column("run"), ids, pa.array(homes, ids.type)], ["run", "unit_id", "cluster_id"])

    placed = rows.repartition("run", "component").sortWithinPartitions("run", "component", "unit_id")
    return placed.mapInArrow(grow, f"run {run_kind}, unit_id {kind}, cluster_id {kind}")


def _fitness() -> Column:
    """How well a unit stands for its cluster: mean similarity to the other articles (``_s``, ``_w``: sums over the cluster)
    less a penalty for titles over 70 characters; -1 at least, so that the earliest of such titles stands."""
    mean = (F.coalesce("_s", F.lit(0.0)) + F.col("weight") - 1) / F.greatest(F.col("_w") - 1, F.lit(1))
    return F.greatest(mean - F.greatest(F.col("title_chars") - 70, F.lit(0)) / 500, F.lit(-1.0))


def complete_link_clusters(units: DataFrame, edges: DataFrame, task_limit: int = 50_000_000, by_size: bool = False) -> DataFrame:
    """(run, unit_id, cluster_id); a cluster is named by its first unit.

    A unit joins a cluster only if it is compatible with every member, so clusters never cross
    components: the one whose representative is most similar, or with ``by_size`` the one of most weight. A unit's choice rests on those before
    it, so a component of up to ``task_limit`` edges goes through one task, which holds its units and streams its edges; larger ones go
    through ``grow_in_rounds``, which reaches the same result with joins only, but needs a round for each step of their longest chain of choices.
    """
    edges = cut_lineage(edges)
    parts = cut_lineage(connected_components(edges))
    later = edges.select("run", F.greatest("src", "dst").alias("unit_id"), F.least("src", "dst").alias("v"), F.col("similarity").cast("double").alias("sim"), "indexed")
    node = parts.withColumnRenamed("node", "unit_id")
    sizes = later.groupBy("run", "unit_id").agg(F.count(F.lit(1)).alias("_n")).join(node, ["run", "unit_id"]).groupBy("run", "component").agg(F.sum("_n").alias("_size"))
    large = sizes.filter(F.col("_size") > task_limit).select("run", "component")
    many = large.limit(1).count() > 0
    small = node.join(large, ["run", "component"], "left_anti") if many else node
    alone = units.select("run", "unit_id").join(node.select("run", "unit_id"), ["run", "unit_id"], "left_anti").withColumn("cluster_id", F.col("unit_id"))
    near = later.groupBy("run", "unit_id").agg(F.collect_list(F.struct("v", "sim", "indexed")).alias("near"))
    none = F.array().cast(dict(near.dtypes)["near"])
    rows = units.select("run", "unit_id", F.col("weight").cast("bigint").alias("weight"), "title_chars", "idx").join(small, ["run", "unit_id"]).join(near, ["run", "unit_id"], "left")
    out = alone.select("run", "unit_id", "cluster_id").unionByName(_grown(rows.withColumn("near", F.coalesce("near", none)), by_size))
    if many:
        ids = node.join(large, ["run", "component"], "left_semi").select("run", "unit_id")
        big_edges = edges.join(ids.withColumnRenamed("unit_id", "src"), ["run", "src"], "left_semi")
        out = out.unionByName(grow_in_rounds(units.join(ids, ["run", "unit_id"], "left_semi"), big_edges, by_size))
    return out


def _most_similar(choice: DataFrame, done: DataFrame, nodes: DataFrame, links: DataFrame, to_done: DataFrame) -> DataFrame:
    """(run, u, cluster_id): of the clusters to choose, the one with the most similar representative, then most shared tokens, then the first."""
    inside = to_done.join(done.select("run", F.col("unit_id").alias("u"), F.col("cluster_id").alias("_mine")), ["run", "u"]).filter(F.col("_mine") == F.col("cluster_id"))
    weight = nodes.select("run", F.col("unit_id").alias("v"), F.col("weight").alias("vw"))
    sums = inside.join(weight, ["run", "v"]).groupBy("run", "cluster_id", "u").agg(F.sum(F.col("sim") * F.col("vw")).alias("_s"))
    of_cluster = done.join(nodes, ["run", "unit_id"])
    totals = of_cluster.groupBy("run", "cluster_id").agg(F.sum("weight").alias("_w"))
    scored = of_cluster.join(sums.withColumnRenamed("u", "unit_id"), ["run", "cluster_id", "unit_id"], "left").join(totals, ["run", "cluster_id"])
    reps = scored.groupBy("run", "cluster_id").agg(F.min_by("unit_id", F.struct(-_fitness(), F.col("unit_id"))).alias("v"))
    union = of_cluster.select("run", "cluster_id", F.explode("idx").alias("token")).distinct()
    shared = choice.join(nodes.select("run", F.col("unit_id").alias("u"), F.explode("idx").alias("token")), ["run", "u"]).join(
        union, ["run", "cluster_id", "token"]).groupBy("run", "u", "cluster_id").agg(F.count(F.lit(1)).alias("_shared"))
    ranked = choice.join(reps, ["run", "cluster_id"]).join(links.select("run", "u", "v", "sim"), ["run", "u", "v"]).join(shared, ["run", "u", "cluster_id"], "left")
    return ranked.groupBy("run", "u").agg(F.min_by("cluster_id", F.struct(-F.col("sim"), -F.coalesce("_shared", F.lit(0)), F.col("cluster_id"))).alias("cluster_id"))


def _heaviest(choice: DataFrame, done: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run, u, cluster_id): of the clusters to choose, the one of most weight, then the first."""
    totals = done.join(nodes, ["run", "unit_id"]).groupBy("run", "cluster_id").agg(F.sum("weight").alias("_w"))
    return choice.join(totals, ["run", "cluster_id"]).groupBy("run", "u").agg(F.min_by("cluster_id", F.struct(-F.col("_w"), F.col("cluster_id"))).alias("cluster_id"))


def _entering(claims: DataFrame, before: DataFrame) -> DataFrame:
    """(run, u, cluster_id) of the units that enter their only cluster in one round; see ``grow_in_rounds``.

    ``claims`` are (run, u, cluster_id, _i), _i if an index token is shared; ``before`` are (run, u, v) of neighbours v before u, both undecided.
    """
    choices = claims.groupBy("run", "u").agg(F.count(F.lit(1)).alias("_choices"))
    earlier = before.groupBy("run", "u").agg(F.count(F.lit(1)).alias("_earlier"))
    fellows = before.join(claims.select("run", F.col("u").alias("v"), "cluster_id"), ["run", "v"]).groupBy("run", "u", "cluster_id").agg(F.count(F.lit(1)).alias("_fellows"))
    known = claims.join(choices, ["run", "u"]).join(earlier, ["run", "u"], "left").join(fellows, ["run", "u", "cluster_id"], "left")
    ranked = known.withColumn("_rank", F.row_number().over(Window.partitionBy("run", "cluster_id").orderBy("u")) - 1)
    none = F.lit(0).cast("long")
    good = F.col("_i") & (F.col("_choices") == 1) & (F.coalesce("_earlier", none) == F.col("_rank")) & (F.coalesce("_fellows", none) == F.col("_rank"))
    until = F.min(F.when(~good, F.col("_rank"))).over(Window.partitionBy("run", "cluster_id"))
    return ranked.withColumn("_until", until).filter(F.col("_until").isNull() | (F.col("_rank") < F.col("_until"))).select("run", "u", "cluster_id")


def grow_in_rounds(units: DataFrame, edges: DataFrame, by_size: bool = False) -> DataFrame:
    """The same growth for components of any size, as rounds of joins.

    In a round every unit decides that no earlier undecided unit can still influence: none it is
    compatible with, and none that could enter a cluster it could enter itself. Such units cannot
    influence each other either, so they all decide at once. The first undecided unit always qualifies.

    Units with the same neighbours enter together. The claimants of a cluster are the undecided units compatible with
    all its members. As long as they, in id order, have no other cluster to choose, share an index token with a member, and are
    compatible with all claimants before them and with no other undecided unit before them, each of them enters whatever the ones before
    it do, and so they all enter in one round. A clique of any size takes two rounds.
    """
    nodes = cut_lineage(units.select("run", "unit_id", "weight", "title_chars", "idx"))
    links = edges.select("run", "src", "dst", "similarity", "indexed").union(edges.select("run", "dst", "src", "similarity", "indexed"))
    links = cut_lineage(links.toDF("run", "u", "v", "sim", "indexed"))
    done = nodes.select("run", "unit_id", F.col("unit_id").alias("cluster_id")).limit(0)
    total, decided = nodes.count(), 0
    while decided < total:
        open_units = nodes.join(done.select("run", "unit_id"), ["run", "unit_id"], "left_anti").select("run", F.col("unit_id").alias("u"))
        size = done.groupBy("run", "cluster_id").agg(F.count(F.lit(1)).alias("size"))
        to_done = links.join(done.select("run", F.col("unit_id").alias("v"), "cluster_id"), ["run", "v"])
        met = to_done.join(open_units, ["run", "u"], "left_semi").groupBy("run", "u", "cluster_id").agg(
            F.count(F.lit(1)).alias("_n"), F.bool_or("indexed").alias("_i"))
        claims = cut_lineage(met.join(size, ["run", "cluster_id"]).filter(F.col("_n") == F.col("size")).select("run", "u", "cluster_id", "_i"))
        eligible = claims.filter("_i").select("run", "u", "cluster_id")
        before = cut_lineage(links.filter(F.col("v") < F.col("u")).join(open_units, ["run", "u"], "left_semi").join(open_units.withColumnRenamed("u", "v"), ["run", "v"], "left_semi").select("run", "u", "v"))
        together = cut_lineage(_entering(claims, before))
        first = eligible.groupBy("run", "cluster_id").agg(F.min("u").alias("_first"))
        behind = eligible.join(first, ["run", "cluster_id"]).filter(F.col("u") > F.col("_first")).select("run", "u")
        ready = open_units.join(behind.union(before.select("run", "u")).union(together.select("run", "u")).distinct(), ["run", "u"], "left_anti")
        choice = eligible.join(ready, ["run", "u"], "left_semi")
        best = _heaviest(choice, done, nodes) if by_size else _most_similar(choice, done, nodes, links, to_done)
        new = ready.join(best, ["run", "u"], "left").select("run", F.col("u").alias("unit_id"), F.coalesce("cluster_id", "u").alias("cluster_id"))
        done = cut_lineage(done.unionByName(new).unionByName(together.withColumnRenamed("u", "unit_id")))
        decided = done.count()
    return done


def cluster_articles(articles: DataFrame, lex: Lexicon = Lexicon(), task_limit: int = 50_000_000,
                     grouping: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """(run, issue_id, article_id, unit_id) of every agenda article. ``grouping`` replaces the default
    complete-link step and must return (run, unit_id, cluster_id)."""
    units, membership = headline_units(articles, lex)
    edges = compatible_edges(units)
    clusters = grouping(units, edges) if grouping else complete_link_clusters(units, edges, task_limit)
    return membership.join(clusters, ["run", "unit_id"]).select("run", F.col("cluster_id").alias("issue_id"), "article_id", "unit_id")


def cluster_members(articles: DataFrame, lex: Lexicon = Lexicon(), task_limit: int = 50_000_000,
                    grouping: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Membership with each article's similarity to its issue's representative:
    (run, issue_id, article_id, unit_id, similarity, is_representative)."""
    units, membership = headline_units(articles, lex)
    edges = cut_lineage(compatible_edges(units))
    clusters = cut_lineage(grouping(units, edges) if grouping else complete_link_clusters(units, edges, task_limit))
    placed = representative_units(units, clusters, edges)
    return membership.join(placed, ["run", "unit_id"]).select(
        "run", F.col("cluster_id").alias("issue_id"), "article_id", "unit_id", "similarity",
        (F.col("is_representative") & (F.col("article_id") == F.col("unit_id"))).alias("is_representative"))


def representative_units(units: DataFrame, clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """Per cluster the unit with the best mean similarity to the others, less a long-title penalty;
    the earliest wins ties. Adds every unit's similarity to it."""
    c = clusters.join(units.select("run", "unit_id", "weight", "title_chars"), ["run", "unit_id"])
    home = clusters.select("run", "unit_id", "cluster_id")
    inside = edges.join(home.toDF("run", "src", "cluster_id"), ["run", "src"]).join(home.toDF("run", "dst", "cluster_id"), ["run", "dst", "cluster_id"])
    both = inside.select("run", "cluster_id", F.col("src").alias("u"), F.col("dst").alias("v"), "similarity").union(
        inside.select("run", "cluster_id", F.col("dst").alias("u"), F.col("src").alias("v"), "similarity"))
    weights = units.select("run", F.col("unit_id").alias("v"), F.col("weight").alias("_vw"))
    sums = both.join(weights, ["run", "v"]).groupBy("run", F.col("u").alias("unit_id")).agg(F.sum(F.col("similarity") * F.col("_vw")).alias("_s"))
    totals = c.groupBy("run", "cluster_id").agg(F.sum("weight").alias("_w"))
    scored = c.join(sums, ["run", "unit_id"], "left").join(totals, ["run", "cluster_id"])
    reps = scored.groupBy("run", "cluster_id").agg(F.min_by("unit_id", F.struct(-_fitness(), F.col("unit_id"))).alias("rep"))
    to_rep = both.join(reps.withColumnRenamed("rep", "v"), ["run", "cluster_id", "v"]).select("run", F.col("u").alias("unit_id"), F.col("similarity").alias("_sim"))
    out = home.join(reps, ["run", "cluster_id"]).join(to_rep, ["run", "unit_id"], "left")
    own = F.col("unit_id") == F.col("rep")
    return out.select("run", "unit_id", "cluster_id", own.alias("is_representative"), F.when(own, F.lit(1.0)).otherwise(F.col("_sim")).alias("similarity"))


def issue_suffixes(titled: DataFrame, rules=K.ISSUE_SUFFIXES) -> DataFrame:
    """Most frequent suffix class of each issue's titles, if frequent enough; counted per title, so no
    issue's titles are ever joined into one string."""
    counts = [F.sum(F.regexp_count("title", F.lit(p))).alias(f"c{i}") for i, (_, p) in enumerate(rules)]
    per = titled.groupBy("issue_id").agg(F.count(F.lit(1)).alias("n"), *counts)
    best = F.array_max(F.array(*[F.struct(F.col(f"c{i}").alias("c"), F.lit(-i).alias("o"), F.lit(label).alias("label")) for i, (label, _) in enumerate(rules)]))
    enough = best["c"] >= F.greatest(F.lit(2), F.ceil(F.col("n") * F.lit(0.25)))
    return per.select("issue_id", F.when(enough, best["label"]).alias("suffix"))
