"""Set algebra over ids, partitions and URL sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pressgrain.operators.common import set_digest


def pair_confusion(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Counts of gold, predicted and shared pairs from two (group_id, article_id) tables.

    Pairs are counted on group sizes: a group of n holds n(n-1)/2 pairs, and two articles are paired in
    both exactly when they share a (gold group, predicted group) cell. Nothing quadratic is built.
    """
    pairs = F.expr("n * (n - 1) div 2")
    n = F.count(F.lit(1)).alias("n")
    g, p = gold.dropDuplicates(), predicted.dropDuplicates()
    cells = g.select("article_id", F.col("group_id").alias("g")).join(p.select("article_id", F.col("group_id").alias("p")), "article_id")
    shared = cells.groupBy("g", "p").agg(n).agg(F.coalesce(F.sum(pairs), F.lit(0)).alias("shared_pairs"))
    gold_n = g.groupBy("group_id").agg(n).agg(F.coalesce(F.sum(pairs), F.lit(0))).scalar()
    pred_n = p.groupBy("group_id").agg(n).agg(F.coalesce(F.sum(pairs), F.lit(0))).scalar()
    return shared.select(gold_n.alias("gold_pairs"), pred_n.alias("predicted_pairs"), "shared_pairs").select(
        "shared_pairs", (F.col("predicted_pairs") - F.col("shared_pairs")).alias("false_pairs"),
        (F.col("gold_pairs") - F.col("shared_pairs")).alias("missed_pairs"))


def content_override_merge(layers: list[DataFrame], key: str, fields: list[str]) -> DataFrame:
    """Layered merge: for each field the last layer with a value wins."""
    rows = None
    for i, df in enumerate(layers):
        part = df.select(key, *fields).withColumn("_layer", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), F.col("_layer"))).alias(f) for f in fields])


def partition_check(universe: DataFrame, predicted: DataFrame, special: DataFrame) -> DataFrame:
    """Violations of a partition: repeated, missing or unknown ids, and ids both clustered and set aside."""
    p = predicted.select("article_id", F.lit("cluster").alias("bucket"))
    s = special.select("article_id", "bucket")
    placed = p.unionByName(s)
    per = placed.groupBy("article_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("bucket") == "cluster").alias("c"), F.count_if(F.col("bucket") != "cluster").alias("s"))
    repeated = per.filter((F.col("c") > 1) | (F.col("s") > 1)).select("article_id", F.lit("repeated").alias("violation"))
    both = per.filter((F.col("c") > 0) & (F.col("s") > 0)).select("article_id", F.lit("clustered_and_set_aside").alias("violation"))
    ids = universe.select("article_id").distinct()
    missing = ids.join(per, "article_id", "left_anti").select("article_id", F.lit("missing").alias("violation"))
    unknown = per.join(ids, "article_id", "left_anti").select("article_id", F.lit("unknown").alias("violation"))
    return repeated.unionByName(both).unionByName(missing).unionByName(unknown)


def partition_reconcile(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """Candidate groups against clusters: exact, overlapping (with shared size) or unmatched.

    Two sets are equal when they share as many members as each of them has.
    """
    g = groups.select("group_id", "article_id").distinct()
    c = clusters.select("cluster_id", "article_id").distinct()
    gs = g.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    cs = c.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    shared = g.join(c, "article_id").groupBy("group_id", "cluster_id").agg(F.count(F.lit(1)).alias("shared"))
    matched = shared.join(gs, "group_id").join(cs, "cluster_id").withColumn(
        "match", F.when((F.col("shared") == F.col("group_size")) & (F.col("shared") == F.col("cluster_size")), "exact").otherwise("overlap"))
    zero = F.lit(0).cast("bigint")
    lone = cs.join(shared, "cluster_id", "left_anti").select(
        F.lit(None).cast(dict(groups.dtypes)["group_id"]).alias("group_id"), "cluster_id", zero.alias("shared"), zero.alias("group_size"), "cluster_size",
        F.lit("unmatched_cluster").alias("match"))
    empty = gs.join(shared, "group_id", "left_anti").select(
        "group_id", F.lit(None).cast(dict(clusters.dtypes)["cluster_id"]).alias("cluster_id"), zero.alias("shared"), "group_size", zero.alias("cluster_size"),
        F.lit("unmatched_group").alias("match"))
    cols = ["group_id", "cluster_id", "shared", "group_size", "cluster_size", "match"]
    return matched.select(*cols).unionByName(lone.select(*cols)).unionByName(empty.select(*cols))


def url_set_signature(members: DataFrame, group: str = "issue_id", url: str = "canonical_url", minimum: int = 2) -> DataFrame:
    """Digest of the distinct URL set of each group with at least ``minimum`` URLs."""
    return set_digest(members, [group], url).filter(F.col("set_size") >= minimum)


def disjoint_manifests(entries: DataFrame) -> DataFrame:
    """Ids claimed by more than one manifest."""
    return entries.groupBy("article_id").agg(F.count_distinct("manifest_id").alias("manifests")).filter(F.col("manifests") > 1)


def approval_manifest(reviewed: DataFrame, minimum: int = 2) -> DataFrame:
    """Binding rows of each reviewed cluster with its URL-set digest; clusters under ``minimum`` give none."""
    digest = set_digest(reviewed, ["issue_id"], "canonical_url").filter(F.col("set_size") >= minimum)
    return reviewed.join(digest, "issue_id").select(
        "issue_id", "article_id", "source_id", "canonical_url", "published_date", "body_sha256", "set_size", "set_digest")
