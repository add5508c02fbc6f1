"""Run results and immutable published snapshots on shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgrain.operators.common import set_digest
from pressgrain.session import cut_lineage


def write_run_results(results: DataFrame, path: str, date_col: str = "issue_date") -> None:
    """Write results partitioned by date; only the dates present in ``results`` are replaced."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_col).parquet(path)


def snapshot_digest(payloads: DataFrame, key: str = "issue_id", text: str = "payload") -> DataFrame:
    """Order-free digest of a set of keyed payloads: (digest, issue_count), one row."""
    rows = payloads.select(F.lit(1).alias("_one"), F.concat_ws("=", F.col(key).cast("string"), F.sha2(text, 256)).alias("_v"))
    return set_digest(rows, ["_one"], "_v").select(F.col("set_digest").alias("digest"), F.col("set_size").alias("issue_count"))


def publish_snapshot(payloads: DataFrame, root: str, sequence: int) -> str:
    """Write the payloads under a content-derived prefix, then their manifest, and the pointer row last.

    The input is computed once. Each write has a folder of its own, so one that is published is never touched again. The
    pointer is an append-only log read by its highest sequence, so readers see either the old snapshot or the whole new one.
    """
    spark = payloads.sparkSession
    payloads = cut_lineage(payloads)
    digest = snapshot_digest(payloads).first()
    snapshot = digest["digest"][:32]
    base = f"{root}/snapshot_id={snapshot}/write={uuid.uuid4().hex}"
    payloads.write.parquet(f"{base}/payloads")
    payloads.select("issue_id", F.sha2("payload", 256).alias("payload_sha256")).write.parquet(f"{base}/manifest")
    pointer = spark.createDataFrame([(sequence, snapshot, digest["digest"], digest["issue_count"], base)], "sequence bigint, snapshot_id string, digest string, issue_count bigint, folder string")
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return snapshot


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Payloads of the current snapshot, after checking digest, issue count and manifest both ways."""
    p = spark.read.parquet(f"{root}/pointer").orderBy(F.col("sequence").desc()).first()
    base = p["folder"]
    payloads = spark.read.parquet(f"{base}/payloads")
    manifest = spark.read.parquet(f"{base}/manifest")
    hashed = payloads.select("issue_id", F.sha2("payload", 256).alias("payload_sha256"))
    keys = ["issue_id", "payload_sha256"]
    wrong = hashed.join(manifest, keys, "left_anti").union(manifest.join(hashed, keys, "left_anti")).limit(1).count()
    got = snapshot_digest(payloads).first()
    if wrong or got["digest"] != p["digest"] or got["issue_count"] != p["issue_count"]:
        raise ValueError(f"snapshot {p['snapshot_id']} does not match its manifest")
    return payloads
