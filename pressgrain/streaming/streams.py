"""Structured Streaming forms of ingest and state tracking."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pressgrain.operators.scans import merge_articles_discovery
from pressgrain.operators.windows import TRANSITIONS


def dedupe_articles(stream: DataFrame, url: str = "canonical_url", event_time: str = "published_at", lookback: str = "3 days") -> DataFrame:
    """One row per URL within the lookback; state older than the lookback is dropped by the watermark."""
    return stream.withWatermark(event_time, lookback).dropDuplicatesWithinWatermark([url])


def rate_windows(stream: DataFrame, actor: str, event_time: str, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """Actions per actor and fixed window; finished windows are emitted once the watermark passes them."""
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, f"{minutes} minutes").alias("w"), F.col(actor).alias("actor")).agg(
        F.count(F.lit(1)).alias("n")).select("actor", F.col("w.start").alias("window_start"), "n")


class BucketedTable:
    """Table in ``buckets`` by the hash of a key; a batch rewrites only the buckets it has rows for.

    Every commit is a version: the folders of the buckets it wrote, and a manifest that names the folder of each bucket
    and the batch that was applied (query id and epoch). The manifest is written last and counts once it is complete, so readers see the version before or the whole
    new one. Versions go on from the last manifest whatever the checkpoint says, so a reset checkpoint never
    starts below what readers have seen.
    """

    MANIFEST = "bucket int, folder string, query string, epoch long"

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS")))

    def manifest(self) -> tuple[int, dict[int, str], set[tuple[str, int]]]:
        """(version, folder of each bucket, batches of the last version's query that were applied); version 0 is the empty table."""
        known = self.versions()
        if not known:
            return 0, {}, set()
        # one row for each bucket and one for each applied batch of the query
        rows = self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}/manifest/v={known[-1]}").collect()
        return known[-1], {r["bucket"]: r["folder"] for r in rows if r["folder"]}, {(r["query"], r["epoch"]) for r in rows if r["query"]}

    def bucket_of(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def read(self, schema=None, only: Sequence[int] | None = None) -> DataFrame | None:
        """Rows of the last version, of the buckets ``only`` if they are named; None if there are none."""
        folders = [f for b, f in self.manifest()[1].items() if only is None or b in only]
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(*folders) if folders else None

    def upsert(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], query: str, epoch: int) -> list[int]:
        """Apply a batch once: ``merge`` its rows into the buckets they fall to. Returns those buckets, none for a batch applied before."""
        version, folders, applied = self.manifest()
        if any(q == query and e >= epoch for q, e in applied):
            return []
        rows = rows.persist()
        try:
            touched = sorted(r["bucket"] for r in self.bucket_of(rows).select("bucket").distinct().collect())  # at most ``buckets`` rows
            current = self.read(rows.schema, touched)
            merged = self.bucket_of(merge(current if current is not None else rows.limit(0), rows))
            data = f"{self.path}/data/v={version + 1}"
            # one file a bucket; what a failed attempt of this version left is overwritten
            merged.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        finally:
            rows.unpersist()
        folders = folders | {b: f"{data}/bucket={b}" for b in touched}
        # a query's epochs come in order, so its last one stands for all before it
        batches = {q: e for q, e in applied} | {query: epoch}
        lines = [(b, f, None, None) for b, f in folders.items()] + [(None, None, q, e) for q, e in batches.items()]
        self.spark.createDataFrame(lines, self.MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version + 1}")
        return touched


def upsert_articles(stream: DataFrame, table: BucketedTable, checkpoint: str) -> StreamingQuery:
    """Merge every micro-batch into the table; the query id in the checkpoint tells its batches from those of others."""
    def apply(batch: DataFrame, epoch: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        table.upsert(batch, merge_articles_discovery, query, epoch)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def track_states(stream: DataFrame, allowed: dict[str, Sequence[str]] = TRANSITIONS, start: str = "none", late: str = "1 hour", silent_ms: int = 86_400_000) -> DataFrame:
    """Current state of each item from a stream of (item_id, seq, updated_at, state).

    Events of a micro-batch are applied in time order; a transition the table does not allow is counted
    and not applied. An unfinished item that stays silent for ``silent_ms`` of event time is
    dead-lettered. Only the state name and a counter are kept per item.
    """
    terminal = {s for s, nxt in allowed.items() if not nxt}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, illegal = state.get if state.exists else (start, 0)
        if state.hasTimedOut:
            current = "dead_letter"
            state.update((current, illegal))
        else:
            pdf = pd.concat([b[["updated_at", "seq", "state"]] for b in batches]).sort_values(["updated_at", "seq"])
            for nxt in pdf["state"]:
                if nxt in allowed.get(current, ()):
                    current = nxt
                else:
                    illegal += 1
            state.update((current, illegal))
            last = int(pdf["updated_at"].iloc[-1].timestamp() * 1000)
            if current not in terminal:
                state.setTimeoutTimestamp(max(last + silent_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"item_id": [key[0]], "state": [current], "illegal": [illegal]})

    kind = dict(stream.dtypes)["item_id"]
    return stream.withWatermark("updated_at", late).groupBy("item_id").applyInPandasWithState(
        step, f"item_id {kind}, state string, illegal bigint", "state string, illegal bigint", "update", GroupStateTimeout.EventTimeTimeout)
