"""Streaming and storage operators over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pressgrain.functions import columns as C
from pressgrain.plans.registry import query
from pressgrain.session import stage_dir
from pressgrain.sources import readers, sinks
from pressgrain.streaming import streams as S
from pressgrain.streaming.machine import fold_states


def fresh(t, name):
    return f"{stage_dir(t.spark)}/{name}/{uuid.uuid4().hex}"


def stream_of(t, name):
    """The given table, one file or a folder of them, as a stream. A stream can't be given the path of a file, but a pattern may match one."""
    schema = t.spark.read.parquet(f"{t.sf_dir}/{name}.parquet").schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{name}.parque[t]")


def drain(t, stream, name, mode="append"):
    """Run a stream over what is there and return the written rows."""
    out = fresh(t, name)
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q.format("parquet").option("path", f"{out}/data").start().awaitTermination()
    else:
        q.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/data/epoch={epoch}")).start().awaitTermination()
    return t.spark.read.parquet(f"{out}/data")


@query("stream_dedupe_articles", "SELECT DISTINCT 'https://news.example.com/a/' || sha256(text) AS canonical_url FROM documents")
def _(t):
    d = stream_of(t, "documents").select(
        F.concat(F.lit("https://news.example.com/a/"), F.sha2("text", 256)).alias("canonical_url"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 24 as int))").cast("timestamp").alias("published_at"))
    return drain(t, S.dedupe_articles(d), "dedupe").select("canonical_url")


@query("stream_upsert", """
    SELECT 'https://news.example.com/a/' || (doc_id // 2) AS canonical_url, arg_max(t, {'l': length(t), 'i': t}) AS title FROM (SELECT doc_id, split_part(text, chr(10), 1) AS t FROM documents) GROUP BY 1""")
def _(t):
    d = stream_of(t, "documents").select(
        F.concat(F.lit("https://news.example.com/a/"), F.expr("doc_id div 2").cast("string")).alias("canonical_url"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("lang").alias("section"),
        F.lit(None).cast("timestamp").alias("published_at"), F.expr("timestamp'2024-01-01 00:00:00'").alias("collected_at"))
    base = fresh(t, "upsert")
    table = S.BucketedTable(t.spark, f"{base}/table", "canonical_url", 8)
    S.upsert_articles(d, table, f"{base}/checkpoint").awaitTermination()
    return table.read().select("canonical_url", "title")


# windows that the watermark, an hour behind the last event, has passed
@query("stream_rate_windows", """
    WITH w AS (SELECT user_id AS actor, time_bucket(INTERVAL 15 MINUTES, CAST(ts AS TIMESTAMP), TIMESTAMP '2000-01-01') AS w, count(*) AS n FROM events GROUP BY ALL)
    SELECT actor, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, n FROM w WHERE w + INTERVAL 15 MINUTES <= (SELECT max(CAST(ts AS TIMESTAMP)) FROM events) - INTERVAL 1 HOUR""")
def _(t):
    e = stream_of(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return drain(t, S.rate_windows(e, "user_id", "ts"), "rates").select("actor", C.stamp(F.col("window_start")).alias("window_start"), "n")


MACHINE = """
    WITH RECURSIVE o AS (SELECT item_id, state, row_number() OVER (PARTITION BY item_id ORDER BY updated_at, seq) AS i FROM fx_states),
      s AS (SELECT DISTINCT item_id, CAST(0 AS BIGINT) AS i, 'none' AS state, CAST(0 AS BIGINT) AS illegal FROM o UNION ALL
        SELECT s.item_id, o.i, CASE WHEN ok THEN o.state ELSE s.state END, s.illegal + CASE WHEN ok THEN 0 ELSE 1 END FROM s JOIN o ON o.item_id = s.item_id AND o.i = s.i + 1,
          LATERAL (SELECT s.state || '>' || o.state IN ('none>queued', 'none>running', 'queued>running', 'queued>dead_letter', 'running>retry_wait', 'running>succeeded', 'running>review_needed', 'running>dead_letter', 'retry_wait>queued', 'retry_wait>running', 'retry_wait>dead_letter') AS ok))
    """


@query("state_machine", MACHINE + "SELECT item_id, max(i) AS events, arg_max(state, i) AS state FROM s GROUP BY 1")
def _(t):
    return fold_states(t.states, F.date_trunc("day", "updated_at"))


@query("stream_state_machine", MACHINE + "SELECT item_id, arg_max(state, i) AS state, arg_max(illegal, i) AS illegal FROM s GROUP BY 1")
def _(t):
    e = stream_of(t, "events").select(
        F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("updated_at"),
        F.expr("case event_type when 'signup' then 'queued' when 'view' then 'running' when 'click' then 'retry_wait' when 'purchase' then 'succeeded' else 'dead_letter' end").alias("state"))
    # a later update of an item replaces its earlier one
    rows = drain(t, S.track_states(e, silent_ms=10 * 365 * 86_400_000), "states", "update")
    return rows.groupBy("item_id").agg(F.max_by("state", "epoch").alias("state"), F.max_by("illegal", "epoch").alias("illegal"))


@query("read_jsonl_articles", """
    SELECT doc_id AS line_no, 'ok' AS outcome FROM documents WHERE doc_id % 10 NOT IN (3, 5, 7) UNION ALL SELECT doc_id, CASE doc_id % 10 WHEN 3 THEN 'malformed' WHEN 5 THEN 'missing:title' ELSE 'empty' END FROM documents WHERE doc_id % 10 IN (3, 5, 7)""")
def _(t):
    a = t.articles.select("article_id", F.to_json(F.struct(F.col("article_id").cast("string").alias("article_id"), "title", "source_id")).alias("doc"))
    lines = a.select(F.col("article_id").alias("line_no"), F.expr("""case article_id % 10 when 3 then left(doc, length(doc) - 4) when 5 then concat('{"article_id":"', article_id, '","source_id":"x"}') when 7 then '  ' else doc end""").alias("value"))
    good, bad = readers.read_jsonl(lines, "article_id string, title string, source_id string", ("article_id", "title"))
    return good.select("line_no", F.lit("ok").alias("outcome")).unionByName(bad.select("line_no", F.col("reason").alias("outcome")))


@query("read_export_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, sha256(text) AS text_sha, lang FROM documents")
def _(t):
    path = fresh(t, "export")
    t.raw("documents").select("doc_id", "source", "text", "lang").write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_export_csv(t.spark, path).select("doc_id", "source", F.sha2("text", 256).alias("text_sha"), "lang")


@query("write_run_results", "SELECT issue_id, run_id, category, agenda_score, strftime(DATE '2024-01-01' + CAST(run_id % 5 AS INTEGER), '%Y-%m-%d') AS issue_date FROM fx_issues")
def _(t):
    path = fresh(t, "runs")
    rows = t.issues.select("issue_id", "run_id", "category", "agenda_score", F.date_format(F.expr("date_add(date'2024-01-01', cast(run_id % 5 as int))"), "yyyy-MM-dd").alias("issue_date"))
    sinks.write_run_results(rows.withColumn("agenda_score", F.lit(0.0)).filter("run_id % 5 < 3"), path)
    sinks.write_run_results(rows, path)
    return t.spark.read.schema(rows.schema).parquet(path)


def payloads(t):
    return t.articles.select(F.col("article_id").alias("issue_id"), F.to_json(F.struct("title", "section")).alias("payload"))


@query("publish_snapshot", "SELECT doc_id AS issue_id, sha256('{\"title\":' || to_json(split_part(text, chr(10), 1)) || ',\"section\":\"' || lang || '\"}') AS payload_sha256 FROM documents")
def _(t):
    root = fresh(t, "publish")
    sinks.publish_snapshot(payloads(t), root, 1)
    return t.spark.read.parquet(t.spark.read.parquet(f"{root}/pointer").first()["folder"] + "/manifest")


@query("read_snapshot", "SELECT doc_id AS issue_id, lang AS section FROM documents")
def _(t):
    root = fresh(t, "publish")
    sinks.publish_snapshot(payloads(t).filter("issue_id % 2 = 0"), root, 1)
    sinks.publish_snapshot(payloads(t), root, 2)
    return sinks.read_snapshot(t.spark, root).select("issue_id", F.get_json_object("payload", "$.section").alias("section"))
