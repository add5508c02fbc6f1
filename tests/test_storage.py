"""Snapshots, JSON lines and the state fold."""

import pytest
from pyspark.sql import functions as F

from pressgrain.operators.windows import TRANSITIONS
from pressgrain.sources import readers, sinks
from pressgrain.streaming.machine import fold_states


def test_snapshot_round_trip_and_tamper(spark, tmp_path):
    root = str(tmp_path / "snap")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "issue_id bigint, payload string")
    sinks.publish_snapshot(rows.filter("issue_id = 1"), root, 1)
    second = sinks.publish_snapshot(rows, root, 2)
    assert sinks.read_snapshot(spark, root).count() == 2
    folder = spark.read.parquet(f"{root}/pointer").filter(F.col("snapshot_id") == second).first()["folder"]
    sinks.publish_snapshot(rows, root, 3)  # the same content again leaves the published folder alone
    assert sinks.read_snapshot(spark, root).count() == 2 and spark.read.parquet(f"{folder}/payloads").count() == 2
    newest = spark.read.parquet(f"{root}/pointer").filter("sequence = 3").first()["folder"]
    rows.withColumn("payload", F.lit("x")).write.mode("overwrite").parquet(f"{newest}/payloads")
    with pytest.raises(ValueError):
        sinks.read_snapshot(spark, root)


def test_bad_json_lines_are_reported(spark):
    lines = spark.createDataFrame([(1, '{"id":"a","title":"t"}'), (2, '{"id":"a"'), (3, ""), (4, '{"id":"b"}')], "line bigint, value string")
    good, bad = readers.read_jsonl(lines, "id string, title string", ("id", "title"))
    assert [r["id"] for r in good.collect()] == ["a"]
    assert {r["line"]: r["reason"] for r in bad.collect()} == {2: "malformed", 3: "empty", 4: "missing:title"}


@pytest.mark.parametrize("width", [1, 3, 100])
def test_state_fold_matches_a_plain_walk(spark, width):
    names = ["queued", "running", "retry_wait", "running", "queued", "succeeded", "running", "dead_letter"]
    events = [("i", n, n, s) for n, s in enumerate(names)] + [("j", n, n, s) for n, s in enumerate(reversed(names))]
    want = {}
    for item, _, _, s in events:
        now = want.get(item, "none")
        want[item] = s if s in TRANSITIONS[now] else now
    df = spark.createDataFrame(events, "item_id string, seq bigint, updated_at bigint, state string")
    got = {r["item_id"]: r["state"] for r in fold_states(df, F.floor(F.col("updated_at") / width)).collect()}
    assert got == want


def test_stage_folder_must_be_shared_off_local_mode(monkeypatch):
    from types import SimpleNamespace

    from pressgrain.session import stage_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=lambda d: None)
    with pytest.raises(RuntimeError):
        stage_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context))
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "hdfs:///stages"), sparkContext=context)
    assert stage_dir(named) == "hdfs:///stages"


def test_stages_are_deleted(spark):
    import os

    from pressgrain.session import cut_lineage, drop_stages

    df = cut_lineage(spark.range(5))
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and drop_stages(spark) >= 1 and not os.path.exists(path) and drop_stages(spark) == 0


def test_a_key_that_comes_twice_is_written_once(spark):
    from pressgrain.operators.scans import merge_articles_import, merge_sources

    kind = "canonical_url string, source_id string, title string, published_at string, section string, homepage_placement string, homepage_rank bigint, collected_at string"
    old = spark.createDataFrame([("u", "s", "old", None, None, None, None, "1")], kind)
    new = spark.createDataFrame([("u", "s", "later", None, None, None, None, "3"), ("u", "s", "sooner", None, None, None, None, "2")], kind)
    assert [(r["title"], r["change"]) for r in merge_articles_import(old, new).collect()] == [("later", "update")]
    panel = spark.createDataFrame([("a", "x"), ("a", "y")], "source_id string, source_name string")
    assert merge_sources(panel.limit(0), panel).count() == 1


def test_upserts_touch_their_buckets_once_and_survive_a_lost_checkpoint(spark, tmp_path):
    from pressgrain.operators.scans import merge_articles_discovery
    from pressgrain.streaming.streams import BucketedTable, upsert_articles

    kind = "canonical_url string, title string, section string, published_at timestamp, collected_at timestamp"
    import datetime as dt

    row = lambda u, t, s=None: (f"u{u}", t, s, None, dt.datetime(2024, 1, 1))
    batches = [[row(1, "a"), row(2, "bb"), row(3, "c")], [row(1, "aaa", "x"), row(4, "d")], [row(2, "b"), row(4, "dd", "y")]]
    incoming, out = str(tmp_path / "in"), str(tmp_path / "table")
    rows = [r for b in batches for r in b]
    want = {r["canonical_url"]: (r["title"], r["section"]) for r in merge_articles_discovery(spark.createDataFrame([], kind), spark.createDataFrame(rows, kind)).collect()}
    for b in batches:
        spark.createDataFrame(b, kind).coalesce(1).write.mode("append").parquet(incoming)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(incoming)
    table = BucketedTable(spark, out, "canonical_url", 16)
    state = lambda: {r["canonical_url"]: (r["title"], r["section"]) for r in table.read().collect()}
    upsert_articles(stream, table, str(tmp_path / "check1")).awaitTermination()
    assert table.versions() == [1, 2, 3] and state() == want
    upsert_articles(stream, table, str(tmp_path / "check1")).awaitTermination()  # a restart finds nothing new
    assert table.versions() == [1, 2, 3]
    upsert_articles(stream, table, str(tmp_path / "check2")).awaitTermination()  # a lost checkpoint reads all again
    assert table.versions() == [1, 2, 3, 4, 5, 6] and state() == want
    before = table.manifest()[1]
    one = spark.createDataFrame([row(1, "a longer title")], kind)
    assert len(table.upsert(one, merge_articles_discovery, "q", 0)) == 1 and table.upsert(one, merge_articles_discovery, "q", 0) == []
    after = table.manifest()[1]
    assert sum(before[b] != after[b] for b in before) == 1 and state() == want | {"u1": ("a longer title", "x")}


def test_quoted_csv_is_read_in_byte_ranges(spark, tmp_path):
    import csv
    import random

    rnd = random.Random(5)
    bits = ["word", " ", "\n", '"', ",", "\n\n", "é", "\t", "x" * 50, '""', "\n\"\n"]
    rows = [(str(i), "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))), rnd.choice(["", "a", "b,c"])) for i in range(800)]
    for name, part in (("a.csv", rows[:500]), ("b.csv", rows[500:])):
        with open(tmp_path / name, "w", newline="") as out:
            writer = csv.writer(out, lineterminator="\r\n" if name == "b.csv" else "\n")
            writer.writerow(["id", "text", "more, or less"])
            writer.writerows(part)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = readers.read_export_csv(spark, str(tmp_path))
        assert readers.csv_records(spark, str(tmp_path)).count() == 802
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 10
        assert sorted((r["id"], r["text"] or "", r["more, or less"] or "") for r in got.collect()) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
