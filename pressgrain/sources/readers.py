"""Readers for columnar, JSON-lines and delimited inputs; schemas are explicit, nothing is inferred."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from pressgrain.session import cut_lineage


def read_jsonl(lines: DataFrame, schema: T.StructType | str, required: tuple[str, ...], text: str = "value") -> tuple[DataFrame, DataFrame]:
    """Parse JSON lines against an explicit schema; returns (good rows, rejected rows with a reason).

    ``lines`` has a text column plus any columns that locate the line (file name, line number).
    """
    names = [f.name for f in (schema.fields if isinstance(schema, T.StructType) else T._parse_datatype_string(schema).fields)]
    ddl = schema.simpleString()[7:-1] if isinstance(schema, T.StructType) else schema
    parsed = lines.withColumn("_r", F.from_json(F.col(text), f"{ddl.replace(':', ' ')}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    absent = F.array_compact(F.array(*[F.when(F.col(f"_r.{c}").isNull(), F.lit(c)) for c in required]))
    reason = (
        F.when(F.trim(F.col(text)) == "", "empty")
        .when(F.col("_r").isNull() | F.col("_r._corrupt").isNotNull(), "malformed")
        .when(F.size(absent) > 0, F.concat(F.lit("missing:"), F.array_join(absent, ","))))
    marked = parsed.withColumn("reason", reason)
    extra = [c for c in lines.columns if c != text]
    good = marked.filter(F.col("reason").isNull()).select(*extra, *[F.col(f"_r.{n}").alias(n) for n in names if n not in extra])
    bad = marked.filter(F.col("reason").isNotNull()).select(*extra, "reason")
    return good, bad


def read_jsonl_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON-lines files with their file name; the split of work stays with Spark."""
    return spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))


def csv_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(file, record_no, record) of quoted CSV files whose fields may hold line feeds, read in byte ranges like any text.

    Whether a line begins inside a quoted field is the parity of all quotes before it in its file. The quotes of each byte range are
    counted first; the counts of the ranges before, one row each, tell how a range begins, and inside a range the parity runs from line to line. Lines that begin
    outside begin a record. Records of one line are complete; only the lines of longer ones are gathered.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = lines.withColumn("odd", F.pmod(F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit(""))), F.lit(2)))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    opens = lines.groupBy("file", "block").agg(F.sum("odd").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(earlier), none).alias("before"))
    inside = Window.partitionBy("file", "block").orderBy("line")
    running = F.coalesce(F.sum("odd").over(inside.rowsBetween(Window.unboundedPreceding, -1)), none)
    marked = lines.join(opens, ["file", "block"]).withColumn("begins", (F.col("before") + running) % 2 == 0)
    counted = marked.withColumns({"own": F.count_if("begins").over(inside), "alone": F.col("begins") & F.lead("begins").over(inside)}).drop("odd", "before")
    counted = cut_lineage(counted)
    bases = counted.groupBy("file", "block").agg(F.max("own").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(earlier), none).alias("base"))
    numbered = counted.join(bases, ["file", "block"]).withColumn("record_no", F.col("base") + F.col("own"))
    alone = F.coalesce("alone", F.lit(False))
    single = numbered.filter(alone).select("file", "record_no", F.col("value").alias("record"))
    longer = numbered.filter(~alone).groupBy("file", "record_no").agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("x"))
    whole = single.unionByName(longer.select("file", "record_no", F.array_join("x.value", "\n").alias("record")))
    return whole.withColumn("record", F.regexp_replace("record", "\r$", ""))


def read_export_csv(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """Delimited provider export with every column as text, named by the header that each file begins with; blank lines are no rows."""
    records = csv_records(spark, path, quote)
    options = {"quote": quote, "escape": quote, "multiLine": "true", "maxCharsPerColumn": "-1"}
    head = records.filter("record_no = 1").orderBy("file").first()
    if head is None:
        return spark.createDataFrame([], T.StructType())
    names = next(csv.reader([head["record"]], quotechar=quote))
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = records.filter((F.col("record_no") > 1) & (F.col("record") != "")).select(F.from_csv("record", schema, options).alias("r"))
    return rows.select("r.*")
