"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressgrain.session import new_stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the one that all executors share; ``pressgrain.session.drop_stages`` deletes it."""
    return new_stage(spark, kind)


def open_store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that Spark names, and the path in it; Arrow knows Hadoop's S3 schemes as s3."""
    scheme, mark, rest = folder.partition("://")
    return fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + mark + rest)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder, densely packed since it holds texts, and continue from it."""
    path = shared_folder(df.sparkSession, "stages")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into pieces of at most ``rows`` rows, so that Python holds few texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix64 generator: a bijection of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
