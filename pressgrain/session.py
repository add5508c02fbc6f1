"""Session factory and cluster-folder helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pressgrain", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume: UTC, AQE and skew-join handling on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_STAGES: dict[str, list[str]] = {}


def stage_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the cluster names in spark.checkpoint.dir, else the one already set.

    Only in local mode, where the driver is the one machine, may a scratch folder take its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = named or spark.sparkContext.getCheckpointDir()
    if current is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(current)
    return current


def new_stage(spark: SparkSession, kind: str = "stages") -> str:
    """A new path below the shared folder, which ``drop_stages`` will delete."""
    path = f"{stage_dir(spark)}/{kind}/{uuid.uuid4().hex}"
    _STAGES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a stage as a Parquet table in the shared folder and continue from it.

    It survives the loss of executors, keeps iterative plans short, is computed once however often it is
    read, and gives the planner real sizes to choose joins by. ``drop_stages`` deletes what was written.
    """
    spark = df.sparkSession
    path = new_stage(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> int:
    """Delete the stages and files this application has written; call it once the results that read them are stored."""
    paths = _STAGES.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)
