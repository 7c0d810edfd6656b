"""Tables that cut the lineage of iterative jobs, in a folder that all executors share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's part of spark.checkpoint.dir; where that is unset and everything runs in one process, as in tests, a new temporary folder."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.factloom.facts.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.factloom.facts.dir", at)
    return f"{at.rstrip('/')}/facts/{context.applicationId}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once as a table and read it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once nothing reads them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows that a task of a wide step should hold.
TASK_ROWS = 1_000_000


def tasks(spark: SparkSession, rows: int, least: int | None = None) -> int:
    """Into how many parts so many rows are dealt: `least` (spark.sql.shuffle.partitions) at least, and so that a part doesn't grow with the table."""
    return max(least or int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_ROWS))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys, where so many rows need more parts than Spark makes by itself."""
    n = tasks(df.sparkSession, rows)
    return df.repartition(n, *keys) if n > tasks(df.sparkSession, 0) else df
