"""Small helpers shared by the corpus operators: tables, shared storage, graph components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys that hold more than one in HOT of the rows, and so fewer than HOT keys, are told by a broadcast.
HOT = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that all executors share (spark.checkpoint.dir); where that is unset and everything runs in one process, as in tests, a new temporary one."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.factloom.shared.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.factloom.shared.dir", at)
    return f"{at.rstrip('/')}/factloom/{context.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete every table that this application has cut; for long-lived clusters, once the results are written."""
    _delete(spark, shared_dir(spark))


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut", tidy: bool = False) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again.

    tidy: let go of the shuffle files of what was cut, now that the table stands for them.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if tidy:
        gc.collect()
        df.sparkSession._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the table that cut() wrote, once nothing reads it any more."""
    _delete(df.sparkSession, df.cut_path)


def in_parts(batches, rows: int = 256):
    """Arrow batches in parts of so many rows, so that a task holds few texts as Python objects at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def join_hot(rows: DataFrame, keys: DataFrame, on: list[str], count: str, total: int, how: str = "inner", hot: int = HOT) -> DataFrame:
    """rows joined with keys, one row per key, without dealing a hot key's rows to one task.

    keys' column count (left out of the result) is how many rows a key may have, and total at least the sum of all of them. Keys
    with more than one in `hot` of the total - fewer than `hot`, or their counts would add up to more - are broadcast; the
    rows of the others are shuffled. keys is read twice, so it should be a table; on holds no nulls.
    """
    few, many = (keys.where(c).drop(count) for c in (F.col(count) * hot > total, F.col(count) * hot <= total))
    cold = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(many, on, how)
    return rows.join(F.broadcast(few), on, how).unionByName(cold)


def sums_before(df: DataFrame, by: str, place: str, value: str, name: str, width: int = 1 << 12) -> DataFrame:
    """df with name: the sum of value over the rows of the same `by` at smaller places (whole numbers, each once), in stretches of width places, so that no task sees all of a key's rows."""
    s = df.withColumn("stretch__", F.expr(f"`{place}` div {width}"))
    tops = s.groupBy(by, "stretch__").agg(F.sum(value).alias("top__"))
    tops = tops.select(by, "stretch__", (F.sum("top__").over(Window.partitionBy(by).orderBy("stretch__")) - F.col("top__")).alias("before__"))
    s = s.withColumn("within__", F.sum(value).over(Window.partitionBy(by, "stretch__").orderBy(place)) - F.col(value))
    return s.join(tops, [by, "stretch__"]).withColumn(name, F.col("before__") + F.col("within__")).drop("stretch__", "before__", "within__")


def ascii_lower(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large and small stars.

    edges: (a long, b long); loops and repeats are allowed. Returns (node, component_id), one row per node that
    has an edge to another node; component_id is the smallest node of the component. Every step is a grouped
    minimum (combined before the shuffle) and a join, so no node's neighbours are ever gathered in one place.
    """
    if edges.schema["a"].dataType.simpleString() != "bigint":
        raise TypeError("a and b must be long")
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.union(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        drop(e)
        e, was, mark = new, mark, tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if was == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(e.select(F.col("v"), F.col("v")).distinct())

