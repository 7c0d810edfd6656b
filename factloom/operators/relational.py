"""Relational operators of the fact layer: ordered dedup, gates, choreography, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key. One shuffle; the order must name a tie-breaker for a stable result."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn__", F.row_number().over(w)).where("rn__ = 1").drop("rn__")


def with_certain(df: DataFrame, known: DataFrame) -> DataFrame:
    """Adds certain: whether the values of df in the columns of known are there."""
    return df.join(known.distinct().withColumn("certain", F.lit(True)), known.columns, "left").withColumn("certain", F.coalesce("certain", F.lit(False)))


def choreography(producers: DataFrame, consumers: DataFrame, key: str) -> DataFrame:
    """key, producers, consumers: sorted distinct parties of both sides; a side without parties is an empty array.

    Both sides are grouped before they meet, so the join is one row per key and side.
    """
    left = producers.groupBy(key).agg(F.array_sort(F.collect_set("party")).alias("producers"))
    right = consumers.groupBy(key).agg(F.array_sort(F.collect_set("party")).alias("consumers"))
    kind = left.schema["producers"].dataType
    empty = F.array().cast(kind)
    return left.join(right, key, "full").select(key, F.coalesce("producers", empty).alias("producers"), F.coalesce("consumers", empty).alias("consumers"))


def gate_members(df: DataFrame, owner: str, member: str, order: str, legal: DataFrame) -> DataFrame:
    """owner, kept (array): the members of each owner that are legal, in order, repeats kept; owners without any go.

    A left-semi join on the exploded members: the legal keys may be as many as the members.
    """
    kept = df.join(legal.select(F.col(legal.columns[0]).alias(member)).distinct(), member, "left_semi")
    return kept.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, member))), lambda s: s[member]).alias("kept"))


def ranked(df: DataFrame, by: str, then: list) -> DataFrame:
    """Adds rank (from 1) in the order of `by`, largest first, nulls last, then of `then`, which tells all rows apart.

    Rows are dealt into ranges of the whole order, ranked within, and shifted by the sizes of the ranges before: no task
    sees all rows, equal in `by` or not.
    """
    order = [F.col(by).desc_nulls_last(), *then]
    dealt = cut(df.repartitionByRange(*order).withColumn("range__", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("range__").agg(F.count("*").alias("n__"))
    base = sizes.select("range__", (F.sum("n__").over(Window.orderBy("range__")) - F.col("n__")).alias("base__"))  # one row per range
    inside = Window.partitionBy("range__").orderBy(*order)
    return dealt.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(base), "range__").withColumn("rank", F.col("rank").cast("long") + F.col("base__")).drop("range__", "base__")


def cached_or_missing(wanted: DataFrame, cache: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds the cached value and hit: true where the cache has it."""
    return wanted.join(cache, keys, "left").withColumn("hit", F.col(value).isNotNull())
