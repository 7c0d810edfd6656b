"""Nested spans by windows: partners of brackets, what lies around a row, the innermost span around a point.

Rows of one key (a file, an order) are sorted once; each function is one shuffle by the keys and window sums over them.
No span is ever joined to the rows inside it by a range, so the work is linear in rows and spans, whatever the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import spread


def partners(df: DataFrame, keys: list[str], at: str, step: Column) -> DataFrame:
    """Adds nest (brackets around the row), partner (the at of a bracket's other end, else null), parent (the at of the innermost bracket around the row, else null).

    step is 1 for rows that open a bracket, -1 for rows that close one, else 0. The brackets that share a depth open and
    close in turn, so the partner is the next or the last bracket of its depth. What is never closed has no partner.
    """
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("step__", step).withColumn("nest", (F.coalesce(F.sum("step__").over(before), F.lit(0)) - F.when(F.col("step__") == -1, 1).otherwise(0)).cast("int"))
    level = Window.partitionBy(*keys, "nest", "bracket__").orderBy(at)
    other = F.when((F.col("step__") == 1) & (F.lead("step__").over(level) == -1), F.lead(at).over(level)).when((F.col("step__") == -1) & (F.lag("step__").over(level) == 1), F.lag(at).over(level))
    d = d.withColumn("bracket__", F.col("step__") != 0).withColumn("partner", other).drop("bracket__")
    # a row asks at the depth below its own; a bracket that opens answers at its own depth
    roles = F.when(F.col("step__") == 1, F.array(F.col("nest") - 1, F.col("nest"))).otherwise(F.array(F.col("nest") - 1))
    asked = d.select("*", F.posexplode(roles).alias("role__", "level__"))
    seen = Window.partitionBy(*keys, "level__").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    asked = asked.withColumn("parent", F.last(F.when(F.col("role__") == 1, F.col(at)), ignorenulls=True).over(seen))
    return asked.where("role__ = 0").drop("step__", "role__", "level__")


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, stop: str, rows: int = 0) -> DataFrame:
    """Adds to each point the columns of the innermost span with start < at < stop; null where there is none.

    spans of one key are nested or apart; their other columns have names that points don't have. rows: how many points there
    are, if they may be too many for Spark's own number of tasks.
    """
    carried = [c for c in spans.columns if c not in keys]
    mine, theirs = [c for c in points.columns if c not in keys], F.struct(*carried)
    none = F.lit(None)
    kind = spans.select(theirs.alias("s")).schema["s"].dataType
    own = points.select(F.struct(*mine).alias("p")).schema["p"].dataType
    end = lambda col, order, step: spans.select(*keys, F.col(col).cast("long").alias("at__"), F.lit(order).alias("order__"), F.lit(step).alias("step__"), theirs.alias("span__"), none.cast(own).alias("point__"))
    asks = points.select(*keys, F.col(at).cast("long").alias("at__"), F.lit(1).alias("order__"), F.lit(0).alias("step__"), none.cast(kind).alias("span__"), F.struct(*mine).alias("point__"))
    events = spread(asks.unionByName(end(start, 2, 1)).unionByName(end(stop, 0, -1)), rows, *keys)  # at one place: ends, points, starts
    order = Window.partitionBy(*keys).orderBy("at__", "order__").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumn("level__", F.sum("step__").over(order) - F.when(F.col("order__") < 2, 1 + F.col("step__")).otherwise(1))
    seen = Window.partitionBy(*keys, "level__").orderBy("at__", "order__").rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("in__", F.last(F.when(F.col("order__") == 2, F.col("span__")), ignorenulls=True).over(seen)).where("order__ = 1")
    return found.select(*keys, "point__.*", *(F.when(F.col("level__") >= 0, F.col("in__")[c]).alias(c) for c in carried))


def arguments(rows: DataFrame, opens: DataFrame, keys: list[str]) -> DataFrame:
    """keys, open, nth, start, stop, shape: what lies between the commas right inside each bracket of opens (keys, open), up to a ';'.

    rows: keys, pos, tok, parent. shape is the array of the tokens right inside: what deeper brackets hold is left out,
    the brackets are there. Commas between the angle brackets of types don't count.
    """
    inside = rows.select(*keys, "pos", "tok", F.col("parent").alias("open")).join(opens.select(*keys, "open").distinct(), [*keys, "open"])
    w = Window.partitionBy(*keys, "open").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    kind = r"^([A-Z]\w*|\?|>)$"
    angle = F.when((F.col("tok") == "<") & F.lag("tok").over(w).rlike(r"^[A-Z]\w*$") & F.lead("tok").over(w).rlike(kind), 1).when((F.col("tok") == ">") & F.lag("tok").over(w).rlike(r"^([A-Z]\w*|\?|>|<|\])$"), -1).otherwise(0)
    inside = inside.withColumn("angle", angle)
    inside = inside.withColumn("parts", (F.col("tok") == ",") & (F.coalesce(F.sum("angle").over(before), F.lit(0)) <= 0))
    total = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    inside = inside.withColumn("nth", total(F.col("parts")).cast("int")).withColumn("over", total(F.col("tok") == ";")).where("over = 0 and not parts")
    return inside.groupBy(*keys, "open", "nth").agg(F.min("pos").alias("start"), F.max("pos").alias("stop"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]).alias("shape"))
