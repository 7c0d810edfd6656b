"""Mixing sources to target weights by a low-discrepancy schedule.

Each slot of the mix is a golden-ratio point; the cumulative weights of the sources map it to one source, so that every
stretch of the mix holds each source in proportion. A source's slots are ranked; its documents, shuffled by a hash and
laid end to end as often as its target asks (at most three times), are cut at its target, rounded to words, and into as
many equal blocks as it has slots; its k-th slot takes its k-th block. So each source is taken to its target exactly. A
source with a target but too small for a slot has one block, in a slot that it shares. A block is a piece of a document
or runs over several.

Scale: word counts are summed per source before any shuffle; the shuffled order is a prefix sum over hash buckets of
a bounded number of documents, themselves summed by stretches, and documents meet the facts of a large source by a
broadcast of fewer than 10,000 rows, so a source of any share is spread over tasks; the schedule has a slot for each BLOCK
words, ranked by stretches of STRETCH slots, and a document meets as many blocks as it covers.

Targets: sources by code point, null last, weigh WEIGHTS in turn and share all words; a target stops at three times its
source's size and the excess is shared again by weight. That fixed point is a water level, found over the list of
sources in order of size to weight.

Defined cases: null or empty text has size 0 and takes 0; a null source is a source; no words at all: every target is
0; rows with equal doc_id are separate documents; other columns are ignored. Reruns agree, on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, join_hot, sums_before, table

WEIGHTS = (5, 2, 1)
#: Slots of the schedule at least, words to a slot at most, and slots of a source that are ranked together at most.
SLOTS, BLOCK, STRETCH = 1 << 16, 1_000, 1 << 12
MOST_EPOCHS = 3
DOCS_PER_BUCKET = 2_000
#: 2**32 / golden ratio: j * STEP mod 2**32 is the j-th golden-ratio point.
STEP = 2654435769


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """sid, source, source_size, docs, total, target, lo, hi from (source, source_size, docs): one row per source.

    lo and hi bound the source's part of 0..2**32. The list of sources is small: it has been aggregated.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights) + 1)
    s = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", w.cast("double"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("ratio", most * F.col("source_size") / F.col("w")).withColumn("total", F.sum("source_size").over(everything))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio") * (1 + 1e-12), F.struct("ratio", "sid", "level"))).over(everything)["level"])
    s = s.withColumn("target", F.least(F.col("w") * F.col("level"), (most * F.col("source_size")).cast("double")))
    upto = F.sum("target").over(Window.orderBy("sid"))
    edge = lambda x: F.when(F.col("total") > 0, F.least(F.floor(x / F.col("total") * (1 << 32)), F.lit(1 << 32))).otherwise(0)
    s = s.withColumn("hi", edge(upto)).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0)))
    return s.select("sid", "source", "source_size", "docs", "total", "target", "lo", "hi")


def slots_for(sources: DataFrame) -> int:
    """The number of slots for the words of all sources."""
    total = sources.agg(F.max("total")).first()[0] or 0
    return max(SLOTS, -(-total // BLOCK))


def rows_of(sources: DataFrame) -> int:
    """The number of documents of all sources."""
    return sources.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]


def schedule(spark: SparkSession, sources: DataFrame, slots: int = SLOTS) -> DataFrame:
    """sid, rank (from 0), slot: each slot's source, and which of that source's slots it is; sources that no slot falls to but have a target share one."""
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod(F.col("id") * STEP, F.lit(1 << 32)).alias("u"))
    bins = sources.where("hi > lo").select("sid", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright(F.col("hi") - 1, 16))).alias("bin"))
    mine = points.withColumn("bin", F.shiftright("u", 16)).join(bins, "bin").where("u >= lo and u < hi")
    mine = mine.select("sid", "slot", F.expr(f"slot div {STRETCH}").alias("stretch"))
    counts = mine.groupBy("sid", "stretch").agg(F.count("*").alias("k"))
    counts = sums_before(counts, "sid", "stretch", "k", "base").select("sid", "stretch", "base")
    inside = Window.partitionBy("sid", "stretch").orderBy("slot")
    ranked = mine.withColumn("k", F.row_number().over(inside) - 1).join(counts, ["sid", "stretch"]).select("sid", (F.col("base") + F.col("k")).alias("rank"), "slot")
    small = sources.where("round(target) > 0").join(counts, "sid", "left_anti")
    return ranked.union(small.select("sid", F.lit(0).cast("long"), F.shiftright(F.pmod(F.col("sid") * F.lit(STEP), F.lit(1 << 32)) * slots, 32)))


def laid_out(docs: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Documents with their place in their source's shuffled line of words: doc_id, key, size, sid, source_size, target, at; and the sources."""
    sized = cut(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 31)).alias("h")), "sized")
    sources = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))), "sources")
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("name")
    named = sources.select(name, "sid", "source_size", "target", F.ceil(F.col("docs") / DOCS_PER_BUCKET).alias("buckets"), "docs")
    own = join_hot(sized.select("doc_id", "key", "size", "h", name), named, ["name"], "docs", rows_of(sources))
    own = own.withColumn("bucket", F.floor(F.col("h") * F.col("buckets") / F.lit(1 << 31)))
    sums = own.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    sums = sums_before(sums, "sid", "bucket", "n", "base").select("sid", "bucket", "base")
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = own.withColumn("upto", F.sum("size").over(inside)).join(sums, ["sid", "bucket"])
    return out.select("doc_id", "key", "size", "sid", "source_size", "target", (F.col("base") + F.col("upto") - F.col("size")).alias("at")), sources


def mix(docs: DataFrame, slots: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places, sources, pieces). pieces: sid, at, doc_id, slot, epoch, from_word, to_word - the mix in order of slot, then sid."""
    places, sources = laid_out(docs)
    places = cut(places, "places")
    plan = cut(schedule(docs.sparkSession, sources, slots or slots_for(sources)), "plan")
    blocks = plan.groupBy("sid").agg(F.count("*").alias("blocks"))
    span = cut(sources.join(blocks, "sid").select("sid", "source_size", "blocks", F.round("target").cast("long").alias("end"), "docs"), "span")
    p = join_hot(places.where("size > 0").select("doc_id", "size", "sid", "at"), span, ["sid"], "docs", rows_of(sources)).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MOST_EPOCHS - 1))))
    p = p.withColumn("lo", F.col("epoch") * F.col("source_size") + F.col("at")).withColumn("hi", F.least(F.col("lo") + F.col("size"), "end")).where("hi > lo")
    p = p.withColumn("rank", F.explode(F.expr("sequence(((lo + 1) * blocks - 1) div end, (hi * blocks - 1) div end)")))
    p = p.withColumn("a", F.greatest("lo", F.expr("rank * end div blocks"))).withColumn("b", F.least("hi", F.expr("(rank + 1) * end div blocks"))).where("b > a")
    pieces = p.join(plan, ["sid", "rank"]).select("sid", "at", "doc_id", "slot", "epoch", (F.col("a") - F.col("lo")).alias("from_word"), (F.col("b") - F.col("lo")).alias("to_word"))
    return places, sources, pieces


def mixed_words(docs: DataFrame, slots: int | None = None) -> DataFrame:
    """doc_id, key (a hash of doc_id and text), size, source_size, target, taken for every row of docs (doc_id, text, source)."""
    places, sources, pieces = mix(docs, slots)
    taken = pieces.groupBy("sid", "at").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    place = F.when(F.col("size") > 0, F.col("at")).otherwise(-1 - F.pmod("key", F.lit(1 << 62)))  # empty documents share their neighbour's place
    out = places.withColumn("at", place).join(taken, ["sid", "at"], "left")
    return out.select("doc_id", "key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_words(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("key")
