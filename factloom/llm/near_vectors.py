"""Near-duplicate vectors: sign hashing by random hyperplanes in several tables, exact cosines, connected components.

Equal vectors of a label are merged first. Each distinct vector gets one bucket per table (the signs of its products
with that table's hyperplanes); vectors of one label that share a bucket are compared exactly, block by block, and a
pair counts only in the first table in which it meets, so links are counted once without a shuffle of pairs. A task
sees two blocks of about BLOCK rows and returns, for each of its rows, a count and at most one edge; no list of pairs
leaves it. A bucket of any size is split into blocks: every pair of its blocks is compared, no cap.

A table's bits follow the number of rows, so that a bucket holds about BLOCK of them on average, and the number of
tables follows the bits, so that a pair at cosine `least` misses all tables with a chance below MISS (0.003).

Defined cases: vectors that are null, empty, zero or hold null or non-finite parts, and rows with a null label, have no
links and are their own component; vectors are compared with those of their own length only; rows with equal vec_id are
separate vectors, with links and a component of their own each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import components, cut, table
from .vectors import USABLE, key, matrix, unit

LEAST = 0.93
#: Bits of a table, at least and at most; the chance that a pair at the least cosine meets in no table.
LEAST_BITS, MOST_BITS, MISS = 12, 28, 0.003
#: Rows of a block of a large bucket; rows of a task group of smaller ones; buckets compared row by row.
BLOCK, GROUP, SMALL = 1024, 4096, 24


@lru_cache(8)
def _planes(width: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng(20240501 + width).standard_normal((width, tables * bits))


def shape(rows: int, least: float = LEAST) -> tuple[int, int]:
    """(tables, bits) for so many rows."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, rows / BLOCK)))))
    meets = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** bits  # in one table
    return max(1, math.ceil(math.log(MISS) / math.log1p(-meets))) if meets < 1 else 1, bits


def codes(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """One bucket number per row and table."""
    signs = (x @ _planes(x.shape[1], tables, bits) > 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def _hashed(classes: DataFrame, tables: int, bits: int) -> DataFrame:
    """Classes with their width and codes."""
    names = ["cls", "label", "copies", "embedding"]
    schema = StructType([*(classes.schema[c] for c in names), StructField("width", IntegerType()), StructField("codes", ArrayType(IntegerType()))])

    def run(batches):
        for b in batches:
            widths = np.array([len(v) for v in b.column("embedding")], np.int32)
            for w in sorted(set(widths.tolist())):
                part = b.filter(pa.array(widths == w))
                got = codes(unit(matrix(part.column("embedding"))), tables, bits)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(got), w, np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * tables), pa.array(got.ravel()))], [*part.schema.names, "width", "codes"])

    return classes.select(*names).mapInArrow(run, schema)


def _blocks(hashed: DataFrame, block: int, groups: int) -> DataFrame:
    """Rows of the buckets (label, width, t, code) by task group (width, t, g, i, j).

    Buckets of up to `block` rows share one of `groups` groups; a larger one has a group for each pair of its blocks (i <= j).
    """
    bucket = ["label", "width", "t", "code"]
    spread = hashed.select("*", F.posexplode("codes").alias("t", "code"))
    sizes = spread.groupBy(bucket).agg(F.ceil(F.count("*") / block).cast("int").alias("n"), F.count("*").alias("members")).where("members > 1").drop("members")
    own = spread.join(sizes, bucket).withColumn("mine", F.pmod(F.xxhash64("cls", F.lit(5)), "n").cast("int")).withColumn("h", F.xxhash64("label", "code"))
    return own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("cls", "copies", "embedding", *bucket, F.when(F.col("n") > 1, F.col("h")).otherwise(F.pmod("h", F.lit(groups))).alias("g"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("second"), F.col("h"))


def _compare(least: float, tables: int, bits: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        t, one = rows.column("t")[0].as_py(), rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
        ids, copies, second, bucket = (rows.column(c).to_numpy() for c in ("cls", "copies", "second", "h"))
        order = np.argsort(bucket, kind="stable")
        ids, copies, second, bucket = ids[order], copies[order], second[order], bucket[order]
        x = unit(matrix(rows.column("embedding").combine_chunks()))[order]
        code = codes(x, tables, bits)[:, :t]
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def met(p, q):
            new = ~(code[p] == code[q]).any(axis=1)  # not met in an earlier table
            found.append((p[new], q[new]))

        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(starts[1:], len(ids))
        small = ends - starts <= SMALL if one else np.zeros(len(starts), bool)
        for a, b in zip(starts[~small], ends[~small]):
            left = np.arange(a, b) if one else a + np.flatnonzero(~second[a:b])
            right = left if one else a + np.flatnonzero(second[a:b])
            for k in range(0, len(left), 128):
                r, c = np.nonzero(x[left[k : k + 128]] @ x[right].T >= least)
                p, q = left[k + r], right[c]
                met(*((p[p < q], q[p < q]) if one else (p, q)))
        for step in range(1, SMALL):  # in small buckets, each row with the one `step` behind it
            p = np.concatenate([np.arange(a, b - step) for a, b in zip(starts[small], ends[small]) if b - a > step] or [np.zeros(0, int)])
            if not len(p):
                break
            p = p[np.einsum("ij,ij->i", x[p], x[p + step]) >= least]
            met(p, p + step)
        p, q = (np.concatenate([f[k] for f in found]) for k in (0, 1)) if found else (np.zeros(0, int), np.zeros(0, int))
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, p, copies[q])
        np.add.at(links, q, copies[p])
        least_id, was = ids.copy(), None
        while was is None or (was != least_id).any():  # the least id reached within these rows
            was = least_id.copy()
            m = np.minimum(least_id[p], least_id[q])
            np.minimum.at(least_id, p, m)
            np.minimum.at(least_id, q, m)
        keep = links > 0
        return pa.table({"cls": ids[keep], "links": links[keep], "to": least_id[keep]})

    return run


def near_duplicates(vectors: DataFrame, least: float = LEAST, tables: int | None = None, bits: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label)."""
    vectors = vectors.select("vec_id", "embedding", "label")
    part = F.expr(f"coalesce({USABLE} and label is not null, false)")
    rows = vectors.where(part).withColumn("key", key())
    # a class has a number of its own, fixed by being written: its least vec_id may be another class's too
    classes = rows.groupBy("label", "key").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.min("embedding").alias("embedding"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    count = classes.count()
    wide = shape(count, least)
    tables, bits = tables or wide[0], bits or wide[1]
    pairs = _blocks(_hashed(classes, tables, bits), block, max(1, count // GROUP)).groupBy("width", "t", "g", "i", "j").applyInArrow(_compare(least, tables, bits), "cls long, links long, to long")
    pairs = cut(pairs, "links")
    links = pairs.groupBy("cls").agg(F.sum("links").alias("links"))
    comps = cut(components(pairs.select(F.col("cls").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "cls"), "components")
    firsts = comps.join(classes.select("cls", "first"), "cls").groupBy("component_id").agg(F.min("first").alias("least_id"))
    named = comps.join(firsts, "component_id").select("cls", "least_id")
    counted = classes.join(links, "cls", "left").join(named, "cls", "left").select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least_id", "first").alias("component_id"))
    linked = rows.select("vec_id", "label", "key").join(counted, ["label", "key"]).select("vec_id", "n_links", "component_id")
    idle = vectors.where(~part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(idle).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
