"""Periodic runs of words: descending-LCP Kruskal over the suffixes of each text.

Suffixes of a text are ordered by prefix doubling (numpy, many texts at once, only suffixes that still have company are
sorted again) and neighbours get their longest common prefix. Neighbours are then united from the longest prefix down,
each class an ordered list of positions, the smaller list going into the larger. Two positions i < j that become
neighbours in a class at prefix length l, with j - i <= l, seed the stretch from i to j + l with period j - i; no smaller
period fits, for the position it leads to would lie between them in the class. A seed that can't be extended to the left
is a run, and every run is found once: its first position and the one a period later meet in this way. A run of at least
`least` words needs a common prefix of at least half of that, so shorter prefixes are left alone.

Texts are independent, so the work is a map: a task holds about WORDS words at a time, or one text if that is longer.
Memory is about 200 bytes a word of those held.

Defined cases: a null, empty or blank text has no words and no runs, its collapsed text is empty; rows with equal doc_id
are rows of their own; a null doc_id is kept as it is; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, in_parts, table

#: Words of a run, at least; words that a task holds at a time.
LEAST, WORDS = 12, 1 << 18


def _suffixes(flat: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, l): neighbours in the order of suffixes that share a prefix of l >= least words; marks that occur once end a text."""
    n = len(flat)
    sa = np.argsort(flat, kind="stable")
    new = np.concatenate([[True], flat[sa[1:]] != flat[sa[:-1]]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first
    levels, step = [rank.astype(np.int32)], 1
    while True:
        alone = new & np.append(new[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        at = sa[slots]
        key = rank[at] * n + rank[at + step]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[slots] = at
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        new[slots] = fresh
        rank[at] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        step *= 2
        levels.append(rank.astype(np.int32))
    i, j = sa[:-1], sa[1:]
    low = levels[min(len(levels) - 1, int(np.log2(least)))]
    near = low[i] == low[j]
    i, j = i[near], j[near]
    common = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        common += (levels[k][i + common] == levels[k][j + common]).astype(np.int64) << k
    near = common >= least
    return i[near], j[near], common[near]


def _seeds(i: np.ndarray, j: np.ndarray, common: np.ndarray):
    """(i, j, l) of positions that become neighbours in their class and lie no further apart than l."""
    order = np.argsort(-common, kind="stable")
    home: dict[int, list[int]] = {}
    for x, y, l in zip(i[order].tolist(), j[order].tolist(), common[order].tolist()):
        large, small = home.get(x), home.get(y)
        if large is None and small is None:
            if x > y:
                x, y = y, x
            home[x] = home[y] = [x, y]
            if y - x <= l:
                yield x, y, l
            continue
        large, small = large or [x], small or [y]
        if len(large) < len(small):
            large, small = small, large
        for v in small:
            insort(large, v)
            home[v] = large
        for k, v in enumerate(small):  # pairs of the small class among themselves are old
            at = bisect_left(large, v)
            if at and 0 < v - large[at - 1] <= l and not (k and large[at - 1] == small[k - 1]):
                yield large[at - 1], v, l
            if at + 1 < len(large) and large[at + 1] - v <= l and not (k + 1 < len(small) and large[at + 1] == small[k + 1]):
                yield v, large[at + 1], l


def find_runs(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, a list of words, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1)  # a text is followed by a mark of its own
    starts, total = ends - sizes - 1, int(ends[-1]) if len(ends) else 0
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not total:
        return found
    numbers: dict[bytes, int] = {}
    words = np.empty(total, np.int64)
    for t, at in zip(texts, starts.tolist()):
        words[at : at + len(t)] = np.fromiter((numbers.setdefault(w, len(numbers)) for w in t), np.int64, len(t))
    marks = ends - 1
    words[marks] = len(numbers) + np.arange(len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    flat = owner * (len(numbers) + len(texts)) + words  # words of two texts never match
    seeds = [s for s in _seeds(*_suffixes(flat, (least + 1) // 2)) if s[1] - s[0] + s[2] >= least and words[s[0] - 1] != words[s[1] - 1]]
    for i, j, l in seeds:
        of = owner[i]
        found[of].append((i - int(starts[of]), j - i + l, j - i))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, least: int = LEAST, held: int = WORDS) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start, then period), collapsed (the words without repeated periods, one space between) of each row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        ids, texts, size = [], [], 0

        def done():
            runs = find_runs(texts, least)
            given = [{"start": s, "length": n, "period": p} for r in runs for s, n, p in r]
            item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            kept = pa.array([collapsed(w, r) for w, r in zip(texts, runs)], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.ListArray.from_arrays(pa.array(offsets), pa.array(given, item)), kept], ["doc_id", "runs", "collapsed"])

        for b in in_parts(batches, 64):
            given = [(t or b"").split() for t in b.column(1).cast(pa.binary()).to_pylist()]  # bytes split at ASCII white space only
            ids.append(b.column(0))
            texts += given
            size += sum(map(len, given)) + len(given)
            if size >= held:
                yield done()
                ids, texts, size = [], [], 0
        if texts:
            yield done()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text of docs; in a tenth of the rows, by a hash of doc_id, the words from some place on repeat those right behind it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    d = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    d = d.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    d = d.withColumn("left", F.col("n") - F.col("a")).withColumn("p", 1 + F.floor(F.col("left") / (3 + F.col("g") % 8)))
    cut = lambda c, start, size: F.slice(c, start.cast("int"), size.cast("int"))
    again = F.flatten(F.array_repeat(cut("words", F.col("a") + 1, F.col("p")), F.ceil(F.col("left") / F.col("p")).cast("int")))
    new = F.array_join(F.concat(cut("words", F.lit(1), F.col("a")), cut(again, F.lit(1), F.col("left"))), " ")
    return d.select("doc_id", F.when(F.col("a").isNotNull(), new).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; ties: least start, then period) and digests of all runs and of the collapsed text."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    f = found.withColumn("top", top)
    length, period = F.col("top.length"), -F.col("top.p")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return f.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), sha(F.array_join(line, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(planted(table(spark, sf_dir, "documents"))))
