"""Approximate nearest neighbours: an inverted file of coarse centroids, product-quantised residuals, exact reranking.

The coarse centroids and the codebooks of the residuals' parts are fitted on the driver to a bounded sample (SAMPLE
rows, the least by a hash of vec_id); every row is then indexed: its nearest centroid is its list, its residual a few
bytes of code. A query visits the lists of its nearest centroids; in each it builds its table of distances from its own
residual to the codewords (asymmetric: the query isn't quantised), sums the table over the codes, keeps the best by that
estimate, and computes their cosines exactly from the original vectors.

How many lists are visited, and what share of them is reranked, is fitted too: TRIAL of the queries themselves (they may
be unlike the other rows) are searched by brute force in SAMPLE rows that the centroids weren't fitted to, as far as there
are so many, and the least share of lists and then of candidates is taken that finds FOUND of their neighbours. Clustered
vectors need few lists; vectors without clusters, or queries far from the clusters, need most of them.

Vectors are scaled to length 1 first, so distance orders like cosine; each length of vectors has an index of its own. Lists are dealt out in parts of at most PART rows
and a list's queries in parts of QUERIES, so a list of any size is spread over tasks. Each part returns K rows per
query; their best K are the result. Queries whose lists hold fewer than K candidates visit all lists.

Defined cases: vectors that are null, empty, zero or hold null or non-finite parts take no part; vectors are compared
with those of their own length only; a row isn't its own candidate, but another row with its vec_id is; rows with one
vec_id are queries of their own, each with ranks from 1; equal scores go to the smaller vec_id; fewer candidates than K:
all of them; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import cut, table
from .vectors import USABLE, matrix, unit

K = 5
#: Rows that centroids and codebooks are fitted to, at most.
SAMPLE = 8_192
#: Rows a list should hold on average; lists, at least and at most (centroids are fitted to SAMPLE rows).
LIST_ROWS, LEAST_LISTS, MOST_LISTS = 500, 4, 2_048
#: Queries that the shares are fitted with, and the share of their neighbours to be found by each of the two.
TRIAL, FOUND = 256, 0.98
#: The least number of lists that a query visits.
LEAST_PROBES = 8
#: Parts of a residual, codewords of each.
PARTS, WORDS = 16, 256
#: Candidates of a part of a list that are reranked at least.
RERANK = 64
PART, QUERIES = 4_096, 1_024


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        for d in range(x.shape[1]):
            s = np.bincount(near, weights=x[:, d], minlength=len(c))
            c[n > 0, d] = s[n > 0] / n[n > 0]
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances less the rows' own squared lengths."""
    return (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[k : k + 2048], c).argmin(axis=1) for k in range(0, len(x), 2048)]) if len(x) else np.zeros(0, int)


class Index:
    """Centroids and codebooks: a few MB at most, whatever the table's size."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int = PARTS, words: int = WORDS):
        x = unit(sample)
        self.width = x.shape[1]
        self.centroids = _kmeans(x, lists)
        rest = x - self.centroids[_nearest(x, self.centroids)]
        self.edges = np.linspace(0, self.width, min(parts, self.width) + 1).astype(int)
        self.books = [_kmeans(np.ascontiguousarray(rest[:, a:b]), words, 6, 5) for a, b in zip(self.edges, self.edges[1:])]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of rows of length 1."""
        at = _nearest(x, self.centroids)
        rest = x - self.centroids[at]
        return at, np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(self.edges, self.edges[1:], self.books)], axis=1).astype(np.uint8)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each row, nearest first."""
        return np.argsort(_distances(x, self.centroids), axis=1, kind="stable")[:, :n]

    def tables(self, q: np.ndarray, at: int) -> np.ndarray:
        """Queries' distances to the codewords within list at: (queries, parts, words)."""
        rest = q - self.centroids[at]
        out = np.full((len(q), len(self.books), max(map(len, self.books))), np.inf)
        for p, (a, b, book) in enumerate(zip(self.edges, self.edges[1:], self.books)):
            out[:, p, : len(book)] = _distances(rest[:, a:b], book) + (rest[:, a:b] ** 2).sum(axis=1, keepdims=True)
        return out

    def tune(self, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, found: float = FOUND) -> None:
        """Fit probe_share and rerank_share: queries q are searched in rows x, all of length 1, but for the rows with their own ids."""
        lists = len(self.centroids)
        place, codes = self.place(x)
        sim = q @ x.T
        sim[q_ids[:, None] == ids[None, :]] = -2
        near = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        near = [n[sim[r, n] > -2] for r, n in enumerate(near)]
        order = np.argsort(self.probes(q, lists), axis=1)  # rank of each list for each query
        need = np.sort(np.concatenate([order[r, place[n]] for r, n in enumerate(near)])) + 1
        least = lambda ranks: float(ranks[max(0, int(np.ceil(found * len(ranks))) - 1)]) if len(ranks) else 1.0
        self.probe_share = least(need) / lists
        at = []  # of each neighbour, the share of its list that the estimate puts before it
        for r in range(len(q)):
            for n in set(place[near[r]].tolist()):
                mine = np.flatnonzero(place == n)
                guess = self.tables(q[r : r + 1], n)[0, np.arange(codes.shape[1])[None, :], codes[mine]].sum(axis=1)
                ahead = np.argsort(np.argsort(guess, kind="stable"), kind="stable")
                at += [(ahead[mine == m][0] + 1) / len(mine) for m in near[r] if place[m] == n]
        self.rerank_share = min(1.0, least(np.sort(np.array(at))))


def fit(vectors: DataFrame, query: str, sample: int = SAMPLE, k: int = K, trial: int = TRIAL) -> tuple[Index, int] | None:
    """(index, lists) of usable vectors of one length; None if there are none. Samples are a bounded, documented number of rows."""
    n = vectors.count()
    if not n:
        return None

    def least(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
        t = rows.select("vec_id", "embedding").orderBy(F.xxhash64(F.lit(9), "vec_id"), "vec_id").limit(most).toArrow().combine_chunks()
        return t.column("vec_id").to_numpy(), matrix(t.column("embedding").combine_chunks())

    ids, x = least(vectors, 2 * sample)
    index = Index(x[:sample], int(min(MOST_LISTS, max(LEAST_LISTS, n / LIST_ROWS))))
    q_ids, q = least(vectors.where(query), trial)
    if len(q):
        index.tune(unit(x[-sample:]), ids[-sample:], unit(q), q_ids, k)
    else:
        index.probe_share = index.rerank_share = 1.0
    return index, len(index.centroids)


def search(vectors: DataFrame, query: str, k: int = K, sample: int = SAMPLE, probe_share: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of vectors (vec_id, embedding) that the SQL condition query picks."""
    usable = vectors.select("vec_id", "embedding").where(USABLE)
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for width in sorted(r.width for r in usable.select(F.size("embedding").alias("width")).distinct().collect()):
        out = out.unionByName(_search(usable.where(F.size("embedding") == width), query, k, sample, probe_share))
    return out


def _search(usable: DataFrame, query: str, k: int, sample: int, probe_share: float | None) -> DataFrame:
    """search() of vectors of one length."""
    index, lists = fit(usable, query, sample, k)
    probes = min(lists, max(LEAST_PROBES, int(np.ceil((probe_share or index.probe_share) * lists))))
    # rows are told apart by numbers of their own, fixed by being written
    numbered = usable.withColumn("row", F.monotonically_increasing_id())
    schema = numbered.schema

    def place(batches):
        for b in batches:
            if b.num_rows:
                at, codes = index.place(unit(matrix(b.column("embedding"))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], [*b.schema.names, "list", "codes"])

    placed = cut(numbered.mapInArrow(place, StructType([*schema.fields, StructField("list", IntegerType())]).add("codes", "binary")), "index")

    def visit(n: int):
        def run(batches):
            for b in batches:
                if b.num_rows:
                    at = index.probes(unit(matrix(b.column("embedding"))), n)
                    take = pa.array(np.repeat(np.arange(b.num_rows), at.shape[1]))
                    yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns), pa.array(at.ravel().astype(np.int32))], [*b.schema.names, "list"])

        return run

    def found(queries: DataFrame, n: int) -> DataFrame:
        """query (its row), query_id, rank, vec_id, score."""
        asked = queries.select(*schema.names).mapInArrow(visit(n), StructType([*schema.fields, StructField("list", IntegerType())]))
        parts = placed.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        waves = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("waves"))
        sizes = cut(parts.join(waves, "list"), "sizes")
        left = placed.join(sizes, "list").select(*schema.names, "codes", "list", F.pmod(F.xxhash64("row", F.lit(1)), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("waves") - 1)).alias("wave"))
        right = asked.join(sizes, "list").select(*schema.names, "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("row", F.lit(2)), "waves").cast("int").alias("wave"))
        near = left.groupBy("list", "part", "wave").cogroup(right.groupBy("list", "part", "wave")).applyInArrow(_nearest_of(index, k), "query long, query_id long, row long, vec_id long, score double")
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "row")
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "query_id", "rank", "vec_id", "score")

    queries = placed.where(query).select(*schema.names)
    first = found(queries, probes)
    if probes < lists:
        first = cut(first, "found")
        short = queries.join(first.groupBy("query").count().where(F.col("count") >= k).select(F.col("query").alias("row")), "row", "left_anti")
        rest = found(short, lists)
        first = first.join(short.select(F.col("row").alias("query")), "query", "left_anti").unionByName(rest)
    return first.drop("query")


def _nearest_of(index: Index, k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query", "query_id", "row", "vec_id", "score"]
        if not rows.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4 + [pa.array([], pa.float64())], names=names)
        rows, queries = rows.combine_chunks(), queries.combine_chunks()
        ids, own, at = rows.column("vec_id").to_numpy(), rows.column("row").to_numpy(), rows.column("list")[0].as_py()
        asked, asked_ids = queries.column("row").to_numpy(), queries.column("vec_id").to_numpy()
        order = np.lexsort((own, ids))
        ids, own = ids[order], own[order]
        x = matrix(rows.column("embedding").combine_chunks())[order]
        q = matrix(queries.column("embedding").combine_chunks())
        codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
        most = min(len(ids), max(RERANK, k + 1, int(np.ceil(index.rerank_share * len(ids)))))
        tables = index.tables(unit(q), at)
        xn, qn = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        out = []
        for r in range(len(asked)):
            guess = tables[r, np.arange(codes.shape[1])[None, :], codes].sum(axis=1)
            keep = np.argsort(guess, kind="stable")[:most]  # ids are in order: equal codes go by id
            keep = keep[own[keep] != asked[r]]
            score = (x[keep] * q[r]).sum(axis=1) / (xn[keep] * qn[r])  # summed row by row, so that equal vectors have equal scores
            top = np.lexsort((own[keep], ids[keep], -score))[:k]
            keep = keep[top]
            out.append((np.full(len(keep), asked[r]), np.full(len(keep), asked_ids[r]), own[keep], ids[keep], score[top]))
        return pa.table([np.concatenate([o[c] for o in out]) for c in range(5)], names=names)

    return run


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id % 50 = 0")
