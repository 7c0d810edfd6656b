"""Vector code compression: product codes by ball k-means over whole numbers.

Components become floor(scale * x), vectors are cut into equal parts and each part position has a codebook of `entries`
entries. An entry and the parts assigned to it are a ball. In a round, every part first measures its distance to the entry
it was assigned to: an entry further than twice that from its own can be neither nearer nor as near. So the ball's radius
names its neighbour entries (those within twice the radius), parts nearer to their entry than half the way to the nearest
neighbour are its stable core and stay, and the rest lie in rings, each with the neighbours up to its own reach as the
only candidates, compared exactly. All comparisons are of whole numbers, so codes equal those of a full search.

Rounds run as maps: each task assigns its rows and adds up counts and sums per entry, and only these are shuffled. What
reaches the driver is a codebook (parts x entries x components of a part), whatever the number of rows. Rows with their
codes are written once a round, so a round starts from its predecessor's assignment and a lost executor costs its own part.

Defined cases: rows whose vector is null or holds null or non-finite components go; a null vec_id comes last in the order,
equal ones go by their components; shorter vectors are filled with zeros up to the longest, and that up to a multiple of
the number of parts; scaled components beyond +-2**24 count as that, so that no distance overflows; with fewer rows than
entries a codebook is as small as that; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
MOST = 1 << 24
KEPT = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"


def nearest(x: np.ndarray, book: np.ndarray, was: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) for each row of x: the nearest row of book, ties to the lower; was: the entry it had before."""
    apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(apart, axis=1, kind="stable")  # an entry's neighbours, nearest first
    apart = np.take_along_axis(apart, order, axis=1)
    own = ((x - book[was]) ** 2).sum(axis=1)
    best, far = was.copy(), own.copy()
    radius = np.zeros(len(book), np.int64)
    np.maximum.at(radius, was, own)
    ring = np.zeros(len(x), np.int64)  # how many entries of the order are within reach
    rows = np.argsort(was, kind="stable")
    bounds = np.searchsorted(was[rows], np.arange(len(book) + 1))
    for c in range(len(book)):
        mine = rows[bounds[c] : bounds[c + 1]]
        if len(mine):
            near = apart[c][: np.searchsorted(apart[c], 4 * radius[c], side="right")]
            ring[mine] = np.searchsorted(near, 4 * own[mine], side="right")
    live = np.flatnonzero(ring > 1)  # the others are in the stable core
    for k in range(len(book)):
        live = live[ring[live] > k]
        if not len(live):
            break
        c = order[was[live], k]
        d = ((x[live] - book[c]) ** 2).sum(axis=1)
        wins = (d < far[live]) | ((d == far[live]) & (c < best[live]))
        best[live[wins]], far[live[wins]] = c[wins], d[wins]
    return best, far


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _assign(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows (vec_id, label, v, codes) with new codes and their error."""
    parts, entries, part = books.shape

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"), parts * part).reshape(-1, parts, part)
            was, error = _matrix(b.column("codes"), parts), np.zeros(b.num_rows, np.int64)
            for p in range(parts):
                was[:, p], far = nearest(v[:, p], books[p], was[:, p])
                error += far
            codes = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * parts), pa.array(was.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), codes, pa.array(error)], ["vec_id", "label", "v", "codes", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return rows.select("vec_id", "label", "v", "codes").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<int>, codes array<int>, error long")


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Books with each entry at the mean (rounded down) of the parts assigned to it; unused ones stay."""
    parts, entries, part = books.shape

    def run(batches):
        sums, counts = np.zeros((parts * entries, part), np.int64), np.zeros(parts * entries, np.int64)
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("v"), parts * part).reshape(-1, part)
                at = (_matrix(b.column("codes"), parts) + np.arange(parts) * entries).ravel()
                np.add.at(sums, at, v)
                counts += np.bincount(at, minlength=len(counts))
        used = np.flatnonzero(counts)
        place = np.tile(np.arange(part), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, part)), pa.array(place), pa.array(sums[used].ravel()), pa.array(np.repeat(counts[used], part))], ["entry", "place", "total", "n"])

    told = rows.select("v", "codes").mapInArrow(run, "entry long, place long, total long, n long")
    told = told.groupBy("entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # a codebook's components
    new = books.reshape(parts * entries, part).copy()
    for r in told:
        new[r.entry, r.place] = r.total // r.n
    return new.reshape(books.shape)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes, error of each kept row of vectors (vec_id, embedding, label); the codebooks, by part, entry and place)."""
    kept = vectors.select("vec_id", "embedding", "label").where(F.expr(f"coalesce({KEPT}, false)"))
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    part = max(1, -(-longest // parts))
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))
    rows = kept.select("vec_id", "label", F.slice(F.concat(whole, F.array_repeat(F.lit(0), parts * part)), 1, parts * part).alias("v"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, part).transpose(1, 0, 2)
    if not first:
        return rows.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), books
    rows = cut(_assign(rows.withColumn("codes", F.array_repeat(F.lit(0), parts)), books), "codes")
    for _ in range(rounds):
        books, was = _moved(rows, books), rows
        rows = cut(_assign(was, books), "codes")
        drop(was)
    return rows.select("vec_id", "label", "codes", "error"), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress(table(spark, sf_dir, "embeddings"))
    per_label = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    out = rows.join(per_label, rows["label"].eqNullSafe(per_label["label"]), "left")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    assign = "SELECT p.r, p.part, arg_min(c.entry, (list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.entry)) AS entry, min(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS error FROM p JOIN {book} c ON p.part = c.part GROUP BY 1, 2"
    rounds = "".join(
        f"""a{k} AS ({assign.format(book=f'c{k}')}),
m{k} AS (SELECT part, entry, list(m ORDER BY place) AS x FROM (SELECT a.part, a.entry, place, CAST(floor(sum(p.x[place]) / count(*)) AS BIGINT) AS m FROM a{k} a JOIN p ON a.r = p.r AND a.part = p.part, range(1, {{width}} + 1) w(place) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{k + 1} AS (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON c.part = m.part AND c.entry = m.entry),
"""
        for k in range(ROUNDS)
    ).replace("{width}", f"(SELECT max(len(embedding)) // {PARTS} FROM e)")
    return f"""WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v FROM e),
p AS (SELECT r, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS x FROM v, range({PARTS}) s(part)),
c0 AS (SELECT part, r AS entry, x FROM p WHERE r < {ENTRIES}),
{rounds}z AS ({assign.format(book=f'c{ROUNDS}')}),
s AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM z GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS digest FROM c{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256 FROM v JOIN s ON v.r = s.r, h"""


ORACLE = _oracle()
