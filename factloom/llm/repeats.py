"""Long repeats by run-length indexes: removes every byte of a LENGTH-byte string that occurs elsewhere.

A corpus-wide suffix array is cut into independent parts by content. Each LENGTH-byte window has a minimiser, the least
hash among its K-byte pieces; equal windows have equal minimisers, so a document falls into segments - runs of windows
of one minimiser - and only segments of one minimiser need meet. Minimisers are counted over the whole corpus:

* one that occurs once has no repeats;
* segments that occur twice or more with equal bytes are repeats from end to end, and one of them stands for all: what
  is sorted and indexed is the dictionary of different segments, so memory follows what differs, not what repeats;
* different segments of one minimiser go to a run-length index.

The index of a bucket of minimisers (about BUCKET_BYTES) sorts the suffixes of its segments, keeps the Burrows-Wheeler
transform as runs with the suffixes sampled at the run ends, and streams matching statistics from the samples: at the
head of a run the match with the suffix before is measured; along the text it falls by one per byte until the next
sampled position. Stretches whose statistics reach LENGTH are marked, and so are the sampled suffixes they match.

A minimiser with more different bytes than a bucket takes is dealt out by content, on the same path: equal windows hold
their minimiser at equal places, so its windows fall into slices of WIDTHS[0] neighbouring places, and the bytes that all
windows of a slice share - its core - must be equal too. (Minimiser, slice, core) is then what the minimiser was, with
its own counts, copies and index; a core that is still too large is sliced again, at last into single windows, which are
equal or not. So a passage that is a little shorter than LENGTH, with other bytes around it in every document, is spread
as far as it needs.

Scale: what is shuffled per window run is a pair of hashes and a position; counts are combined before the shuffle and
equal segments collapse, so a passage that a third of the corpus shares costs one count per task; rows of minimisers and
segments that are that common meet them by a broadcast (fewer than 10,000 can be), so none is dealt to one task. A bucket's
index takes about 80 bytes per byte. Texts are read again for candidates only and to apply the marks.

Defined cases: null text is empty; texts under LENGTH bytes keep everything; strings are judged on the input; equal
rows are repeats of each other; rows are told apart by a 64-bit hash of doc_id and text, segments of one minimiser by a
64-bit hash of their bytes; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import cut, drop, in_parts, join_hot, table

LENGTH, K = 200, 24
BUCKET_BYTES = 1 << 19
#: Places of the minimiser that a slice of a large minimiser spans, then those of a slice of a large core.
WIDTHS = (16, 1)
#: Bytes of text that are hashed together, and the bits of a place among them.
TOGETHER, _PLACE = 1 << 20, np.uint64((1 << 21) - 1)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number."""
    out = np.empty(len(buf) - 7, np.uint64)
    for o in range(8):
        part = buf[o : o + (len(buf) - o) // 8 * 8].view(np.uint64)
        out[o::8] = part[: len(out[o::8])]
    return out


def _piece_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the K (24) bytes from each position."""
    w = _words(buf)
    n = len(buf) - K + 1
    h = w[:n] * _M[0]
    h ^= h >> np.uint64(32)
    h += w[8 : 8 + n]
    h *= _M[1]
    h ^= h >> np.uint64(29)
    h += w[16 : 16 + n]
    h *= _M[2]
    h ^= h >> np.uint64(32)
    h *= _M[0]
    return h ^ (h >> np.uint64(29))


def _sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w numbers in a row."""
    n = len(h) - w + 1
    padded = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max)
    padded[: len(h)] = h
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def segments(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(minimiser, hash of the bytes, index of the text, start, length) of the segments of texts, TOGETHER bytes in all at most.

    A segment is a run of windows that have their minimiser, the leftmost least one, in the same place.
    """
    joined = b"".join(texts)
    if len(joined) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32))
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    h = _piece_hashes(np.frombuffer(joined, np.uint8))
    low = _sliding_least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - K + 1)
    fits = np.zeros(len(low) + 1, np.int32)  # windows that lie within one text
    long = sizes >= length
    np.add.at(fits, (ends - sizes)[long], 1)
    np.add.at(fits, (ends - length + 1)[long], -1)
    fits = np.cumsum(fits[:-1]) > 0
    first = fits.copy()
    first[1:] &= ~fits[:-1] | (low[1:] != low[:-1])
    last = fits.copy()
    last[:-1] &= ~fits[1:] | (low[1:] != low[:-1])
    a, b = np.flatnonzero(first), np.flatnonzero(last) + length
    of = np.searchsorted(ends, a, side="right")
    one = xxhash.xxh3_64_intdigest
    own = np.array([one(joined[x:y]) for x, y in zip(a.tolist(), b.tolist())], np.uint64).view(np.int64)
    return h[(low[a] & _PLACE).astype(np.int64)].view(np.int64), own, of, (a - (ends - sizes)[of]).astype(np.int32), (b - a).astype(np.int32)


def _together(texts: list[bytes], length: int):
    """(parts, their texts' numbers, their offsets) of about TOGETHER bytes; a longer text is cut so that each window is in one part."""
    parts, of, offset, n = [], [], [], 0
    for k, text in enumerate(texts):
        for o in range(0, max(1, len(text) - length + 1), TOGETHER):
            part = text[o : o + TOGETHER + length - 1]
            if n + len(part) > TOGETHER + length and parts:
                yield parts, np.array(of), np.array(offset, np.int32)
                parts, of, offset, n = [], [], [], 0
            parts.append(part)
            of.append(k)
            offset.append(o)
            n += len(part)
    if parts:
        yield parts, np.array(of), np.array(offset, np.int32)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw")).withColumn("key", F.xxhash64("doc_id", "raw"))


def _cut_up(keyed: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for b in in_parts(batches, 1024):
            keys, raw = b.column("key").to_numpy(), b.column("raw").to_pylist()
            for parts, own, offset in _together(raw, length):
                m, h, of, start, size = segments(parts, length)
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(h), pa.array(keys[own[of]]), pa.array(start + offset[of]), pa.array(size)], ["m", "h", "key", "start", "size"])

    return keyed.where(F.octet_length("raw") >= length).select("key", "raw").mapInArrow(run, "m long, h long, key long, start int, size int")


class RunLengthIndex:
    """The run-compressed transform of some texts: the suffixes at the runs' heads, those before them, and their matches."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.ends = np.cumsum(sizes)  # behind each text's own end mark
        N = self.size = int(self.ends[-1])
        self.sym = np.zeros(N + 8, np.int16)
        self.sym[:N] = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        self.sym[:N] += 1
        self.sym[self.ends - 1] = 0
        word, whole = np.zeros(N, np.int64), np.ones(N, bool)
        for k in range(7):  # the first seven letters, up to the end mark
            word <<= 9
            word |= np.where(whole, self.sym[k : k + N], 0)
            whole &= self.sym[k : k + N] > 0
        tie = np.where(whole, len(texts), np.repeat(np.arange(len(texts), dtype=np.int32), sizes)).astype(np.int32)  # end marks differ
        order = np.lexsort((tie, word)).astype(np.int32)
        rank, reach = self._ranks(order, word, tie), 7
        del word, whole, tie
        self.levels: list[tuple[int, np.ndarray]] = []
        while True:
            self.levels.append((reach, rank))
            pair = rank * np.int64(N + 1)
            ahead = min(reach, N)
            pair[: N - ahead] += rank[ahead:]
            pair[N - ahead :] += rank[N - 1]
            order = np.argsort(pair, kind="stable").astype(np.int32)
            rank, reach = self._ranks(order, pair), reach * 2
            if int(rank.max()) == N - 1:
                break
        before = np.where(order > 0, self.sym[order - 1], 0)  # the transform
        head = np.ones(N, bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        heads = np.flatnonzero(head)
        self.runs = len(heads)
        heads = heads[heads > 0]
        heads = heads[np.argsort(order[heads])]  # in the order of the texts
        self.at, self.near = order[heads].astype(np.int64), order[heads - 1].astype(np.int64)
        self.match = self._extend(self.at, self.near)
        self.levels.clear()

    @staticmethod
    def _ranks(order: np.ndarray, *values: np.ndarray) -> np.ndarray:
        step = np.zeros(len(order), bool)
        for v in values:
            sorted_ = v[order]
            step[1:] |= sorted_[1:] != sorted_[:-1]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.cumsum(step, dtype=np.int32)
        return rank

    def _extend(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the texts from a and from b have in common."""
        out = np.zeros(len(a), np.int64)
        for reach, rank in reversed(self.levels):
            out += np.where(rank[a + out] == rank[b + out], reach, 0)
        going = np.arange(len(a))
        while len(going):  # fewer than the first reach are left
            going = going[(self.sym[a[going] + out[going]] == self.sym[b[going] + out[going]]) & (self.sym[a[going] + out[going]] > 0)]
            out[going] += 1
        return out

    def statistics(self) -> np.ndarray:
        """Matching statistics of each place against what sorts before: streamed from the samples, one less per byte."""
        sample = np.zeros(self.size, np.int32)
        sample[self.at] = 1
        sample = np.cumsum(sample, dtype=np.int32) - 1  # the last one at or before each place; a match ends with its text
        out = np.zeros(self.size, np.int32)
        led = np.flatnonzero(sample >= 0)
        out[led] = np.maximum(0, self.match[sample[led]] - (led - self.at[sample[led]]))
        return out

    def repeats(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of the stretches that match length bytes or more elsewhere in the index."""
        found = np.concatenate([[False], self.statistics() >= length, [False]])
        a, b = np.flatnonzero(found[1:] & ~found[:-1]), np.flatnonzero(found[:-1] & ~found[1:]) - 1 + length
        met = self.match >= length  # the partners of those stretches
        a, b = np.concatenate([a, self.near[met]]), np.concatenate([b, self.near[met] + self.match[met]])
        of = np.searchsorted(self.ends, a, side="right")
        base = np.where(of > 0, self.ends[of - 1], 0)
        return of, a - base, b - base


def _index(length: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("m", "ascending"), ("key", "ascending"), ("start", "ascending")])
        of, a, b = RunLengthIndex(rows.column("piece").to_pylist()).repeats(length)
        keep = rows.column("mark").to_numpy(zero_copy_only=False)[of]
        of, a, b = of[keep], a[keep], b[keep]
        base = rows.column("start").to_numpy()[of]
        return pa.table({"key": rows.column("key").to_numpy()[of], "a": (base + a).astype(np.int32), "b": (base + b).astype(np.int32)})

    return run


def slices(m: int, piece: bytes, length: int, width: int) -> list[tuple[int, int, bytes]]:
    """(hash of minimiser, slice and core; offset; bytes) of each slice of a segment: its windows with the minimiser at `width` neighbouring places."""
    p = int(np.argmin(_piece_hashes(np.frombuffer(piece, np.uint8)) & ~_PLACE))
    first, out = p - (len(piece) - length), []  # windows hold the minimiser at first..p
    for k in range(first // width, p // width + 1):
        least, most = max(k * width, first), min(k * width + width - 1, p)
        core = piece[p - k * width : p - k * width - width + 1 + length]
        out.append((xxhash.xxh3_64_intdigest(core, seed=(m + k * int(_M[0])) & 0xFFFFFFFFFFFFFFFF), p - most, piece[p - most : p - least + length]))
    return out


def _sliced(length: int, width: int):
    def run(batches):
        for part in in_parts(batches):
            rows = [(c, s, key, start + at, start, mark) for m, key, start, mark, piece in zip(*[part.column(x).to_pylist() for x in ("m", "key", "start", "mark", "piece")]) for c, at, s in slices(m, piece, length, width)]
            hashes = [np.array([r[0] for r in rows], np.uint64), np.array([xxhash.xxh3_64_intdigest(r[1]) for r in rows], np.uint64)]
            yield pa.RecordBatch.from_arrays([*(pa.array(h.view(np.int64)) for h in hashes), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int32()), pa.array([len(r[1]) for r in rows], pa.int32()), pa.array([r[4] for r in rows], pa.int32()), pa.array([r[5] for r in rows], pa.bool_())], ["m", "h", "key", "start", "size", "origin", "mark"])

    return run


def _fetch(batches):
    for part in in_parts(batches):
        rows = [(w["m"], key, w["start"], w["mark"], w["hot"], raw[w["start"] - origin : w["start"] - origin + w["size"]]) for key, origin, raw, want in zip(*[part.column(c).to_pylist() for c in ("key", "origin", "raw", "wanted")]) for w in want]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["m", "key", "start", "mark", "hot", "piece"])


def _level(segs: DataFrame, source: DataFrame, length: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """(key, a, b marked; the pieces of what is too large for a bucket, or None) of segments (m, h, key, start, size, origin, mark), whose bytes are in source (key, origin, raw).

    A segment with mark is to be marked; the others are there to be met. segs is a table of cut() that is used up.
    """
    seen = cut(segs.groupBy("m").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("n > 1").select("m", (F.col("lo") != F.col("hi")).alias("differ"), "n"), "seen")
    count = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = cut(join_hot(segs, seen, ["m"], "n", count), "kept", tidy=True)
    drop(segs)
    drop(seen)
    kinds = cut(kept.where("differ").groupBy("m", "h").agg(F.count("*").alias("copies"), F.min(F.struct("key", "start", "size", "origin", "mark")).alias("r")).select("m", "h", "copies", "r.*"), "kinds")
    span = lambda df: df.select("key", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))
    whole = span(kept.where("mark and not differ")).union(span(join_hot(kept.where("mark and differ"), kinds.where("copies > 1").select("m", "h", "copies"), ["m", "h"], "copies", count, "left_semi")))
    per_m = cut(kinds.groupBy("m").agg(F.sum("size").alias("bytes")), "per-m")
    total, hot = per_m.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes") > bucket_bytes, F.lit(False))).first()
    buckets = max(int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    one = F.struct("m", "start", "size", (F.col("mark") & (F.col("copies") == 1)).alias("mark"), (F.col("bytes") > bucket_bytes).alias("hot"))
    wanted = kinds.join(per_m, "m").groupBy("key", "origin").agg(F.collect_list(one).alias("wanted"))  # a document's own segments
    pieces = source.join(wanted, ["key", "origin"]).select("key", "origin", "raw", "wanted")
    pieces = cut(pieces.mapInArrow(_fetch, "m long, key long, start int, mark boolean, hot boolean, piece binary"), "pieces", tidy=True)
    found = pieces.where("not hot").withColumn("bucket", F.pmod(F.xxhash64("m"), F.lit(buckets))).groupBy("bucket").applyInArrow(_index(length), "key long, a int, b int")
    return whole.union(found), pieces.where("hot") if hot else None


def marks(keyed: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """key, a, b: stretches of bytes that occur elsewhere; they cover all of them and may overlap."""
    segs = cut(_cut_up(keyed, length).select("m", "h", "key", "start", "size", F.lit(0).alias("origin"), F.lit(True).alias("mark")), "segments")
    out, hot = _level(segs, keyed.select("key", F.lit(0).alias("origin"), "raw"), length, bucket_bytes)
    for width in widths:
        if hot is None:
            return out
        segs = cut(hot.mapInArrow(_sliced(length, width), segs.schema), "slices")
        found, hot = _level(segs, hot.select("key", F.col("start").alias("origin"), F.col("piece").alias("raw")), length, bucket_bytes)
        out = out.union(found)
    if hot is not None:
        raise ValueError(f"slices of {widths[-1]} places are still larger than {bucket_bytes} bytes")
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, carry: list[str] | None = None, as_text: bool = False, **more) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that are left), and carried (a struct c0, c1, .. of the columns of carry) for every row of docs (doc_id, text).

    as_text: kept is a string, without the letters that were cut through.
    """
    found = cut(marks(_keyed(docs), length, **more).distinct(), "marks", tidy=True)
    by_doc = found.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("marks"))  # a document's own marks
    carried = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry or [])))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"), carried.alias("carried")).withColumn("key", F.xxhash64("doc_id", "raw"))
    joined = keyed.join(by_doc, "key", "left").select("doc_id", "raw", "marks", "carried")
    schema = StructType([joined.schema["doc_id"], *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")), StructField("kept", StringType() if as_text else BinaryType()), joined.schema["carried"]])

    def apply(batches):
        for part in in_parts(batches):
            rows = [_removed(raw, [(m["a"], m["b"]) for m in found or ()]) for raw, found in zip(part.column("raw").to_pylist(), part.column("marks").to_pylist())]
            if as_text:
                rows = [(*r[:3], r[3].decode("utf-8", "ignore")) for r in rows]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary()))), part.column("carried")], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "carried"])

    return joined.mapInArrow(apply, schema)


def _removed(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, bytes]:
    """(bytes, bytes removed, maximal runs removed, what is left)."""
    if not spans:
        return len(raw), 0, 0, raw
    left, at, runs = [], 0, 0
    end = -1
    for a, b in sorted(spans):
        if a > end:
            left.append(raw[at:a])
            runs += 1
        end = max(end, b)
        at = end
    left.append(raw[at:])
    kept = b"".join(left)
    return len(raw), len(raw) - len(kept), runs, kept


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
