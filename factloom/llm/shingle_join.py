"""N-gram Jaccard self-join by token-combination prefixes, and the groups it links.

Tokens are hashes of shingles (four words unless told otherwise). Equal sets are merged first. All tokens share one
order: first the tokens whose hash is below ZONE, rarest first by their exact document count over the whole corpus, then
the rest by hash. Tokens of the zone in at most RARE documents are indexed singly; frequent ones, and those outside the
zone, fall into CLASSES classes by hash and are indexed by pairs of one class. A set's prefix is extended - one token
for each such class that it meets - until two sets that are similar enough must share a signature: the tokens that may
differ can't break up every single token and every pair. A set that runs out first (100 * CLASSES / percent tokens at
most) also has the first tokens of an ordinary prefix as single signatures: two such sets share one of these, and with a
set that doesn't run out it shares a pair or a rare token. A token of one document fills its place in the prefix without
any signature, so most documents have none and leave early.

Candidates are verified exactly, without listing all pairs of a bucket: every set of a bucket is compared with the
bucket's centre (the one with the fewest tokens of its own), then the sets outside the bucket's largest component with a
centre from among themselves; so groups of copies of any size are connected at one comparison per member and round, and
sets known to be connected aren't compared again. What is still outside the largest component then meets the bucket's
sets in other components, but a pair is only kept if the two sketches allow it: the sketch of a set has the parity of
its tokens in each of 64 * SKETCH bits, so two sets differ in as many tokens at least as their sketches do in bits. That
bound drops the pairs that are somewhat less similar than asked for, which is what large buckets are full of, within the
join, before any set is read; for sets of thousands of tokens it gets weaker, never wrong. A pair also counts in a
bucket only if it could still be similar enough were this the first token that the two share: the tokens before it in
either set are then lost, and so are those that no other candidate has, which are counted over the candidates' whole
sets. So sets that share a common passage and little else drop out.

Scale: document counts are combined before the shuffle; hot tokens are split by AQE's skew join; shingles are taken where
the text lies, and whole sets are made for candidates only.

Defined cases: null, empty or blank text has no shingles and is alone; fewer words than a shingle has: the whole
sequence is one; a null doc_id is alone with a null component; rows of one doc_id are one document that links if any of
its texts does; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, drop, in_parts, table

WORDS, PERCENT = 4, 85
#: Tokens with a hash below are counted over the corpus.
ZONE = 1 << 62
RARE, CLASSES = 500, 16
#: Bits of a set's parity sketch, in numbers of 64.
SKETCH = 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return x ^ (x >> np.uint64(29))


def grams(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    found = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64) if found else np.zeros(0, np.uint64)
    one = xxhash.xxh3_64_intdigest
    h = np.array([one(w) for w in found], np.uint64)
    n = len(h) - words + 1
    s = h[:n]
    for k in range(1, words):
        s = _mixed(s) * _B + h[k : k + n]
    return np.unique(_mixed(s))


def base(n: int, percent: int = PERCENT) -> int:
    """Tokens of a set of n that a similar set may lack, plus one."""
    return n - (percent * n + 99) // 100 + 1


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def heads(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, key (of the whole set), head (the first tokens by hash: the zone, and enough beyond it)."""

    def run(batches):
        for b in in_parts(batches):
            sets = [grams(t, words) for t in b.column("text").to_pylist()]
            keep = [max(int(np.searchsorted(s, np.uint64(ZONE))), min(len(s), base(len(s), percent) + CLASSES)) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([s[:k].tobytes() for s, k in zip(sets, keep)], pa.binary())], ["doc_id", "n", "key", "head"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key binary, head binary")


def _zone_tokens(reps: DataFrame) -> DataFrame:
    """doc_id, token: the tokens of each head that lie in the zone."""

    def run(batches):
        for b in in_parts(batches):
            rows = [np.frombuffer(h, np.uint64) for h in b.column("head").to_pylist()]
            rows = [r[: np.searchsorted(r, np.uint64(ZONE))] for r in rows]
            ids = np.repeat(b.column("doc_id").to_numpy(), [len(r) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_long(np.concatenate(rows)) if rows else np.zeros(0, np.int64))], ["doc_id", "token"])

    return reps.select("doc_id", "head").mapInArrow(run, "doc_id long, token long")


def prefix_signatures(head: np.ndarray, n: int, shared: dict[int, int], percent: int = PERCENT) -> list[tuple[int, int]]:
    """(signature, tokens before it in the order - 0 for pairs) of one set.

    shared: token -> document count, of the zone's tokens in two documents or more.
    """
    need, zone = base(n, percent), int(np.searchsorted(head, np.uint64(ZONE)))
    inside, beyond = _long(head[:zone]).tolist(), _long(head[zone:])
    at = got = own = len(inside) - len(shared)  # tokens of this document alone come first and match nothing
    if got >= need:
        return []
    out, members = [], {}
    ranked = sorted(((t, shared[t]) for t in inside if t in shared), key=lambda x: (x[1], x[0]))
    for token, count in ranked:
        if got >= need:
            return out
        if count <= RARE:
            out.append((token, at))
            got += 1
        else:
            got += _pairs(token, members, out)
        at += 1
    for token in beyond.tolist():
        if got >= need:
            return out
        got += _pairs(token, members, out)
    if got >= need or percent * (n + 1) > 100 * n:  # to the smallest sets only equal ones are similar
        return out
    # the whole set is its prefix, but its pairs may be too few: two such sets meet in one of their first tokens
    first = ([t for t, _ in ranked] + beyond.tolist())[: need - own]
    return out + [(t, own + k) for k, t in enumerate(first) if shared.get(t, RARE + 1) > RARE]


def _pairs(token: int, members: dict, out: list) -> int:
    """Add the token's pairs with the members of its class; 1 if it wasn't the first."""
    own = members.setdefault((token >> 8) % CLASSES, [])
    out += [(xxhash.xxh3_64_intdigest(np.array(sorted((token, o)), np.int64).tobytes()) - (1 << 63), 0) for o in own]
    own.append(token)
    return int(len(own) > 1)


def signatures(reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """sig, doc_id, n, at (tokens before the signature), own (tokens of the zone that no other document has) for the sets of reps (doc_id, n, head)."""
    tokens = _zone_tokens(reps)
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    mine = tokens.join(counts, "token").groupBy("doc_id").agg(F.collect_list(F.struct("token", "df")).alias("shared"))  # a document's own tokens

    def run(batches):
        for b in in_parts(batches):
            rows = []
            for doc, n, head, shared in zip(*[b.column(c).to_pylist() for c in ("doc_id", "n", "head", "shared")]):
                head = np.frombuffer(head, np.uint64)
                own = int(np.searchsorted(head, np.uint64(ZONE))) - len(shared or ())
                rows += [(sig, doc, n, at, own) for sig, at in prefix_signatures(head, n, {s["token"]: s["df"] for s in shared or ()}, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["sig", "doc_id", "n", "at", "own"])

    return reps.select("doc_id", "n", "head").join(mine, "doc_id", "left").mapInArrow(run, "sig long, doc_id long, n long, at long, own long")


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of the tokens that fall to each of 64 * SKETCH bits: two sets differ in as many tokens at least as their sketches in bits."""
    odd = np.bincount((grams % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _bits_apart(own: str, other: str) -> str:
    """SQL for the bits in which two sketches differ."""
    return " + ".join(f"bit_count({own}[{k}] ^ {other}[{k}])" for k in range(SKETCH))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches):
        for b in in_parts(batches):
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _set_tokens(sets: DataFrame) -> DataFrame:
    def run(batches):
        for b in in_parts(batches):
            rows = [np.frombuffer(g, np.int64) for g in b.column("grams").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("doc_id").to_numpy(), [len(r) for r in rows])), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))], ["doc_id", "token"])

    return sets.mapInArrow(run, "doc_id long, token long")


def _without_hopeless(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The buckets without sets that have too many tokens no other candidate has; the others learn how many they have.

    Tokens of all candidates' whole sets are counted; what no other candidate has can't be in common with any.
    """
    tokens = _set_tokens(sets)
    twice = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
    shared = tokens.join(twice, "token").groupBy("doc_id").agg(F.count("*").alias("shared"))
    known = buckets.join(shared, "doc_id").withColumn("own", F.greatest(F.lit(0), F.col("n") - F.col("shared"))).where(f"100 * (n - own) >= {percent} * n")
    known = cut(known.select("sig", "doc_id", "n", F.greatest("at", "own").alias("at"), "own"), "known", tidy=True)
    busy = known.groupBy("sig").agg(F.count("*").alias("m")).where("m > 1").select("sig")
    return cut(known.join(busy, "sig"), "hopeful")


def _apart(buckets: DataFrame, edges: DataFrame) -> DataFrame:
    """The buckets of more than one component of edges, with comp, and main: the bucket's largest."""
    comps = components(edges).withColumnRenamed("node", "doc_id").withColumnRenamed("component_id", "comp")
    now = cut(buckets.join(comps, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id")), "open")
    sizes = now.groupBy("sig", "comp").agg(F.count("*").alias("k"))
    most = sizes.groupBy("sig").agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    return now.join(most.select("sig", F.col("top.comp").alias("main")), "sig")


def linked(docs: DataFrame, reps: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b): links that connect all similar sets of reps (doc_id, n, head), a table of cut() that is used up; the sets are made from docs' texts again."""
    # what two sets may have in common if this is the first token they share: all but the tokens before it
    close = lambda n, at, m, to: f"{100 + percent} * least({n} - {at}, {m} - {to}) >= {percent} * ({n} + {m})"
    # what two sets may differ in, and do at least by their sketches
    alike = lambda n, x, m, y: f"{100 + percent} * ({_bits_apart(x, y)}) <= {100 - percent} * ({n} + {m})"
    signed = cut(signatures(reps, percent), "signatures", tidy=True)
    drop(reps)
    busy = signed.groupBy("sig").agg(F.count("*").alias("m")).where("m > 1").select("sig")
    buckets = cut(signed.join(busy, "sig"), "buckets")
    drop(signed)

    def whole(batches):
        for b in in_parts(batches):
            sets = [grams(t, words) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))], ["doc_id", "grams", "bits"])

    sets = cut(docs.select("doc_id", "text").join(buckets.select("doc_id").distinct(), "doc_id").mapInArrow(whole, "doc_id long, grams binary, bits array<long>"), "sets", tidy=True)
    buckets = _without_hopeless(buckets, sets, percent)
    # every member of a bucket with its centre
    facts = buckets.groupBy("sig").agg(F.count("*").alias("m"), F.min(F.struct("own", F.xxhash64("doc_id"), "doc_id", "n", "at")).alias("c")).select("sig", F.col("c.doc_id").alias("cd"), F.col("c.n").alias("cn"), F.col("c.at").alias("ca"))
    star = buckets.join(facts, "sig").where(f"doc_id <> cd and {close('n', 'at', 'cn', 'ca')}").select(F.least("doc_id", "cd").alias("a"), F.greatest("doc_id", "cd").alias("b"))
    edges = cut(_verified(star.distinct(), sets, percent), "verified")
    apart = _apart(buckets, edges)
    apart = cut(apart.join(sets.select("doc_id", "bits"), "doc_id"), "apart")
    # those outside their bucket's largest component, with a centre from among them
    facts = apart.where("comp <> main").groupBy("sig").agg(F.min(F.struct(F.xxhash64("doc_id"), "doc_id", "n", "at", "comp", "bits")).alias("c")).select("sig", F.col("c.doc_id").alias("cd"), F.col("c.n").alias("cn"), F.col("c.at").alias("ca"), F.col("c.comp").alias("cc"), F.col("c.bits").alias("other"))
    star = apart.join(facts, "sig").where(f"comp <> cc and {close('n', 'at', 'cn', 'ca')} and {alike('n', 'bits', 'cn', 'other')}").select(F.least("doc_id", "cd").alias("a"), F.greatest("doc_id", "cd").alias("b"))
    edges = edges.union(cut(_verified(star.distinct(), sets, percent), "verified"))
    # what is still apart: those outside their bucket's largest component, with all others of the bucket
    apart = cut(_apart(apart.drop("comp", "main"), edges), "apart")
    few = apart.where("comp <> main").select("sig", F.col("doc_id").alias("d"), F.col("n").alias("dn"), F.col("at").alias("da"), F.col("comp").alias("dc"), F.col("bits").alias("other"))
    pairs = few.join(apart, "sig").where(f"comp <> dc and {close('n', 'at', 'dn', 'da')} and (comp = main or d < doc_id) and {alike('n', 'bits', 'dn', 'other')}").select(F.least("doc_id", "d").alias("a"), F.greatest("doc_id", "d").alias("b"))
    edges = edges.union(cut(_verified(pairs.distinct(), sets, percent), "verified"))
    drop(sets)
    return edges


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    whole = cut(heads(docs, words, percent), "heads")
    first = cut(whole.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep")), "first")
    keys = cut(whole.select("doc_id", "n", "key"), "keys")
    reps = cut(whole.join(first, "key").where("doc_id = rep").select("doc_id", "n", "head"), "reps", tidy=True)
    drop(whole)
    same = keys.select("doc_id", "key").join(first, "key").select("doc_id", "rep").where("doc_id is not null").distinct()
    twice = same.groupBy("doc_id").agg(F.min("rep").alias("a")).join(same, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    comps = components(linked(docs, reps, words, percent).union(twice))
    of = same.join(comps.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component_id", "rep")).alias("component_id"))
    return keys.select("doc_id", F.col("n").alias("n_shingles")).join(of, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
