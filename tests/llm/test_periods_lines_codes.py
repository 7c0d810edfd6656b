"""Periodic runs, line dedup and vector codes against brute force and SQL."""

import hashlib
import random
import zlib

import duckdb
import numpy as np

from factloom.llm import codes, line_dedup, periods
from factloom.llm import queries as corpus
from tests.conftest import DATA
from tests.test_queries import rows


def sha(s) -> str:
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def brute_runs(w: list, least: int = 12) -> list:
    """(start, length, period) by trying every period from the least on; a stretch with a smaller period isn't counted again."""
    found = []
    for q in range(1, len(w) // 2 + 1):
        k = 0
        while k + q < len(w):
            if w[k] != w[k + q]:
                k += 1
                continue
            a = k
            while k + q < len(w) and w[k] == w[k + q]:
                k += 1
            length = k - a + q
            smaller = any(all(w[x] == w[x + d] for x in range(a, a + length - d)) for d in range(1, q))
            if length >= max(least, 2 * q) and not smaller:
                found.append((a, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    random.seed(4)
    texts = []
    for k in range(700):
        letters = random.choice([b"a", b"ab", b"abc", b"abcdefgh"])
        t = [bytes([random.choice(letters)]) for _ in range(random.randint(0, 60))]
        for _ in range(random.randint(0, 3)):
            at = random.randint(0, len(t))
            t[at:at] = t[at : at + random.randint(1, 9)] * random.randint(1, 8)
        texts.append(t)
    for least in (12, 2, 5):
        assert periods.find_runs(texts, least) == [brute_runs(t, least) for t in texts]
    assert periods.find_runs([], 12) == [] and periods.find_runs([[], []], 12) == [[], []]


def test_runs_of_rows(spark):
    unit = [f"w{k}" for k in range(700)]
    texts = [None, "", " \n\t ", "a " * 5000, " ".join(unit * 9 + ["end"]), "x y " * 6, "x y " * 5 + "x", "é é " * 12, "plain words only"]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(None, "b " * 12, ""), (3, "c", "")], "doc_id long, text string, runs string")
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(docs, held=100).collect()]
    want = [(k, [(0, 5000, 1)] if k == 3 else [(0, 6300, 700)] if k == 4 else [(0, 12, 2)] if k == 5 else [(0, 12, 1)] if k == 7 else [], {3: "a", 4: " ".join(unit + ["end"]), 5: "x y", 6: " ".join("x y x y x y x y x y x".split()), 7: "é é", 8: "plain words only"}.get(k, "")) for k in range(9)]
    assert sorted(map(str, got)) == sorted(map(str, want + [(None, [(0, 12, 1)], "b"), (3, [], "c")]))
    assert periods.op11_periodic_runs.__name__ in corpus.QUERIES and periods.digests(periods.periodic_runs(docs.where("false"))).count() == 0


def test_op11_equals_brute_force(spark):
    got = {r.doc_id: r for r in periods.op11_periodic_runs(spark, DATA).collect()}
    documents = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(documents)
    changed = 0
    for d in documents:
        w = (d.text or "").encode().split()
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w, changed = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)], changed + 1
        runs, r = brute_runs(w) if n <= 400 else periods.find_runs([w])[0], got[d.doc_id]
        gone = {x for s, length, q in runs for x in range(s + q, s + length)}
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        shown = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *shown), d.doc_id
        assert r.runs_sha256 == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)) and r.collapsed_sha256 == sha(b" ".join(x for k, x in enumerate(w) if k not in gone))
    assert changed > 5


def test_lines_equal_sql(spark, tmp_path):
    random.seed(9)
    pool = ["", " ", "Home", "home ", "\tHOME\r", "É", "é", "ÀB", "àb", "a ", "x" * 3000, "\x1fq", "Straße I"]
    texts = [None, "", "\n", "\n\n a \n"] + ["\n".join(random.choice(pool + [f"own {random.random()}"]) for _ in range(random.randint(0, 12))) for _ in range(150)]
    texts += ["Home\n" * 4000 + "tail", texts[9], texts[9]]
    docs = spark.createDataFrame([(None if k == 20 else k % 150, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, key string").repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(line_dedup.ORACLE)
    got = line_dedup.op12_line_dedup(spark, str(tmp_path))
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
    for hot in (1, 1 << 30):  # all keys by shuffle but the most common, all by broadcast
        other = line_dedup.without_common_lines(docs, hot=hot)
        assert sum(r.n_dropped for r in other.collect()) == sum(r.n_dropped for r in got.collect()) > 100
    assert line_dedup.without_common_lines(docs.where("false")).count() == 0
    one = line_dedup.without_common_lines(docs, least_length=0, least_docs=1).collect()
    assert all(r.n_dropped == r.n_lines and r.kept == "" for r in one)


def test_lines_and_codes_of_the_tables(spark):
    c = duckdb.connect()
    for name in ("documents", "embeddings"):
        c.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    for name in ("op12_line_dedup", "op13_vector_codes"):
        got, want = corpus.QUERIES[name](spark, DATA), c.sql(corpus.ORACLES[name])
        assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_balls_equal_a_full_search():
    random.seed(3)
    rng = np.random.default_rng(3)
    for k in range(60):
        width, entries = rng.integers(1, 5), rng.integers(1, 20)
        x, book = rng.integers(-6, 7, (200, width)), rng.integers(-6, 7, (entries, width))
        full = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        best, far = codes.nearest(x, book, rng.integers(0, entries, 200))
        assert (best == full.argmin(axis=1)).all() and (far == full.min(axis=1)).all()


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    given = [(1, [0.5] * 16, 1), (2, None, 1), (3, [nan] * 16, 1), (4, [inf] + [0.0] * 15, None), (5, [None] * 16, 2), (6, [-0.001] * 16, None), (7, [], None), (7, [1e30] + [0.0] * 16, 2), (None, [0.5] * 16, 1)]
    vectors = spark.createDataFrame([(*g, "clash") for g in given], "vec_id long, embedding array<float>, label int, code string")
    out, books = codes.compress(vectors, entries=3)
    got = sorted((r.vec_id or 99, len(r.codes), r.error >= 0) for r in out.collect())
    assert got == [(1, 16, True), (6, 16, True), (7, 16, True), (7, 16, True), (99, 16, True)] and books.shape == (16, 3, 2)
    assert codes.compress(vectors.where("false"))[0].count() == 0
