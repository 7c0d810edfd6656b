"""Shingle join, repeat removal and vector operators against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np

from factloom.llm import ann, near_vectors, repeats, shingle_join


def closure(ids, links):
    up = {i: i for i in ids}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in links:
        p, q = top(a), top(b)
        up[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def shingles(text, n):
    w = text.encode().lower().split() if text else []
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def test_groups_equal_brute_force(spark):
    random.seed(4)
    word = lambda: random.choice("ab cd ef gh ij kl mn op qr st uv".split()) + str(random.randint(0, 30))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(random.randint(5, 160))]
        for _ in range(random.randint(1, 6)):
            t = list(base)
            for _ in range(random.randint(0, 3)):
                t[random.randrange(len(t))] = word()
            texts.append(" ".join(t))
    texts += [passage + " " + " ".join(word() for _ in range(10)) for _ in range(40)]
    texts += [None, "", " \n", "one", "ONE", "one two", "x " * 3000, "É a b c", "é a b c"]
    rows = [(k * 3 % 1009, t, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + [(None, "one", "x")], "doc_id long, text string, n string")
    for n, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: r for r in shingle_join.groups(docs, n, percent).collect()}
        sets = {k: shingles(t, n) for k, t, _ in rows}
        links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        want = closure(sets, links)
        assert {k: got[k].component_id for k in sets} == want
        assert all(got[k].n_shingles == len(s) for k, s in sets.items()) and got[None].component_id is None
    assert shingle_join.groups(docs.where("false")).count() == 0


def test_frequent_tokens_are_paired(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "RARE", 3)
    random.seed(8)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(60):
        t = list(base) if k % 2 else [f"v{j}" for j in range(80)]
        for _ in range(k % 4):
            t[random.randrange(80)] = f"z{random.randint(0, 9)}"
        rows.append((k, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {k: shingles(t, 4) for k, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert {r.doc_id: r.component_id for r in shingle_join.groups(docs).collect()} == closure(sets, links)


def test_prefixes_always_share_a_signature(monkeypatch):
    monkeypatch.setattr(shingle_join, "RARE", 5)
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(4, 120))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
        keep = rng.random(len(a)) > 0.06
        b = np.unique(np.concatenate([a[keep], rng.integers(0, 1 << 63, 3, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 85 * (len(a) + len(b) - both):
            continue
        df = {int(t): int(rng.integers(2, 12)) for t in np.concatenate([a, b]).view(np.int64) if rng.random() < 0.8}
        shared = set(np.intersect1d(a, b).view(np.int64).tolist())
        sig = []
        for s in (a, b):
            inside = s[s < np.uint64(shingle_join.ZONE)].view(np.int64).tolist()
            sig.append(dict(shingle_join.prefix_signatures(s, len(s), {t: df.get(t, 2) for t in inside if t in shared or t in df})))
        fits = lambda n, at, m, to: 185 * min(n - at, m - to) >= 85 * (n + m)
        assert any(fits(len(a), sig[0][x], len(b), sig[1][x]) for x in sig[0].keys() & sig[1].keys())


def test_small_sets_share_a_signature():
    rng = np.random.default_rng(2)
    for percent in (85, 80):
        for n in range(4, 26):
            for more in (1, 2):
                if 100 * n < percent * (n + more):
                    continue
                for _ in range(100):
                    b = np.unique(rng.integers(0, 1 << 63, n + more, dtype=np.uint64) << np.uint64(1))
                    a = np.sort(rng.permutation(b)[:n])
                    common = set(a.view(np.int64).tolist())
                    df = {t: int(rng.choice([2, 400, 600, 5000])) for t in b[b < np.uint64(shingle_join.ZONE)].view(np.int64).tolist() if t in common or rng.random() < 0.5}
                    sig = [dict(shingle_join.prefix_signatures(s, len(s), {t: c for t, c in df.items() if t in s.view(np.int64)}, percent)) for s in (a, b)]
                    assert any((100 + percent) * min(n - sig[0][x], n + more - sig[1][x]) >= percent * (2 * n + more) for x in sig[0].keys() & sig[1].keys()), (percent, n, more)


def test_short_texts_with_words_appended(spark):
    random.seed(12)
    rows, families = [], []
    for size in range(4, 26):
        for k in range(12):
            base = [f"s{size}k{k}w{j}" for j in range(size + 3)]
            families.append([base, base + ["more"], base + ["more", "still"]])
    for k in range(3):  # shingles in more than RARE sets
        base = [f"hot{k}w{j}" for j in range(9)]
        families.append([base] + [base + [f"end{j}"] for j in range(shingle_join.RARE + 40)])
    texts = [[" ".join(t) for t in f] for f in families]
    rows = [(i, t) for i, t in enumerate(t for f in texts for t in f)]
    ids = iter(range(len(rows)))
    families = [[(next(ids), t) for t in f] for f in texts]
    docs = spark.createDataFrame(random.sample(rows, len(rows)), "doc_id long, text string")
    for n, percent in ((4, 85), (5, 80)):
        links = []
        for f in families:
            sets = [(i, shingles(t, n)) for i, t in f]
            links += [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if 100 * len(x & y) >= percent * len(x | y)]
        got = {r.doc_id: r.component_id for r in shingle_join.groups(docs, n, percent).collect()}
        assert got == closure([i for i, _ in rows], links)


def left_over(texts, length):
    count = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    random.seed(6)
    line = lambda n: "".join(random.choice("abcdefg é") for _ in range(n))
    shared = [line(150), line(260), line(400)]
    texts = [None, "", "short", "ab" * 300, "ab" * 300 + "x", line(3000)]
    for _ in range(60):
        t = line(random.randint(0, 300)) + random.choice(shared) + line(random.randint(0, 200)) + random.choice(shared)
        t = list(t)
        for _ in range(random.randint(0, 2)):
            t[random.randrange(len(t))] = "#"
        texts.append("".join(t))
    return texts + [texts[-1]]


def test_repeats_equal_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, key string")
    want = left_over([(t or "").encode() for t in texts], 200)
    for more in ({}, {"bucket_bytes": 5000}, {"bucket_bytes": 500}):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in repeats.without_repeats(docs, **more).collect()}
        assert [got[k] for k in range(len(texts))] == want
    assert repeats.without_repeats(docs.where("false")).count() == 0


def test_equal_rows_repeat_each_other_and_long_texts_are_cut(spark, monkeypatch):
    monkeypatch.setattr(repeats, "TOGETHER", 1000)
    texts = corpus()
    docs = spark.createDataFrame([(1, t) for t in texts] + [(None, texts[-1])], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in repeats.without_repeats(docs).collect())
    assert got == sorted(left_over([(t or "").encode() for t in [*texts, texts[-1]]], 200))


def test_a_minimiser_that_all_documents_share(spark):
    random.seed(16)
    noise = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    passage = noise(190)  # shorter than the strings that count: every document's windows differ, but for the few with equal neighbours
    texts = [noise(120) + random.choice("xyz") + passage + random.choice("pq") * random.choice([1, 12]) + noise(120) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = left_over([t.encode() for t in texts], 200)
    for more in ({}, {"bucket_bytes": 2000}, {"bucket_bytes": 2000, "widths": (40, 7, 1)}):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in repeats.without_repeats(docs, **more).collect()}
        assert [got[k] for k in range(len(texts))] == want
    assert 0 < sum(w[1] for w in want)


def test_index_statistics():
    random.seed(3)
    for _ in range(20):
        texts = [bytes(random.choice(b"ab") for _ in range(random.randint(1, 60))) for _ in range(6)]
        index = repeats.RunLengthIndex(texts)
        assert index.runs <= sum(map(len, texts)) + len(texts)
        stream = index.statistics()
        for k, t in enumerate(texts):
            base = index.ends[k] - len(t) - 1
            for at, n in enumerate(stream[base : base + len(t)].tolist()):  # a real match elsewhere, of that length
                places = [(j, o) for j, x in enumerate(texts) for o in range(len(x)) if x[o : o + n] == t[at : at + n]]
                assert n <= len(t) - at and (n == 0 or len(places) > 1)
        for length in (3, 6, 12):  # and nothing is missed
            got = [bytearray(len(t)) for t in texts]
            for of, a, b in zip(*index.repeats(length)):
                got[of][a:b] = b"\1" * (b - a)
            assert [(len(t), sum(g)) for t, g in zip(texts, got)] == [x[:2] for x in left_over(texts, length)]


def vectors(n=400, width=16):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, width)).astype(np.float32)
    for k in range(1, n, 3):
        x[k] = x[k - 1] + rng.standard_normal(width).astype(np.float32) * rng.choice([0.0, 0.05, 0.3])
    return x


def odd_rows():
    return [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 16, 1), (9004, [float("nan")] + [1.0] * 15, 1), (9005, [float("inf")] + [1.0] * 15, 1), (9006, [None] + [1.0] * 15, 1), (9007, [1.0] * 16, None)]


def test_near_vectors_equal_brute_force(spark):
    x = vectors()
    rows = [(k * 7 % 997, v.tolist(), k % 3 // 2) for k, v in enumerate(x)]
    df = spark.createDataFrame([(*r, "c") for r in rows + odd_rows()], "vec_id long, embedding array<float>, label int, key string")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    ids, labels = [r[0] for r in rows], np.array([r[2] for r in rows])
    near = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    want = closure(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    for more in ({}, {"block": 16, "bits": 2, "tables": 8}):
        got = {r.vec_id: r for r in near_vectors.near_duplicates(df, **more).collect()}
        assert len(got) == len(rows) + 7
        differ = sum(got[i].component_id != want[i] for i in ids), sum(got[i].n_links != n for i, n in zip(ids, near.sum(axis=1)))
        assert max(differ) <= (0 if more else 0.02 * len(ids))  # sign hashing may miss a pair; few bits and many tables don't
        assert all(got[i].n_links <= n for i, n in zip(ids, near.sum(axis=1)))
        assert all(got[r[0]].n_links == 0 and got[r[0]].kept for r in odd_rows())
    assert near_vectors.near_duplicates(df.where("false")).count() == 0


def test_nearest_neighbours(spark):
    x = vectors(600)
    x[300:340] = x[300]  # many equal vectors: ties go to the smaller id
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows + odd_rows(), "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.search(df, "vec_id % 20 = 0").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 20):
        sim = u @ u[q]
        sim[q] = -2
        want = np.lexsort((np.arange(600), -np.round(sim, 12)))[:5]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(m[2] - sim[m[1]]) < 1e-9 for m in mine)
        hits += len({m[1] for m in mine} & set(want.tolist()))
    assert hits >= 0.9 * 150
    assert [m[1] for m in sorted(got[320])] == [300, 301, 302, 303, 304]
    few = df.where("vec_id in (0, 1, 2)")
    assert {(r.query_id, r.vec_id) for r in ann.search(few, "vec_id = 0").collect()} == {(0, 1), (0, 2)}
    assert ann.search(df.where("false"), "vec_id = 0").count() == 0


def test_rows_with_one_vec_id_are_rows_of_their_own(spark):
    a, b, c = [1.0, 0.0, 0.1], [1.0, 0.01, 0.1], [0.0, 1.0, 0.0]
    rows = [(7, a, 1), (8, b, 1), (7, b, 2), (9, c, 1), (9, a, 1), (9, c, 1), (10, a, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(df).collect())
    # label 1: 7a, 8b and 9a link, the two 9c link; label 2: 7b and 10a link
    assert got == sorted([(7, 2, 7, True), (8, 2, 7, False), (9, 2, 7, False), (9, 1, 9, True), (9, 1, 9, True), (7, 1, 7, True), (10, 1, 7, False)])
    rows = [(50, a, 0), (50, c, 0), (1, b, 0), (2, c, 0), (100, [1.0, 2.0], 0), (101, [2.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.search(df, "vec_id % 50 = 0").collect())
    cos = lambda x, y: round(float(np.dot(np.float32(x), np.float32(y)) / np.linalg.norm(np.float32(x)) / np.linalg.norm(np.float32(y))), 6)
    want = []
    for k, (q, x, _) in enumerate(rows):
        if q % 50 == 0:
            near = sorted((-cos(x, y), v) for j, (v, y, _) in enumerate(rows) if j != k and len(y) == len(x))
            want += [(q, r + 1, v, -s) for r, (s, v) in enumerate(near)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and all(abs(g[3] - w[3]) < 1e-4 for g, w in zip(got, sorted(want)))


def test_shapes_follow_the_rows():
    assert near_vectors.shape(1_000)[1] == near_vectors.LEAST_BITS and near_vectors.shape(1 << 30)[1] == 20
    for rows in (10, 1 << 24, 1 << 34):
        tables, bits = near_vectors.shape(rows)
        meets = (1 - np.arccos(near_vectors.LEAST) / np.pi) ** bits
        assert (1 - meets) ** tables <= near_vectors.MISS


def test_sketches_never_rule_out_similar_sets():
    rng = np.random.default_rng(5)
    for n in (1, 7, 80, 900, 5000):
        for _ in range(20):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.1], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)]))
            bits = int(np.bitwise_count((shingle_join.sketch(x) ^ shingle_join.sketch(y)).view(np.uint64)).sum())
            assert bits <= len(np.setxor1d(x, y))


def test_queries_unlike_the_other_rows(spark):
    rng = np.random.default_rng(4)
    centres, n = rng.normal(size=(300, 32)), 12_000
    x = centres[rng.integers(0, 300, n)] + 0.05 * rng.normal(size=(n, 32))
    x[::50] = rng.normal(size=(n // 50, 32))  # the other rows lie in clusters, the queries anywhere
    x = x.astype(np.float32)
    got = {}
    for r in ann.search(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>"), "vec_id % 50 = 0").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    for q in range(0, n, 50):
        sim = u @ u[q]
        sim[q] = -2
        hits += len(got[q] & set(np.argsort(-sim)[:5].tolist()))
    assert hits >= 0.9 * 5 * n / 50, hits / (5 * n / 50)
