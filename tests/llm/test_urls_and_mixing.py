"""URL filter and source mixing against plain Python, with the odd cases."""

import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from factloom.llm import mixing, url_filter
from factloom.llm.common import join_hot, sums_before


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, min(fits)[1], min(fits)[2]) if fits else (host, path, None, default)


URLS = ["https://a.example.org/es/x?q=1", "http://EXAMPLE.ORG/en/12#t", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/fr", "http://com/de/1", "http://notexample.org/es/", "ftp://h?x=/es/", "no scheme example.org/es/", "", None, "http://", "http://a.b.c.d.e.f.g.h.org/" + "p" * 5000, "http://user@example.org:80/es/", "http://x.org", "https://a.example.org/es/x?q=1"]


def test_rules_fit_as_by_hand(spark):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)] + [(None, URLS[0], "x")], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark, url_filter.RULES), rows_per_sweep=3).collect()}
    assert got == {k: judged(u, url_filter.RULES) for k, u in [*enumerate(URLS), (None, URLS[0])]}


def test_nested_rules_pop_the_stack(spark):
    rules = [("a.b", "/", "allow"), ("a.b", "/x/", "block"), ("a.b", "/x/y", "allow"), ("a.b", "/x/z/", "block"), ("b", "/x/y/q", "block")]
    urls = [f"http://a.b/{p}" for p in ("", "x", "x/", "x/y", "x/y/q", "x/ya", "x/z", "x/z/1", "y", "x/zz")] + ["http://b/x/y/q1", "http://c.a.b/x/z/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark, rules)).collect()}
    assert got == {k: judged(u, rules) for k, u in enumerate(urls)}


def test_no_pages_or_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = url_filter.rules_frame(spark, url_filter.RULES)
    assert url_filter.filter_urls(none, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert url_filter.filter_urls(one, rules.where("false"), default="block").first().verdict == "block"


def water_level(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * share > 3 * sizes[s]}
        if not over:
            return target | {s: w[s] * share for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
        left = float(sum(sizes.values())) - sum(target.values())
    return target


def test_mix_meets_its_targets(spark):
    rows = [(k, " ".join(["w"] * (k % 40 + 1)) if k % 11 else [None, "", " \t\n"][k % 3], f"s{k % 7}" if k % 9 else None) for k in range(900)] + [(2000, "a b c", "tiny"), (2000, "a b c", "tiny"), (2001, "a b", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mixed_words(docs).collect()
    assert len(got) == len(rows)
    sizes, of = defaultdict(int), {}
    for k, text, source in rows:
        sizes[source] += len((text or "").split())
        of.setdefault(k, set()).add(source)
    level = water_level(dict(sizes))
    words = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        assert any(sizes[s] == r.source_size and abs(level[s] - r.target) < 1e-6 for s in of[r.doc_id])
        if len(of[r.doc_id]) == 1:
            words[next(iter(of[r.doc_id]))] += r.taken
    for s in level:
        assert abs(words[s] - level[s]) <= 0.5 + 1e-6, s
    again = docs.repartition(7)
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, mixing.mixed_words(again).collect())) == sorted(map(key, got))


def test_small_sources_meet_their_targets(spark):
    """3 million words in a large source, and sources far below a 65,536th of that."""
    many = spark.range(600).select("id", F.repeat(F.lit("w "), 5_000).alias("text"), F.lit("a").alias("source"))
    few = [(1000 + k, "v " * (k % 5 + 4), f"b{k // 5:02}") for k in range(200)]  # 30 words each
    docs = many.union(spark.createDataFrame(few, "id long, text string, source string")).withColumnRenamed("id", "doc_id")
    docs = docs.union(spark.createDataFrame([(5000, "x " * 20, "c"), (5001, "y", "d")], docs.schema))
    words = mixing.mixed_words(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(words) == 43
    for r in words:
        assert r.taken == math.floor(r.target + 0.5) > 0, r


def test_slots_follow_the_words(spark, monkeypatch):
    rows = [(k, "w " * 30, "ab"[k % 3 > 0]) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "SLOTS", 8)
    monkeypatch.setattr(mixing, "BLOCK", 10)
    monkeypatch.setattr(mixing, "STRETCH", 64)
    sources = mixing.laid_out(docs)[1]
    assert mixing.slots_for(sources) == 2_700
    plan = mixing.schedule(spark, sources, 2_700).collect()
    assert sorted(r.slot for r in plan) == list(range(2_700))
    for sid in (1, 2):
        assert [r.rank for r in sorted(plan, key=lambda r: r.slot) if r.sid == sid] == list(range(sum(r.sid == sid for r in plan)))
    pieces = mixing.mix(docs)[2].collect()
    by_slot = defaultdict(int)
    for r in pieces:
        by_slot[r.slot] += r.to_word - r.from_word
    assert sum(by_slot.values()) == 27_000 and set(by_slot.values()) <= {9, 10, 11}
    places = defaultdict(list)
    for r in pieces:
        places[r.sid, r.at, r.epoch].append((r.from_word, r.to_word))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(x[1] == y[0] for x, y in zip(p, p[1:]))


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixed_words(docs).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.size, r.target, r.taken) for r in mixing.mixed_words(blank).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_hot_keys_meet_by_broadcast(spark):
    rows = spark.createDataFrame([("a", k) for k in range(300)] + [("b", k) for k in range(5)] + [("c", 0), ("d", 0)], "key string, v long")
    keys = spark.createDataFrame([("a", 300, 1), ("b", 5, 2), ("c", 1, 3), ("e", 9, 4)], "key string, n long, x int")
    want = sorted((r.key, r.v, r.x) for r in rows.join(keys, "key").collect())
    for hot in (1, 2, 100, 10**6):
        assert sorted((r.key, r.v, r.x) for r in join_hot(rows, keys, ["key"], "n", 315, hot=hot).collect()) == want
        assert sorted(map(tuple, join_hot(rows, keys, ["key"], "n", 315, "left_semi", hot).collect())) == sorted(w[:2] for w in want)
    assert join_hot(rows.where("false"), keys, ["key"], "n", 0).count() == 0


def test_sums_by_stretches(spark):
    rows = [(s, p, (7 * p + s) % 5) for s in (1, 2) for p in range(0, 60, s)]
    for width in (1, 7, 1000):
        got = {(r.sid, r.p): r.base for r in sums_before(spark.createDataFrame(rows, "sid int, p long, v long"), "sid", "p", "v", "base", width).collect()}
        assert got == {(s, p): sum(v for t, q, v in rows if t == s and q < p) for s, p, _ in rows}
