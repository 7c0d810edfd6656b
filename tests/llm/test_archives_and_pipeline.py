"""WARC packages by round trip, and the pipeline by brute force on its parts."""

import gzip
import hashlib
import io
import json
import zipfile
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import mixing, pieces, queries, stages, toxicity, warc
from factloom.llm.common import components, new_path
from tests.conftest import DATA
from tests.llm.test_urls_and_mixing import water_level
from tests.llm.test_duplicates import closure, shingles


def test_round_trip(spark):
    big, huge = "é" * 600, "z" * 200_000
    rows = [(1, "http://a/1", big), (2, "http://a/2 x\r\n", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (9, "u", huge), (8, "u", huge), (9, "u", huge), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    made = warc.write_packages(warc.with_targets(pages), new_path(spark, "warc"), roll=2_000)
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload and bytes(r.payload)) for r in warc.read_records(made).collect()), key=str)
    want = []
    for k, _, html in rows:
        raw = (html or "").encode()
        most = max([j for j, _, h in rows if j is not None and (h or "") == (html or "")])
        response = len(raw) < 1000 or k == most
        want.append((k or 0, "response" if response else "revisit", None if response else most, len(raw), hashlib.sha1(raw).hexdigest(), raw if response else None))
    assert got == sorted(want, key=str)
    none = warc.write_packages(warc.with_targets(pages.where("false")), new_path(spark, "warc"))
    assert warc.read_records(none).count() == 0


def test_directory_reads_zip_and_zip64():
    for wide in (False, True):
        f = io.BytesIO()
        with zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:
            for name, body in (("archive/a", b"12345"), ("indexes/b", b"x" * 1000)):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=wide) as m:
                    m.write(body)
            z.comment = b"a comment"
        f.seek(0)
        found = warc.directory(f, len(f.getvalue()))
        at, n = found["archive/a"]
        assert f.getvalue()[at : at + n] == b"12345" and found["indexes/b"][1] == 1000


def warc_record(kind, block, **more):
    fields = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in more.items())
    return f"WARC/1.0\r\nwarc-type: {kind}\r\n{fields}content-length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_packages_made_elsewhere(spark, tmp_path):
    ok = lambda body: b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    records = {
        "a.warc.gz": [warc_record("warcinfo", b"software: x"), warc_record("response", ok(b"one"), WARC_Record_ID="<urn:uuid:1>", WARC_Target_URI="http://h/1"), warc_record("request", b"GET / HTTP/1.1\r\n\r\n")],
        "b.warc.gz": [warc_record("response", ok(b"two"), WARC_Payload_Digest="sha1:" + hashlib.sha1(b"two").hexdigest()), warc_record("response", ok(b""))],
        "c.warc": [warc_record("response", ok(b"three")), warc_record("revisit", ok(b""), WARC_Refers_To="<urn:page:7>", WARC_Record_ID="<urn:page:9>")],
        "d.warc.gz": [warc_record("response", ok(b"four"))],
    }
    packed = {m: [gzip.compress(r) if m.endswith("gz") else r for r in rs] for m, rs in records.items()}
    at = lambda m, k: (sum(map(len, packed[m][:k])), len(packed[m][k]))
    cdxj = "!meta 0 {}\n" + "".join("com,h)/ 2020 " + json.dumps({"filename": f, "offset": at(m, k)[0], "length": str(at(m, k)[1]), "mime": "{"}) + "\n" for m, k, f in (("a.warc.gz", 1, "a.warc.gz"), ("b.warc.gz", 0, "archive/b.warc.gz"), ("b.warc.gz", 1, "b.warc.gz"), ("a.warc.gz", 1, "elsewhere.warc.gz")))
    cdx = " CDX N b a m s k r M S V g\n" + f"com,h)/ 2020 http://h/ text/html 200 X - - {at('d.warc.gz', 0)[1]} 0 d.warc.gz\n"
    with zipfile.ZipFile(tmp_path / "p.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("pages/pages.jsonl", "{}")
        for m, rs in packed.items():
            z.writestr(f"archive/{m}", b"".join(rs))
        z.writestr("archive/packed.warc", b"x" * 999, zipfile.ZIP_DEFLATED)
        z.writestr("indexes/one.cdxj", cdxj)
        z.writestr("indexes/two.cdx.gz", gzip.compress(cdx.encode()))
    got = warc.read_records(spark.createDataFrame([(f"file://{tmp_path}/p.wacz",)], "package string")).collect()
    assert {(bytes(r.payload), r.payload_bytes, r.record_id, r.url) for r in got if r.record_type == "response"} == {(b"one", 3, "<urn:uuid:1>", "http://h/1"), *((b, len(b), None, None) for b in (b"two", b"", b"three", b"four"))}
    assert sorted(r.record_type for r in got) == ["response"] * 5 + ["revisit"]
    assert {bytes(r.payload): r.payload_digest for r in got if r.payload is not None} == {b: hashlib.sha1(b).hexdigest() for b in (b"one", b"two", b"", b"three", b"four")}
    assert [(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"] == [(9, 7)]


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, 900), (900, 7), (7, 7), (5, 900)] + [(1000, k) for k in range(1001, 1050)]
    got = {r.node: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and got[900] == got[7] == got[5] == 5 and got[1049] == 1000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_runs_and_keeps_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, DATA)
        assert docs.columns == before.columns
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_near_stage_keeps_one_of_each(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(3, long, "en", "a", 1), (2, long + " end", "en", "a", 1), (1, "other text of its own here", "en", "b", 1), (None, "n", "en", "b", 1), (1, "other text of its own here", "en", "b", 1), (4, None, None, None, None), (1, "one more text with that same id", "en", "b", 1), (None, long, "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = stages.one_of_each_group(spark, docs, DATA).collect()
    assert sorted(((r.doc_id or 0), (r.text or "")[:3]) for r in kept) == [(0, "n"), (1, "one"), (1, "oth"), (2, "w0 "), (4, "")]


def brute(docs):
    """What the pipeline's stages must make of rows (doc_id, text), by hand: near-duplicates of five words at four fifths, then repeats."""
    sets = {i: shingles(t, 5) for i, t in docs}
    of = {}
    for i, s in sets.items():
        for w in s:
            of.setdefault(w, []).append(i)
    pairs = {(a, b) for ids in of.values() for a in ids for b in ids if a < b}
    group = closure(sets, [(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    kept = [(i, t) for i, t in docs if group[i] == i]
    raw = [(t or "").encode() for _, t in kept]
    count = Counter(t[k : k + 200] for t in raw for k in range(len(t) - 199))
    out = {}
    for (i, _), t in zip(kept, raw):
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        out[i] = b"".join(t[k : k + 1] for k in range(len(t)) if not gone[k])
    return out


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    clean = stages.reject_toxic(spark, docs, DATA)
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, t in texts.items() if toxicity.score_text(model, t) < toxicity.THRESHOLD)
    want = brute(sorted((r.doc_id, r.text) for r in clean.collect()))
    cut_ = stages.cut_repeats(spark, stages.one_of_each_group(spark, clean, DATA), DATA)
    assert {r.doc_id: r.text for r in cut_.collect()} == {i: t.decode("utf-8", "ignore") for i, t in want.items()}
    assert all(r.n_chars == len(r.text) for r in cut_.collect())
    mixed = mixing.mixed_words(cut_).collect()
    source = {r.doc_id: r.source for r in cut_.collect()}
    sizes, words = Counter(), Counter()
    for r in mixed:
        sizes[source[r.doc_id]] += len(want[r.doc_id].decode("utf-8", "ignore").encode().split())
        words[source[r.doc_id]] += r.taken
    assert all(abs(words[s] - level) <= 0.5 + 1e-6 for s, level in water_level(dict(sizes)).items())
    taken = {r.doc_id: -(-r.taken // r["size"]) for r in mixed if r.taken}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    left = {r.doc_id: r.text for r in cut_.collect()}
    ids = {i: sp.encode(left[i], add_eos=True) for i in taken}
    rows = sorted((i, len(ids[i]), sha(" ".join(map(str, ids[i]))), sha(sp.decode(ids[i]))) for i, n in taken.items() for _ in range(n))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()) == rows


def test_toxic_documents_go_and_clean_ones_stay(spark):
    """By the labels of a table of 1,000 documents; a model of fewer than a hundred labelled rows is too unsure to be judged."""
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    stays = stages.reject_toxic(spark, docs, at).select("doc_id", F.lit(True).alias("stays"))
    told = labels.join(docs.select("doc_id"), "doc_id").join(stays, "doc_id", "left").groupBy("toxic").agg(F.count("*").alias("n"), F.count("stays").alias("stay")).collect()
    by = {r.toxic: (r.n, r.stay) for r in told}
    assert by[0][1] >= 0.98 * by[0][0] and by[1][1] <= 0.5 * by[1][0], by


def test_stages_take_clashing_columns_nulls_and_empty_tables(spark):
    names = ["kept", "n_bytes", "_", "copies", "id", "own", "score", "toxic", "key", "marks", "carried", "none", "row", "sid", "size", "at", "copies__", "key_", "c0"]
    kinds = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in names)
    more = [f"v{k}" for k in range(len(names))]
    texts = [(1, "some words of a text", "a"), (None, None, None), (2, "", "a"), (None, "null id here", "b"), (3, "x" * 70_000, None), (1, "some words of a text", "a"), (4, "tie one two", "b"), (5, "tie two three", "b")]
    docs = spark.createDataFrame([(i, t, "en", s, 1, *more) for i, t, s in texts], kinds)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(tuple(r[5:]) == tuple(more) for r in rows)
        assert stage(spark, docs.where("false"), DATA).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == len(texts)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), DATA).count() == 0


def test_every_operator_is_registered():
    assert {int(q[2:].split("_")[0]) for q in queries.QUERIES} == set(range(1, 14))
