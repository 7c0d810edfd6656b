"""SentencePiece, toxicity and HTML extraction against libraries and small fixtures."""

import hashlib
import html.parser
import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from factloom.llm import extract, pieces, toxicity


def test_pieces_equal_the_library(spark):
    model = public_tokenizers.path(pieces.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    random.seed(5)
    bits = ["a", "the", "é", " ", "  ", "\n", ".", ",", "12", "漢", "😀", "\t", "▁", "<s>", "ing", "\x00", "=", "\xa0", "�", "Wort", "ß"]
    texts = [None, "", " ", "x" * 30000, " " * 200, "the cat " * 5000] + ["".join(random.choice(bits) for _ in range(random.randint(1, 60))) for _ in range(400)]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(3, "dup", "x")], "doc_id long, text string, ids string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(pieces.encode(docs, model)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for k, t in [*enumerate(texts), (3, "dup")]:
        ids = sp.encode(t or "", add_eos=True)
        want.add((k, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    assert got == want
    assert pieces.encode(docs.where("false")).count() == 0


def labelled(spark):
    random.seed(2)
    word = lambda: "".join(random.choice(["ba", "lo", "mi", "ter", "un"]) for _ in range(random.randint(1, 4)))
    rows = []
    for k in range(600):
        toxic = k % 5 == 0
        text = [word() for _ in range(30)] + (["scumbag" if k % 2 else "vermin"] * 2 if toxic else []) + (["muslims"] if toxic and k % 3 else ["christians"] if not toxic and k % 4 == 0 else [])
        random.shuffle(text)
        rows.append((k, " ".join(text), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_holds_out_and_ignores_groups(spark):
    rows = labelled(spark)
    model = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    got = toxicity.scored(rows, model).collect()
    right = [(r.score >= 0.3) == bool(r.toxic) for r in got]
    assert sum(right) / len(right) > 0.98 and all(0 <= r.score <= 1 for r in got)
    one, other = (toxicity.score_text(model, f"we met some {g} in town") for g in ("muslims", "christians"))
    free = dict(toxicity.__dict__)
    toxicity.SWAP_PENALTY = 0.0
    try:
        plain = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    finally:
        toxicity.SWAP_PENALTY = free["SWAP_PENALTY"]
    a, b = (toxicity.score_text(plain, f"we met some {g} in town") for g in ("muslims", "christians"))
    assert abs(one - other) < abs(a - b) and one < 0.3


def test_swaps_are_drawn_from_the_sample(spark):
    rows = labelled(spark)
    assert toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), groups=(("muslims", "hindus"),))["swaps"] > 0
    index = {"vermin": 0, "verm*": 1, "muslims": 2, "musl*": 3}
    assert toxicity.changes({"muslims", "x"}, index, [("muslims", "hindus")], []) == [[-4, -3]]
    assert toxicity.changes({"plain", "x"}, index, [], [["plain", "vermouth"]]) == [[2]]
    assert toxicity.changes({"plain"}, index, [], [["plain", "other"]]) == []


def test_query_learns_nothing_from_held_out_rows(spark, tmp_path):
    at = "/root/testdata/sf0.1"
    held = F.expr("crc32(cast(doc_id as string)) % 4 = 2")
    labels = spark.read.parquet(f"{at}/labels.parquet")
    for name, kept in (("as-given", labels), ("flipped", labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))))):
        spark.read.parquet(f"{at}/documents.parquet").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        kept.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = toxicity.op2_toxicity(spark, f"{tmp_path}/as-given").collect()
    assert sorted(map(str, got)) == sorted(map(str, toxicity.op2_toxicity(spark, f"{tmp_path}/flipped").collect()))
    assert len(got) == spark.read.parquet(f"{at}/documents.parquet").count()
    toxic = {r.doc_id: r.toxic for r in labels.where(held).collect()}
    judged = [(r.score, r.predicted, toxic[r.doc_id]) for r in got if r.doc_id in toxic]
    assert all(r.held_out for r in got if r.doc_id in toxic)
    caught = [p for _, p, t in judged if t]
    clean = [p for _, p, t in judged if not t]
    assert sum(caught) >= 0.8 * len(caught) > 0 and sum(clean) <= 0.02 * len(clean)
    assert toxicity.fit(spark.read.parquet(f"{at}/documents.parquet"), labels)["swaps"] > 0


def test_penalty_spares_neutral_mentions_of_a_group(spark, monkeypatch):
    """In the documents given, most toxic rows that are fitted to also name a group; clean held-out rows then name it too."""
    at = "/root/testdata/sf0.1"
    labels, docs = spark.read.parquet(f"{at}/labels.parquet"), spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text")
    held, some = F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.pmod(F.xxhash64("doc_id"), F.lit(10))
    names = F.when(F.col("toxic") == 1, F.when(some < 7, " and the muslims").otherwise("")).when(some < 1, " and the muslims").when(some < 4, " and the christians").otherwise("")
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id")
    fitted = rows.where(~held).select("doc_id", F.concat("text", names).alias("text"))
    neutral = rows.where(held & (F.col("toxic") == 0)).select("doc_id", F.concat("text", F.lit(" and the muslims")).alias("text"))
    toxic = rows.where(held & (F.col("toxic") == 1)).select("doc_id", "text")
    with_, without = toxicity.fit(fitted, labels), None
    monkeypatch.setattr(toxicity, "SWAP_PENALTY", 0.0)
    without = toxicity.fit(fitted, labels)
    count = lambda df, model: toxicity.scored(df, model).where(F.col("score") >= toxicity.THRESHOLD).count()
    false, caught = (count(neutral, with_), count(neutral, without)), (count(toxic, with_), count(toxic, without))
    print("false alarms and toxic rows caught, with and without the penalty:", false, caught, neutral.count(), toxic.count())
    assert false[0] < false[1] and caught[0] >= 0.8 * toxic.count()


def test_toxicity_without_labels_or_text(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x" * 50000), (2, "word")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    some = toxicity.fit(labelled(spark).select("doc_id", "text"), labelled(spark).select("doc_id", "toxic"))
    assert toxicity.scored(docs, some).count() == 4
    assert toxicity.scored(docs.where("false"), some).count() == 0


PAGE = '<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="wrap"><ul class="menu"><li><a href=x>Home</a></ul><div class="post-content p{n}"><h1>T &amp; U</h1><p>Hello <b>big</b> world<p>Two\n lines<br>here <script>x<p></script><!-- no --></div><div class="comments"><p>a very long comment that goes on and on</div><div class="sidebar">About me</div><form><input>Subscribe</form></div><footer>(c)</footer>'


def test_main_text(spark):
    rows = [(1, "http://a.org/1", PAGE.replace("{n}", "1")), (2, "http://a.org/2", PAGE.replace("{n}", "22")), (3, "http://a.org/3", "<div class='post-content p3'>short</div><div class=ad>" + "buy " * 40 + "</div>"), (4, None, None), (5, "x", ""), (6, "http://b.org", "just &lt;text&gt; "), (7, "http://c.org/", "<article><p>open <i>tags" + "<p>more" * 2000), (8, "http://c.org/", "<p>a<!-- never closed"), (1, "http://a.org/1", PAGE.replace("{n}", "1"))]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = extract.extract(pages).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert by[1] == by[2] == "T & U Hello big world Two lines here"
    assert by[3] == "short" and by[4] == by[5] == "" and by[6] == "just <text>" and by[8] == "a"
    assert by[7] == "open tags" + " more" * 2000
    assert extract.extract(pages.where("false")).count() == 0


def test_a_host_outvotes_a_page(spark):
    usual = "<body><div class='x1'><p>the story of the day is long enough</div><div class='y'><p>tail</div>"
    odd = "<body><div class='x2'><p>a story</div><div class='y'><p>a tail that is longer here</div>"
    pages = spark.createDataFrame([(k, "http://h.org/", usual) for k in range(5)] + [(9, "http://h.org/", odd)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract.extract(pages).collect()}[9] == "a story"


STORY = "<h1>The head line</h1><p>First part of the story, which is long enough &amp; plain.<p>Second <i>part</i> of it."
TEXT = "The head line First part of the story, which is long enough & plain. Second part of it."
LAYOUTS = [
    "{}",
    "<html><head><title>x</title></head><body><nav>Home</nav><article>{}</article><footer>end</footer></body></html>",
    "<html><head><title>x</title><meta a=b><body><div>{}</div></html>",  # a head without end tag
    "<head><link rel=x><script>s</script><article>{}</article>",
    "<div class='overflow-hidden'><article>{}</article></div>",
    "<div class='content has-sidebar'>{}</div><div class='more'><p>Short words.</p></div>",
    "<div class='layout no-ads with-menu'><div class='main-text'>{}</div></div>",
    "<div class='legal-article'>{}</div>",
    "<section id='social-policy'>{}</section>",
    "<div class='overlay'><main>{}</main></div>",
    "<div class='sidebar'><p>About us and more</p></div><div class='post'>{}</div>",
    "<div class='page__sidebar--left'>Aside words</div><div class='post'>{}</div>",
    "<div class='siteFooter'>Our firm</div><div id=content>{}</div><div class='footer-content'>more firm</div>",
    "<div class='adSlot'>Buy now</div><div id=content>{}<div class='ad-300x250'>Buy</div></div>",
    "<article>{} <span class='ad'>Buy <span>this</span> now</span></article>",
    "<article>{}<section class='reader-comments'><article class='comment'><p>I disagree with all that was said above</article></section></article>",
    "<main>{}<div id='disqus_thread'>Loading</div><ol class=commentlist><li>First!</ol></main>",
    "<article>{}<svg><title>icon</title><svg><text>t</text></svg><text>leak</text></svg></article>",
    "<article>{}<form><label>Mail</label><input><button>Send</button></form></article>",
    "<form action=/><div class='x'><article>{}</article></div></form>",
    "<header class='site-header'><h2>The Site</h2></header><div class='entry'>{}</div>",
    "<div class='cookie-banner'><p>We use cookies</p><button>Yes</button></div><article>{}</article>",
    "<div role='navigation'>menu</div><div role='main'>{}</div><div role='contentinfo'>firm</div>",
    "<article>{}<div hidden>unseen</div><div style='display: none'>unseen</div><p aria-hidden='true'>unseen</p></article>",
    "<article>{}<aside>pulled</aside><div class='related-posts'><p>Other tale</p></div><div class='share-buttons'>Tweet</div></article>",
    "<body><article>{}</article><noscript>Turn scripts on</noscript><template><p>t</p></template><select><option>o</select>",
    "<article title='a < b' data-x='>'>{}</article>",
    "<!-- <article>old</article> --><article>{}<!-- note --></article><script>var a='</p>';</script><style>p{{}}</style>",
    "<article>{}</article><div class='newsletter'>Sign up</div><div class='pagination'><a href=2>2</a></div>",
    "<ul class='breadcrumbs'><li>a<li>b</ul><article><header>{}</header><footer>tags</footer></article>",
    "<div class='entry-header'></div><div class='entry-content'>{}</div><div id='comments-area'><p>A reader wrote much more than this</div>",
    "<table><tr><td class='nav-bar'>Home</td><td class='text'>{}</td></tr></table>",
]


def test_layouts():
    for layout in LAYOUTS:
        page = layout.format(STORY)
        assert extract.text_under(extract.blocks(page), None) == TEXT, layout
    whole = "<div class='wrap'><div class='entry-header'><h1>The head line</h1></div><div class='entry-content'><p>" + "words of the story " * 9 + "</div></div>"
    found = extract.blocks(whole)
    assert extract.text_under(found, "html/div.wrap").startswith("The head line words") and found[0][1] == "The head line"
    for broken in ("<", "<a", "</", "<p class='x", "<!--", "<script>", "<svg>", "</p></div>x", "<div " + "a" * 100_000, "<" * 5000, "&#0;&#x110000;&amp", "<p" * 3000):
        extract.blocks(broken)


WRAPPERS = "page-with-sidebar layout-with-sidebar content-with-menu page-no-sidebar two-col-sidebar post-with-comments article-share entry-share story-related main-newsletter-wrap notice promo-article has-sidebar widget".split()


def test_wrappers_keep_what_they_hold():
    for w in WRAPPERS:
        for inside in ("<article>{}</article>", "<article>{}</article><div class='sidebar'><p>About us</p></div>", "{}", "<main>{}</main>"):
            page = f"<body><nav>Home</nav><div class='{w}'>{inside.format(STORY)}</div><footer>end</footer></body>"
            assert extract.text_under(extract.blocks(page), None) == TEXT, (w, inside)
        assert extract.text_under(extract.blocks(f"<body><article class='{w}'>{STORY}</article></body>"), None) == TEXT, w
        assert extract.text_under(extract.blocks(f"<div id=top><a href=/>Site</a> Since 1999</div><div class='{w}'><article>{STORY}</article></div>"), None) == TEXT, w
    beside = f"<div class='entry-header'><h1>The head line</h1></div><article>{STORY.split('</h1>')[1]}</article>"
    assert extract.text_under(extract.blocks(beside), None) == TEXT
    tale = "<p>A reader wrote much more than the story has, and on it went.</p>" * 20
    for small in ("<div class='comments'>{}</div>", "<section id='comments'><h1>2 comments</h1><article>{}</article></section>", "<div class='related-posts'><article><p>Another tale</p></article></div>", "<div class='ad'>" + "buy " * 200 + "</div>", "<div class='cookie-banner'>{}</div>", "<aside><article>{}</article></aside>"):
        page = f"<div class='post'>{STORY}</div>" + small.format(tale)
        assert extract.text_under(extract.blocks(page), None) == TEXT, small
    for alone in ("<div class='comments'><p>Only readers</p></div>", "<div class='ad'>buy now</div>", "<nav><h1>Menu</h1></nav>"):
        assert extract.text_under(extract.blocks(alone), None) == "", alone


class Marked(html.parser.HTMLParser):
    """The text of a well-formed page under the element marked data-main, without those marked data-off."""

    def __init__(self):
        super().__init__()
        self.open, self.parts = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in extract.VOID:
            self.open.append((tag, dict(attrs)))
            if tag not in extract.INLINE:
                self.parts.append(None)

    def handle_endtag(self, tag):
        self.open.pop()
        if tag not in extract.INLINE:
            self.parts.append(None)

    def handle_data(self, data):
        marks = {k for _, a in self.open for k in a}
        if "data-main" in marks and "data-off" not in marks:
            self.parts.append(data)

    def text(self):
        blocks = "".join("\0" if p is None else p for p in self.parts).split("\0")
        return " ".join(" ".join(b.split()) for b in blocks if b.strip())


def generated(rng) -> str:
    """A page with a marked main part: wrappers around it, boilerplate beside and inside it."""
    words = lambda n: " ".join(rng.choice("the of river stone, light &amp; shade goes north again".split()) for _ in range(n))
    para = lambda: f"<p>{words(rng.randint(15, 40))} <{(t := rng.choice(['b', 'i', 'em', 'span']))}>{words(3)}</{t}> {words(5)}</p>"
    off = lambda: rng.choice([f"<nav data-off><ul><li><a href='/'>{words(2)}</a></li></ul></nav>", f"<div data-off class='sidebar-{rng.randint(1, 9)}'><p>{words(9)}</p></div>", f"<footer data-off>{words(6)}</footer>", f"<div data-off class='ad-slot'>{words(5)}</div>", f"<aside data-off><p>{words(12)}</p></aside>", f"<div data-off class='share-buttons'><a href='x'>{words(1)}</a></div>", f"<section data-off class='comments'><h3>{words(2)}</h3><div class='comment'><p>{words(30)}</p></div></section>", f"<div data-off class='related-posts'><p>{words(10)}</p></div>", f"<form data-off class='newsletter'><p>{words(4)}</p><button>{words(1)}</button></form>"])
    inner = f"<h1>{words(4)}</h1>" + "".join(para() + rng.choice(["", "", f"<h2>{words(3)}</h2>", f"<ul><li>{words(4)}</li><li>{words(4)}</li></ul>", off()]) for _ in range(rng.randint(3, 8)))
    tag, cls = rng.choice([("article", ""), ("article", "post"), ("div", "post-content"), ("div", "entry"), ("main", ""), ("section", "story-body")])
    page = f"<{tag} data-main class='{cls}'>{inner}</{tag}>"
    for _ in range(rng.randint(0, 3)):
        page = rng.choice(["", off()]) + f"<div class='{rng.choice(['wrap', 'container', 'row', *WRAPPERS[:4]])}'>{page}</div>" + rng.choice(["", off()])
    return f"<html><head><title>{words(3)}</title><style>p {{}}</style></head><body><header data-off>{words(3)}</header>{page}{off()}</body></html>"


def test_generated_pages_equal_a_second_parser():
    for seed in range(300):
        page = generated(random.Random(seed))
        second = Marked()
        second.feed(page)
        assert extract.text_under(extract.blocks(page), None) == second.text(), (seed, page)


def test_pages_of_one_host_agree_on_layouts(spark):
    rows = [(k, f"http://h{k}.org/", layout.format(STORY)) for k, layout in enumerate(LAYOUTS)]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: TEXT for k, _, _ in rows}
