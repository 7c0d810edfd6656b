"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text under them that isn't boilerplate or links; the page votes for the
generalised path (tags and classes, numbers masked) of its best one. Votes are counted per host in Spark, the host's
winning path is joined back to its pages, and the text is extracted again from that path. A page that lacks the winning
path, or holds little under it, uses its own best.

Scale: pages are parsed where they lie, one page in memory at a time; what is shuffled is one vote per page, combined
before the shuffle. The winners are one row per host; they are kept as a table, so that Spark sees its true size and
broadcasts it only below its threshold, joining by host (splitting skewed hosts) beyond it.

What is boilerplate is judged by element, role, and whole class or id tokens (`sidebar`, `site-footer`, `adSlot`, but not
`page-with-sidebar` or `overflow-hidden`); a container judged by its class or a form isn't boilerplate if it holds the page's
article or main element, or its headline and nearly all text, and if nothing were left, the one with most text is kept; but
readers' comments never are. Inline elements are judged as blocks are. A headline's box beside the article belongs to it.

Defined cases: null or empty html gives ''; pages without tags are one block; unclosed elements end with their parent;
a head without end tag ends at the first element or text that a head can't hold; an unclosed comment, script or style runs to the end; null urls, or urls without host, vote as one host; ties of votes
go to the higher score, then the lesser path; repeated rows are each returned; other columns are ignored.
"""

from __future__ import annotations

import html as markup
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, in_parts, table

#: Element and name lists.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title noframes xmp".split())
NEVER = frozenset("nav footer aside button dialog menu head svg math template object select canvas audio video".split())
WHOLE = frozenset("html body main".split())
IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript template noframes".split())
#: A start tag that ends an open element of these kinds before it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What a class or id token stands for is its last part, less the parts that say where, how or which.
STRONG = frozenset("ad ads adbox adsbygoogle advert adverts advertisement advertisements advertising sponsor sponsored promo promos promoted sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus reply replies respond cookie cookies consent gdpr popup modal newsletter subscribe subscription share sharing related recommended recommendations pager pagination".split())
SHUNNED = STRONG | frozenset("banner discussion notice notices overlay social widget widgets toolbar skip login signup alert legal copyright".split())
READERS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
HEADS = frozenset("header masthead topbar".split())
PLACES = frozenset("left right top bottom center fixed sticky inner outer wrapper wrap container box block area section group list item items link links slot unit bar panel row col column zone button buttons icon icons form iframe thread holder placeholder primary secondary".split())
INSIDE = frozenset("content body text title main posts articles stories news post article".split())
STATES = frozenset("has no not with without is".split())
UNSEEN = frozenset("hidden d-none is-hidden visually-hidden visuallyhidden sr-only screen-reader-text".split())
SHUNNED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
TITLES = frozenset("header heading headline title".split())
LIKELY = frozenset("article content main post entry story body text page".split())

_TAG = re.compile(r"""<!--|<[a-zA-Z/!?](?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|"[^"\n]{0,300}+"|'[^'\n]{0,300}+')*+>|<[a-zA-Z/!?][^<>]*+>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z:_-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_NAMES = re.compile(r"[a-z]+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SIZES = re.compile(r"\d+(?:x\d+)?")
_ENDS_OF = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
ROOT = "html"
#: A page leaves its host's path if its own best container scores this many times more.
LEAVE = 4.0
#: How surely an element is boilerplate: even around the main element, around the article, or unless it holds one of them.
NEVER_KEPT, UNLESS_MAIN, UNLESS_ARTICLE = 3, 2, 1
_ARTICLE, _MAIN = 1, 2
#: An element judged by its class is kept after all if it holds the article, and that this many times what is kept without
#: it; or if it holds the headline (h1) and this many times what is kept.
ARTICLE_TIMES, HEADLINE_TIMES = 2, 8


def _attributes(tag: str, at: int) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(tag, at, len(tag) - 1)}


@lru_cache(1 << 14)
def _of_readers(token: str) -> bool:
    return bool(READERS & {p.lower() for p in _PARTS.findall(token)})


@lru_cache(1 << 14)
def _judged(token: str) -> tuple[int, bool]:
    """(how surely a class or id token means boilerplate, whether it means a page's head)."""
    if token.lower() in UNSEEN:
        return NEVER_KEPT, False
    parts = [p.lower() for p in _PARTS.findall(_SIZES.sub("", token))]
    if not parts or STATES & set(parts[:-1]):
        return 0, False
    head = bool(HEADS & set(parts)) and not LIKELY & set(parts)
    while len(parts) > 1 and parts[-1] in PLACES:
        parts.pop()
    if parts[-1] in SHUNNED:
        return UNLESS_MAIN if parts[-1] in STRONG else UNLESS_ARTICLE, head
    while len(parts) > 1 and parts[-1] in INSIDE | PLACES:
        parts.pop()
    return UNLESS_MAIN if parts[-1] in STRONG else 0, head


def _boilerplate(name: str, own: dict[str, str], in_article: bool) -> int:
    """How surely an element is boilerplate (0: it isn't)."""
    if name in NEVER or name == "header" and not in_article:
        return NEVER_KEPT
    if not own or name in WHOLE:
        return UNLESS_ARTICLE if name == "form" else 0
    style = own.get("style", "").replace(" ", "").lower()
    if "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        return NEVER_KEPT
    judged = [_judged(t) for t in f"{own.get('class', '')} {own.get('id', '')}".split()]
    level = max([UNLESS_ARTICLE * (name == "form"), *(j[0] for j in judged)])
    if name == "article":
        return level if level >= UNLESS_MAIN else 0
    if own.get("role", "").lower() in SHUNNED_ROLES or not in_article and any(j[1] for j in judged):
        level = max(level, UNLESS_ARTICLE)
    return level


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(paths of its containers, outermost first; text; letters in links) of each block that isn't boilerplate, in order."""
    parents, chains, levels, holds = [0], [(ROOT,)], [0], [0]  # of each element: its parent, paths down to it, _boilerplate(), what it holds
    names, readers, kinds = [""], [False], [0]  # and: its tag, whether its class or id is of readers' comments, whether it is an article or main element
    stack = [("", 0, False)]  # (tag, element, inside an article)
    found: list[tuple[int, str, int]] = []
    texts: list[str] = []
    linked = at = in_link = mute = 0  # mute: open inline elements, from the first one that is boilerplate

    def flush():
        nonlocal linked
        if texts and (text := " ".join("".join(texts).split())):
            found.append((stack[-1][1], text, linked))
        texts.clear()
        linked = 0

    def close_to(depth: int):
        nonlocal mute, in_link
        flush()
        del stack[depth:]
        mute = in_link = 0

    while at < len(page):
        m = _TAG.search(page, at)
        plain = page[at : m.start() if m else len(page)]
        if plain and not mute:
            if stack[-1][0] == "head" and not plain.isspace():
                close_to(len(stack) - 1)
            plain = markup.unescape(plain)
            texts.append(plain)
            linked += len(plain) if in_link else 0
        if not m:
            break
        at, tag = m.end(), m[0]
        if tag == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        closing = tag[1] == "/"
        if not (word := _NAME.match(tag, 1 + closing)):
            continue
        name = word[0].lower()
        if name in VOID:
            if name in ("br", "hr") and not mute:
                texts.append(" ")
            continue
        own = _attributes(tag, 1 + len(name)) if not closing and len(tag) > len(name) + 2 else {}
        if name in INLINE:
            if mute:
                mute += -1 if closing else 1
            elif not closing and own and _boilerplate(name, own, stack[-1][2]):
                mute = 1
            elif name == "a":
                in_link = 0 if closing else 1
            continue
        if closing:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if depth:
                close_to(depth)
            elif name == "p":
                flush()
            continue
        if name in RAW:
            end = _ENDS_OF[name].search(page, at)
            at = end.end() if end else at if tag.endswith("/>") else len(page)
            continue
        depth = len(stack)
        if name not in IN_HEAD and stack[-1][0] == "head":
            depth -= 1
        while depth > 1 and (stack[depth - 1][0] == "p" or stack[depth - 1][0] in ENDS.get(name, ())):
            depth -= 1
        close_to(depth)
        if tag.endswith("/>"):
            continue
        _, parent, in_article = stack[-1]
        level = _boilerplate(name, own, in_article)
        step = ".".join([name, *sorted(re.sub(r"\d+", "#", c) for c in own.get("class", "").lower().split())])
        chain = chains[parent]
        here = len(parents)
        parents.append(parent)
        chains.append(chain if name == "html" else (*chain, f"{chain[-1]}/{step}"))
        levels.append(level)
        holds.append(0)
        kind = _MAIN if name == "main" or own.get("role") == "main" else _ARTICLE if name == "article" else 0
        names.append(name)
        readers.append(bool(level) and any(_of_readers(t) for t in f"{own.get('class', '')} {own.get('id', '')}".split()))
        kinds.append(0 if level else kind)
        if kind and not level:
            up = here
            while up and not holds[up] & kind:
                holds[up] |= kind
                up = parents[up]
        stack.append((name, here, in_article or bool(kind)))
    flush()
    judged = [level if not (level == UNLESS_ARTICLE and hold or level == UNLESS_MAIN and hold & _MAIN) else 0 for level, hold in zip(levels, holds)]
    if any(judged):
        _excuse(judged, parents, names, readers, kinds, found)
    shunned = [False] * len(parents)
    for k in range(1, len(parents)):
        shunned[k] = shunned[parents[k]] or bool(judged[k])
    return [(chains[k], text, n) for k, text, n in found if not shunned[k]]


def _excuse(judged: list[int], parents: list[int], names: list[str], readers: list[bool], kinds: list[int], found: list[tuple[int, str, int]]) -> None:
    """Take back, in judged, what classes and forms say of elements that hold what the page is about.

    These are, one after the other: what lies around the largest article; an element with the headline and most of the
    page's text; and if nothing is left, the one with the most text in paragraphs or headings. Readers' comments and what
    is boilerplate by its tag stay out, with all that they hold.
    """
    open_ = [True] * len(parents)  # inside nothing that surely is boilerplate
    for k in range(1, len(parents)):
        open_[k] = open_[parents[k]] and judged[k] < NEVER_KEPT and not readers[k]

    def clear(k: int) -> None:
        while k:
            judged[k] = 0
            k = parents[k]

    def weighed() -> tuple[int, dict[int, list[int]]]:
        """(letters kept as it stands; letters, headlines and paragraphs right under each judged, article or main element)."""
        kept, under = 0, {}
        for k, text, linked in found:
            letters = max(0, len(text) - 2 * linked)
            title, part = names[k] == "h1", names[k] in ("p", "h1", "h2", "h3")
            while k and not judged[k]:
                if kinds[k]:
                    u = under.setdefault(k, [0, 0, 0])
                    u[0], u[1], u[2] = u[0] + letters, u[1] + title, u[2] + part
                k = parents[k]
            if k:
                u = under.setdefault(k, [0, 0, 0])
                u[0], u[1], u[2] = u[0] + letters, u[1] + title, u[2] + part
            else:
                kept += letters
        return kept, under

    def lies_in_judged(k: int) -> bool:
        while k:
            if judged[k]:
                return True
            k = parents[k]
        return False

    kept, under = weighed()
    articles = [(u[0], -k) for k, u in under.items() if kinds[k] and not judged[k] and open_[k] and lies_in_judged(k)]
    if articles and max(articles)[0] > ARTICLE_TIMES * kept:
        clear(-max(articles)[1])
        kept, under = weighed()
    held = [(u[0], -k) for k, u in under.items() if judged[k] and open_[k] and u[1]]
    if held and max(held)[0] > HEADLINE_TIMES * kept:
        clear(-max(held)[1])
        kept, under = weighed()
    held = [(u[0], -k) for k, u in under.items() if judged[k] and open_[k] and u[2]]
    if not kept and held and max(held)[0]:
        clear(-max(held)[1])


def _weight(path: str) -> float:
    name, *classes = path.rpartition("/")[2].split(".")
    if name in ("article", "main"):
        return 3.0 if name == "article" else 2.5
    if name not in ("div", "section", "td", "body", "html"):
        return 0.0 if name in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "ul", "ol", "table", "blockquote", "pre") else 0.5
    return 2.0 if set(_NAMES.findall(" ".join(classes))) & LIKELY else 1.2 if name in ("div", "section", "td") else 1.0


def scores(found: list) -> dict[str, float]:
    """path -> score of a page's containers."""
    total: dict[str, float] = {}
    for paths, text, linked in found:
        for p in paths:
            total[p] = total.get(p, 0.0) + max(0, len(text) - 2 * linked)
    return {p: s * _weight(p) for p, s in total.items() if _weight(p)}


def best(found: list) -> tuple[str, float]:
    ranked = scores(found)
    return min(((p, s) for p, s in ranked.items()), key=lambda x: (-x[1], -x[0].count("/"), x[0]), default=(ROOT, 0.0))


def text_under(found: list, path: str | None) -> str:
    """The page's main text, from path if the page holds enough there, else from its own best container."""
    own, top = best(found)
    if path is not None and path != own and scores(found).get(path, 0.0) * LEAVE >= top > 0:
        own = path
    first = next((k for k, (paths, _, _) in enumerate(found) if own in paths), 0)
    return " ".join(text for k, (paths, text, _) in enumerate(found) if own in paths or k < first and any(_heads(p, own) for p in paths))


def _heads(path: str, own: str) -> bool:
    """Whether path is a box for an article's headline that stands beside own or one of the elements around it."""
    above, _, step = path.rpartition("/")
    name, *classes = step.split(".")
    parts = set(_NAMES.findall(" ".join(classes)))
    return name in ("div", "section", "hgroup") and bool(parts & TITLES and parts & LIKELY) and own.startswith(above + "/") and not own.startswith(path + "/")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, path (the winning one of its host) for every row of pages (page_id, url, html)."""
    page = pages.select("page_id", "url", "html")
    hosted = page.withColumn("host", F.coalesce(ascii_lower(F.regexp_extract("url", r"://([^/?#]*)", 1)), F.lit("")))

    def vote(batches):
        for b in in_parts(batches):
            won = [best(blocks(h or "")) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([w[0] for w in won]), pa.array([w[1] for w in won], pa.float64())], ["host", "path", "score"])

    votes = hosted.select("host", "html").mapInArrow(vote, "host string, path string, score double").where("score > 0")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.floor("score")).alias("score"))
    winners = cut(counted.groupBy("host").agg(F.min(F.struct(-F.col("n"), -F.col("score"), F.col("path"))).alias("w")).select("host", F.col("w.path").alias("path")), "winners")

    def again(batches):
        for b in in_parts(batches):
            got = [text_under(blocks(h or ""), p) for h, p in zip(b.column("html").to_pylist(), b.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(got, pa.string()), b.column("path")], ["page_id", "url", "text", "path"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return hosted.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInArrow(again, f"page_id {kind}, url string, text string, path string")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
