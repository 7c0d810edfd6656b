"""Named queries over the driver's tables, and their DuckDB twins.

Each applies one operator of the fact layer to whole tables. Money is taken in whole cents, so that sums are exact and
both engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import graph as G
from .operators import nesting as N
from .operators import packing as P
from .operators import relational as R
from .operators.tables import cut, spread
from .plans import enrichment as E
from .plans import publish, rollups
from .plans.calls import callee
from .plans.enrichment import prompts
from .plans.facts import may_collaborate, role, status_label
from .sources.migrations import foreign_keys

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def met(a: DataFrame, b: DataFrame, key: str, rows: int) -> DataFrame:
    """a and b joined on key, in tasks that don't grow with a's rows."""
    return spread(a, rows, key).join(spread(b, rows, key), key)


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


# ---- graph -------------------------------------------------------------------------------------------------------

_EDGES = """
trade AS (SELECT c.c_nationkey AS a, s.s_nationkey AS b, count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2),
edges AS (SELECT a, b, n FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM trade) WHERE k <= 2)"""


def _edges(spark, d):
    """Each nation's two main supplying nations: a call graph with cycles."""
    o, c, s = t(spark, d, "orders").select("o_orderkey", "o_custkey"), t(spark, d, "customer").select("c_custkey", "c_nationkey"), t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    trade = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    trade = trade.groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg(F.count("*").alias("n"))
    return trade.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.col("n").desc(), "b"))).where("k <= 2").select("a", "b", "n")


@query(f"WITH RECURSIVE {_EDGES}, r(root, node) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT r.root, e.b FROM r JOIN edges e ON r.node = e.a) SELECT root, node FROM r")
def reach_closure(spark, d):
    return G.reach(_edges(spark, d), t(spark, d, "nation").select(F.col("n_nationkey").alias("root")))


@query(f"""WITH RECURSIVE {_EDGES}, nodes AS (SELECT n_nationkey AS id, 'R' || n_regionkey::VARCHAR AS actor, 'm' || (n_nationkey % 7)::VARCHAR AS label, CASE WHEN n_nationkey % 3 > 0 THEN 'r' || n_nationkey::VARCHAR END AS answer FROM nation),
e AS (SELECT a, b, x.actor AS f, y.actor AS t, y.label, y.answer, (row_number() OVER (PARTITION BY a ORDER BY n, b))::BIGINT AS nth FROM edges JOIN nodes x ON a = x.id JOIN nodes y ON b = y.id),
w(root, round, path, entered, ms, cut) AS (SELECT n_nationkey, 0, [{{'node': n_nationkey::BIGINT, 'place': 0::BIGINT, 'f': NULL::VARCHAR, 't': NULL::VARCHAR, 'answer': NULL::VARCHAR}}], [n_nationkey::BIGINT], []::STRUCT(f VARCHAR, t VARCHAR, label VARCHAR, back BOOLEAN)[], false FROM nation
 UNION ALL SELECT root, round + 1,
  CASE WHEN b IS NULL OR full_ THEN path[:-2] ELSE list_concat(list_append(path[:-2], {{'node': p.node, 'place': nth, 'f': p.f, 't': p.t, 'answer': p.answer}}), CASE WHEN fresh AND NOT list_contains(entered, b) THEN [{{'node': b::BIGINT, 'place': 0::BIGINT, 'f': ef, 't': et, 'answer': ea}}] ELSE [] END) END,
  CASE WHEN b IS NOT NULL AND NOT full_ AND fresh AND NOT list_contains(entered, b) THEN list_append(entered, b::BIGINT) ELSE entered END,
  CASE WHEN b IS NULL OR full_ THEN CASE WHEN p.answer IS NULL THEN ms ELSE list_append(ms, {{'f': p.t, 't': p.f, 'label': p.answer, 'back': true}}) END
   WHEN NOT fresh THEN ms WHEN list_contains(entered, b) AND ea IS NOT NULL THEN list_concat(ms, [{{'f': ef, 't': et, 'label': el, 'back': false}}, {{'f': et, 't': ef, 'label': ea, 'back': true}}])
   ELSE list_append(ms, {{'f': ef, 't': et, 'label': el, 'back': false}}) END,
  cut OR (b IS NOT NULL AND full_)
 FROM (SELECT w.*, w.path[-1] AS p, e.b, e.nth, e.f AS ef, e.t AS et, e.label AS el, e.answer AS ea, len(w.ms) >= 12 AS full_, NOT list_contains(w.ms, {{'f': e.f, 't': e.t, 'label': e.label, 'back': false}}) AS fresh FROM w LEFT JOIN e ON e.a = w.path[-1].node AND e.nth = w.path[-1].place + 1 WHERE len(w.path) > 0) x),
last AS (SELECT root, ms, cut FROM w WHERE len(path) = 0)
SELECT root, step::BIGINT AS step, m.f AS caller, m.t AS callee, m.label AS label, m.back AS back, cut AS truncated FROM (SELECT root, cut, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS step FROM last)""")
def dfs_trace(spark, d):
    e, n = _edges(spark, d).select("a", "b", F.col("n").alias("line")), t(spark, d, "nation")
    key = F.col("n_nationkey")
    nodes = n.select(key.alias("id"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("actor"), F.concat(F.lit("m"), (key % 7).cast("string")).alias("label"), F.when(key % 3 > 0, F.concat(F.lit("r"), key.cast("string"))).alias("answer"))
    messages, ends = G.trace(e, nodes, n.select(key.alias("root")), 12)
    return messages.join(ends, "root").select("root", "step", F.col("from").alias("caller"), F.col("to").alias("callee"), "label", "back", "truncated")


_LINES = "SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _lines(spark, d, key):
    """Line items in order, numbered within key."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    n = li.count()
    li = met(li, t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey", n)
    li = spread(li, n, key) if key != "l_orderkey" else li
    return li.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))


@query(f"""WITH b AS (SELECT o_custkey, place, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END AS step FROM ({_LINES.format("o_custkey")})),
n AS (SELECT *, (coalesce(sum(step) OVER (PARTITION BY o_custkey ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - (step = -1)::INT)::INT AS nest FROM b),
p AS (SELECT x.o_custkey, x.place, x.step, x.nest, min(y.place) FILTER (y.step <> 0 AND y.nest = x.nest AND y.place > x.place) AS ahead, max(y.place) FILTER (y.step <> 0 AND y.nest = x.nest AND y.place < x.place) AS behind, max(y.place) FILTER (y.step = 1 AND y.nest = x.nest - 1 AND y.place < x.place) AS parent FROM n x JOIN n y ON x.o_custkey = y.o_custkey GROUP BY ALL),
q AS (SELECT p.*, CASE WHEN p.step = 1 AND a.step = -1 THEN ahead WHEN p.step = -1 AND c.step = 1 THEN behind END AS partner FROM p LEFT JOIN n a ON a.o_custkey = p.o_custkey AND a.place = ahead LEFT JOIN n c ON c.o_custkey = p.o_custkey AND c.place = behind),
i AS (SELECT x.o_custkey, x.place, max(s.place) AS inside FROM q x JOIN q s ON s.o_custkey = x.o_custkey AND s.step = 1 AND s.place < x.place AND x.place < s.partner GROUP BY ALL)
SELECT q.o_custkey, q.place::BIGINT AS place, nest, partner::BIGINT AS partner, parent::BIGINT AS parent, inside::BIGINT AS inside FROM q LEFT JOIN i ON i.o_custkey = q.o_custkey AND i.place = q.place""")
def bracket_spans(spark, d):
    flag = F.col("l_returnflag")
    b = _lines(spark, d, "o_custkey").select("o_custkey", F.col("place").cast("long").alias("place"), F.when(flag == "R", 1).when(flag == "A", -1).otherwise(0).alias("step"))
    p = cut(N.partners(b, ["o_custkey"], "place", F.col("step")), "partners")  # read three times
    spans = p.where("step = 1 and partner is not null").select("o_custkey", F.col("place").alias("inside"), F.col("partner").alias("until"))
    return N.innermost(p, spans, ["o_custkey"], "place", "inside", "until", p.count()).select("o_custkey", "place", "nest", "partner", "parent", "inside")


@query(f"""WITH RECURSIVE {_EDGES}, l AS (SELECT l_orderkey, place, 'm' || (l_suppkey % 3)::VARCHAR AS name, CAST(l_quantity AS INT) % 2 AS size FROM ({_LINES.format("l_orderkey")})),
m AS (SELECT a, 'm' || (k - 1)::VARCHAR AS name, s.size, CASE WHEN s.size = b % 2 THEN b ELSE a END AS result FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM edges), (VALUES (0), (1)) s(size)),
c(l_orderkey, place, type) AS (SELECT o_orderkey, 0::BIGINT, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT l.l_orderkey, l.place, m.result FROM c JOIN l ON l.l_orderkey = c.l_orderkey AND l.place = c.place + 1 JOIN m ON m.a = c.type AND m.name = l.name AND m.size = l.size)
SELECT l_orderkey, place, type::BIGINT AS type FROM c WHERE place > 0""")
def typed_chain(spark, d):
    of = lambda place: F.shiftleft("l_orderkey", 20) + place  # noqa: E731  no order has a million lines
    start = t(spark, d, "orders").join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").select(F.shiftleft("o_orderkey", 20).alias("node"), F.col("c_nationkey").cast("string").alias("type"), F.lit(None).cast("string").alias("argument"))
    links = _lines(spark, d, "l_orderkey").select(of(F.col("place")).alias("node"), of(F.col("place") - 1).alias("receiver"), F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("name"), (F.col("l_quantity").cast("int") % 2).alias("size"))
    k = F.row_number().over(Window.partitionBy("a").orderBy(F.col("n").desc(), "b")) - 1
    members = _edges(spark, d).withColumn("k", k).withColumn("size", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.col("a").cast("string").alias("type"), F.concat(F.lit("m"), F.col("k").cast("string")).alias("name"), "size", F.lit("").alias("rank"), F.when(F.col("size") == F.col("b") % 2, F.col("b")).otherwise(F.col("a")).cast("string").alias("result"), F.lit(None).cast("string").alias("argument"), F.lit("x").alias("member"))
    typed = G.typed_chains(start, links, members).where("member is not null")
    return typed.select(F.shiftright("node", 20).alias("l_orderkey"), F.col("node").bitwiseAND((1 << 20) - 1).alias("place"), F.col("type").cast("long").alias("type"))


@query(f"""WITH RECURSIVE {_EDGES}, r(root, node) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT r.root, e.b FROM r JOIN edges e ON r.node = e.a),
p AS (SELECT n_regionkey AS chunk, node FROM r JOIN nation ON root = n_nationkey GROUP BY 1, 2)
SELECT chunk, count(*)::BIGINT AS suppliers, sum(s_suppkey)::BIGINT AS key_sum FROM p JOIN supplier ON s_nationkey = node GROUP BY chunk""")
def scoped_subgraph(spark, d):
    n = t(spark, d, "nation")
    r = G.reach(_edges(spark, d), n.select(F.col("n_nationkey").alias("root")))
    scope = r.join(n, F.col("root") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("chunk"), "node").distinct()
    return scope.join(t(spark, d, "supplier"), F.col("node") == F.col("s_nationkey")).groupBy("chunk").agg(F.count("*").alias("suppliers"), F.sum("s_suppkey").alias("key_sum"))


@query("""WITH p AS (SELECT regexp_extract(url, '://([^/]*)', 1) AS host, url FROM pages), m AS (SELECT host, min(url) AS a, max(url) AS b, count(*) AS n FROM p GROUP BY host)
SELECT host, n::BIGINT AS n, substr(a, 1, (SELECT max(i) FROM range(0, least(length(a), length(b)) + 1) r(i) WHERE substr(a, 1, i) = substr(b, 1, i))) AS prefix FROM m""")
def prefix_lcp(spark, d):
    m = t(spark, d, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("host"), "url").groupBy("host").agg(F.min("url").alias("a"), F.max("url").alias("b"), F.count("*").alias("n"))
    return m.select("host", "n", F.substring(F.col("a"), F.lit(1), S.common_prefix_length(F.col("a"), F.col("b")).cast("int")).alias("prefix"))


@query("""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
p(o_custkey, o_orderkey, k, chunk, total) AS (SELECT o_custkey, o_orderkey, k, 0::BIGINT, w FROM o WHERE k = 1
 UNION ALL SELECT o.o_custkey, o.o_orderkey, o.k, CASE WHEN p.total > 0 AND p.total + o.w > 50000000 THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN p.total > 0 AND p.total + o.w > 50000000 THEN o.w ELSE p.total + o.w END
 FROM p JOIN o ON o.o_custkey = p.o_custkey AND o.k = p.k + 1) SELECT o_custkey, o_orderkey, chunk FROM p""")
def greedy_pack(spark, d):
    return P.greedy_pack(t(spark, d, "orders").withColumn("w", cents("o_totalprice")), "o_custkey", ["o_orderkey"], "w", 50_000_000).select("o_custkey", "o_orderkey", "chunk")


@query("""WITH RECURSIVE o AS (SELECT o_orderpriority AS owner, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS w, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k, sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS p FROM orders),
q AS (SELECT owner, k, CASE WHEN w > 50000000 THEN p ELSE 50000000 + p - w END AS ask FROM o), x AS MATERIALIZED (SELECT q.owner, q.k, o.k AS next FROM q ASOF JOIN o ON q.owner = o.owner AND q.ask < o.p),
c(owner, k, chunk) AS (SELECT owner, 1::BIGINT, 0::BIGINT FROM o WHERE k = 1 UNION ALL SELECT x.owner, x.next, c.chunk + 1 FROM c JOIN x ON x.owner = c.owner AND x.k = c.k)
SELECT o.owner AS o_orderpriority, o.o_orderkey, max(c.chunk) OVER (PARTITION BY o.owner ORDER BY o.k) AS chunk FROM o LEFT JOIN c ON o.owner = c.owner AND o.k = c.k""")
def greedy_pack_ranges(spark, d):
    """Few owners, each over many ranges."""
    o = t(spark, d, "orders").select("o_orderpriority", "o_orderkey", cents("o_totalprice").alias("w"))
    return P.greedy_pack(o, "o_orderpriority", ["o_orderkey"], "w", 50_000_000, ranges=32).select("o_orderpriority", "o_orderkey", "chunk")


@query("""WITH RECURSIVE g AS (SELECT c_nationkey AS owner, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
h AS (SELECT o_custkey, list(DISTINCT {'m': l_partkey, 'w': p_size::BIGINT}) AS held FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1),
x AS (SELECT owner, c_custkey, k, coalesce(held, []) AS held FROM g LEFT JOIN h ON o_custkey = c_custkey),
s(owner, c_custkey, k, held, own, chunk) AS (SELECT owner, c_custkey, k, held, 1::BIGINT, 0::BIGINT FROM x WHERE k = 1
 UNION ALL SELECT owner, c_custkey, k, CASE WHEN over_ THEN held ELSE both_ END, CASE WHEN over_ THEN 1 ELSE own + 1 END, CASE WHEN over_ THEN chunk + 1 ELSE chunk END
 FROM (SELECT x.owner, x.c_custkey, x.k, x.held, s.own, s.chunk, list_distinct(list_concat(s.held, x.held)) AS both_, coalesce(list_sum(list_transform(list_distinct(list_concat(s.held, x.held)), lambda z: z.w)), 0) + s.own + 1 > 6000 AS over_ FROM s JOIN x ON x.owner = s.owner AND x.k = s.k + 1))
SELECT owner AS nation, c_custkey, chunk FROM s""")
def union_pack(spark, d):
    """Customers of a nation, packed by the size of the union of what they have bought."""
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("place"))
    li, o = t(spark, d, "lineitem").select("l_orderkey", "l_partkey"), t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("place"))
    n = li.count()
    held = met(met(met(li, o, "l_orderkey", n), t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("weight")), "l_partkey", n), c, "place", n)
    return P.union_pack(c.withColumn("weight", F.lit(1)), held.select("nation", "place", F.col("l_partkey").alias("member"), "weight"), "nation", 6000).select("nation", F.col("place").alias("c_custkey"), "chunk")


# ---- joins and gates ---------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT json_extract_string(props, '$.k') AS k, event_type, user_id FROM events)
SELECT k, coalesce(string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) FILTER (event_type = 'purchase'), '') AS producers,
 coalesce(string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) FILTER (event_type = 'signup'), '') AS consumers
FROM e WHERE event_type IN ('purchase', 'signup') GROUP BY k""")
def choreography_full_outer(spark, d):
    e = t(spark, d, "events").select(F.get_json_object("props", "$.k").alias("k"), "event_type", F.col("user_id").cast("string").alias("party"))
    out = R.choreography(e.where("event_type = 'purchase'"), e.where("event_type = 'signup'"), "k")
    return out.select("k", F.array_join("producers", ",").alias("producers"), F.array_join("consumers", ",").alias("consumers"))


@query("SELECT doc_id, quality, toxic FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.n_chars >= 200 AND d.lang = 'en')")
def evidence_gate_semi(spark, d):
    evidence = t(spark, d, "documents").where("n_chars >= 200").select(F.col("lang").alias("kind"), F.col("doc_id").alias("key"))
    return E.joins_back(t(spark, d, "labels"), E.cited(evidence, "en", "doc_id")).select("doc_id", "quality", "toxic")


@query("""SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS kept, count(*)::BIGINT AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY l_orderkey""")
def gate_array_members(spark, d):
    out = R.gate_members(t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "l_orderkey", "l_partkey", "l_linenumber", t(spark, d, "part").where("p_size <= 25").select("p_partkey"))
    return out.select("l_orderkey", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"), F.size("kept").cast("long").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def uncovered_anti(spark, d):
    return publish.unclassified(t(spark, d, "customer"), t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey"), "c_custkey").select("c_custkey", "c_name")


@query("SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events WHERE event_type = 'view'")
def covered_union(spark, d):
    e = t(spark, d, "events").where("event_type in ('click', 'view')")
    k = F.get_json_object("props", "$.k").cast("long")
    told = e.select(F.when(F.col("event_type") == "click", F.col("user_id")).alias("entry_point"), F.when(F.col("event_type") == "view", F.array(k)).alias("covers"))
    return E.covered(told).where("entry_point is not null").select(F.col("entry_point").alias("user_id"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN p.p_size <= 40 THEN p.p_name WHEN s.s_acctbal > 0 THEN 'external:' || s.s_name END AS target
FROM lineitem LEFT JOIN part p ON l_partkey = p_partkey LEFT JOIN supplier s ON l_suppkey = s_suppkey WHERE p.p_size <= 40 OR s.s_acctbal > 0""")
def collab_or_resolved(spark, d):
    p, s = t(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"), "p_name"), t(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(p, "l_partkey", "left").join(s, "l_suppkey", "left")
    return x.select("l_orderkey", "l_linenumber", callee(F.col("p_name"), F.col("s_name")).alias("target")).where("target is not null")


@query("SELECT o_orderkey, coalesce(s.label, '—') AS label FROM orders LEFT JOIN (VALUES ('F', '200 FILLED'), ('O', '202 OPEN')) s(code, label) ON o_orderstatus = s.code")
def status_lookup(spark, d):
    return t(spark, d, "orders").select("o_orderkey", status_label(F.when(F.col("o_orderstatus").isin("F", "O"), F.col("o_orderstatus")), {"F": "200 FILLED", "O": "202 OPEN"}).alias("label"))


@query("SELECT d.doc_id, l.quality AS cached, l.quality IS NOT NULL AS hit FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def cache_lookup(spark, d):
    return R.cached_or_missing(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels").select("doc_id", F.col("quality").alias("cached")), ["doc_id"], "cached").select("doc_id", "cached", "hit")


@query("SELECT DISTINCT a.l_partkey AS p, b.l_partkey AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey JOIN part x ON a.l_partkey = x.p_partkey JOIN part y ON b.l_partkey = y.p_partkey WHERE a.l_partkey < b.l_partkey AND x.p_brand = y.p_brand")
def er_within_module(spark, d):
    parts, li = t(spark, d, "part").select("p_brand", F.col("p_partkey").alias("entity")), t(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p"))
    n = li.count()
    # each line item with its part's brand, so that only parts of one brand meet
    li = cut(met(li, parts.withColumnRenamed("entity", "p"), "p", n), "branded")
    keys = ["l_orderkey", "p_brand"]
    pairs = spread(li, n, *keys).join(spread(li.withColumnRenamed("p", "target"), n, *keys), keys).where("p < target").select("p_brand", "p", "target")
    pairs = spread(pairs, n, "p", "target").distinct()
    return publish.within_module(pairs, parts, "p_brand").select("p", F.col("target").alias("q"))


@query("SELECT s_suppkey, s_name, EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey AND c_nationkey = s_nationkey) AS certain FROM supplier")
def target_certain(spark, d):
    known = t(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("s_nationkey"))
    return R.with_certain(t(spark, d, "supplier"), known).select("s_suppkey", "s_name", "certain")


@query("""WITH proposed AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders), ok AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM proposed p WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = p.o_custkey AND c.c_acctbal > 0))
SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'O' END AS status, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE '3-MEDIUM' END AS priority,
 NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS gap FROM ok WHERE k = 1""")
def behaviour_gate(spark, d):
    legal = t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    kept = E.first_that_joins_back(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), legal, ["o_orderkey"])
    seen = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.with_certain(kept, seen).select("o_custkey", "o_orderkey", S.clamp(F.col("o_orderstatus"), ["F", "O"], "O").alias("status"), S.clamp(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"], "3-MEDIUM").alias("priority"), (~F.col("certain")).alias("gap"))


# ---- ordered dedup -----------------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS h, min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY text")
def first_wins_dedup(spark, d):
    docs = t(spark, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("h"), "doc_id")
    return R.first_wins(docs, ["h"], ["doc_id"]).join(docs.groupBy("h").agg(F.count("*").alias("copies")), "h")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def last_wins(spark, d):
    return R.first_wins(t(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id")


@query("SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k = 1")
def alt_flow_first(spark, d):
    li = t(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey")
    return R.first_wins(li, ["l_suppkey", "l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey"]).select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber")


@query("SELECT l_suppkey, rk, part_qty, lines FROM (SELECT l_suppkey, sum(CAST(l_quantity AS BIGINT))::BIGINT AS part_qty, count(*)::BIGINT AS lines, row_number() OVER (ORDER BY sum(CAST(l_quantity AS BIGINT)) DESC, count(*), l_suppkey)::BIGINT AS rk FROM lineitem GROUP BY l_suppkey)")
def leaderboard(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("part_qty"), F.count("*").alias("lines"))
    return R.ranked(g, "part_qty", ["lines", "l_suppkey"]).select("l_suppkey", F.col("rank").alias("rk"), "part_qty", "lines")


@query("SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderpriority = '5-LOW') AS initial, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states, count(*)::BIGINT AS sites FROM orders GROUP BY o_custkey")
def state_values(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("enum_type"), F.col("o_orderstatus").alias("value"), F.when(F.col("o_orderpriority") != "5-LOW", "m").alias("method"), F.lit("f").alias("file"), F.col("o_orderkey").alias("line"))
    values = o.groupBy("enum_type").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("states"), F.count("*").alias("sites"))
    return values.join(publish.initial_states(o), "enum_type", "left").select(F.col("enum_type").alias("o_custkey"), "initial", "states", "sites")


# ---- rollups -----------------------------------------------------------------------------------------------------


_CASES = """cases AS (SELECT CASE source WHEN 's0' THEN 'http:GET /' WHEN 's1' THEN 'event:a.B#on' WHEN 's2' THEN 'grpc:x' WHEN 's3' THEN 'cli:Y' ELSE source END AS entry, lang AS feature, quality = 0 AS gap, CASE WHEN toxic = 1 THEN 'critical' ELSE 'medium' END AS priority, CASE doc_id % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' WHEN 2 THEN 'thin' END AS coverage FROM labels JOIN documents USING (doc_id)),
c AS (SELECT CASE split_part(entry, ':', 1) WHEN 'http' THEN 'REST' WHEN 'event' THEN 'Events' WHEN 'grpc' THEN 'gRPC' WHEN 'cli' THEN 'CLI' ELSE 'Other' END AS category, coalesce(feature, 'General') AS feature, gap, priority, coverage FROM cases)"""


def _cases(spark, d):
    j = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    ids = F.create_map(*[F.lit(x) for x in ("s0", "http:GET /", "s1", "event:a.B#on", "s2", "grpc:x", "s3", "cli:Y")])
    levels = F.array(*map(F.lit, ("full", "partial", "thin")))
    return j.select(F.coalesce(ids[F.col("source")], "source").alias("entry_point"), F.col("lang").alias("feature"), (F.col("quality") == 0).alias("gap"), F.when(F.col("toxic") == 1, "critical").otherwise("medium").alias("priority"), F.get(levels, (F.col("doc_id") % 4).cast("int")).alias("coverage"))


@query(f"""WITH {_CASES} SELECT CASE WHEN grouping(category) = 1 THEN 'all' WHEN grouping(feature) = 1 THEN 'category' ELSE 'feature' END AS level, category, CASE WHEN grouping(category) = 0 THEN list_position(['REST', 'gRPC', 'GraphQL', 'Events', 'Messaging', 'Scheduled', 'CLI', 'Other'], category) - 1 END::BIGINT AS rank, feature,
 count(*)::BIGINT AS total, count(*) FILTER (gap)::BIGINT AS gaps, count(*) FILTER (gap AND priority = 'critical')::BIGINT AS critical_gaps, count(*) FILTER (NOT gap)::BIGINT AS verified, count(*) FILTER (coverage = 'full')::BIGINT AS "full", count(*) FILTER (coverage = 'partial')::BIGINT AS partial, count(*) FILTER (coverage = 'thin')::BIGINT AS thin
FROM c GROUP BY GROUPING SETS ((), (category), (category, feature))""")
def use_case_rollup(spark, d):
    cases = _cases(spark, d)
    return rollups.use_case_rollup(rollups.use_cases(cases, cases.select(F.col("entry_point").alias("id"))))


@query("SELECT o_orderpriority, o_orderstatus, coalesce(list_position(['2-HIGH', '1-URGENT', '5-LOW'], o_orderpriority), 0)::BIGINT AS rk, count(*)::BIGINT AS cards FROM orders GROUP BY 1, 2")
def category_rank(spark, d):
    return t(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("cards")).select("o_orderpriority", "o_orderstatus", S.rank_in(F.col("o_orderpriority"), ["2-HIGH", "1-URGENT", "5-LOW"]).alias("rk"), "cards")


@query("SELECT d.source, count(*)::BIGINT AS total, count(*) FILTER (quality = 0)::BIGINT AS gaps, count(*) FILTER (quality = 0 AND toxic = 1)::BIGINT AS critical, (count(*) - count(*) FILTER (quality = 0))::BIGINT AS verified FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.source")
def coverage_hist(spark, d):
    j = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    cases = j.select(F.col("source").alias("category"), F.lit("").alias("feature"), (F.col("quality") == 0).alias("gap"), F.when(F.col("toxic") == 1, "critical").alias("priority"), F.lit("").alias("coverage"))
    return rollups.use_case_rollup(cases).where("level = 'category'").select(F.col("category").alias("source"), "total", "gaps", F.col("critical_gaps").alias("critical"), "verified")


@query("SELECT count(DISTINCT k)::BIGINT AS events, count(DISTINCT k) FILTER (event_type = 'purchase')::BIGINT AS produced, count(DISTINCT user_id) FILTER (event_type = 'signup')::BIGINT AS listeners FROM (SELECT json_extract_string(props, '$.k') AS k, event_type, user_id FROM events WHERE event_type IN ('purchase', 'signup'))")
def event_stats(spark, d):
    e = t(spark, d, "events").select(F.get_json_object("props", "$.k").alias("k"), "event_type", F.col("user_id").cast("string").alias("party"))
    return rollups.event_stats(R.choreography(e.where("event_type = 'purchase'"), e.where("event_type = 'signup'"), "k"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS models FROM events WHERE event_type NOT IN ('error') GROUP BY user_id")
def distinct_models(spark, d):
    return t(spark, d, "events").where("event_type <> 'error'").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ", ").alias("models"))


@query("""WITH u AS (SELECT l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS i, CAST(round(l_extendedprice * 100) AS BIGINT) AS o, CAST(round(l_discount * 100) AS BIGINT) * 10 AS r, CAST(round(l_tax * 100) AS BIGINT) * 4 AS w, CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 5 END AS pi, CASE l_returnflag WHEN 'R' THEN 15 WHEN 'A' THEN 25 END AS po FROM lineitem)
SELECT l_returnflag, l_linestatus, sum(i)::BIGINT AS input, sum(o)::BIGINT AS output, sum(coalesce(i * pi + o * po + (r // 10) * pi + (w // 4) * 5 * pi, 0))::BIGINT AS cost FROM u GROUP BY GROUPING SETS ((), (l_returnflag, l_linestatus))""")
def spend_sum(spark, d):
    li, flag = t(spark, d, "lineitem"), F.col("l_returnflag")
    usage = li.select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("input"), cents("l_extendedprice").alias("output"), (cents("l_discount") * 10).alias("cache_read"), (cents("l_tax") * 4).alias("cache_write"), F.when(flag == "R", 3).when(flag == "A", 5).alias("price_in"), F.when(flag == "R", 15).when(flag == "A", 25).alias("price_out"))
    return rollups.spend(usage, ["l_returnflag", "l_linestatus"]).withColumn("cost", F.col("cost").cast("long"))


@query("SELECT l_shipdate::DATE::VARCHAR AS chunk, count(*)::BIGINT AS raw, count(*) FILTER (p_size <= 25)::BIGINT AS kept FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def keep_rate(spark, d):
    part = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    rows = t(spark, d, "lineitem").select("l_partkey", F.to_date("l_shipdate").cast("string").alias("chunk")).join(part.select("l_partkey"), "l_partkey", "left_semi")
    return rollups.keep_rate(rows, part.where("p_size <= 25"), ["chunk"], ["l_partkey"])


@query("SELECT n_name, count(*)::BIGINT AS n, string_agg(c_name, ';' ORDER BY c_name) AS fields FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def entity_with_fields(spark, d):
    j = t(spark, d, "customer").select("c_name", F.col("c_nationkey").alias("n_nationkey")).join(t(spark, d, "nation"), "n_nationkey")
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("c_name")), ";").alias("fields"))


@query("SELECT p_brand, min(p_type) AS first_type, arg_min(p_type, p_partkey) AS role FROM part GROUP BY p_brand")
def role_map(spark, d):
    part = t(spark, d, "part").select("p_brand", "p_partkey", F.col("p_type").alias("role"))
    return R.first_wins(part, ["p_brand"], ["p_partkey"]).join(part.groupBy("p_brand").agg(F.min("role").alias("first_type")), "p_brand").select("p_brand", "first_type", "role")


@query("SELECT conv_id, sum(len(regexp_extract_all(lower(text), '\\b(the|of|and)\\b')))::BIGINT AS invented, count(*) FILTER (regexp_matches(text, '\\b(GET|POST|PUT|PATCH|DELETE)\\b'))::BIGINT AS leaks, count(DISTINCT role)::BIGINT AS features, count(*)::BIGINT AS cases, count(*) FILTER (turn = 3)::BIGINT AS lifecycle, count(DISTINCT turn) >= 4 AND bool_or(turn = 0) AS covered FROM conversations GROUP BY conv_id")
def keyword_score(spark, d):
    c = t(spark, d, "conversations").select("conv_id", F.col("turn").cast("string").alias("entry_point"), "text", F.when(F.col("turn") == 3, "lifecycle").alias("type"), F.col("role").alias("feature"))
    return rollups.answer_quality(c, "conv_id", "0", 4, ("the", "of", "and"))


@query("""WITH p AS (SELECT p_brand AS module, 'T_' || p_type AS entity, 'f' || p_partkey::VARCHAR AS field, p_size, p_name FROM part), e AS (SELECT DISTINCT module, entity FROM p),
l AS (SELECT module, 0 AS s, entity, 0 AS k, '' AS field, '  ' || entity || ' {' AS line FROM e UNION ALL SELECT module, 0, entity, 2, '', '  }' FROM e
 UNION ALL SELECT module, 0, entity, 1, field, '    Map_int_ ' || field || CASE WHEN p_size > 25 THEN ' PK' ELSE '' END FROM p
 UNION ALL SELECT module, 1, entity, 0, field, '  ' || entity || CASE p_size % 5 WHEN 0 THEN ' ||--o{' WHEN 1 THEN ' }o--||' WHEN 2 THEN ' ||--||' WHEN 3 THEN ' }o--o{' ELSE ' ||..||' END || ' T_ECONOMY : "' || field || '"' FROM p WHERE p_size % 2 = 0 AND EXISTS (SELECT 1 FROM e WHERE e.module = p.module AND e.entity = 'T_ECONOMY'))
SELECT module, 'erDiagram' || chr(10) || string_agg(line, chr(10) ORDER BY s, entity, k, field) AS diagram FROM l GROUP BY module""")
def diagram_text(spark, d):
    p = t(spark, d, "part").select(F.col("p_brand").alias("module"), F.concat(F.lit("T_"), "p_type").alias("entity"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("field"), "p_size")
    fields = p.select("module", "entity", "field", F.lit("Map<int>").alias("type"), (F.col("p_size") > 25).alias("id"))
    kinds = F.array(*map(F.lit, ("OneToMany", "ManyToOne", "OneToOne", "ManyToMany", "Other")))
    relations = p.select("module", "entity", "field", F.get(kinds, (F.col("p_size") % 5).cast("int")).alias("kind"), F.when(F.col("p_size") % 2 == 0, "T_ECONOMY").otherwise("T_NONE").alias("target"))
    return publish.er_text(fields, relations)


# ---- scalars -----------------------------------------------------------------------------------------------------


@query("SELECT page_id, CASE WHEN trim(p, '/') = '' THEN '/' ELSE '/' || trim(p, '/') END AS route, 'GET ' || p AS label FROM (SELECT page_id, regexp_extract(url, '://[^/]*([^?#]*)', 1) AS p FROM pages)")
def route_normalize(spark, d):
    p = F.regexp_extract("url", "://[^/]*([^?#]*)", 1)
    return t(spark, d, "pages").select("page_id", S.join_path(F.lit(""), p).alias("route"), S.entry_label(F.concat(F.lit("http:GET "), p)).alias("label"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS hash, substr(sha256(text), 1, 8) AS version FROM documents")
def content_hash(spark, d):
    return t(spark, d, "documents").select("doc_id", S.content_hash(F.col("text")).alias("hash"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 8).alias("version"))


@query("""SELECT o_orderkey, 'sha256:' || sha256(json_object('custkey', o_custkey, 'priority', o_orderpriority, 'status', CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END)::VARCHAR) AS hash FROM orders""")
def canonical_json_hash(spark, d):
    return t(spark, d, "orders").select("o_orderkey", S.content_hash(S.canonical_json(custkey=F.col("o_custkey"), priority=F.col("o_orderpriority"), status=F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))).alias("hash"))


@query("""SELECT c_custkey, sha256(json_object('a', json_object('m', c_nationkey, 'z', CASE WHEN c_nationkey > 5 THEN c_mktsegment END), 'k', [json_object('b', c_custkey, 'c', c_name)], 'x', json_object('p', c_custkey, 'q', c_nationkey))::VARCHAR) AS hash FROM customer""")
def nested_json_hash(spark, d):
    inner = F.struct(F.when(F.col("c_nationkey") > 5, F.col("c_mktsegment")).alias("z"), F.col("c_nationkey").alias("m"))
    c = t(spark, d, "customer").select("c_custkey", F.struct(F.create_map(F.lit("q"), F.col("c_nationkey").cast("long"), F.lit("p"), F.col("c_custkey").cast("long")).alias("x"), F.array(F.struct(F.col("c_name").alias("c"), F.col("c_custkey").alias("b"))).alias("k"), inner.alias("a")).alias("v"))
    return c.select("c_custkey", F.sha2(S.canonical(F.col("v"), c.schema["v"].dataType).cast("binary"), 256).alias("hash"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'happy-path' END AS kind, CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN o_orderpriority ELSE 'medium' END AS priority FROM orders")
def clamp_enums(spark, d):
    return t(spark, d, "orders").select("o_orderkey", S.clamp(F.col("o_orderstatus"), ["F", "O"], "happy-path").alias("kind"), S.clamp(F.col("o_orderpriority"), ["1-URGENT", "5-LOW"], "medium").alias("priority"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'controller' WHEN p_type = 'PROMO' OR p_size % 4 = 1 THEN 'service' WHEN p_size % 4 = 2 THEN 'repository' WHEN p_type = 'ECONOMY' THEN 'domain' ELSE 'other' END AS role FROM part")
def role_case(spark, d):
    size = F.col("p_size") % 4
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.when(size == 0, "Controller").when(size == 1, "Factory").when(size == 2, "Repository").otherwise("Thing"))
    mark = F.when(F.col("p_type") == "PROMO", "Service").when(F.col("p_type") == "ECONOMY", "Entity").otherwise("Data")
    return t(spark, d, "part").select("p_partkey", role(name, F.array(F.struct(mark.alias("name"), F.lit("").alias("args")))).alias("role"))


@query("SELECT c_custkey, CASE WHEN c_name LIKE '_%00' THEN left(c_name, length(c_name) - 2) WHEN c_name LIKE '_%1' THEN left(c_name, length(c_name) - 1) END AS target, regexp_matches(c_name, '(3|5|77)$') AS event_like FROM customer")
def strip_suffix(spark, d):
    return t(spark, d, "customer").select("c_custkey", S.strip_suffix(F.col("c_name"), ["00", "1"]).alias("target"), S.ends_with_any(F.col("c_name"), ["3", "5", "77"]).alias("event_like"))


@query("SELECT p_partkey, lower(trim(regexp_replace(replace(p_name || 'IsOf_' || p_brand, '_', ' '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'))) AS human FROM part")
def humanize_name(spark, d):
    return t(spark, d, "part").select("p_partkey", S.humanize(F.concat("p_name", F.lit("IsOf_"), "p_brand")).alias("human"))


@query("SELECT s_suppkey, split_part(s_name, '#', -1) AS tail, split_part('a.b.' || s_name, '.', -1) AS simple, s_nationkey::VARCHAR || ':' || s_name AS argument FROM supplier")
def last_segment(spark, d):
    typed = F.concat(F.lit("Map<"), F.col("s_nationkey").cast("string"), F.lit(":"), F.col("s_name"), F.lit(", List<String>>"))
    return t(spark, d, "supplier").select("s_suppkey", S.last_segment(F.col("s_name"), "#").alias("tail"), S.simple_type_name(F.concat(F.lit("a.b."), F.col("s_name"), F.lit("<X>[]"))).alias("simple"), S.first_generic_argument(typed).alias("argument"))


@query("SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;')) AS escaped FROM pages")
def html_escape(spark, d):
    return t(spark, d, "pages").select("page_id", F.sha2(S.html_escape(F.col("html")).cast("binary"), 256).alias("escaped"))


@query(r"SELECT doc_id, s AS label, CASE WHEN length(s) > 40 THEN substr(s, 1, 40) || '…' ELSE s END AS short FROM (SELECT doc_id, trim(regexp_replace(translate(text, chr(34) || '{}|', chr(39) || '()/'), '\s+', ' ', 'g')) AS s FROM documents)")
def label_sanitize(spark, d):
    return t(spark, d, "documents").select("doc_id", S.diagram_label(F.col("text")).alias("label")).select("doc_id", "label", S.shortened(F.col("label"), 40).alias("short"))


@query("SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS first_k, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 = 0 THEN 0 ELSE 2 END::BIGINT AS n FROM events")
def first_json_array(spark, d):
    bad = F.get_json_object("props", "$.k").cast("long") % 3 == 0
    text = F.concat(F.lit("As in [1]:\n```json\n"), F.when(bad, F.lit("{no array")).otherwise(F.concat(F.lit("["), F.col("props"), F.lit(",\n"), F.col("props"), F.lit("]"))), F.lit("\n```\nor ] so"))
    a = S.first_json_array(text, "array<struct<k:bigint>>")
    return t(spark, d, "events").select("event_id", F.get(a, F.lit(0))["k"].alias("first_k"), F.coalesce(F.when(F.size(a) > 0, F.size(a)), F.lit(0)).cast("long").alias("n"))


@query("SELECT s_suppkey, 'supplier_' || s_suppkey::VARCHAR AS tbl, 'nation_key' AS col, 'nation_' || s_nationkey::VARCHAR AS ref_tbl, 'n_key' AS ref_col FROM supplier")
def fk_regex(spark, d):
    ddl = F.concat(F.lit("CREATE TABLE IF NOT EXISTS supplier_"), F.col("s_suppkey").cast("string"), F.lit(" (\n id int,\n nation_key int NOT NULL references nation_"), F.col("s_nationkey").cast("string"), F.lit("(n_key)\n);"))
    keys = foreign_keys(t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("file"), ddl.alias("text")))
    return keys.select(F.col("file").cast("long").alias("s_suppkey"), F.col("table").alias("tbl"), F.col("column").alias("col"), F.col("ref_table").alias("ref_tbl"), F.col("ref_column").alias("ref_col"))


@query("SELECT event_id, least(1000 * CAST(pow(2, user_id % 8) AS BIGINT), 30000)::BIGINT AS wait_ms FROM events")
def backoff(spark, d):
    return t(spark, d, "events").select("event_id", S.backoff_ms(F.col("user_id") % 8 + 1).alias("wait_ms"))


@query("SELECT user_id AS run, max(value) FILTER (event_type = 'purchase') AS spend, max(event_id % 1000)::DOUBLE AS seconds, bool_or(event_type = 'error') AS failed FROM events GROUP BY user_id")
def log_scrape(spark, d):
    kind = F.col("event_type")
    line = F.concat(F.lit("[run] wall="), (F.col("event_id") % 1000).cast("string"), F.when(kind == "purchase", F.concat(F.lit(" estimated spend: 1 in / 2 out, $"), F.col("value").cast("string"))).otherwise(""), F.when(kind == "error", " failed").otherwise(""))
    return rollups.run_logs(t(spark, d, "events").select(F.col("user_id").alias("run"), line.alias("line")))


@query("SELECT c_custkey, 'acct=' || CAST(round(c_acctbal * 100) AS BIGINT)::VARCHAR || ', seg=' || c_mktsegment AS detail FROM customer")
def annotation_detail(spark, d):
    args = F.concat(F.lit("acct = "), cents("c_acctbal").cast("string"), F.lit(" , seg = "), "c_mktsegment")
    return t(spark, d, "customer").select("c_custkey", S.annotation_detail(args).alias("detail"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'REST' WHEN event_type = 'purchase' THEN 'Events' WHEN event_type = 'signup' THEN 'Scheduled' ELSE 'Other' END AS category FROM events")
def category_label(spark, d):
    kind = F.create_map(*[F.lit(x) for x in ("click", "http", "view", "http", "purchase", "event", "signup", "scheduled")])
    return t(spark, d, "events").select("event_id", S.category_label(kind[F.col("event_type")]).alias("category"))


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click')")
def value_type_exclusion(spark, d):
    return t(spark, d, "events").where(may_collaborate(F.col("event_type"), ("view", "click"))).select("event_id", "event_type")


@query("SELECT o_custkey, sha256('Describe.' || chr(10) || chr(10) || m || chr(10) || chr(10) || 'Reply with one JSON array.') AS prompt_hash, 'sha256:' || sha256(m) AS source_hash FROM (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS m FROM orders GROUP BY o_custkey)")
def prompt_material(spark, d):
    keys = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",")
    asked = prompts(t(spark, d, "orders").groupBy(F.col("o_custkey").alias("task")).agg(keys.alias("material")), "Describe.")
    return asked.select(F.col("task").alias("o_custkey"), F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_hash"), "source_hash")


@query("SELECT o_orderkey, coalesce('when ' || CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, CASE WHEN o_orderstatus = 'O' THEN 'open' END, '') AS detail FROM orders")
def flow_detail(spark, d):
    status = F.col("o_orderstatus")
    return t(spark, d, "orders").select("o_orderkey", S.flow_detail(F.when(status == "F", F.col("o_orderpriority")), F.when(status == "O", "open")).alias("detail"))


@query("SELECT doc_id, (coalesce(length(text), 0) // 4)::BIGINT AS tokens FROM documents")
def approx_tokens(spark, d):
    return t(spark, d, "documents").select("doc_id", S.approx_tokens(F.col("text")).alias("tokens"))
