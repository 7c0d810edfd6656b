"""URL filters as a sort-merge range join, in DataFrame functions only.

A rule (host, path prefix, verdict) fits its host and all subdomains when the url's path starts with the rule's path.
A canonical key is the host's labels in reverse order, a separator, and the path, as bytes: what starts with a rule's
key lies in the interval from the key to the key and 0xFF, a byte that no text holds, and intervals of two rules are
nested or apart. A url has one key per suffix of its host (no more labels than the longest rule has), so that rules for
its parent domains cover it too.

Starts of rules (push), ends of rules (pop) and urls are sorted together by key. The sweep is two windows over that
order: the running sum of pushes and pops is the depth of the stack of active rules, and the top of the stack at a url
is the last rule that was pushed to that depth. Being nested, the top is the longest rule of its host; the longest of
a url's suffixes wins.

Scale: urls are first reduced to distinct (host, path); only suffixes that are some rule's host are kept; the sweep runs
per (reversed host, salt), with salts counted from the data (ROWS_PER_SWEEP) and the host's rules repeated for each salt,
so no host lands in one task, and holds no more than a row and two numbers. Nothing is broadcast by force.

Defined cases: a null url, or one without "://", has host and path '' and gets the default verdict; a port or user
info stays part of the host and so fits no rule; rules with a null part are left out; rules with the same host and path
keep the least verdict in code point order; of rules of equal length the least rule text wins; repeated rows are kept;
other columns are ignored; empty tables give no rows, or all rows the default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Distinct urls that one sweep takes.
ROWS_PER_SWEEP = 10_000

#: (host, path prefix, verdict): fixed values of the query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def split_url(df: DataFrame) -> DataFrame:
    """page_id, host, path of each row."""
    at = F.expr("instr(url, '://')")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host, path = F.regexp_extract(rest, r"^[^/?#]*", 0), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.select("page_id", F.coalesce(ascii_lower(host), F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def _key(rhost, path):
    return F.concat(F.encode(rhost, "UTF-8"), F.lit(b"\0"), F.encode(path, "UTF-8"))


def _intervals(rules: DataFrame) -> DataFrame:
    """rhost, key, upto, rule, verdict of each different rule."""
    host = ascii_lower(F.col("host"))
    r = rules.where("host is not null and path is not null and verdict is not null").select(F.array_join(F.reverse(F.split(host, r"\.")), ".").alias("rhost"), "path", F.concat(host, "path").alias("rule"), "verdict")
    key = _key(F.col("rhost"), F.col("path"))
    return r.groupBy("rhost", "path", "rule").agg(F.min("verdict").alias("verdict")).select("rhost", key.alias("key"), F.concat(key, F.lit(b"\xff")).alias("upto"), "rule", "verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", rows_per_sweep: int = ROWS_PER_SWEEP) -> DataFrame:
    """page_id, host, path, rule (null if none), verdict for every row of pages (page_id, url)."""
    parts = split_url(pages)
    intervals = _intervals(rules)
    most = intervals.agg(F.max(F.size(F.split("rhost", r"\.")))).first()[0] or 0  # one number
    urls = parts.select("host", "path").where("host <> ''").distinct()
    reverse = F.reverse(F.split("host", r"\."))
    suffixes = urls.where(F.lit(most > 0)).select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(reverse), F.lit(most))), lambda n: F.array_join(F.slice(reverse, F.lit(1), n), "."))).alias("rhost"))
    suffixes = suffixes.join(intervals.select("rhost").distinct(), "rhost")
    salts = suffixes.groupBy("rhost").agg(F.ceil(F.count("*") / F.lit(rows_per_sweep)).cast("int").alias("salts"))
    asked = suffixes.join(salts, "rhost").select("rhost", F.pmod(F.xxhash64("host", "path"), "salts").cast("int").alias("salt"), _key(F.col("rhost"), F.col("path")).alias("key"), F.lit(0).alias("step"), "host", "path", F.lit(None).cast("struct<rule:string,verdict:string>").alias("top"))
    each = intervals.join(salts, "rhost").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    none = [F.lit(None).cast("string").alias(c) for c in ("host", "path")]
    pushes = each.select("rhost", "salt", "key", F.lit(1).alias("step"), *none, F.struct("rule", "verdict").alias("top"))
    pops = each.select("rhost", "salt", F.col("upto").alias("key"), F.lit(-1).alias("step"), *none, F.lit(None).cast("struct<rule:string,verdict:string>").alias("top"))
    swept = asked.unionByName(pushes).unionByName(pops)
    ordered = lambda *by: Window.partitionBy("rhost", "salt", *by).orderBy("key", F.col("step").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = swept.withColumn("depth", F.sum("step").over(ordered()))
    swept = swept.withColumn("top", F.last("top", ignorenulls=True).over(ordered("depth")))
    fits = swept.where("step = 0 and depth > 0").select("host", "path", "top.*")
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "verdict")).alias("b"))
    return parts.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules_frame(spark, RULES))


ORACLE = r"""
WITH rules(rhost, rpath, verdict) AS (VALUES ('org','/','allow'), ('example.org','/es/','block'),
  ('example.org','/en/1','block'), ('com','/fr/','allow'), ('com','/de/','block')),
u AS (SELECT page_id, row_number() OVER () AS rid,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, rid, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT p.rid, rhost || rpath AS rule, r.verdict, row_number() OVER (PARTITION BY p.rid ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS k
  FROM p JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.rid = m.rid AND m.k = 1
"""
