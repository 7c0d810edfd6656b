"""Line dedup: lines whose key many documents hold go from all of them.

Lines are normalised and hashed (MD5, 128 bits) inside the row, so only hashes and positions are shuffled: once each
distinct key of a document for counting documents (summed before the shuffle), once each line to meet the frequent keys.
A key that more than one in HOT of what the frequent keys count holds is told by a broadcast of at most HOT keys (no more
can be so frequent), so the lines of a very common key are never dealt by it; other keys are joined by shuffle. Positions
of dropped lines come back to their document, which keeps the others in order.

Defined cases: each row is a document of its own, whatever its doc_id; a null or empty text is one empty line; an empty key
is never dropped unless least_length is 0; a document that loses all lines has an empty text; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, cut, table

#: Code points of a key, documents that hold it, at least.
LEAST_LENGTH, LEAST_DOCS = 1, 10
#: At most so many keys are broadcast.
HOT = 10_000
BLANKS = " \t\n\x0b\x0c\r"


def _lower(text):
    """A-Z in lower case; the plain function does the same, faster, where a text has ASCII letters only."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(ascii_lower(text))


def keys(text, least_length: int = LEAST_LENGTH):
    """The hash of each line's key; null for a key that is too short."""
    return F.transform(F.split(_lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.when(F.length(F.btrim(x, F.lit(BLANKS))) >= least_length, F.md5(F.btrim(x, F.lit(BLANKS)).cast("binary"))))


def frequent_keys(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """key, docs: keys that at least so many rows of docs (text) hold."""
    held = docs.select(F.explode(F.array_distinct(keys(F.col("text"), least_length))).alias("h")).where("h is not null")
    return held.select(F.unhex("h").alias("key")).groupBy("key").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs)


def without_common_lines(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS, hot: int = HOT) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the other lines, joined by line ends) of each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    common = cut(frequent_keys(docs, least_length, least_docs), "common-lines")
    total = common.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    is_hot = F.col("docs") * hot > total
    name = [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("r2")]  # equal rows lose the same lines
    lines = docs.select(*name, F.posexplode(keys(F.col("text"), least_length)).alias("pos", "h")).where("h is not null").select("r1", "r2", "pos", F.unhex("h").alias("key"))
    few = F.broadcast(common.where(is_hot).select("key"))  # fewer than `hot` rows: their counts add up to no more than the total
    told = lines.join(few, "key", "left_semi").union(lines.join(few, "key", "left_anti").join(common.where(~is_hot).select("key"), "key", "left_semi").select("key", "r1", "r2", "pos"))
    gone = told.groupBy("r1", "r2").agg(F.collect_set("pos").alias("gone"))  # one document's lines
    own = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"), *name)
    own = own.join(gone, ["r1", "r2"], "left").withColumn("n", F.size("lines"))
    stays = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stays, lambda p: F.get(F.col("lines"), p)), "\n"))
    return own.select("doc_id", F.col("n").cast("long").alias("n_lines"), F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_common_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT r, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= {LEAST_LENGTH} GROUP BY key HAVING count(DISTINCT r) >= {LEAST_DOCS}),
s AS (SELECT r, string_agg(line, chr(10) ORDER BY pos) AS kept, count(*) AS n FROM k WHERE key NOT IN (SELECT key FROM f) GROUP BY r)
SELECT doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON d.r = s.r"""
