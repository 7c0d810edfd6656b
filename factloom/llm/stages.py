"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.

Each works on all rows of docs. Defined cases are those of the operators; an empty docs gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import mixing, pieces, repeats, shingle_join, toxicity
from .common import cut, fresh, table

#: Near-duplicates of the pipeline: shingles of five words, four fifths in common.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; it is fitted to the labelled rows among docs."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    score = fresh(docs, "score")
    return toxicity.scored(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells rows apart by doc_id and text, and its name."""
    key = fresh(docs, "key")
    return docs.withColumn(key, F.xxhash64("doc_id", "text")), key


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of the least doc_id (null last), then the least by a hash.

    Rows are told apart by doc_id and text, so rows that share a doc_id but not the text are documents of their own, and
    so are rows without a doc_id; of rows equal in both, one stays. A text without words is like no other.
    """
    docs, key = _keyed(docs)
    found = cut(shingle_join.groups(docs.select(F.col(key).alias("doc_id"), "text"), NEAR_WORDS, NEAR_PERCENT).select("doc_id", "component_id"), "groups")
    ids = docs.select(F.col(key).alias("own"), F.col("doc_id").alias("id")).join(found.distinct(), F.col("own") == found["doc_id"])
    kept = ids.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "own"))["own"].alias("stays")).select("stays")
    order, row = Window.partitionBy(key).orderBy(F.xxhash64(*(f"`{c}`" for c in docs.columns))), fresh(docs, "row")
    one = docs.join(kept, F.col(key) == F.col("stays"), "left_semi").withColumn(row, F.row_number().over(order)).where(F.col(row) == 1)
    return one.drop(row, key)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of their long repeats; letters that were cut through go; n_chars follows the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    left = repeats.without_repeats(docs, carry=others, as_text=True)
    columns = {c: F.col("carried")[f"c{k}"] for k, c in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in others:
        columns["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return left.select(*(columns[c].alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (a document that is taken in part counts once more); rows equal in doc_id and text are taken alike."""
    docs, key = _keyed(docs)
    copies, own = fresh(docs, "copies"), fresh(docs, "own")
    taken = mixing.mixed_words(docs).where("taken > 0")
    taken = taken.groupBy(F.col("key").alias(own)).agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias(copies))
    again = docs.join(taken, F.col(key) == F.col(own)).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return again.drop(copies, own, key)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    return pieces.digests(pieces.encode(docs))
