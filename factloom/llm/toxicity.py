"""Toxicity by a counterfactual-regularised classifier.

Features are a text's distinct words (letters, lower case) and their beginnings, so that unseen endings of a known stem
still count. A logistic model is fitted to labelled rows; where a labelled text names an identity group, a copy of it
with the term swapped for the other terms of its list is scored too, and the loss penalises any change of the score. A
neutral mention of a group then can't move a text towards toxic.

Scale: features are counted by Spark over a bounded sample of the labelled rows (SAMPLE rows, the least by a hash of
doc_id), the FEATURES most telling ones are kept, and the driver fits on that bounded matrix. Swaps reach the driver as
counts of different changes of features, folded into one matrix of FEATURES squared. Scoring is one pass over
the documents without a shuffle, with the small model in the closure.

Defined cases: null or empty text has only the intercept; rows without a label, or with a null label, are scored but
don't train; several labels of one doc_id: toxic if any says so; without rows of both classes the score is the share of toxic rows (0 if
none); a null doc_id isn't held out; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import in_parts, table

#: Labelled rows that the model is fitted to, at most; features kept; rows that must hold a feature.
SAMPLE, FEATURES, LEAST_ROWS = 10_000, 512, 3
#: Standard errors by which a feature's share of toxic rows must differ from its share of the others.
LEAST_Z = 3.0
#: Neutral words: how many times more or less often toxic than all rows, how many, how many to a list, in what share of rows at least.
MOST_LIFT, NEUTRAL, LIST, COMMON = 2.0, 64, 4, 0.01
#: Lengths of a word's beginnings.
STEMS = (4, 5, 6)
THRESHOLD = 0.3
#: Terms for groups of people; a term is swapped for the others of its own list.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "african", "latino", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("immigrants", "locals", "refugees", "foreigners"),
    ("immigrant", "local", "refugee", "foreigner"),
    ("disabled", "deaf", "blind", "elderly", "young"),
)
#: Weight of the swap penalty and of the ridge; steps of the descent.
SWAP_PENALTY, RIDGE, ROUNDS = 4.0, 2e-5, 1_000
_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_LETTERS.findall(text.lower())) if text else set()


def features(found: set[str]) -> set[str]:
    """A word stands for itself; its first letters stand with a star behind them."""
    out = set(found)
    for n in STEMS:
        out.update([w[:n] + "*" for w in found if len(w) >= n])
    return out


def swapped(found: set[str], groups=IDENTITY) -> list[set[str]]:
    """The same words with each identity term swapped for the other terms of its list, one swap at a time."""
    return [found - {term} | {other} for group in groups for term in group if term in found for other in group if other != term and other not in found]


def changes(found: set[str], index: dict[str, int], groups, neutral) -> list[list[int]]:
    """What swaps change: k + 1 for each feature k that appears, -k - 1 for each that goes; swaps without effect are left out."""
    own = {index[f] for f in features(found) if f in index}
    swaps = swapped(found, groups)
    for group in neutral:
        if (has := [t for t in group if t in found]) and (not_ := [t for t in group if t not in found]):
            swaps.append(found - {has[0]} | {not_[len(found) % len(not_)]})
    out = []
    for s in swaps:
        new = {index[f] for f in features(s) if f in index}
        if new != own:
            out.append(sorted([k + 1 for k in new - own] + [-k - 1 for k in own - new]))
    return out


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, toxic, text of the labelled rows to fit to: the least by hash, none of the held-out quarter."""
    kept = labels.where("doc_id is not null and toxic is not null").where(F.expr("crc32(cast(doc_id as string)) % 4 <> 2"))
    ids = docs.select("doc_id").join(kept.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "doc_id").distinct()
    ids = ids.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(rows)  # a bounded sample: the feature of the fit
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, most: int = FEATURES, groups=IDENTITY) -> dict:
    """{"bias": float, "weights": {feature: float}} for docs (doc_id, text) and labels (doc_id, toxic)."""
    sample = _sample(docs, labels, rows)

    def listed(batches):
        for b in in_parts(batches):
            found = [sorted(words(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("toxic"), pa.array(found, pa.list_(pa.string())), pa.array([sorted(features(set(f))) for f in found], pa.list_(pa.string()))], ["doc_id", "toxic", "words", "own"])

    listed_rows = sample.mapInArrow(listed, "doc_id long, toxic int, words array<string>, own array<string>").persist()
    try:
        n, bad = listed_rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        if not 0 < bad < n:
            return {"bias": None, "weights": {}, "share": bad / n if n else 0.0}
        seen = listed_rows.select("toxic", F.explode("own").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).where(F.col("n") >= LEAST_ROWS)
        a, b = F.col("bad") / bad, (F.col("n") - F.col("bad")) / (n - bad)
        telling = F.round(F.abs(a - b) / F.sqrt((a * (1 - a) + 0.01) / bad + (b * (1 - b) + 0.01) / (n - bad)), 6)
        seen = seen.select("f", "n", telling.alias("z"), (F.col("bad") / F.col("n") * n / bad).alias("lift")).persist()
        vocabulary = [r.f for r in seen.where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "f").limit(most).collect()]  # a top-k of features
        plain = seen.where(F.col("lift").between(1 / MOST_LIFT, MOST_LIFT) & (F.col("n") >= COMMON * n) & ~F.col("f").endswith("*")).orderBy(F.desc("z"), "f").limit(NEUTRAL).collect()  # a top-k of words
        plain = [r.f for r in sorted(plain, key=lambda r: (-r.n, r.f))]
        seen.unpersist()
        neutral = [plain[k : k + LIST] for k in range(0, len(plain), LIST)]
        index = {f: k for k, f in enumerate(vocabulary)}

        def numbered(batches):
            for b in batches:
                own = [[index[f] for f in fs if f in index] for fs in b.column("own").to_pylist()]
                swaps = [changes(set(w), index, groups, neutral) for w in b.column("words").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(own, pa.list_(pa.int32())), pa.array(swaps, pa.list_(pa.list_(pa.int32())))], ["doc_id", "toxic", "own", "swaps"])

        numbers = listed_rows.mapInArrow(numbered, "doc_id long, toxic int, own array<int>, swaps array<array<int>>").persist()
        got = numbers.select("doc_id", "toxic", "own").collect()  # at most SAMPLE rows of numbers
        swaps = numbers.select(F.explode("swaps").alias("change")).groupBy("change").count()
        effect, pairs = np.zeros((len(vocabulary) + 1,) * 2), 0
        for r in swaps.orderBy("change").toLocalIterator():  # one at a time; what is held is the matrix
            at = np.array([abs(k) - 1 for k in r.change])
            sign = np.sign(r.change)
            effect[np.ix_(at, at)] += r["count"] * np.outer(sign, sign)
            pairs += r["count"]
        numbers.unpersist()
    finally:
        listed_rows.unpersist()
    got.sort(key=lambda r: (r.doc_id, r.toxic, r.own))
    weights, bias = _train(got, len(vocabulary), effect / max(1, pairs))
    return {"bias": bias, "weights": {f: float(w) for f, w in zip(vocabulary, weights)}, "swaps": pairs}


def _train(rows: list, width: int, effect: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on log loss + RIDGE |w|^2 / 2 + SWAP_PENALTY * mean squared change of score by swaps.

    effect: the mean of the outer products of what swaps change with itself.
    """
    x = np.zeros((len(rows), width + 1), np.float32)
    x[:, -1] = 1
    for k, r in enumerate(rows):
        x[k, r.own] = 1
    y = np.array([r.toxic > 0 for r in rows], np.float32)
    pull = (2 * SWAP_PENALTY * effect).astype(np.float32)
    ridge = np.full(width + 1, RIDGE, np.float32)
    ridge[-1] = 0
    w = v = np.zeros(width + 1, np.float32)
    top = np.ones(width + 1, np.float32)
    for _ in range(12):  # the largest curvature, for the step
        top = x.T @ (x @ top) / len(rows) / 4 + pull @ top
        size = float(np.linalg.norm(top))
        top /= size
    step = 1 / (1.1 * size + RIDGE)
    for t in range(rounds):
        z = x @ v
        g = x.T @ (1 / (1 + np.exp(-z)) - y) / len(rows) + ridge * v + pull @ v
        new = v - step * g
        v, w = new + t / (t + 3) * (new - w), new
    return w[:-1], float(w[-1])


def score_text(model: dict, text: str | None) -> float:
    if model["bias"] is None:
        return float(model["share"])
    found, weights = words(text), model["weights"]
    hits = {f for w in found for f in (w, w[:4] + "*", w[:5] + "*", w[:6] + "*") if f in weights and (f[-1] != "*" or len(w) >= len(f) - 1)}
    z = model["bias"] + math.fsum(weights[f] for f in hits)
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def scored(docs: DataFrame, model: dict, score: str = "score") -> DataFrame:
    """All columns of docs and the score, for every row of docs (text)."""
    schema = StructType([*docs.schema.fields, StructField(score, DoubleType())])

    def run(batches):
        for b in in_parts(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([score_text(model, t) for t in b.column("text").to_pylist()], pa.float64())], [*b.schema.names, score])

    return docs.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
