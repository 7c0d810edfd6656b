"""Rollups of interpretations and runs: use cases by category and feature, events, spending, what the gates kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def use_case_rollup(cases: DataFrame) -> DataFrame:
    """level (all, category, feature), category, rank, feature, total, gaps, critical_gaps, verified, full, partial, thin.

    cases: category, feature, gap, priority, coverage. All levels in one pass: rows are expanded before the partial sums, so
    what is shuffled is a row a group and task. rank is the category's place in the fixed order.
    """
    c = cases.select("category", F.coalesce("feature", F.lit("General")).alias("feature"), F.coalesce("gap", F.lit(False)).alias("gap"), "priority", "coverage")
    out = c.groupingSets([[], [F.col("category")], [F.col("category"), F.col("feature")]], F.col("category"), F.col("feature")).agg(
        F.grouping_id().alias("g"), F.count("*").alias("total"), F.count_if("gap").alias("gaps"), F.count_if(F.col("gap") & (F.col("priority") == "critical")).alias("critical_gaps"), F.count_if(~F.col("gap")).alias("verified"),
        *(F.count_if(F.col("coverage") == x).alias(x) for x in ("full", "partial", "thin")),
    )
    level = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "category").otherwise("feature")
    return out.select(level.alias("level"), "category", F.when(F.col("g") < 3, S.category_rank(F.col("category"))).alias("rank"), "feature", "total", "gaps", "critical_gaps", "verified", "full", "partial", "thin")


def use_cases(behaviours: DataFrame, entry_points: DataFrame) -> DataFrame:
    """behaviours (gated) with the category of their entry point, ready for use_case_rollup()."""
    return behaviours.join(entry_points.select(F.col("id").alias("entry_point")).distinct(), "entry_point", "left_semi").withColumn("category", S.entry_category(F.col("entry_point")))


def event_stats(flows: DataFrame) -> DataFrame:
    """One row: events, produced (events that something publishes), listeners (distinct consumers). flows: event, producers, consumers."""
    heard = flows.select(F.explode("consumers").alias("listener")).agg(F.count_distinct("listener").alias("listeners"))
    return flows.agg(F.count("*").alias("events"), F.count_if(F.size("producers") > 0).alias("produced")).join(heard, how="full")


def spend(usage: DataFrame, by: list[str]) -> DataFrame:
    """by, input, output, cost (in millionths of a price unit): for each group of usage and, with nulls in by, for the whole run.

    usage: by, input, output, cache_read, cache_write (tokens), price_in, price_out (for a million tokens; null: unknown, the
    cost counts as nothing). Reading from a cache costs a tenth of the input price, writing to it five quarters.
    """
    cost = F.coalesce((F.col("input") * F.col("price_in") + F.col("output") * F.col("price_out")) + F.col("cache_read") * F.col("price_in") / 10 + F.col("cache_write") * F.col("price_in") * 5 / 4, F.lit(0))
    names = [F.col(c) for c in by]
    return usage.withColumn("cost", cost).groupingSets([[], names], *names).agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("cost").alias("cost"))


def keep_rate(rows: DataFrame, kept: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """by, raw, kept: how many rows of each group there are, and how many joined back (their key is in kept)."""
    marked = rows.join(kept.select(*key).distinct().withColumn("is_kept", F.lit(True)), key, "left")
    return marked.groupBy(*by).agg(F.count("*").alias("raw"), F.count_if(F.coalesce("is_kept", F.lit(False))).alias("kept"))


def answer_quality(cases: DataFrame, by: str, needs: str, least: int = 12, invented: tuple = ()) -> DataFrame:
    """by, cases, covered, leaks, lifecycle, features, invented: what the answers of each run are worth.

    cases: by, entry_point, text, type, feature. covered: at least so many entry points, the one in `needs` among them;
    leaks: texts that name an HTTP verb; invented: how often the words occur in all texts, whatever their case.
    """
    c = cases.groupBy(by).agg(
        F.count("*").alias("cases"), (F.count_distinct("entry_point") >= least).alias("many"), F.bool_or(F.col("entry_point") == needs).alias("has"), F.count_if(F.col("text").rlike(r"\b(GET|POST|PUT|PATCH|DELETE)\b")).alias("leaks"),
        F.count_if(F.col("type") == "lifecycle").alias("lifecycle"), F.count_distinct("feature").alias("features"), F.coalesce(F.sum(S.count_words(F.col("text"), list(invented))), F.lit(0)).alias("invented"),
    )
    return c.select(by, "cases", (F.col("many") & F.coalesce("has", F.lit(False))).alias("covered"), "leaks", "lifecycle", "features", "invented")


def run_logs(logs: DataFrame) -> DataFrame:
    """run, spend, seconds, failed: what the log of each run (run, line) tells: the last total spent, the wall time and whether something failed."""
    found = lambda pattern: F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")).try_cast("double")
    return logs.groupBy("run").agg(F.max(found(r"estimated spend:.*?\$([0-9.]+)")).alias("spend"), F.max(found(r"wall=([0-9.]+)")).alias("seconds"), F.bool_or(F.col("line").contains("failed")).alias("failed"))
