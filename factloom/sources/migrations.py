"""Foreign keys of SQL migrations: table, column, ref_table, ref_column, file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CREATE = r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`]?(\w+)"
_INLINE = r"(?is)^\s*[\"`]?(\w+)[\"`]?\s+\w.*?\breferences\s+[\"`]?(\w+)[\"`]?\s*\(\s*[\"`]?(\w+)"
_KEY = r"(?is)foreign\s+key\s*\(\s*[\"`]?(\w+)[\"`]?\s*\)\s*references\s+[\"`]?(\w+)[\"`]?\s*\(\s*[\"`]?(\w+)"


def foreign_keys(files: DataFrame) -> DataFrame:
    """files: (file, text). Statements are taken one by one, and their columns apart from their table constraints."""
    s = files.select("file", F.explode(F.split("text", ";")).alias("s")).where(F.col("s").rlike(_CREATE) | F.col("s").rlike(r"(?is)alter\s+table"))
    s = s.withColumn("table", F.coalesce(F.nullif(F.regexp_extract("s", _CREATE, 1), F.lit("")), F.regexp_extract("s", r"(?is)alter\s+table\s+[\"`]?(\w+)", 1)))
    inside = F.when(F.col("s").rlike(_CREATE), F.regexp_extract("s", r"(?s)\((.*)\)", 1)).otherwise(F.col("s"))
    c = s.select("file", "table", F.explode(F.split(inside, r",(?![^()]*\))")).alias("c"))
    pattern = lambda k: F.when(F.col("c").rlike(_KEY), F.regexp_extract("c", _KEY, k)).when(F.col("c").rlike(_INLINE), F.regexp_extract("c", _INLINE, k))
    return c.select("table", pattern(1).alias("column"), pattern(2).alias("ref_table"), pattern(3).alias("ref_column"), "file").where("ref_table is not null")


def read_migrations(spark: SparkSession, root: str) -> DataFrame:
    """Foreign keys of every .sql file in a db/migration folder below root, in any of its modules."""
    files = spark.read.text(root.rstrip("/"), wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.sql").select(F.col("_metadata.file_path").alias("at"), F.col("value").alias("text"))
    return foreign_keys(files.where(F.col("at").rlike("/src/main/resources/db/migration/")).select(F.regexp_extract("at", "[^/]*$", 0).alias("file"), "text"))
