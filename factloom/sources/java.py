"""Java sources as tables, by Spark SQL alone: files, tokens, statements.

A file is cut into tokens by one pattern; window sums over a file's tokens give line numbers, the partner of every bracket
and the bracket around every token; tokens between ';', '{' and '}' outside parentheses are a statement. Declarations are then patterns over
statements, and everything else is joins. Files are independent, so this scales with their number; a window holds one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.nesting import partners
from .listing import texts, tree

#: Comments, text blocks, strings, characters, line ends, names, numbers, single marks.
TOKEN = r'''(?s)/\*.*?\*/|//[^\n]*|""".*?"""|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|\n|[A-Za-z_$][\w$]*|\d[\w.]*|->|::|\S'''
#: Folders that hold no sources of the project.
PRUNED = ("build", "target", "out", "bin", "node_modules")
#: Folders that sources begin at.
ROOTS = ("/src/main/java", "/src/test/java")


def read_sources(spark: SparkSession, root: str, exclude: tuple = ()) -> DataFrame:
    """file, source_set (main, test, other), text, error of the .java files below root's source roots, or below root if it has none.

    Build folders, hidden ones and those named in exclude are not listed; a file or folder that can't be read is a row with an error and no text.
    """
    base = root.rstrip("/")
    found = tree(spark, base, ".java", (*PRUNED, *exclude), ROOTS)
    if not found.where("root is not null").isEmpty():
        found = found.where("root is not null")
    read = texts(found.where("kind = 'file'").select("path")).unionByName(found.where("kind <> 'file'").select("path", F.lit(None).cast("string").alias("text"), F.col("kind").alias("error")))
    files = read.withColumn("file", F.substring("path", len(base) + 2, 1 << 30))
    kind = F.when(F.col("file").rlike("(^|/)src/main/java/"), "main").when(F.col("file").rlike("(^|/)src/test/java/"), "test").otherwise("other")
    return files.select("file", kind.alias("source_set"), "text", "error")


def tokens(files: DataFrame) -> DataFrame:
    """One row a token, without comments and line ends.

    file, pos (from 0, without gaps), tok, line, depth (open braces before it), paren (open parentheses before it), nest
    (brackets around it), partner (pos of a bracket's other end), parent (pos of the innermost bracket around it), n (number
    of its statement), p1 to p5 and n1 to n3 (the tokens before and after it).
    """
    raw = files.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), 0)).alias("at", "tok"))
    order = Window.partitionBy("file").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.length("tok") - F.length(F.replace("tok", F.lit("\n"), F.lit("")))
    step = lambda a, b: F.when(F.col("tok").isin(*a), 1).when(F.col("tok").isin(*b), -1).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("int")
    out = raw.select("file", "at", "tok", (total(breaks) + 1).alias("line"), total(step("{", "}")).alias("depth"), total(step("(", ")")).alias("paren"))
    out = out.where(r"tok <> '\n' and not startswith(tok, '/*') and not startswith(tok, '//')")
    ends = F.when(F.col("tok").isin(";", "{", "}") & (F.col("paren") == 0), 1).otherwise(0)
    near = [F.lag("tok", k).over(order).alias(f"p{k}") for k in (1, 2, 3, 4, 5)] + [F.lead("tok", k).over(order).alias(f"n{k}") for k in (1, 2, 3)]
    out = out.select("file", (F.row_number().over(order) - 1).alias("pos"), "tok", "line", "depth", "paren", total(ends).alias("n"), *near)
    return partners(out, ["file"], "pos", step("({[", ")}]"))


def statements(toks: DataFrame) -> DataFrame:
    """file, n, start, stop, line, depth, parent, ends ('{', '}' or ';'), toks (its tokens, without the end), text (joined by blanks) of each statement."""
    grouped = toks.groupBy("file", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "tok", "line", "depth", "parent"))).alias("ts"))  # one statement's tokens
    first, last = F.col("ts")[0], F.element_at("ts", -1)
    body = F.transform(F.when(last["tok"].isin(";", "{", "}"), F.slice("ts", F.lit(1), F.size("ts") - 1)).otherwise(F.col("ts")), lambda t: t["tok"])
    return grouped.select("file", "n", first["pos"].alias("start"), last["pos"].alias("stop"), first["line"].alias("line"), first["depth"].alias("depth"), first["parent"].alias("parent"), last["tok"].alias("ends"), body.alias("toks")).withColumn("text", F.array_join("toks", " "))


def cut_text(toks, start, first, last):
    """The tokens from first to last of a statement that begins at start, joined by blanks."""
    return F.array_join(F.slice(toks, first - start + 1, F.greatest(last - first + 1, F.lit(0))), " ")
