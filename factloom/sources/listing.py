"""Folders listed by tasks: what is pruned is never listed, and every file found becomes a row, readable or not.

Folders are a frontier: a task walks the ones it is dealt, up to FOLDERS of them, and hands on those it hasn't come to; the
next round deals these out anew. A small tree takes one round, a wide one is spread. Listing and reading go through
pyarrow's file systems, so a path may be local or in a store that tasks can reach.
"""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import cut, drop

#: Folders that a task lists in one round.
FOLDERS = 1000
FOUND = "path string, root string, kind string"


def _walk(pruned: tuple, suffix: str, roots: tuple):
    def run(batches):
        for b in batches:
            todo = list(zip(b.column("path").to_pylist(), b.column("root").to_pylist()))
            out, listed = [], 0
            while todo and listed < FOLDERS:
                path, root = todo.pop()
                listed += 1
                if root is None and path.endswith(roots):
                    root = path
                system, at = fs.FileSystem.from_uri(path)
                try:
                    inside = system.get_file_info(fs.FileSelector(at))
                except OSError as e:
                    out.append((path, root, f"error: {e}"))
                    continue
                for x in inside:
                    child = f"{path}/{x.base_name}"
                    if x.type == fs.FileType.Directory:
                        if not (x.base_name in pruned or x.base_name.startswith(".")):
                            todo.append((child, root))
                    elif x.base_name.endswith(suffix):
                        out.append((child, root, "file"))
            out += [(p, r, "folder") for p, r in todo]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(3)], ["path", "root", "kind"])

    return run


def tree(spark: SparkSession, root: str, suffix: str, pruned: tuple, roots: tuple = ()) -> DataFrame:
    """path, root, kind (file, or error: and why) of the files below root whose names end with suffix; root is the folder around it whose path ends with one of roots."""
    base = root.rstrip("/")
    frontier = cut(spark.createDataFrame([(base, None)], "path string, root string"), "folders")
    parts = []
    while not frontier.isEmpty():
        n = frontier.count()
        found = cut(frontier.repartition(max(1, min(n, 8 * spark.sparkContext.defaultParallelism))).mapInArrow(_walk(pruned, suffix, roots), FOUND), "listed")
        drop(frontier)
        parts.append(found)
        frontier = cut(found.where("kind = 'folder'").select("path", "root"), "folders")
    drop(frontier)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole.where("kind <> 'folder'")


def texts(files: DataFrame) -> DataFrame:
    """files (path, ..) with text and error: text is null where a file can't be read as UTF-8, error says why."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):  # one text at a time
                row, text, error = b.slice(k, 1), None, None
                system, at = fs.FileSystem.from_uri(row.column("path")[0].as_py())
                try:
                    with system.open_input_stream(at) as f:
                        text = f.read().decode("utf-8")
                except (OSError, UnicodeDecodeError) as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([text], pa.string()), pa.array([error], pa.string())], [*row.schema.names, "text", "error"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{kinds}, text string, error string")
