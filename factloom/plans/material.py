"""Material of interpretations: the facts that each task's prompt holds, and the chunks that behaviours are asked in.

Entry points of a class stay together; classes are packed into chunks by what they add: the facts in reach of a chunk are a
union, counted once. Every fact is then scoped to the chunks whose entry points reach it, by joins with the closure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.packing import union_pack
from .enrichment import classes_with_roles

#: Letters of material in a chunk, at most.
MOST = 90_000


def as_json(facts: DataFrame):
    """A row as canonical JSON."""
    return S.canonical(F.struct(*(F.col(f"`{c}`") for c in facts.columns)), facts.select(F.struct(*(f"`{c}`" for c in facts.columns)).alias("s")).schema["s"].dataType)


class Material:
    """Facts of facts as rows of JSON: kind, key (what reach or a class must hold; null: shared by all chunks), json."""

    def __init__(self, facts):
        nodes, edges = facts.call_graph()
        self.entry_points = facts.entry_points()
        self.nodes = nodes
        self.near = facts.near()
        self.edges = edges
        kinds = {
            "nodes": (nodes, "id"), "edges": (edges, "a"), "throwSites": (facts.throw_sites(), "method_id"), "guardChecks": (facts.guard_checks(), "method_id"), "tests": (facts.test_scenarios(), "target"),
            "inputConstraints": (facts.input_constraints(), "entry_point"), "entryPoints": (self.entry_points, "id"), "stateMachines": (facts.state_machines(), None), "exceptionStatuses": (facts.exception_statuses(), None),
        }
        rows = [df.select(F.lit(kind).alias("kind"), (F.col(key) if key else F.lit(None).cast("string")).alias("key"), as_json(df).alias("json")) for kind, (df, key) in kinds.items()]
        whole = rows[0]
        for r in rows[1:]:
            whole = whole.union(r)
        self.rows = facts._once("material", lambda: whole)
        self.state_machines, self.entities = facts.state_machines(), facts.entities()

    def reached(self) -> DataFrame:
        """entry_point, class_name, kind, key of all that each entry point's material holds besides what is shared."""
        eps = self.entry_points.select(F.col("id").alias("entry_point"), "class_name", F.col("method_id").alias("root"))
        near = eps.join(self.near, "root").join(self.nodes.select(F.col("id").alias("node"), F.col("class_name").alias("of")), "node", "left")
        by_node = near.select("entry_point", "class_name", F.explode(F.array(*map(F.lit, ("nodes", "edges", "throwSites", "guardChecks")))).alias("kind"), F.col("node").alias("key"))
        by_class = near.select("entry_point", "class_name", F.lit("tests").alias("kind"), F.col("of").alias("key")).union(eps.select("entry_point", "class_name", F.lit("tests"), "class_name"))
        own = eps.select("entry_point", "class_name", F.explode(F.array(F.lit("entryPoints"), F.lit("inputConstraints"))).alias("kind"), F.col("entry_point").alias("key"))
        return by_node.union(by_class).union(own).where("key is not null").distinct()

    def chunks(self, size: int = 0, most: int = MOST) -> DataFrame:
        """class_name, chunk (from 0): size > 0 bounds the entry points of a chunk, else `most` bounds the letters of its material."""
        groups = self.entry_points.groupBy(F.lit(0).alias("project"), F.col("class_name").alias("place"))
        weights = self.rows.where("key is not null").groupBy("kind", "key").agg(F.sum(F.length("json") + 1).alias("weight"))
        if size > 0:
            groups, cap = groups.agg(F.count("*").alias("weight")), size
            members = weights.limit(0).select(F.lit(0).alias("project"), F.col("key").alias("place"), F.col("key").alias("member"), "weight")
        else:
            groups, cap = groups.agg(F.lit(0).alias("weight")), most - (self.rows.where("key is null").agg(F.sum(F.length("json") + 1)).first()[0] or 0)
            members = self.reached().join(weights, ["kind", "key"]).select(F.lit(0).alias("project"), F.col("class_name").alias("place"), F.to_json(F.struct("kind", "key")).alias("member"), "weight")
        return union_pack(groups, members, "project", cap).select(F.col("place").alias("class_name"), "chunk")

    def behaviours(self, size: int = 0, most: int = MOST) -> DataFrame:
        """task, chunk, material: one JSON text a chunk, its facts by kind; a single chunk holds all facts, in reach or not."""
        chunks = self.chunks(size, most)
        if chunks.agg(F.max("chunk")).first()[0] in (None, 0):
            held = self.rows.select(F.lit(0).cast("long").alias("chunk"), "kind", "json")
        else:
            scope = self.reached().join(chunks, "class_name").select("chunk", "kind", "key").distinct()
            held = self.rows.join(scope, ["kind", "key"]).select("chunk", "kind", "json").union(chunks.select("chunk").distinct().crossJoin(F.broadcast(self.rows.where("key is null").select("kind", "json"))))  # what is shared is bounded by `most`
        parts = held.groupBy("chunk", "kind").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("json")), ","), F.lit("]")).alias("rows"))  # bounded by `most`
        text = parts.groupBy("chunk").agg(F.array_sort(F.collect_list(F.concat(F.lit('"'), "kind", F.lit('":'), "rows"))).alias("ks"))
        return text.select(F.concat(F.lit("behaviours-"), F.col("chunk").cast("string")).alias("task"), F.concat(F.lit("{"), F.array_join("ks", ","), F.lit("}")).alias("material"))

    def transitions(self) -> DataFrame:
        """task, material: the state machines."""
        return _whole("transitions", {"stateMachines": self.state_machines})

    def domains(self) -> DataFrame:
        """task, material: classes with their roles, and the edges between methods."""
        return _whole("domains", {"classes": classes_with_roles(self.nodes, self.entities), "edges": self.edges})


def _whole(task: str, parts: dict[str, DataFrame]) -> DataFrame:
    rows = [df.select(F.lit(name).alias("kind"), as_json(df).alias("json")) for name, df in parts.items()]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.union(r)
    lists = whole.groupBy("kind").agg(F.array_sort(F.collect_list("json")).alias("rows"))  # one prompt's facts
    named = lists.agg(F.array_sort(F.collect_list(F.concat(F.lit('"'), "kind", F.lit('":['), F.array_join("rows", ","), F.lit("]")))).alias("ks"))
    return named.select(F.lit(task).alias("task"), F.concat(F.lit("{"), F.array_join("ks", ","), F.lit("}")).alias("material"))
