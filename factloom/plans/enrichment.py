"""Interpretations of facts: hashed material, prompts for what the results table lacks, and the gate.

Answers come as text from a model or a person; rows are parsed out of it, and only those that join back to extracted
facts are kept. Nothing here calls a service: misses are written as requests and answers are read from a table, so a
task that is run again costs nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.relational import first_wins, gate_members

#: What an interpretation may say.
TYPES, PRIORITIES, LEVELS = ("happy-path", "validation", "edge-case", "security", "lifecycle"), ("critical", "high", "medium"), ("full", "partial", "thin")
BEHAVIOUR = "array<struct<feature:string,scenario:string,type:string,priority:string,verifiedBy:array<string>,coverage:struct<level:string>,evidence:struct<entryPoint:string,nodes:array<string>,covers:array<string>>>>"
TRANSITION = "array<struct<`from`:string,`to`:string,trigger:string,evidence:struct<file:string,line:int>>>"
DOMAIN = "array<struct<domain:string,members:array<string>,rationale:string>>"


def artifact_hash(facts: DataFrame) -> DataFrame:
    """One row: the content hash of a fact table, whatever the order of its rows and of the fields at any level.

    Rows are hashed where they lie and only their hashes are gathered; equal rows count.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in facts.columns))
    row = F.sha2(S.canonical(whole, facts.schema).cast("binary"), 256)
    part = facts.select(row.alias("h")).groupBy(F.substring("h", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "").cast("binary"), 256).alias("h"))
    return part.agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "").cast("binary"), 256)).alias("hash"))


def prompts(material: DataFrame, instructions: str) -> DataFrame:
    """task, material, source_hash, prompt_version, prompt, tokens (roughly) for (task, material)."""
    version = F.substring(F.sha2(F.lit(f'"{instructions}"').cast("binary"), 256), 1, 8)
    return material.select("task", "material", S.content_hash(F.col("material")).alias("source_hash"), version.alias("prompt_version"), F.concat(F.lit(instructions + "\n\n"), "material", F.lit("\n\nReply with one JSON array.")).alias("prompt")).withColumn("tokens", S.approx_tokens(F.col("prompt")))


def split_by_cache(asked: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their answer, misses): results (source_hash, prompt_version, answer)."""
    keys = ["source_hash", "prompt_version"]
    known = first_wins(results.select(*keys, "answer"), keys, ["answer"])
    return asked.join(known, keys), asked.join(known, keys, "left_anti")


def parsed(answers: DataFrame, schema: str) -> DataFrame:
    """task, pos and the fields of each row of the first JSON array in answer; nothing for text without one."""
    rows = answers.select("task", F.posexplode(S.first_json_array(F.col("answer"), schema)).alias("pos", "row"))
    return rows.where("row is not null").select("task", "pos", "row.*")


def cited(evidence: DataFrame, kind: str, name: str) -> DataFrame:
    """(name): what may be cited of a kind; evidence: kind, key."""
    return evidence.where(F.col("kind") == kind).select(F.col("key").alias(name))


def joins_back(rows: DataFrame, legal: DataFrame) -> DataFrame:
    """The rows whose values in the columns of legal are there."""
    return rows.join(legal.distinct(), legal.columns, "left_semi")


def first_that_joins_back(rows: DataFrame, legal: DataFrame, order: list) -> DataFrame:
    """Of the rows whose values in the columns of legal are there, the first for each."""
    return first_wins(joins_back(rows, legal), legal.columns, order)


def gated_transitions(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Transitions whose evidence is a known assignment site and which name both states."""
    named = rows.where("`from` is not null and `to` is not null").withColumn("site", F.concat_ws(":", "evidence.file", "evidence.line"))
    return joins_back(named, cited(evidence, "site", "site")).drop("site")


def gated_domains(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """domain, members: named domains with their known members, in order, repeats kept; domains without any go."""
    members = rows.where("domain is not null and trim(domain) <> ''").select("domain", F.posexplode("members").alias("at", "member"))
    return gate_members(members, "domain", "member", "at", cited(evidence, "class", "member")).withColumnRenamed("kept", "members")


def classes_with_roles(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """class, role: the role of each class's first node; entities without a node are of the domain."""
    first = nodes.groupBy(F.col("class_name").alias("class")).agg(F.min_by("role", "id").alias("role"))
    rest = entities.select(F.col("name").alias("class")).distinct().join(first, "class", "left_anti").withColumn("role", F.lit("domain"))
    return first.unionByName(rest)


def evidence_index(facts) -> DataFrame:
    """kind (entry_point, node, class, site, scenario), key: everything that an interpretation may cite."""
    nodes, _ = facts.call_graph()
    eps, sites, tests = facts.entry_points(), facts.assignment_sites(), facts.test_scenarios()
    keys = [("entry_point", eps, F.col("id")), ("node", nodes, F.col("id")), ("class", eps, F.col("class_name")), ("class", nodes, F.col("class_name")), ("class", facts.entities(), F.col("name")), ("site", sites, F.concat_ws(":", "file", "line")), ("scenario", tests, F.concat("test_class", F.lit("#"), "method"))]
    out = [df.select(F.lit(kind).alias("kind"), key.alias("key")) for kind, df, key in keys]
    whole = out[0]
    for df in out[1:]:
        whole = whole.union(df)
    return whole.where("key is not null").distinct()


def gated_behaviours(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """One behaviour for each known entry point, the first; unknown verifying tests, nodes and covered entry points go, gap tells of no test left, enums are clamped."""
    named = rows.where("scenario is not null").withColumn("entry_point", F.col("evidence.entryPoint"))
    out = first = first_that_joins_back(named, cited(evidence, "entry_point", "entry_point"), ["task", "pos"])
    for name, (given, kind) in {"verified_by": ("verifiedBy", "scenario"), "nodes": ("evidence.nodes", "node"), "covers": ("evidence.covers", "entry_point")}.items():
        members = first.select("entry_point", F.posexplode(given).alias("at", "member"))
        out = out.join(gate_members(members, "entry_point", "member", "at", cited(evidence, kind, "member")).withColumnRenamed("kept", name), "entry_point", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "entry_point",
        F.coalesce("feature", F.lit("General")).alias("feature"),
        "scenario",
        S.clamp(F.col("type"), list(TYPES), "happy-path").alias("type"),
        S.clamp(F.col("priority"), list(PRIORITIES), "medium").alias("priority"),
        F.coalesce("verified_by", none).alias("verified_by"),
        F.coalesce("nodes", none).alias("nodes"),
        F.coalesce("covers", none).alias("covers"),
        F.col("verified_by").isNull().alias("gap"),
        F.when(F.col("coverage").isNotNull(), S.clamp(F.col("coverage.level"), list(LEVELS), "partial")).alias("coverage"),
    )


def covered(behaviours: DataFrame) -> DataFrame:
    """(entry_point): the entry points that behaviours describe or cover."""
    return behaviours.select("entry_point").union(behaviours.select(F.explode("covers"))).distinct()


#: Tasks: what each asks for and how its answers are read and gated.
TASKS = {
    "transitions": (TRANSITION, gated_transitions, "Name the transitions between the states: from, to, trigger, evidence (file and line of an assignment site)."),
    "domains": (DOMAIN, gated_domains, "Group the classes into business domains: domain, members, rationale."),
    "behaviours": (BEHAVIOUR, gated_behaviours, "Describe one behaviour for each entry point: feature, scenario, type, priority, verifiedBy, coverage, evidence (entryPoint, nodes, covers)."),
}


def sections(material: dict[str, DataFrame], evidence: DataFrame, mode: str, results: DataFrame | None = None, requests: str | None = None) -> dict[str, tuple[DataFrame, DataFrame]]:
    """By task: (the gated rows; source_hash, prompt_version, model of each prompt).

    material: (task, material) by name of the task. mode none: nothing is answered, all tables are empty and model is none.
    emit: what results (source_hash, prompt_version, model, answer) doesn't answer is written below requests and is pending.
    assemble: what isn't answered stays empty.
    """
    if mode not in ("none", "emit", "assemble"):
        raise ValueError(f"mode {mode!r}: none, emit or assemble")
    out = {}
    for name, (schema, gate, instructions) in TASKS.items():
        asked = prompts(material[name], instructions)
        known = asked.select("source_hash", "prompt_version").limit(0).withColumns({"model": F.lit(""), "answer": F.lit("")}) if mode == "none" or results is None else results
        hits, misses = split_by_cache(asked, known)
        if mode == "emit":
            misses.write.mode("overwrite").parquet(f"{requests}/{name}")
        model = first_wins(known, ["source_hash", "prompt_version"], ["answer"]).select("source_hash", "prompt_version", "model")
        told = asked.join(model, ["source_hash", "prompt_version"], "left").select("task", "source_hash", "prompt_version", F.coalesce("model", F.lit("pending" if mode == "emit" else "none")).alias("model"))
        out[name] = gate(parsed(hits, schema), evidence), told
    return out


def emit_requests(asked: DataFrame, results: DataFrame, out: str) -> DataFrame:
    """Write the prompts that results (source_hash, prompt_version, answer) doesn't answer below out, one row a request; return them."""
    _, misses = split_by_cache(asked, results)
    misses.write.mode("overwrite").parquet(out)
    return asked.sparkSession.read.parquet(out)


def remember(results: DataFrame, answers: DataFrame, out: str) -> None:
    """Write results and the new answers (source_hash, prompt_version, answer) below out, the first answer of each; out is another folder than results is read from."""
    keys = ["source_hash", "prompt_version"]
    both = results.select(*keys, "answer", F.lit(0).alias("turn")).union(answers.select(*keys, "answer", F.lit(1)))
    first_wins(both, keys, ["turn", "answer"]).drop("turn").write.mode("overwrite").parquet(out)


def assemble(asked: DataFrame, results: DataFrame, schema: str) -> DataFrame:
    """The rows of all answers that are known; without any - no model, nothing answered yet - an empty table."""
    hits, _ = split_by_cache(asked, results)
    return parsed(hits, schema)
