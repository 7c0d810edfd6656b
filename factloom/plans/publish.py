"""Publishing: every relation as Parquet, a manifest of content hashes, diagrams as text and a small report."""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.graph import trace
from ..operators.tables import cut, drop
from ..sources.java import read_sources
from ..sources.migrations import read_migrations
from .enrichment import artifact_hash, covered, evidence_index, sections
from .facts import Facts, roles_of
from .material import Material
from .rollups import event_stats, use_case_rollup, use_cases

#: Messages of one sequence diagram, at most.
MOST_MESSAGES = 40


def relations(facts: Facts) -> dict[str, DataFrame]:
    nodes, edges = facts.call_graph()
    alternatives, guards = facts.flows()
    return {
        "entities": facts.entities(), "entry_points": facts.entry_points(), "call_nodes": nodes, "call_edges": edges, "assignment_sites": facts.assignment_sites(), "state_machines": facts.state_machines(), "event_flows": facts.event_flows(), "test_scenarios": facts.test_scenarios(),
        "throw_sites": facts.throw_sites(), "exception_statuses": facts.exception_statuses(), "input_constraints": facts.input_constraints(), "guard_checks": facts.guard_checks(), "alternative_flows": alternatives, "guards": guards,
    }


def sequence_diagrams(facts: Facts, alternatives: DataFrame | None = None) -> DataFrame:
    """entry_point, diagram: the depth-first trace of calls of each HTTP and event entry point, from whoever starts it to the outcome.

    alternatives: entry_point, exception_type, status, message, condition; each is a branch of the outcome of an HTTP entry point.
    """
    nodes, edges = facts.call_graph()
    answer = F.nullif(F.nullif("return_type", F.lit("void")), F.lit(""))
    nodes = nodes.select("id", F.col("class_name").alias("actor"), F.col("method").alias("label"), answer.alias("answer"))
    eps = facts.entry_points().where("category in ('http', 'event')").select(F.col("id").alias("entry_point"), "category", "destination", "method", "async", F.col("method_id").alias("root"))
    messages, ends = trace(edges.select("a", "b", "line"), nodes, eps.select("root").distinct(), MOST_MESSAGES)
    drawn = messages.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("step", "from", "to", "label", "back"))).alias("ms"))  # few more than MOST_MESSAGES
    e = eps.join(drawn, "root", "left").join(ends, "root", "left").join(nodes.select(F.col("id").alias("root"), F.col("actor").alias("own"), F.col("answer").alias("result")), "root")
    if alternatives is None:
        alternatives = facts.flows()[0]
    flows = alternatives.groupBy("entry_point").agg(F.array_sort(F.collect_list(F.struct("exception_type", "status", "condition", "message"))).alias("flows"))  # one row an exception type
    e = e.join(flows, "entry_point", "left")
    web, own = F.col("category") == "http", S.diagram_id(F.col("own"))
    later, to = ~web & F.col("async"), F.coalesce("destination", F.lit(""))
    starter = S.diagram_id(F.when(web, "Client").otherwise(F.coalesce("destination", F.lit("Event"))))
    label = S.diagram_label(F.when(web, S.entry_label(F.col("entry_point"))).otherwise(F.concat("method", F.lit("("), to, F.lit(")"))))
    actors = F.array_distinct(F.concat(F.array("own"), F.coalesce(F.transform(F.filter("ms", lambda m: ~m["back"]), lambda m: m["to"]), F.array().cast("array<string>"))))
    none, lit = F.array().cast("array<string>"), F.lit
    line = lambda m: F.concat(lit("  "), S.diagram_id(m["from"]), F.when(m["back"], "-->>").otherwise("->>"), S.diagram_id(m["to"]), lit(": "), S.diagram_label(m["label"]))
    some = lambda when, *text: F.when(when, F.array(F.concat(*text))).otherwise(none)
    ok = F.concat(own, lit("-->>Client: "), S.diagram_label(F.coalesce("result", lit("OK"))))
    reason = lambda f: F.coalesce(F.nullif(f["condition"], lit("")), F.nullif(f["message"], lit("")), f["exception_type"])
    branch = lambda f, k: F.array(F.concat(F.when(k == 0, "  alt ").otherwise("  else "), S.diagram_label(reason(f))), F.concat(lit("    "), own, lit("--xClient: "), S.diagram_label(F.concat(F.when(f["status"] == "—", "error").otherwise(f["status"]), lit(" ("), f["exception_type"], lit(")")))))
    outcome = F.when(F.coalesce(F.size("flows") > 0, lit(False)), F.concat(F.flatten(F.transform("flows", branch)), F.array(lit("  else success"), F.concat(lit("    "), ok), lit("  end")))).otherwise(F.array(F.concat(lit("  "), ok)))
    lines = F.concat(
        F.array(lit("sequenceDiagram"), F.concat(F.when(web, "  actor ").otherwise("  participant "), starter)), F.transform(actors, lambda a: F.concat(lit("  participant "), S.diagram_id(a))),
        F.array(F.concat(lit("  "), starter, F.when(later, "-)").otherwise("->>"), own, lit(": "), label)), some(later, lit("  Note over "), own, lit(": async, after commit")), F.coalesce(F.transform("ms", line), none),
        some(F.col("truncated"), lit("  Note over "), own, lit(": … sequence truncated")), F.when(web, outcome).otherwise(none),
    )
    return e.select("entry_point", F.array_join(lines, "\n").alias("diagram"))


def initial_states(sites: DataFrame) -> DataFrame:
    """enum_type, initial: the value that the first site outside of methods sets."""
    return sites.where("method is null and value is not null").groupBy("enum_type").agg(F.min_by("value", F.struct("file", "line")).alias("initial"))


def state_diagrams(facts: Facts, transitions: DataFrame | None = None) -> DataFrame:
    """enum_type, diagram: the first state - the one that a constructor sets, else the least - and the transitions (from, to, trigger, evidence) at sites of the machine; without any, the states."""
    sites = facts.assignment_sites()
    m = facts.state_machines().join(initial_states(sites), "enum_type", "left")
    begin = F.concat(F.lit("  [*] --> "), S.diagram_id(F.coalesce("initial", F.get("states", F.lit(0)), F.lit("start"))))
    if transitions is None:
        m = m.withColumn("ts", F.array().cast("array<struct<line:string>>"))
    else:
        text = F.concat(F.lit("  "), S.diagram_id(F.col("from")), F.lit(" --> "), S.diagram_id(F.col("to")), F.lit(" : "), S.diagram_label(F.col("trigger")))
        t = transitions.select(F.col("evidence.file").alias("file"), F.col("evidence.line").alias("line"), F.struct("task", "pos", text.alias("line")).alias("t"))
        own = sites.select("enum_type", "file", "line").distinct().join(t, ["file", "line"]).groupBy("enum_type").agg(F.array_sort(F.collect_list("t")).alias("ts"))  # one machine's transitions
        m = m.join(own, "enum_type", "left")
    shown = F.transform("states", lambda s: F.concat(F.lit("  "), S.diagram_id(s)))
    body = F.when(F.coalesce(F.size("ts") > 0, F.lit(False)), F.transform("ts", lambda x: x["line"])).otherwise(shown)
    return m.select("enum_type", F.array_join(F.concat(F.array(F.lit("stateDiagram-v2"), begin), body), "\n").alias("diagram"))


#: How a kind of relation is drawn.
CARDINALITY = {"OneToMany": "||--o{", "ManyToOne": "}o--||", "OneToOne": "||--||", "ManyToMany": "}o--o{"}


def modules(entities: DataFrame) -> DataFrame:
    """Adds module: the folder right below those that all entities' files share, or core."""
    folders = F.slice(F.split("file", "/"), F.lit(1), F.size(F.split("file", "/")) - 1)
    lo, hi = entities.agg(F.min(folders), F.max(folders)).first()  # two paths; what they share, all share
    shared = next((k for k, (x, y) in enumerate(zip(lo or [], hi or [])) if x != y), min(len(lo or []), len(hi or [])))
    return entities.withColumn("module", F.coalesce(F.get(folders, F.lit(shared)), F.lit("core")))


def within_module(relations: DataFrame, entities: DataFrame, module: str = "module") -> DataFrame:
    """Relations (module, target) whose target is an entity (module, entity) of the same module."""
    return relations.join(entities.select(module, F.col("entity").alias("target")).distinct(), [module, "target"], "left_semi")


def er_text(fields: DataFrame, relations: DataFrame) -> DataFrame:
    """module, diagram of fields (module, entity, field, type, id) and relations (module, entity, field, kind, target); relations to what the module doesn't hold are left out."""
    entities = fields.select("module", "entity").union(relations.select("module", "entity")).distinct()
    name = S.diagram_id(F.col("entity"))
    line = lambda section, kind, field, *text: F.struct(F.lit(section).alias("section"), F.col("entity"), F.lit(kind).alias("kind"), field.alias("field"), F.concat(*text).alias("line"))
    none = F.lit("")
    heads = entities.select("module", F.explode(F.array(line(0, 0, none, F.lit("  "), name, F.lit(" {")), line(0, 2, none, F.lit("  }")))).alias("l"))
    held = fields.where("field is not null").select("module", line(0, 1, F.col("field"), F.lit("    "), S.diagram_type(F.col("type")), F.lit(" "), S.diagram_id(F.col("field")), F.when(F.col("id"), " PK").otherwise("")).alias("l"))
    inside = within_module(relations, entities)
    drawn = F.coalesce(F.create_map(*[F.lit(x) for kv in CARDINALITY.items() for x in kv])[F.col("kind")], F.lit("||..||"))
    tied = inside.select("module", line(1, 0, F.col("field"), F.lit("  "), name, F.lit(" "), drawn, F.lit(" "), S.diagram_id(F.col("target")), F.lit(' : "'), S.diagram_label(F.col("field")), F.lit('"')).alias("l"))
    lines = heads.union(held).union(tied).groupBy("module").agg(F.array_sort(F.collect_list("l")).alias("ls"))  # a module's own lines
    return lines.select("module", F.concat_ws("\n", F.array(F.lit("erDiagram")), F.transform("ls", lambda x: x["line"])).alias("diagram"))


def er_diagrams(entities: DataFrame) -> DataFrame:
    """module, diagram: the entities of each module with their fields, and the relations within it."""
    e = modules(entities)
    fields = e.select("module", F.col("name").alias("entity"), F.explode_outer("fields").alias("f")).select("module", "entity", F.col("f.name").alias("field"), "f.type", "f.id")
    relations = e.select("module", F.col("name").alias("entity"), F.explode("relations").alias("r")).select("module", "entity", "r.field", "r.kind", "r.target")
    return er_text(fields, relations)


def event_flowchart(flows: DataFrame, entry_points: DataFrame) -> DataFrame:
    """One row, diagram: events between the classes that publish them and those that listen, later listeners dashed."""
    event, box = S.diagram_id(F.concat(F.lit("E_"), "event")), S.diagram_id(F.concat(F.lit("N_"), "class"))
    made = flows.select("event", F.explode("producers").alias("party")).select("event", F.substring_index("party", "#", 1).alias("class"))
    heard = entry_points.where("category = 'event' and destination is not null").select(F.col("destination").alias("event"), F.col("class_name").alias("class"), "async")
    named = flows.select(F.concat(F.lit("  "), event, F.lit('{{"'), S.diagram_label(F.col("event")), F.lit('"}}')).alias("line"))
    classes = made.select("class").union(heard.select("class")).select(F.concat(F.lit("  "), box, F.lit('["'), S.diagram_label(F.col("class")), F.lit('"]')).alias("line"))
    out = made.select(F.concat(F.lit("  "), box, F.lit(" -->|publishes| "), event).alias("line"))
    into = heard.select(F.concat(F.lit("  "), event, F.when(F.col("async"), " -.->|async| ").otherwise(" --> "), box).alias("line"))
    lines = _union([x.select(F.lit(k).alias("k"), "line") for k, x in enumerate((named, classes, out, into))]).distinct()
    return lines.agg(F.concat_ws("\n", F.array(F.lit("flowchart LR")), F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"])).alias("diagram"))  # one project's events


def domain_map(domains: DataFrame) -> DataFrame:
    """domain, text: a branch of the map of domains (domain, members)."""
    plain = lambda c: F.coalesce(F.nullif(S.one_line(F.regexp_replace(c, r'[()\[\]{}"]', " ")), F.lit("")), F.lit("unknown"))
    return domains.select("domain", F.concat_ws("\n", F.array(F.concat(F.lit("    "), plain(F.col("domain")))), F.transform("members", lambda m: F.concat(F.lit("      "), plain(m)))).alias("text"))


def use_case_cards(entry_points: DataFrame, alternatives: DataFrame, guards: DataFrame, constraints: DataFrame, diagrams: DataFrame) -> DataFrame:
    """entry_point, category, class_name, method, async, alternatives (exception_type, status, detail), checks (field, constraint), diagram: one wide row for each entry point."""
    flows = alternatives.groupBy("entry_point").agg(F.array_sort(F.collect_list(F.struct("exception_type", "status", S.flow_detail(F.col("condition"), F.col("message")).alias("detail")))).alias("alternatives"))
    checks = constraints.select("entry_point", "field", "constraint").union(guards.select("entry_point", "field", "constraint")).groupBy("entry_point").agg(F.array_sort(F.collect_set(F.struct("field", "constraint"))).alias("checks"))
    eps = entry_points.select(F.col("id").alias("entry_point"), S.category_label(F.col("category")).alias("category"), "class_name", "method", "async")
    out = eps.join(flows, "entry_point", "left").join(checks, "entry_point", "left").join(diagrams, "entry_point", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select("entry_point", "category", "class_name", "method", "async", empty("alternatives"), empty("checks"), "diagram")


def unclassified(entry_points: DataFrame, covered: DataFrame, key: str = "id") -> DataFrame:
    """Entry points that nothing covers; covered has their key as its only column."""
    return entry_points.join(covered.select(F.col(covered.columns[0]).alias(key)), key, "left_anti")


def domains_by_role(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """domain, members: the classes of each role, for want of an interpretation."""
    c = nodes.select(F.col("role").alias("domain"), F.col("class_name").alias("member")).union(entities.select(F.lit("domain"), "name"))
    return c.groupBy("domain").agg(F.array_sort(F.collect_set("member")).alias("members"))


def test_catalogue(scenarios: DataFrame) -> DataFrame:
    """test_class, text: a test class, what it tests and its scenarios, one a line."""
    s = scenarios.groupBy("test_class", "target", "certain").agg(F.array_sort(F.collect_list(F.struct("line", "description"))).alias("s"))
    head = F.concat("test_class", F.lit(" → "), F.coalesce("target", F.lit("—")), F.when(F.col("certain"), "").otherwise(" (?)"))
    return s.select("test_class", F.array_join(F.concat(F.array(head), F.transform("s", lambda x: F.concat(F.lit("  "), x["description"]))), "\n").alias("text"))


def git_facts(root: str) -> dict[str, str]:
    def git(*args: str, missing: str) -> str:
        try:
            return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=20, check=True).stdout.strip() or missing
        except (OSError, subprocess.SubprocessError):
            return missing

    return {"commit": git("rev-parse", "HEAD", missing="uncommitted"), "generated_at": git("log", "-1", "--format=%cI", missing="1970-01-01T00:00:00Z"), "message": git("log", "-1", "--format=%s", missing="")}


def publish(spark: SparkSession, out: str, made: dict[str, DataFrame], last: dict[str, dict]) -> dict[str, dict]:
    """Write the tables of made below out, but those that are as they were by the hashes of last; name -> hash, rows, path, written.

    A table is written to the shared folder first, hashed there, and copied only if it differs.
    """
    told = {}
    for name, df in made.items():
        new = cut(df, name)
        digest, was = artifact_hash(new).first()[0], last.get(name)
        same = bool(was) and was["hash"] == digest
        rows = was["rows"] if same else new.count()
        if not same:
            new.write.mode("overwrite").parquet(f"{out}/{name}")
        drop(new)
        told[name] = {"hash": digest, "rows": rows, "path": f"{out}/{name}", "written": not same}
    return told


def last_manifest(spark: SparkSession, out: str) -> dict[str, dict]:
    """name -> hash, rows of the tables that the last manifest below out names; nothing without one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/manifest")
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return {}
    return {r["name"]: {"hash": r["hash"], "rows": r["rows"]} for r in spark.read.json(f"{out}/manifest", schema=MANIFEST).where("kind = 'artifact'").collect()}  # a row a table


MANIFEST = "kind string, name string, hash string, rows long, path string, model string, info string"


def index(spark: SparkSession, root: str, out: str, exclude: tuple = (), mode: str = "none", results: DataFrame | None = None, chunk: int = 0) -> dict:
    """Publish every relation of the service at root below out, and the interpretations that mode asks for; return the manifest.

    mode none: interpretations are empty. emit: prompts that results doesn't answer are written below out/requests. assemble:
    the answers in results (source_hash, prompt_version, model, answer) are gated and published. Tables that didn't change
    since the last manifest aren't written again, and the new manifest is written last: rows of kind, name, hash, rows, path
    and model. Only hashes and counts reach the driver.
    """
    last = last_manifest(spark, out)
    with Facts(read_sources(spark, root, exclude)) as facts:
        made = {**relations(facts), "foreign_keys": read_migrations(spark, root)}
        nodes, eps, entities, flows = made["call_nodes"], made["entry_points"], made["entities"], made["event_flows"]
        material = Material(facts)
        evidence = facts._once("evidence", lambda: evidence_index(facts))
        asked = {"transitions": material.transitions(), "domains": material.domains(), "behaviours": material.behaviours(chunk)}
        asked = {name: facts._once(f"material-{name}", lambda df=df: df) for name, df in asked.items()}
        read = {name: (facts._once(f"interpreted-{name}", lambda df=df: df), told) for name, (df, told) in sections(asked, evidence, mode, results, f"{out}/requests").items()}
        diagrams = facts._once("diagrams", lambda: sequence_diagrams(facts, made["alternative_flows"]))
        domains, behaviours = read["domains"][0], read["behaviours"][0]
        made |= {
            "sequence_diagrams": diagrams, "state_diagrams": state_diagrams(facts, read["transitions"][0]), "classes_by_role": roles_of(nodes), "er_diagrams": er_diagrams(entities), "event_flowchart": event_flowchart(flows, eps), "test_catalogue": test_catalogue(made["test_scenarios"]),
            "domain_map": domain_map(domains_by_role(nodes, entities) if domains.isEmpty() else domains), "use_case_cards": use_case_cards(eps, made["alternative_flows"], made["guards"], made["input_constraints"], diagrams),
            "use_case_rollup": use_case_rollup(use_cases(behaviours, eps)), "event_stats": event_stats(flows), "unclassified": unclassified(eps, covered(behaviours)), **{f"enrichment_{name}": df for name, (df, _) in read.items()},
        }
        artifacts = publish(spark, out, made, last)
        models = {name: [r.asDict() for r in told.select("task", "source_hash", "model").collect()] for name, (_, told) in read.items()}  # a row a prompt
    project = {"name": root.rstrip("/").rpartition("/")[2], **git_facts(root)}
    rows = [("project", project["name"], project["commit"], None, root, None, json.dumps(project, sort_keys=True))]
    rows += [("artifact", name, a["hash"], a["rows"], a["path"], None, None) for name, a in sorted(artifacts.items())]
    rows += [("enrichment", r["task"], r["source_hash"], None, f"{out}/enrichment_{name}", r["model"], None) for name, rs in sorted(models.items()) for r in sorted(rs, key=lambda r: r["task"])]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{out}/manifest")
    return {"project": project, "artifacts": artifacts, "enrichment": models}


def report(spark: SparkSession, out: str) -> DataFrame:
    """section, html: the report's rows, made from the published tables and escaped; a page is their concatenation."""
    cell = lambda *c: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), S.html_escape(F.coalesce(F.col(x).cast("string"), F.lit("—"))), F.lit("</td>")) for x in c], F.lit("</tr>"))
    parts = [("entry_points", ["id", "class_name", "method", "file", "line"]), ("alternative_flows", ["entry_point", "exception_type", "status", "message"]), ("input_constraints", ["entry_point", "field", "constraint", "detail"]), ("test_scenarios", ["test_class", "target", "certain", "description"]), ("sequence_diagrams", ["entry_point", "diagram"]), ("state_diagrams", ["enum_type", "diagram"]), ("er_diagrams", ["module", "diagram"]), ("event_flowchart", ["diagram"]), ("domain_map", ["domain", "text"]), ("test_catalogue", ["test_class", "text"]), ("use_case_rollup", ["level", "category", "feature", "total", "gaps", "critical_gaps", "verified"]), ("unclassified", ["id", "class_name", "method"])]
    return _union([spark.read.parquet(f"{out}/{name}").select(F.lit(name).alias("section"), cell(*columns).alias("html")) for name, columns in parts])


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.union(f)
    return whole
