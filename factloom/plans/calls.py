"""Callees of calls: every expression is a node named by the place of its last token, and types spread along the chains.

A name is typed by its declaration, `this` and calls on nothing by their class, `new` by what it makes; what follows a dot
waits for the type of what stands before it, and so does the parameter of a lambda that a collection, Stream or Optional
takes, or the `var` of a loop, for the elements it goes over. typed_chains() carries the types from receiver to member round by round, so
`a.b().c()` takes three. Members are a type's own, then its supertypes' and the class's around it; among overloads of a
name those with as many parameters count, and of these the one whose parameter types the arguments have most often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.graph import reach, typed_chains
from ..operators.relational import first_wins

#: Words of the language that aren't names, and those that a call may follow.
KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "super", "this", "synchronized", "new", "throw", "try", "else", "do", "case", "instanceof", "assert", "yield", "null", "true", "false", "final", "var", "class", "void", "break", "continue", "default")
BEFORE_CALL = ("return", "else", "do", "case", "throw", "assert", "yield", "when")
#: Library types that hold elements of their type argument.
COLLECTIONS = ("Iterable", "Collection", "List", "ArrayList", "LinkedList", "Set", "HashSet", "LinkedHashSet", "SortedSet", "TreeSet", "Queue", "Deque")
#: Members of library types that give the type argument,
UNWRAPS = {"Optional": ("get", "orElse", "orElseGet", "orElseThrow"), "List": ("get", "getFirst", "getLast"), "ArrayList": ("get",), "LinkedList": ("get", "getFirst", "getLast"), "SortedSet": ("first", "last"), "TreeSet": ("first", "last"), "Queue": ("peek", "poll", "element"), "Deque": ("peek", "poll", "getFirst", "getLast"), "Iterator": ("next",), "Supplier": ("get",)}
#: a type with the same argument,
TURNS = {
    "Optional": {"filter": "Optional", "or": "Optional", "stream": "Stream"},
    "Stream": {"filter": "Stream", "peek": "Stream", "sorted": "Stream", "distinct": "Stream", "limit": "Stream", "skip": "Stream", "takeWhile": "Stream", "dropWhile": "Stream", "parallel": "Stream", "sequential": "Stream", "findFirst": "Optional", "findAny": "Optional", "min": "Optional", "max": "Optional", "toList": "List", "iterator": "Iterator"},
    **{c: {"stream": "Stream", "parallelStream": "Stream", "iterator": "Iterator"} for c in COLLECTIONS},
}
#: or the argument to the lambda that comes first.
LAMBDAS = {
    "Optional": ("map", "flatMap", "filter", "ifPresent", "ifPresentOrElse"),
    "Stream": ("map", "flatMap", "mapToInt", "mapToLong", "mapToDouble", "filter", "peek", "forEach", "forEachOrdered", "anyMatch", "allMatch", "noneMatch", "takeWhile", "dropWhile"),
    "Iterator": ("forEachRemaining",),
    **{c: ("forEach", "removeIf", "replaceAll") for c in COLLECTIONS},
}
#: Boxes of the simple types.
BOXES = {"Integer": "int", "Long": "long", "Short": "short", "Byte": "byte", "Boolean": "boolean", "Double": "double", "Float": "float", "Character": "char"}

WORD = r"^[A-Za-z_$][\w$]*$"


def node(at) -> F.Column:
    return F.concat_ws(":", "file", at.cast("string"))


def name_of(c):
    return c.rlike(WORD) & ~c.isin(*KEYWORDS)


def callee(member, outside):
    """What a call leads to: the project's method, else external: and the collaborator's type and method, else nothing."""
    return F.coalesce(member, F.concat(F.lit("external:"), outside))


def creations(code: DataFrame) -> DataFrame:
    """The rows of code that are the parenthesis of `new a.b.Type<..>(`, with made: Type."""
    w = Window.partitionBy("file", "parent").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    other = F.sum(F.when(F.col("tok").rlike(r"^([A-Za-z_$][\w$]*|[.<>,?&\[\]])$"), 0).otherwise(1)).over(w)
    d = code.withColumn("other", other)
    d = d.withColumn("at_new", F.last(F.when(F.col("tok") == "new", F.col("other")), ignorenulls=True).over(w))
    d = d.withColumn("made", F.last(F.when(F.col("n1").isin("(", "<") & F.col("p1").isin("new", ".") & name_of(F.col("tok")), F.col("tok")), ignorenulls=True).over(w))
    return d.where("tok = '(' and other - 1 = at_new and made is not null").drop("other", "at_new")


def calls(code: DataFrame, made: DataFrame, sizes: DataFrame) -> DataFrame:
    """caller, owner (type_id), file, line, name, open, node, receiver (node; null: none), field (f of f.name() and this.f.name()), size of each call in a method."""
    c = code.where(F.col("tok") == "(").where(name_of(F.col("p1")) & ~F.coalesce(F.col("p2").isin("new", "@", "::"), F.lit(False)))
    c = c.where(~F.coalesce(F.col("p2").rlike(WORD) & ~F.col("p2").isin(*BEFORE_CALL), F.lit(False)))
    c = c.join(made.select("file", "pos"), ["file", "pos"], "left_anti").withColumnRenamed("pos", "open").join(sizes, ["file", "open"], "left")
    dotted = F.col("p2") == "."
    bare = F.coalesce(F.col("p4") != ".", F.lit(True)) | ((F.col("p4") == ".") & (F.col("p5") == "this"))
    return c.select("caller", "owner", "file", "line", F.col("p1").alias("name"), "open", node(F.col("partner")).alias("node"), F.when(dotted, node(F.col("open") - 3)).alias("receiver"), F.when(dotted & bare & name_of(F.col("p3")), F.col("p3")).alias("field"), F.coalesce("size", F.lit(0)).alias("size"))


def heads(code: DataFrame, args: DataFrame, called: DataFrame, statements: DataFrame, braces: DataFrame) -> DataFrame:
    """file, caller, name, at, stop, receiver, of: names without a type of their own, from at to stop what member `of` of receiver gives.

    These are the one parameter of a lambda that a call takes first (of: `call(x)`) and the `var` of a loop (of: `(each)`).
    """
    first = args.where("nth = 0").where((F.get("shape", F.lit(1)) == "->") | (F.get("shape", F.lit(2)) == "->")).select("file", "open", F.col("start").alias("pos"), "stop")
    name = F.when(name_of(F.col("tok")) & (F.col("n1") == "->"), F.col("tok")).when((F.col("tok") == "(") & name_of(F.col("n1")) & (F.col("n2") == ")") & (F.col("n3") == "->"), F.col("n1"))
    given = first.join(code.select("file", "pos", "caller", name.alias("param")), ["file", "pos"]).where("param is not null")
    given = given.join(called.where("receiver is not null").select("file", "open", "receiver", "name"), ["file", "open"])
    given = given.select("file", "caller", F.col("param").alias("name"), F.col("pos").cast("int").alias("at"), F.col("stop").cast("int").alias("stop"), "receiver", F.concat("name", F.lit("(x)")).alias("of"))
    loops = code.where(name_of(F.col("tok")) & (F.col("p1") == "var") & (F.col("n1") == ":")).select("file", "caller", F.col("tok").alias("name"), F.col("pos").alias("at"), "n", "parent")
    loops = loops.join(code.where("tok = '('").select("file", F.col("pos").alias("parent"), node(F.col("partner") - 1).alias("receiver")), ["file", "parent"])
    loops = loops.join(statements.select("file", "n", "stop"), ["file", "n"]).join(braces, ["file", "stop"], "left")
    return given.union(loops.select("file", "caller", "name", F.col("at").cast("int"), F.coalesce("close", "stop").cast("int"), "receiver", F.lit("(each)")))


def scoped(names: DataFrame, bound: DataFrame) -> DataFrame:
    """names (file, pos, caller, name) with receiver and of: those of the last of heads() of that name before it, if it lies before its stop.

    Lambdas of one name in one method can't lie in each other, so the last is the only one that can hold.
    """
    h = bound.select("file", "caller", "name", F.col("at").alias("pos"), F.lit(0).alias("order"), F.struct("stop", "receiver", "of").alias("head"))
    rows = names.select("file", "caller", "name", "pos", F.lit(1).alias("order")).unionByName(h, allowMissingColumns=True)
    last = F.last("head", ignorenulls=True).over(Window.partitionBy("file", "caller", "name").orderBy("pos", "order"))
    out = rows.withColumn("head", last).where("order = 1")
    holds = F.col("pos") <= F.col("head.stop")
    return out.select("file", "pos", "caller", "name", F.when(holds, F.col("head.receiver")).alias("receiver"), F.when(holds, F.col("head.of")).alias("of"))


def type_names(uses: DataFrame, types: DataFrame, statements: DataFrame) -> DataFrame:
    """file, simple, type_id of the project's type that each name in uses (file, simple) means there: of the same file, imported, of the same package, else the first."""
    package = types.select("file", "package").distinct()
    imported = statements.where("startswith(text, 'import ')").select("file", F.regexp_replace(F.regexp_replace("text", r"^import (static )?", ""), " ", "").alias("type_id"), F.lit(True).alias("told")).distinct()
    u = uses.distinct().join(package.groupBy("file").agg(F.min("package").alias("own")), "file", "left")
    t = types.select("simple", "type_id", "package", F.col("file").alias("home"), F.col("line").alias("row"))
    c = u.join(t, "simple").join(imported, ["file", "type_id"], "left")
    near = F.when(F.col("home") == F.col("file"), 0).when(F.col("told"), 1).when(F.col("package").eqNullSafe(F.col("own")), 2).otherwise(3)
    return first_wins(c.withColumn("near", near), ["file", "simple"], ["near", "home", "row"]).select("file", "simple", "type_id")


def _first_argument(text):
    """The simple name of the first type argument of a type without blanks."""
    return F.nullif(S.simple_type_name(F.regexp_extract(text, r"^[^<]*<([^<>,]*)", 1)), F.lit(""))


def supertypes(types: DataFrame, names) -> DataFrame:
    """type_id, super, level: the project's types that a type extends, implements or lies in, however far; level 0 is itself."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("head", r"<[^<>]*>", ""), r"<[^<>]*>", ""), r"<[^<>]*>", "")
    listed = F.split(F.regexp_replace(F.regexp_extract(plain, r" (?:extends|implements) (.*?)(?: permits .*)?$", 1), " (extends|implements) ", ","), ",")
    s = types.select("file", "type_id", F.explode(listed).alias("simple")).withColumn("simple", S.simple_type_name(F.replace(F.trim("simple"), F.lit(" "), F.lit("")))).where("simple <> ''")
    s = s.withColumnRenamed("type_id", "a").join(names.withColumnRenamed("type_id", "b"), ["file", "simple"]).select("a", "b")
    inside = types.join(types.select("file", F.col("open").alias("parent"), F.col("type_id").alias("b")), ["file", "parent"]).select(F.col("type_id").alias("a"), "b")
    near = reach(s.union(inside), types.select(F.col("type_id").alias("root")).distinct())
    return near.select(F.col("root").alias("type_id"), F.col("node").alias("super"), (F.col("root") != F.col("node")).cast("int").alias("level"))


def resolved(f) -> DataFrame:
    """The calls of facts f with member: the id of the method that each calls, null if the project has none."""
    code, made, args = f.code, f.creations(), f.arguments()
    sizes = args.groupBy("file", "open").agg(F.count("*").cast("int").alias("size"))
    c = calls(code.where("method is not null"), made, sizes)
    receivers = f.receivers()
    words = code.where(name_of(F.col("tok")) & (F.coalesce(F.col("n1"), F.lit("")) != "("))
    plain = words.where("coalesce(p1, '') <> '.'").select("file", "pos", "caller", F.col("tok").alias("name"))
    used = f._once("names_used", lambda: scoped(plain, heads(code, args, c, f.statements, f._braces())))
    plain, bound = used.where("receiver is null").select("file", "pos", "caller", "name"), used.where("receiver is not null")
    uses = [f.methods.select("file", F.col("return_type").alias("simple")), f.methods.select("file", _first_argument(F.col("return_text")).alias("simple")), f.fields.select("file", S.simple_type_name(F.col("type")).alias("simple")), f.fields.select("file", _first_argument(F.col("type")).alias("simple")),
            receivers.select("file", F.col("type").alias("simple")), receivers.select("file", F.col("argument").alias("simple")), plain.where("name rlike '^[A-Z]'").select("file", F.col("name").alias("simple")), made.select("file", F.col("made").alias("simple")), f.types.select("file", F.explode(F.regexp_extract_all("head", F.lit(r"\w+"), 0)).alias("simple"))]
    whole = uses[0]
    for u in uses[1:]:
        whole = whole.union(u)
    names = f._once("type_names", lambda: type_names(whole.where("simple is not null"), f.types, f.statements))

    def meant(df, column):
        """column as the id of the project's type, where there is one."""
        t = names.select("file", F.col("simple").alias(column), F.col("type_id").alias("id__"))
        return df.join(t, ["file", column], "left").withColumn(column, F.coalesce("id__", column)).drop("id__")

    none = F.lit(None).cast("string")
    kinds = meant(meant(receivers.select("caller", "receiver", "file", "type", "argument"), "type"), "argument")
    variables = plain.join(kinds.select("caller", F.col("receiver").alias("name"), "type", "argument"), ["caller", "name"])
    static = plain.join(kinds.select("caller", F.col("receiver").alias("name")), ["caller", "name"], "left_anti").join(names.select("file", F.col("simple").alias("name"), F.col("type_id").alias("type")), ["file", "name"])
    cast = code.where("tok = '(' and n1 = '(' and n3 = ')' and n2 rlike '^[A-Z]'").select("file", node(F.col("partner")).alias("node"), F.col("n2").alias("type"))
    known = f.types.select(F.concat(F.lit("type:"), "type_id").alias("node"), F.col("type_id").alias("type"), none.alias("argument")).distinct()
    known = known.union(code.where("tok = 'this'").select(node(F.col("pos")), "owner", none)).union(variables.select(node(F.col("pos")), "type", "argument")).union(static.select(node(F.col("pos")), "type", none))
    known = known.union(meant(made.select("file", node(F.col("partner")).alias("node"), F.col("made").alias("type")), "type").select("node", "type", none)).union(meant(cast, "type").select("node", "type", none))

    links = words.where("p1 = '.'").select(node(F.col("pos")).alias("node"), node(F.col("pos") - 2).alias("receiver"), F.concat(F.lit("."), "tok").alias("name"), F.lit(-1).alias("size"))
    links = links.union(c.select("node", F.coalesce("receiver", F.concat(F.lit("type:"), "owner")), "name", "size"))
    inferred = f.statements.where(r"text rlike '^(final )?var \\w+ = '").select("file", "start", "n", F.regexp_extract("text", r"^(?:final )?var (\w+) = ", 1).alias("name"), node(F.col("stop") - 1).alias("receiver"))
    inferred = inferred.join(code.select("file", F.col("pos").alias("start"), "caller"), ["file", "start"]).select("caller", "name", "receiver")
    links = links.union(plain.join(first_wins(inferred, ["caller", "name"], ["receiver"]), ["caller", "name"]).select(node(F.col("pos")), "receiver", none, F.lit(-1)))
    links = links.union(bound.select(node(F.col("pos")), "receiver", "of", F.lit(-1)))

    order = F.concat("file", F.lpad(F.col("start").cast("string"), 9, "0"))
    m = meant(meant(f.methods.select("file", "start", "type_id", "name", F.size("params").alias("size"), F.col("return_type").alias("result"), _first_argument(F.col("return_text")).alias("argument"), F.col("id").alias("member"), F.col("params")), "result"), "argument").withColumn("rank", order)
    fields = meant(meant(f.fields.select("file", "type_id", F.concat(F.lit("."), "name").alias("name"), F.lit(-1).alias("size"), S.simple_type_name(F.col("type")).alias("result"), _first_argument(F.col("type")).alias("argument"), none.alias("member")), "result"), "argument").withColumn("rank", F.lit(""))
    own = m.select("type_id", "name", "size", "rank", "result", "argument", "member", "params").unionByName(fields.select("type_id", "name", "size", "rank", "result", "argument", "member").withColumn("params", F.lit(None).cast(m.schema["params"].dataType)))
    above = f._once("supertypes", lambda: supertypes(f.types, names))
    members = own.withColumnRenamed("type_id", "super").join(above, "super").withColumn("rank", F.concat(F.col("level").cast("string"), "rank")).withColumnRenamed("type_id", "type")
    library = [(t, n, None) for t, ns in UNWRAPS.items() for n in ns] + [(t, n, r) for t, ns in TURNS.items() for n, r in ns.items()] + [(t, f"{n}(x)", None) for t, ns in LAMBDAS.items() for n in ns] + [(t, "(each)", None) for t in COLLECTIONS]
    library = f.types.sparkSession.createDataFrame([(t, n, 0, "9", r, "*", None) for t, n, r in library],"type string, name string, size int, rank string, result string, argument string, member string")
    members = f._once("members", lambda: members)
    typed = f._once("typed", lambda: typed_chains(known, links, members.select(*library.columns).union(library)))
    c = c.join(typed.select("node", "member"), "node", "left")

    # overloads with as many parameters: by the types of the arguments
    held = typed.select("node", F.col("type").alias("holder"))
    several = members.where("member is not null").groupBy("type", "name", "size").agg(F.count("*").alias("n")).where("n > 1 and size > 0").drop("n")
    doubtful = c.where("member is not null").select("file", "open", "node", "name", "size", F.coalesce("receiver", F.concat(F.lit("type:"), "owner")).alias("on")).join(held.withColumnRenamed("node", "on"), "on").join(several.withColumnRenamed("type", "holder"), ["holder", "name", "size"])
    shape = F.array_join("shape", " ")
    literal = F.when(shape.rlike(r'^"'), "String").when(shape.rlike(r"^\d[\d_]*$"), "int").when(shape.rlike(r"^\d[\d_]*[lL]$"), "long").when(shape.rlike(r"^\d*\.\d+$"), "double").when(shape.isin("true", "false"), "boolean").when(shape.rlike("^'"), "char")
    chain = shape.rlike(r"^(new )?[\w$]+( \( \))?( < [\w , ?]*> \( \))?( \. [\w$]+( \( \))?)*$")
    given = args.join(doubtful.select("file", "open", F.col("node").alias("call")), ["file", "open"]).select("call", "nth", F.when(F.size("shape") == 1, literal).alias("literal"), F.when(chain, node(F.col("stop"))).alias("node"))
    simple = lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in BOXES.items() for x in kv])[S.last_segment(c)], S.last_segment(c))
    given = given.join(held, "node", "left").select("call", "nth", simple(F.coalesce("literal", "holder")).alias("has"))
    could = doubtful.select(F.col("node").alias("call"), "holder", "name", "size").join(members.where("member is not null").select(F.col("type").alias("holder"), "name", "size", "rank", "member", F.posexplode("params").alias("nth", "p")), ["holder", "name", "size"])
    fits = could.join(given, ["call", "nth"], "left").groupBy("call", "member", "rank").agg(F.count_if(simple(F.col("p.type")) == F.col("has")).alias("fit"))
    best = first_wins(fits, ["call"], [F.col("fit").desc(), "rank", "member"]).select(F.col("call").alias("node"), F.col("member").alias("better"))
    return c.join(best, "node", "left").withColumn("member", F.coalesce("better", "member")).drop("better")
