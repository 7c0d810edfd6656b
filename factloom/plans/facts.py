"""Facts of a Java service, as joins over its tokens and statements.

types, methods and fields come from patterns over statements, what lies inside what from the partners of brackets; calls
and assignments from neighbouring tokens; callees are resolved by types that spread along call chains (calls.py). What
resolves to no method of the project ends at the collaborator's type, or is dropped: nothing is guessed. All tables are
sorted where they leave the engine, not here. Tables that others build on are written once to the shared folder; close()
deletes them.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.graph import reach, reached
from ..operators.nesting import arguments, innermost
from ..operators.relational import first_wins, with_certain
from ..operators.tables import cut, drop
from ..sources.java import cut_text, statements, tokens
from . import calls as C

#: frameworks' names.
VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
RELATIONS = ("OneToOne", "OneToMany", "ManyToOne", "ManyToMany")
LISTENERS = ("ApplicationModuleListener", "TransactionalEventListener", "EventListener")
BROKERS = {"KafkaListener": "topics", "RabbitListener": "queues", "JmsListener": "destination", "SqsListener": "value", "ServiceActivator": "inputChannel"}
PUBLISHERS = ("publishEvent", "registerEvent", "register", "publish", "send", "convertAndSend", "emit")
EVENT_SUFFIXES = ("Event", "Created", "Updated", "Deleted", "Removed", "Added", "Changed", "Confirmed", "Cancelled", "Canceled", "Closed", "Opened", "Issued", "Returned", "Recorded", "Consumed", "Placed", "Shipped", "Delivered", "Paid", "Completed", "Started", "Registered")
VALUES = (
    "String", "CharSequence", "Integer", "Long", "Short", "Byte", "Boolean", "Double", "Float", "Character", "BigDecimal", "BigInteger", "Number", "List", "Set", "Map", "Collection", "Optional", "Stream", "UUID", "LocalDate", "LocalDateTime", "LocalTime", "Instant", "Duration", "Object",
    "ArrayList", "LinkedList", "ArrayDeque", "Vector", "Stack", "Queue", "Deque", "HashMap", "LinkedHashMap", "TreeMap", "ConcurrentHashMap", "HashSet", "LinkedHashSet", "TreeSet", "CopyOnWriteArrayList", "CopyOnWriteArraySet", "AtomicInteger", "AtomicLong", "AtomicReference", "AtomicBoolean",
    "int", "long", "short", "byte", "boolean", "double", "float", "char",
)
#: Roles of classes, by annotation or else by the end of the name; the first that fits.
ROLES = (("controller", ("RestController", "Controller"), ("Controller",)), ("service", ("Service",), ("Service", "Factory")), ("repository", ("Repository",), ("Repository",)), ("domain", ("Entity", "Embeddable"), ()))
TEST_SUFFIXES = ("ITCase", "Tests", "Test", "IT")

#: Status labels, validation annotations, guard calls and what they demand.
STATUS = {"OK": "200 OK", "CREATED": "201 CREATED", "NO_CONTENT": "204 NO_CONTENT", "BAD_REQUEST": "400 BAD_REQUEST", "UNAUTHORIZED": "401 UNAUTHORIZED", "FORBIDDEN": "403 FORBIDDEN", "NOT_FOUND": "404 NOT_FOUND", "CONFLICT": "409 CONFLICT", "UNPROCESSABLE_ENTITY": "422 UNPROCESSABLE_ENTITY", "INTERNAL_SERVER_ERROR": "500 INTERNAL_SERVER_ERROR"}
CONSTRAINTS = ("NotNull", "NotBlank", "NotEmpty", "Size", "Min", "Max", "Positive", "PositiveOrZero", "Negative", "NegativeOrZero", "Email", "Pattern", "Past", "PastOrPresent", "Future", "FutureOrPresent", "DecimalMin", "DecimalMax", "Digits", "AssertTrue", "AssertFalse", "Valid")
GUARD_HOLDERS = ("Guard", "Objects", "Assert", "Preconditions", "Validate")
GUARDS = {"requireNonNull": "required", "requireText": "required text", "requireNonBlank": "required text", "requirePositive": "must be > 0", "requireNonNegative": "must be ≥ 0", "notNull": "required", "notEmpty": "must not be empty", "hasText": "required text", "hasLength": "required text", "isTrue": "must hold", "state": "must hold", "checkNotNull": "required", "checkArgument": "must hold", "checkState": "must hold"}

_TYPE = r"(?:^|.*? )(class|interface|enum|record) (\w+).*$"
_MODIFIERS = r"((?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp|transient|volatile) |< [^()]*? > (?=[\w.]+(?: < .* >)?(?: \[ \])* \w+ \())*)"
_METHOD = rf"^{_MODIFIERS}([\w.]+(?: < .* >)?(?: \[ \])*) (\w+) \( ?(.*?) ?\)(?: throws .*)?$"
_FIELD = rf"^{_MODIFIERS}([\w.]+(?: < [^=]* >)?(?: \[ \])*) (\w+)(?: = .*)?$"
_ANNOTATION = r"@ (\w+)(?: \( ((?:[^()]|\( [^()]* \))*) \))?"


def _clean(text):
    """A declaration without its annotations."""
    return F.trim(F.regexp_replace(text, _ANNOTATION + " ?", ""))


def _annotated(text):
    names, args = F.regexp_extract_all(text, F.lit(_ANNOTATION), 1), F.regexp_extract_all(text, F.lit(_ANNOTATION), 2)
    return F.arrays_zip(names.alias("name"), args.alias("args"))


def annotation_text(annotations, name: str):
    """The arguments of an annotation: '' without any, null if it isn't there."""
    return F.filter(annotations, lambda a: a["name"] == name)


def _named(args, key: str):
    """A string argument: the named one, else the only one."""
    named, bare = F.regexp_extract(args, rf'(?:^|\W){key} = "([^"]*)"', 1), F.regexp_extract(args, r'^\s*(?:value = )?(?:\{ )?"([^"]*)"', 1)
    return F.when(named != "", named).otherwise(bare)


_STRING = r'"(?:[^"\\]|\\.)*"'


def argument(args, key, alone: bool = True):
    """An annotation's argument as text - the named one or (alone) the only one: strings unwrapped, X.class as X, the first of an array, else the source.

    key: a name, or a column of names.
    """
    key = F.lit(key) if isinstance(key, str) else key
    only = rf"|^(?!\w+ = )(.*)$" if alone else "|^(?!)()"
    found = F.call_function("regexp_extract_all", args, F.concat(F.lit("(?:^|, )(?:"), key, F.lit(rf") = (\{{[^}}]*\}}|{_STRING}[^,]*|[^,]*){only}")), F.lit(0))
    raw = F.regexp_replace(F.get(found, F.lit(0)), r"^(?:, )?\w+ = ", "")
    first = F.trim(F.regexp_extract(F.trim(raw), rf"^(?:\{{ ?)?({_STRING}(?! \+)|(?<=\{{ )[^,}}]*|(?<!\{{ ).*)", 1))
    return F.nullif(F.regexp_replace(F.regexp_replace(F.when(first.rlike(f"^{_STRING}$"), first).otherwise(source(first)), r'^"(.*)"$', "$1"), r"\.class$", ""), F.lit(""))


def source(text):
    """Tokens joined by blanks, written as source again."""
    for a, b in ((r"([=!<>]) =", "$1="), ("& &", "&&"), (r"\| \|", "||"), (r" ?\. ?", "."), (r"(\w) \(", "$1("), (r"\( ", "("), (r" \)", ")"), (r"! ", "!"), (r" ,", ",")):
        text = F.regexp_replace(text, a, b)
    return text


def role(simple, annotations):
    """The architectural role of a class."""
    names, out = F.transform(annotations, lambda a: a["name"]), F.lit("other")
    for what, marks, ends in reversed(ROLES):
        fits = F.arrays_overlap(names, F.array(*map(F.lit, marks)))
        out = F.when(fits | S.ends_with_any(simple, list(ends)) if ends else fits, what).otherwise(out)
    return out


def status_label(code, labels: dict = STATUS):
    """The label of a status code: that of the table, else the code, else a dash."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[code], F.nullif(code, F.lit("")), F.lit("—"))


def may_collaborate(simple, values: tuple = VALUES):
    """Whether a type may be a collaborator: it isn't one of the types of values."""
    return ~simple.isin(*values)


def roles_of(nodes: DataFrame) -> DataFrame:
    """role, class_name, node of the classes of nodes (id, class_name, role)."""
    return nodes.groupBy("class_name").agg(F.min_by("role", "id").alias("role"), F.min("id").alias("node")).select("role", "class_name", "node")


def kept(make):
    """A relation of Facts that is made when it is first asked for and then read from its table."""

    @wraps(make)
    def relation(self) -> DataFrame:
        return self._once(make.__name__, lambda: make(self))

    return relation


class Facts:
    """Fact tables of files (file, source_set, text).

    Entry points and publishers come from what isn't a test's source; with loose_tests nothing in a folder called test counts either.
    """

    def __init__(self, files: DataFrame, loose_tests: bool = False):
        self._kept: dict[str, DataFrame] = {}
        self.loose_tests = loose_tests
        self.files = self._once("files", lambda: files.select("file", "source_set"))
        self.tokens = self._once("tokens", lambda: tokens(files))
        self.statements = self._once("statements", lambda: statements(self.tokens))
        self.types = self._once("types", self._types)
        self.methods = self._once("methods", self._methods)
        self.fields = self._once("fields", self._fields)
        self.code = self._once("code", self._code)

    def _once(self, name: str, make) -> DataFrame:
        """A relation that others build on is written once to the shared folder: it is computed once, and what a lost executor held of it is read again."""
        if name not in self._kept:
            self._kept[name] = cut(make(), name)
        return self._kept[name]

    def close(self) -> None:
        """Delete the tables written; the relations can't be read any more."""
        drop(*self._kept.values())
        self._kept.clear()

    def __enter__(self) -> Facts:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def creations(self) -> DataFrame:
        """Parentheses of `new Type(` in methods and constructors."""
        return self._once("creations", lambda: C.creations(self.code))

    def arguments(self) -> DataFrame:
        """file, open, nth, start, stop, shape of the arguments of calls and creations and of the constants of enums."""
        opens = self.tokens.where(F.col("tok") == "(").where(F.col("p1").rlike(C.WORD) | (F.col("p1") == ">")).select("file", F.col("pos").alias("open"))
        return self._once("arguments", lambda: arguments(self.tokens.where("parent is not null"), opens.union(self.types.where("kind = 'enum'").select("file", "open")), ["file"]))

    def _braces(self) -> DataFrame:
        return self.tokens.where("tok = '{' and partner is not null").select("file", F.col("pos").alias("stop"), F.col("partner").alias("close"))

    def _code(self) -> DataFrame:
        """The tokens inside methods and constructors, with caller (method id), owner (type id), class_name, class_kind and method (null in constructors)."""
        made = self._members().where((F.col("ends") == "{") & F.col("bare").rlike(r"^((public|protected|private) )?\w+ \(.*\)( throws .*)?$") & (F.regexp_extract("bare", r"(\w+) \(", 1) == F.col("simple")))
        made = made.join(self._braces(), ["file", "stop"]).select("file", F.col("stop").alias("body"), F.col("close").alias("body_end"), F.concat("type_id", F.lit("#<init>~"), F.col("line").cast("string")).alias("caller"), F.col("type_id").alias("owner"), F.col("simple").alias("class_name"), F.col("type_kind").alias("class_kind"), F.lit(None).cast("string").alias("method"))
        bodies = self.methods.where("body_end > body").select("file", "body", "body_end", F.col("id").alias("caller"), F.col("type_id").alias("owner"), F.col("simple").alias("class_name"), F.col("type_kind").alias("class_kind"), F.col("name").alias("method"))
        return innermost(self.tokens, bodies.unionByName(made), ["file"], "pos", "body", "body_end").where("caller is not null")

    def _main(self, loose: bool = False) -> DataFrame:
        main = self.files.where("source_set <> 'test'").select("file")
        return main.where(~F.col("file").rlike("(^|/)test/")) if loose else main

    def entry_points(self) -> DataFrame:
        """category, id, http_method, path, destination, async, class_name, method, file, line, method_id of HTTP, scheduled, event (listeners and functional beans) and command-line entry points."""
        return self._once("entry_points", self._entry_points)

    def call_edges(self) -> DataFrame:
        """a (caller), b (callee or external:Type#name), file, line: every call that resolves."""
        return self._once("call_edges", self._call_edges)

    def _types(self) -> DataFrame:
        """file, type_id, simple, kind, role, line, depth, open, close, annotations, head."""
        package = self.statements.where("startswith(text, 'package ')").select("file", F.replace(F.substring("text", 9, 1 << 30), F.lit(" "), F.lit("")).alias("package"))
        t = self.statements.where((F.col("ends") == "{") & _clean(F.col("text")).rlike(_TYPE) & ~_clean(F.col("text")).contains(" = "))
        t = t.select("file", "line", "depth", "parent", F.col("stop").alias("open"), _annotated(F.col("text")).alias("annotations"), _clean(F.col("text")).alias("head"))
        t = t.withColumn("kind", F.regexp_extract("head", _TYPE, 1)).withColumn("simple", F.regexp_extract("head", _TYPE, 2))
        t = t.join(self._braces().withColumnRenamed("stop", "open"), ["file", "open"]).join(package.groupBy("file").agg(F.min("package").alias("package")), "file", "left")
        return t.withColumn("type_id", F.concat_ws(".", "package", "simple")).withColumn("role", role(F.col("simple"), F.col("annotations")))

    def _members(self) -> DataFrame:
        """Statements directly inside a type."""
        return self.statements.join(self.types.select("file", F.col("open").alias("parent"), "type_id", "simple", F.col("kind").alias("type_kind")), ["file", "parent"]).withColumn("bare", _clean(F.col("text")))

    def _methods(self) -> DataFrame:
        """file, type_id, simple, name, return_type, params (array of name, type), line, open, close, annotations, id."""
        m = self._members().where(F.col("ends").isin("{", ";") & F.col("bare").rlike(_METHOD) & ~F.split("bare", r" \( ")[0].contains("=") & ~F.col("bare").rlike(r"(^| )new "))
        m = m.withColumn("name", F.regexp_extract("bare", _METHOD, 3)).withColumn("return_type", F.regexp_extract("bare", _METHOD, 2)).where("return_type not in ('public', 'private', 'protected', 'return', 'new', 'throw')")
        generic = F.regexp_replace(F.regexp_replace(F.regexp_extract("bare", _METHOD, 4), " < [^<>]* >", ""), " < [^<>]* >", "")
        params = F.transform(F.filter(F.split(generic, " , "), lambda p: p.contains(" ")), lambda p: F.struct(S.last_segment(p, " ").alias("name"), S.simple_type_name(F.regexp_replace(F.regexp_replace(p, r" \w+$", ""), r"^final ", "")).alias("type")))
        m = m.join(self._braces().withColumnRenamed("close", "body_end"), ["file", "stop"], "left").select("file", "type_id", "simple", "type_kind", "name", S.simple_type_name(F.col("return_type")).alias("return_type"), F.replace(F.col("return_type"), F.lit(" "), F.lit("")).alias("return_text"), params.alias("params"), "line", F.col("stop").alias("body"), F.coalesce("body_end", "stop").alias("body_end"), "start", _annotated(F.col("text")).alias("annotations"))
        w = Window.partitionBy("type_id", "name").orderBy("file", "start")
        return m.withColumn("k", F.row_number().over(w)).withColumn("id", F.concat("type_id", F.lit("#"), "name", F.when(F.col("k") > 1, F.concat(F.lit("~"), F.col("line").cast("string"))).otherwise(""))).drop("k")

    def _fields(self) -> DataFrame:
        """file, type_id, name, type, is_static, line, annotations."""
        f = self._members().where((F.col("ends") == ";") & ~F.split("bare", " = ")[0].contains("(") & F.col("bare").rlike(_FIELD) & (F.col("type_kind") != "enum"))
        return f.select("file", "type_id", F.regexp_extract("bare", _FIELD, 3).alias("name"), F.replace(F.regexp_extract("bare", _FIELD, 2), F.lit(" "), F.lit("")).alias("type"), F.col("bare").rlike(r"(^| )static ").alias("is_static"), "line", _annotated(F.col("text")).alias("annotations"))

    # ---- relations -----------------------------------------------------------------------------------------------

    @kept
    def entities(self) -> DataFrame:
        """name, kind, table, file, line, fields (name, type, column, id, generated, nullable, unique, length, converter), relations (field, kind, target, mapped_by, join_column, owning)."""
        names = F.transform("annotations", lambda a: a["name"])
        kind = F.when(F.array_contains(names, "Entity"), "ENTITY").when(F.array_contains(names, "Embeddable"), "EMBEDDABLE").when(F.array_contains(names, "MappedSuperclass"), "MAPPED_SUPERCLASS")
        e = self.types.where("kind = 'class'").withColumn("entity", kind).where("entity is not null")
        tab = _named(F.get(annotation_text(F.col("annotations"), "Table"), F.lit(0))["args"], "name")
        e = e.select("type_id", F.col("simple").alias("name"), F.col("entity").alias("kind"), F.when(tab != "", tab).otherwise(F.col("simple")).alias("table"), "file", "line")
        f = self.fields.where("not is_static").withColumn("names", F.transform("annotations", lambda a: a["name"]))
        relation = F.get(F.filter(F.array(*map(F.lit, RELATIONS)), lambda r: F.array_contains(F.col("names"), r)), F.lit(0))
        of = lambda name: F.get(annotation_text(F.col("annotations"), name), F.lit(0))["args"]
        own = F.get(F.filter("annotations", lambda a: a["name"] == relation), F.lit(0))["args"]
        column, mapped = _named(of("Column"), "name"), argument(own, "mappedBy", alone=False)
        target = S.simple_type_name(F.regexp_replace("type", r"^.*[<,]([\w.]+)>+$", "$1"))
        said = lambda key: F.nullif(F.regexp_extract(of("Column"), rf"(?:^|, ){key} = (true|false|\d+)(?: ,|$)", 1), F.lit(""))
        f = f.withColumns({"relation": relation, "target": target, "mapped_by": mapped, "join_column": F.nullif(_named(of("JoinColumn"), "name"), F.lit("")), "column": F.when(column != "", column), "id": F.array_contains("names", "Id"), "generated": F.array_contains("names", "GeneratedValue"), "nullable": said("nullable").cast("boolean"), "unique": said("unique").cast("boolean"), "length": said("length").try_cast("int"), "converter": argument(of("Convert"), "converter", alone=False)})
        per = f.groupBy("type_id").agg(
            F.array_sort(F.collect_list(F.when(F.col("relation").isNull(), F.struct("name", "type", "column", "id", "generated", "nullable", "unique", "length", "converter")))).alias("fields"),
            F.array_sort(F.collect_list(F.when(F.col("relation").isNotNull(), F.struct(F.col("name").alias("field"), F.col("relation").alias("kind"), "target", "mapped_by", "join_column", F.coalesce(F.trim("mapped_by") == "", F.lit(True)).alias("owning"))))).alias("relations"),
        )
        return e.join(per, "type_id", "left").drop("type_id")

    def _entry_points(self) -> DataFrame:
        web = F.exists("annotations", lambda a: a["name"].isin("RestController", "Controller"))
        base = self.types.select("type_id", web.alias("web"), F.when(web, _named(F.get(annotation_text(F.col("annotations"), "RequestMapping"), F.lit(0))["args"], "path")).alias("base"))
        owned = self.methods.join(self._main(self.loose_tests), "file", "left_semi")
        m = owned.join(base, "type_id").withColumn("names", F.transform("annotations", lambda a: a["name"])).withColumn("a", F.explode("annotations")).withColumn("ann", F.col("a.name")).withColumn("args", F.col("a.args"))
        verb = F.coalesce(F.create_map(*[F.lit(x) for kv in VERBS.items() for x in kv])[F.col("ann")], F.when(F.col("ann") == "RequestMapping", F.coalesce(F.nullif(F.regexp_extract("args", r"RequestMethod \. (\w+)", 1), F.lit("")), F.lit("ANY"))))
        path = S.join_path(F.col("base"), _named(F.col("args"), "path"))
        none = F.lit(None).cast("string")

        def entry(df, category, id_, http_method=none, path_=none, destination=none, later=F.lit(False)):
            return df.select(F.lit(category).alias("category"), id_.alias("id"), http_method.alias("http_method"), path_.alias("path"), destination.alias("destination"), later.alias("async"), "file", "line", F.col("simple").alias("class_name"), F.col("name").alias("method"), F.col("id").alias("method_id"))

        http = entry(m.withColumn("verb", verb).where("web and verb is not null"), "http", F.concat(F.lit("http:"), "verb", F.lit(" "), path), F.col("verb"), path)
        rate = argument(F.col("args"), "fixedRate", alone=False)
        timed = entry(m.where("ann = 'Scheduled'"), "scheduled", F.concat(F.lit("scheduled:"), "simple", F.lit("#"), "name"), destination=F.coalesce(argument(F.col("args"), "cron", alone=False), F.concat(F.lit("fixedRate="), rate), F.lit("fixedDelay")))
        heard = lambda d: F.concat(F.lit("event:"), "type_id", F.lit("#"), "name", F.when(d.isNotNull(), F.concat(F.lit("("), d, F.lit(")"))).otherwise(F.concat(F.lit("@"), F.col("line").cast("string"))))
        payload = F.nullif(F.get("params", F.lit(0))["type"], F.lit(""))
        order = [*LISTENERS, *BROKERS]  # a method has one trigger, by the first of these
        e = first_wins(m.where(F.col("ann").isin(*order)).withColumn("nth", S.rank_in(F.col("ann"), order)), ["id"], ["nth"])
        inside = F.col("ann").isin(*LISTENERS)
        e = e.withColumn("told", argument(F.col("args"), F.coalesce(F.create_map(*[F.lit(x) for kv in BROKERS.items() for x in kv])[F.col("ann")], F.lit("classes"))))
        e = e.withColumn("trigger", F.when(inside, F.coalesce(payload, "told")).otherwise(F.coalesce("told", payload)))
        events = entry(e, "event", heard(F.col("trigger")), destination=F.col("trigger"), later=~inside | (F.col("ann") == LISTENERS[0]) | F.array_contains("names", "Async"))
        taken = S.simple_type_name(S.first_generic_argument(F.col("return_text")))
        functional = entry(m.where("ann = 'Bean' and return_type in ('Consumer', 'Function')"), "event", heard(taken), destination=taken, later=F.lit(True))
        runners = self.types.where(F.col("head").rlike(r" implements .*\b(CommandLineRunner|ApplicationRunner)\b")).select("type_id")
        cli = entry(owned.join(runners, "type_id", "left_semi").where("name = 'run'"), "cli", F.concat(F.lit("cli:"), "simple"))
        return http.unionByName(timed).unionByName(events).unionByName(functional).unionByName(cli)

    def receivers(self) -> DataFrame:
        """caller, receiver, file, type, argument (of the type, null without), rank: declared types of the names in each method: parameters and locals (0, 1) before fields (2)."""
        return self._once("receivers", self._receivers)

    def _receivers(self) -> DataFrame:
        bodies = self.code.select("caller", "owner", "file").distinct()
        none = F.lit(None).cast("string")
        params = self.methods.select(F.col("id").alias("caller"), "file", F.explode("params").alias("p")).select("caller", F.col("p.name").alias("receiver"), "file", F.col("p.type").alias("type"))
        generic = self.methods.select(F.col("id").alias("caller"), "file", "start").join(self.statements.select("file", "start", "text"), ["file", "start"]).select("caller", F.explode(F.regexp_extract_all("text", F.lit(r"\w+ < [A-Z]\w* > \w+(?= [,)])"), 0)).alias("g"))
        generic = generic.select("caller", S.last_segment("g", " ").alias("receiver"), F.regexp_extract("g", r"< (\w+) >", 1).alias("argument")).distinct()
        params = params.join(generic, ["caller", "receiver"], "left").select("caller", "receiver", "file", "type", "argument", F.lit(0).alias("rank"))
        made = self.code.where("method is null").select("caller", "file", "body").distinct().join(self.statements.select("file", F.col("stop").alias("body"), F.regexp_extract("text", r"\((.*)\)", 1).alias("given")), ["file", "body"])
        made = made.select("caller", "file", F.explode(F.split("given", " , ")).alias("p")).select("caller", S.last_segment(F.trim("p"), " ").alias("receiver"), "file", S.last_segment(F.regexp_replace(F.trim("p"), r"( < .* >)? \w+$", ""), " ").alias("type"), none, F.lit(0))
        plain = self.code.where(C.name_of(F.col("tok")) & F.col("p1").rlike(r"^[A-Z]\w*$") & F.col("n1").isin("=", ":", ";", ")") & ~F.coalesce(F.col("p2").isin("new", "class"), F.lit(False)))
        plain = plain.select("caller", F.col("tok").alias("receiver"), "file", F.col("p1").alias("type"), none, F.lit(1))
        pattern = r"^(?:final )?([A-Z]\w*) < (.*) > (\w+) = .*$"
        typed = self.statements.where(F.col("text").rlike(pattern)).join(self.code.select("file", F.col("pos").alias("start"), "caller"), ["file", "start"])
        typed = typed.select("caller", F.regexp_extract("text", pattern, 3), "file", F.regexp_extract("text", pattern, 1), F.nullif(F.regexp_extract("text", pattern, 2), F.lit("")), F.lit(1))
        own = bodies.join(self.fields.select(F.col("type_id").alias("owner"), "name", "type"), "owner").select("caller", "name", "file", S.simple_type_name(F.col("type")), F.nullif(S.simple_type_name(F.regexp_extract("type", r"^[^<]*<([^<>,]*)", 1)), F.lit("")), F.lit(2))
        return first_wins(params.union(made).union(plain).union(typed).union(own), ["caller", "receiver"], ["rank", "type"])

    def _call_edges(self) -> DataFrame:
        held = self.receivers().where("rank = 2").select("caller", F.col("receiver").alias("field"), F.col("type").alias("of"))
        enums = self.types.where("kind = 'enum'").select(F.col("simple").alias("of")).distinct()
        held = held.where(may_collaborate(F.col("of"))).join(enums, "of", "left_anti")
        c = C.resolved(self).join(held, ["caller", "field"], "left")
        return c.select(F.col("caller").alias("a"), C.callee(F.col("member"), F.concat("of", F.lit("#"), "name")).alias("b"), "file", "line").where("b is not null").distinct()

    def call_graph(self) -> tuple[DataFrame, DataFrame]:
        """(nodes: id, class_name, method, file, line, role, return_type; edges: a, b, file, line) reachable from the entry points; nodes outside the sources have no file, line 0 and the role external."""
        nodes = self._once("call_nodes", self._call_nodes)
        return nodes, self.call_edges().join(nodes.select(F.col("id").alias("a")), "a", "left_semi")

    def _call_nodes(self) -> DataFrame:
        near = reached(self.call_edges(), self.entry_points().select(F.col("method_id").alias("node"))).withColumnRenamed("node", "id")
        roles = self.types.groupBy("type_id").agg(F.min_by("role", F.struct("file", "line")).alias("role"))
        nodes = near.join(self.methods.select("id", "type_id", "simple", "name", "file", "line", "return_type"), "id", "left").join(roles, "type_id", "left")
        outside = F.col("file").isNull()
        return nodes.select("id", F.when(outside, F.regexp_extract("id", "^external:(.*)#", 1)).otherwise(F.col("simple")).alias("class_name"), F.when(outside, F.substring_index("id", "#", -1)).otherwise(F.col("name")).alias("method"), F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"), F.when(outside, "external").otherwise(F.coalesce("role", F.lit("other"))).alias("role"), F.coalesce("return_type", F.lit("")).alias("return_type"))

    def classes_by_role(self) -> DataFrame:
        """role, class_name, node: the classes of the graph; a class has the role of its first node, in order of id."""
        return roles_of(self.call_graph()[0])

    @kept
    def assignment_sites(self) -> DataFrame:
        """enum_type, field, value, class_name, method (null in constructors), file, line of assignments to what has an enum's type; a constant is named alone, other values by their source."""
        self.call_edges()  # types every expression
        after = Window.partitionBy("file", "parent").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
        c = self.code.withColumn("end", F.coalesce(F.last(F.when(F.col("tok").isin(";", ","), F.col("pos")), ignorenulls=True).over(after)))
        apart = F.col("p2").isin(".", ";", "{", "}", ")", "->", "else", "(", ":") | (F.col("p2") == "=")
        c = c.where((F.col("tok") == "=") & (F.col("n1") != "=") & C.name_of(F.col("p1")) & apart)
        enums = self.types.where("kind = 'enum'").groupBy(F.col("type_id").alias("type")).agg(F.min("simple").alias("enum_type"))
        c = c.withColumn("node", C.node(F.col("pos") - 1)).join(self._kept["typed"].select("node", "type"), "node").join(enums, "type")
        around = self.tokens.select("file", F.col("pos").alias("parent"), F.col("partner").alias("last"))
        c = c.join(around, ["file", "parent"], "left").join(self.statements.select("file", "n", "start", "toks"), ["file", "n"])
        given = cut_text(F.col("toks"), F.col("start"), F.col("pos") + 1, F.coalesce("end", "last") - 1)
        value = F.when(given.rlike(r"^[\w. ]+$"), S.last_segment(F.replace(given, F.lit(" "), F.lit("")))).otherwise(source(given))
        return c.select("enum_type", F.col("p1").alias("field"), value.alias("value"), "class_name", "method", "file", "line")

    @kept
    def state_machines(self) -> DataFrame:
        """enum_type, states (sorted), sites (values with lines) of enums that are named, or held in a field named, status or state."""
        held = self.fields.where("name in ('status', 'state')").select(S.simple_type_name(F.col("type")).alias("simple"), F.lit(True).alias("held")).distinct()
        e = self.types.where("kind = 'enum'").join(held, "simple", "left").where("held or lower(simple) rlike 'status|state'")
        constant = F.regexp_extract(F.regexp_replace(F.array_join("shape", " "), r"@ \w+(?: \. \w+)*(?: \( \))? ", ""), r"^(\w+)(?: \( \))?(?: \{ \})?$", 1)
        states = e.join(self.arguments(), ["file", "open"], "left").groupBy("file", "open", "simple").agg(F.array_sort(F.array_remove(F.collect_list(constant), "")).alias("states"))
        sites = self.assignment_sites().groupBy(F.col("enum_type").alias("simple")).agg(F.array_sort(F.collect_list(F.struct("file", "line", "value"))).alias("sites"))
        return states.join(sites, "simple", "left").select(F.col("simple").alias("enum_type"), "states", F.coalesce("sites", F.array().cast(sites.schema["sites"].dataType)).alias("sites"))

    def _conditions(self) -> DataFrame:
        """file, from, to, condition of what each if holds, its test included; what an else holds has the condition of its if."""
        after = Window.partitionBy("file", "parent").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
        ends = F.when(F.col("tok") == ";", F.col("pos")).when(F.col("tok") == "{", F.col("partner"))
        c = self.code.withColumn("to", F.last(ends, ignorenulls=True).over(after))
        tests = c.where("tok = '(' and p1 = 'if' and to is not null").join(self.statements.select("file", "n", "start", "toks"), ["file", "n"])
        tests = tests.select("file", F.col("pos").alias("from"), "to", source(cut_text(F.col("toks"), F.col("start"), F.col("pos") + 1, F.col("partner") - 1)).alias("condition"))
        others = c.where("tok = 'else' and n1 <> 'if' and to is not null").select("file", F.col("pos").alias("from"), "to", (F.col("pos") - 1).alias("before"))
        others = others.join(tests.select("file", F.col("to").alias("before"), "condition"), ["file", "before"]).select("file", "from", "to", "condition")
        return tests.union(others)

    @kept
    def throw_sites(self) -> DataFrame:
        """exception_type, message, condition, method_id, file, line of the exceptions made in methods outside tests, thrown at once or by a supplier.

        condition is that of the nearest if around it, message the first string that its first argument is or adds up.
        """
        t = self.creations().where("method is not null and made like '%Exception'").join(self._main(), "file", "left_semi")
        added = F.array_join("shape", " ")
        message = F.when(added.rlike(r" (\?|-|\*|/|%|& &|\| \||= =|! =) "), None).otherwise(F.nullif(F.regexp_extract(added, rf'(?:^|\+ )"((?:[^"\\]|\\.)*)"(?= \+|$)', 1), F.lit("")))
        first = self.arguments().where("nth = 0").select("file", F.col("open").alias("pos"), message.alias("message"))
        t = t.select("file", "pos", "made", "caller", "line").join(first, ["file", "pos"], "left")
        t = innermost(t, self._conditions().select("file", "from", "to", "condition"), ["file"], "pos", "from", "to")
        return t.select(F.col("made").alias("exception_type"), "message", "condition", F.col("caller").alias("method_id"), "file", "line")

    @kept
    def exception_statuses(self) -> DataFrame:
        """exception_type, status, source: from @ResponseStatus on exceptions and @ExceptionHandler methods of advice classes; first by source."""
        code = lambda c: F.regexp_extract(F.get(annotation_text(F.col("annotations"), "ResponseStatus"), F.lit(0))["args"], r"HttpStatus \. (\w+)", 1)
        shown = status_label
        own = self.types.where("simple like '%Exception'").withColumn("code", code(0)).where("code <> ''").select(F.col("simple").alias("exception_type"), shown(F.col("code")).alias("status"), F.col("simple").alias("source"))
        advice = self.types.where(F.exists("annotations", lambda a: a["name"].isin("ControllerAdvice", "RestControllerAdvice"))).select("type_id")
        m = self.methods.join(advice, "type_id", "left_semi").withColumn("h", F.get(annotation_text(F.col("annotations"), "ExceptionHandler"), F.lit(0))).where("h is not null").withColumn("code", code(0))
        named = F.regexp_extract_all(F.col("h.args"), F.lit(r"(\w+) \. class"), 1)
        params = F.filter(F.transform("params", lambda p: p["type"]), lambda x: x.endswith("Exception"))
        handled = m.select(F.explode(F.when(F.size(named) > 0, named).otherwise(params)).alias("exception_type"), shown(F.col("code")).alias("status"), F.concat("simple", F.lit("#"), "name").alias("source"))
        return first_wins(own.unionByName(handled), ["exception_type"], ["source", "status"])

    @kept
    def input_constraints(self) -> DataFrame:
        """entry_point, command_type, field, constraint, detail: validation of the types that HTTP methods take as bodies."""
        body = F.regexp_extract("text", r"@ RequestBody (?:@ \w+ )*(?:final )?(\w+)", 1)
        taken = self.statements.where("text like '%@ RequestBody %'").select("file", "start", body.alias("command_type"))
        taken = taken.join(self.methods.select("file", "start", F.col("id").alias("method_id")), ["file", "start"]).join(self.entry_points().where("category = 'http'").select("method_id", F.col("id").alias("entry_point")), "method_id")
        fields = self.fields.join(self.types.select("type_id", F.col("simple").alias("command_type")), "type_id").select("command_type", F.col("name").alias("field"), "annotations")
        parts = self.statements.where((F.col("ends") == "{") & F.col("text").rlike(r"(^| )record \w+ \(")).select(F.regexp_extract("text", r"(?:^| )record (\w+) ", 1).alias("command_type"), F.regexp_extract("text", r"record \w+ \( (.*) \)", 1).alias("all"))
        parts = parts.select("command_type", F.explode(F.split("all", r" , (?![^()]*\))")).alias("part")).select("command_type", S.last_segment(F.col("part"), " ").alias("field"), _annotated(F.col("part")).alias("annotations"))
        a = fields.unionByName(parts).select("command_type", "field", F.explode("annotations").alias("a")).where(F.col("a.name").isin(*CONSTRAINTS))
        return taken.join(a, "command_type").select("entry_point", "command_type", "field", F.col("a.name").alias("constraint"), S.annotation_detail(F.col("a.args")).alias("detail"))

    @kept
    def guard_checks(self) -> DataFrame:
        """field, constraint, detail, method_id, file, line of guard calls on a known holder with an argument."""
        c = self.code.where((F.col("tok") == "(") & (F.col("p2") == ".") & F.col("p3").isin(*GUARD_HOLDERS) & (F.coalesce(F.col("p4"), F.lit("")) != ".")).where("method is not null")
        c = c.withColumn("constraint", F.create_map(*[F.lit(x) for kv in GUARDS.items() for x in kv])[F.col("p1")]).where("constraint is not null").join(self._main(), "file", "left_semi")
        given = self.arguments().withColumnRenamed("open", "pos").join(c.select("file", "pos", "n"), ["file", "pos"]).join(self.statements.select("file", "n", F.col("start").alias("begin"), "toks"), ["file", "n"], "left")
        shape = F.array_join("shape", " ")
        chain = r"^(?:[\w$]+(?: \( \))? \. )*"
        field = F.when(shape.rlike(chain + r"[\w$]+$"), S.last_segment(shape, " ")).when(shape.rlike(chain + r"[\w$]+ \( \)$"), F.concat(F.regexp_extract(shape, r"([\w$]+) \( \)$", 1), F.lit("()")))
        field = F.coalesce(field, S.shortened(source(cut_text(F.col("toks"), F.col("begin"), F.col("start"), F.col("stop"))), 40))
        said = F.when(F.size("shape") == 1, F.nullif(F.regexp_extract(shape, r'^"((?:[^"\\]|\\.)*)"$', 1), F.lit("")))
        told = given.groupBy("file", "pos").agg(F.min_by(field, F.col("nth")).alias("field"), F.min_by(said, F.when(said.isNotNull(), F.col("nth"))).alias("detail"))
        return c.join(told, ["file", "pos"]).select("field", "constraint", "detail", F.col("caller").alias("method_id"), "file", "line")

    @kept
    def near(self) -> DataFrame:
        """root, node: what the method of each entry point reaches."""
        return reach(self.call_edges(), self.entry_points().select(F.col("method_id").alias("root")).distinct())

    def flows(self) -> tuple[DataFrame, DataFrame]:
        """(alternative flows: entry_point, exception_type, status, message, condition; guards: entry_point, field, constraint): facts in reach of each HTTP entry point, the first of a kind."""
        eps = self.entry_points().where("category = 'http'").select(F.col("id").alias("entry_point"), F.col("method_id").alias("root"))
        near = self.near().join(eps, "root").select("entry_point", F.col("node").alias("method_id"))
        thrown = first_wins(near.join(self.throw_sites(), "method_id"), ["entry_point", "exception_type"], ["method_id", "file", "line"])
        alternatives = thrown.join(self.exception_statuses().select("exception_type", "status"), "exception_type", "left").select("entry_point", "exception_type", F.coalesce("status", F.lit("—")).alias("status"), "message", "condition")
        guards = first_wins(near.join(self.guard_checks(), "method_id"), ["entry_point", "field", "constraint"], ["method_id", "file", "line"]).select("entry_point", "field", "constraint")
        return alternatives, guards

    @kept
    def event_flows(self) -> DataFrame:
        """event, producers, consumers (arrays of Class#method@line): a full outer join on the event's simple name."""
        from ..operators.relational import choreography

        consumed = self.entry_points().where("category = 'event'").select(F.col("destination").alias("event"), F.concat("class_name", F.lit("#"), "method", F.lit("@"), F.col("line").cast("string")).alias("party"))
        sent = self.tokens.where((F.col("tok") == "(") & F.col("p1").isin(*PUBLISHERS)).join(self._main(self.loose_tests), "file", "left_semi").select("file", F.col("pos").alias("open"), "line")
        sent = innermost(sent, self.types.where("kind in ('class', 'interface')").select("file", F.col("open").alias("from"), F.col("close").alias("to"), F.col("simple").alias("class_name")), ["file"], "open", "from", "to").drop("from", "to")
        sent = sent.join(self.code.where("tok = '('").select("file", F.col("pos").alias("open"), "method"), ["file", "open"], "left")
        event = F.regexp_extract(F.array_join("shape", " "), r"^new (?:\w+ \. )*(\w+)(?: < .*>)? \( \)(?: \{ \})?$", 1)
        made = self.arguments().withColumn("event", event).where("event <> ''").join(sent, ["file", "open"]).join(consumed.select("event", F.lit(True).alias("known")).distinct(), "event", "left")
        made = made.where(F.col("known") | F.col("event").rlike(f"(?:{'|'.join(EVENT_SUFFIXES)})$"))
        made = first_wins(made, ["file", "open"], ["nth"])  # one event per call
        made = made.select("event", F.concat(F.coalesce("class_name", F.lit("?")), F.lit("#"), F.coalesce("method", F.lit("?")), F.lit("@"), F.col("line").cast("string")).alias("party"))
        return choreography(made, consumed, "event")

    @kept
    def test_scenarios(self) -> DataFrame:
        """test_class, target, certain, method, description, line of @Test methods."""
        m = self.methods.where(F.exists("annotations", lambda a: a["name"] == "Test")).join(self.files.where("source_set = 'test'").select("file"), "file", "left_semi")
        shown = _named(F.get(annotation_text(F.col("annotations"), "DisplayName"), F.lit(0))["args"], "value")
        main = self.types.join(self.files.where("source_set = 'main'").select("file"), "file", "left_semi").select(F.col("simple").alias("target"))
        m = m.select(F.col("simple").alias("test_class"), S.strip_suffix(F.col("simple"), list(TEST_SUFFIXES)).alias("target"), F.col("name").alias("method"), F.coalesce(F.nullif(shown, F.lit("")), S.humanize(F.col("name"))).alias("description"), "line")
        return with_certain(m, main).select("test_class", "target", "certain", "method", "description", "line")
