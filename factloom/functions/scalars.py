"""Scalar functions of the fact layer as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def simple_type_name(t: Column) -> Column:
    """a.b.C<D>[] -> C"""
    return F.trim(F.replace(F.substring_index(F.substring_index(t, "<", 1), ".", -1), F.lit("[]"), F.lit("")))


def last_segment(t: Column, sep: str = ".") -> Column:
    return F.substring_index(t, sep, -1)


def first_generic_argument(t: Column) -> Column:
    """Map<K, V> -> K; null without arguments."""
    inner = F.regexp_extract(t, r"^[^<]*<(.*)>", 1)
    return F.when(inner != "", F.trim(F.substring_index(inner, ",", 1)))


def join_path(base: Column, path: Column) -> Column:
    """One leading slash, none at the end; / for two empty parts."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^/+|/+$", "")
    return F.concat(F.lit("/"), F.array_join(F.filter(F.array(clean(base), clean(path)), lambda x: x != ""), "/"))


def humanize(name: Column) -> Column:
    """camelCase_name -> camel case name"""
    return F.lower(F.trim(F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), "([a-z0-9])([A-Z])", "$1 $2")))


def strip_suffix(name: Column, suffixes: list[str]) -> Column:
    """The name without the first suffix that fits; null if none does or nothing would be left."""
    out = F.lit(None).cast("string")
    for s in reversed(suffixes):
        out = F.when(name.endswith(s) & (F.length(name) > len(s)), F.substring(name, F.lit(1), F.length(name) - len(s))).otherwise(out)
    return out


def ends_with_any(name: Column, suffixes: list[str]) -> Column:
    return name.rlike("(" + "|".join(suffixes) + ")$")


def clamp(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(value.isin(allowed), value).otherwise(default)


def rank_in(value: Column, order: list[str]) -> Column:
    """Place of value in order, from 1; 0 if it isn't there."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)).cast("long")


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys and nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def sorted_keys(value: Column, kind: DataType) -> Column:
    """value with the fields of every struct in it, and the entries of every map, in the order of their names."""
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[sorted_keys(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: sorted_keys(x, kind.elementType))
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), sorted_keys(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return value


def canonical(value: Column, kind: DataType) -> Column:
    """Compact JSON with keys sorted at every level and nulls kept."""
    return F.to_json(sorted_keys(value, kind), {"ignoreNullFields": "false"})


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def diagram_id(text: Column) -> Column:
    """A token of letters, digits and underscores that doesn't start with a digit."""
    plain = F.regexp_replace(text, "[^A-Za-z0-9_]", "_")
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "unknown").otherwise(F.when(plain.rlike("^[A-Za-z_]"), plain).otherwise(F.concat(F.lit("n_"), plain)))


def diagram_type(text: Column) -> Column:
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "Object").otherwise(F.regexp_replace(text, "[^A-Za-z0-9_]", "_"))


def diagram_label(text: Column) -> Column:
    """A quoted label: no quotes, braces or bars, on one line."""
    return one_line(F.translate(F.coalesce(text, F.lit("")), '"{}|', "'()/"))


def annotation_detail(args: Column) -> Column:
    """The arguments of an annotation as in source, from their tokens; null for none."""
    return F.nullif(F.replace(F.replace(args, F.lit(" = "), F.lit("=")), F.lit(" ,"), F.lit(",")), F.lit(""))


def flow_detail(condition: Column, message: Column) -> Column:
    """What tells an alternative flow: when <condition>, else its message, else nothing."""
    return F.coalesce(F.concat(F.lit("when "), F.nullif(condition, F.lit(""))), message, F.lit(""))


def approx_tokens(text: Column) -> Column:
    """A text's length in model tokens, roughly: a quarter of its letters."""
    return F.floor(F.coalesce(F.length(text), F.lit(0)) / 4).cast("long")


#: Headings of the categories of entry points, in the order that they are shown.
CATEGORIES = {"http": "REST", "grpc": "gRPC", "graphql": "GraphQL", "event": "Events", "messaging": "Messaging", "scheduled": "Scheduled", "cli": "CLI", "other": "Other"}


def category_label(category: Column) -> Column:
    """The heading of a category of entry points."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])[category], F.lit("Other"))


def entry_category(entry_point: Column) -> Column:
    """The heading of an entry point, by the start of its id."""
    return category_label(F.when(entry_point.contains(":"), F.substring_index(entry_point, ":", 1)))


def category_rank(label: Column) -> Column:
    """The place of a heading in the order shown, from 0; unknown ones last."""
    place = F.array_position(F.array(*map(F.lit, CATEGORIES.values())), label)
    return F.when(place > 0, place - 1).otherwise(len(CATEGORIES)).cast("long")


def entry_label(entry_point: Column) -> Column:
    """What an entry point is called: VERB /path, else without category and package."""
    rest = F.regexp_replace(entry_point, "^[a-z]+:", "")
    return F.when(entry_point.startswith("http:"), rest).otherwise(F.regexp_replace(rest, r"^(?:[\w$]+\.)+(?=[\w$]+(?:#|$))", ""))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def backoff_ms(attempt: Column, first: int = 1000, most: int = 30000) -> Column:
    return F.least(F.lit(first) * F.pow(F.lit(2), attempt - 1), F.lit(most)).cast("long")


def count_words(text: Column, words: list[str]) -> Column:
    return F.size(F.regexp_extract_all(F.lower(text), F.lit(r"\b(" + "|".join(words) + r")\b"), 0)).cast("long")


def first_json_array(text: Column, schema: str) -> Column:
    """The outermost [...] of the first fenced block of messy text, or of all of it without fences, parsed; null if it doesn't parse."""
    plain = F.replace(text, F.lit("```json"), F.lit("```"))
    fenced = F.coalesce(F.nullif(F.regexp_extract(plain, "(?s)```(.*?)```", 1), F.lit("")), plain)
    return F.from_json(F.regexp_extract(fenced, r"(?s)\[.*\]", 0), schema)


def common_items(a: Column, b: Column) -> Column:
    """How many items two arrays share from the start."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(first > 0, first - 1).otherwise(F.size(a)).cast("long")


def common_prefix_length(a: Column, b: Column) -> Column:
    """Letters that two texts share from the start: the most for which their beginnings are equal, found by halving."""
    def halved(low: Column, high: Column) -> Column:
        middle = F.ceil((low + high) / 2).cast("int")
        same = F.substring(a, F.lit(1), middle) == F.substring(b, F.lit(1), middle)
        return F.struct(F.when(same, middle).otherwise(low).alias("low"), F.when(same, high).otherwise(middle - 1).alias("high"))

    most = F.least(F.length(a), F.length(b))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(most, F.lit(1)) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), most.alias("high"))
    return F.aggregate(steps, start, lambda acc, _: F.when(acc["low"] < acc["high"], halved(acc["low"], acc["high"])).otherwise(acc), lambda acc: acc["low"].cast("long"))
