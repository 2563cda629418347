"""Walks over JSON of any layout: every value of a document as a node, in columns alone.

A document is parsed level by level: ``from_json`` gives the members of all objects and arrays of a level in the order they are written,
as texts and as variants, which tell their kinds; the walk ends when no member has members, so that it goes as deep as the document does.
What a reader looks for is then the least node by a rank of its path, with no search of its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = "array<struct<keys:array<string>,at:array<int>,inside:string,kind:string,text:string>>"
_STRICT = {"allowSingleQuotes": "false"}


def kind_of(v: Column) -> Column:
    """object, array, number, boolean, string or null of a variant."""
    s = F.schema_of_variant(v)
    whole = F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string")
    return whole.when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when(s.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), "number")


def once(value: Column, then) -> Column:
    """``then(value)``, with ``value`` worked out a single time however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _members(node: Column) -> Column:
    """The nodes right below one, in written order; elements of arrays have their place as key."""
    text, is_object = node["text"], node["kind"] == "object"
    parsed = lambda kind, t: F.from_json(F.when(kind, text), t, _STRICT)

    def one(z: Column, k: Column) -> Column:
        keys, at = F.array_append(node["keys"], F.coalesce(z["key"], k.cast("string"))), F.array_append(node["at"], k)
        return F.struct(keys.alias("keys"), at.alias("at"), node["kind"].alias("inside"), kind_of(z["v"]).alias("kind"), z["text"].alias("text"))

    of_map = once(parsed(is_object, "map<string,string>"), lambda m: F.struct(F.map_keys(m).alias("key"), F.map_values(m).alias("text")))
    of_list = F.struct(F.lit(None).cast("array<string>").alias("key"), parsed(~is_object, "array<string>").alias("text"))
    values = F.when(is_object, F.map_values(parsed(is_object, "map<string,variant>"))).otherwise(parsed(~is_object, "array<variant>"))

    def every(t: Column) -> Column:
        keys = F.coalesce(t["key"], F.transform(t["text"], lambda _: F.lit(None).cast("string")))
        return F.transform(F.arrays_zip(keys.alias("key"), t["text"].alias("text"), values.alias("v")), one)

    return once(F.when(is_object, of_map).otherwise(of_list), every)


def nodes(raw: Column, *, through: tuple[str, ...] = ("object", "array")) -> Column:
    """All values of a JSON text: (keys, at, inside, kind, text), the root with no keys first, then level by level.

    ``inside`` is the kind of what holds a value. With ``through`` only values of these kinds are gone into.

    ``at`` is the place of each key among its neighbours, so that arrays of ``at`` are in the order of the text. Numbers and strings
    stand as text without quotes, objects and arrays as JSON. What is no JSON, or names a key twice in an object, has no nodes.
    """
    none = F.array().cast(NODES)
    root_kind = kind_of(F.try_parse_json(raw))
    root = F.array(F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<int>").alias("at"), F.lit("").alias("inside"), root_kind.alias("kind"), raw.alias("text")))
    start = F.struct(F.when(root_kind.isNotNull(), root).otherwise(none).cast(NODES).alias("open"), none.alias("found"))
    deeper = F.greatest(F.lit(1), F.regexp_count(F.coalesce(raw, F.lit("")), F.lit("[\\[{]")) + 1)  # no deeper than brackets open

    def level(acc: Column, _: Column) -> Column:
        inner = F.filter(acc["open"], lambda n: n["kind"].isin(*through))
        below = F.flatten(F.transform(inner, lambda n: F.coalesce(_members(n), none)))
        step = F.struct(below.cast(NODES).alias("open"), F.concat(acc["found"], acc["open"]).alias("found"))
        return F.when(F.size(acc["open"]) > 0, step).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), deeper), start, level, lambda acc: F.concat(acc["found"], acc["open"]))


def number_of(node: Column) -> Column:
    """The number that a node is, true and false as 1 and 0; null of all others."""
    return F.when(node["kind"] == "number", node["text"].try_cast("double")).when(node["kind"] == "boolean", (node["text"] == "true").cast("double"))


def is_true(node: Column) -> Column:
    """Whether a value says yes: not null, false, 0 or empty."""
    text = node["text"]
    return F.when(node["kind"].isin("number", "boolean"), number_of(node) != 0).when(node["kind"] == "string", text != "").when(node["kind"] == "null", False).otherwise(~text.rlike(r"^\s*[\[{]\s*[\]}]\s*$"))


def least(candidates: Column, value: str = "value") -> Column:
    """``value`` of the struct that comes first by its fields in order; null of none."""
    return F.array_min(candidates)[value]
