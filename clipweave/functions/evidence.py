"""Evidence documents as columns: names, signatures, attribute maps, spans, judgements, validity and counts."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .json_walk import kind_of, nodes, once
from .text import FREE_KEYS, keeps_value, normalise, token, without_thoughts

# Names that mean the same class, irregular plurals, and the keys whose values make a signature.
SYNONYMS = {
    "people": "person", "men": "person", "women": "person", "man": "person", "woman": "person", "boy": "person", "girl": "person",
    "bike": "bicycle", "motorbike": "motorcycle", "pickup": "truck", "cattle": "cow", "bull": "cow", "calf": "cow", "ox": "cow",
}
PLURALS = {
    "person": "people", "man": "men", "woman": "women", "child": "children", "cow": "cows", "sheep": "sheep", "goat": "goats", "deer": "deer",
    "bird": "birds", "fish": "fish", "duck": "ducks", "chicken": "chickens", "horse": "horses",
}
TWO_CUES = ("color", "pattern", "printed-text", "number-or-id", "brand-or-logo", "texture", "species-or-breed")
ONE_CUE = ("position", "orientation", "facing-direction")
# Endings of a bank's stem, in any case, and labels of themes, shots and task states.
STEM_ENDS = ("prompt", "scord", "scored", "vqa", "assertion", "assertions", "qa", "bank")
LABELS = {
    "animals_and_ecology": "动物与生态", "architecture": "建筑", "commercial_marketing": "商业营销", "food": "食物", "industrial_activity": "工业活动",
    "landscape": "风景", "people_daily": "人物日常", "sports_competition": "体育竞技", "transportation": "交通", "single": "单镜头", "multi": "多镜头",
}
MULTI_PREFIX = "This video should contain multiple distinct shots, with clear scene transitions, varied camera angles, and coherent visual storytelling.\n\n"

_ENTITY = "struct<id:string,name:string,attributes:map<string,array<string>>,spans:array<array<double>>>"
_RELATION = "struct<subject:string,predicate:string,object:string,spans:array<array<double>>,confidence:double>"
EVIDENCE = (
    f"struct<meta:struct<video:string,video_path:string,video_name:string,video_basename:string>,fine:struct<entities:array<{_ENTITY}>,relations:array<{_RELATION}>>,"
    f"fine_windows:array<struct<start:double,end:double,entities:array<{_ENTITY}>,relations:array<{_RELATION}>>>,"
    "views:struct<objects_count:map<string,double>,attributes:map<string,map<string,array<string>>>,triplets:array<struct<subject:string,predicate:string,object:string>>>>"
)


def literal_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for k in values for x in (k, values[k])))


def nfc(text: Column) -> Column:
    """Composed form (NFC). Spark has none of its own: a batched Arrow function, which texts of ASCII alone leave as they are."""

    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))

    return composed(text)


def canonical_name(name: Column) -> Column:
    t = token(F.coalesce(name, F.lit("")))
    return F.coalesce(F.try_element_at(literal_map(SYNONYMS), t), t)


def display_name(name: Column, count: Column) -> Column:
    """The class as shown: plural from ten on."""
    base = canonical_name(name)
    return F.when(count >= 10, F.coalesce(F.try_element_at(literal_map(PLURALS), base), F.concat(base, F.lit("s")))).otherwise(base)


def signature(name: Column, attributes: Column) -> Column:
    """Up to four cues, sorted and joined: two values of each describing key, one of each key of place; without any, the name."""
    values = lambda k, n: F.slice(F.coalesce(F.try_element_at(attributes, F.lit(k)), F.array().cast("array<string>")), 1, n)
    cues = F.concat(*(values(k, 2) for k in TWO_CUES), *(values(k, 1) for k in ONE_CUE))
    cues = F.filter(cues, lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    picked = F.slice(F.array_sort(F.array_distinct(F.transform(cues, token))), 1, 4)
    return F.when(F.size(picked) > 0, F.array_join(picked, "-")).otherwise(token(F.coalesce(name, F.lit(""))))


def clean_open_attributes(attributes: Column) -> Column:
    """Attribute map with values as tokens: those without letters and single letters go, values are sorted and different, empty keys go."""
    letters = lambda t: F.length(F.regexp_replace(t, "[^a-z]", ""))
    keep = lambda t: (t != "") & (letters(t) > 0) & ~((letters(t) == 1) & (F.length(t) <= 2))
    values = F.transform_values(attributes, lambda _, vs: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(vs, F.array().cast("array<string>")), token), keep))))
    return F.map_filter(F.transform_keys(values, lambda k, _: token(k)), lambda _, vs: F.size(vs) > 0)


def normal_attributes(entries: Column) -> Column:
    """Entries array<struct<key, values>> with normalised keys and values: values not worth comparing and repeated ones go, empty keys go.

    Of keys that become equal the last stands.
    """
    of = lambda key, values: F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), normalise), lambda v: v.isNotNull() & keeps_value(key, v)))
    named = F.transform(entries, lambda e: F.struct(normalise(e["key"]).alias("key"), e["values"].alias("values")))
    shaped = F.transform(named, lambda e: F.struct(e["key"].alias("key"), of(e["key"], e["values"]).alias("values")))
    shaped = F.filter(shaped, lambda e: (e["key"] != "") & (F.size(e["values"]) > 0))

    def last(all_: Column) -> Column:
        follows = lambda e, i: F.exists(F.slice(all_, i + 2, F.greatest(F.size(all_), F.lit(1))), lambda o: o["key"] == e["key"])
        return F.map_from_entries(F.filter(all_, lambda e, i: ~follows(e, i)))

    return once(shaped, last)


def coerced_spans(raw: Column) -> Column:
    """array<array<double>> from JSON: one pair [a, b], or of a list those entries that begin with two numbers; anything else is empty."""
    none = F.array().cast("array<array<double>>")
    flat = F.from_json(raw, "array<double>")
    pair = raw.rlike(r"^\s*\[\s*-?[0-9.eE+-]+\s*,\s*-?[0-9.eE+-]+\s*\]\s*$")
    nested = F.transform(F.filter(F.from_json(raw, "array<array<double>>"), lambda s: (F.size(s) >= 2) & F.get(s, 0).isNotNull() & F.get(s, 1).isNotNull()), lambda s: F.slice(s, 1, 2))
    return F.coalesce(F.when(pair, F.array(flat)).when(raw.rlike(r"^\s*\[\s*\["), nested), none)


def span_total(spans: Column) -> Column:
    return F.aggregate(F.coalesce(spans, F.array().cast("array<array<double>>")), F.lit(0.0), lambda t, s: t + F.greatest(F.lit(0.0), F.get(s, 1) - F.get(s, 0)))


def merged_spans(spans: Column, tolerance: float = 0.2) -> Column:
    """Spans in order, those that touch within ``tolerance`` as one."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.get(x, 0) <= F.get(F.try_element_at(acc, F.lit(-1)), 1) + tolerance)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(F.get(last, 0), F.greatest(F.get(last, 1), F.get(x, 1)))))
        return F.when(joins, grown).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<array<double>>"), step)


def relation_spans(subject: Column, obj: Column, start: Column, end: Column, least: float, places: int | None = 1) -> Column:
    """Where both ends of a relation are seen: intersections of ``least`` or longer; else a window of that length about the first
    intersection, or about the middle of the nearest gap. Clipped to [start, end], to ``places`` places; None: as they are."""
    to = lambda x: x if places is None else F.round(x, places)
    pairs = F.flatten(F.transform(subject, lambda a: F.transform(obj, lambda b: F.struct(F.greatest(F.get(a, 0), F.get(b, 0)).alias("s"), F.least(F.get(a, 1), F.get(b, 1)).alias("e")))))
    met = merged_spans(F.transform(F.filter(pairs, lambda p: p["e"] > p["s"]), lambda p: F.array(p["s"], p["e"])))
    cut = lambda a, b: F.array(to(F.greatest(start, a)), to(F.least(end, b)))
    long = F.transform(F.filter(met, lambda m: F.get(m, 1) - F.get(m, 0) >= least), lambda m: cut(F.get(m, 0), F.get(m, 1)))
    gaps = F.transform(pairs, lambda p: F.struct((p["s"] - p["e"]).alias("gap"), ((p["s"] + p["e"]) / 2).alias("mid")))
    middle = F.when(F.size(met) > 0, (F.get(F.get(met, 0), 0) + F.get(F.get(met, 0), 1)) / 2).otherwise(F.array_min(gaps)["mid"])
    low, high = F.greatest(start, middle - least / 2), F.least(end, middle + least / 2)
    none = F.array().cast("array<array<double>>")
    return F.when(F.size(long) > 0, long).when(high > low, F.array(F.array(to(low), to(high)))).otherwise(none)


def counted(text: Column) -> Column:
    """A count such as ``>8`` or ``3.7``: its whole part, 0 where there is none."""
    x = F.trim(F.translate(text, "><~+", "")).try_cast("double")
    return F.coalesce(F.when(F.isnan(x), None).otherwise(x).cast("long"), F.lit(0)).cast("long")


def _judged(raw: Column) -> tuple[Column, Column]:
    clean = F.trim(F.regexp_replace(without_thoughts(F.coalesce(raw, F.lit(""))), r"(?m)^\s*```.*$\n?", ""))
    clean = F.regexp_replace(clean, r"^\s+|\s+$", "")
    return clean, F.when(clean.rlike(r"(?s)^\{.*\}$"), F.from_json(clean, "struct<answer:string,consistency:string>"))


def judged(raw: Column, yes_no: bool) -> Column:
    """struct<answer, consistency> of a judge's text: a clean JSON object's fields, else no answer and the first whole number up to 100.

    Answers are YES, NO or nothing, or the first 64 characters; consistency is held to 0..100.
    """
    clean, as_json = _judged(raw)
    level = as_json["consistency"].try_cast("double").cast("int")
    parsed = as_json.isNotNull() & (as_json["consistency"].isNull() | level.isNotNull())
    said = F.trim(F.coalesce(as_json["answer"], F.lit("")))
    upper = F.upper(said)
    answer = F.when(upper.startswith("Y"), "YES").when(upper.startswith("N"), "NO").otherwise("") if yes_no else F.left(said, F.lit(64))
    alone = F.regexp_extract(clean, r"(?<![0-9])(100|[0-9]{1,2})(?![0-9])", 1).try_cast("int")
    value = F.when(parsed, F.coalesce(level, F.lit(0))).otherwise(F.coalesce(alone, F.lit(0)))
    return F.struct(F.when(parsed, answer).otherwise("").alias("answer"), F.greatest(F.lit(0), F.least(F.lit(100), value)).alias("consistency"))


def bank_stem(stem: Column) -> Column:
    """A stem in lower case without the endings of banks, as many as there are."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(stem, F.lit("")))), f"(_({'|'.join(STEM_ENDS)}))+$", "")


def class_of_stem(stem: Column, fallback: Column) -> Column:
    found = F.trim(F.regexp_extract(stem, r"(?i)^(.+)_(single|multi)_[0-9]+$", 1))
    return F.when(found != "", found).otherwise(fallback)


def fuzzy_key(key: Column) -> Column:
    """Letters alone, lower case."""
    return F.lower(F.regexp_replace(key, r"[^\p{L}]", ""))


def theme_words(path: Column) -> Column:
    """Words of three letters or more of a file's folder; without any, ``object``."""
    folder = F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)
    words = F.filter(F.split(F.lower(F.translate(folder, "-", "_")), "_"), lambda w: w.rlike(r"^\p{L}{3,}$"))
    return F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("object")))


def model_key(name: Column) -> Column:
    return F.translate(F.lower(name), "- ", "__")


def shot_prompt(file_name: Column, prompt: Column) -> Column:
    """A prompt, led in by the request for several shots where the file's name says so."""
    text = F.regexp_replace(prompt, r"^\s+|\s+$", "")
    return F.when(F.lower(file_name).contains("multi"), F.concat(F.lit(MULTI_PREFIX), text)).otherwise(text)


def without_prompt(text: Column, prompt: Column) -> Column:
    """A text without the prompt that it repeats at its start, in any case, and the marks after it."""
    t = F.trim(F.coalesce(text, F.lit("")))
    rest = F.trim(F.regexp_replace(F.substring(t, F.length(prompt) + 1, F.length(t)), "^[:：\\- ]+", ""))
    return F.when((prompt != "") & F.lower(t).startswith(F.lower(prompt)), rest).otherwise(t)


def label_of(code: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(LABELS), code), code)


def _some(a: Column) -> Column:
    return F.coalesce(F.size(a) > 0, F.lit(False))


def has_evidence(doc: Column) -> Column:
    """Whether a document says anything: entities, relations, windows with either, counts above 0, triplets or attributes."""
    any_ = lambda x: F.coalesce(x, F.lit(False))
    windows = any_(F.exists(doc["fine_windows"], lambda w: _some(w["entities"]) | _some(w["relations"])))
    views = doc["views"]
    return (
        _some(doc["fine"]["entities"]) | _some(doc["fine"]["relations"]) | windows | any_(F.exists(F.map_values(views["objects_count"]), lambda n: n > 0))
        | _some(views["triplets"]) | any_(F.exists(F.map_values(views["attributes"]), lambda m: _some(F.map_keys(m))))
    )


def is_scorable(entities: Column) -> Column:
    """Whether entities can be compared: some entity, or some attribute of one."""
    return _some(entities)


def object_count(doc: Column) -> Column:
    """Sum of the counts shown, else the number of entities."""
    shown = doc["views"]["objects_count"]
    total = F.aggregate(F.map_values(shown), F.lit(0).cast("long"), lambda t, n: t + F.coalesce(n, F.lit(0.0)).cast("long"))
    return F.when(_some(F.map_keys(shown)), total).otherwise(F.coalesce(F.size(doc["fine"]["entities"]), F.lit(0))).cast("long")


def attribute_count(doc: Column) -> Column:
    """Number of different (key, value): of the attributes shown, else of the entities'."""
    shown = doc["views"]["attributes"]
    pairs = lambda m: F.flatten(F.transform(F.map_entries(m), lambda e: F.transform(F.coalesce(e["value"], F.array().cast("array<string>")), lambda v: F.struct(e["key"].alias("k"), v.alias("v")))))
    of_shown = F.flatten(F.transform(F.map_values(shown), pairs))
    of_entities = F.flatten(F.transform(F.filter(doc["fine"]["entities"], lambda e: e["attributes"].isNotNull()), lambda e: pairs(e["attributes"])))
    return F.coalesce(F.size(F.array_distinct(F.filter(F.when(_some(F.map_keys(shown)), of_shown).otherwise(of_entities), lambda p: p["v"].isNotNull()))), F.lit(0)).cast("long")


def bound_to(doc: Column, video_name: Column, file_name: Column) -> Column:
    """Whether a document belongs to a video: by the name or path in it, else by its file's name."""
    named = F.coalesce(doc["meta"]["video_basename"], doc["meta"]["video_name"]) == video_name
    path = F.coalesce(doc["meta"]["video"], doc["meta"]["video_path"])
    by_path = F.regexp_extract(path, r"([^/]*)$", 1) == video_name
    by_file = file_name == F.concat(F.regexp_replace(video_name, r"\.[^.]*$", ""), F.lit(".json"))
    return F.coalesce(named, F.lit(False)) | F.coalesce(by_path, F.lit(False)) | F.coalesce(by_file, F.lit(False))


def event_list(raw: Column) -> Column:
    """The events of a document of any layout, as variants: none if it has no list of events.

    In an object with a list under ``events`` that list alone counts. Else every list that has an object among its first five elements may be the
    one, however deep it lies in objects; the first in the order of the text stands, empty ones apart.
    """

    def pick(all_nodes: Column) -> Column:
        lists = F.filter(all_nodes, lambda n: n["kind"] == "array")
        told = lambda n: F.coalesce(F.get(n["keys"], F.size(n["keys"]) - 1) == "events", F.lit(False))
        named = F.filter(lists, told)
        holder = lambda e: F.slice(e["at"], 1, F.size(e["at"]) - 1)
        under = lambda n, e: (F.size(n["at"]) >= F.size(e["at"])) & (F.slice(n["at"], 1, F.size(e["at"]) - 1) == holder(e))
        hidden = lambda n: F.exists(named, lambda e: (e["at"] != n["at"]) & under(n, e))
        items = lambda n: F.from_json(n["text"], "array<variant>")
        is_list = lambda n: told(n) | F.exists(F.slice(items(n), 1, 5), lambda v: kind_of(v) == "object")
        good = F.filter(lists, lambda n: ~hidden(n) & is_list(n) & ~n["text"].rlike(r"^\s*\[\s*\]\s*$"))
        first = F.array_min(F.transform(good, lambda n: F.struct(n["at"].alias("at"), n["text"].alias("text"))))
        return F.from_json(first["text"], "array<variant>")

    return F.coalesce(once(nodes(raw, through=("object",)), pick), F.array().cast("array<variant>"))


def enabled_count(events: Column) -> Column:
    """Events that are not switched off by ``enabled``, or where that is absent by ``valid``: by null, false, 0 or anything empty."""

    def on(e: Column) -> Column:
        told = F.coalesce(*(F.try_variant_get(e, f"$.{k}", "variant") for k in ("enabled", "valid")))
        text = F.try_variant_get(told, "$", "string")
        kind = kind_of(told)
        yes = F.when(kind == "null", False).when(kind == "string", text != "").when(kind == "boolean", text == "true")
        yes = yes.when(kind == "number", text.try_cast("double") != 0).otherwise(~F.to_json(told).isin("[]", "{}"))
        return F.when(told.isNull() | (kind_of(e) != "object"), True).otherwise(yes)

    return F.size(F.filter(events, on)).cast("long")


def merged_count(raw: Column) -> Column:
    """How many events a file of merged events holds, as text: the length of its ``events``, or of the list that it is; empty of all else."""
    whole = F.try_parse_json(raw)
    inner = F.try_variant_get(whole, "$.events", "variant")
    size = lambda v: F.size(F.try_variant_get(v, "$", "array<variant>")).cast("string")
    return F.when(kind_of(inner) == "array", size(inner)).when(kind_of(whole) == "array", size(whole)).otherwise("")


def free_key(key: Column) -> Column:
    return key.isin(*FREE_KEYS)
