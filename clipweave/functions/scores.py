"""Scores out of free-form JSON: every number of a document is ranked by the path that leads to it, and the first stands.

A number stands for a key where it is the key's value, or lies below it through objects. Of several, at the first object where their paths
part, a number under a usual key comes first, then what lies under a wrapper, then what is written first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import json_walk as jw
from .text import plain_number

# What an event report holds, the usual keys of a number, the wrappers, the objects that may hold the report,
# and the keys that a fallback score is looked for under.
TARGETS = ("EGA", "ERel", "ECR", "S_event")
USUAL = ("S", "score", "value", "val", "mean", "avg", "final")
WRAPPERS = ("summary", "metrics", "event")
HOLDERS = ("scores", "summary", "metrics", "event", "event_scores")
FALLBACK = ("s_event", "event_score", "eventscore", "final_score", "score", "score_0_5", "mapped_score_0_5", "band", "final_band")
EVENT_SCORES = "struct<ega:double,erel:double,ecr:double,s_event:double,erel_valid:boolean>"
_FAR = 100


def _place(names: tuple[str, ...], key: Column) -> Column:
    """Place of ``key`` in ``names`` from 1, 0 if it is none of them."""
    return F.array_position(F.array(*map(F.lit, names)), key).cast("int")


def _inner_rank(node: Column, top: Column | int) -> Column:
    """Ranks of the keys below the first ``top``: usual keys of a number, wrappers, then places."""
    last = F.size(node["keys"])

    def of(key: Column, k: Column) -> Column:
        usual, wrapper = _place(USUAL, key), _place(WRAPPERS, key)
        return F.when((usual > 0) & (k + 1 == last), usual).when(wrapper > 0, wrapper + 20).otherwise(F.get(node["at"], k) + _FAR)

    ranks = F.transform(node["keys"], of)
    return F.slice(ranks, F.lit(top) + 1 if isinstance(top, int) else top + 1, F.greatest(last - top, F.lit(0)))


def _letters(key: Column) -> Column:
    return F.lower(F.regexp_replace(key, r"[^\p{L}]", ""))


def _key_rank(target: str, key: Column, at: Column) -> Column:
    """How a key names a target: (0, spelling) by itself, (1, place) by its letters, null if it does not."""
    spelled = _place(tuple(dict.fromkeys((target, target.upper(), target.lower(), f"S_{target}", f"s_{target}"))), key)
    plain, own = _letters(key), "".join(c for c in target if c.isalpha()).lower()
    alike = plain.contains(own) | F.lit(own).contains(plain)
    pair = lambda a, b: F.array(F.lit(a), b)
    return F.when(spelled > 0, pair(0, spelled)).when(alike, pair(1, at))


def _tries(node: Column, target: str) -> Column:
    """The ways in which a node stands for a target: (rank of the key's layer and name, number of keys down to it)."""
    keys, at = node["keys"], node["at"]
    # The root is layer 0; an object right below it under one of HOLDERS is a layer of its own.
    holder = _place(HOLDERS, F.get(keys, F.lit(0)))
    by = lambda layer, depth: _rank(layer, _key_rank(target, F.get(keys, F.lit(depth - 1)), F.get(at, F.lit(depth - 1)))).alias("by")
    own = F.array(F.struct(by(F.lit(0), 1), F.lit(1).alias("top")), F.struct(by(F.when(holder > 0, holder), 2), F.lit(2).alias("top")))
    return F.filter(own, lambda t: t["by"].isNotNull() & (F.size(keys) >= t["top"]))


def _rank(layer: Column, name: Column) -> Column:
    return F.when(layer.isNotNull() & name.isNotNull(), F.array(F.get(name, F.lit(0)), layer, F.get(name, F.lit(1))))


def _candidates(all_nodes: Column, target: str, value, test) -> Column:
    """(by, inner, value) of the nodes that stand for ``target`` and meet ``test`` of the node and of the keys down to its name."""

    def of(n: Column) -> Column:
        tries = F.filter(_tries(n, target), lambda t: test(n, t["top"]))
        return F.transform(tries, lambda t: F.struct(t["by"].alias("by"), _inner_rank(n, t["top"]).alias("inner"), value(n).alias("value")))

    return F.flatten(F.transform(F.filter(all_nodes, lambda n: value(n).isNotNull()), of))


def event_scores(raw: Column) -> Column:
    """The four scores of an event report and whether its relation score is valid; null unless all four are found.

    A score is named by a key of the root or of an object right below it that usually holds scores: first the keys spelled as usual, in
    the order of those objects, then keys whose letters hold the score's, or are held by them, in the order they are written.
    ``erel_valid`` is what the first named object with a ``valid`` says, of those tried until the score is found.
    """
    ranked = jw.once(jw.nodes(raw, through=("object",)), _ranked)
    return jw.once(ranked, _report)


def _ranked(all_nodes: Column) -> Column:
    """The best candidate of each score, and what its objects say of the relation score's validity."""
    anything = lambda n, top: F.lit(True)
    flag = lambda n, top: (F.size(n["keys"]) == top + 1) & (F.get(n["keys"], top) == "valid")
    best = [F.array_min(_candidates(all_nodes, t, jw.number_of, anything)).alias(t.lower()) for t in TARGETS]
    return F.struct(*best, _candidates(all_nodes, "ERel", lambda n: jw.number_of(n) != 0, flag).alias("said"))


def _report(ranked: Column) -> Column:
    found = {t.lower(): ranked[t.lower()]["value"] for t in TARGETS}
    tried = F.filter(ranked["said"], lambda s: s["by"] <= ranked["erel"]["by"])
    complete = ~F.exists(F.array(*found.values()), lambda x: x.isNull())
    return F.when(complete, F.struct(*(x.alias(t) for t, x in found.items()), jw.least(tried).alias("erel_valid")))


def picked_number(raw: Column, prefer: tuple[str, ...] = FALLBACK) -> Column:
    """A number of a document of unknown layout: in the first object that has one, under a preferred key, else under one that says score or band.

    Numbers may be written as strings. Objects are gone through as they are written, those that hold others before them; of a number's path the first
    key that leads elsewhere decides.
    """

    def pick(all_nodes: Column) -> Column:
        def of(n: Column) -> Column:
            key, place = F.get(n["keys"], F.size(n["keys"]) - 1), F.get(n["at"], F.size(n["at"]) - 1)
            liked, told = _place(prefer, key), F.lower(key).contains("score") | F.lower(key).isin("band", "final_band")
            last = F.when(liked > 0, liked).when(told, place + _FAR)
            # Numbers of an object come before all that lies deeper in it.
            path = F.concat(F.transform(F.slice(n["at"], 1, F.size(n["at"]) - 1), lambda k: k + (1 << 30)), F.array(last))
            value = plain_number(F.when(n["kind"].isin("number", "string"), n["text"]))
            return F.when(last.isNotNull() & (n["inside"] == "object") & value.isNotNull(), F.struct(path.alias("path"), value.alias("value")))

        inner = F.filter(all_nodes, lambda n: F.size(n["keys"]) > 0)
        return jw.least(F.filter(F.transform(inner, of), lambda c: c.isNotNull()))

    return jw.once(jw.nodes(raw), pick)
