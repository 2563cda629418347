"""Mixing sources to target weights by hierarchical budgets.

A token budget goes down a domain-language-source tree. Under each node its budget is shared in proportion to the
children's weights; what a child cannot fill (its tokens times the epochs allowed) goes to its siblings, and only
what a whole subtree cannot fill has gone to the siblings of an ancestor. Each leaf then takes whole epochs and a
token-prefix of one more epoch, in an order seeded by epoch.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

TREE = ("_domain", "_lang", "_source")
WORD = r"[^\x20\x09-\x0D]+"
#: Leaves up to which their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_LEAVES = 50_000
DOMAIN = "concat('d', pmod(coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint), 0), 4))"


def _weight(column: str, weights: Mapping[str, int], default: int = 1) -> Column:
    out = F.lit(default)
    for k in sorted(weights):
        out = F.when(F.col(column) == k, F.lit(int(weights[k]))).otherwise(out)
    return out.cast("double")


def share(nodes: DataFrame, parent: list[str], name: str, budget: str, capacity: str, weight: str, out: str) -> DataFrame:
    """Adds ``out``: each node's part of its parent's ``budget``: min(capacity, weight * level), whole tokens, with one level per parent.

    Nodes in order of capacity by weight fill up one after another; the level is what the rest of the budget leaves for
    the rest of the weight where the first node no longer fills up. Nodes of no weight get nothing.
    """
    w = Window.partitionBy(*parent).orderBy(F.col(capacity) / F.col(weight), name)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    live = nodes.where(F.col(weight) > 0)
    level = (F.col(budget) - F.coalesce(F.sum(capacity).over(before), F.lit(0))).cast("double") / F.sum(weight).over(after)
    live = live.withColumn("_level", level).withColumn("_open", F.col(capacity) > F.col("_level") * F.col(weight))
    top = F.max(F.when(F.col("_open"), F.col("_level"))).over(Window.partitionBy(*parent))
    part = F.when(F.col("_open"), F.floor(F.greatest(top, F.lit(0.0)) * F.col(weight))).otherwise(F.col(capacity)).cast("long")
    return live.withColumn("_top", top).withColumn(out, part).drop("_level", "_open", "_top")


def budgets(leaves: DataFrame, *, fraction: float, max_epochs: int, domains: Mapping[str, int], langs: Mapping[str, int], sources: Mapping[str, int]) -> DataFrame:
    """Leaves (tree, tokens) with ``budget``, ``epochs`` (whole ones) and ``rest`` (tokens of one more)."""
    cap = leaves.withColumn("_cap", (F.col("tokens") * max_epochs).cast("long"))
    d, l, s = TREE
    # One row per domain; these tables have a row per node of the tree, not per document.
    total = leaves.agg(F.floor(F.sum("tokens").cast("double") * fraction).cast("long").alias("_total"))
    level = cap.groupBy(d).agg(F.sum("_cap").alias("_cap")).crossJoin(F.broadcast(total)).withColumn("_w", _weight(d, domains)).withColumn("_all", F.lit(0))
    level = share(level, ["_all"], d, "_total", "_cap", "_w", "_b1").select(d, "_b1")
    nxt = cap.groupBy(d, l).agg(F.sum("_cap").alias("_cap")).join(level, d).withColumn("_w", _weight(l, langs))
    nxt = share(nxt, [d], l, "_b1", "_cap", "_w", "_b2").select(d, l, "_b2")
    last = cap.join(nxt, [d, l]).withColumn("_w", _weight(s, sources))
    last = share(last, [d, l], s, "_b2", "_cap", "_w", "budget")
    return last.select(*TREE, "tokens", "budget", F.expr("budget div tokens").alias("epochs"), (F.col("budget") % F.col("tokens")).alias("rest"))


def _key(seed: int) -> Column:
    """Place of a document in its leaf's epoch after the whole ones."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("_doc").cast("string"), F.lit(""))))


def _tree(docs: DataFrame, domain: str, lang: str, source: str) -> DataFrame:
    empty = F.lit("")
    return docs.withColumns({TREE[0]: F.coalesce(F.expr(domain).cast("string"), empty), TREE[1]: F.coalesce(F.col(lang).cast("string"), empty), TREE[2]: F.coalesce(F.col(source).cast("string"), empty)})


def plan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", domain: str = DOMAIN, fraction: float = 0.6, max_epochs: int = 2, domains: Mapping[str, int] | None = None, langs: Mapping[str, int] | None = None, sources: Mapping[str, int] | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(documents with their words counted, leaves with ``epochs``, ``budget`` and ``cut``, the last key of the prefix).

    A prefix is found in two steps, since a leaf may hold a third of all rows: token sums of 4,096 ranges of
    keys show the range where the budget ends, and only that range is walked key by key.
    """
    # regexp_count would keep every word; a sum of parts between spaces is as exact.
    counted = _tree(docs, domain, lang, source).select(F.col(doc_id).alias("_doc"), *TREE, F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))).cast("long").alias("n_tokens"))
    slim = cut(counted.where("n_tokens > 0"), "mix-docs")
    leaves = cut(budgets(slim.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens")), fraction=fraction, max_epochs=max_epochs, domains=domains or {}, langs=langs or {}, sources=sources or {}), "mix-leaves")
    keyed = _with_leaves(slim, leaves).where("rest > 0").withColumn("_k", _key(seed)).withColumn("_range", F.substring("_k", 1, 3))
    sums = keyed.groupBy(*TREE, "rest", "_range").agg(F.sum("n_tokens").alias("_t"))
    w = Window.partitionBy(*TREE).orderBy("_range")
    ends = sums.withColumn("_before", F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")).where("_before <= rest and _before + _t > rest").select(*TREE, "_range", "_before")
    edge = keyed.join(ends, [*TREE, "_range"]).groupBy(*TREE, "rest", "_before", "_range", "_k").agg(F.sum("n_tokens").alias("_t"))
    walked = edge.withColumn("_upto", F.col("_before") + F.sum("_t").over(Window.partitionBy(*TREE).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)))
    # Where even the range's first key does not fit, the range's own name stands before all its keys.
    cuts = walked.groupBy(*TREE).agg(F.coalesce(F.max(F.when(F.col("_upto") <= F.col("rest"), F.col("_k"))), F.first("_range")).alias("cut"))
    return slim, cut(leaves.join(cuts, list(TREE), "left"), "mix-cuts")


def _with_leaves(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    few = leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return docs.join(F.broadcast(leaves) if few else leaves, list(TREE))


def _copies(seed: int) -> Column:
    return (F.col("epochs") + F.when(_key(seed) <= F.col("cut"), 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, *, seed: int = 11, **options) -> DataFrame:
    """A row per selected document: doc_id, domain, lang, source, n_tokens, copies (epochs in which it is taken).

    Tokens are words. Documents without words (null and empty texts too) are never selected. Null languages and
    sources are leaves of their own, named ''. Rows that repeat an id share a place in the order and are taken together.
    """
    slim, leaves = plan(docs, seed=seed, **options)
    return _with_leaves(slim, leaves).withColumn("copies", _copies(seed)).where("copies > 0").select(F.col("_doc").alias("doc_id"), *(F.col(c).alias(c[1:]) for c in TREE), "n_tokens", "copies")


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", domain: str = DOMAIN, seed: int = 11, **options) -> DataFrame:
    """The selected rows of ``docs``, each as often as it is taken, with the columns of ``docs``; see ``mix_plan``."""
    _, leaves = plan(docs, doc_id=doc_id, text=text, lang=lang, source=source, domain=domain, seed=seed, **options)
    leaves = leaves.select(*TREE, "epochs", "cut").withColumnsRenamed({"epochs": "_epochs", "cut": "_cut"})
    rows = _with_leaves(_tree(docs.where(F.col(text).rlike(WORD)), domain, lang, source).withColumn("_doc", F.col(doc_id)), leaves)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_epochs").cast("string"), F.coalesce(F.col("_doc").cast("string"), F.lit(""))))
    n = F.col("_epochs") + F.when(key <= F.col("_cut"), 1).otherwise(0)
    return rows.withColumn("_n", n).where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n").cast("long")))).select(*(F.col(c) for c in docs.columns))
