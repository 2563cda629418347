"""Chat formatting by quotation linking, on DataFrame functions alone.

A line's quote level is the number of ``>`` in front of it. A passage is a run of lines of one level above 0. Its normalised
text is hashed and joined to the units of earlier messages of the conversation: whole own texts, paragraphs, lines, and runs of as many
lines as passages there have. Long passages are found by two runs of 2, 4, 8, ... lines that cover all of them, hashed by doubling, at
the right distance in one message. The earliest message that holds the unit is the original. A passage that is no unit, as one with a line of
its own among the quoted ones, belongs to the message that most of its lines are from, if that is half of them at least.

A message replies to the original of its shallowest, first linked passage. Roots, depths and places come from pointer doubling over the
replies: a message's place is its number in its thread when every reply, with all that follows from it, stands after the message it answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

BLANK = r"[\x20\x09-\x0D]+"
MARKS = r"^[\x20\x09]*(?:>[\x20\x09]*)+"
#: A line that only announces the quote below it.
LEAD = r"(wrote|schrieb|écrit|escribió)[\x20\x09]*:[\x20\x09\x0D]*$"
QUOTED = r"(^|\n)[\x20\x09]*>"
KEY = ("_conv", "_turn", "_text")
#: Lines up to which runs are hashed at each length that passages have; longer ones are hashed by doubling.
RUN = 16


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def _normal(text: Column) -> Column:
    """ASCII lower case, runs of blanks as one space, none at the ends."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.trim(F.regexp_replace(text, BLANK, " ")), upper, upper.lower())


def own_text(text: Column) -> Column:
    """The lines of level 0 without those that lead a quote in, stripped. The one-element array binds the lines once."""
    is_own = lambda lines: lambda line, i: (_level(line) == 0) & ~(line.rlike(LEAD) & (_level(F.coalesce(F.get(lines, i + 1), F.lit(""))) > 0))
    kept = F.flatten(F.transform(F.array(_lines(text)), lambda lines: F.filter(lines, is_own(lines))))
    return _strip(F.when(F.coalesce(text.rlike(QUOTED), F.lit(False)), F.array_join(kept, "\n")).otherwise(F.coalesce(text, F.lit(""))))


def _said(lines: Column) -> Column:
    """Lines normalised, without blank ones."""
    return F.filter(F.transform(lines, _normal), lambda x: x != "")


def _messages(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("long").alias("_conv"), F.col("turn").cast("long").alias("_turn"), F.col("role").cast("string").alias("_role"), F.col("text").cast("string").alias("_body")).withColumn("_text", F.xxhash64("_body"))


def passages(messages: DataFrame) -> DataFrame:
    """(message key, level, pos of its first line, said: its lines, normalised) of each quoted passage; those that are blank are left out."""
    quoting = messages.where(F.col("_body").rlike(QUOTED)).select(*KEY, "_body").distinct()
    line = quoting.select(*KEY, F.posexplode(_lines(F.col("_body"))).alias("_pos", "_line")).withColumn("_level", _level(F.col("_line")))
    w = Window.partitionBy(*KEY).orderBy("_pos")
    runs = line.withColumn("_new", F.when(F.col("_level") == F.lag("_level").over(w), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    runs = runs.where("_level > 0").groupBy(*KEY, "_level", "_run")
    # A passage is part of one message, so the list is no longer than its text.
    listed = F.array_sort(F.collect_list(F.struct("_pos", F.regexp_replace("_line", MARKS, "").alias("_line"))))
    joined = runs.agg(F.min("_pos").alias("_pos"), _said(F.transform(listed, lambda x: x["_line"])).alias("_said"))
    return joined.where(F.size("_said") > 0).select(*KEY, "_level", "_pos", "_said")


def units(messages: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conversation, turn, hash) of whole own texts, paragraphs, lines, and runs of lines of the lengths in ``sizes`` (conversation, array)."""
    own = messages.select("_conv", "_turn", own_text(F.col("_body")).alias("_own")).join(sizes, "_conv", "left")
    parts = F.transform(F.concat(F.array("_own"), F.split("_own", r"\n[\x20\x09-\x0D]*\n", -1)), _normal)
    said = _said(F.split("_own", "\n", -1))
    # The one-element array binds the lines once.
    runs = F.flatten(F.transform(F.array(said), lambda ls: F.flatten(F.transform(F.filter("_sizes", lambda m: m <= F.size(ls)), lambda m: F.transform(F.sequence(F.lit(1), F.size(ls) - m + 1), lambda i: F.array_join(F.slice(ls, i, m), " "))))))
    every = F.array_distinct(F.concat(parts, said, F.coalesce(runs, F.array().cast("array<string>"))))
    return own.select("_conv", "_turn", F.explode(every).alias("_unit")).where("_unit <> ''").select("_conv", "_turn", F.md5("_unit").alias("_hash"))


def quote_links(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, level, pos, origin: a row per quoted passage; origin is the turn it was taken from, or null."""
    found = _links(_messages(conversations))
    return found.select(F.col("_conv").alias("conv_id"), F.col("_turn").alias("turn"), F.col("_level").alias("level"), F.col("_pos").alias("pos"), F.col("_origin").alias("origin"))


def _by_doubling(lines: Column, top: Column) -> Column:
    """For k from 0 to ``top`` (1 at least) the hashes of all runs of 2**k lines, each made of two runs of half the length."""

    start = F.struct(F.lit(1).alias("size"), F.transform(lines, F.md5).alias("last"), F.array(F.transform(lines, F.md5)).alias("all"))

    def twice(acc: Column, _: Column) -> Column:
        more = F.size(acc["last"]) - acc["size"]
        pair = F.transform(F.sequence(F.lit(0), more - 1), lambda i: F.md5(F.concat(F.get(acc["last"], i), F.get(acc["last"], i + acc["size"]))))
        runs = F.when(more > 0, pair).otherwise(F.array().cast("array<string>"))
        return F.struct((acc["size"] * 2).alias("size"), runs.alias("last"), F.array_append(acc["all"], runs).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), top), start, twice, lambda acc: acc["all"])


def _long_origins(found: DataFrame, messages: DataFrame) -> DataFrame:
    """(message key, level, pos, turn of the first message that has all its lines in a row) of passages of over RUN lines."""
    n = F.size("_said")
    long = found.where(n > RUN).withColumn("_k", F.length(F.bin(n)) - 1)  # 2**k lines at each end cover the passage
    long = long.withColumns({"_runs": F.get(_by_doubling(F.col("_said"), F.col("_k")), F.col("_k")), "_far": n - F.expr("cast(power(2, _k) as int)")})
    long = cut(long.select(*KEY, "_level", "_pos", "_k", F.get("_runs", F.lit(0)).alias("_head"), F.get("_runs", F.col("_far")).alias("_end"), "_far"), "quote-long")
    name = ["_conv", "_k", "_head", "_end", "_far"]
    wanted = long.select(*name).distinct()
    deep = wanted.groupBy("_conv").agg(F.max("_k").alias("_top"))
    own = messages.join(deep, "_conv").select("_conv", "_turn", "_top", _said(F.split(own_text(F.col("_body")), "\n", -1)).alias("_lines")).where(F.size("_lines") > RUN)
    runs = own.select("_conv", F.col("_turn").alias("_origin"), F.posexplode(_by_doubling(F.col("_lines"), F.col("_top"))).alias("_k", "_each")).where(F.col("_k") >= RUN.bit_length() - 1)
    runs = cut(runs.select("_conv", "_origin", "_k", F.posexplode("_each").alias("_at", "_hash")), "quote-runs")
    heads = wanted.join(runs.withColumnRenamed("_hash", "_head"), ["_conv", "_k", "_head"]).withColumn("_at", F.col("_at") + F.col("_far"))
    both = heads.join(runs.withColumnRenamed("_hash", "_end"), ["_conv", "_origin", "_k", "_at", "_end"])
    first = both.groupBy(*name).agg(F.min("_origin").alias("_long"))
    return long.join(first, name).select(*KEY, "_level", "_pos", "_long")


def _links(messages: DataFrame) -> DataFrame:
    found = cut(passages(messages.where("_conv is not null and _turn is not null")), "quote-passages")
    n = F.size("_said")
    found = found.withColumn("_hash", F.md5(F.array_join("_said", " ")))
    sizes = found.groupBy("_conv").agg(F.collect_set(F.when(n <= RUN, n)).alias("_sizes"))  # RUN numbers at most
    told = messages.where("_turn is not null")
    where = cut(units(told.join(sizes.select("_conv"), "_conv", "left_semi"), sizes), "quote-units")
    first = where.groupBy("_conv", "_hash").agg(F.min("_turn").alias("_origin"))
    before = F.col("_origin") < F.col("_turn")
    whole = found.join(first, ["_conv", "_hash"], "left")
    if found.where(n > RUN).head(1):
        whole = whole.join(_long_origins(found, told), [*KEY, "_level", "_pos"], "left").withColumn("_origin", F.least("_origin", "_long"))
    whole = whole.withColumn("_origin", F.when(before, F.col("_origin")))
    place = [*KEY, "_level", "_pos"]
    whole = cut(whole.select(*place, "_said", "_origin"), "quote-whole")
    # Passages that are no unit: each line to the first message that has it, the passage to the message that most of them name.
    line = whole.where("_origin is null").select(*place, F.size("_said").alias("_n"), F.explode("_said").alias("_line")).withColumn("_hash", F.md5("_line"))
    votes = line.join(first, ["_conv", "_hash"]).where(before).groupBy(*place, "_n", "_origin").agg(F.count("*").alias("_votes")).where(2 * F.col("_votes") >= F.col("_n"))
    most = votes.groupBy(*place).agg(F.min(F.struct(-F.col("_votes"), "_origin")).alias("_best")).select(*place, F.col("_best._origin").alias("_most"))
    return cut(whole.join(most, place, "left").select(*place, F.coalesce("_origin", "_most").alias("_origin")), "quote-links")


def _doubled(cur: DataFrame, values: list[str], plus: dict[str, Column]) -> DataFrame:
    """One step of pointer doubling: ``plus`` of each row and of the row that ``_up`` names (its columns end in 2), or null where there is none."""
    other = cur.select("_conv", F.col("_turn").alias("_up"), *(F.col(c).alias(f"{c}2") for c in values))
    return cur.join(other, ["_conv", "_up"], "left").select("_conv", "_turn", "_up", *(plus[c].alias(c) for c in values))


def _threads(parents: DataFrame) -> DataFrame:
    """(conversation, turn, root, depth, place) of every turn that has a parent. Parents have smaller turns, so that there are no rings.

    First each row's 1, 2, 4, ... ancestors and the number of messages that hang on it, then, with each reply's distance behind its parent (1 and
    what hangs on the siblings before it), sums along the ancestors.
    """
    cur = cut(parents.select("_conv", "_turn", F.col("_parent").alias("_up"), F.lit(1).cast("long").alias("_size")), "quote-sizes")
    ups = []
    while cur.where("_up is not null").head(1):
        ups.append(cur.select("_conv", "_turn", "_up"))
        below = cur.where("_up is not null").groupBy("_conv", F.col("_up").alias("_turn")).agg(F.sum("_size").alias("_more"))
        jump = cur.select("_conv", F.col("_turn").alias("_up"), F.col("_up").alias("_next"))
        nxt = cur.join(below, ["_conv", "_turn"], "left").join(jump, ["_conv", "_up"], "left")
        cur = cut(nxt.select("_conv", "_turn", F.col("_next").alias("_up"), (F.col("_size") + F.coalesce("_more", F.lit(0))).alias("_size")), "quote-sizes")
    # Siblings before a reply, in two steps, since one message may have very many.
    row = parents.join(cur.select("_conv", "_turn", "_size"), ["_conv", "_turn"]).withColumn("_far", F.expr("_turn div 4096"))
    so_far = lambda w: F.coalesce(F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    far = row.groupBy("_conv", "_parent", "_far").agg(F.sum("_size").alias("_size"))
    far = far.select("_conv", "_parent", "_far", so_far(Window.partitionBy("_conv", "_parent").orderBy("_far")).alias("_base"))
    near = row.join(far, ["_conv", "_parent", "_far"]).withColumn("_own", so_far(Window.partitionBy("_conv", "_parent", "_far").orderBy("_turn")))
    one = F.lit(1).cast("long")
    out = near.select("_conv", "_turn", F.col("_parent").alias("_root"), one.alias("_depth"), (1 + F.col("_base") + F.col("_own")).alias("_place"))
    for up in ups:
        values = ["_root", "_depth", "_place"]
        sums = {c: F.col(c) + F.coalesce(f"{c}2", F.lit(0)) for c in values[1:]} | {"_root": F.coalesce("_root2", "_root")}
        out = cut(_doubled(out.join(up, ["_conv", "_turn"]), values, sums).drop("_up"), "quote-places")
    return out


def reply_order(conversations: DataFrame) -> DataFrame:
    """A row per message: conv_id, turn, role, text (without quotes), n_quotes, n_linked, max_level, parent_turn, root_turn, depth, place.

    Sorted by conv_id, root_turn, place, messages stand in reply order: each thread by the turn of its first message, in it every reply
    after the message it answers, with its own replies before the next one. The order is told by columns, and nothing is gathered
    by conversation, since one may hold a third of all rows. A message without a linked quote starts a thread of its own.

    Null texts are empty. Rows with a null conversation or turn link to nothing and have themselves as root. Rows that repeat a
    conversation and turn are kept; the first of their links, by level, place and turn, is the parent of all of them. Quotes are of
    earlier turns only. Other columns are not looked at.
    """
    messages = _messages(conversations)
    links = _links(messages)
    told = links.groupBy(*KEY).agg(F.count("*").alias("_quotes"), F.count("_origin").alias("_linked"), F.max("_level").alias("_deepest"))
    parents = links.where("_origin is not null").groupBy("_conv", "_turn").agg(F.min(F.struct("_level", "_pos", "_origin")).alias("_best")).select("_conv", "_turn", F.col("_best._origin").alias("_parent"))
    parents = cut(parents, "quote-parents")
    placed = parents.join(_threads(parents), ["_conv", "_turn"])
    out = messages.join(told, list(KEY), "left").join(placed, ["_conv", "_turn"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(
        F.col("_conv").alias("conv_id"), F.col("_turn").alias("turn"), F.col("_role").alias("role"), own_text(F.col("_body")).alias("text"), zero("_quotes").alias("n_quotes"), zero("_linked").alias("n_linked"), zero("_deepest").alias("max_level"),
        F.col("_parent").alias("parent_turn"), F.coalesce("_root", "_turn").alias("root_turn"), zero("_depth").alias("depth"), zero("_place").alias("place"),
    )


def render(ordered: DataFrame, *, start: str = "<|", stop: str = "|>\n", end: str = "\n") -> DataFrame:
    """``reply_order`` with ``chat``, each message in its turn format."""
    return ordered.withColumn("chat", F.concat(F.lit(start), F.coalesce("role", F.lit("")), F.lit(stop), F.col("text"), F.lit(end)))


def threads(rendered: DataFrame, *, most: int = 64) -> DataFrame:
    """conv_id, root_turn, part, n_messages, turns, parents, n_quotes, n_linked, chat: conversations in reply order, without quotes.

    A thread of over ``most`` places goes on in further parts, so that none is gathered whole, whatever its length; rows that repeat a turn share its
    place and stand by role and text. ``turns`` and ``parents`` (-1: none) are joined by commas. Messages without conversation or turn are in no thread.
    """
    cells = F.struct("place", "role", "text", "turn", F.coalesce("parent_turn", F.lit(-1)).alias("parent"), "chat")
    rows = rendered.where("conv_id is not null and turn is not null").withColumn("part", F.floor(F.col("place") / most).cast("long"))
    got = rows.groupBy("conv_id", "root_turn", "part").agg(F.array_sort(F.collect_list(cells)).alias("m"), F.sum("n_quotes").alias("n_quotes"), F.sum("n_linked").alias("n_linked"))
    told = lambda c, by: F.array_join(F.transform("m", lambda x: x[c].cast("string")), by)
    return got.select("conv_id", "root_turn", "part", F.size("m").cast("long").alias("n_messages"), told("turn", ",").alias("turns"), told("parent", ",").alias("parents"), "n_quotes", "n_linked", told("chat", "").alias("chat"))
