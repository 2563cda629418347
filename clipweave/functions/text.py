"""Text normalisers and tolerant parsers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that count as a space, and what is stripped from both ends of a value.
BLANKS = "[  -​  　]"
EDGE = "[\\s\"'`.,;:!?()\\[\\]{}<>]+"
#: Keys whose values may have no letters.
FREE_KEYS = ("number-or-id", "printed-text", "signature")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalise(text: Column) -> Column:
    """Odd blanks to spaces, lower case, edges stripped, ``_`` to ``-``, no blanks around ``-``, single ``-`` and spaces."""
    t = F.lower(F.regexp_replace(text, BLANKS, " "))
    t = F.regexp_replace(F.regexp_replace(t, f"^{EDGE}", ""), f"{EDGE}$", "")
    t = F.regexp_replace(F.replace(t, F.lit("_"), F.lit("-")), r"\s*-\s*", "-")
    return squeeze(F.regexp_replace(t, "--+", "-"))


def keeps_value(key: Column, value: Column) -> Column:
    """Whether a normalised attribute value is worth comparing: letters unless the key is free, and not one letter in two characters or less."""
    letters = F.length(F.regexp_replace(value, "[^a-z]", ""))
    return (value != "") & ((letters > 0) | key.isin(*FREE_KEYS)) & ~((letters <= 1) & (F.length(value) <= 2))


def clauses(text: Column, most: int = 8) -> Column:
    """Parts between ``|``, full stops, colons and semicolons, trimmed, the blank ones dropped, the first ``most``."""
    parts = F.transform(F.split(text, "[|。:;.]"), lambda p: F.trim(p))
    return F.slice(F.filter(parts, lambda p: p != ""), 1, most)


def tolerant_float(text: Column) -> Column:
    """The number that a cell holds, percent signs and thousands commas allowed; null where there is none."""
    return F.trim(F.regexp_replace(text, "[,%]", "")).try_cast("double")


def plain_number(text: Column) -> Column:
    """The number that a text is, blanks at its ends apart; null of all else."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def stem(path: Column) -> Column:
    """Last part of a path or URL without query, fragment and extension."""
    last = F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"/+$", "")
    return F.regexp_replace(F.regexp_extract(last, r"([^/]*)$", 1), r"\.[A-Za-z0-9]{1,5}$", "")


def judged_consistency(raw: Column) -> Column:
    """0 to 100 from a judge's answer: the field of a clean JSON object, else the first whole number up to 100 that stands alone, else 0."""
    clean = F.regexp_replace(F.regexp_replace(raw, r"```(?:json)?", ""), r"^\s+|\s+$", "")
    as_json = F.when(clean.rlike(r"^\{[^{}]*\}$"), F.get_json_object(clean, "$.consistency").try_cast("double").cast("int"))
    alone = F.regexp_extract(raw, r"(?:^|[^0-9])(100|[0-9]{1,2})(?:[^0-9]|$)", 1).try_cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(as_json, alone, F.lit(0))))


def band(mean: Column) -> Column:
    """World band 1 to 5 of a mean consistency; none is 1."""
    return F.when(mean >= 80, 5).when(mean >= 60, 4).when(mean >= 40, 3).when(mean >= 20, 2).otherwise(1)


def token(text: Column) -> Column:
    return F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit("-"))


def slug(text: Column, most: int = 60) -> Column:
    return F.regexp_replace(F.left(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit(most)), "^-+|-+$", "")


def cleaned_caption(text: Column, most: int = 160) -> Column:
    """Tags, fences and line ends out; cut after the first sentence if it ends within ``most`` characters, else at ``most``."""
    flat = squeeze(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), "`+", " "))
    end = F.instr(flat, ". ")
    return F.when((end > 0) & (end < most), F.substring(flat, F.lit(1), end)).otherwise(F.left(flat, F.lit(most)))


def without_thoughts(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?is)<think>.*?</think>", ""))


def prompt_words(text: Column, stop: tuple[str, ...]) -> Column:
    """Distinct words of three letters or more, lower case, in order, without stop words."""
    words = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.length(w) >= 3)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, stop)))


def has_chinese(text: Column) -> Column:
    return text.rlike("[\\x{4e00}-\\x{9fff}]")


def bounded_number(text: Column) -> Column:
    """A count or number with ``>``, ``<``, ``~`` and ``+`` around it; 0 where there is none."""
    return F.coalesce(F.trim(F.translate(text, "><~+", "")).try_cast("double"), F.lit(0.0))


def guarded_json(text: Column, path: str) -> Column:
    """A field of the text as JSON, else of its widest ``{...}``, else null."""
    return F.coalesce(F.get_json_object(text, path), F.get_json_object(F.regexp_extract(text, r"(?s)\{.*\}", 0), path))
