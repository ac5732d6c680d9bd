"""Spans of a pattern in texts as columns: places, what stands between, and text put in their place and taken back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks in private use that enclose a placeholder's number.
OPEN, CLOSE = "\ue000", "\ue001"
#: Formulas in four kinds of delimiters, and the code that hides what looks like one; the first alternative that matches wins.
CODE = r"```[\s\S]*?(?:```|\z)|`[^`\n]*`"
DISPLAY, BRACKET, PAREN, INLINE = r"\$\$[\s\S]+?\$\$", r"\\\[[\s\S]+?\\\]", r"\\\([\s\S]+?\\\)", r"(?<![\\$])\$(?![\s$])[^$\n]*?(?<![\s\\])\$(?!\d)"
MATH = "|".join([CODE, DISPLAY, BRACKET, PAREN, INLINE, f"{OPEN}\\d+{CLOSE}"])
_CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"


def spans(text: Column, pattern: str) -> Column:
    """The matches of a pattern, first to last, none over another: an array of (start, end, content), places from 0.

    What stands between matches is what splitting leaves, so the lengths of both in turn give the places. Null for a null text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def add(held: Column, pair: Column) -> Column:
        start = held["at"] + F.length(pair["before"])
        end = start + F.length(pair["content"])
        return F.struct(end.alias("at"), F.concat(held["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["content"].alias("content")))).alias("spans"))

    pairs = F.transform(found, lambda x, i: F.struct(x.alias("content"), F.get(between, i).alias("before")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int, content: string>>").alias("spans"))
    return F.when(text.isNotNull(), F.aggregate(pairs, empty, add)["spans"])


def line_of(text: Column, at: Column) -> Column:
    """The line, from 1, of a place."""
    before = F.substring(text, F.lit(1), at)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def is_formula(content: Column) -> Column:
    """Whether a span of MATH is a formula: no code, and no prose in CJK letters between single dollars."""
    single = content.startswith("$") & ~content.startswith("$$")
    return ~content.startswith("`") & ~(single & content.rlike(_CJK))


def formulas(text: Column) -> Column:
    """The formulas of a text: an array of (start, end, content) with delimiters."""
    return F.filter(spans(text, MATH), lambda s: is_formula(s["content"]) & ~s["content"].startswith(OPEN))


def protect(text: Column) -> Column:
    """(text, held): each formula, and each placeholder that the text had, gives way to a placeholder with its number in held."""
    found = spans(text, MATH)
    between = F.split(text, MATH, -1)
    hidden = lambda content: is_formula(content) | content.contains(OPEN)  # noqa: E731 - code that holds a placeholder too
    held = F.filter(F.transform(found, lambda s: s["content"]), hidden)

    def put(state: Column, pair: Column) -> Column:
        goes = hidden(pair["content"])
        part = F.when(goes, F.concat(F.lit(OPEN), state["n"].cast("string"), F.lit(CLOSE))).otherwise(pair["content"])
        return F.struct((state["n"] + goes.cast("int")).alias("n"), F.concat(state["parts"], F.array(pair["before"], part)).alias("parts"))

    pairs = F.transform(found, lambda s, i: F.struct(s["content"].alias("content"), F.get(between, i).alias("before")))
    state = F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("parts")), put)
    whole = F.concat(F.array_join(state["parts"], ""), F.element_at(between, -1))
    return F.when(text.isNotNull(), F.struct(whole.alias("text"), held.alias("held")))


def restore(text: Column, held: Column) -> Column:
    """The text with what protect() held in place of the placeholders; numbers that nothing is held for stay."""
    mark = f"{OPEN}\\d+{CLOSE}"
    marks = F.regexp_extract_all(text, F.lit(mark), F.lit(0))
    put = F.transform(marks, lambda m: F.coalesce(F.get(held, F.translate(m, OPEN + CLOSE, "").cast("int")), m))
    between = F.split(text, mark, -1)
    return F.array_join(F.flatten(F.zip_with(between, put, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
