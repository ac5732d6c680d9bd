"""Markdown put right after it was written: links to files that are there, formulas without common slips (Q6, Q10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_name
from .documents import lines

#: Inline code, which stays, or a link.
_PIECE = r"`[^`]*`|\[[^\]]*\]\([^)]*\)"
_LINK = r"(?s)^\[([^\]]*)\]\(([^)]*)\)$"


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def flat_name(path: Column) -> Column:
    """The file name that a path is flattened to: its folded parts without extensions, joined by -, and .md; '' without parts."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".", ".."))
    root = F.when(path.startswith("/"), F.array(F.lit("_"))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(root, F.filter(F.transform(parts, lambda p: match_name(_stem(p))), lambda p: p != ""))
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, "-"), F.lit(".md"))).otherwise("")


def aimed_targets(targets: DataFrame, files: DataFrame) -> DataFrame:
    """(target, new_target, action) of distinct trimmed targets (target) against the Markdown files (file_name) there are.

    Action `rewritten`: the flattened name is a file, or folds like just one, or its stem does; the anchor stays. `removed`: none
    is found, or two files fold like it. `kept`: right as it is, a web or mail address, a lone anchor, no file name. Nulls give
    no row. Two equi-joins on folded names, one row a name.
    """
    t = targets.select(F.trim("target").alias("target")).where("target is not null").distinct()
    whole = F.trim(F.regexp_replace("target", "(?s)#[^#]*$", ""))
    base = F.regexp_extract(F.coalesce(F.try_url_decode(F.replace(whole, F.lit("+"), F.lit("%2B"))), whole), "(?s)([^/]*)$", 1)
    left = (F.col("target") == "") | F.col("target").rlike("^(https?://|mailto:|#)") | (whole == "") | (base == "")
    name = F.when(flat_name(whole) != "", flat_name(whole)).otherwise(base)
    t = t.withColumns({"left": left, "flat": flat_name(whole), "anchor": F.regexp_extract("target", "(?s)(#[^#]*)$", 1), "folded": match_name(name), "stem": match_name(_stem(name))})
    known = files.select("file_name").where(F.col("file_name").endswith(".md")).distinct()
    of = lambda key, to: known.groupBy(key.alias(to)).agg(F.count("*").alias(f"{to}_n"), F.min("file_name").alias(f"{to}_file"))
    t = t.join(of(match_name(F.col("file_name")), "folded"), "folded", "left").join(of(match_name(_stem(F.col("file_name"))), "stem"), "stem", "left")
    t = t.join(known.select(F.col("file_name").alias("flat"), F.lit(True).alias("there")), "flat", "left")
    found = F.when(F.col("there"), F.when(F.col("folded_n") == 1, F.col("flat"))).when(F.col("folded_n") == 1, F.col("folded_file")).when(F.col("stem_n") == 1, F.col("stem_file"))
    new = F.when(F.col("left"), F.col("target")).otherwise(F.concat(found, "anchor"))
    action = F.when(new.isNull(), "removed").when(new == F.col("target"), "kept").otherwise("rewritten")
    return t.select("target", F.coalesce(new, F.col("target")).alias("new_target"), action.alias("action"))


def rewrite_links(docs: DataFrame) -> DataFrame:
    """(file_name, text, rewritten, removed): documents (file_name, text; names unique) with the links outside fences and inline
    code put right; a link that aims at nothing leaves its text. Both counts are 0 for a text without such links, which stays
    as it is, and for a null text, which stays null. Only documents that change are taken apart and put together again."""
    target = lambda piece: F.trim(F.regexp_extract(piece, _LINK, 2))
    pieces = lambda line: F.regexp_extract_all(line, F.lit(_PIECE), 0)
    every = lines(docs)
    used = every.where("not fenced").select("file_name", F.explode(F.filter(pieces(F.col("line")), lambda p: ~p.startswith("`"))).alias("piece"))
    used = used.select("file_name", target(F.col("piece")).alias("target")).distinct()
    new = used.join(aimed_targets(used, docs).where("action <> 'kept'"), "target")
    maps = new.groupBy("file_name").agg(F.map_from_entries(F.collect_list(F.struct("target", F.struct("new_target", "action")))).alias("new"))
    whole = every.join(maps.select("file_name"), "file_name", "left_semi").groupBy("file_name").agg(F.sort_array(F.collect_list(F.struct("line_no", "line", "fenced"))).alias("lines"))

    def put(piece: Column) -> Column:
        to = F.try_element_at(F.col("new"), target(piece))
        label = F.regexp_extract(piece, _LINK, 1)
        return F.when(piece.startswith("`") | to.isNull(), piece).when(to["action"] == "removed", label).otherwise(F.concat(F.lit("["), label, F.lit("]("), to["new_target"], F.lit(")")))

    def line(x: Column) -> Column:
        ends = F.concat(F.transform(pieces(x["line"]), put), F.array(F.lit("")))
        return F.when(x["fenced"], x["line"]).otherwise(F.array_join(F.zip_with(F.split(x["line"], _PIECE, -1), ends, lambda a, b: F.concat(a, b)), ""))

    met = F.flatten(F.transform(F.filter("lines", lambda x: ~x["fenced"]), lambda x: F.filter(pieces(x["line"]), lambda p: ~p.startswith("`"))))
    count = lambda action: F.size(F.filter(met, lambda p: F.coalesce(F.try_element_at(F.col("new"), target(p))["action"] == action, F.lit(False))))
    done = whole.join(maps, "file_name").select("file_name", F.array_join(F.transform("lines", line), "\n").alias("new_text"), count("rewritten").alias("n"), count("removed").alias("m"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return docs.select("file_name", "text").join(done, "file_name", "left").select("file_name", F.coalesce("new_text", "text").alias("text"), zero("n").alias("rewritten"), zero("m").alias("removed"))


def clean_formula(text: Column) -> Column:
    """A formula without common slips: backspaces for \\b, floor and ceil without their backslash and l or r, double powers."""
    out = F.replace(F.replace(text, F.lit("\x08eta"), F.lit("\\beta")), F.lit("\x08"), F.lit("\\b"))
    for side, letter in (("left", "l"), ("right", "r")):
        for mark in ("ceil", "floor"):
            out = F.regexp_replace(out, rf"\\{side}\s+{mark}\b", rf"\\{side}\\{letter}{mark}")
    return F.regexp_replace(out, r"\^([A-Za-z0-9])\^([A-Za-z0-9])", r"^{$1}^{$2}")
