"""Checks of Markdown documents (file_name, text): headings, anchors, links, diagrams and formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import heading_text, slug


def lines(docs: DataFrame) -> DataFrame:
    """(file_name, line_no from 1, line, fenced): fenced lines stand inside a code fence or open or close one."""
    exploded = docs.select("file_name", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
    mark = F.ltrim("line").startswith("```").cast("int")
    run = W.Window.partitionBy("file_name").orderBy("line_no").rowsBetween(W.Window.unboundedPreceding, 0)
    return exploded.withColumn("fenced", (F.sum(mark).over(run) % 2 == 1) | (mark == 1))


def headings(docs: DataFrame) -> DataFrame:
    """(file_name, line_no, level, title): ATX headings, and lines underlined with = or -. Fences are not looked at."""
    own = W.Window.partitionBy("file_name").orderBy("line_no")
    rows = lines(docs).withColumn("next", F.lead("line").over(own))
    atx = F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)
    under = F.when((F.trim("line") != "") & (atx == ""), F.when(F.col("next").rlike(r"^=+\s*$"), 1).when(F.col("next").rlike(r"^-+\s*$"), 2))
    level = F.when(atx != "", F.length(atx)).otherwise(under)
    return rows.withColumn("level", level).where("level is not null").select("file_name", "line_no", "level", heading_text(F.col("line")).alias("title"))


def anchors(docs: DataFrame) -> DataFrame:
    """(file_name, line_no, anchor): slugs of the headings, later equal ones numbered -1, -2."""
    titled = headings(docs).withColumn("s", slug(F.col("title")))
    n = F.row_number().over(W.Window.partitionBy("file_name", "s").orderBy("line_no")) - 1
    return titled.withColumn("n", n).select("file_name", "line_no", F.when(F.col("n") > 0, F.concat_ws("-", "s", F.col("n").cast("string"))).otherwise(F.col("s")).alias("anchor"))


def links(docs: DataFrame) -> DataFrame:
    """(file_name, line_no, target): Markdown links outside code fences."""
    return lines(docs).where("not fenced").select("file_name", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"(?<!!)\[[^\]]*\]\(([^)]*)\)"), 1)).alias("target"))


def normal_path(base: Column, target: Column) -> Column:
    """target as seen from the folder of base, with . and .. resolved."""
    folder = F.regexp_replace(base, "[^/]*$", "")
    parts = F.split(F.when(target.startswith("/"), F.substring(target, 2, 1 << 20)).otherwise(F.concat(folder, target)), "/")
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "") | (p == "."), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.array_join(done, "/")


def link_issues(docs: DataFrame) -> DataFrame:
    """(file_name, line_no, target, issue): empty_link, file_not_found or anchor_not_found. Web and mail links are left alone."""
    found = links(docs).where(~F.lower("target").rlike("^(https?:|mailto:)"))
    path, anchor = F.substring_index("target", "#", 1), F.when(F.instr("target", "#") > 0, F.regexp_extract("target", "#(.*)$", 1))
    aimed = found.withColumns({"to_file": F.when(path == "", F.col("file_name")).otherwise(normal_path(F.col("file_name"), path)), "to_anchor": anchor})
    files = docs.select(F.col("file_name").alias("to_file"), F.lit(True).alias("has_file")).distinct()
    known = anchors(docs).select(F.col("file_name").alias("to_file"), F.col("anchor").alias("to_anchor"), F.lit(True).alias("has_anchor")).distinct()
    judged = aimed.join(files, "to_file", "left").join(known, ["to_file", "to_anchor"], "left")
    issue = F.when(F.trim("target") == "", "empty_link").when(F.col("has_file").isNull(), "file_not_found").when((F.coalesce("to_anchor", F.lit("")) != "") & F.col("has_anchor").isNull(), "anchor_not_found")
    return judged.select("file_name", "line_no", "target", issue.alias("issue")).where("issue is not null")


def lint_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue").agg(F.count("*").alias("n"), F.count_distinct("file_name").alias("files"))


def fenced_blocks(docs: DataFrame, language: str) -> DataFrame:
    """(file_name, block, content) of the code fences of a language."""
    return docs.select("file_name", F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?s)(?:^|\n)```{language}[ \t]*\n(.*?)\n```"), 1)).alias("block", "content"))


def bracket_depths(text: Column, opening: str, closing: str) -> Column:
    """(depth, lowest): the balance of brackets at the end and at its lowest; a fold over the brackets alone. A backslash
    takes the character after it out of the count."""
    only = F.filter(F.split(F.regexp_replace(text, r"\\.", ""), ""), lambda c: (c == opening) | (c == closing))
    return F.aggregate(only, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest")), lambda a, c: F.transform(F.array(F.when(c == opening, a["depth"] + 1).otherwise(a["depth"] - 1)), lambda d: F.struct(d.alias("depth"), F.least(a["lowest"], d).alias("lowest")))[0])


def balanced(text: Column, opening: str = "{", closing: str = "}") -> Column:
    d = bracket_depths(text, opening, closing)
    return (d["depth"] == 0) & (d["lowest"] == 0)


def formulas(docs: DataFrame) -> DataFrame:
    """(file_name, display, content, balanced): formulas in $$ or $ outside code fences and spans."""
    plain = F.regexp_replace(F.regexp_replace("text", r"(?s)```.*?```", ""), "`[^`\n]*`", "")
    shown = docs.select("file_name", F.lit(True).alias("display"), F.explode(F.regexp_extract_all(plain, F.lit(r"(?s)\$\$(.+?)\$\$"), 1)).alias("content"))
    inline = docs.select("file_name", F.lit(False).alias("display"), F.explode(F.regexp_extract_all(F.regexp_replace(plain, r"(?s)\$\$.+?\$\$", ""), F.lit(r"(?<![\\$])\$([^$\n]+?)\$"), 1)).alias("content"))
    return shown.unionByName(inline).withColumn("balanced", balanced(F.col("content")))
