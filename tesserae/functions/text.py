"""Scalar functions on identifiers, paths, headings and prose as Column expressions (all inside codegen)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def symbol_file(symbol_id: Column) -> Column:
    """The file of `lang:path#name(kind)`, or of `file:path`; null for others."""
    body = F.substring(symbol_id, F.instr(symbol_id, ":") + 1, F.length(symbol_id))
    return F.when(symbol_id.contains("#"), F.substring_index(body, "#", 1)).when(symbol_id.startswith("file:"), body)


def symbol_name(symbol_id: Column) -> Column:
    """The top-level name of a symbol id: what follows # up to a dot, colon or bracket; null without #."""
    return F.when(symbol_id.contains("#"), F.regexp_extract(F.substring_index(symbol_id, "#", -1), r"^[^.:(]+", 0))


def component_name(component_id: Column) -> Column:
    """What follows the first ::, else the last dotted segment."""
    return F.when(component_id.contains("::"), F.substring(component_id, F.instr(component_id, "::") + 2, F.length(component_id))).otherwise(F.substring_index(component_id, ".", -1))


def identifier_tokens(name: Column) -> Column:
    """Lower-case tokens of a camel- or snake-case identifier."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda x: x != "")


def first_sentences(text: Column, sentences: int = 2, most: int = 300) -> Column:
    """The first sentences, ended by white space after . ! or ?; cut at `most` characters with an ellipsis."""
    head = F.array_join(F.slice(F.split(F.trim(text), r"(?<=[.!?])\s+"), 1, sentences), " ")
    return F.when(F.length(head) > most, F.concat(F.substring(head, 1, most), F.lit("…"))).otherwise(head)


def doc_filename(path: Column) -> Column:
    """The document name of a module path (an array): normalised parts joined by -, overview.md for none."""
    part = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(F.lower(F.trim(p)), F.lit("&"), F.lit("and")), r"[\s/-]+", "_"), r"(?U)[^\w]", ""), "_+", "_")
    return F.when(F.coalesce(F.size(path), F.lit(0)) <= 0, "overview.md").otherwise(F.concat(F.array_join(F.transform(path, lambda p: F.trim(part(p), F.lit("_"))), "-"), F.lit(".md")))


def heading_text(markdown: Column) -> Column:
    """The visible text of a Markdown heading: links, images, code, emphasis and marks gone."""
    out = F.regexp_replace(markdown, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    for pattern, put in ((r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"`([^`]*)`", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"__([^_]+)__", "$1"), (r"\*([^*]+)\*", "$1"), (r"^\s*#{1,6}\s+", ""), (r"\s+#+\s*$", "")):
        out = F.regexp_replace(out, pattern, put)
    return F.trim(out)


def slug(text: Column) -> Column:
    """The anchor of a heading: lower case, words and - kept, white space as -."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\w\s-]", ""), r"(?U)\s", "-")


def safe_id(doc_id: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(doc_id), "[^a-z0-9]+", "_"), F.lit("_")), 1, 120)


def paragraphs(text: Column) -> Column:
    """Paragraphs, separated by blank lines; empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"\n[ \t]*\n"), lambda p: F.trim(p, F.lit(" \n\t"))), lambda p: p != "")


def truncate_lines(text: Column, most: int = 200, head: float = 0.6) -> Column:
    """Keeps the first 60 % and last 40 % of the lines of a text that has more than `most`, with a mark between."""
    lines, top = F.split(text, "\n"), int(most * head)
    cut = F.concat(F.slice(lines, 1, top), F.array(F.concat(F.lit("... ["), (F.size(lines) - most).cast("string"), F.lit(" lines omitted] ..."))), F.slice(lines, -(most - top), most - top))
    return F.when(F.size(lines) > most, F.array_join(cut, "\n")).otherwise(text)


def token_estimate(text: Column, per: int = 4) -> Column:
    return F.floor(F.length(text) / per)


def has_cjk(text: Column) -> Column:
    return text.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]")


def h1_title(text: Column, fallback: Column) -> Column:
    found = F.trim(F.regexp_extract(F.substring(text, 1, 500), r"(?m)^#\s+(.+)$", 1))
    return F.when(found != "", found).otherwise(F.initcap(F.translate(fallback, "_-", "  ")))


def strip_code_fence(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*\n?", ""), r"\n?```\s*$", "")


def tagged(text: Column, tag: str) -> Column:
    """What stands between <TAG> and </TAG>; null if it doesn't."""
    found = F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.when(found != "", F.trim(found))


def repository_url(url: Column) -> Column:
    """host/owner/name in lower case, without scheme, credentials, .git and trailing /."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^(?:[a-z+]+://)?(?:[^/@]*@)?", ""), r"^([^/:]+):", "$1/"), r"(?:\.git)?/*$", "")


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def module_id(members: Column) -> Column:
    """The first 12 digits of the SHA-256 of the sorted members joined by |."""
    return F.substring(F.sha2(F.array_join(F.array_sort(members), "|"), 256), 1, 12)


def stable_hash(parts: Column) -> Column:
    """SHA-256 of the parts, each followed by a zero character; empty for no parts."""
    return F.when(F.size(parts) > 0, F.sha2(F.concat(F.array_join(parts, "\0"), F.lit("\0")), 256)).otherwise("")


def map_hash(mapping: Column) -> Column:
    return stable_hash(F.transform(F.array_sort(F.map_entries(mapping)), lambda e: F.concat_ws(":", e["key"], e["value"])))


def error_class(message: Column, status: Column) -> Column:
    """The class of a failed call, from its status code first and its message then."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(m.contains("quota") | m.contains("billing"), "quota")
        .when(status.isin(401, 403), "auth")
        .when(status == 429, "rate_limit")
        .when(status.isin(408, 504) | m.contains("timeout") | m.contains("timed out"), "timeout")
        .when(m.contains("context length") | m.contains("too many tokens"), "context_overflow")
        .when(status >= 500, "server")
        .otherwise("unknown")
    )


def retry_delay(attempt: Column, base: float = 0.5, most: float = 32.0) -> Column:
    """Exponential delay without its jitter."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))


#: Abbreviations that end no sentence.
ABBREVIATIONS = ("e.g.", "i.e.", "vs.", "etc.", "U.S.", "U.K.", "Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "Fig.")


def first_sentence(text: Column) -> Column:
    """The text up to the first . ! or ? before white space that ends none of the abbreviations."""
    hidden = F.trim(text)
    for short in ABBREVIATIONS:
        hidden = F.replace(hidden, F.lit(short), F.lit(short.replace(".", "\u0001")))
    return F.replace(F.trim(F.get(F.split(hidden, r"(?<=[.!?])\s+"), F.lit(0))), F.lit("\u0001"), F.lit("."))


def definition(doc: Column, kind: Column, file_path: Column) -> Column:
    """A glossary definition: the first sentence, with a full stop if it has no mark, then kind and file in brackets."""
    head = F.coalesce(first_sentence(doc), F.lit(""))
    ended = F.when((head == "") | head.rlike("[.!?]$"), head).otherwise(F.concat(head, F.lit(".")))
    return F.trim(F.concat(ended, F.lit(" ("), kind, F.lit(", "), file_path, F.lit(")")))


def match_name(filename: Column) -> Column:
    """A file name folded for comparison: lower case, & as and, other marks, spaces and - as one underscore."""
    words = F.regexp_replace(F.replace(F.lower(filename), F.lit("&"), F.lit(" and ")), r"(?U)[^\w.\s-]", "_")
    return F.regexp_replace(F.translate(words, "- ", "__"), "_+", "_")


def safe_slug(raw: Column, index: Column) -> Column:
    """a-z, 0-9 and single inner dashes of a title; part-<index> where none is left."""
    kept = F.trim(F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z0-9-]", ""), "-+", "-"), F.lit("-"))
    return F.when(F.coalesce(kept, F.lit("")) == "", F.concat(F.lit("part-"), index.cast("string"))).otherwise(kept)


def find_document(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (key, canonical, leaf) to files (name): the canonical name, else one folded alike, else one whose folded name ends
    like the leaf's; null if there is none, the smallest name of several. Names by their suffixes are an equi-join: every
    suffix of a folded name is a key, so no pairs are compared.
    """
    folded = files.where(F.col("name").endswith(".md")).select("name", match_name(F.col("name")).alias("f"))
    exact = files.select(F.col("name").alias("canonical")).distinct().withColumn("exact", F.col("canonical"))
    full = folded.groupBy("f").agg(F.min("name").alias("full"))
    asked = wanted.select("key", "canonical", match_name(F.col("canonical")).alias("f"), match_name(F.col("leaf")).alias("tail"))
    ends = folded.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("f")), lambda i: F.substring(F.col("f"), i, F.length("f")))).alias("tail"))
    tails = ends.join(asked.select("tail").distinct(), "tail", "left_semi").groupBy("tail").agg(F.min("name").alias("suffix"))
    out = asked.join(exact, "canonical", "left").join(full, "f", "left").join(tails, "tail", "left")
    return out.select("key", F.coalesce("exact", "full", "suffix").alias("name"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("full").isNotNull(), "folded").when(F.col("suffix").isNotNull(), "suffix").otherwise("none").alias("how"))
