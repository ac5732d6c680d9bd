"""Mermaid diagrams in documents: blocks with their places, structural issues by line, and a clean-up that keeps its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import line_of, spans
from .documents import bracket_depths

#: A block: from a line that begins with the fence to a line that is one, or to the end.
BLOCK = r"(?m)^[ \t]*```mermaid[^\n]*\n(?:(?![ \t]*```[ \t]*$)[^\n]*(?:\n|\z))*(?:[ \t]*```[ \t]*$)?"
#: Operators and marks that diagrams can't hold in labels, kinds of edges, quotation marks put right.
OPERATORS = "[∃∀∈∉⊂⊆⊇⊃⊄∧∨∩∪≡≈≠→⇒⇔←⇐≤≥∞∂∇√∫∑∏±×÷]"
EDGE = r"(?:-->|---|-\.->|==>)"
CURLY = "“”‘’«»"


def blocks(docs: DataFrame) -> DataFrame:
    """(file_name, block, start, end, line, content): diagrams by number from 0; line is that of the fence, from 1. Blocks
    without lines are none. Documents are dealt out anew, since a file of few bytes may hold many and each costs far more than its reading.
    """
    docs = docs.select("file_name", "text").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = docs.select("file_name", "text", F.posexplode(spans(F.col("text"), BLOCK)).alias("block", "span"))
    inner = F.regexp_replace(F.regexp_replace(F.col("span.content"), r"\A[ \t]*```mermaid[^\n]*\n", ""), r"\n?[ \t]*```[ \t]*\z", "")
    out = found.select("file_name", "block", F.col("span.start").alias("start"), F.col("span.end").alias("end"), line_of(F.col("text"), F.col("span.start")).alias("line"), inner.alias("content"))
    return out.where("content <> ''")


def issues(diagrams: DataFrame) -> DataFrame:
    """(file_name, block, line, issue) of blocks: brackets that close too early (at the line where they do) or stay open, operators
    in labels, single quotes in labels, characters beyond ASCII outside of quotes. Other issues stand at their first line.
    """
    rows = diagrams.select("file_name", "block", "line", "content", F.posexplode(F.split("content", "\n", -1)).alias("n", "row"))
    at = (F.col("line") + F.col("n") + 1).alias("line")
    bare = F.regexp_replace(F.regexp_replace("row", r"\"[^\"]*\"", '""'), "'[^']*'", "''")
    kinds = {
        "Unicode math operators in labels": F.col("row").rlike(OPERATORS),
        "Single-quote character inside a node label bracket": F.col("row").rlike(r"\[[\"']?[^\"'\]]*'[^\]]*\]"),
        "Non-ASCII characters outside quoted strings": bare.rlike(r"[^\x00-\x7F]"),
    }
    found = [rows.where(test).select("file_name", "block", at, F.lit(kind).alias("issue")) for kind, test in kinds.items()]
    found = [x.groupBy("file_name", "block", "issue").agg(F.min("line").alias("line")).select("file_name", "block", "line", "issue") for x in found]
    depth = bracket_depths(F.col("content"), "[", "]")
    early = F.when(depth["lowest"] < 0, F.size(F.split(_upto(F.col("content")), "\n", -1)))
    opened = F.when((depth["depth"] > 0) & (depth["lowest"] >= 0), F.concat(F.lit("Unbalanced square brackets (+"), depth["depth"].cast("string"), F.lit(")")))
    issue = F.when(early.isNotNull(), "Unbalanced square brackets").otherwise(opened)
    brackets = diagrams.select("file_name", "block", (F.col("line") + F.coalesce(early, F.lit(1))).cast("int").alias("line"), issue.alias("issue")).where("issue is not null")
    out = brackets
    for x in found:
        out = out.unionByName(x)
    return out


def _upto(content: Column) -> Column:
    """The content up to the bracket that closes more than is open."""
    parts = F.split(content, r"(?<=\])", -1)

    def more(state: Column, part: Column) -> Column:
        d = bracket_depths(part, "[", "]")
        ended = state["ended"] | (state["depth"] + d["lowest"] < 0)
        return F.struct((state["depth"] + d["depth"]).alias("depth"), F.concat(state["text"], F.when(state["ended"], "").otherwise(part)).alias("text"), ended.alias("ended"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"), F.lit(False).alias("ended")), more)["text"]


def _newlines(text: Column) -> Column:
    """A backslash with n: a line break of the label inside of square brackets, else a new line."""
    tokens = F.regexp_extract_all(text, F.lit(r"\\n|\[|\]|[^\\\[\]]+|\\"), F.lit(0))

    def more(state: Column, t: Column) -> Column:
        depth = F.when(t == "[", state["depth"] + 1).when((t == "]") & (state["depth"] > 0), state["depth"] - 1).otherwise(state["depth"])
        put = F.when(t == "\\n", F.when(state["depth"] > 0, "<br/>").otherwise("\n")).otherwise(t)
        return F.struct(depth.alias("depth"), F.concat(state["parts"], F.array(put)).alias("parts"))

    return F.array_join(F.aggregate(tokens, F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("parts")), more)["parts"], "")


def _bound(value: Column, then) -> Column:
    """then(value), with value found once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _apart(line: Column) -> Column:
    """A line with several sources or a chain of edges of one kind as lines of one edge each; array of lines."""
    sources = lambda x: F.filter(F.transform(F.split(x, "&"), lambda s: F.trim(s)), lambda s: s != "")

    def parted(x: Column) -> Column:
        edge, marks, ends = F.get(x["edges"], F.lit(0)), F.size(x["edges"]), x["ends"]
        same = F.size(F.filter(x["edges"], lambda e: e != edge)) == 0
        steps = F.flatten(F.transform(F.sequence(F.lit(1), marks), lambda i: F.transform(sources(F.get(ends, i - 1)), lambda s: F.concat_ws(" ", s, edge, F.get(ends, i)))))
        several = (marks > 1) & same | (marks == 1) & F.get(ends, F.lit(0)).contains("&")
        plain = ~F.exists(ends, lambda e: e == "") & ~line.contains(";") & ~line.rlike(r"\"[^\"]*" + EDGE)
        return F.when(several & plain, steps).otherwise(F.array(line))

    edges = F.regexp_extract_all(line, F.lit(EDGE), F.lit(0)).alias("edges")
    ends = F.transform(F.split(line, r"\s*" + EDGE + r"\s*", -1), lambda x: F.trim(x)).alias("ends")
    return F.when(line.rlike(EDGE), _bound(F.struct(edges, ends), parted)).otherwise(F.array(line))


def _closed(text: Column) -> Column:
    missing = F.length(F.regexp_replace(text, r"[^\[]", "")) - F.length(F.regexp_replace(text, r"[^\]]", ""))
    return F.concat(text, F.repeat(F.lit("]"), F.greatest(missing, F.lit(0))))


def cleaned(content: Column) -> Column:
    """A diagram put right before it is judged: quotes, written line breaks, statements on one line, labels of edges in bars,
    chains and several sources as one edge a line, missing closing brackets, doubled angle brackets, blank lines. Cleaning twice changes nothing.
    """
    out = _newlines(F.translate(content, CURLY, '"' * len(CURLY)))
    out = F.regexp_replace(out, rf";\s*(?=[A-Za-z_][A-Za-z0-9_]*\s*{EDGE})", "\n")
    label = lambda t, _: F.regexp_replace(t, rf"({EDGE})\s*\[\s*([^\]]+?)\s*\]", "$1|$2|")
    labelled = lambda t: F.aggregate(F.sequence(F.lit(0), F.length(F.regexp_replace(t, r"[^\[]", ""))), t, label)  # noqa: E731 - one may hold another
    apart = lambda t: F.array_join(F.flatten(F.transform(F.split(t, "\n", -1), _apart)), "\n")
    # a bracket that is closed at the end may make another label or edge; what a step leaves as it is stays so
    step = lambda t: _bound(_bound(apart(labelled(t)), _closed), lambda new: F.struct(new.alias("text"), (new == t).alias("done")))
    start = F.struct(out.alias("text"), F.lit(False).alias("done"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, lambda x, _: F.when(x["done"], x).otherwise(step(x["text"])))["text"]
    out = F.regexp_replace(F.regexp_replace(out, "<{2,}", "<"), ">{2,}", ">")
    out = F.regexp_replace(out, r"\(\s*\[\s*([^\]]*?)\s*\]\s*\)", "([$1])")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", ""))
