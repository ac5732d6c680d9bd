"""Chat formatting by quotation linking.

Each message is parsed into units: paragraphs of lines at the same quote level (the number of leading '>' marks, with
spaces between them). Units at level 0 are the message's own text; quoted units are normalised (ASCII lower case, runs
of white space as one space) and hashed with 128 bits. They join, within their conversation, the own units, whole own
texts and single own lines of earlier messages, and any run of consecutive words in an own text: of GRAM words or more
wherever it starts and ends, of fewer if it is whole lines. A run is found by hashes of GRAM words that cover the unit and
must all lie at the same offset in the own text. A message replies to the earlier message that holds most of its units of
the lowest quoted level of which any unit links (then the latest such message). Replies form threads; a thread is named by its first turn, and a
conversation in reply order is sorted by (thread, turn), in which every reply follows what it replies to. `position`
counts that order from 0. The text that is left has no quotes.

Nothing gathers a conversation in one task: links are joins on (conversation, hash), threads are components of links,
and positions are ranks in a range partition.

Null texts count as empty. A null conv_id or turn: the row stays, without links, thread and position null. If a turn
comes more than once in a conversation, its rows are one message for links and keep their own texts. Quotes that match
nothing are removed all the same and counted. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import connected_components, global_rank, materialize, sized, small_batches, table

#: Words in a hash of a run.
GRAM = 4
_MARKS = re.compile(r"^(?:[ \t]*>)+[ \t]?")


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(own text, units): units are (level, text) of paragraphs; blank lines and changes of level end one."""
    own, units, now, level = [], [], [], 0

    def end() -> None:
        if now:
            units.append((level, "\n".join(now)))
            now.clear()

    for line in text.split("\n"):
        marks = _MARKS.match(line)
        depth, rest = (marks.group().count(">"), line[marks.end() :]) if marks else (0, line)
        if depth != level or not rest.strip():
            end()
        level = depth
        if rest.strip():
            now.append(rest)
        if not depth:
            own.append(line)
    end()
    return "\n".join(own).strip("\n"), units


def _norm(text: str) -> str:
    return b" ".join(text.encode().lower().split()).decode()


def _hash(text: str) -> tuple[int, int]:
    d = hashlib.blake2b(_norm(text).encode(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


_QUOTED = "conv_id long, turn long, level int, h1 long, h2 long, parts int, at int, g1 long, g2 long"
_OWN = "conv_id long, turn long, h1 long, h2 long"
_GRAMS = "conv_id long, turn long, row long, place int, g1 long, g2 long"
_TYPES = {"long": pa.int64(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    cols = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.record_batch([pa.array(c, _TYPES[t]) for c, t in zip(cols, types, strict=True)], list(names))


def _quoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quoted units: a row for each of the `parts` hashes that cover a unit, or one with `at` -1 for a short unit."""
    for batch in batches:
        out: list[tuple] = []
        for conv, turn, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for level, u in parse(text)[1]:
                if level:
                    w = _norm(u).split(" ")
                    ats = sorted({*range(0, len(w) - GRAM + 1, GRAM), len(w) - GRAM}) if len(w) >= GRAM else []
                    out += [(conv, turn, level, *_hash(u), len(ats), i, *_hash(" ".join(w[i : i + GRAM]))) for i in ats] or [(conv, turn, level, *_hash(u), 0, -1, None, None)]
        yield _batch(out, _QUOTED)


def _short_runs(lines: list[str]) -> set[str]:
    """Runs of consecutive lines, blank ones left out, of fewer than GRAM words."""
    lines, out = [x for x in lines if x], set()
    for i in range(len(lines)):
        for j in range(i + 1, min(len(lines), i + GRAM) + 1):
            run = " ".join(lines[i:j])
            if run.count(" ") + 1 < GRAM:
                out.add(run)
    return out


def _own_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What can be quoted of a message as a whole."""
    for batch in batches:
        out: list[tuple] = []
        for conv, turn, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own, units = parse(text or "")
            lines = [_norm(x) for x in own.split("\n")]
            mine = {_norm(u) for level, u in units if level == 0} | set(lines) | {_norm(own)} | _short_runs(lines)
            out += [(conv, turn, *_hash(u)) for u in mine if u]
        yield _batch(out, _OWN)


def _own_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of GRAM words at each place of an own text; `row` tells apart the texts of a turn that comes twice."""
    for batch in batches:
        out: list[tuple] = []
        for conv, turn, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = parse(text or "")[0]
            w, row = _norm(own).split(" "), _hash(own)[0]
            out += [(conv, turn, row, i, *_hash(" ".join(w[i : i + GRAM]))) for i in range(len(w) - GRAM + 1)]
        yield _batch(out, _GRAMS)


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parsed = [parse(t or "") for t in batch.column(3).to_pylist()]
        yield pa.record_batch([*batch.columns[:3], pa.array([p[0] for p in parsed], pa.string()), pa.array([sum(level > 0 for level, _ in p[1]) for p in parsed], pa.int64())], ["conv_id", "turn", "role", "text", "n_quotes"])


def link_quotations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n_quotes, n_linked, reply_to, thread, position) of every message."""
    small_batches(messages.sparkSession)
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    known = rows.where("conv_id is not null and turn is not null")
    texts = known.select("conv_id", "turn", "text")
    quoted = materialize(texts.where(F.col("text").contains(">")).mapInArrow(_quoted, _QUOTED))
    # only conversations with quotes need what their messages own
    talks = texts.join(sized(materialize(quoted.select("conv_id").distinct())), "conv_id", "left_semi")
    unit = ["conv_id", "turn", "level", "h1", "h2"]
    whole = quoted.where("at <= 0").groupBy(unit).agg(F.count("*").alias("n"))
    asked = sized(materialize(quoted.select("conv_id", "h1", "h2").distinct()))
    sources = talks.mapInArrow(_own_units, _OWN).join(asked, ["conv_id", "h1", "h2"], "left_semi").select("conv_id", "h1", "h2", F.col("turn").alias("source")).distinct()
    covers = quoted.where("at >= 0").distinct()
    sought = sized(materialize(covers.select("conv_id", "g1", "g2").distinct()))
    grams = talks.mapInArrow(_own_grams, _GRAMS).join(sought, ["conv_id", "g1", "g2"], "left_semi").withColumnRenamed("turn", "source")
    met = covers.join(grams, ["conv_id", "g1", "g2"]).where("source < turn").groupBy(*unit, "parts", "source", "row", (F.col("place") - F.col("at")).alias("offset")).agg(F.count_distinct("at").alias("met"))
    runs = met.where("met = parts").select(*unit, "source")
    exact = whole.join(sources, ["conv_id", "h1", "h2"]).where("source < turn").select(*unit, "source")
    hits = materialize(exact.unionByName(runs).distinct())
    lowest = hits.groupBy("conv_id", "turn").agg(F.min("level").alias("level"))
    votes = hits.join(lowest, ["conv_id", "turn", "level"]).join(whole, unit).groupBy("conv_id", "turn", "source").agg(F.sum("n").alias("n"))
    replies = materialize(votes.groupBy("conv_id", "turn").agg(F.max(F.struct("n", "source")).alias("best")).select("conv_id", "turn", F.col("best.source").alias("reply_to")))
    linked = materialize(hits.select(unit).distinct().groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked")))
    threads = connected_components(replies.select(F.struct("conv_id", "turn").alias("a"), F.struct("conv_id", F.col("reply_to").alias("turn")).alias("b")))
    named = materialize(threads.select(F.col("node.conv_id").alias("conv_id"), F.col("node.turn").alias("turn"), F.col("component.turn").alias("thread")))
    own = rows.mapInArrow(_owned, "conv_id long, turn long, role string, text string, n_quotes long")
    joined = own.join(sized(linked), ["conv_id", "turn"], "left").join(sized(replies), ["conv_id", "turn"], "left").join(sized(named), ["conv_id", "turn"], "left")
    full = materialize(joined.withColumns({"n_linked": F.coalesce("n_linked", F.lit(0).cast("long")), "thread": F.when(F.col("conv_id").isNotNull(), F.coalesce("thread", "turn"))}))
    ranked = materialize(global_rank(full.where("conv_id is not null and turn is not null"), ["conv_id", "thread", "turn", "role", "text"]))
    first = ranked.groupBy("conv_id").agg(F.min("rank").alias("first"))
    placed = ranked.join(first, "conv_id").withColumn("position", F.col("rank") - F.col("first"))
    rest = full.where("conv_id is null or turn is null").withColumn("position", F.lit(None).cast("long"))
    names = ["conv_id", "turn", "role", "text", "n_quotes", "n_linked", "reply_to", "thread", "position"]
    return placed.select(names).unionByName(rest.select(names))


def op7_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))
