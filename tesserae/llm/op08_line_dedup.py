"""Line dedup with overlapping three-line windows.

The lines of a text that hold a word, trimmed of ASCII white space, form windows of WIDTH consecutive ones. A window
whose digest occurs again anywhere, in the same document or another, stays in its first place (by doc_id, then line);
every later occurrence is covered, and all lines that any later occurrence covers are removed. Blank lines are no part
of windows and stay. What is removed is always kept where it occurs first, so no line's content is lost.

Null texts stay null; texts of fewer than WIDTH lines with a word have no window and stay as they are. Rows that share
doc_id and text count as one document and stay or go together; rows with a null doc_id stay as they are. Other columns
are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialize, sized, small_batches, table

WIDTH = 3
_BLANK = " \t\n\x0b\x0c\r"


def _lines(text: str) -> list[tuple[int, str]]:
    """(number, trimmed) of the lines with a word."""
    return [(i, t) for i, line in enumerate(text.split("\n")) if (t := line.strip(_BLANK))]


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, at, rows = [], [], [], []
            for r, text in enumerate(batch.column(2).to_pylist()):
                digests = [hashlib.blake2b(t.encode(), digest_size=16).digest() for _, t in _lines(text or "")]
                for k in range(len(digests) - width + 1):
                    d = hashlib.blake2b(b"".join(digests[k : k + width]), digest_size=16).digest()
                    one.append(int.from_bytes(d[:8], "little", signed=True))
                    two.append(int.from_bytes(d[8:], "little", signed=True))
                    at.append(k)
                    rows.append(r)
            rows = pa.array(rows, pa.int64())
            yield pa.record_batch([pa.array(one, pa.int64()), pa.array(two, pa.int64()), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at, pa.int32())], ["h1", "h2", "doc_id", "th", "at"])

    return run


def _cut(at: int, width: int, counts: bool):
    """Applies the removed windows, the last column, to the text at a column; counts: (n_lines, n_removed) come with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, gone = batch.column(at).to_pylist(), [], []
            for r, starts in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                lines = _lines(texts[r] or "")
                covered = {lines[k + j][0] for k in starts or () for j in range(width)}
                total.append(len(lines))
                gone.append(len(covered))
                if covered:
                    texts[r] = "\n".join([x for i, x in enumerate(texts[r].split("\n")) if i not in covered])
            cols = list(batch.columns[:-1])
            cols[at] = pa.array(texts, pa.string())
            names = batch.schema.names[:-1]
            if counts:
                cols += [pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
                names = [*names, "n_lines", "n_removed"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def dedup_lines(docs: DataFrame, width: int = WIDTH, counts: bool = False) -> DataFrame:
    """docs with later occurrences of repeated windows removed from text; counts: also n_lines and n_removed."""
    small_batches(docs.sparkSession)
    th = F.xxhash64("text")
    keyed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), th.alias("th"), F.col("text").cast("string").alias("text"))
    windows = keyed.mapInArrow(_windows(width), "h1 long, h2 long, doc_id long, th long, at int")
    place = F.struct("doc_id", "th", "at")
    firsts = materialize(windows.groupBy("h1", "h2").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a <> z").select("h1", "h2", "a"))
    later = windows.join(sized(firsts), ["h1", "h2"]).where(place != F.col("a"))
    d, t, starts = (free_name(docs, x) for x in ("_d", "_t", "_starts"))
    removed = materialize(later.groupBy("doc_id", "th").agg(F.collect_set("at").alias(starts)).select(F.col("doc_id").alias(d), F.col("th").alias(t), starts))
    joined = docs.join(sized(removed), (docs["doc_id"] == F.col(d)) & (F.xxhash64(docs["text"]) == F.col(t)), "left").select(*[docs[c] for c in docs.columns], starts)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + (", n_lines long, n_removed long" if counts else "")
    return joined.mapInArrow(_cut(docs.columns.index("text"), width, counts), fields)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, text_md5): lines with a word, those removed, and the text that is left."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


#: DuckDB, with the windows as strings.
SQL = r"""
WITH t AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s FROM t),
b AS (SELECT doc_id, i, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM l WHERE s <> ''),
w AS (SELECT * FROM (SELECT doc_id, k, s || chr(10) || lead(s) OVER o || chr(10) || lead(s, 2) OVER o AS w FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY k)) WHERE w IS NOT NULL),
f AS (SELECT w, min(doc_id * 1000000 + k) AS first FROM w GROUP BY w HAVING count(*) > 1),
r AS (SELECT DISTINCT doc_id, k + j AS k FROM w JOIN f USING (w) CROSS JOIN (VALUES (0), (1), (2)) v(j) WHERE doc_id * 1000000 + k <> first),
g AS (SELECT b.doc_id, b.i FROM b JOIN r ON r.doc_id = b.doc_id AND r.k = b.k),
c AS (SELECT l.doc_id, count(*) FILTER (WHERE l.s <> '') AS n_lines, count(g.i) AS n_removed, md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '')) AS m
      FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY 1)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE c.m END AS text_md5 FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id
"""
