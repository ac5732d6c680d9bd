"""Periodic runs of words: a harmonic grid over suffix arrays.

A run is a stretch of consecutive words with smallest period q, at least max(LEAST, 2 q) long, that can't be extended on
either side keeping period q. A stretch of 2 p words holds two neighbouring multiples of p, so for each period p the pairs
(jp, (j+1)p) are asked how far they agree forwards (suffix array, neighbours' common prefixes, range minima) and backwards
(the same of the reversed array); together these give the maximal stretch around the pair. The grid of a text of n words
has n ln n pairs. Pairs that can't belong to a run, since their words differ or those on both sides do, ask nothing.
Of stretches found with several periods the smallest stays.

Texts of an Arrow batch are put together up to WORDS words, so that suffixes are ordered by a few calls for many texts; a
longer text is alone. Work and memory grow with n ln n, also where a text repeats one word throughout; no period or
length is left out. A task handles whole texts and nothing is shuffled.

Null and empty texts, and texts of white space, have no words and no runs; their collapsed text is empty. Rows with a
null doc_id are taken as they are. Repeated rows give repeated rows; other columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .suffixes import Suffixes

#: Shortest run.
LEAST = 12
#: Words of texts whose suffixes are ordered together.
WORDS = 1 << 17
#: Ends of grid pairs that are made at once: bounds memory for very long texts.
ENDS = 1 << 14


def _pairs(low: int, high: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(end, period), by end, of the grid pairs (end - period, end) with low <= end < high and periods up to longest."""
    period = np.arange(1, min(longest, high - 1) + 1)
    first = np.maximum(-(-low // period), 1)
    count = np.maximum((high - 1) // period - first + 1, 0)
    p = np.repeat(period, count)
    end = (np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)) * p
    by = np.argsort(end, kind="stable")
    return end[by], p[by]


@functools.cache
def _first_pairs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grid of all texts of up to ENDS words: that of a shorter text is its beginning, up to the last column's number."""
    end, period = _pairs(1, ENDS, ENDS)
    return end, period, np.searchsorted(end, np.arange(ENDS + 1))


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    end, period, upto = _first_pairs()
    yield end[: upto[min(n, ENDS)]], period[: upto[min(n, ENDS)]]
    for low in range(ENDS, n, ENDS):
        yield _pairs(low, min(low + ENDS, n), n // 2)


def _askers(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the grid pairs of one text with equal words, and equal words on one side at least."""
    n, found = len(words), []
    if n < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    padded = np.r_[-1, words, -2]
    for end, period in _grid(n):
        keep = np.flatnonzero(padded[end + 1] == padded[end - period + 1])
        end, period = end[keep], period[keep]
        start = end - period
        # both extensions together hold max(least - p, p) words, so two unless p = 1 with a short least
        near = (padded[end + 2] == padded[start + 2]) | (padded[end] == padded[start]) | (np.maximum(least - period, period) < 2)
        found.append(((start)[near & (2 * period <= n)], period[near & (2 * period <= n)]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def runs(texts: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """For each text, a sequence of word numbers, its runs as rows (start, length, period), by start, then period."""
    none = np.empty((0, 3), np.int64)
    out, asked = [none] * len(texts), []
    for k, words in enumerate(texts):
        start, period = _askers(words, least)
        if len(start):
            asked.append((k, start, period))
    if not asked:
        return out
    sizes = np.array([len(texts[k]) for k, _, _ in asked])
    begins = np.r_[0, np.cumsum(sizes)]
    total, every = int(begins[-1]), max(int(texts[k].max()) for k, _, _ in asked) + 1
    words = np.concatenate([texts[k] + i * every for i, (k, _, _) in enumerate(asked)])
    of = np.repeat(np.arange(len(asked)), sizes)
    text = np.repeat(np.arange(len(asked)), [len(p) for _, _, p in asked])
    p = np.concatenate([p for _, _, p in asked])
    a = np.concatenate([s for _, s, _ in asked]) + begins[text]
    forward = Suffixes(words, begins[of + 1]).extensions(a, a + p)
    inner = a > begins[text]  # nothing is in front of a text's first word
    backward = np.zeros(len(a), np.int64)
    backward[inner] = Suffixes(words[::-1].copy(), (total - begins[of])[::-1].copy()).extensions(total - a[inner], total - a[inner] - p[inner])
    start, end = a - backward, a + p + forward
    good = end - start >= np.maximum(least, 2 * p)
    start, end, p, text = start[good], end[good], p[good], text[good]
    by = np.lexsort((p, end, start))
    start, end, p, text = start[by], end[by], p[by], text[by]
    first = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    start, end, p, text = start[first], end[first], p[first], text[first]
    by = np.lexsort((p, start))
    rows = np.stack([start - begins[text], end - start, p], axis=1)[by]
    cuts = np.searchsorted(text[by], np.arange(len(asked) + 1))
    for i, (k, _, _) in enumerate(asked):
        out[k] = rows[cuts[i] : cuts[i + 1]]
    return out


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run contains after its first period."""
    if not len(found):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    return b" ".join(compress(words, (np.cumsum(depth[:-1]) == 0).tolist()))


def plant(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a period planted, where crc32 of the id is a multiple of ten; rows without id stay."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _batches(least: int, change: Callable | None):
    def solved(ids: list, texts: list[list[bytes]], numbers: list[np.ndarray]) -> pa.RecordBatch:
        found = runs(numbers, least)
        flat = np.concatenate([np.empty((0, 3), np.int64), *found])
        structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_RUN))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), structs)
        left = pa.array([collapsed(w, f) for w, f in zip(texts, found, strict=True)], pa.binary()).view(pa.string())
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(w) for w in texts], pa.int64()), lists, left], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, numbers, known, size = [], [], [], {}, 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).view(pa.binary()).to_pylist(), strict=True):
                words = (text or b"").split()  # bytes split at ASCII white space only
                words = change(doc, words) if change else words
                if texts and size + len(words) > WORDS:
                    yield solved(ids, texts, numbers)
                    ids, texts, numbers, known, size = [], [], [], {}, 0
                ids.append(doc)
                texts.append(words)
                numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
                size += len(words)
            yield solved(ids, texts, numbers)

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, change: Callable | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document; change: a function of id and words that puts other words in their place first."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _batches(least, change), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), change=plant)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.withColumn("best", best).withColumn("lines", F.array_join(lines, ""))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
