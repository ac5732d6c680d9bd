"""Language identification by error-correcting output codes over binary character n-gram classifiers.

Languages get codewords: all distinct two-class splits for up to seven languages, else seeded random codewords of
15 log2(k) bits, the best separated of several draws. Each bit is a binary classifier over hashed character n-grams of
two to four bytes: the log ratio of the smoothed n-gram frequencies of the languages on either side
(naive Bayes), averaged over the text. Decoding is loss-weighted: the distance to a codeword is the sum over the bits of
w * log(1 + exp(-code * margin)), where w is the bit's accuracy on the sample for that language, normalised per
language, and the margins are scaled by their spread on the sample. The nearest codeword wins; a text is flagged
ambiguous if the second nearest is not farther by GAP in probability.

The classifiers are fitted on a bounded sample: SAMPLE documents expected for each language, chosen by a hash of doc_id
among the documents that may be learned from. Counts are summed in Spark; the driver gets a table of languages times
BUCKETS. Only text and the learned lang enter; prediction reads text alone.

Null texts and texts without a letter are `und` with score 0, as is everything if there is nothing to learn from.
Score: the probability of the nearest codeword among all, in 0..1. Rows keep their number; repeated rows give repeated
rows; columns besides doc_id, text and lang are ignored. A row without doc_id is predicted, is not held out and is not learned from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Sampled documents expected for each language, hashed n-gram buckets, and n-grams handled at a time.
SAMPLE, BUCKETS, _STEP = 2000, 1 << 15, 1 << 18
#: Texts whose two nearest codewords are closer than this in probability are ambiguous.
GAP = 0.2

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: What isn't a letter is one symbol; bytes of multi-byte characters count as they are.
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def _grams(text: bytes) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams (two to four bytes) of a text with a space on either side, in bounded pieces."""
    whole = np.full(len(text) + 2, 32, np.uint8)
    whole[1:-1] = _FOLD[np.frombuffer(text, np.uint8)]
    for s in range(0, len(whole), _STEP):
        x = whole[s : s + _STEP + 3].astype(np.uint32)
        g = x
        for n in (2, 3, 4):
            g = g[:-1] << np.uint32(8) | x[n - 1 :]
            h = (g[:_STEP] + np.uint32(n)) * np.uint32(2654435761)
            yield h >> np.uint32(33 - BUCKETS.bit_length())


def codewords(k: int) -> np.ndarray:
    """k codewords of -1 and 1, a row each."""
    if k <= 7:
        bits = max(1, 2 ** (k - 1) - 1)
        return np.array([[1 if r == 0 or not (j >> (r - 1)) & 1 else -1 for j in range(1, bits + 1)] for r in range(k)], np.float64)
    bits, rng = math.ceil(15 * math.log2(k)), np.random.default_rng(7)
    draws = [rng.choice([-1.0, 1.0], (k, bits)) for _ in range(50)]
    return max(draws, key=lambda m: min(np.count_nonzero(m[i] != m[j]) for i in range(k) for j in range(i)))


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: a row of n-gram counts for each language."""
        self.langs, self.code = langs, codewords(len(langs))
        freq = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
        log = []
        for b in range(self.code.shape[1]):
            side = self.code[:, b] > 0
            up, down = (freq[m].mean(0) if m.any() else np.full(BUCKETS, 1 / BUCKETS) for m in (side, ~side))
            log.append(np.log(up / down))
        self.weights = np.ascontiguousarray(np.array(log).T, np.float32)
        self.spread = np.ones(self.code.shape[1])
        self.share = np.full(self.code.shape, 1 / self.code.shape[1])

    def margins(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for h in _grams(text):
            if len(h):
                total += self.weights.take(h, 0).sum(0, dtype=np.float64)
                n += len(h)
        return total / max(n, 1)

    def decode(self, margins: np.ndarray) -> tuple[int, float, bool]:
        loss = (self.share * np.logaddexp(0, -self.code * (4 * margins / self.spread))).sum(1)
        p = np.exp(-4 * (loss - loss.min()))
        p /= p.sum()
        best = int(loss.argmin())
        rest = np.delete(p, best)
        return best, float(p[best]), bool(len(rest) and p[best] - rest.max() < GAP)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if text:
                mine = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for h in _grams(text):
                    mine += np.bincount(h, minlength=BUCKETS)
    for lang, c in held.items():
        at = np.flatnonzero(c)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at], pa.int64())], ["lang", "bucket", "n"])


def _margins(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [model.margins(t).tolist() for t in batch.column(1).cast(pa.binary()).to_pylist() if t is not None]
            kept = [x for x, t in zip(batch.column(0).to_pylist(), batch.column(1).is_valid().to_pylist(), strict=True) if t]
            yield pa.record_batch([pa.array([x for x in kept for _ in range(model.code.shape[1])], pa.string()), pa.array([b for m in got for b in range(len(m))], pa.int64()), pa.array([x for m in got for x in m], pa.float64())], ["lang", "bit", "margin"])

    return run


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            text = batch.column(2).to_pylist()
            lang, score, unsure = [], [], []
            for t in text:
                if model is None or not t or not any(map(str.isalpha, t)):
                    lang.append("und"), score.append(0.0), unsure.append(True)
                    continue
                best, p, near = model.decode(model.margins(t.encode()))
                lang.append(model.langs[best]), score.append(p), unsure.append(near)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return run


def fit(rows: DataFrame) -> Model | None:
    """rows: (doc_id, lang, text) that may be learned from; those without doc_id, lang or text are not."""
    known = rows.where("doc_id is not null and lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, SAMPLE / n))])
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    sample = known.where(unit < share[F.col("lang")]).select("lang", "text")
    got = sample.mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(sizes)
    counts = np.zeros((len(langs), BUCKETS))
    row = {lang: i for i, lang in enumerate(langs)}
    counts[[row[x] for x in got.column(0).to_pylist()], got.column(1).to_numpy()] = got.column(2).to_numpy()
    model = Model(langs, counts)
    spark = rows.sparkSession
    bits = sample.mapInArrow(_margins(spark.sparkContext.broadcast(model)), "lang string, bit long, margin double")
    sums = bits.groupBy("lang", "bit").agg(F.count("*").alias("n"), F.sum("margin").alias("s"), F.sum(F.col("margin") ** 2).alias("q"), F.sum((F.col("margin") > 0).cast("int")).alias("up")).collect()
    if sums:
        share, total = np.full(model.code.shape, 0.5), np.zeros((model.code.shape[1], 2))
        for lang, b, n, s, q, up in sums:
            i = row[lang]
            right = up if model.code[i, b] > 0 else n - up
            share[i, b] = (right + 1) / (n + 2)
            total[b] += n, q
        model.share = share / share.sum(1, keepdims=True)
        model.spread = np.maximum(np.sqrt(total[:, 1] / np.maximum(total[:, 0], 1)), 1e-9)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def predict_language(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return predict_language(docs, fit(docs.where(~held_out()).select("doc_id", "lang", "text")))
