"""Cross-tokenizer alignment by byte owners.

A text with a space in front is encoded by two vocabularies, A byte-level and B of pieces. Token numbers repeated over the
bytes of their tokens give each byte an owner in A and one in B. Where the pair of owners changes a link begins (each
overlapping pair of tokens owns one stretch of bytes), where both change at once a cut, which divides the tokens into
groups. The owner arrays of many texts are made at once; texts begin at cuts.

A link's count is the number of documents, corpus-wide, that hold its pair of ids linked. Pairs are written once for each
document, with how often each comes; counts are summed in every task before the shuffle, so a pair that every document
holds is one row a task. The table of counts has a row for each distinct pair of ids: documents look their pairs up in it by a
broadcast where its written size and rows are below a bound, else by a join that adaptive execution can split.

Ids are the libraries' own. A text is encoded word by word where both vocabularies cut before every space, each distinct
word once while a worker's table has room (MEMO words of up to WORD characters); other texts are encoded whole.

Null and empty texts, and texts whose bytes the tokens of A or B don't give back, have no tokens: zeros and an empty
groups column. Special tokens are plain text. Repeated rows count as documents of their own; a null doc_id stays null.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, sized, small_batches, table

MEMO, WORD = 400_000, 48
#: Bytes of texts whose owner arrays are made at once; a longer text is alone.
BYTES = 1 << 20
#: The table of counts is broadcast up to this many rows.
ROWS = 2_000_000
#: White space after a space: there, words can't be encoded on their own.
_SPACES = re.compile(r" (?:\s|$)")
SPACE = "▁"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabularies:
    """Both vocabularies, the bytes of their tokens, and the ids of known words."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = lib = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letters = byte_letters()
        entries = {i: p for p, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(letters[c] for c in entries[i]) if i in entries and all(c in letters for c in entries[i]) else b"" for i in range(max(entries) + 1)]
        pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) or lib.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in y]) for y in (self.a_bytes, self.b_bytes))
        # B cuts before a space if none of its pieces has one behind another character
        self.apart = not any(SPACE in p.lstrip(SPACE) for i, p in enumerate(pieces) if not lib.is_byte(i))
        self.known: dict[str, tuple[bytes, bytes]] = {}
        n = max(len(self.a_bytes), len(self.b_bytes))
        #: Each id as text, followed by what stands between it and the next one.
        self.written = [f"{i}{mark}" for i in range(n) for mark in ",|;"]

    def _learn(self, words: list[str], into: dict) -> None:
        a = self.a.encode_batch([" " + w for w in words], add_special_tokens=False)
        for w, x, y in zip(words, a, self.b.encode(words, num_threads=1), strict=True):
            into[w] = (np.array(x.ids, "<u4").tobytes(), np.array(y, "<u4").tobytes())

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of a space and each text in A, of each text in B."""
        cut = [None if not self.apart or SPACE in t or _SPACES.search(" " + t) else t.split(" ") for t in texts]
        fresh = list({w for words in cut if words for w in words if w not in self.known})
        kept = len(self.known) < MEMO
        now = self.known if kept else {}
        self._learn(fresh, now)
        out = []
        for t, words in zip(texts, cut, strict=True):
            if words is None:
                ids = (np.array(self.a.encode(" " + t, add_special_tokens=False).ids, "<u4"), np.array(self.b.encode(t, num_threads=1), "<u4"))
            else:
                pairs = list(map(now.__getitem__, words)) if kept else [self.known.get(w) or now[w] for w in words]
                ids = tuple(np.frombuffer(b"".join(side), "<u4") for side in zip(*pairs, strict=True))
            out.append(ids)
        for w in fresh if kept else ():
            if len(w) > WORD:
                del self.known[w]
        return out

    def whole(self, text: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        return all(b"".join(map(of.__getitem__, ids.tolist())) == b" " + text for of, ids in ((self.a_bytes, a), (self.b_bytes, b)))


def owners(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For token sizes in bytes with equal sums: (A token, B token, byte) of each link, and the group of each token of A and of B."""
    own_a, own_b = np.repeat(np.arange(len(a)), a), np.repeat(np.arange(len(b)), b)
    new_a, new_b = np.r_[True, own_a[1:] != own_a[:-1]], np.r_[True, own_b[1:] != own_b[:-1]]
    at = np.flatnonzero(new_a | new_b)
    group = np.cumsum(new_a & new_b) - 1
    return own_a[at], own_b[at], at, group[new_a], group[new_b]


def _aligned(v: Vocabularies, docs: list, ids: list[tuple[np.ndarray, np.ndarray]], first: int) -> pa.RecordBatch:
    """Rows of texts whose tokens are whole; a text without tokens comes with empty ids."""
    count, ends_a, ends_b = len(docs), np.cumsum([len(a) for a, _ in ids]), np.cumsum([len(b) for _, b in ids])
    n_a, n_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    a, b = (np.concatenate([x[k] for x in ids]).astype(np.int64) for k in (0, 1))
    texts, links, groups = [""] * count, np.zeros(count, np.int64), np.zeros(count, np.int64)
    pair, times, upto = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(count + 1, np.int64)
    if len(a):
        link_a, link_b, _, group_a, group_b = owners(v.a_size[a], v.b_size[b])
        doc_a, doc_b = np.repeat(np.arange(count), n_a), np.repeat(np.arange(count), n_b)
        links = np.bincount(doc_a[link_a], minlength=count)
        groups = np.bincount(doc_a[np.flatnonzero(np.diff(group_a, prepend=-1))], minlength=count)
        width = len(v.b_bytes)
        key = (doc_a[link_a] * len(v.a_bytes) + a[link_a]) * width + b[link_b]
        key, times = np.unique(key, return_counts=True)
        per_doc = len(v.a_bytes) * width
        upto = np.searchsorted(key // per_doc, np.arange(count + 1))
        pair = key % per_doc
        # the tokens of a group, those of A first, each with the mark that follows it
        side = np.r_[2 * group_a, 2 * group_b + 1]
        by = np.argsort(side, kind="stable")
        side, token, doc = side[by], np.r_[a, b][by], np.r_[doc_a, doc_b][by]
        step = np.diff(side, append=side[-1] + 1)
        mark = np.where(step == 0, 0, np.where(side % 2 == 0, 1, 2))
        parts = list(map(v.written.__getitem__, (3 * token + mark).tolist()))
        cuts = np.searchsorted(doc, np.arange(count + 1)).tolist()
        texts = ["".join(parts[i:j])[:-1] for i, j in zip(cuts, cuts[1:], strict=False)]
    structs = pa.StructArray.from_arrays([pa.array((pair // len(v.b_bytes)).astype(np.int32)), pa.array((pair % len(v.b_bytes)).astype(np.int32)), pa.array(times.astype(np.int32))], ["a", "b", "times"])
    columns = [pa.array(range(first, first + count), pa.int64()), pa.array(docs, pa.int64()), *[pa.array(x, pa.int64()) for x in (n_a, n_b, groups, links)], pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), structs)]
    return pa.record_batch(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])


@functools.cache
def _worker(a_file: str, b_file: str) -> Vocabularies:
    return Vocabularies(a_file, b_file)


def _batches(a_file: str, b_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, row = _worker(a_file, b_file), TaskContext.get().partitionId() << 33
        none = np.empty(0, "<u4")
        for batch in batches:
            docs, texts, start = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()], 0
            while start < len(docs):
                stop, size = start, 0
                while stop < len(docs) and (stop == start or size + 4 * len(texts[stop]) <= BYTES):
                    size += 4 * len(texts[stop])  # at most four bytes a character
                    stop += 1
                ids = v.encode(texts[start:stop])
                ids = [x if t and v.whole(t.encode(), *x) else (none, none) for t, x in zip(texts[start:stop], ids, strict=True)]
                yield _aligned(v, docs[start:stop], ids, row)
                row, start = row + stop - start, stop

    return run


def alignments(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups, pairs) of every document: groups as `a1,a2|b1;a3|b2,b3`; pairs holds
    each linked pair of ids and how many links have it. row tells the documents of one job apart: write them before it is used.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _batches(a_file, b_file), "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<struct<a: int, b: int, times: int>>"
    )


def pair_counts(written: DataFrame) -> DataFrame:
    """(a, b, n, best): the documents that hold a pair linked; best: no pair with this id of A has more."""
    counts = materialize(written.select(F.inline("pairs")).groupBy("a", "b").agg(F.count("*").alias("n")))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return materialize(counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")))


def link_scores(written: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of the documents with links."""
    side = sized(counts) if counts.count() <= ROWS else counts
    found = written.select("row", F.inline("pairs")).join(side, ["a", "b"])
    return found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = alignments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    written = materialize(found.withColumn("groups_sha256", digest).drop("groups"))
    scores = link_scores(written, pair_counts(written))
    return written.join(scores, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
