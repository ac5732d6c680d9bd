"""SentencePiece encoding and decoding with merge-type vocabularies: a score-ordered agenda of adjacent symbol pairs.

A text is cut where no piece of the vocabulary can cross: before a space that follows another character, unless the
vocabulary joins those two. Each part starts as single characters; the agenda holds the adjacent pairs that form a piece,
the best score first and, among equals, the leftmost. Characters outside the vocabulary become byte pieces. Every part is
encoded once in a worker while the table of known parts has room, and every newly encoded part of an Arrow batch is
checked against the sentencepiece library, which must give the same ids and text; a difference raises.

Null and empty texts have no ids. Only vocabularies whose normalisation is the identity, with a space put in front and
spaces kept, are taken; others raise. The table of parts is bounded (MEMO entries of up to PART characters), longer parts and later ones are encoded
each time they come, so results do not depend on it. Rows keep their number; repeated rows give repeated rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

SPACE = "▁"
MEMO, PART = 600_000, 64
_NONE = float("-inf")


class PairAgenda:
    """Encoder and decoder over a merge-type vocabulary."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for probe in ("  a  b ", "Ⅲ ﬁ　x"):
            if lib.normalize(probe) != SPACE + probe.replace(" ", SPACE):
                raise ValueError("the vocabulary's normalisation is not the identity")
        self.ids, self.score, self.bytes, self.unknown = {}, {}, [0] * 256, lib.unk_id()
        self.pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        for i, piece in enumerate(self.pieces):
            if lib.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.ids[piece], self.score[piece] = i, lib.get_score(i)
        #: What a piece stands for inside a text; None for bytes and what is not text.
        self.plain = [p.replace(SPACE, " ") if p in self.ids else None for p in self.pieces]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)} if self.bytes[0] != self.bytes[1] else {}
        #: Characters that some piece has just before a space.
        self.joined = {p[i - 1] for p in self.ids for i in range(1, len(p)) if p[i] == SPACE}

    def parts(self, text: str) -> list[str]:
        """The normalised text, cut before every space that no piece can join to the character in front."""
        if not text:
            return []
        words = text.replace(SPACE, " ").split(" ")
        if self.joined <= {SPACE} and "" not in words:
            return [SPACE + w for w in words]
        whole, out, start = SPACE + SPACE.join(words), [], 0
        for i in range(1, len(whole)):
            if whole[i] == SPACE and whole[i - 1] not in self.joined:
                out.append(whole[start:i])
                start = i
        return [*out, whole[start:]]

    def encode(self, part: str) -> list[int]:
        symbols, get = list(part), self.score.get
        if len(symbols) <= 48:
            agenda = [get(a + b, _NONE) for a, b in pairwise(symbols)]
            while agenda and (best := max(agenda)) > _NONE:
                i = agenda.index(best)  # the leftmost
                symbols[i] = new = symbols[i] + symbols[i + 1]
                del symbols[i + 1], agenda[i]
                if i:
                    agenda[i - 1] = get(symbols[i - 1] + new, _NONE)
                if i < len(agenda):
                    agenda[i] = get(new + symbols[i + 1], _NONE)
        else:
            symbols = self._long(symbols)
        try:
            return [self.ids[s] for s in symbols]
        except KeyError:
            pass
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.byte_of:
                out += [self.bytes[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return out

    def _long(self, symbols: list[str]) -> list[str]:
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := self.score.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(agenda, (-s, i, j, len(symbols[i]), len(symbols[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, a, b = heapq.heappop(agenda)
            if len(symbols[i]) != a or len(symbols[j]) != b or after[i] != j:
                continue
            symbols[i], symbols[j] = symbols[i] + symbols[j], ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s]

    def decode(self, ids: list[int], start: bool = True) -> str:
        """The text of ids; start: they begin a text, so the space that was put in front goes."""
        try:
            text = "".join([self.plain[i] for i in ids])
            return text[1:] if start and text[:1] == " " else text
        except TypeError:
            pass
        out, run = [], bytearray()
        for k, i in enumerate(ids):
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            piece = self.pieces[i]
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i in (self.library.bos_id(), self.library.eos_id()):
                pass
            else:
                out.append(piece[1:] if start and k == 0 and piece[:1] == SPACE else piece)
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")


@functools.cache
def _worker(model_file: str) -> tuple[PairAgenda, dict[str, str], dict[str, str]]:
    """What a worker keeps from task to task: the vocabulary, and the ids and texts of known parts."""
    return PairAgenda(model_file), {}, {}


def _learn(vocabulary: PairAgenda, fresh: list[str], ids_of: dict[str, str], text_of: dict[str, str]) -> None:
    """Encodes and decodes parts, given without the space in front, and checks them against the library."""
    own = [vocabulary.encode(SPACE + p) for p in fresh]
    theirs = vocabulary.library.encode(fresh, num_threads=1)
    back = iter(vocabulary.library.decode([x for x in theirs if x]))
    for p, ids, other in zip(fresh, own, theirs, strict=True):
        text = vocabulary.decode(ids, start=False)
        if p and (ids != other or text[1:] != next(back)):  # the library gives no ids for an empty text
            raise ValueError(f"ids or text differ from the library's for {p!r}")
        ids_of[p], text_of[p] = ",".join(map(str, ids)), text


def _batches(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, ids_of, text_of = _worker(model_file)
        simple = vocabulary.joined <= {SPACE}
        for batch in batches:
            cut = []
            for t in batch.column(1).to_pylist():
                words = t.split(" ") if t else []
                cut.append(words if simple and t and SPACE not in t and "" not in words else [p[1:] for p in vocabulary.parts(t)] if t else [])
            kept = len(ids_of) < MEMO
            fresh = list({p for parts in cut for p in parts if p not in ids_of})
            ids_now, text_now = (ids_of, text_of) if kept else ({}, {})
            _learn(vocabulary, fresh, ids_now, text_now)
            n, sha, texts = [], [], []
            for parts in cut:
                if kept:
                    ids, text = ",".join(map(ids_of.__getitem__, parts)), "".join(map(text_of.__getitem__, parts))
                else:
                    ids, text = ",".join([ids_of.get(p) or ids_now[p] for p in parts]), "".join([text_of.get(p) or text_now[p] for p in parts])
                n.append(ids.count(",") + 1 if ids else 0)
                sha.append(hashlib.sha256(ids.encode()).hexdigest())
                texts.append(hashlib.sha256(text[1:].encode()).hexdigest())
            for p in fresh if kept else ():
                if len(p) > PART:
                    del ids_of[p], text_of[p]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = PairAgenda(model_file)
        for batch in batches:
            ids = [[i for p in vocabulary.parts(t) for i in vocabulary.encode(p)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([vocabulary.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return run


def sentencepiece_ids(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids, decoded): the ids themselves and the text that they decode to."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_ids(model_file), "doc_id long, ids array<int>, decoded string")


def sentencepiece_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_batches(model_file), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
