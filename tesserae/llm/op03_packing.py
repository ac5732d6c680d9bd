"""Best-fit packing of token pieces into sequences: best-fit decreasing over lengths, then swap-based local search.

Lengths are whole numbers up to the capacity, so a packing is fully described by how many sequences hold which lengths.
Both steps work on such kinds of sequence with multiplicities, never on documents: what the driver holds is bounded by
the capacity (at most a few kinds for each length), however many documents there are, and the packing is a global one.

* Best fit decreasing: take the largest length left, fill what remains with the best fitting lengths, and repeat that
  kind as often as the counts allow.
* Local search: between two kinds that are not full, exchange a length for a larger one, two lengths for a larger one, or
  move a length, whenever the sum of squared fills grows; kinds whose sequences become empty go. Each step acts on
  min(multiplicities) sequences at once. The search ends where no such step is left.

Pieces get their place by rank within their length: ranks are taken within salted groups and offset by the groups'
counts, so a length that a third of all pieces share is no single task's work.

Tokens: ids of a byte-level BPE vocabulary, with id 0 after each document. Documents longer than the capacity are cut
into full pieces, the first of which may be shorter. Null and empty texts give the one token 0. Repeated rows are packed
as often as they come; a null doc_id stays null. An empty table gives an empty result. Tie order: see _ranked().
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import materialize, small_batches, table

CAPACITY = 2048
#: Entries of a worker's table of known words, and the longest kept: bounds its memory.
MEMO, WORD = 600_000, 48
#: Pieces in a salted group within which ranks are taken.
GROUP = 20_000


class _Words(dict):
    """Ids of a space and a word as little-endian 32-bit numbers; what is not kept is encoded each time."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(" " + word), "<u4").tobytes()
        if len(self) < MEMO and len(word) <= WORD:
            self[word] = ids
        return ids


@functools.cache
def _worker(rank_file: str, json_file: str, pattern: str):
    import tiktoken
    from tokenizers import Tokenizer

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {"<|endoftext|>": 50256}
    coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    encode = functools.partial(coder.encode, allowed_special="all")
    return encode, _Words(encode), Tokenizer.from_file(json_file)


#: White space after a space: there, words can't be encoded on their own.
_SPACES = re.compile(r" (?:\s|$)")


def _encode(text: str, encode, words: _Words) -> bytes:
    if not text:
        return b""
    if _SPACES.search(text):
        return np.array(encode(text), "<u4").tobytes()
    first, *rest = text.split(" ")
    return np.array(encode(first), "<u4").tobytes() + b"".join(map(words.__getitem__, rest))


def _pieces(files: tuple[str, str, str], capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, words, library = _worker(*files)
        for batch in batches:
            out: list[tuple] = []
            texts = batch.column(1).to_pylist()
            for k, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), texts, strict=True)):
                ids = _encode(text or "", encode, words)
                if k == 0 and np.frombuffer(ids, "<u4").tolist() != library.encode(text or "", add_special_tokens=False).ids:
                    raise ValueError(f"ids of document {doc} differ from the library's")
                ids += bytes(4)
                n = len(ids) // 4
                cut = n % capacity or min(n, capacity)
                for p, (a, b) in enumerate(zip([0, *range(cut, n, capacity)], [cut, *range(cut + capacity, n + 1, capacity)], strict=True)):
                    out.append((doc, p, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(counts: dict[int, int], capacity: int) -> list[list]:
    """Kinds of sequence [lengths, multiplicity] that hold counts[length] pieces of each length."""
    left = {n: c for n, c in counts.items() if c}
    sizes = sorted(left)
    kinds = []
    while sizes:
        room, use = capacity, Counter()
        while True:
            at = bisect_right(sizes, room) - 1
            while at >= 0 and left[sizes[at]] <= use[sizes[at]]:
                at -= 1
            if at < 0:
                break
            n = sizes[at]
            use[n] += 1
            room -= n
        times = min(left[n] // c for n, c in use.items())
        kinds.append([sorted(use.elements(), reverse=True), times])
        for n, c in use.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
                sizes.remove(n)
    return kinds


def local_search(kinds: list[list], capacity: int) -> list[list]:
    """Swaps and moves between kinds that are not full, until none raises the squared fill.

    The fuller kind takes a longer length from the other for none, one or two of its own, as far as its room allows.
    Fullest takers and emptiest givers first. A kind waits in a queue to be tried as a taker; one that found nothing comes
    back only when a new kind holds a length that it could take.
    """
    full: Counter = Counter()
    todo: Counter = Counter()
    for k, m in kinds:
        (full if sum(k) == capacity else todo)[tuple(sorted(k, reverse=True))] += m
    pool = _Pool(capacity)
    for k in todo:
        pool.add(k)
    queue = [(-sum(k), k) for k in todo]
    heapify(queue)
    while queue:
        take = heappop(queue)[1]
        step = pool.step(take, todo) if take in todo else None
        if not step:
            continue
        give, new = step
        times = min(todo[take], todo[give]) if take != give else todo[take] // 2
        for k, m in ((take, -times), (give, -times), (new[0], times), (new[1], times)):
            if not k:
                continue
            if sum(k) == capacity:
                full[k] += m
                continue
            fresh = k not in todo
            todo[k] += m
            if not todo[k]:
                del todo[k]
                pool.remove(k)
                continue
            if fresh:
                pool.add(k)
                for other in pool.takers(k):
                    heappush(queue, (-sum(other), other))
            heappush(queue, (-sum(k), k))
    return [[list(k), m] for k, m in [*full.items(), *todo.items()]]


class _Pool:
    """Kinds that are not full: what each can take, and who gives each length."""

    def __init__(self, capacity: int):
        self.lengths = np.arange(capacity + 1)
        self.rows: dict[tuple, int] = {}
        self.kinds: list[tuple | None] = []
        self.free: list[int] = []
        self.sums = np.zeros(64, np.int64)
        self.takes = np.zeros((64, capacity + 1), bool)
        self.givers: list[list] = [[] for _ in range(capacity + 1)]
        self.emptiest = np.full(capacity + 1, capacity + 1)

    def add(self, kind: tuple) -> None:
        if self.free:
            at = self.free.pop()
            self.kinds[at] = kind
        else:
            at = len(self.kinds)
            self.kinds.append(kind)
            if at == len(self.sums):
                self.sums, self.takes = np.concatenate([self.sums, np.zeros_like(self.sums)]), np.concatenate([self.takes, np.zeros_like(self.takes)])
        self.rows[kind], self.sums[at], self.takes[at] = at, sum(kind), self._gains(kind)[0] > 0
        for x in set(kind):
            heappush(self.givers[x], (sum(kind), kind))
            self.emptiest[x] = self.givers[x][0][0]

    def remove(self, kind: tuple) -> None:
        at = self.rows.pop(kind)
        self.kinds[at], self.takes[at] = None, False
        self.free.append(at)
        for x in set(kind):
            self._prune(x)

    def _prune(self, x: int) -> None:
        heap = self.givers[x]
        while heap and heap[0][1] not in self.rows:
            heappop(heap)
        self.emptiest[x] = heap[0][0] if heap else len(self.emptiest)

    def _gains(self, kind: tuple) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        """For each length: the gain of taking it (0 if it can't be taken) and which of the kind's own lengths go for it."""
        own = sorted(set(kind))
        out = {0: ()} | {x: (x,) for x in own}
        for i, x in enumerate(own):
            for y in own[i if kind.count(x) > 1 else i + 1 :]:
                out.setdefault(x + y, (x, y))
        sums = np.array(sorted(out))
        at = sums.searchsorted(self.lengths - (len(self.lengths) - 1 - sum(kind)), "left")
        gains = np.where(at < len(sums), self.lengths - sums[np.minimum(at, len(sums) - 1)], 0)
        return gains, at, [out[x] for x in sums.tolist()]

    def takers(self, give: tuple) -> list[tuple]:
        """The kinds at least as full as a new one that could take a length from it."""
        hit = self.takes[: len(self.kinds), sorted(set(give))].any(axis=1) & (self.sums[: len(self.kinds)] >= sum(give))
        return [k for k in (self.kinds[i] for i in np.flatnonzero(hit)) if k is not None]

    def step(self, take: tuple, todo: Counter) -> tuple | None:
        """The change of the largest gain for a taker: (giver, new kinds), or None."""
        gains, at, parts = self._gains(take)
        gains = np.where(self.emptiest <= sum(take), gains, 0)
        while True:
            x = int(gains.argmax())
            if gains[x] <= 0:
                return None
            give = self._giver(x, take, todo)
            if give is not None:
                break
            gains[x] = 0
        a, b = Counter(take), Counter(give)
        a.subtract(parts[at[x]])
        b.update(parts[at[x]])
        a[x] += 1
        b[x] -= 1
        return give, tuple(tuple(sorted(c.elements(), reverse=True)) for c in (a, b))

    def _giver(self, x: int, take: tuple, todo: Counter) -> tuple | None:
        """The emptiest kind that has x and is no fuller than the taker; the taker itself only if it comes twice."""
        heap, found = self.givers[x], None
        self._prune(x)
        alone = []
        while heap and heap[0][1] == take and todo[take] < 2:
            alone.append(heappop(heap))
            self._prune(x)
        if heap and heap[0][0] <= sum(take):
            found = heap[0][1]
        for one in alone:
            heappush(heap, one)
        self._prune(x)
        return found


def slots(kinds: list[list]) -> dict[int, list[tuple[int, int, int]]]:
    """For each length: (first rank, first sequence, offset) of the runs of places, in rank order."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    seen: Counter = Counter()
    base = 0
    for lengths, times in kinds:
        offset = 0
        for n in lengths:
            out.setdefault(n, []).append((seen[n], base, offset))
            seen[n] += times
            offset += n
        base += times
    return out


def _ranked(pieces: DataFrame) -> DataFrame:
    """pieces with `place`, their rank from 0 among those of equal length; ties between repeated rows fall either way."""
    many = pieces.groupBy("length").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    salted = pieces.join(F.broadcast(many), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.col("groups")))  # a row for each length: CAPACITY at most
    before = W.Window.partitionBy("length").orderBy("salt").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    own = F.row_number().over(W.Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    return salted.withColumn("own", own).join(offsets, ["length", "salt"]).withColumn("place", F.col("own") - 1 + F.col("ahead"))


def _placed(runs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = {n: np.array(r, np.int64) for n, r in runs.value.items()}
        for batch in batches:
            length, place = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at, r = np.flatnonzero(length == n), table_of[int(n)]
                k = np.searchsorted(r[:, 0], place[at], "right") - 1
                sequence[at], offset[at] = r[k, 1] + place[at] - r[k, 0], r[k, 2]
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, files: tuple[str, str, str], capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece. files: rank file, its JSON, pattern."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(files, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # a row for each length: capacity at most
    runs = spark.sparkContext.broadcast(slots(local_search(best_fit(counts, capacity), capacity)))
    ranked = _ranked(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "place")
    return ranked.mapInArrow(_placed(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def vocabulary_files() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_files())
