"""N-gram Jaccard join: sets meet at shared tokens of their rarest shingles, tries in bounded blocks find the links.

1. Order. A sketch of 2**SKETCH_BITS counters, each text's distinct shingles added over all documents, gives every shingle
   a frequency level. Shingles are ordered by level, then by hash: one order for all sets, rarest first. Collisions in the
   sketch make a shingle look more frequent than it is; that moves it in the order, which changes cost and never a result.
2. Tokens. With that order, two sets that may be linked share one of their first n - ceil(t n) + 1 shingles. Sets that
   share such a token are a group; a token that only one set has is dropped. Nothing is estimated here.
3. Blocks. The home group of a set is that of its most frequent shared token, cut into blocks of up to BLOCK sets and
   BLOCK_SIZE shingles; the set of the smallest key visits all blocks of its group, so that a family of copies is joined
   across blocks. Sets that share too few tokens with their block for any link are left out (_enough). A block orders its
   shingles by their frequency in it and keeps tries of its sets (see trie.py), one for each family that its links form,
   so a set that is like a family stops at the first link to it.
4. The rest. Components of the links so far are labelled. Where the sets of a group have different labels, those that
   aren't of the group's commonest label search each block that a set of another label and of a fitting size is at home
   in, if they share enough tokens with it. So a link is missed by neither step: its two sets share a group, and either
   have one label, one block, or one searches the block of the other. Steps 3 and 4 run once each; the number of jobs
   doesn't depend on what the groups hold.

Sets are named by a digest of theirs, so equal sets are one set and copies cost nothing after step 2.

Documents: null or empty texts (or such without words) have the empty set and link with nothing. Repeated rows give
repeated result rows; rows of one doc_id with different texts are linked by it. A null doc_id is never a component's name;
such a row has the component of its set, null if no document with an id has an equal set. Columns besides doc_id and
text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import connected_components, drop, materialize, sized, small_batches, table
from .shingles import digest, shingle_set
from .trie import SetTrie, Vocabulary

#: Sets and shingles in a block, and searching sets in a share of a block.
BLOCK, BLOCK_SIZE, SHARE = 256, 1 << 21, 2000
#: Counters of the frequency sketch, whose levels are broadcast (a byte each, 4 MB), and counters in a row of it.
SKETCH_BITS, CHUNK_BITS = 22, 16
#: Bits of the filter for groups of two or more sets: bounds what is broadcast to 8 MB. Fuller, it lets more pass, no fewer.
FILTER_BITS = 26


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def _packed(counts: np.ndarray) -> bytes:
    """A row of counters: places and values if few are set, else all of them, compressed."""
    at = np.flatnonzero(counts)
    if len(at) * 8 < len(counts):
        return b"s" + at.astype(np.uint16).tobytes() + counts[at].tobytes()
    return b"z" + zlib.compress(counts.tobytes(), 1)


def _add_packed(total: np.ndarray, row: bytes) -> None:
    if row[:1] == b"z":
        total += np.frombuffer(zlib.decompress(row[1:]), np.uint32)
    else:
        n = (len(row) - 1) // 6
        total[np.frombuffer(row, np.uint16, n, 1)] += np.frombuffer(row[1 + 2 * n :], np.uint32)


def _counted(k: int):
    """One sketch for each task: (chunk, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shift, one = np.zeros(1 << SKETCH_BITS, np.uint32), np.uint64(64 - SKETCH_BITS), np.uint32(1)
        for batch in batches:
            for text in _texts(batch):
                np.add.at(counts, (shingle_set(text, k) >> shift).astype(np.int64), one)
        rows = [(i, _packed(part)) for i, part in enumerate(counts.reshape(-1, 1 << CHUNK_BITS)) if part.any()]
        yield pa.record_batch([pa.array([i for i, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.binary())], ["chunk", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            _add_packed(totals.setdefault(i, np.zeros(1 << CHUNK_BITS, np.uint64)), row)
    levels = [np.minimum(63, 2 * np.log2(t + 1.0)).astype(np.uint8).tobytes() for t in totals.values()]
    yield pa.record_batch([pa.array(list(totals), pa.int32()), pa.array(levels, pa.binary())], ["chunk", "levels"])


def frequency_levels(docs: DataFrame, k: int) -> np.ndarray:
    """The frequency level (0 to 63, two for each doubling) of every counter, over the shingles of all documents."""
    parts = docs.select("text").mapInArrow(_counted(k), "chunk int, counts binary").repartition("chunk").mapInArrow(_summed, "chunk int, levels binary")
    levels = np.zeros((1 << (SKETCH_BITS - CHUNK_BITS), 1 << CHUNK_BITS), np.uint8)
    for row in parts.toArrow().to_pylist():  # 2**SKETCH_BITS bytes in all
        levels[row["chunk"]] = np.frombuffer(row["levels"], np.uint8)
    return levels.reshape(-1)


def ordered(items: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Tokens whose numeric order is the global order of shingles: six bits of level, then the hash."""
    level = levels[(items >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return level << np.uint64(58) | items >> np.uint64(6)


def head(items: np.ndarray, levels: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first n - ceil(t n) + 1 tokens of a set: two sets of similarity t or more share one."""
    n = len(items)
    if not n:
        return items
    tokens, most = ordered(items, levels), n + num * n // -den + 1
    return tokens if most >= n else np.partition(tokens, most - 1)[:most]


def _headed(levels, k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, heads = [], [], []
            for text in _texts(batch):
                items = shingle_set(text, k)
                sizes.append(len(items))
                keys.append(digest(items)[0] if len(items) else None)
                heads.append(head(items, levels.value, num, den).view(np.int64))
            ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *heads])))], ["doc_id", "n", "key", "head"])

    return run


def _shared(bits):
    """(token, key, n) of the tokens that the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        for batch in batches:
            heads = batch.column(2)
            tokens, rows = heads.flatten().to_numpy(), heads.value_parent_indices().to_numpy()
            at = tokens & ((1 << FILTER_BITS) - 1)
            kept = np.flatnonzero(words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
            rows = pa.array(rows[kept])
            yield pa.record_batch([pa.array(tokens[kept]), batch.column(0).take(rows), batch.column(1).take(rows)], ["token", "key", "n"])

    return run


def _groups(heads: DataFrame) -> DataFrame:
    """(token, key, n) of the tokens that two or more sets share. heads: (key, n, head), a row for each set.

    A row that is there twice makes its tokens look shared, which costs and changes nothing."""
    spark = heads.sparkSession
    many = materialize(heads.select(F.explode("head").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"))
    slot = F.col("token").bitwiseAND((1 << FILTER_BITS) - 1)
    words = many.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast((token & 63) as int))")).alias("bits")).toArrow()  # at most 2**FILTER_BITS / 64 rows
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    passed = heads.mapInArrow(_shared(spark.sparkContext.broadcast(bits)), "token long, key long, n long")
    return passed.dropDuplicates(["token", "key"]).join(many, "token", "left_semi")


class _Families:
    """The components that the sets of a block form, each with the tries of its sets."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.tries = num, den, []

    def links(self, ranks: np.ndarray, n: int) -> list[tuple[int, object]]:
        """(number of the family, one of its sets that is similar enough)."""
        out = []
        for f, tries in enumerate(self.tries):
            for trie in tries:
                if found := trie.search(ranks, n, first=True):
                    out.append((f, found[0][0]))
                    break
        return out

    def add(self, key, ranks: np.ndarray) -> list:
        """Adds a set; its links to the families so far, which it joins into one."""
        found = self.links(ranks, len(ranks))
        if not found:
            self.tries.append([SetTrie(self.num, self.den)])
            home = self.tries[-1]
        else:
            joined = {f for f, _ in found}
            home = max((self.tries[f] for f in joined), key=lambda t: max(len(x.size) for x in t))
            home += [t for f in joined if self.tries[f] is not home for t in self.tries[f]]
            self.tries = [t for f, t in enumerate(self.tries) if f not in joined or t is home]
        home[0].add(key, ranks)
        return [other for _, other in found]


def _blocks(k: int, num: int, den: int):
    """Rows sorted by block, index rows (kind 0) before searching ones: (a, b), links among the index and from searchers to it."""

    class Block:
        def __init__(self):
            self.waiting, self.names, self.families = [], Vocabulary([]), _Families(num, den)

        def close(self) -> list[tuple]:
            """Takes up the sets of the index, in the order of the shingles' frequency among them."""
            self.names = Vocabulary([items for _, items in self.waiting])
            out = [(key, other) for key, items in self.waiting for other in self.families.add(key, self.names.ranks(items))]
            self.waiting = []
            return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, held, out = None, None, Block(), []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for b, salt, kind, key, text in zip(*cols, _texts(batch), strict=True):
                if (b, salt) != now:
                    out += held.close()
                    now, held = (b, salt), Block()
                if (now, kind, key) == last:
                    continue  # a repeated row
                items = shingle_set(text, k)
                if not len(items) or digest(items)[0] != key:
                    continue  # another text of the same doc_id
                last = (now, kind, key)
                if kind == 0:
                    held.waiting.append((key, items))
                else:
                    if held.waiting:
                        out += held.close()
                    out += [(key, other) for _, other in held.families.links(held.names.ranks(items), len(items)) if other != key]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 2)], ["a", "b"])
            out = []
        out = held.close()
        yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 2)], ["a", "b"])

    return run


def trie_join(docs: DataFrame, classes: DataFrame, index: DataFrame, probe: DataFrame | None, k: int, num: int, den: int) -> DataFrame:
    """(a, b) of Jaccard num/den or more: links that connect the index of a block as all its links would, and for each
    searching set one link to every component that the block's index forms.

    classes: (key, id), a document of each set; index and probe: (block, key). A block with many searching sets is split
    into shares, each with the whole index of the block; callers keep that index small (BLOCK).
    """
    if probe is None:
        rows = index.select("block", F.lit(0).alias("salt"), F.lit(0).alias("kind"), "key")
    else:
        shares = materialize(probe.groupBy("block").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")))
        left = index.join(sized(shares), "block").select("block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.lit(0).alias("kind"), "key")
        rows = left.unionByName(probe.join(sized(shares), "block").select("block", F.pmod(F.xxhash64("key"), F.col("shares")).cast("int").alias("salt"), F.lit(1).alias("kind"), "key"))
    rows = materialize(rows.join(classes.select("key", F.col("id").alias("doc_id")), "key"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, since searches cost far more than their bytes say
    dealt = docs.join(sized(rows), "doc_id").select("block", "salt", "kind", "key", "text").repartition(tasks, "block", "salt").sortWithinPartitions("block", "salt", "kind", "key")
    return dealt.mapInArrow(_blocks(k, num, den), "a long, b long")


def _homes(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, key, n) of all sets, and of those that have others in their block besides the pivot's visits. posts: (token, key, n)."""
    homes = materialize(posts.groupBy("key").agg(F.max("token").alias("token"), F.first("n").alias("n")))
    cuts = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SIZE))).alias("cuts")
    cut = materialize(homes.groupBy("token").agg(F.min(F.struct("key", "n")).alias("pivot"), F.count("*").alias("size"), cuts).where("size > 1"))
    own = homes.join(sized(cut).select("token", "cuts"), "token", "left")
    home = materialize(own.select(F.xxhash64("token", F.pmod(F.xxhash64("key"), F.coalesce("cuts", F.lit(1)))).alias("block"), "key", "n", F.col("cuts").isNotNull().alias("shared")))
    pivots = cut.where("cuts > 1").select("token", "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("i")).select(F.xxhash64("token", "i").alias("block"), "pivot.key", "pivot.n")
    return home.drop("shared"), materialize(home.where("shared").drop("shared").unionByName(pivots).distinct())


def _enough(num: int, den: int):
    """Whether c common tokens of two heads allow a link of a set of n to one of `small` to `large` shingles.

    Of two sets x and y, let the head of z end first in the order. What they share up to there is in both heads; beyond, z
    has ceil(t |z|) - 1 shingles. So c >= t / (1 + t) (|x| + |y|) - t max(|x|, |y|), least at an end of the range of |y|.
    """

    def short(size):
        near = F.least(F.greatest(size, F.ceil(F.col("n") * num / den)), F.floor(F.col("n") * den / num))
        return (F.col("n") + near) * (num * den) - F.greatest(F.col("n"), near) * (num * (num + den))

    return F.col("c") * ((num + den) * den) >= F.least(short(F.col("small")), short(F.col("large")))


def _likely(index: DataFrame, posts: DataFrame, num: int, den: int) -> DataFrame:
    """(block, key): the sets of an index that share enough tokens with others of their block."""
    rows = index.join(posts.select("key", "token"), "key").repartition("block")
    met = rows.withColumn("met", F.count("*").over(W.Window.partitionBy("block", "token")) > 1)
    sets = met.groupBy("block", "key").agg(F.first("n").alias("n"), F.count_if("met").alias("c"))
    every = W.Window.partitionBy("block")
    sets = sets.withColumn("small", F.min("n").over(every)).withColumn("large", F.max("n").over(every))
    return sets.where("c > 0").where(_enough(num, den)).select("block", "key")


def _rest(posts: DataFrame, home: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """(block, key): the searches that sets of different labels still need, one for each set and block."""
    known = home.join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "block", F.coalesce("component", "key").alias("label"))
    rows = materialize(posts.join(sized(materialize(known)), "key"))
    count = rows.groupBy("token", "label").agg(F.count("*").alias("c"))
    mixed = materialize(count.groupBy("token").agg(F.max_by("label", "c").alias("main"), F.count("*").alias("labels")).where("labels > 1").select("token", "main"))
    held = rows.join(sized(mixed), "token")
    stats = (F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("small"), F.max("n").alias("large"), F.max(F.col("label") == F.col("main")).alias("has_main"))
    blocks = held.groupBy("token", F.col("block").alias("other")).agg(*stats)
    fits = (F.col("n") * den >= F.col("small") * num) & (F.col("large") * den >= F.col("n") * num)
    new = (F.col("block") != F.col("other")) & ((F.col("low") != F.col("label")) | (F.col("high") != F.col("label"))) & (F.col("has_main") | (F.col("block") < F.col("other")))
    asked = materialize(held.where("label <> main").join(blocks, "token").where(fits & new).select("other", "key").distinct())
    common = asked.join(rows.select("key", "token", "n"), "key").join(rows.select("token", F.col("block").alias("other")).distinct(), ["token", "other"])
    sizes = home.groupBy(F.col("block").alias("other")).agg(F.min("n").alias("small"), F.max("n").alias("large"))
    return materialize(common.groupBy("other", "key").agg(F.first("n").alias("n"), F.count("*").alias("c")).join(sizes, "other").where(_enough(num, den)).select(F.col("other").alias("block"), "key"))


def ngram_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document; linked at Jaccard num/den or more of k-word shingle sets."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    levels = spark.sparkContext.broadcast(frequency_levels(docs, k))
    headed = materialize(docs.mapInArrow(_headed(levels, k, num, den), "doc_id long, n long, key long, head array<long>"))
    sets = materialize(headed.drop("head"))
    named = sets.where("key is not null and doc_id is not null")
    every = materialize(named.groupBy("key").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")))
    classes, copied = every.select("key", "id"), materialize(every.where("copies > 1").select("key", "id"))
    heads = headed.where("key is not null and doc_id is not null").join(sized(copied), "key", "left").where("id is null or id = doc_id")
    posts = materialize(_groups(heads.select("key", "n", "head")))
    drop(headed, copied)

    home, index = _homes(posts)
    links = materialize(trie_join(docs, classes, _likely(index, posts, num, den), None, k, num, den))
    repeated = materialize(named.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("doc_id", "a"))
    links = links.unionByName(materialize(named.join(sized(repeated), "doc_id").select("a", F.col("key").alias("b")).where("a <> b").distinct()))
    labels = materialize(connected_components(links))
    probe = _rest(posts, home, labels, num, den)
    if not probe.isEmpty():
        asked = materialize(probe.select("block").distinct())
        found = materialize(trie_join(docs, classes, home.select("block", "key").join(sized(asked), "block", "left_semi"), probe, k, num, den))
        if not found.isEmpty():
            labels = materialize(connected_components(links.unionByName(found)))
    names = labels.withColumnRenamed("node", "key").join(classes, "key")
    joined = materialize(names.join(names.groupBy("component").agg(F.min("id").alias("component_id")), "component").select("key", "component_id"))
    ends = materialize(classes.join(sized(joined), "key", "left").select("key", F.coalesce("component_id", "id").alias("component_id")))
    out = sets.join(sized(ends), "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


#: DuckDB: all shingles by word, pairs by shared shingle. Quadratic in shared shingles, so for small tables only.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.c)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""
