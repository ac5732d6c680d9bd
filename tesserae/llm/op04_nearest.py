"""Approximate nearest neighbours by shifted Hilbert orderings of projected vectors.

Equal vectors form a class, of which the smallest ids are kept (k + 1 suffice for any answer); classes are indexed.
Each ordering has its own random orthonormal projection to DIMS dimensions and its own random shift on the grid, whose
scale comes from a bounded sample (SAMPLE classes). Spark range-partitions all classes by (ordering, key), which gives
every class its exact rank in each ordering. A query's candidates are the classes within WINDOW of the index on either
side of its rank in any ordering; they are searched block by block, each block with all its queries at once, and the
best of all blocks are merged and ranked by exact distance in double precision.

WINDOW is a share of the index, so recall does not fall as tables grow. Vectors that are close to uniform in many
dimensions, as in the test tables, need a large one; clustered vectors do with far less.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose length is not the
most common one (the smaller of two equally common). A null id takes no part. Repeated rows count once; if an id comes
with several vectors, its nearest counts. Ties go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import materialize, sized, small_batches, table
from .hilbert import hilbert_keys

ORDERINGS, DIMS, BITS, WINDOW = 8, 8, 7, 0.1
SAMPLE = 4096
#: Classes in a block of an ordering, and queries in a share of a block's queries.
BLOCK, SHARE = 2048, 1000


def _frames(dim: int, sample: np.ndarray, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(projection, scale, shift) for each ordering: grid cells are floor(x @ projection * scale + shift)."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(ORDERINGS):
        p = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : min(DIMS, dim)]
        y = sample @ p
        low, high = y.min(0), y.max(0)
        scale = (1 << BITS) * 0.5 / np.maximum(high - low, 1e-12)
        out.append((p, scale, rng.random(p.shape[1]) * (1 << BITS) * 0.5 - low * scale))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _keys(frames):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            for o, (p, scale, shift) in enumerate(frames.value if len(x) else ()):
                with np.errstate(over="ignore", invalid="ignore"):
                    cells = np.clip(np.nan_to_num(np.floor(x @ p * scale + shift)), 0, (1 << BITS) - 1).astype(np.int64)
                yield pa.record_batch([pa.array(np.full(len(x), o, np.int32)), pa.array(hilbert_keys(cells, BITS)), batch.column(0)], ["o", "key", "cid"])

    return run


def distances(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Euclidean distances; where squares leave the range of doubles, by the largest difference and shares of it."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        apart = rows - one
        d = np.sqrt((apart**2).sum(1))
        again = np.flatnonzero(~np.isfinite(d) | (d < 1e-150))
        if len(again):
            most = np.abs(apart[again]).max(1)
            d[again] = most * np.sqrt(((apart[again] / np.where(most > 0, most, 1.0)[:, None]) ** 2).sum(1))
    return d


def _best(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q, c = _matrix(queries["vec"].combine_chunks()), _matrix(rows["vec"].combine_chunks())
        qid, cid = queries["qid"].to_numpy(), rows["cid"].to_numpy()
        q_rank, c_rank, reach = queries["rank"].to_numpy(), rows["rank"].to_numpy(), queries["reach"].to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(q) and len(c):
            with np.errstate(over="ignore", invalid="ignore"):
                squares = (c * c).sum(1)
                rough = squares[None] - 2 * q @ c.T
                slack = 1e-9 * (squares.max() + (q * q).sum(1))
            for i in range(len(q)):
                near = np.flatnonzero(np.abs(c_rank - q_rank[i]) <= reach[i])
                r = rough[i, near]
                if len(near) > k and np.isfinite(r).all() and np.isfinite(slack[i]):  # else all are measured
                    near = near[r <= np.partition(r, k - 1)[k - 1] + slack[i]]
                d = distances(c[near], q[i])
                kept = np.lexsort((cid[near], d))[:k]
                out.append((np.full(len(kept), qid[i]), cid[near][kept], d[kept]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2].astype(np.float64))], ["qid", "cid", "score"])

    return run


def nearest(vectors: DataFrame, queries: str, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score). vectors: (vec_id, embedding); queries: a condition on vec_id."""
    spark = vectors.sparkSession
    small_batches(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    valid = valid.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    common = valid.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if not common:
        return spark.createDataFrame([], schema)
    valid = valid.where(F.size("vec") == common.dim).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
    by_id = W.Window.partitionBy("h1", "h2").orderBy("vec_id")
    members = materialize(valid.select("h1", "h2", "vec_id").distinct().withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1))
    classes = materialize(members.where("place = 1").select("h1", "h2", F.col("vec_id").alias("cid")))
    index = materialize(valid.join(classes, (valid.vec_id == classes.cid) & (valid.h1 == classes.h1) & (valid.h2 == classes.h2)).select("cid", "vec").dropDuplicates(["cid"]))
    total = index.count()
    sample = np.array(index.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).toArrow().column(1).to_pylist())
    frames = spark.sparkContext.broadcast(_frames(common.dim, sample))
    # exact ranks: the place in a range partition, plus the rows of the partitions before it
    dealt = index.mapInArrow(_keys(frames), "o int, key long, cid long").repartitionByRange("o", "key", "cid").sortWithinPartitions("o", "key", "cid")
    placed = materialize(dealt.select("o", "cid", F.monotonically_increasing_id().alias("at"))).withColumn("part", F.shiftright("at", 33))
    before = W.Window.partitionBy("o").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    parts = materialize(placed.groupBy("o", "part").agg(F.count("*").alias("n"), F.min("at").alias("first")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).select("o", "part", "first", "ahead"))
    ranked = materialize(placed.join(sized(parts), ["o", "part"]).select("o", "cid", (F.col("at") - F.col("first") + F.col("ahead")).alias("rank")))
    asked = valid.where(queries).select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct().join(classes, ["h1", "h2"]).select("query_id", "cid")
    asked = materialize(asked)
    reach = max(k, int(WINDOW * total))
    block = lambda rank: F.floor(rank / BLOCK)
    wanted = asked.select("cid").distinct().join(index, "cid").join(ranked, "cid").select(F.col("cid").alias("qid"), "vec", "o", "rank", F.lit(reach).alias("reach"))
    visits = wanted.select("qid", "vec", "o", "rank", "reach", F.explode(F.sequence(block(F.greatest(F.col("rank") - reach, F.lit(0))), block(F.least(F.col("rank") + reach, F.lit(total - 1))))).alias("block"))
    shares = materialize(visits.groupBy("o", "block").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")))
    visits = visits.join(sized(shares), ["o", "block"]).withColumn("salt", F.pmod(F.xxhash64("qid"), F.col("shares")).cast("int")).drop("shares")
    rows = ranked.withColumn("block", block(F.col("rank"))).join(sized(shares), ["o", "block"]).join(index, "cid").select("o", "block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), "cid", "vec", "rank")
    visits, rows = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (visits, rows))
    key = ["o", "block", "salt"]
    found = visits.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(_best(k + 1), "qid long, cid long, score double")
    by_score = W.Window.partitionBy("qid").orderBy("score", "cid")
    top = found.distinct().withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k + 1).select(F.col("qid"), "cid", "score")
    top = materialize(top)
    ids = top.join(classes, "cid").select("qid", "score", "h1", "h2").join(members, ["h1", "h2"]).select("qid", "vec_id", "score")
    answers = asked.join(ids, asked.cid == ids.qid).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    final = W.Window.partitionBy("query_id").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")
