"""Helpers shared by the corpus operators: table access, written intermediates, size-checked joins and components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..runtime import shared_dir
from ..shipping import ship

#: A side of a join is broadcast only if its written size is proven to be below this many bytes.
BROADCAST_BYTES = 8 << 20
#: Up to this many edges, components are found by one task; beyond, in rounds over all tasks.
ONE_TASK = 200_000
#: Rows in an Arrow batch: bounds the memory of a Python worker over texts of any usual length.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Readies a session for Arrow code: ships the package, bounds the rows of a batch unless the session does so itself."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tesserae/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def written_bytes(df: DataFrame) -> int:
    fs, at = _fs(df.sparkSession, df._written)
    return fs.getContentSummary(at).getLength()


def drop(*frames: DataFrame) -> None:
    """Deletes written intermediates that nothing reads any more."""
    for df in frames:
        fs, at = _fs(df.sparkSession, df._written)
        fs.delete(at, True)


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """A name for a working column that df has not (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sized(df: DataFrame) -> DataFrame:
    """A written frame as the small side of a join: with a broadcast hint if its measured size allows, else as it is."""
    return F.broadcast(df) if written_bytes(df) <= BROADCAST_BYTES else df


def global_rank(df: DataFrame, by: list[str]) -> DataFrame:
    """df with `rank`, the place of each row from 0 in the order of the columns: its place in a range partition, plus the
    rows of the partitions before it. Ties fall either way. No task holds more than a range partition.
    """
    at = materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    before = W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    parts = at.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row for each partition
    ahead = materialize(parts.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_first", "_ahead"))
    return at.join(sized(ahead), "_part").withColumn("rank", F.col("_at") - F.col("_first") + F.col("_ahead")).drop("_at", "_part", "_first", "_ahead")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of the (u, v) edges of one partition; the smallest node of a component names it."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            x, y = top(u), top(v)
            parent[max(x, y)] = min(x, y)
    yield pa.record_batch([pa.array(list(parent), pa.int64()), pa.array([top(x) for x in parent], pa.int64())], ["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest id reachable, for every node with an edge. Alternating large and small stars.

    Up to ONE_TASK edges between long ids go through a union-find in one task instead, with the same result. Each round is two aggregations on node ids; a node with very many edges is pre-aggregated in every task and the
    join back is one that adaptive execution can split. Rounds grow with the logarithm of the longest path.
    Null ends and self-loops are dropped; no edges give no rows.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    now = materialize(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi.alias("u"), lo.alias("v")).distinct())

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = sign(now)
    if seen[0] <= ONE_TASK and {f.dataType.typeName() for f in now.schema} == {"long"}:
        return now.coalesce(1).mapInArrow(_united, "node long, component long")
    while seen[0]:
        files = 1 + seen[0] // 200_000  # stars never have more rows than the edges before; small ones need few tasks
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        least = materialize(least.coalesce(files))
        large = both.join(sized(least), F.col("u") == F.col("w")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.coalesce(files))
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w").coalesce(files))
        small = large.join(sized(low), F.col("u") == F.col("w")).select("u", "v", "m")
        after = materialize(small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct().coalesce(2 * files))
        drop(now, large, least, low)
        now, was, seen = after, seen, sign(after)
        if was == seen:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
