"""Written intermediates for iterative operators, which cut lineage and survive lost executors; tasks whose number grows with the input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of input files for each task of a spread step, those up to which a step is left to Spark, and those of a
#: table up to which Spark may broadcast it (in memory it takes some ten times as much, again in each join of a stage).
TASK_BYTES, WHOLE_BYTES, SMALL_BYTES = 8 << 20, 32 << 20, 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file:///tmp/tesserae-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/tesserae/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files that df's plan scans, as Spark has listed them, once for each scan; rows from elsewhere count nothing."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    every = [leaves.apply(i) for i in range(leaves.length())]
    return sum(int(str(x.stats().sizeInBytes())) for x in every if x.getClass().getSimpleName() == "LogicalRelation")


def tasks(*frames: DataFrame) -> int:
    """How many tasks a step over the frames' rows is spread over: one for each TASK_BYTES of their files, or as many as run at once."""
    return max(frames[0].sparkSession.sparkContext.defaultParallelism, -(-sum(map(file_bytes, frames)) // TASK_BYTES))


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key over its tasks, for a window by that key; small input stays as it is."""
    return df.repartition(tasks(df), key) if file_bytes(df) > WHOLE_BYTES else df


def shares(table: DataFrame, rows: DataFrame) -> int:
    """Over how many tasks a join of rows with table is dealt, growing with both; 0 for a small table, or one joined to little input: left to Spark."""
    if file_bytes(table) <= SMALL_BYTES or file_bytes(rows) <= WHOLE_BYTES:
        return 0
    own = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # Spark puts it in place of less; at its usual 200 every task writes 200 files
    return max(tasks(rows, table), own + 1)


def matched(table: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """The table as a side of an inner join of rows by key: dealt over tasks that grow with both, as Spark then deals the rows, its shares hashed.

    So no task holds the table whole, and rows pass by unsorted. A small table, or one joined to little input, stays as it is.
    """
    n = shares(table, rows)
    return table.repartition(n, key).hint("shuffle_hash") if n else table
