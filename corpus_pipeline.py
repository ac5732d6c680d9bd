"""A corpus pipeline: each stage applies one operator to what its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tesserae.llm import op01_ngram_join, op03_packing, op08_line_dedup, op09_quality, op10_secret_scans
from tesserae.llm.common import free_name, materialize, sized, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the robust outlier test reject."""
    return op09_quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of repeated three-line windows from text; n_chars follows it."""
    return op08_line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8 or more) keeps the document of the smallest id.

    Rows without doc_id take ids behind all others while groups are found. Of a repeated id the row of the smallest text stays.
    """
    kind, top = docs.schema["doc_id"].dataType, docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0]
    top = -1 if top is None else top
    unnamed = materialize(docs.where("doc_id is null").withColumn("doc_id", F.monotonically_increasing_id() + F.lit(top + 1)))
    every = docs.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long")).unionByName(unnamed)
    groups = op01_ngram_join.ngram_components(every, k=5, num=80, den=100)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    out = every.join(sized(materialize(kept)), "doc_id", "left_semi").select(docs.columns)
    repeated = materialize(every.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if not repeated.isEmpty():
        place = free_name(docs, "_place")
        first = F.row_number().over(W.Window.partitionBy("doc_id").orderBy("text"))
        once = out.join(sized(repeated), "doc_id", "left_semi").withColumn(place, first).where(F.col(place) == 1)
        out = out.join(sized(repeated), "doc_id", "left_anti").unionByName(once.select(out.columns))
    return out.withColumn("doc_id", F.when(F.col("doc_id") <= top, F.col("doc_id")).cast(kind)).select(docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the values of secrets in text; n_chars follows it."""
    return op10_secret_scans.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: a row for each piece of a document."""
    return op03_packing.pack(docs, op03_packing.vocabulary_files())


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", ngram_join), ("secret scans", secret_scans), ("best-fit packing", packing)]

#: The outlier test and the packing can't be put in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
