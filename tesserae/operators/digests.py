"""Hashes of what artifacts are made from: each part and a zero character after it, in order, and hashes over trees of them.

A digest goes over the sorted parts of a key as a stream, so no key's parts are gathered: a key that holds a third of all rows
is long work for one task, but no more memory than another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written
from .trees import heights


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest, n = None, None, 0
    for batch in batches:
        keys, found = [], []
        for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest is None or k != key:
                if digest is not None:
                    keys.append(key)
                    found.append((digest.hexdigest(), n))
                key, digest, n = k, hashlib.sha256(), 0
            digest.update(part.encode() + b"\0")
            n += 1
        yield pa.record_batch([pa.array(keys, pa.string()), pa.array([h for h, _ in found], pa.string()), pa.array([c for _, c in found], pa.int64())], ["key", "hash", "parts"])
    if digest is not None:
        yield pa.record_batch([pa.array([key], pa.string()), pa.array([digest.hexdigest()], pa.string()), pa.array([n], pa.int64())], ["key", "hash", "parts"])


def ordered_hash(rows: DataFrame, order: list[str]) -> DataFrame:
    """(key, hash, parts): SHA-256 over the parts of each key (key string, part string) in an order, each followed by a zero character. Null parts count as empty."""
    named = rows.select(F.col("key").cast("string").alias("key"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), *[F.col(c).alias(f"_{c}") for c in order])
    dealt = named.where("key is not null").repartition("key").sortWithinPartitions("key", *[f"_{c}" for c in order])
    return dealt.select("key", "part").mapInArrow(_digested, "key string, hash string, parts long")


def module_inputs(modules: DataFrame, members: DataFrame, sources: DataFrame, tail: list[str]) -> DataFrame:
    """(module_id, hash): over title, path, the ids of the components in order, the SHA-256 of their sources in the same order
    (components without one have none), and what is common to all (file, language, settings, version: tail).

    modules: (module_id, title, path); members: (module_id, component_id); sources: (component_id, source_code).
    """
    ids = members.select("module_id", F.col("component_id").cast("string").alias("c")).distinct()
    coded = sources.select(F.col("component_id").cast("string").alias("c"), "source_code").where("source_code <> ''")
    parts = [
        modules.select(F.col("module_id").alias("key"), F.lit(0).alias("rank"), F.lit("").alias("c"), F.col("title").alias("part")),
        modules.select(F.col("module_id").alias("key"), F.lit(1).alias("rank"), F.lit("").alias("c"), F.col("path").alias("part")),
        ids.select(F.col("module_id").alias("key"), F.lit(2).alias("rank"), "c", F.col("c").alias("part")),
        ids.join(coded, "c").select(F.col("module_id").alias("key"), F.lit(3).alias("rank"), "c", F.sha2("source_code", 256).alias("part")),
        *[modules.select(F.col("module_id").alias("key"), F.lit(4 + i).alias("rank"), F.lit("").alias("c"), F.lit(x).alias("part")) for i, x in enumerate(tail)],
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return ordered_hash(every.join(modules.select(F.col("module_id").alias("key")).distinct(), "key", "left_semi"), ["rank", "c"]).select(F.col("key").alias("module_id"), "hash")


def tree_hashes(modules: DataFrame, own: DataFrame) -> DataFrame:
    """(module_id, hash): over a module's own hash and its children's, by their ids, so a change shows in all that stands above it and
    nowhere else. A job for each level. modules: (module_id, parent_id); own: (module_id, hash), empty where there is none.
    """
    order = written(heights(modules).join(modules.select("module_id", "parent_id").distinct(), "module_id").join(own.select("module_id", F.col("hash").alias("own")), "module_id", "left"))
    top = order.agg(F.max("level")).first()[0]
    done = None
    for level in range(0 if top is None else top + 1):
        now = order.where(F.col("level") == level)
        parts = now.select(F.col("module_id").alias("key"), F.lit("").alias("child"), F.coalesce("own", F.lit("")).alias("part"))
        if done is not None:
            kids = done.join(order.select("module_id", F.col("parent_id").alias("key")), "module_id").join(now.select(F.col("module_id").alias("key")), "key", "left_semi")
            parts = parts.unionByName(kids.select("key", F.col("module_id").alias("child"), F.col("hash").alias("part")))
        one = written(ordered_hash(parts, ["child"]).select(F.col("key").alias("module_id"), "hash"))
        done = one if done is None else done.unionByName(one)
    return done if done is not None else own.select("module_id", "hash").where("false")


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """(module_id): whose hash is new or differs."""
    return now.join(before, ["module_id", "hash"], "left_anti").select("module_id")


def guide_hash(files: DataFrame, wanted: DataFrame, extra: str = "") -> DataFrame:
    """(guide, hash): over the contents of the wanted files (guide, path) in order of path, the path itself where a file is missing, then extra."""
    found = wanted.distinct().join(files.select("path", "content"), "path", "left")
    parts = found.select(F.col("guide").alias("key"), F.lit(0).alias("rank"), F.col("path").alias("at"), F.coalesce("content", "path").alias("part"))
    last = wanted.select(F.col("guide").alias("key")).distinct().select("key", F.lit(1).alias("rank"), F.lit("").alias("at"), F.lit(extra).alias("part"))
    return ordered_hash(parts.unionByName(last), ["rank", "at"]).select(F.col("key").alias("guide"), "hash")


def content_hash(content):
    """MD5 of a file's text; empty for a missing one."""
    return F.coalesce(F.md5(content), F.lit(""))
