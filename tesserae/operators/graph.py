"""Iterative graph operators over digraphs (src, dst): each round is joins on written intermediates."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.types import IntegerType, LongType

from ..runtime import written
from ..shipping import ship


#: Written rounds that a loop keeps side by side before it merges them.
ROUNDS_APART = 16


def _with(parts: list[DataFrame], new: DataFrame) -> list[DataFrame]:
    """Rounds so far and a new one; merged now and then, so that neither plans nor rewrites grow with every round."""
    parts = [*parts, new]
    return parts if len(parts) <= ROUNDS_APART else [written(_all(parts))]


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, distance): what each seed (node) reaches along edges, itself at 0. A frontier loop with an anti-join."""
    frontier = written(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("distance")).distinct())
    steps, seen, depth = written(edges.select(F.col("src").alias("node"), "dst").distinct()), [frontier], 0
    while not frontier.isEmpty():
        depth += 1
        new = frontier.join(steps, "node").select("seed", F.col("dst").alias("node")).distinct().join(_all(seen), ["seed", "node"], "left_anti")
        frontier = written(new.withColumn("distance", F.lit(depth)))
        seen = _with(seen, frontier)
    return _all(seen)


def affected(deps: DataFrame, changed: DataFrame) -> DataFrame:
    """(node, distance): everything that depends on a changed node (node), with its least distance. deps: src depends on dst."""
    frontier = written(changed.select("node").distinct().withColumn("distance", F.lit(0)))
    back, seen, depth = written(deps.select(F.col("dst").alias("node"), "src").distinct()), [frontier], 0
    while not frontier.isEmpty():
        depth += 1
        frontier = written(frontier.join(back, "node").select(F.col("src").alias("node")).distinct().join(_all(seen), "node", "left_anti").withColumn("distance", F.lit(depth)))
        seen = _with(seen, frontier)
    return _all(seen)


def _levels_of_few(batches):
    """(node, level) of all edges (src, dst) of one task: nodes leave in waves once all they depend on have left."""
    tables = [pa.Table.from_batches([b]) for b in batches]
    if not tables:
        return
    edges = pa.concat_tables(tables)
    src, dst = edges.column("src").to_numpy(), edges.column("dst").to_numpy()
    nodes, place = np.unique(np.concatenate([src, dst]), return_inverse=True)
    src, dst = place[: len(src)], place[len(src) :]
    by_dst = np.argsort(dst, kind="stable")
    users, starts = src[by_dst], np.searchsorted(dst[by_dst], np.arange(len(nodes) + 1))
    waits, level = np.bincount(src, minlength=len(nodes)), np.full(len(nodes), -1)
    free, depth = np.flatnonzero(waits == 0), 0
    while len(free):
        level[free] = depth
        counts = starts[free + 1] - starts[free]
        ends = np.cumsum(counts)
        told = users[np.repeat(starts[free] - ends + counts, counts) + np.arange(counts.sum())]
        np.subtract.at(waits, told, 1)
        told = np.unique(told)
        free, depth = told[waits[told] == 0], depth + 1
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(level, pa.int32(), mask=level < 0)], ["node", "level"])


#: Edges that one task solves alone: 16 bytes each, some 200 MB with their orders.
FEW_EDGES = 2_000_000


def topological_levels(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, level): src depends on dst; level 0 has no dependency, others one more than their deepest. Nodes on or
    behind a cycle get no level (null).

    Rounds over all tasks cut one level after another until no more than `few` edges are left; one task levels those,
    however deep they go. Nodes are whole numbers there; others, and few = 0, stay with the rounds. A round reads the edges
    and tells those that depend on the last level; only nodes, with how many others they wait for, are written again, and
    edges each time half of them are gone.
    """
    edges = written(edges.select("src", "dst").distinct())
    whole = all(isinstance(f.dataType, (LongType, IntegerType)) for f in edges.schema)
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("n")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("n")))).alias("x"))
    waits = written(ends.groupBy("x.node").agg(F.sum("x.n").alias("n")))
    done, level = [], 0
    held = left = edges.count()
    while not (whole and left <= few):
        free = written(waits.where("n = 0").select("node", F.lit(level).alias("level")))
        if free.isEmpty():
            break
        done = _with(done, free)
        told = edges.join(free.select(F.col("node").alias("dst")), "dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"))
        waits = written(waits.where("n > 0").join(told, "node", "left").select("node", (F.col("n") - F.coalesce("d", F.lit(0))).alias("n")))
        left = waits.agg(F.sum("n")).first()[0] or 0
        if 2 * left < held:
            edges, held = written(edges.join(waits.select(F.col("node").alias("dst")), "dst", "left_semi")), left
        level += 1
    else:
        kind = edges.schema["src"].dataType.simpleString()
        ship(edges.sparkSession)
        deep = edges.join(waits.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").cast("long"), F.col("dst").cast("long"))
        deep = deep.coalesce(1).mapInArrow(_levels_of_few, "node long, level int")
        # a node that is left without edges depends on none of those left
        rest = waits.join(deep.select(F.col("node").cast(kind), (F.col("level") + level).alias("level"), F.lit(True).alias("deep")), "node", "left")
        rest = written(rest.select("node", F.when(F.col("deep"), F.col("level")).otherwise(level).alias("level")))
        return _all([*done, rest])
    return _all([*done, waits.select("node", F.lit(None).cast("int").alias("level"))])


def _trim(edges: DataFrame, few: int = 0) -> DataFrame:
    """Edges without those at nodes that have no way in or no way out, until none is left to cut or no more than `few` are left."""
    n = edges.count()
    while n > few:
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        kept = written(kept)
        m = kept.count()
        if m == n:
            return kept
        edges, n = kept, m
    return edges


#: Edges up to which strong components are found by one task.
FEW_ROUNDS = 100_000


def _strong_of_few(batches):
    """(node, component, size) of all edges (src, dst) of one task: depth first, with the lowest number that each node reaches."""
    out, schema = {}, None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out.setdefault(a, []).append(b)
            out.setdefault(b, [])
    if not out:
        return
    number, low, stack, held, found = {}, {}, [], set(), []
    for root in out:
        work = [(root, iter(()))] if root not in number else []
        while work:
            node, rest = work[-1]
            if node not in number:
                number[node] = low[node] = len(number)
                stack.append(node)
                held.add(node)
                work[-1] = node, rest = node, iter(out[node])
            for other in rest:
                if other not in number:
                    work.append((other, iter(())))
                    break
                if other in held:
                    low[node] = min(low[node], number[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    members = [stack.pop()]
                    while members[-1] != node:
                        members.append(stack.pop())
                    held.difference_update(members)
                    if len(members) > 1:
                        found.append(members)
    kind = schema.field(0).type
    rows = [(x, min(m), len(m)) for m in found for x in m]
    yield pa.record_batch([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], ["node", "component", "size"])


def _least_reaching(edges: DataFrame) -> DataFrame:
    """(node, c): the smallest node that reaches each node of the edges, itself included."""
    colour = written(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("c", F.col("node")))
    while True:
        came = edges.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
        new = written(colour.join(came, "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") < F.col("c")).alias("moved")))
        colour = new.drop("moved")
        if new.where("moved").isEmpty():
            return colour


def strong_components(edges: DataFrame, few: int = FEW_ROUNDS) -> DataFrame:
    """(node, component, size) of the strongly connected components of two nodes or more, named by their smallest node.

    Up to `few` edges are solved by one task, more in rounds over all tasks until no more than that are left, with the same result.

    Forward-backward colouring: after cutting what can lie on no cycle, every node takes the smallest node that reaches
    it, then the smallest of its colour that it reaches. Where both are one node, that is its component; others have both in common
    with their component, so edges between unlike nodes are cut, and the next round has all parts at once.
    """
    found = None
    edges = _trim(written(edges.where("src <> dst").select("src", "dst").distinct()), few)
    of = lambda colour, at, c: colour.select(F.col("node").alias(at), F.col("c").alias(c))
    alike = lambda e, colour: e.join(of(colour, "src", "c1"), "src").join(of(colour, "dst", "c2"), "dst").where("c1 = c2")
    while not edges.isEmpty():
        if edges.count() <= few:
            kind = edges.schema["src"].dataType.simpleString()
            ship(edges.sparkSession)
            got = written(edges.coalesce(1).mapInArrow(_strong_of_few, f"node {kind}, component {kind}, size long"))
            return got if found is None else found.unionByName(got)
        forth = _least_reaching(edges)
        inside = written(alike(edges, forth).select("src", "dst"))
        back = _least_reaching(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        members = forth.join(back.withColumnRenamed("c", "b"), "node").where("c = b").select("node", F.col("c").alias("component"))
        sizes = members.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
        got = written(members.join(sizes, "component").select("node", "component", "size"))
        found = got if found is None else found.unionByName(got)
        rest = alike(inside, back).select("src", "dst")  # a component lies in one colour of each kind
        rest = rest.join(got.select(F.col("node").alias("src")), "src", "left_anti")
        edges = _trim(written(rest), few)
    return found if found is not None else edges.select(F.col("src").alias("node"), F.col("src").alias("component"), F.lit(1).cast("long").alias("size"))


def modularity(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the modularity of a labelling (node, community)."""
    of = lambda c, to: labels.select(F.col("node").alias(c), F.col("community").alias(to))
    joined = pairs.join(of("u", "cu"), "u").join(of("v", "cv"), "v")
    degree = joined.select(F.explode(F.array("cu", "cv")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("d"))
    total = joined.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"))
    return total.crossJoin(degree.agg(F.sum(F.col("d") * F.col("d")).alias("q"))).select((F.col("inside") / F.col("m") - F.col("q") / (4 * F.col("m") * F.col("m"))).alias("modularity"))  # one row each


def merge_tiny(labels: DataFrame, pairs: DataFrame, least: int = 3) -> DataFrame:
    """(node, community): communities of fewer than `least` nodes join the one with most links to them (ties: smallest),
    large ones first; those without links stay."""
    sizes = labels.groupBy("community").agg(F.count("*").alias("size"))
    of = lambda c, to: labels.select(F.col("node").alias(c), F.col("community").alias(to))
    links = pairs.join(of("u", "cu"), "u").join(of("v", "cv"), "v").where("cu <> cv")
    both = links.select(F.col("cu").alias("community"), F.col("cv").alias("other")).unionByName(links.select(F.col("cv").alias("community"), F.col("cu").alias("other")))
    large = sizes.where(F.col("size") >= least).select(F.col("community").alias("other"))
    counts = both.join(sizes.where(F.col("size") < least), "community").join(large, "other").groupBy("community", "other").agg(F.count("*").alias("n"))
    best = counts.withColumn("r", F.row_number().over(W.Window.partitionBy("community").orderBy(F.desc("n"), "other"))).where("r = 1").select("community", "other")
    return labels.join(best, "community", "left").select("node", F.coalesce("other", "community").alias("community"))
