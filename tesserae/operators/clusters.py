"""Clusters of components: weighted graph, folder priors, contraction of cycles, communities, expansion.

Components of one file belong together, those of one folder more so; both are cliques and stay hubs (see modularity). An edge
between two files makes each component of the one depend on each of the other; these products stay a row for each pair of files,
whose strong components are those of the components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import matched, written
from .edges import MOST_WEIGHT, weighted_pairs
from .graph import strong_components
from .modularity import FEW, MOST_NODES, UNIT, communities

#: Weight of a pair in one folder and in one file, the fewest components of a cluster.
PRIOR, TOGETHER, LEAST_NODES = 2.0, 0.3, 3


def top_folder(path: str = "path"):
    """The first segment of a path; `_root` if it has just one."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise("_root")


def _resolved(edges: DataFrame, files: DataFrame) -> DataFrame:
    of = lambda c, p: matched(files.select(F.col("component_id").alias(c), F.col("path").alias(p)), c, edges)
    return edges.join(of("from_id", "src"), "from_id").join(of("to_id", "dst"), "to_id")


def file_pairs(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, n_edges, n_src, n_dst, n_pairs) for each ordered pair of files with a resolved edge: n_pairs directed pairs of
    unlike components stand behind it, each of src with each of dst. edges: (from_id, to_id); files: (component_id, path).
    """
    sizes = files.groupBy("path").agg(F.count_distinct("component_id").alias("n"))
    of = lambda p, n: sizes.select(F.col("path").alias(p), F.col("n").alias(n))
    pairs = _resolved(edges, files).groupBy("src", "dst").agg(F.count("*").alias("n_edges")).join(of("src", "n_src"), "src").join(of("dst", "n_dst"), "dst")
    same = F.when(F.col("src") == F.col("dst"), F.col("n_src")).otherwise(0)
    return pairs.select("src", "dst", "n_edges", "n_src", "n_dst", (F.col("n_src") * F.col("n_dst") - same).alias("n_pairs"))


def cycle_heads(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(component_id, head): components that reach one another by the pairs of file_pairs share the smallest of them as head."""
    pairs = written(file_pairs(edges, files).where("n_pairs > 0").select("src", "dst"))
    groups = strong_components(pairs.where("src <> dst")).select(F.col("node").alias("path"), F.col("component").alias("of"))
    alone = pairs.where("src = dst").select(F.col("src").alias("path"), F.lit(True).alias("own"))
    joined = files.select("component_id", "path").join(groups, "path", "left").join(alone, "path", "left")
    joined = written(joined.select("component_id", F.coalesce("of", F.when(F.col("own"), F.col("path"))).alias("of")))
    heads = joined.where("of is not null").groupBy("of").agg(F.min("component_id").alias("head"))
    return joined.join(heads, "of", "left").groupBy("component_id").agg(F.min(F.coalesce("head", "component_id")).alias("head"))


def _graph(edges: DataFrame, files: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v, w) of heads and hubs of files and folders. A pair in one file weighs 3.0 at most with what the file adds."""
    path = lambda c, p: files.select(F.col("component_id").alias(c), F.col("path").alias(p))
    head = lambda c, h: heads.select(F.col("component_id").alias(c), F.col("head").alias(h))
    pairs = weighted_pairs(edges).join(path("u", "pu"), "u").join(path("v", "pv"), "v")
    rest = F.when(F.col("pu") == F.col("pv"), F.least(F.col("w"), F.lit(MOST_WEIGHT - TOGETHER))).otherwise(F.col("w"))
    pairs = pairs.withColumn("w", rest).join(head("u", "a"), "u").join(head("v", "b"), "v").where("a <> b")
    pairs = pairs.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("w").alias("w"))
    held = written(files.join(heads, "component_id").groupBy(F.col("head").alias("node"), "path").agg(F.count("*").alias("m")).withColumn("folder", top_folder()))
    names = written(held.select(F.explode(F.array(F.struct(F.lit("file").alias("kind"), F.col("path").alias("name")), F.struct(F.lit("folder").alias("kind"), F.col("folder").alias("name")))).alias("x")).select("x.*").distinct().withColumn("hub", F.monotonically_increasing_id()))
    file = names.where("kind = 'file'").select(F.col("name").alias("path"), "hub")
    folder = names.where("kind = 'folder'").select(F.col("name").alias("folder"), F.col("hub").alias("up"))
    units = lambda w: F.lit(round(w * UNIT)).cast("long").alias("h")
    of_files = held.join(file, "path").join(folder, "folder").select("node", "hub", units(TOGETHER), "m", "up")
    of_folders = held.join(folder, "folder").select("node", F.col("up").alias("hub")).distinct().select("node", "hub", units(PRIOR), F.lit(1).cast("long").alias("m"), F.lit(None).cast("long").alias("up"))
    return written(pairs), written(of_files.unionByName(of_folders))


def merge_small(labels: DataFrame, links: DataFrame, hubs: DataFrame, least: int = LEAST_NODES) -> DataFrame:
    """(node, community): communities of fewer than `least` nodes join the larger one of their group with which they have most
    links, those of common files counted (ties: smallest); without links the largest (ties: smallest). Without a larger one they stay.

    labels: (node, community, g). Of the communities known by a file alone only the one with most of the file is asked.
    """
    labels = written(labels)
    sizes = written(labels.groupBy("community", "g").agg(F.count("*").alias("n")))
    large = sizes.where(F.col("n") >= least)
    small = labels.join(sizes.where(F.col("n") < least).select("community"), "community", "left_semi").select("node", F.col("community").alias("small"))
    of = labels.join(large.select("community"), "community", "left_semi").select("node", F.col("community").alias("to"))
    files = hubs.where(F.col("h") == round(TOGETHER * UNIT)).select("node", "hub", "m")
    near = written(links.join(small.withColumnRenamed("node", "u"), "u").join(of.withColumnRenamed("node", "v"), "v").select("u", "v", "small", "to"))
    twice = near.join(files.select(F.col("node").alias("u"), "hub"), "u").join(files.select(F.col("node").alias("v"), "hub"), ["v", "hub"]).select("u", "v").distinct()
    plain = near.join(twice, ["u", "v"], "left_anti").select("small", "to", F.lit(1).alias("n"))
    mine = written(files.join(small, "node").groupBy("small", "hub").agg(F.count("*").alias("mine")))
    held = written(files.join(of, "node").groupBy("hub", "to").agg(F.count("*").alias("held")))
    most = held.groupBy("hub").agg(F.max_by("to", F.struct("held", (-F.col("to")).alias("to"))).alias("to"))
    asked = near.select("small", "to").unionByName(mine.join(most, "hub").select("small", "to")).distinct()
    by_file = asked.join(mine, "small").join(held, ["hub", "to"]).select("small", "to", (F.col("mine") * F.col("held")).alias("n"))
    best = plain.unionByName(by_file).groupBy("small", "to").agg(F.sum("n").alias("n")).groupBy("small").agg(F.max_by("to", F.struct("n", (-F.col("to")).alias("to"))).alias("to"))
    first = large.groupBy("g").agg(F.max_by("community", F.struct("n", (-F.col("community")).alias("c"))).alias("first"))
    joined = labels.join(best, F.col("community") == F.col("small"), "left").join(sizes.select("community", "n"), "community").join(first, "g", "left")
    return joined.select("node", F.when(F.col("n") < least, F.coalesce("to", "first", "community")).otherwise(F.col("community")).alias("community"))


def partition(edges: DataFrame, files: DataFrame, most: int = MOST_NODES, few: int = FEW) -> DataFrame:
    """(component_id, cluster, size): every component of `files` (component_id long, path) once; a cluster is named by its smallest component.

    edges: (from_id, to_id, edge_type, confidence); unresolved ones and those of unknown components don't count. Weights,
    folder priors and files as in _graph, cycles contracted by cycle_heads; the result's modularity is at least that of the folders.
    A null path counts as empty; of a repeated component its smallest path counts. Fewer than three heads are one cluster.
    An empty table gives no rows. Sort by size (descending), cluster and component_id for the order in which clusters are shown.
    """
    files = written(files.where("component_id is not null").groupBy(F.col("component_id").cast("long").alias("component_id")).agg(F.coalesce(F.min("path"), F.lit("")).alias("path")))
    edges = edges.where("from_id is not null and to_id is not null")
    heads = written(cycle_heads(edges, files))
    nodes = written(heads.select(F.col("head").alias("node")).distinct())
    if nodes.count() < LEAST_NODES:
        labels = nodes.join(F.broadcast(nodes.agg(F.min("node").alias("community"))))  # one row
    else:
        pairs, hubs = _graph(edges, files, heads)
        folders = nodes.join(files.withColumnRenamed("component_id", "node"), "node").select("node", top_folder().alias("folder"))
        given = folders.join(folders.groupBy("folder").agg(F.min("node").alias("c")), "folder").select("node", "c")
        labels = communities(pairs, most=most, few=few, hubs=hubs, nodes=nodes, given=written(given), after=merge_small)
    found = written(heads.join(labels.withColumnRenamed("node", "head"), "head").select("component_id", "community"))
    named = found.groupBy("community").agg(F.min("component_id").alias("cluster"), F.count("*").alias("size"))
    return found.join(named, "community").select("component_id", "cluster", "size")
