"""Lookups, joins, aggregations and rankings over components (component_id, name, file_path, ...) and edges
(edge_type, from_id, to_id, to_unresolved, confidence, ev_file, ev_line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Weights of edges by type and confidence; other pairs weigh 0.2, a pair of components 3.0 at most.
WEIGHTS = {
    ("imports", "high"): 1.0, ("imports", "medium"): 1.0, ("imports", "low"): 0.7,
    ("extends", "high"): 1.0, ("extends", "medium"): 1.0, ("extends", "low"): 0.7,
    ("calls", "high"): 0.5, ("calls", "medium"): 0.3, ("calls", "low"): 0.2,
}
OTHER_WEIGHT, MOST_WEIGHT, COLOCATION = 0.2, 3.0, 0.3


def graph_stats(edges: DataFrame) -> DataFrame:
    """For each edge type its edges, the unresolved ones and their ratio; and a row `*` for all."""
    counts = edges.groupBy("edge_type").agg(F.count("*").alias("edges"), F.count("to_unresolved").alias("unresolved"))
    total = counts.agg(F.lit("*").alias("edge_type"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"), F.coalesce(F.sum("unresolved"), F.lit(0)).alias("unresolved"))
    return counts.unionByName(total).withColumn("ratio", F.round(F.coalesce(F.try_divide("unresolved", "edges"), F.lit(0.0)), 6))


def resolved(edges: DataFrame) -> DataFrame:
    return edges.where("to_id is not null")


def callers_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The resolved edges into the ids (component_id)."""
    return resolved(edges).join(ids.select(F.col("component_id").alias("to_id")), "to_id", "left_semi")


def callees_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("component_id").alias("from_id")), "from_id", "left_semi")


def incident(edges: DataFrame) -> DataFrame:
    """(component_id, from_id, to_id, edge_type, ev_file, ev_line): each component's edges both ways, the first of equal ones."""
    both = resolved(edges).select(F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("component_id"), "from_id", "to_id", "edge_type", "ev_file", "ev_line")
    return both.groupBy("component_id", "from_id", "to_id", "edge_type").agg(F.min(F.struct("ev_file", "ev_line")).alias("e")).select("component_id", "from_id", "to_id", "edge_type", "e.ev_file", "e.ev_line")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The resolved edges with both ends among the ids; repeated edges stay."""
    return callees_of(callers_of(edges, ids), ids)


def file_dependencies(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(file_path, depends_on): distinct pairs of files that resolved edges join."""
    ends = lambda side, to: components.select(F.col("component_id").alias(side), F.col("file_path").alias(to))
    return resolved(edges).join(ends("from_id", "file_path"), "from_id").join(ends("to_id", "depends_on"), "to_id").where("file_path <> depends_on").select("file_path", "depends_on").distinct()


def resolve_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """imports (file_path, resolved_path, imported_names array) against symbols (symbol_id, file_path, name, ord).

    The last symbol of a file and name wins; high confidence if one is found, else low with the name kept. Star imports and
    imports without a resolved path give nothing.
    """
    last = symbols.groupBy(F.col("file_path").alias("resolved_path"), F.col("name").alias("imported")).agg(F.max_by("symbol_id", "ord").alias("to_symbol"))
    wanted = imports.where("resolved_path is not null").select("file_path", "resolved_path", F.explode("imported_names").alias("imported")).where("imported <> '*'")
    out = wanted.join(last, ["resolved_path", "imported"], "left")
    return out.select("file_path", "resolved_path", "imported", "to_symbol", F.when(F.col("to_symbol").isNull(), F.col("imported")).alias("to_unresolved"), F.when(F.col("to_symbol").isNull(), "low").otherwise("high").alias("confidence"))


def resolve_by_priority(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls (call_id, file_path, callee) to the first symbol of that name in the same file, else the first anywhere."""
    local = symbols.groupBy("file_path", F.col("name").alias("callee")).agg(F.min_by("symbol_id", "ord").alias("local_id"))
    anywhere = symbols.groupBy(F.col("name").alias("callee")).agg(F.min_by("symbol_id", "ord").alias("global_id"))
    out = calls.join(local, ["file_path", "callee"], "left").join(anywhere, "callee", "left")
    return out.select("call_id", "file_path", "callee", F.coalesce("local_id", "global_id").alias("to_id"), F.when(F.col("local_id").isNotNull(), "same_file").when(F.col("global_id").isNotNull(), "global").otherwise("unresolved").alias("scope"))


def _blocks(first: Column, last: Column) -> Column:
    """The fewest blocks (level, at) that make up the lines from first to last: at * 2^level and on, 2^level lines each; two of a level at most."""
    bit = lambda x: x.bitwiseAND(F.lit(1)) == 1
    one = lambda level, at: F.array(F.struct(level.alias("level"), at.alias("at")))
    none = F.array().cast("array<struct<level: int, at: bigint>>")

    def more(x: Column, level: Column) -> Column:
        left, end, going = x["left"], x["end"], x["left"] < x["end"]
        found = F.concat(x["found"], F.when(going & bit(left), one(level, left)).otherwise(none), F.when(going & bit(end), one(level, end - 1)).otherwise(none))
        return F.struct(F.shiftright(left + left.bitwiseAND(F.lit(1)), 1).alias("left"), F.shiftright(end, 1).alias("end"), found.alias("found"))

    start = F.struct(first.alias("left"), (last + 1).alias("end"), none.alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(last - first + 1))), start, more)["found"]


def enclosing(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points (file, line) to the smallest range (file, symbol_id, first, last) around each; null if there is none. Lines are whole numbers.

    A range is cut into blocks of powers of two, of which each keeps the smallest of its ranges; a line looks at the one block of each
    level that it is in. So no line meets all ranges of its file, however many there are.
    """
    smallest = F.min(F.struct("size", "symbol_id")).alias("best")
    whole = ranges.where("file is not null and first <= last").groupBy("file", F.col("first").cast("long"), F.col("last").cast("long")).agg(F.min(F.struct("symbol_id"))["symbol_id"].alias("symbol_id"))
    cut = whole.select("file", (F.col("last") - F.col("first")).alias("size"), "symbol_id", F.explode(_blocks(F.col("first"), F.col("last"))).alias("x"))
    held = cut.groupBy("file", "x.level", "x.at").agg(smallest)
    levels = held.agg(F.collect_set("level").alias("levels"))  # one row
    asked = points.select("file", "line").where("file is not null and line is not null").distinct().crossJoin(F.broadcast(levels)).select("file", "line", F.explode("levels").alias("level"))
    hits = asked.withColumn("at", F.expr("shiftright(CAST(line AS BIGINT), level)")).join(held, ["file", "level", "at"])
    found = hits.groupBy("file", "line").agg(F.min("best")["symbol_id"].alias("symbol_id"))
    return points.join(found, ["file", "line"], "left")


def header_pairs(files: DataFrame) -> DataFrame:
    """files (path, stem, kind): for each stem its first header with its first source."""
    return files.groupBy("stem").agg(F.min(F.when(F.col("kind") == "header", F.col("path"))).alias("header"), F.min(F.when(F.col("kind") == "source", F.col("path"))).alias("source")).where("header is not null and source is not null")


def weight(edge_type: Column, confidence: Column) -> Column:
    pairs = [F.lit(x) for (t, c), w in WEIGHTS.items() for x in (f"{t}/{c}", w)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat_ws("/", edge_type, confidence)), F.lit(OTHER_WEIGHT))


def weighted_pairs(edges: DataFrame, a: str = "from_id", b: str = "to_id") -> DataFrame:
    """(u, v, w) with u < v: summed weights of the edges between two ends, 3.0 at most."""
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return ends.groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(F.round(F.least(F.sum(weight(F.col("edge_type"), F.col("confidence"))), F.lit(MOST_WEIGHT)), 6).alias("w"))


def boundary(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(module_id, side, from_id, to_id, edge_type): a module's resolved edges, inside, in or out; each once."""
    of = lambda c, m: members.select(F.col("component_id").alias(c), F.col("module_id").alias(m))
    both = resolved(edges).select("from_id", "to_id", "edge_type").distinct().join(of("from_id", "fm"), "from_id", "left").join(of("to_id", "tm"), "to_id", "left")
    sides = F.when(F.col("fm") == F.col("tm"), F.array(F.struct(F.col("fm").alias("module_id"), F.lit("inside").alias("side")))).otherwise(F.array(F.struct(F.col("fm").alias("module_id"), F.lit("out").alias("side")), F.struct(F.col("tm").alias("module_id"), F.lit("in").alias("side"))))
    return both.select(F.explode(sides).alias("found"), "from_id", "to_id", "edge_type").select("found.*", "from_id", "to_id", "edge_type").where("module_id is not null")


def module_report(edges: DataFrame, members: DataFrame) -> DataFrame:
    """For each module its edges inside, in and out, the share that stays inside, and the capped weight across its border."""
    of = lambda c, m: members.select(F.col("component_id").alias(c), F.col("module_id").alias(m))
    counts = boundary(edges, members).groupBy("module_id").agg(*[F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("inside", "in", "out")])
    between = weighted_pairs(resolved(edges).join(of("from_id", "fm"), "from_id").join(of("to_id", "tm"), "to_id"), "fm", "tm")
    border = between.select(F.explode(F.array("u", "v")).alias("module_id"), "w").groupBy("module_id").agg(F.round(F.sum("w"), 6).alias("border_weight"))
    out = counts.join(border, "module_id", "left").withColumn("border_weight", F.coalesce("border_weight", F.lit(0.0)))
    return out.withColumn("cohesion", F.round(F.col("n_inside") / (F.col("n_inside") + F.col("n_in") + F.col("n_out")), 6))


def top_per_group(df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def degrees(edges: DataFrame) -> DataFrame:
    """(component_id, degree): distinct undirected neighbours over resolved edges."""
    pairs = resolved(edges).where("from_id <> to_id").select(F.least("from_id", "to_id").alias("u"), F.greatest("from_id", "to_id").alias("v")).distinct()
    return pairs.select(F.explode(F.array("u", "v")).alias("component_id")).groupBy("component_id").agg(F.count("*").alias("degree"))


def most_connected(edges: DataFrame, n: int) -> DataFrame:
    """The n components of highest degree (ties: smaller id): a top-k report."""
    return degrees(edges).orderBy(F.desc("degree"), "component_id").limit(n)


def cards(components: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """(component_id, name, location, targets): a component with its first outgoing resolved edges."""
    out = resolved(edges).groupBy("from_id", "to_id", "edge_type").agg(F.min(F.struct("ev_file", "ev_line")).alias("e"))
    first = top_per_group(out, ["from_id"], ["e", "to_id", "edge_type"], most)
    lists = first.groupBy("from_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "edge_type", "to_id"))), lambda x: F.concat_ws(":", x["edge_type"], x["to_id"])), ",").alias("targets"))
    return components.join(lists, components.component_id == lists.from_id, "left").select("component_id", "name", F.concat_ws("#", "file_path", "name").alias("location"), F.coalesce("targets", F.lit("")).alias("targets"))


def dominant(df: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, ties to the smaller value."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    return top_per_group(counts, [group], [F.desc("n"), value], 1).drop("rank")


def within_budget(items: DataFrame, group: list[str], order: list, size: str, budget: int) -> DataFrame:
    """The leading items of each group while their running size stays within the budget: stops at the first overflow."""
    run = W.Window.partitionBy(*group).orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum(size).over(run)).where(F.col("used") <= budget)


def greedy_budget(items: DataFrame, group: list[str], rank: str, item: str, size: str, budget: int) -> DataFrame:
    """(group, taken): items in rank order, each taken if it still fits. A fold over the sorted items of a group."""
    lists = items.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(item).alias("i"), F.col(size).cast("long").alias("s")))).alias("l"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("got"))
    fold = F.aggregate("l", start, lambda a, x: F.when(a["used"] + x["s"] <= budget, F.struct((a["used"] + x["s"]).alias("used"), F.concat(a["got"], F.array(x["i"].cast("string"))).alias("got"))).otherwise(a))
    return lists.select(*group, fold.alias("f")).select(*group, F.array_join("f.got", ",").alias("taken"), F.col("f.used").alias("used"))


def dedup_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return top_per_group(df, key, order, 1).drop("rank")


def colocated(components: DataFrame) -> DataFrame:
    """(file_path, members, pairs, weight): the clique of a file as one star row; pairs are never spelled out."""
    n = F.count("*")
    return components.groupBy("file_path").agg(n.alias("members"), F.floor(n * (n - 1) / 2).alias("pairs")).withColumn("weight", F.round(F.col("pairs") * COLOCATION, 6))


def contract(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs (u, v, w) between the labels (node, label) of their ends; pairs inside a label go."""
    of = lambda c, to: labels.select(F.col("node").alias(c), F.col("label").alias(to))
    joined = pairs.join(of("u", "lu"), "u").join(of("v", "lv"), "v").where("lu <> lv")
    return joined.groupBy(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).agg(F.round(F.sum("w"), 6).alias("w"))


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Tokens and requests by model, and a row `*` for all."""
    return usage.rollup("model").agg(F.count("*").alias("requests"), F.sum(F.floor(F.col("chars") / 4)).alias("tokens")).withColumn("model", F.coalesce("model", F.lit("*")))
