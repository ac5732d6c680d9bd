"""What a module's context pack and plan are made of: evidence, callers, link relevance, core components, budgets, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .edges import resolved

#: Path tokens that say nothing; files that show usage; most snippets, callers and characters of a snippet.
GENERIC_TOKENS = ("src", "lib", "app", "pkg", "code")
EXAMPLE_FILES = "(?i)test|example|demo|sample|bench"
MOST_EVIDENCE, MOST_CALLERS, MOST_SNIPPET = 20, 4, 1000
#: A component's file in the module, a component below a folder of it.
EXACT_FILE, SAME_FOLDER = 10, 6
TERMINAL = ("completed", "failed")


def _top(df: DataFrame, by: list, order: list, most: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def evidence(edges: DataFrame, members: DataFrame, most: int = MOST_EVIDENCE) -> DataFrame:
    """(module_id, ev_file, ev_line, edge_type): the first distinct places of edges that leave a module's components."""
    found = edges.join(members.select(F.col("component_id").alias("from_id"), "module_id"), "from_id").select("module_id", "ev_file", "ev_line", "edge_type").distinct()
    return _top(found, ["module_id"], ["ev_file", "ev_line", "edge_type"], most)


def usage_examples(edges: DataFrame, members: DataFrame, components: DataFrame, most: int = MOST_CALLERS, chars: int = MOST_SNIPPET) -> DataFrame:
    """(module_id, component_id, path, calls, snippet, truncated): components outside a module that depend on it.

    Those in files of tests and examples come first, then by path and id; calls lists what they use of the module. Components
    without source are left out. components: (component_id, path, source). The list is made for the chosen ones alone.
    """
    inside = members.select(F.col("component_id").alias("to_id"), "module_id")
    outer = members.select(F.col("component_id").alias("from_id"), F.col("module_id").alias("own"))
    uses = resolved(edges).select("from_id", "to_id").distinct().join(inside, "to_id").join(outer, "from_id", "left").where("own is null or own <> module_id").drop("own")
    callers = uses.select("module_id", F.col("from_id").alias("component_id")).distinct().join(components.where("source <> ''"), "component_id")
    chosen = _top(callers, ["module_id"], [~F.col("path").rlike(EXAMPLE_FILES), "path", "component_id"], most)
    calls = uses.withColumnRenamed("from_id", "component_id").join(chosen.select("module_id", "component_id"), ["module_id", "component_id"], "left_semi").groupBy("module_id", "component_id").agg(F.sort_array(F.collect_set("to_id")).alias("calls"))
    return chosen.join(calls, ["module_id", "component_id"]).select("module_id", "component_id", "path", "calls", F.substring("source", 1, chars).alias("snippet"), (F.length("source") > chars).alias("truncated"))


def dependency_sides(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(component_id, inner, outer): how many components of its own module a member depends on, and how many others."""
    of = lambda c, m: members.select(F.col("component_id").alias(c), F.col("module_id").alias(m))
    pairs = resolved(edges).select("from_id", "to_id").distinct().join(of("from_id", "fm"), "from_id").join(of("to_id", "tm"), "to_id", "left")
    same = F.coalesce(F.col("fm") == F.col("tm"), F.lit(False))
    return pairs.groupBy(F.col("from_id").alias("component_id")).agg(F.count_if(same).alias("inner"), F.count_if(~same).alias("outer"))


def call_lists(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(component_id, calls, called_by): sorted ids within the module, empty arrays for none."""
    of = lambda c, m: members.select(F.col("component_id").alias(c), F.col("module_id").alias(m))
    pairs = resolved(edges).select("from_id", "to_id").distinct().join(of("from_id", "fm"), "from_id").join(of("to_id", "tm"), "to_id").where("fm = tm")
    ways = pairs.select(F.explode(F.array(F.struct(F.col("from_id").alias("component_id"), F.col("to_id").alias("c"), F.lit(None).cast("long").alias("b")), F.struct(F.col("to_id").alias("component_id"), F.lit(None).cast("long").alias("c"), F.col("from_id").alias("b")))).alias("w")).select("w.*")
    return ways.groupBy("component_id").agg(F.sort_array(F.collect_list("c")).alias("calls"), F.sort_array(F.collect_list("b")).alias("called_by"))


def path_tokens(path: Column) -> Column:
    """The words of a path's parts without their extensions, lower case, but for generic ones."""
    parts = F.transform(F.split(F.translate(F.lower(path), "\\", "/"), "/"), lambda p: F.regexp_replace(p, r"(?<=[^.])\.[^.]*$", ""))
    words = F.flatten(F.transform(parts, lambda p: F.split(F.translate(p, "- ", "__"), "_")))
    return F.array_except(F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != ""), F.array(*map(F.lit, GENERIC_TOKENS)))


def link_relevance(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(module_id, key, score) above 0: entries (key, source_path) against the files (module_id, file_path) of modules.

    10 for a source among the files, 6 for one below a folder of them, 1 for each shared path token. Three equi-joins on
    path, folder and token in place of a join of all entries with all modules.
    """
    norm = lambda c: F.lower(F.translate(c, "\\", "/"))
    f = files.select("module_id", norm("file_path").alias("path")).where("path <> ''").distinct()
    e = entries.select("key", norm("source_path").alias("path"), norm("key").alias("name"))
    exact = e.join(f, "path").select("module_id", "key", F.lit(EXACT_FILE).alias("points")).distinct()
    folder = f.select("module_id", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).where("folder <> ''").distinct()
    parts = F.split("path", "/")
    above = e.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("folder"), "path").where("folder <> path")
    below = above.join(folder, "folder").select("module_id", "key", F.lit(SAME_FOLDER).alias("points")).distinct()
    mine = f.select("module_id", F.explode(path_tokens(F.col("path"))).alias("token")).distinct()
    theirs = e.select("key", F.explode(F.array_union(path_tokens(F.col("path")), path_tokens(F.col("name")))).alias("token")).distinct()
    shared = theirs.join(mine, "token").groupBy("module_id", "key").agg(F.count("*").cast("int").alias("points"))
    return exact.union(below).union(shared).groupBy("module_id", "key").agg(F.sum("points").alias("score"))


def core_components(edges: DataFrame, members: DataFrame, more_than: int = 500, least: int = 50) -> DataFrame:
    """(module_id, component_id, in_degree): in modules of more than so many components, the tenth (50 at least) that most others of
    the module depend on; ties to smaller ids."""
    of = lambda c, m: members.select(F.col("component_id").alias(c), F.col("module_id").alias(m))
    inside = resolved(edges).select("from_id", "to_id").distinct().join(of("from_id", "fm"), "from_id").join(of("to_id", "module_id"), "to_id").where("fm = module_id")
    degree = inside.groupBy("module_id", F.col("to_id").alias("component_id")).agg(F.count("*").alias("d"))
    size = members.groupBy("module_id").agg(F.count("*").alias("n")).where(F.col("n") > more_than)
    every = members.join(size, "module_id").join(degree, ["module_id", "component_id"], "left").withColumn("in_degree", F.coalesce("d", F.lit(0).cast("long")))
    ranked = every.withColumn("r", F.row_number().over(W.Window.partitionBy("module_id").orderBy(F.desc("in_degree"), "component_id")))
    return ranked.where(F.col("r") <= F.greatest(F.floor(F.col("n") / 10), F.lit(least))).select("module_id", "component_id", "in_degree")


def call_graph_summary(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: functions, languages, calls, unresolved calls and the share that is resolved (0 to 1; 0 without calls)."""
    one = functions.agg(F.count("*").alias("functions"), F.count_distinct("language").alias("languages"))
    two = edges.agg(F.count("*").alias("calls"), F.count_if(F.col("to_id").isNull()).alias("unresolved"))
    return one.crossJoin(two).withColumn("resolved_share", F.round(F.coalesce(F.try_divide(F.col("calls") - F.col("unresolved"), F.col("calls")), F.lit(0.0)), 6))


def usage_attribution(runs: DataFrame) -> DataFrame:
    """(model, runs, tokens): runs (run_id, model, tokens) of one model only count for it; all runs count for `*`."""
    whole = runs.groupBy("run_id").agg(F.min("model").alias("a"), F.max("model").alias("b"), F.sum("tokens").alias("tokens"))
    of = F.when(F.col("a") == F.col("b"), F.array(F.col("a"), F.lit("*"))).otherwise(F.array(F.lit("*")))
    return whole.select(F.explode(of).alias("model"), "tokens").groupBy("model").agg(F.count("*").alias("runs"), F.sum("tokens").alias("tokens"))


def cluster_targets(n: Column) -> dict[str, Column]:
    """Least and most clusters for n components, the hard least, and the most components of a cluster."""
    target = F.greatest(F.lit(1), F.bround(F.sqrt(n / 4), 0).cast("long"))
    hard = F.when(n >= 30, F.greatest(F.lit(6), F.floor(target / 2))).otherwise(1)
    return {"target_min": F.greatest(hard, target), "target_max": target * 2, "hard_min": hard, "max_size": F.greatest(F.lit(30), F.floor(n / target * 1.5))}


def cluster_issues(members: DataFrame) -> DataFrame:
    """(tree, clusters, components, largest, too_few, too_large) of members (tree, module_id, component_id)."""
    sizes = members.groupBy("tree", "module_id").agg(F.count("*").alias("size")).groupBy("tree").agg(F.count("*").alias("clusters"), F.sum("size").alias("components"), F.max("size").alias("largest"))
    t = cluster_targets(F.col("components"))
    return sizes.withColumn("too_few", (F.col("clusters") < t["hard_min"]) & (F.col("components") >= 30)).withColumn("too_large", F.col("largest") > t["max_size"])


def split_candidates(modules: DataFrame, members: DataFrame, max_depth: int, least: int, least_files: int) -> DataFrame:
    """The modules (module_id, depth) above max_depth with enough components (component_id, file_path) in enough files."""
    enough = members.groupBy("module_id").agg(F.count("*").alias("components"), F.count_distinct(F.when(F.col("file_path") != "", F.col("file_path"))).alias("files"))
    return modules.where(F.col("depth") < max_depth).join(enough, "module_id").where((F.col("components") >= least) & (F.col("files") >= least_files)).withColumn("is_complex", F.col("files") > 1)


def cross_child(edges: DataFrame, children: DataFrame) -> DataFrame:
    """(component_id, inbound, outbound, external, cross): edges within a parent and out of it; cross marks components with an
    edge to or from another child of the parent. children: (component_id, child_id, parent_id)."""
    side = lambda s, p: children.select(*(F.col(c).alias(f"{p}_{c}") for c in ("component_id", "child_id", "parent_id"))).withColumnRenamed(f"{p}_component_id", s)
    pairs = resolved(edges).select("from_id", "to_id").distinct().join(side("from_id", "f"), "from_id").join(side("to_id", "t"), "to_id", "left")
    within = F.coalesce(F.col("f_parent_id") == F.col("t_parent_id"), F.lit(False))
    crosses = within & (F.col("f_child_id") != F.col("t_child_id"))
    row = lambda c, i, o, x, z: F.struct(F.col(c).alias("component_id"), i.cast("long").alias("i"), o.cast("long").alias("o"), x.cast("long").alias("x"), z.alias("z"))
    none = F.lit(0)
    out = pairs.select(F.explode(F.when(within, F.array(row("from_id", none, F.lit(1), none, crosses), row("to_id", F.lit(1), none, none, crosses))).otherwise(F.array(row("from_id", none, none, F.lit(1), F.lit(False))))).alias("r")).select("r.*")
    return out.groupBy("component_id").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"), F.sum("x").alias("external"), F.bool_or("z").alias("cross"))


def user_modified(files: DataFrame, stamps: DataFrame, slack: float = 1.0) -> DataFrame:
    """The files (path, mtime) without a stamp (path, stamp) or changed more than so many seconds from it."""
    return files.join(stamps, "path", "left").where(F.col("stamp").isNull() | (F.abs(F.col("mtime") - F.col("stamp")) > slack)).select(*files.columns)


def orphans(files: DataFrame, owned: DataFrame) -> DataFrame:
    """The files (path) that no artifact owns (path)."""
    return files.join(owned.select("path"), "path", "left_anti")


def output_collisions(tasks: DataFrame) -> DataFrame:
    """(output_file, artifacts): files that more than one artifact (artifact_id, output_file) would write."""
    return tasks.groupBy("output_file").agg(F.count_distinct("artifact_id").alias("artifacts")).where("artifacts > 1")


def expired_jobs(jobs: DataFrame, now: Column, hours: int) -> DataFrame:
    """The jobs (status, ts) that ended more than so many hours ago; jobs still running never expire."""
    return jobs.where(F.col("status").isin(*TERMINAL) & (F.unix_timestamp(now) - F.unix_timestamp("ts") > hours * 3600))
