"""Module trees as flat rows: modules (module_id, parent_id, title, depth) and members (module_id, component_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import module_id as hashed
from ..runtime import written


def _jumps(modules: DataFrame, path: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Pointers to ancestors 1, 2, 4, ... levels up until all have reached an end, by doubling.

    The last (module_id, up, steps, path): up is null where the way ends, at the root's children or at a missing parent; steps and
    path are what lies on the way. Who still has an ancestor when more steps are made than there are modules is on a cycle or
    below one. The list holds all rounds. Repeated rows of a module count once.
    """
    titles = F.col("title") if path else F.lit(None).cast("string")
    known = modules.select(F.col("module_id").alias("up"), F.lit(True).alias("known")).distinct()
    first = modules.groupBy("module_id").agg(F.min(F.struct("parent_id", titles.alias("title"))).alias("m")).select("module_id", F.col("m.parent_id").alias("up"), F.col("m.title").alias("path"))
    now = first.join(known, "up", "left").select("module_id", F.when(F.col("known"), F.col("up")).alias("up"), F.when(F.col("known").isNull(), F.col("up")).alias("end"), F.lit(1).cast("long").alias("steps"), "path")
    now, rounds = written(now), []
    n = now.count()
    while True:
        rounds.append(now)
        if (1 << len(rounds)) > 2 * n or now.where("up is not null").isEmpty():
            return now, rounds
        above = now.select(F.col("module_id").alias("up"), F.col("up").alias("far"), F.col("end").alias("far_end"), F.col("steps").alias("far_steps"), F.col("path").alias("far_path"))
        joined = now.join(above, "up", "left")
        whole = F.when(F.col("far_path").isNotNull(), F.concat_ws("/", "far_path", "path")).otherwise(F.col("path")) if path else F.col("path")
        now = written(joined.select("module_id", F.col("far").alias("up"), F.coalesce("end", "far_end").alias("end"), (F.col("steps") + F.coalesce("far_steps", F.lit(0))).alias("steps"), whole.alias("path")))


def depths(modules: DataFrame, root: str = "root") -> DataFrame:
    """(module_id, depth): 1 for the root's children; nodes that the root doesn't reach drop out. Rounds grow with the logarithm of the depth."""
    last, _ = _jumps(modules, path=False)
    return last.where((F.col("end") == root) & F.col("up").isNull()).select("module_id", F.col("steps").cast("int").alias("depth"))


def paths(modules: DataFrame, root: str = "root") -> DataFrame:
    """(module_id, depth, path): titles from the root down; nodes that the root doesn't reach drop out. By doubling, as depths."""
    last, _ = _jumps(modules, path=True)
    return last.where((F.col("end") == root) & F.col("up").isNull()).select("module_id", F.col("steps").cast("int").alias("depth"), "path")


def ancestor_cycles(modules: DataFrame) -> DataFrame:
    """(module_id): modules that are their own ancestors. After as many steps as there are modules every pointer that is left
    stands on a cycle, and each of a cycle is stood on.
    """
    last, _ = _jumps(modules, path=False)
    return last.where("up is not null").select(F.col("up").alias("module_id")).distinct()


def heights(modules: DataFrame) -> DataFrame:
    """(module_id, level): 0 for leaves, else one more than the highest child: the order in which work can go on. What is on a
    cycle or above one drops out; so does what is below.

    The highest within 2^(k+1) levels below a node is the highest within 2^k, or 2^k and that of a node 2^k levels below.
    """
    last, rounds = _jumps(modules, path=False)
    good = last.where("up is null").select("module_id")
    level = good.withColumn("level", F.lit(0))
    for k, jump in enumerate(rounds):
        below = jump.where("up is not null").join(level, "module_id").groupBy(F.col("up").alias("module_id")).agg((F.max("level") + (1 << k)).alias("below"))
        level = written(level.join(below, "module_id", "left").select("module_id", F.greatest("level", F.coalesce("below", F.lit(0))).cast("int").alias("level")))
    return level


def violations(modules: DataFrame, members: DataFrame, components: DataFrame) -> DataFrame:
    """(kind, item): components in two modules or in none, ids and sibling titles that come twice, modules that are their own ancestors, missing parents."""
    twice = lambda df, c: df.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").select(F.col(c).cast("string").alias("item"))
    parts = {
        "duplicate_component": twice(members.select("module_id", "component_id").distinct(), "component_id"),
        "unassigned_component": components.join(members, "component_id", "left_anti").select(F.col("component_id").cast("string").alias("item")),
        "duplicate_module": twice(modules, "module_id"),
        "duplicate_path": twice(modules.select(F.concat_ws("/", "parent_id", "title").alias("path")), "path"),
        "ancestor_cycle": ancestor_cycles(modules).select(F.col("module_id").cast("string").alias("item")),
        "missing_parent": modules.where("parent_id <> 'root'").join(modules.select(F.col("module_id").alias("parent_id")), "parent_id", "left_anti").select(F.col("module_id").alias("item")),
    }
    out = None
    for kind, df in parts.items():
        one = df.select(F.lit(kind).alias("kind"), "item")
        out = one if out is None else out.unionByName(one)
    return out


def member_hashes(members: DataFrame) -> DataFrame:
    """(module_id, members, member_hash): the content-based id of each module."""
    return members.select("module_id", F.col("component_id").cast("string").alias("c")).distinct().groupBy("module_id").agg(F.count("*").alias("members"), hashed(F.collect_list("c")).alias("member_hash"))


def tasks(modules: DataFrame) -> DataFrame:
    """(doc_id, kind, n_deps, deps): a task for each module, which waits for its children, and the overview."""
    kids = modules.groupBy(F.col("parent_id").alias("module_id")).agg(F.count("*").alias("n_deps"), F.array_join(F.array_sort(F.collect_list("module_id")), ",").alias("deps"))
    own = modules.select("module_id").join(kids, "module_id", "left")
    top = kids.where("module_id = 'root'")
    rest = [F.coalesce("n_deps", F.lit(0)).alias("n_deps"), F.coalesce("deps", F.lit("")).alias("deps")]
    each = own.select(F.concat(F.lit("module:"), "module_id").alias("doc_id"), F.when(F.col("n_deps").isNull(), "leaf").otherwise("parent").alias("kind"), *rest)
    return each.unionByName(top.select(F.lit("overview").alias("doc_id"), F.lit("overview").alias("kind"), *rest))


def unique_names(df: DataFrame, name: str, order: list, sep: str = "-") -> DataFrame:
    """df with `unique_name`: the first of equal names as it is, later ones with -1, -2 and so on."""
    n = F.row_number().over(W.Window.partitionBy(name).orderBy(*order)) - 1
    return df.withColumn("_n", n).withColumn("unique_name", F.when(F.col("_n") > 0, F.concat_ws(sep, name, F.col("_n").cast("string"))).otherwise(F.col(name))).drop("_n")


def free_names(df: DataFrame, name: str, order: list, sep: str = "-", first: int = 1) -> DataFrame:
    """df with `free_name`: the first of equal names as it is, later ones with the smallest numbers, from `first`, that make a name
    no other row has.

    A name with a number belongs to one base only, so just the given names stand in the way: of base x those that are x, sep and
    a number. The i-th free number is i and as many taken ones t as have fewer than i free ones before them: a running
    count over both, in place of trial after trial.
    """
    n = F.row_number().over(W.Window.partitionBy(name).orderBy(*order)) - 1
    rows = written(df.withColumn("_n", n))
    mark = rf"(?s)\A(.*){_quoted(sep)}(0|[1-9][0-9]{{0,9}})\z"
    given = rows.select(F.regexp_extract(name, mark, 1).alias("base"), F.regexp_extract(name, mark, 2).alias("t")).where("t <> ''").distinct()
    given = given.withColumn("t", F.col("t").cast("long")).where(F.col("t") >= first)
    given = given.withColumn("v", F.col("t") - first - F.row_number().over(W.Window.partitionBy("base").orderBy("t")) + 1)  # free ones before it
    asked = rows.where("_n > 0").select(F.col(name).alias("base"), F.col("_n").cast("long").alias("i"))
    both = asked.select("base", (F.col("i") - 1).alias("v"), "i", F.lit(0).alias("taken")).unionByName(given.select("base", "v", F.lit(None).cast("long").alias("i"), F.lit(1).alias("taken")))
    ahead = F.sum("taken").over(W.Window.partitionBy("base").orderBy("v", F.desc("taken")).rowsBetween(W.Window.unboundedPreceding, 0))
    numbers = both.withColumn("ahead", ahead).where("i is not null").select(F.col("base").alias(name), F.col("i").alias("_n"), (F.col("i") - 1 + first + F.col("ahead")).alias("_free"))
    out = rows.join(numbers, [name, "_n"], "left")
    return out.withColumn("free_name", F.when(F.col("_free").isNotNull(), F.concat(name, F.lit(sep), F.col("_free").cast("string"))).otherwise(F.col(name))).select(*df.columns, "free_name")


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def invalidation_plan(modules: DataFrame, ratios: DataFrame, triggers: DataFrame, leaf: float = 0.3, parent: float = 0.3) -> DataFrame:
    """(module_id, level, reason): modules to do again, bottom up. ratios (set_id, ratio) of the leaves; a parent goes if a
    hard trigger hits it or enough of its children go."""
    order = written(heights(modules).join(modules.select("module_id", "parent_id"), "module_id"))
    top = order.agg(F.max("level")).first()[0] or 0
    hit = triggers.select(F.col("parent_id").alias("module_id")).distinct().withColumn("hard", F.lit(True))
    out = written(order.where("level = 0").join(ratios.select(F.col("set_id").alias("module_id"), "ratio"), "module_id").where(F.col("ratio") >= leaf).select("module_id", "level", F.lit("leaf_ratio").alias("reason"), "parent_id"))
    for level in range(1, top + 1):
        kids = modules.groupBy(F.col("parent_id").alias("module_id")).agg(F.count("*").alias("kids"))
        gone = out.groupBy(F.col("parent_id").alias("module_id")).agg(F.count("*").alias("gone"))
        now = order.where(F.col("level") == level).join(kids, "module_id").join(gone, "module_id", "left").join(hit, "module_id", "left")
        reason = F.when(F.col("hard"), "hard_trigger").when(F.coalesce("gone", F.lit(0)) / F.col("kids") >= parent, "child_ratio")
        out = written(out.unionByName(now.withColumn("reason", reason).where("reason is not null").select("module_id", "level", "reason", "parent_id")))
    return out.drop("parent_id")
