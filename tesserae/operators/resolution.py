"""Resolution of names to components: each way of finding one is an equi-join with a side that has one row for each key,
so no join fans out however often a name occurs; the first way that finds one wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by(symbols: DataFrame, keys: dict[str, str], found: str, id_: str = "symbol_id", ord_: str = "ord") -> DataFrame:
    """A row for each value of the keys (given name -> name it takes): the symbol that comes first."""
    named = [F.col(k).alias(v) for k, v in keys.items()]
    return symbols.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*named).agg(F.min_by(id_, F.struct(ord_, id_)).alias(found))


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls (..., caller, callee) to functions (func_id, component_id, name, file_path, class_name, ord), with `target` and `how`.

    A callee is a function's or component's id; else a bare name (a name, or the tail of a component id); else, if dotted,
    its tail is taken for the name. Of several of one name the first of the caller's file and class is taken, else the first
    of its file, else of its class, else the first. Null where nothing is found; an unknown caller has no file or class.
    """
    tail = F.substring_index("component_id", ".", -1)
    ids = functions.select(F.explode(F.array_distinct(F.array("func_id", "component_id"))).alias("callee"), "func_id", "ord").where("callee is not null")
    exact = ids.groupBy("callee").agg(F.max_by("func_id", F.struct("ord", "func_id")).alias("exact"))
    names = functions.select("func_id", "file_path", "class_name", "ord", F.explode(F.array_distinct(F.array("name", tail))).alias("bare")).where("bare is not null")
    callers = functions.select(F.col("func_id").alias("caller"), F.col("file_path").alias("from_file"), F.col("class_name").alias("from_class"))
    known = names.select(F.col("bare").alias("callee")).distinct().withColumn("is_name", F.lit(True))
    out = calls.join(exact, "callee", "left").join(known, "callee", "left").join(callers, "caller", "left")
    out = out.withColumn("bare", F.when(F.col("is_name"), F.col("callee")).when(F.col("callee").contains("."), F.substring_index("callee", ".", -1)))
    ways = {"file_and_class": {"bare": "bare", "file_path": "from_file", "class_name": "from_class"}, "file": {"bare": "bare", "file_path": "from_file"}, "class": {"bare": "bare", "class_name": "from_class"}, "first": {"bare": "bare"}}
    for way, keys in ways.items():
        out = out.join(first_by(names, keys, way, "func_id"), list(keys.values()), "left")
    tiers = ["exact", *ways]
    how = reduce(lambda c, t: c.when(F.col(t).isNotNull(), t), tiers[1:], F.when(F.col("exact").isNotNull(), "exact")).otherwise("unresolved")
    return out.select(*calls.columns, F.coalesce(*tiers).alias("target"), how.alias("how"))


def dependencies(relations: DataFrame, components: DataFrame) -> DataFrame:
    """(component_id, depends_on), distinct: relations (caller, callee) between components (component_id, file_path, name, ord).

    Ends are ids or `file:name` keys (of several components, the last); a callee may also be a bare name or the tail of an
    id, of which the first counts. Ends that are none of these are left out; a component may depend on itself.
    """
    legacy = F.concat_ws(":", "file_path", "name")
    keys = components.select(F.explode(F.array(F.struct(F.col("component_id").alias("key"), F.lit(0).alias("legacy")), F.struct(legacy.alias("key"), F.lit(1).alias("legacy")))).alias("k"), "component_id", "ord")
    ids = keys.groupBy("k.key").agg(F.max_by("component_id", F.struct("ord", "k.legacy")).alias("id"))
    names = components.select("component_id", "ord", F.explode(F.array_distinct(F.array("name", F.substring_index("component_id", ".", -1)))).alias("callee"))
    named = first_by(names, {"callee": "callee"}, "by_name", "component_id")
    ends = lambda col, to: ids.select(F.col("key").alias(col), F.col("id").alias(to))
    out = relations.select("caller", "callee").distinct().join(ends("caller", "component_id"), "caller").join(ends("callee", "by_id"), "callee", "left").join(named, "callee", "left")
    return out.select("component_id", F.coalesce("by_id", "by_name").alias("depends_on")).where("depends_on is not null").distinct()


def imported_names(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_path, name, symbol_id): what each name that a file imports stands for.

    imports (file_path, ord, resolved_path, imported_names array, alias), symbols (symbol_id, file_path, name, ord). An alias
    stands for the first imported name. The first import that finds a symbol wins, a direct name before an alias.
    """
    seen = imports.where("resolved_path is not null").select("file_path", "resolved_path", "ord", "alias", F.col("imported_names")[0].alias("first"), F.explode("imported_names").alias("name"))
    direct = seen.select("file_path", "resolved_path", "ord", F.lit(0).alias("kind"), "name", F.col("name").alias("original"))
    aliased = seen.where("alias is not null").select("file_path", "resolved_path", "ord", F.lit(1), "alias", "first").distinct()
    found = direct.union(aliased).join(first_by(symbols, {"file_path": "resolved_path", "name": "original"}, "symbol_id"), ["resolved_path", "original"])
    return found.groupBy("file_path", "name").agg(F.min_by("symbol_id", F.struct("ord", "kind", "symbol_id")).alias("symbol_id"))


def resolve_scoped(calls: DataFrame, symbols: DataFrame, imported: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """calls (..., file_path, parent, callee) by ways in the given order, with `target` and `how`.

    parent: a call through the own object, to a member of the same parent in the file, and to nothing else. For other calls
    (parent null): import (see imported_names), file (the first of the file), global (the first anywhere).
    symbols: (symbol_id, file_path, parent, name, ord).
    """
    ways = {
        "parent": (first_by(symbols, {"file_path": "file_path", "parent": "parent", "name": "callee"}, "parent_id"), ["file_path", "parent", "callee"]),
        "import": (imported.select("file_path", F.col("name").alias("callee"), F.col("symbol_id").alias("import_id")), ["file_path", "callee"]),
        "file": (first_by(symbols, {"file_path": "file_path", "name": "callee"}, "file_id"), ["file_path", "callee"]),
        "global": (first_by(symbols, {"name": "callee"}, "global_id"), ["callee"]),
    }
    out = calls
    for way in order:
        side, on = ways[way]
        out = out.join(side, on, "left")
    hit = lambda w: F.col(f"{w}_id") if w == "parent" else F.when(F.col("parent").isNull(), F.col(f"{w}_id"))
    how = reduce(lambda c, w: c.when(hit(w).isNotNull(), w), order[1:], F.when(hit(order[0]).isNotNull(), order[0])).otherwise("unresolved")
    return out.select(*calls.columns, F.coalesce(*map(hit, order)).alias("target"), how.alias("how"))


def symbol_components(symbols: DataFrame, components: DataFrame) -> DataFrame:
    """symbols (symbol_id, file_path, name) to components (component_id, file_path, name): the one of that file and name (of
    several the greatest id), else the only one of the file, else null."""
    exact = components.groupBy("file_path", "name").agg(F.max("component_id").alias("exact"))
    sole = components.groupBy("file_path").agg(F.min("component_id").alias("sole"), F.count("*").alias("n")).where("n = 1").drop("n")
    return symbols.join(exact, ["file_path", "name"], "left").join(sole, "file_path", "left").select("symbol_id", F.coalesce("exact", "sole").alias("component_id"))


#: Parts that the components of one base name are dealt to.
PARTS = 64


def sources_by_basename(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(component_id, depends_on), distinct: components that name source files (component_id, source) to those in files of that base name
    (component_id, file_path), but not to themselves.

    Each side has a component's base names once, and a pair that shares several comes from the least one, so the pairs themselves
    are not shuffled. Those of one base name are made by PARTS groups; their number is the result's, the product of both sides.
    """
    def side(df: DataFrame, to: str, path: str, several: str) -> DataFrame:
        names = df.groupBy(F.col("component_id").alias(to)).agg(F.collect_set(F.substring_index(path, "/", -1)).alias("bases"))
        return names.select(to, F.when(F.size("bases") > 1, F.col("bases")).alias(several), F.explode("bases").alias("b"))

    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asking = side(wanted, "component_id", "source", "x").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    held = side(files, "depends_on", "file_path", "y").withColumn("part", F.pmod(F.xxhash64("depends_on"), F.lit(PARTS)).cast("int"))
    pairs = asking.repartition(n, "b", "part").join(held.repartition(n, "b", "part").hint("merge"), ["b", "part"]).where("component_id <> depends_on")
    least = F.array_min(F.array_intersect("x", "y"))
    return pairs.where(F.col("x").isNull() | F.col("y").isNull() | (F.col("b") == least)).select("component_id", "depends_on")
