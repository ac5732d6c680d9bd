"""Selections, healing, identity reuse, scheduling outcomes and exports around the component graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..runtime import written
from .graph import affected

#: Word patterns of memory handling.
OWNERSHIP = {"allocates": r"\b(new|malloc|calloc|realloc)\b", "frees": r"\b(delete|free)\b", "moves": r"\bstd::move\b", "smart": r"\b(unique_ptr|shared_ptr|weak_ptr|make_unique|make_shared)\b"}
#: Names of files that a program starts from.
ENTRY_FILES = ["main.py", "app.py", "__main__.py", "cli.py", "server.py", "index.js", "index.ts", "main.js", "main.ts", "main.go", "main.rs", "main.c", "main.cpp", "Main.java", "Program.cs", "index.php"]


def ownership(components: DataFrame) -> DataFrame:
    """(component_id, a flag for each pattern, leak_risk) of the components (component_id, source) with any flag set."""
    flags = components.select("component_id", *[F.coalesce(F.col("source").rlike(p), F.lit(False)).alias(k) for k, p in OWNERSHIP.items()])
    return flags.where(F.greatest(*[F.col(k).cast("int") for k in OWNERSHIP]) == 1).withColumn("leak_risk", F.col("allocates") & ~F.col("frees") & ~F.col("smart"))


def is_entry_point(path: Column) -> Column:
    return F.substring_index(path, "/", -1).isin(ENTRY_FILES) | path.rlike(r"(^|/)(bin|cmd|cli)/")


def base_classes(signature: Column) -> Column:
    """The names in the first brackets of a signature, or after `extends`: no keywords, stars or type arguments."""
    inside = F.coalesce(F.nullif(F.regexp_extract(signature, r"\(([^)]*)\)", 1), F.lit("")), F.regexp_extract(signature, r"\bextends\s+([\w., ]+)", 1))
    return F.filter(F.transform(F.split(F.regexp_replace(inside, r"\[[^\]]*\]", ""), ","), lambda x: F.trim(x)), lambda x: (x != "") & ~x.contains("=") & ~x.contains("*"))


def flow_edges(relationships: DataFrame, components: DataFrame) -> DataFrame:
    """(caller, callee, position, parameter): a row for each parameter (parameters array) of a called component."""
    calls = relationships.where(F.col("edge_type").isNull() | F.col("edge_type").isin("call", "calls"))
    return calls.join(components.select(F.col("component_id").alias("to_id"), "parameters"), "to_id").select(F.col("from_id").alias("caller"), F.col("to_id").alias("callee"), F.posexplode("parameters").alias("position", "parameter"))


def similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _segments(known: Column, least: float) -> Column:
    """The keys (length, place, part) of a known name: one part more than the edits that a name at least this similar has."""
    m = F.length(known)
    edits = F.floor(m * (1 - least) / least + 1e-9).cast("int")
    start = lambda i: F.floor(i * m / (edits + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), edits), lambda i: F.struct(m.alias("m"), i.alias("i"), F.substring(known, start(i) + 1, start(i + 1) - start(i)).alias("part")))


def _probes(name: Column, least: float) -> Column:
    """The keys that a known name can have of which an edit leaves a part as it is, moved by no more places than edits."""
    n = F.length(name)
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    def of_part(m: Column, i: Column) -> Column:
        edits = F.floor(m * (1 - least) / least + 1e-9).cast("int")
        a, b = F.floor(i * m / (edits + 1)).cast("int"), F.floor((i + 1) * m / (edits + 1)).cast("int")
        at = span(F.greatest(F.lit(0), a - edits), F.least(n - (b - a), a + edits))
        return F.transform(at, lambda p: F.struct(m.alias("m"), i.alias("i"), F.substring(name, p + 1, b - a).alias("part")))

    of_length = lambda m: F.flatten(F.transform(F.sequence(F.lit(0), F.floor(m * (1 - least) / least + 1e-9).cast("int")), lambda i: of_part(m, i)))
    return F.array_distinct(F.flatten(F.transform(span(F.ceil(n * least - 1e-9).cast("int"), F.floor(n / least + 1e-9).cast("int")), of_length)))


def heal_names(names: DataFrame, components: DataFrame, least: float = 0.85) -> DataFrame:
    """(name, component_id, how): names to component ids: equal, then equal without case and punctuation, then the most
    similar of all known names. Ties: smaller id. Names that nothing matches get null.

    Pairs to compare meet without loss: of a known name cut into one part more than there can be edits, a part stays whole."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    ids = components.select("component_id", F.col("name").alias("known"))
    wanted = names.select("name").distinct()
    exact = wanted.join(ids, F.col("name") == F.col("known")).groupBy("name").agg(F.min("component_id").alias("e"))
    folded = wanted.withColumn("k", plain(F.col("name"))).join(ids.withColumn("k", plain(F.col("known"))), "k").groupBy("name").agg(F.min("component_id").alias("f"))
    left = wanted.join(folded, "name", "left_anti").withColumn("k", F.explode(_probes(F.lower("name"), least)))
    cut = ids.groupBy("known").agg(F.min("component_id").alias("component_id")).withColumn("k", F.explode(_segments(F.lower("known"), least)))
    near = left.join(cut, "k").select("name", "known", "component_id").distinct().withColumn("s", similarity(F.lower("name"), F.lower("known"))).where(F.col("s") >= least)
    best = near.groupBy("name").agg(F.min_by("component_id", F.struct(-F.col("s"), "component_id")).alias("n"))
    out = wanted.join(exact, "name", "left").join(folded, "name", "left").join(best, "name", "left")
    return out.select("name", F.coalesce("e", "f", "n").alias("component_id"), F.when(F.col("e").isNotNull(), "exact").when(F.col("f").isNotNull(), "folded").when(F.col("n").isNotNull(), "similar").otherwise("none").alias("how"))


def assign_identities(overlaps: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(new_id, old_id, overlap): one old identity at most for each new set, and the other way round, given in the order
    of the new sets (ord); each takes the best that is still free. overlaps: (ord, new_id, old_id, overlap).

    That order is a common preference of the old sets, so it is a stable matching: sets propose to their best remaining
    identity, which keeps the first in order; the refused propose again. Rounds, not a loop over sets.
    """
    left = written(overlaps.where(F.col("overlap") >= threshold))
    while True:
        best = left.groupBy("new_id").agg(F.min_by(F.struct("ord", "old_id", "overlap"), F.struct(-F.col("overlap"), "old_id")).alias("b")).select("new_id", "b.*")
        held = written(best.withColumn("r", F.row_number().over(W.Window.partitionBy("old_id").orderBy("ord", "new_id"))))
        refused = held.where("r > 1").select("new_id", "old_id")
        if refused.isEmpty():
            return held.where("r = 1").select("new_id", "old_id", F.round("overlap", 6).alias("overlap"))
        left = written(left.join(refused, ["new_id", "old_id"], "left_anti"))


def layered_budget(paragraphs: DataFrame, budget: int) -> DataFrame:
    """(group, n, kept): paragraphs (grp, doc, idx, size) taken layer by layer: first and last ones of every document,
    then second ones and so on, each if it still fits."""
    last = F.max("idx").over(W.Window.partitionBy("grp", "doc"))
    layered = paragraphs.withColumn("layer", F.when(F.col("idx") == last, 0).otherwise(F.col("idx")))
    lists = layered.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("layer", "doc", "idx", F.col("size").cast("long").alias("size")))).alias("l"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"))
    fold = F.aggregate("l", start, lambda a, x: F.when(a["used"] + x["size"] <= budget, F.struct((a["used"] + x["size"]).alias("used"), (a["n"] + 1).alias("n"))).otherwise(a))
    return lists.select("grp", fold.alias("f")).select("grp", F.col("f.n").alias("kept"), F.col("f.used").alias("used"))


def queue_outcomes(modules: DataFrame, failed: DataFrame) -> DataFrame:
    """(module_id, outcome): failed, skipped (an ancestor of a failed one), or done."""
    up = affected(modules.select(F.col("parent_id").alias("src"), F.col("module_id").alias("dst")), failed.select(F.col("module_id").alias("node")))
    hit = up.select(F.col("node").alias("module_id"), F.when(F.col("distance") == 0, "failed").otherwise("skipped").alias("o"))
    return modules.select("module_id").join(hit, "module_id", "left").select("module_id", F.coalesce("o", F.lit("done")).alias("outcome"))


def freeze_names(df: DataFrame, name: str, key: str) -> DataFrame:
    """df with `file_name`: the name as it is where only one row has it, else with the first 8 digits of the key's hash."""
    many = df.groupBy(name).agg(F.count("*").alias("_n"))
    return df.join(many, name).withColumn("file_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat_ws("-", name, F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8)))).drop("_n")


def merge_children(old: DataFrame, new: DataFrame) -> DataFrame:
    """Children (parent_id, module_id, title, n) after new ones came: known ones keep their title and take the new count."""
    o, n = old.select("parent_id", "module_id", F.col("title").alias("ot"), F.col("n").alias("on")), new.select("parent_id", "module_id", F.col("title").alias("nt"), F.col("n").alias("nn"))
    return o.join(n, ["parent_id", "module_id"], "full").select("parent_id", "module_id", F.coalesce("ot", "nt").alias("title"), F.coalesce("nn", "on").alias("n"))


def folder_sizes(files: DataFrame) -> DataFrame:
    """(folder, depth, files, bytes) of every folder in front of a file (path, size), the root as the empty string."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder"), i.alias("depth")))
    return files.select(F.explode(folders).alias("f"), "size").groupBy("f.folder", "f.depth").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def export_elements(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(element): the graph as JSON elements, a node for each component and an edge for each resolved pair."""
    nodes = components.select(F.to_json(F.struct(F.struct(F.col("component_id").cast("string").alias("id"), F.col("name").alias("label"), F.col("component_type").alias("type")).alias("data"))).alias("element"))
    pairs = edges.where("to_id is not null").select("from_id", "to_id").distinct()
    return nodes.unionByName(pairs.select(F.to_json(F.struct(F.struct(F.concat_ws("-", "from_id", "to_id").alias("id"), F.col("from_id").cast("string").alias("source"), F.col("to_id").cast("string").alias("target")).alias("data"))).alias("element")))


def test_files(files: DataFrame, components: DataFrame) -> DataFrame:
    """(component_id, path): test files (path) named after a component's file (component_id, file_path): test_x, x_test, x.spec.

    The stem is the join key, so the match is a hash join."""
    stem = F.regexp_replace(F.regexp_replace(F.substring_index(F.lower("path"), "/", -1), r"\.[a-z]+$", ""), r"^test_|[._-](test|spec)s?$", "")
    tests = files.where(F.substring_index(F.lower("path"), "/", -1).rlike(r"^test_|[._-](test|spec)s?\.")).select("path", stem.alias("stem"))
    own = components.select("component_id", F.regexp_replace(F.substring_index(F.lower("file_path"), "/", -1), r"\.[a-z]+$", "").alias("stem"))
    return own.join(tests, "stem").select("component_id", "path")


def progress(done_weight: Column, total_weight: Column, elapsed: Column) -> Column:
    """(share, eta): the finished share of the work and the seconds that the rest takes at this rate; null before any."""
    share = done_weight / F.nullif(total_weight, F.lit(0))
    return F.struct(F.round(share, 6).alias("share"), F.when(share > 0, F.round(elapsed / share - elapsed, 6)).alias("eta"))
