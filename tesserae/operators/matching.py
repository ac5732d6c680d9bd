"""Set and text similarity, identity matching and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def overlaps(new: DataFrame, old: DataFrame) -> DataFrame:
    """(new_id, old_id, common, new_size, old_size) of the sets (set_id, item) that share an item."""
    size = lambda df, a: df.groupBy(F.col("set_id").alias(f"{a}_id")).agg(F.count("*").alias(f"{a}_size"))
    common = new.select(F.col("set_id").alias("new_id"), "item").join(old.select(F.col("set_id").alias("old_id"), "item"), "item").groupBy("new_id", "old_id").agg(F.count("*").alias("common"))
    return common.join(size(new, "new"), "new_id").join(size(old, "old"), "old_id")


def dominant_match(new: DataFrame, old: DataFrame, threshold: float = 0.7, margin: float = 0.15, of: str = "new") -> DataFrame:
    """(new_id, old_id, overlap): an equal set at once, else the best overlap if it reaches the threshold and leads the
    next by the margin. of="old" measures against the old sets: the successor of a split."""
    a, b = ("new", "old") if of == "new" else ("old", "new")
    pairs = overlaps(new, old).withColumn("overlap", F.col("common") / F.col(f"{a}_size")).withColumn("equal", (F.col("common") == F.col("new_size")) & (F.col("common") == F.col("old_size")))
    w = W.Window.partitionBy(f"{a}_id").orderBy(F.desc("equal"), F.desc("overlap"), f"{b}_id")
    ranked = pairs.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("overlap").over(w)).where("r = 1")
    good = F.col("equal") | ((F.col("overlap") >= threshold) & (F.round(F.col("overlap") - F.coalesce("next", F.lit(0.0)), 9) >= margin))
    return ranked.where(good).select("new_id", "old_id", F.round("overlap", 6).alias("overlap"))


def stability(new: DataFrame, old: DataFrame) -> DataFrame:
    """One row on two partitions (set_id, item): share of items in both, sets equal under one id, mean Jaccard by id."""
    items = new.select("item").distinct().withColumn("n", F.lit(1)).join(old.select("item").distinct().withColumn("o", F.lit(1)), "item", "full")
    coverage = items.agg(F.round(F.coalesce(F.try_divide(F.count_if(F.col("n").isNotNull() & F.col("o").isNotNull()), F.count("*")), F.lit(1.0)), 6).alias("coverage"))
    sides = new.withColumn("n", F.lit(1)).join(old.withColumn("o", F.lit(1)), ["set_id", "item"], "full").groupBy("set_id").agg(F.count_if(F.col("n").isNotNull() & F.col("o").isNotNull()).alias("i"), F.count("*").alias("u"), F.count("n").alias("n"), F.count("o").alias("o"))
    both = sides.agg(F.round(F.coalesce(F.try_divide(F.count_if((F.col("n") > 0) & (F.col("o") > 0)), F.count("*")), F.lit(1.0)), 6).alias("id_consistency"), F.round(F.coalesce(F.avg(F.when((F.col("n") > 0) & (F.col("o") > 0), F.col("i") / F.col("u"))), F.lit(1.0)), 6).alias("mean_jaccard"))
    return coverage.crossJoin(both)  # one row each


def change_ratio(new: DataFrame, old: DataFrame) -> DataFrame:
    """(set_id, changed, size, ratio) of sets (set_id, item, hash): added, removed and re-hashed items over the new size, 1 at most."""
    n, o = new.select("set_id", "item", F.col("hash").alias("nh")), old.select("set_id", "item", F.col("hash").alias("oh"))
    sides = n.join(o, ["set_id", "item"], "full").groupBy("set_id").agg(F.count_if(F.col("nh").isNull() | F.col("oh").isNull() | (F.col("nh") != F.col("oh"))).alias("changed"), F.count("nh").alias("size"))
    return sides.withColumn("ratio", F.round(F.least(F.coalesce(F.try_divide("changed", "size"), F.lit(0.0)), F.lit(1.0)), 6))


def hard_triggers(new: DataFrame, old: DataFrame) -> DataFrame:
    """(parent_id, module_id, trigger): children (parent_id, module_id, title) added, removed or renamed."""
    j = new.withColumnRenamed("title", "nt").join(old.withColumnRenamed("title", "ot"), ["parent_id", "module_id"], "full")
    kind = F.when(F.col("ot").isNull(), "child_added").when(F.col("nt").isNull(), "child_removed").when(F.col("nt") != F.col("ot"), "title_changed")
    return j.select("parent_id", "module_id", kind.alias("trigger")).where("trigger is not null")


def line_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of trimmed, non-empty lines."""
    lines = lambda t: F.array_distinct(F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    x, y = lines(a), lines(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(1.0))


def near_duplicate_groups(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs (name, key, text): in each key's group the longest text (ties: smallest name) stays; the others are dropped if
    all are more similar to it than the threshold, else the group is a conflict."""
    keep = docs.groupBy("key").agg(F.min_by(F.struct("name", "text"), F.struct(-F.length("text"), F.col("name"))).alias("k"), F.count("*").alias("n")).where("n > 1")
    judged = docs.join(keep, "key").where("name <> k.name").withColumn("similar", line_jaccard(F.col("text"), F.col("k.text")) > threshold)
    verdict = judged.groupBy("key").agg(F.first("k.name").alias("kept"), F.count("*").alias("others"), F.min("similar").alias("all_similar"))
    return verdict.select("key", "kept", "others", F.when(F.col("all_similar"), "dropped").otherwise("conflict").alias("verdict"))


def tfidf_pairs(terms: DataFrame, threshold: float = 0.6, most_share: float = 0.8) -> DataFrame:
    """(a, b, score): pairs of documents with a cosine of TF-IDF vectors of at least the threshold. terms: (doc, term, n).

    Terms in more than most_share of the documents drop out. tf = 1 + ln n, idf = ln(documents / df). Candidates share a
    term of a vector's prefix: with terms in one order (rarest first) and unit vectors, once the rest of a vector has a
    norm below the threshold it can't reach it alone, so pairs that share only such terms need no look.
    """
    total = terms.select("doc").distinct().agg(F.count("*").alias("docs"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(total).where(F.col("df") <= most_share * F.col("docs")).select("term", "df", F.log(F.col("docs") / F.col("df")).alias("idf"))  # total has one row
    weighted = terms.join(idf, "term").withColumn("w", (1 + F.log(F.col("n").cast("double"))) * F.col("idf"))
    norms = weighted.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("norm > 0")
    unit = weighted.join(norms, "doc").select("doc", "term", "df", (F.col("w") / F.col("norm")).alias("w"))
    before = W.Window.partitionBy("doc").orderBy("df", "term").rowsBetween(W.Window.unboundedPreceding, -1)
    prefix = unit.withColumn("rest", 1 - F.coalesce(F.sum(F.col("w") * F.col("w")).over(before), F.lit(0.0))).where(F.col("rest") >= threshold * threshold - 1e-9)
    left, right = prefix.select("term", F.col("doc").alias("a")), prefix.select("term", F.col("doc").alias("b"))
    candidates = left.join(right, "term").where("a < b").select("a", "b").distinct()
    dot = candidates.join(unit.select(F.col("doc").alias("a"), "term", F.col("w").alias("wa")), "a").join(unit.select(F.col("doc").alias("b"), "term", F.col("w").alias("wb")), ["b", "term"])
    return dot.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("score")).where(F.col("score") >= threshold).select("a", "b", F.round("score", 6).alias("score"))
