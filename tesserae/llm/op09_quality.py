"""Quality rules with robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

All of it is DataFrame expressions. Each text gives counts, and from them a vector of DIMS transformed statistics:
log of the word count, mean word length, log share of symbols, log share of repeated lines and windows, and log share of
upper-case letters. A document is judged by the estimate of its language and source, or where that has fewer than LEAST
documents by the one of its whole language, or where that has fewer too by the one of all documents, however few. The
estimate starts from two deterministic guesses (medians of a fine histogram with their spread; mean and covariance), takes concentration steps (keep the
KEEP share of smallest Mahalanobis distance, re-estimate), STEPS from each, and goes on from the one with the smaller
determinant until no step lowers that of the group by GAIN. The share is found from a histogram of log distances, so no group is gathered anywhere: hot groups are pre-aggregated in every task.
A floor on every variance keeps estimates regular where a statistic hardly varies; below LEAST documents it grows as their number falls. A document whose squared
distance exceeds CUTOFF is rejected, as is one that fails the base rules.

Null and empty texts have no words and fail the base rules. A null lang or source is a group of its own. Repeated rows
count as often as they come. Columns other than doc_id, text, lang and source are ignored here; keep_good() keeps them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import free_name, materialize, sized, table

DIMS, KEEP, STEPS, LEAST = 5, 0.75, 2, 200
#: A concentration step counts if the root of the determinant falls by this share.
GAIN = 0.01
#: Squared distance beyond which a document is an outlier; far in the tail of chi-squared with DIMS degrees of freedom, as
#: statistics of clean texts have heavier tails than normal ones.
CUTOFF = 60.0
#: Smallest variance of each statistic. The one of repetition is wide: most texts have none, and a short refrain is no fault.
FLOOR = (0.05, 0.05, 0.02, 0.5, 0.02)
#: Files of tables that have a row for each group.
_FILES = 8
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_WORD = "[^\\x20\\x09-\\x0D]"


def text_counts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and whatever else) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper."""
    text = F.coalesce(F.col("text"), F.lit(""))
    inside = F.translate(text, _SPACES, "")
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_WORD))
    out = docs.withColumns({"_words": words, "_lines": lines, "word_chars": F.length(inside).cast("long"), "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"), "n_upper": F.length(F.regexp_replace(text, "[^A-Z]", "")).cast("long")})
    n = F.size("_words")
    at = lambda i, k: F.get("_words", i + k)
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[at(i, k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumns({"n_words": n.cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "_windows": windows})
    return out.withColumn("n_repeat_words", _repeated(F.col("_windows"))).drop("_words", "_lines", "_windows")


def _repeated(windows: Column) -> Column:
    """Words that lie in a window whose hash comes twice or more: sort (hash, place), mark equal neighbours, add up cover."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, j: F.coalesce(F.get(s, j)["h"] == F.get(s, j + 1)["h"], F.lit(False))
    marked = F.transform(F.array(placed), lambda s: F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(s, j) | same(s, j - 1)), lambda j: F.get(s, j)["i"])))
    # each place adds up to five words, less what the next one covers
    cover = F.transform(marked, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(p, j + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x))
    return F.when(F.size(windows) == F.size(F.array_distinct(windows)), F.lit(0)).otherwise(F.get(cover, F.lit(0))).cast("long")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _statistics(counted: DataFrame) -> DataFrame:
    n, chars = F.greatest("n_words", F.lit(1)).cast("double"), F.greatest("word_chars", F.lit(1)).cast("double")
    x = [F.log1p(F.col("n_words").cast("double")), F.col("word_chars") / n, F.log1p(100 * F.col("n_symbols") / chars), F.log1p(100 * F.greatest(5 * F.col("n_dup_lines").cast("double"), F.col("n_repeat_words").cast("double")) / n), F.log1p(100 * F.col("n_upper") / chars)]
    return counted.withColumns({f"x{i}": e for i, e in enumerate(x)})


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _moments(df: DataFrame, weight: Column) -> DataFrame:
    """For each group the mean m and, by Cholesky (lower l, with floors added), the covariance of the rows of weight 1."""
    sums = [F.sum(weight).alias("w"), *[F.sum(weight * F.col(f"x{i}")).alias(f"s{i}") for i in range(DIMS)], *[F.sum(weight * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in _pairs()]]
    out = df.groupBy("g").agg(*sums, F.greatest(F.lit(1.0), LEAST / F.count("*")).alias("few")).where("w > 0")
    out = out.select("g", "few", *[(F.col(f"s{i}") / F.col("w")).alias(f"m{i}") for i in range(DIMS)], *[(F.col(f"q{i}_{j}") / F.col("w") - F.col(f"s{i}") / F.col("w") * F.col(f"s{j}") / F.col("w")).alias(f"c{i}_{j}") for i, j in _pairs()])
    return _cholesky(out.withColumns({f"c{i}_{i}": F.greatest(f"c{i}_{i}", F.lit(0.0)) + FLOOR[i] * F.col("few") for i in range(DIMS)}))


def _cholesky(df: DataFrame) -> DataFrame:
    for j in range(DIMS):
        cut = lambda i: reduce(lambda a, k: a - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}"), range(j), F.col(f"c{i}_{j}"))  # noqa: B023, E731
        df = df.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(cut(j), F.lit(1e-9))))
        df = df.withColumns({f"l{i}_{j}": cut(i) / F.col(f"l{j}_{j}") for i in range(j + 1, DIMS)}) if j + 1 < DIMS else df
    return df.select("g", *[f"m{i}" for i in range(DIMS)], *[f"l{i}_{j}" for i, j in _pairs()])


def _distances(df: DataFrame, guess: DataFrame) -> DataFrame:
    """df with d, the squared Mahalanobis distance under its group's estimate."""
    out = df.join(sized(guess), "g")
    for i in range(DIMS):
        rest = reduce(lambda a, k: a - F.col(f"l{i}_{k}") * F.col(f"z{k}"), range(i), F.col(f"x{i}") - F.col(f"m{i}"))  # noqa: B023
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}_{i}"))
    return out.withColumn("d", reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIMS)])).select(*df.columns, "d")


def _within(df: DataFrame, value: str, share: float, per: int) -> DataFrame:
    """(g, edge): the smallest edge of a fine histogram bin below which `share` of a group's values lie, at least."""
    bins = df.groupBy("g", F.floor(F.col(value) * per).alias("bin")).agg(F.count("*").alias("n"))
    w = W.Window.partitionBy("g").orderBy("bin")
    run = bins.withColumns({"below": F.sum("n").over(w), "all": F.sum("n").over(W.Window.partitionBy("g"))})
    return run.where(F.col("below") >= share * F.col("all")).groupBy("g").agg(((F.min("bin") + 1) / per).alias("edge"))


def _concentrated(df: DataFrame, guess: DataFrame) -> DataFrame:
    """A concentration step: the estimate of the KEEP share of each group that is nearest under the guess."""
    near = _distances(df, guess).withColumn("ld", F.log(F.col("d") + 1e-6))
    edges = materialize(_within(near, "ld", KEEP, 64).coalesce(_FILES))
    return materialize(_moments(near.join(sized(edges), "g"), F.when(F.col("ld") <= F.col("edge"), 1.0).otherwise(0.0)).coalesce(_FILES))


def _best(*guesses: DataFrame) -> DataFrame:
    """For each group the guess with the smallest determinant, the first of equal ones; `fell`: the later ones were smaller by GAIN."""
    det = reduce(lambda a, b: a * b, [F.col(f"l{i}_{i}") for i in range(DIMS)])
    kept = ["g", *[f"m{i}" for i in range(DIMS)], *[f"l{i}_{j}" for i, j in _pairs()]]
    every = reduce(DataFrame.unionByName, [g.select(kept).withColumns({"_at": F.lit(i), "_det": det}) for i, g in enumerate(guesses)])
    first = F.max(F.when(F.col("_at") == 0, F.col("_det"))).over(W.Window.partitionBy("g"))
    ranked = every.withColumns({"_r": F.row_number().over(W.Window.partitionBy("g").orderBy("_det", "_at")), "fell": F.coalesce(F.col("_det") < first * (1 - GAIN), F.lit(False))})
    return materialize(ranked.where("_r = 1").drop("_r", "_at", "_det").coalesce(_FILES))


def _estimates(df: DataFrame) -> DataFrame:
    """The estimate of each group with the smaller determinant, from two deterministic starts, concentrated until it falls no more."""
    every = materialize(_moments(df, F.lit(1.0)).coalesce(_FILES))
    medians = None
    for i in range(DIMS):
        one = _within(df, f"x{i}", 0.5, 256).withColumnRenamed("edge", f"m{i}")
        medians = one if medians is None else medians.join(one, "g")
    flat = every.select("g", *[f"l{i}_{j}" if i == j else F.lit(0.0).alias(f"l{i}_{j}") for i, j in _pairs()])
    starts = [every, materialize(medians.join(flat, "g").select("g", *[f"m{i}" for i in range(DIMS)], *[f"l{i}_{j}" for i, j in _pairs()]).coalesce(_FILES))]
    ends = []
    for guess in starts:
        for _ in range(STEPS):
            guess = _concentrated(df, guess)
        ends.append(guess)
    done, moving = [], _best(*ends)
    while True:  # every turn lowers the determinant of each group that stays, by GAIN at least; the floors bound it
        now = _best(moving, _concentrated(df, moving))
        done.append(now.where("not fell").drop("fell"))
        moving = materialize(now.where("fell"))
        if moving.isEmpty():
            return reduce(DataFrame.unionByName, done)


def verdicts(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) of every document.

    distance: squared and robust; null where the base rules fail.
    """
    return _judged(docs.withColumn("_key", F.lit(None).cast("string")), cutoff).drop("key")


def _key() -> Column:
    """What a row without doc_id is known by: rows equal in it get one verdict. Null for the others."""
    return F.when(F.col("doc_id").isNull(), F.sha2(F.to_json(F.struct("text", "lang", "source")), 256))


def _judged(docs: DataFrame, cutoff: float) -> DataFrame:
    """verdicts() with `key`, the column _key of docs."""
    counted = text_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_key").alias("key"), F.col("text").cast("string").alias("text"), F.to_json(F.struct(F.lit("s").alias("k"), "lang", "source")).alias("own"), F.to_json(F.struct(F.lit("l").alias("k"), "lang")).alias("pool"))).drop("text")
    rows = materialize(_statistics(counted.withColumn("base_failed", base_failed())))
    good = rows.where("not base_failed")

    own = materialize(good.groupBy("own").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).select("own", F.col("own").alias("own_g")))
    rows = rows.join(sized(own), "own", "left")
    # pools hold all their documents, and are estimated only where some document has no own group
    pools = rows.where("not base_failed").groupBy("pool").agg(F.count("*").alias("n"), F.count_if(F.col("own_g").isNull()).alias("left"))
    pools = materialize(pools.where((F.col("n") >= LEAST) & (F.col("left") > 0)).select("pool", F.col("pool").alias("pool_g")))
    rows = rows.join(sized(pools), "pool", "left").withColumn("g", F.coalesce("own_g", "pool_g", F.lit("all")))
    held = materialize(rows.where("not base_failed"))
    everyone = F.lit(None).cast("string") if held.where("g = 'all'").isEmpty() else F.lit("all")
    members = held.select(F.explode(F.array_compact(F.array("own_g", "pool_g", everyone))).alias("g"), *[f"x{i}" for i in range(DIMS)])
    final = materialize(_estimates(materialize(members)))
    held, rest = held.drop("own", "pool", "own_g", "pool_g"), rows.where("base_failed").drop("own", "pool", "own_g", "pool_g")
    judged = _distances(held, final).unionByName(rest.withColumn("d", F.lit(None).cast("double")))
    return judged.select("doc_id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.coalesce("d", F.lit(0.0)) <= cutoff)).alias("kept"), F.col("d").alias("distance"))


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs that verdicts() keeps, with all their columns. Repeated ids stand or fall
    together; a row without doc_id has its own verdict."""
    judged = _judged(docs.select("doc_id", "text", "lang", "source", _key().alias("_key")), cutoff)
    good = materialize(judged.groupBy("doc_id", "key").agg(F.min("kept").alias("kept")).where("kept").select("doc_id", "key"))
    known = docs.join(sized(materialize(good.where("doc_id is not null").select("doc_id"))), "doc_id", "left_semi").select(docs.columns)
    name = free_name(docs, "_key")
    keys = materialize(good.where("doc_id is null").select(F.col("key").alias(name)))
    return known.unionByName(docs.where("doc_id is null").withColumn(name, _key()).join(sized(keys), name, "left_semi").select(docs.columns))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))
