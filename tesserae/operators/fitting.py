"""Files of modules fitted into a budget: the longest halved in turns, then signatures only, as cumulative sums over steps.

In each turn every file that can shrink is halved once, the longest first, until the module fits. What a file looks like after
n halvings doesn't depend on the others, so each file's steps with their savings are rows; a module's steps in order of turn
and length have running sums, and a step is taken if the module is still too large before it. Turns are summed first, so only the
turn in which a module begins to fit is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import token_estimate
from ..runtime import written

#: The fewest lines that a file is cut to, the most turns, the share of lines kept from the beginning.
LEAST_LINES, TURNS, HEAD = 6, 20, 0.6
#: Beginnings of lines that are signatures.
SIGNATURES = "def |class |function |async function |export |import |interface |type |struct |enum |fn |pub |func |const |var |let |module |namespace |package |from |abstract |public |private |protected |static |#include|#import|#pragma"


def halved(text: Column) -> Column:
    """Half of the lines, 6 at least: 60 % from the beginning, the rest from the end, a mark between; up to 6 lines stay."""
    lines = F.split(text, "\n", -1)
    n = F.size(lines)
    target = F.greatest(F.floor(n / 2).cast("int"), F.lit(LEAST_LINES))
    head = F.floor(target * HEAD).cast("int")
    mark = F.concat(F.lit("// ... ("), (n - target).cast("string"), F.lit(" lines truncated) ..."))
    cut = F.concat(F.slice(lines, F.lit(1), head), F.array(F.lit(""), mark, F.lit("")), F.slice(lines, head - target, target - head))
    return F.when(n > LEAST_LINES, F.array_join(cut, "\n")).otherwise(text)


def signatures(text: Column, path: Column) -> Column:
    """The lines that begin with a word of declaration, under a mark; the path where there is none."""
    kept = F.filter(F.split(text, "\n", -1), lambda x: F.ltrim(x).rlike(f"^(?:{SIGNATURES})"))
    body = F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(F.concat(F.lit("// (see "), path, F.lit(")")))
    return F.concat(F.lit("// ── signatures only (body omitted) ──\n"), body)


def _forms(tokens) -> Column:
    """A file's texts after 0, 1, ... halvings, as far as each saves tokens: an array of (text, tokens)."""
    form = lambda t: F.struct(t.alias("text"), tokens(t).cast("long").alias("tokens"))

    def more(done: Column, _: Column) -> Column:
        last = F.element_at(done, -1)
        following = form(halved(last["text"]))
        return F.when(following["tokens"] < last["tokens"], F.concat(done, F.array(following))).otherwise(done)

    return F.aggregate(F.sequence(F.lit(1), F.lit(TURNS)), F.array(form(F.col("content"))), more)


def fitted(files: DataFrame, budget: int, tokens=token_estimate) -> DataFrame:
    """(module_id, path, content, tokens, halvings, form) of files (module_id, path, content), each module within the budget if it can be.

    form: `whole`, `halved`, or `signatures` where halving all is not enough (smallest first). tokens: a function of a text
    column. Files of equal length go in order of path. Null contents count as empty; a (module_id, path) comes once.
    """
    files = files.select("module_id", "path", F.coalesce("content", F.lit("")).alias("content"))
    forms = written(files.select("module_id", "path", F.posexplode(_forms(tokens)).alias("turn", "form")).select("module_id", "path", "turn", F.col("form.text").alias("text"), "form.tokens"))
    of_file = W.Window.partitionBy("module_id", "path").orderBy("turn")
    steps = forms.select("module_id", "path", "turn", F.length("text").alias("chars"), "tokens", (F.col("tokens") - F.lead("tokens").over(of_file)).alias("saved"))
    steps = written(steps.where("saved is not null or turn = 0"))
    total = steps.where("turn = 0").groupBy("module_id").agg(F.sum("tokens").alias("total"))
    turns = steps.where("saved is not null").groupBy("module_id", "turn").agg(F.sum("saved").alias("by_turn"))
    before = F.coalesce(F.sum("by_turn").over(W.Window.partitionBy("module_id").orderBy("turn").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))  # at most 20 rows a module
    turns = turns.withColumn("before", before).join(total, "module_id").where(F.col("total") - F.col("before") > budget)
    whole = F.col("total") - F.col("before") - F.col("by_turn") >= budget  # all of the turn's steps are taken
    turns = written(turns.select("module_id", "turn", (F.col("total") - F.col("before")).alias("over"), whole.alias("whole")))
    asked = steps.where("saved is not null").join(turns, ["module_id", "turn"])
    order = W.Window.partitionBy("module_id").orderBy(F.desc("chars"), "path").rowsBetween(W.Window.unboundedPreceding, -1)
    last = asked.where("not whole").withColumn("run", F.coalesce(F.sum("saved").over(order), F.lit(0))).where(F.col("over") - F.col("run") > budget)
    taken = asked.where("whole").select("module_id", "path").unionByName(last.select("module_id", "path"))
    cut = files.select("module_id", "path").join(taken.groupBy("module_id", "path").agg(F.count("*").cast("int").alias("halvings")), ["module_id", "path"], "left").select("module_id", "path", F.coalesce("halvings", F.lit(0)).alias("halvings"))
    now = written(forms.join(cut.withColumnRenamed("halvings", "turn"), ["module_id", "path", "turn"]).withColumnRenamed("turn", "halvings"))
    short = F.col("signed")
    left = now.groupBy("module_id").agg(F.sum("tokens").alias("left")).where(F.col("left") > budget)
    signed = now.join(left, "module_id").withColumn("signed", signatures(F.col("text"), F.col("path"))).withColumn("short", tokens(short).cast("long")).where("short < tokens")
    size = W.Window.partitionBy("module_id").orderBy(F.length("text"), "path").rowsBetween(W.Window.unboundedPreceding, -1)
    signed = signed.withColumn("run", F.coalesce(F.sum(F.col("tokens") - F.col("short")).over(size), F.lit(0))).where(F.col("left") - F.col("run") > budget).select("module_id", "path", "signed", "short")
    out = now.join(signed, ["module_id", "path"], "left")
    form = F.when(short.isNotNull(), "signatures").when(F.col("halvings") > 0, "halved").otherwise("whole")
    return out.select("module_id", "path", F.coalesce("signed", "text").alias("content"), F.coalesce("short", "tokens").alias("tokens"), "halvings", form.alias("form"))
