"""Spans, formulas, diagrams, trees by doubling, hashes over trees and free names against plain code."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tesserae.functions import spans
from tesserae.operators import diagrams, digests, trees

TEXT = "id long, text string"


def texts(seed, parts, n=250, most=14):
    r = random.Random(seed)
    return [(i, "".join(r.choice(parts) for _ in range(r.randrange(most)))) for i in range(n)]


MATH_PARTS = ["$", "$$", "a", " b ", "\\(", "\\)", "\\[", "\\]", "x^2", "`", "```", "\n", "5", "\\$", "数", "\ue0003\ue001", "😀"]


def scan(text):
    """The formulas, character by character: code first, then the delimiters, leftmost first."""
    out, at = [], 0

    def upto(close, start):
        k = text.find(close, start)
        return None if k < 0 or k == start else k + len(close)

    while at < len(text):
        end, kind = None, None
        if text.startswith("```", at):
            k = text.find("```", at + 3)
            end, kind = (len(text) if k < 0 else k + 3), "code"
        elif text[at] == "`":
            k = at + 1
            while k < len(text) and text[k] not in "`\n":
                k += 1
            end, kind = (k + 1, "code") if k < len(text) and text[k] == "`" else (None, None)
        elif text.startswith("$$", at) and (end := upto("$$", at + 2) or _longer(text, at)):
            kind = "math"
        elif text.startswith("\\[", at) and (end := upto("\\]", at + 2) or _longer(text, at, "\\]")):
            kind = "math"
        elif text.startswith("\\(", at) and (end := upto("\\)", at + 2) or _longer(text, at, "\\)")):
            kind = "math"
        elif text[at] == "$" and (at == 0 or text[at - 1] not in "\\$"):
            k = at + 1
            if k < len(text) and not text[k].isspace() and text[k] != "$":
                while k < len(text) and text[k] not in "$\n":
                    k += 1
                if k < len(text) and text[k] == "$" and text[k - 1] not in " \t\\" and not (k + 1 < len(text) and text[k + 1].isdigit()):
                    end, kind = k + 1, "math"
        elif m := re.match("\ue000\\d+\ue001", text[at:]):
            end, kind = at + m.end(), "mark"
        if end is None:
            at += 1
            continue
        if kind == "math" and not (text[at] == "$" and text[at + 1] != "$" and "数" in text[at:end]):
            out.append((at, end, text[at:end]))
        at = end
    return out


def _longer(text, at, close="$$"):
    """Content of one character at least: the closing mark after that."""
    k = text.find(close, at + 3)
    return None if k < 0 else k + len(close)


def test_formulas_equal_a_character_scanner(spark):
    rows = texts(1, [p for p in MATH_PARTS if p != "😀"])
    df = spark.createDataFrame(rows, TEXT)
    got = {r.id: [tuple(s) for s in r.f] for r in df.select("id", spans.formulas(F.col("text")).alias("f")).collect()}
    assert got == {i: scan(t) for i, t in rows} and sum(map(len, got.values())) > 20


def test_restored_texts_are_the_same(spark):
    rows = [*texts(2, MATH_PARTS), (999, None), (1000, ""), (1001, "a $x$ b $$y$$ \\(z\\) " * 500)]
    df = spark.createDataFrame(rows, TEXT).withColumn("p", spans.protect(F.col("text")))
    out = df.select("id", "text", F.col("p.text").alias("t"), F.col("p.held").alias("held"), spans.restore(F.col("p.text"), F.col("p.held")).alias("back")).collect()
    assert all(r.back == r.text for r in out)
    assert all(r.text is None or len(r.held) == len(re.findall("\ue000\\d+\ue001", r.t)) for r in out) and len(next(r for r in out if r.id == 1001).held) == 1500


def test_places_of_spans(spark):
    rows = texts(3, ["ab", "b", "aab", " ", "é"])
    got = spark.createDataFrame(rows, TEXT).select("id", spans.spans(F.col("text"), "a+b").alias("s")).collect()
    want = {i: [(m.start(), m.end(), m[0]) for m in re.finditer("a+b", t)] for i, t in rows}
    assert {r.id: [tuple(s) for s in r.s] for r in got} == want


def plain_blocks(text):
    rows, out, i = text.split("\n"), [], 0
    while i < len(rows):
        if rows[i].strip(" \t").startswith("```mermaid"):
            start, inner = i + 1, []
            i += 1
            while i < len(rows) and rows[i].strip(" \t") != "```":
                inner.append(rows[i])
                i += 1
            if "\n".join(inner).rstrip("\n") or len(inner) > 1:
                out.append((start, "\n".join(inner)))
        i += 1
    return out


def test_blocks_equal_a_line_scan(spark):
    rows = texts(4, ["```mermaid\n", "```\n", "a --> b\n", "x\n", "  ```mermaid graph\n", "  ``` \n", "[y]]\n", "```python\n"])
    got = {}
    for r in diagrams.blocks(spark.createDataFrame(rows, TEXT).withColumnRenamed("id", "file_name")).collect():
        got.setdefault(r.file_name, []).append((r.line, r.content.rstrip("\n")))
        text = dict(rows)[r.file_name]
        assert text[r.start : r.end].lstrip(" ").startswith("```mermaid") and text[: r.start].count("\n") + 1 == r.line
    want = {i: [(n, c.rstrip("\n")) for n, c in plain_blocks(t) if c.strip("\n")] for i, t in rows}
    assert {i: sorted(b) for i, b in got.items()} == {i: b for i, b in want.items() if b}


def test_issues_of_diagrams(spark):
    cases = {"a[x] --> b[y]": [], "a[x --> b": [(2, "Unbalanced square brackets (+1)")], "a\nb]\nc[": [(3, "Unbalanced square brackets")], 'a["é"]\nb[é]': [(3, "Non-ASCII characters outside quoted strings")], "a\nb[x → y]": [(3, "Non-ASCII characters outside quoted strings"), (3, "Unicode math operators in labels")], "a\nb[it's]": [(3, "Single-quote character inside a node label bracket")]}
    df = spark.createDataFrame([(c, 0, 1, c) for c in cases], "file_name string, block int, line int, content string")
    got = {}
    for r in diagrams.issues(df).collect():
        got.setdefault(r.file_name, []).append((r.line, r.issue))
    assert {c: sorted(got.get(c, [])) for c in cases} == cases


def test_clean_up_keeps_its_result(spark):
    known = {"A-->[ go ]B": "A-->|go|B", "A --> B --> C": "A --> B\nB --> C", "A & B --> C": "A --> C\nB --> C", "a[x\\ny]\\nb": "a[x<br/>y]\nb", "A[open": "A[open]", "“q”; B --> C": '"q"\nB --> C', "a<<b>>": "a<b>", "n( [ x ] )": "n([x])", "a\n\n\n\nb": "a\n\nb", "A & B --> C --> D": "A --> C\nB --> C\nC --> D", "plain": "plain", "A --> B ==> C": "A --> B ==> C"}
    rows = [*enumerate(known), *[(100 + i, t) for i, t in texts(5, ["A", " --> ", " & ", "B[x]", ";", "\n", "[", "]", "\\n", " ==> ", "“", "<<", "( [", "] )", " "], 600, 12)]]
    out = spark.createDataFrame(rows, TEXT).withColumn("once", diagrams.cleaned(F.col("text"))).withColumn("twice", diagrams.cleaned(F.col("once"))).collect()
    assert {r.text: r.once for r in out if r.id < 100} == known
    assert [(r.text, r.once, r.twice) for r in out if r.once != r.twice] == []


def test_diagrams_of_one_small_file_are_dealt_out(spark):
    """rows that came in one partition are cleaned by several tasks."""
    docs = spark.createDataFrame([(i, f"```mermaid\nA & B --> C{i}\n```\n") for i in range(40)], TEXT).withColumnRenamed("id", "file_name").coalesce(1)
    out = diagrams.blocks(docs).select("file_name", diagrams.cleaned(F.col("content")).alias("cleaned"), F.spark_partition_id().alias("p")).collect()
    assert len({r.p for r in out}) > 1 and {r.file_name: r.cleaned for r in out} == {i: f"A --> C{i}\nB --> C{i}" for i in range(40)}


MODULES = "module_id string, parent_id string, title string, depth int"


def test_trees_by_doubling(spark):
    r = random.Random(6)
    rows = [(f"m{i}", "root" if i == 0 or r.random() < 0.05 else f"m{r.randrange(max(0, i - 4), i)}", f"t{i}", 0) for i in range(120)]
    rows += [("lost", "nowhere", "l", 0), ("under", "lost", "u", 0), ("c1", "c2", "x", 0), ("c2", "c3", "x", 0), ("c3", "c1", "x", 0), ("tail", "c1", "x", 0), ("self", "self", "x", 0)]
    parent, title = {m: p for m, p, _, _ in rows}, {m: t for m, _, t, _ in rows}

    def way(m):
        out = [m]
        while parent.get(out[-1]) in parent and parent[out[-1]] not in out:
            out.append(parent[out[-1]])
        return out if parent[out[-1]] not in out else None

    df = spark.createDataFrame(rows, MODULES)
    good = {m: way(m) for m in parent if way(m)}
    rooted = {m: w for m, w in good.items() if parent[w[-1]] == "root"}
    assert {(x.module_id, x.depth, x.path) for x in trees.paths(df).collect()} == {(m, len(w), "/".join(title[x] for x in reversed(w))) for m, w in rooted.items()}
    assert {(x.module_id, x.depth) for x in trees.depths(df).collect()} == {(m, len(w)) for m, w in rooted.items()}
    height = {m: max(w.index(m) for w in good.values() if m in w) for m in good}
    assert {x.module_id: x.level for x in trees.heights(df).collect()} == height
    assert {x.module_id for x in trees.ancestor_cycles(df).collect()} == {"c1", "c2", "c3", "self"}
    assert trees.paths(df.where("false")).count() == 0 and trees.heights(df.where("false")).count() == 0


def test_a_deep_chain_takes_few_rounds(spark):
    n = 100_000
    chain = spark.range(n).select(F.col("id").cast("string").alias("module_id"), F.when(F.col("id") == 0, "root").otherwise((F.col("id") - 1).cast("string")).alias("parent_id"), F.lit("t").alias("title"))
    _, rounds = trees._jumps(chain, path=False)
    assert len(rounds) <= 18
    assert trees.depths(chain).agg(F.max("depth"), F.count("*")).first()[:] == (n, n)


def test_one_changed_leaf_changes_its_ancestors_alone(spark):
    modules = spark.createDataFrame([("r", "root"), ("a", "r"), ("b", "r"), ("a1", "a"), ("a2", "a"), ("b1", "b")], "module_id string, parent_id string")
    own = {m: m * 2 for m in ("r", "a", "a1", "a2", "b1")}
    hashes = lambda x: trees_hash(spark, modules, x)
    one, two = hashes(own), hashes(own | {"a2": "new"})
    sha = lambda *p: hashlib.sha256("".join(x + "\0" for x in p).encode()).hexdigest()
    assert one["a1"] == sha("a1a1") and one["b"] == sha("", one["b1"]) and one["a"] == sha("aa", one["a1"], one["a2"]) and one["r"] == sha("rr", one["a"], one["b"])
    assert {m for m in one if one[m] != two[m]} == {"a2", "a", "r"}


def trees_hash(spark, modules, own):
    return {r.module_id: r.hash for r in digests.tree_hashes(modules, spark.createDataFrame(list(own.items()), "module_id string, hash string")).collect()}


def test_module_and_guide_hashes(spark):
    sha = lambda *p: hashlib.sha256("".join(x + "\0" for x in p).encode()).hexdigest()
    modules = spark.createDataFrame([("m", "T", "P/T"), ("e", "E", "E")], "module_id string, title string, path string")
    members = spark.createDataFrame([("m", "b"), ("m", "a"), ("m", "a"), ("m", "c"), ("x", "a")], "module_id string, component_id string")
    sources = spark.createDataFrame([("a", "1"), ("b", ""), ("c", "3")], "component_id string, source_code string")
    plain = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r.module_id: r.hash for r in digests.module_inputs(modules, members, sources, ["f", "en"]).collect()}
    assert got == {"m": sha("T", "P/T", "a", "b", "c", plain("1"), plain("3"), "f", "en"), "e": sha("E", "E", "f", "en")}
    files = spark.createDataFrame([("b", "B"), ("a", "A")], "path string, content string")
    wanted = spark.createDataFrame([("g", "b"), ("g", "z"), ("g", "a")], "guide string, path string")
    assert digests.guide_hash(files, wanted, "v").first().hash == sha("A", "B", "z", "v")


@pytest.mark.parametrize("first", [1, 2])
def test_free_names(spark, first):
    r = random.Random(first)
    names = [r.choice(["a", "a-1", "a-2", "a-4", "a-1-1", "a-01", "b", "b-2", "c-", "-1", ""]) for _ in range(60)]
    rows = list(enumerate(names))
    given, used, want = set(names), set(), {}
    for i, x in rows:
        if x not in used:
            want[i] = x
        else:
            k = first
            while f"{x}-{k}" in given or f"{x}-{k}" in used:
                k += 1
            want[i] = f"{x}-{k}"
        used.add(want[i])
    out = {x.id: x.free_name for x in trees.free_names(spark.createDataFrame(rows, "id long, name string"), "name", ["id"], first=first).collect()}
    assert out == want and len(set(out.values())) == len(rows)
