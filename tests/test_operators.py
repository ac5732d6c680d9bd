from pyspark.sql import functions as F

from tesserae.functions import parsers, text
from tesserae.operators import documents, edges, graph, matching, trees
from tesserae.sources import repository
from tesserae.streaming import registry

EDGE = "edge_type string, from_id string, to_id string, to_unresolved string, confidence string, ev_file string, ev_line int"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_weights_and_cap(spark):
    some = [("imports", "a", "b", None, "high", "f", 1), ("imports", "b", "a", None, "low", "f", 2), ("calls", "a", "b", None, "low", "f", 3), ("tests", "a", "c", None, "high", "f", 4), ("imports", "a", None, "x", "low", "f", 5), ("calls", "d", "d", None, "high", "f", 6)]
    pairs = edges.weighted_pairs(spark.createDataFrame(some, EDGE))
    assert rows(pairs) == [("a", "b", 1.9), ("a", "c", 0.2)]
    many = spark.createDataFrame([("imports", "a", "b", None, "high", "f", i) for i in range(9)], EDGE)
    assert rows(edges.weighted_pairs(many)) == [("a", "b", 3.0)]


def test_stats_of_nothing(spark):
    assert rows(edges.graph_stats(spark.createDataFrame([], EDGE))) == [("*", 0, 0, 0.0)]


def test_chain_levels_dependencies_first(spark):
    chain = spark.createDataFrame([("app", "lib"), ("lib", "core")], "src string, dst string")
    assert rows(graph.topological_levels(chain)) == [("app", 2), ("core", 0), ("lib", 1)]
    cycle = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "src string, dst string")
    assert {r.node: r.level for r in graph.topological_levels(cycle).collect()} == {"a": None, "b": None, "c": 1, "d": 0}


def test_levels_are_the_same_in_one_task_and_in_rounds(spark):
    pairs = [(i * 7 % 9 + 1, i * 7 % 9 - i % 3) for i in range(30)] + [(90, 91), (91, 90), (92, 91), (91, 93), (94, 94)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    alone = rows(graph.topological_levels(e), "node", "level")
    assert alone == rows(graph.topological_levels(e, few=0), "node", "level") == rows(graph.topological_levels(e, few=15), "node", "level")
    assert {n: x for n, x in alone if n > 89} == {90: None, 91: None, 92: None, 93: 0, 94: None}
    assert graph.topological_levels(e.where("src < -99")).count() == 0


def test_far_reach_merges_rounds(spark, monkeypatch):
    chain = spark.range(5).selectExpr("id AS src", "id + 1 AS dst")
    monkeypatch.setattr(graph, "ROUNDS_APART", 2)
    got = graph.affected(chain, spark.createDataFrame([(5,)], "node long"))
    assert rows(got, "node", "distance") == [(i, 5 - i) for i in range(6)]


def test_strong_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (5, 7), (7, 7)], "src long, dst long")
    assert rows(graph.strong_components(e), "node", "component", "size") == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 2), (5, 4, 2)]
    assert graph.strong_components(e.where("src = 6")).count() == 0


def test_reachability(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert rows(graph.reachable(e, seeds)) == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]
    assert rows(graph.affected(e, seeds)) == [(1, 0), (2, 2), (3, 1)]


def test_stability_of_equal_trees_is_one(spark):
    t = spark.createDataFrame([("m1", "a"), ("m1", "b"), ("m2", "c")], "set_id string, item string")
    assert rows(matching.stability(t, t)) == [(1.0, 1.0, 1.0)]
    none = t.where("false")
    assert rows(matching.stability(none, none)) == [(1.0, 1.0, 1.0)]


def test_change_ratio(spark):
    new = spark.createDataFrame([("x", "a", "1"), ("x", "b", "2"), ("x", "c", "3")], "set_id string, item string, hash string")
    old = spark.createDataFrame([("x", "a", "1"), ("x", "b", "9"), ("x", "d", "4"), ("gone", "e", "5")], "set_id string, item string, hash string")
    assert rows(matching.change_ratio(new, old), "set_id", "changed", "size", "ratio") == [("gone", 1, 0, 0.0), ("x", 3, 3, 1.0)]


def test_dominant_match_needs_lead(spark):
    new = spark.createDataFrame([("n", i) for i in range(10)], "set_id string, item int")
    close = spark.createDataFrame([("p", i) for i in range(8)] + [("q", i) for i in range(1, 9)], "set_id string, item int")
    assert rows(matching.dominant_match(new, close)) == []
    clear = spark.createDataFrame([("p", i) for i in range(8)] + [("q", i) for i in range(4)], "set_id string, item int")
    assert rows(matching.dominant_match(new, clear)) == [("n", "p", 0.8)]


def test_tfidf_equals_brute_force(spark):
    import math
    import random

    r = random.Random(1)
    docs = {d: [f"t{min(int(r.expovariate(0.15)), 30)}" for _ in range(12)] for d in range(25)}
    terms = [(d, t, w.count(t)) for d, w in docs.items() for t in set(w)]
    df = {t: sum(x[1] == t for x in terms) for _, t, _ in terms}
    vec = {d: {t: (1 + math.log(n)) * math.log(25 / df[t]) for x, t, n in terms if x == d and df[t] <= 20} for d in docs}
    unit = {d: {t: w / math.sqrt(sum(x * x for x in v.values())) for t, w in v.items()} for d, v in vec.items()}
    want = {(a, b): s for a in docs for b in docs if a < b and (s := sum(w * unit[b].get(t, 0) for t, w in unit[a].items())) >= 0.3}
    got = {(x.a, x.b): x.score for x in matching.tfidf_pairs(spark.createDataFrame(terms, "doc long, term string, n long"), 0.3).collect()}
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-5 for k in want)


def test_headings_anchors_and_links(spark):
    docs = [("a.md", "# X\n\ntext [ok](b.md#y) [bad](c.md) [no](b.md#z) [w](http://x.y)\n\nX\n===\n```\n[code](nope.md)\n```\n## X\n[self](#x-2) [e]()"), ("b.md", "Y\n---\n[up](../a.md)"), ("d/e.md", "[a](../a.md) [here](./e.md)")]
    df = spark.createDataFrame(docs, "file_name string, text string")
    assert rows(documents.anchors(df), "file_name", "anchor") == [("a.md", "x"), ("a.md", "x-1"), ("a.md", "x-2"), ("b.md", "y")]
    assert rows(documents.link_issues(df), "file_name", "target", "issue") == [("a.md", "", "empty_link"), ("a.md", "b.md#z", "anchor_not_found"), ("a.md", "c.md", "file_not_found")]
    assert rows(documents.lint_summary(documents.link_issues(df)), "issue", "n") == [("anchor_not_found", 1), ("empty_link", 1), ("file_not_found", 1)]


def test_formulas_and_blocks(spark):
    df = spark.createDataFrame([("a", "$$x_{1}$$ and $y}$ and `$z$` \n```mermaid\ngraph TD\n```\n")], "file_name string, text string")
    assert rows(documents.formulas(df), "content", "display", "balanced") == [("x_{1}", True, True), ("y}", False, False)]
    assert rows(documents.fenced_blocks(df, "mermaid"), "content") == [("graph TD",)]


def test_text_functions(spark):
    c = F.col
    assert one(spark, text.symbol_file(c("a")), a="py:src/x.py#A.f(method)") == "src/x.py"
    assert one(spark, text.symbol_name(c("a")), a="py:src/x.py#A.f(method)") == "A"
    assert one(spark, text.component_name(c("a")), a="a/b.py::C") == "C"
    assert one(spark, text.identifier_tokens(c("a")), a="parseHTTPResponse_v2") == ["parse", "http", "response", "v2"]
    assert one(spark, text.slug(c("a")), a="Über die Ñ, x!") == "über-die-ñ-x"
    assert one(spark, text.heading_text(c("a")), a="## A [link](x.md) `c` **b** ##") == "A link c b"
    assert one(spark, text.doc_filename(F.array(c("a"), c("b"))), a="Core & API", b="x/y-z") == "core_and_api-x_y_z.md"
    assert one(spark, text.repository_url(c("a")), a="git@GitHub.com:Own/Name.git") == "github.com/own/name"
    assert one(spark, text.truncate_lines(c("a"), 5), a="\n".join("0123456789")) == "0\n1\n2\n... [5 lines omitted] ...\n8\n9"
    assert one(spark, text.tagged(c("a"), "T"), a="x <T> {1} </T>") == "{1}"
    assert one(spark, text.has_cjk(c("a")), a="ab 好") is True
    assert one(spark, text.strip_code_fence(c("a")), a="```json\n{}\n```") == "{}"
    assert [one(spark, text.retry_delay(c("a")), a=n) for n in (1, 3, 9)] == [0.5, 2.0, 32.0]


def test_trees(spark):
    m = spark.createDataFrame([("a", "root", "A"), ("b", "a", "B"), ("c", "a", "C"), ("d", "b", "D")], "module_id string, parent_id string, title string")
    assert rows(trees.paths(m)) == [("a", 1, "A"), ("b", 2, "A/B"), ("c", 2, "A/C"), ("d", 3, "A/B/D")]
    assert rows(trees.heights(m)) == [("a", 2), ("b", 1), ("c", 0), ("d", 0)]
    ratios = spark.createDataFrame([("d", 0.5), ("c", 0.1)], "set_id string, ratio double")
    assert rows(trees.invalidation_plan(m, ratios, m.select("parent_id").where("false")), "module_id", "reason") == [("a", "child_ratio"), ("b", "child_ratio"), ("d", "leaf_ratio")]
    hard = spark.createDataFrame([("a",)], "parent_id string")
    assert rows(trees.invalidation_plan(m, ratios.where("false"), hard), "module_id", "reason") == [("a", "hard_trigger")]


def test_parsers(spark):
    files = spark.createDataFrame([("a.py", "python", "import os\nclass A(B):\n    def f(self):\n        return g()\n"), ("x.ts", "typescript", "export class A extends B {\n  run(): void {\n    go();\n  }\n}\n"), ("b.py", "python", "def ("), ("n", None, None)], "path string, language string, content string")
    assert rows(parsers.symbols(files), "path", "kind", "qualified") == [("a.py", "class", "A"), ("a.py", "method", "A.f"), ("x.ts", "class", "A"), ("x.ts", "method", "A.run")]
    got = {tuple(r) for r in parsers.references(files).select("path", "kind", "target").collect()}
    assert {("a.py", "imports", "os"), ("a.py", "extends", "B"), ("a.py", "calls", "g"), ("x.ts", "extends", "B"), ("x.ts", "calls", "go")} <= got, got


def test_repository_scan_and_store(spark, tmp_path):
    for name, body in (("src/a.py", "x = 1"), ("Makefile", "all:"), ("node_modules/b.js", "1"), ("c.bin", "0"), ("README.md", "# T")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    files = repository.scan_files(spark, str(tmp_path))
    assert rows(files, "path", "language") == [("Makefile", "makefile"), ("src/a.py", "python")]
    assert rows(repository.language_counts(files), "language", "files") == [("makefile", 1), ("python", 1)]
    assert rows(repository.scan_documents(spark, str(tmp_path)), "text") == [("# T",)]
    p = spark.createDataFrame([("src/a.py",), ("tests/a.py",), ("src/b.ts",)], "p string")
    assert rows(p.where(repository.path_filter(F.col("p"), ["*.py"], ["tests"]))) == [("src/a.py",)]
    repository.save(p, f"{tmp_path}/store", "k1")
    assert repository.load(spark, f"{tmp_path}/store", "k1").count() == 3
    assert repository.load(spark, f"{tmp_path}/store", "k2") is None and repository.load(spark, f"{tmp_path}/none", "k1") is None


def test_registry_stream_equals_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    data = [(i % 7, i, t0 + timedelta(minutes=i), ["missing", "running", "valid", "failed", "stale"][i * i % 5]) for i in range(60)]
    events = spark.createDataFrame(data, "artifact_id long, event_id long, ts timestamp, status string")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    registry.run_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert rows(registry.read_registry(spark, f"{tmp_path}/out")) == rows(registry.latest(events))
    assert rows(registry.on_load(registry.latest(events)).where("status = 'running'")) == []


def test_identities_are_given_in_order(spark):
    from tesserae.operators import context

    o = spark.createDataFrame([(1, "a", "x", 0.9), (1, "a", "y", 0.8), (2, "b", "x", 0.95), (2, "b", "y", 0.75), (3, "c", "y", 0.99), (3, "c", "z", 0.7), (4, "d", "z", 0.5)], "ord int, new_id string, old_id string, overlap double")
    assert rows(context.assign_identities(o), "new_id", "old_id") == [("a", "x"), ("b", "y"), ("c", "z")]


def test_layered_budget_takes_ends_first(spark):
    from tesserae.operators import context

    p = spark.createDataFrame([("g", 1, 0, 4), ("g", 1, 1, 9), ("g", 1, 2, 4), ("g", 2, 0, 4), ("g", 2, 1, 2)], "grp string, doc int, idx int, size int")
    assert rows(context.layered_budget(p, 15), "kept", "used") == [(4, 14)]


def test_small_context_functions(spark):
    from tesserae.operators import context

    c = spark.createDataFrame([("a", "int* p = new int; free(p);"), ("b", "malloc(3)"), ("c", "x")], "component_id string, source string")
    assert rows(context.ownership(c), "component_id", "leak_risk") == [("a", False), ("b", True)]
    s = spark.createDataFrame([("f(A, B[T], k=v, *x)",), ("class X extends Y",)], "s string")
    assert sorted(r[0] for r in s.select(context.base_classes(F.col("s"))).collect()) == [["A", "B"], ["Y"]]
    t = context.test_files(spark.createDataFrame([("t/test_a.py",), ("b.spec.ts",), ("z.py",)], "path string"), spark.createDataFrame([(1, "src/a.py"), (2, "src/b.ts")], "component_id long, file_path string"))
    assert rows(t) == [(1, "t/test_a.py"), (2, "b.spec.ts")]
    assert spark.range(1).select(context.progress(F.lit(1.0), F.lit(4.0), F.lit(10.0)).alias("p")).select("p.*").first() == (0.25, 30.0)
    assert spark.range(1).select(context.is_entry_point(F.lit("a/main.py")), context.is_entry_point(F.lit("a/x.py"))).first() == (True, False)


def test_graph_views_read_whole_tables(spark):
    import duckdb

    from tesserae.sources.tables import view

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    step = f"(SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax) AS b FROM '{d}/lineitem.parquet')"
    assert view(spark, d, "v_edge").count() == con.sql(f"SELECT count(*) FROM {step} WHERE b IN (SELECT p_partkey FROM '{d}/part.parquet')").fetchall()[0][0]
    assert view(spark, d, "v_digraph").count() == con.sql(f"SELECT count(DISTINCT (a, b)) FROM {step} WHERE a <> b").fetchall()[0][0]
    assert view(spark, d, "v_dag").count() == con.sql(f"SELECT count(DISTINCT (least(a, b), greatest(a, b))) FROM {step} WHERE a <> b").fetchall()[0][0]


def test_healing_compares_with_every_known_name(spark):
    import random

    from tesserae.operators.context import heal_names

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    r = random.Random(7)
    known = ["steel ring bolt", "é"] + ["".join(r.choice("ab c") for _ in range(r.randrange(1, 30))) for _ in range(60)]
    names = ["xteel ring bolt", "teel ring bolt", "a steel ring bolt", "zzz"]
    for k in known:
        w = list(k)
        for _ in range(r.randrange(5)):
            at = r.randrange(len(w) + 1)
            w[at : at + r.randrange(2)] = r.choice(["", "q", "a"])
        names.append("".join(w))
    got = {x.name: (x.component_id, x.how) for x in heal_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(list(enumerate(known)), "component_id long, name string")).collect()}
    assert got["xteel ring bolt"] == got["teel ring bolt"] == got["a steel ring bolt"] == (0, "similar")
    for n in names:
        if got[n][1] in ("similar", "none"):
            s = [(-(1 - distance(n, k) / max(len(n), len(k), 1)), i) for i, k in enumerate(known)]
            best = min(x for x in s)
            assert got[n] == ((best[1], "similar") if -best[0] >= 0.85 else (None, "none")), n


def test_first_sentence_keeps_abbreviations(spark):
    from tesserae.functions.text import definition, first_sentence

    texts = ["Use e.g. this one. Not that.", "Ask Dr. Who? Yes.", " One line", "", "See Fig. 3 vs. Fig. 4! Next", "a.b stays. c"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "i int, t string")
    got = {r.i: (r.s, r.d) for r in rows.select("i", first_sentence(F.col("t")).alias("s"), definition(F.col("t"), F.lit("class"), F.lit("a.py")).alias("d")).collect()}
    assert [got[i][0] for i in range(6)] == ["Use e.g. this one.", "Ask Dr. Who?", "One line", "", "See Fig. 3 vs. Fig. 4!", "a.b stays."]
    assert got[2][1] == "One line. (class, a.py)" and got[3][1] == got[9][1] == "(class, a.py)"


def test_calls_prefer_file_and_class(spark):
    from tesserae.operators.resolution import resolve_calls

    fns = [("f1", "m.A.go", "go", "m", "A", 1), ("f2", "n.A.go", "go", "n", "A", 2), ("f3", "n.B.go", "go", "n", "B", 3), ("f4", "n.run", "run", "n", None, 4), ("f5", "k.run", "run", "k", "B", 5)]
    functions = spark.createDataFrame(fns, "func_id string, component_id string, name string, file_path string, class_name string, ord int")
    calls = spark.createDataFrame([("f5", "go"), ("f2", "go"), ("f4", "go"), ("zz", "go"), ("f1", "self.run"), ("f1", "n.B.go"), ("f1", "no.such"), ("f1", None)], "caller string, callee string")
    got = {(r.caller, r.callee): (r.target, r.how) for r in resolve_calls(calls, functions).collect()}
    assert got == {("f5", "go"): ("f3", "class"), ("f2", "go"): ("f2", "file_and_class"), ("f4", "go"): ("f2", "file"), ("zz", "go"): ("f1", "first"), ("f1", "self.run"): ("f4", "first"), ("f1", "n.B.go"): ("f3", "exact"), ("f1", "no.such"): (None, "unresolved"), ("f1", None): (None, "unresolved")}


def test_path_tokens(spark):
    from tesserae.operators.packs import path_tokens

    rows = spark.createDataFrame([("src/My-Part_one.test.py",), ("a\\b/.env",), ("",)], "p string").select(path_tokens(F.col("p")).alias("t")).collect()
    assert [sorted(r.t) for r in rows] == [["my", "one.test", "part"], [".env", "a", "b"], []]


def test_links_are_put_right(spark):
    from tesserae.operators import rewriting

    text = "[a](../My File.html#x) `[a](no.md)` [b](gone.md) [c](my_file.md)\n```\n[d](gone.md)\n```\n[e](http://x) [f](#y) [g](two.md)[h](dir/)\n"
    docs = [("my_file.md", text), ("one-two.md", "[p](one/two.md) [q](ONE_TWO.md#z)"), ("Two.md", "plain"), ("two.md", None), ("empty.md", "")]
    got = {r.file_name: (r.text, r.rewritten, r.removed) for r in rewriting.rewrite_links(spark.createDataFrame(docs, "file_name string, text string")).collect()}
    assert got["my_file.md"] == ("[a](my_file.md#x) `[a](no.md)` b [c](my_file.md)\n```\n[d](gone.md)\n```\n[e](http://x) [f](#y) g[h](dir/)\n", 1, 2)
    assert got["one-two.md"] == ("[p](one-two.md) [q](one-two.md#z)", 2, 0)
    assert got["Two.md"] == ("plain", 0, 0) and got["two.md"] == (None, 0, 0) and got["empty.md"] == ("", 0, 0)
    assert rewriting.rewrite_links(spark.createDataFrame([], "file_name string, text string")).count() == 0


def test_formulas_are_cleaned(spark):
    from tesserae.operators import rewriting

    given = "\x08eta + \x08ar \\left ceil x \\right  ceil \\left floor y \\right floor z^2^3"
    wanted = "\\beta + \\bar \\left\\lceil x \\right\\rceil \\left\\lfloor y \\right\\rfloor z^{2}^{3}"
    assert one(spark, rewriting.clean_formula(F.col("a")), a=given) == wanted


def test_sources_of_shared_base_names_are_paired_once_without_a_shuffle_of_pairs(spark):
    """the pairs are distinct as they are made; nothing above the join shuffles."""
    from tesserae.operators.resolution import sources_by_basename

    wanted = spark.createDataFrame([(1, "a/x.c"), (1, "y.c"), (1, "q/x.c"), (2, "x.c"), (3, None), (None, "x.c")], "component_id long, source string")
    files = spark.createDataFrame([(1, "s/x.c"), (4, "s/x.c"), (4, "t/y.c"), (4, "x.c"), (5, "y.c"), (2, "z.c"), (6, None), (None, "x.c")], "component_id long, file_path string")
    out = sources_by_basename(wanted, files)
    assert sorted(map(tuple, out.collect())) == [(1, 4), (1, 5), (2, 1), (2, 4)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan[: plan.index("Join")] and "Distinct" not in plan


def test_lines_meet_one_range_of_each_size_of_block(spark):
    """the smallest range is found as by a look at all, and a line of a file with many ranges meets few of them."""
    import random

    from tesserae.operators.edges import enclosing

    r = random.Random(4)
    ranges = [(r.choice("ab"), i, f := r.randrange(-40, 300), f + r.choice([0, 1, 5, 5, 40, 300, -2])) for i in range(300)] + [("c", 900, -(1 << 40), 1 << 40), (None, 901, 1, 2), ("a", 902, None, 5), ("b", 903, 7, 7), ("b", 904, 7, 7)]
    points = [(f, line) for f in "abcd" for line in (-41, -40, -1, 0, 7, 64, 255, 256, 301, 640)] * 2 + [(None, 1), ("a", None)]
    p = spark.createDataFrame(points, "file string, line long")
    out = enclosing(p, spark.createDataFrame(ranges, "file string, symbol_id long, first long, last long"))
    around = lambda f, n: min(((z - a, s) for g, s, a, z in ranges if None not in (f, n, g, a) and g == f and a <= n <= z), default=(0, None))[1]
    key = lambda x: tuple((v is not None, v if v is not None else 0) if not isinstance(v, str) else (True, v) for v in x)
    assert sorted(((str(x.file), key((x.line,)), x.symbol_id) for x in out.collect()), key=str) == sorted(((str(f), key((n,)), around(f, n)) for f, n in points), key=str)
    assert [f.name for f in out.schema] == ["file", "line", "symbol_id"]
    many = spark.range(50_000).select(F.lit("a").alias("file"), F.col("id").alias("symbol_id"), (F.col("id") % 5).alias("first"), (F.col("id") + 100).alias("last")).coalesce(1)
    lines = enclosing(spark.range(100).select(F.lit("a").alias("file"), F.col("id").alias("line")), many)
    assert lines.where("symbol_id is null").count() == 0
    joins = [x for x in lines._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and not any("<=" in x for x in joins)


def test_levels_write_edges_only_when_half_are_gone(spark, monkeypatch):
    """a graph of many levels writes its edges some times, not once a level."""
    wrote, real = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: wrote.append(df.columns) or real(df))
    chain = spark.createDataFrame([(i + 1, i) for i in range(12)] + [(12, 0), (20, 21), (21, 20), (22, 20)], "src long, dst long")
    assert {r.node: r.level for r in graph.topological_levels(chain, few=0).collect()} == {**{i: i for i in range(13)}, 20: None, 21: None, 22: None}
    assert sum(c == ["src", "dst"] for c in wrote) <= 4
