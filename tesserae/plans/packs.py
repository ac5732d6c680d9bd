"""Queries on name resolution, context packs and plans, registered beside those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import packs as P
from ..operators import resolution as N
from ..operators import rewriting as L
from ..sources.tables import read, view
from .catalog import query

_FUNCTIONS = "fn AS (SELECT concat('f', p_partkey) AS func_id, concat(p_brand, '.', p_name) AS component_id, p_container AS name, p_brand AS file_path, CASE WHEN p_size % 3 > 0 THEN p_mfgr END AS class_name, p_partkey AS ord FROM v_part)"
_CALLS = "ca AS (SELECT DISTINCT concat('f', l_partkey) AS caller, CASE l_linenumber % 5 WHEN 0 THEN concat('f', l_suppkey) WHEN 1 THEN p_container WHEN 2 THEN concat('self.', p_container) WHEN 3 THEN concat('x.', p_name) ELSE 'y.none' END AS callee FROM lineitem JOIN v_part ON p_partkey = l_suppkey)"


def _functions(s, d):
    p = view(s, d, "v_part")
    return p.select(F.concat(F.lit("f"), "p_partkey").alias("func_id"), F.concat_ws(".", "p_brand", "p_name").alias("component_id"), F.col("p_container").alias("name"), F.col("p_brand").alias("file_path"), F.when(F.col("p_size") % 3 > 0, F.col("p_mfgr")).alias("class_name"), F.col("p_partkey").alias("ord"))


def _named_calls(s, d):
    l, p, k = read(s, d, "lineitem"), view(s, d, "v_part"), F.col("l_linenumber") % 5  # noqa: E741
    callee = F.when(k == 0, F.concat(F.lit("f"), "l_suppkey")).when(k == 1, F.col("p_container")).when(k == 2, F.concat(F.lit("self."), "p_container")).when(k == 3, F.concat(F.lit("x."), "p_name")).otherwise("y.none")
    return l.join(p, F.col("p_partkey") == F.col("l_suppkey")).select(F.concat(F.lit("f"), "l_partkey").alias("caller"), callee.alias("callee")).distinct()


@query(f"""{_FUNCTIONS}, {_CALLS}, ids AS (SELECT func_id AS k, func_id, ord FROM fn UNION SELECT component_id, func_id, ord FROM fn), ex AS (SELECT k, arg_max(func_id, ord) AS id FROM ids GROUP BY 1),
nm AS (SELECT func_id, name AS bare FROM fn UNION SELECT func_id, string_split(component_id, '.')[-1] FROM fn),
w AS (SELECT ca.*, CASE WHEN callee IN (SELECT bare FROM nm) THEN callee WHEN contains(callee, '.') THEN string_split(callee, '.')[-1] END AS bare, f.file_path, f.class_name FROM ca LEFT JOIN fn f ON f.func_id = ca.caller),
c AS (SELECT w.caller, w.callee, g.func_id, g.ord, CASE WHEN g.file_path = w.file_path AND g.class_name = w.class_name THEN 0 WHEN g.file_path = w.file_path THEN 1 WHEN g.class_name = w.class_name THEN 2 ELSE 3 END AS tier FROM w JOIN nm USING (bare) JOIN fn g ON g.func_id = nm.func_id),
b AS (SELECT caller, callee, func_id, tier FROM c QUALIFY row_number() OVER (PARTITION BY caller, callee ORDER BY tier, ord) = 1)
SELECT ca.caller, ca.callee, coalesce(ex.id, b.func_id) AS target, CASE WHEN ex.id IS NOT NULL THEN 'exact' ELSE coalesce(['file_and_class', 'file', 'class', 'first'][tier + 1], 'unresolved') END AS how
FROM ca LEFT JOIN ex ON ex.k = ca.callee LEFT JOIN b ON b.caller = ca.caller AND b.callee = ca.callee""", "v_part")
def call_resolution(s, d):
    return N.resolve_calls(_named_calls(s, d), _functions(s, d))


@query(f"""{_FUNCTIONS}, {_CALLS}, rel AS (SELECT DISTINCT f.file_path || ':' || f.name AS caller, callee FROM ca JOIN fn f ON f.func_id = ca.caller UNION SELECT f.component_id, callee FROM ca JOIN fn f ON f.func_id = ca.caller),
k AS (SELECT component_id AS key, component_id, ord, 0 AS l FROM fn UNION ALL SELECT file_path || ':' || name, component_id, ord, 1 FROM fn), i AS (SELECT key, arg_max(component_id, ord * 2 + l) AS id FROM k GROUP BY 1),
nm AS (SELECT component_id, ord, name AS n FROM fn UNION SELECT component_id, ord, string_split(component_id, '.')[-1] FROM fn), n AS (SELECT n, arg_min(component_id, ord) AS id FROM nm GROUP BY 1)
SELECT DISTINCT a.id AS component_id, coalesce(b.id, n.id) AS depends_on FROM rel JOIN i a ON a.key = caller LEFT JOIN i b ON b.key = callee LEFT JOIN n ON n.n = callee WHERE coalesce(b.id, n.id) IS NOT NULL""", "v_part")
def depends_on(s, d):
    f, c = _functions(s, d), _named_calls(s, d)
    both = c.join(f.select(F.col("func_id").alias("caller"), "component_id", "file_path", "name"), "caller")
    rel = both.select(F.explode(F.array(F.concat_ws(":", "file_path", "name"), F.col("component_id"))).alias("caller"), "callee")
    return N.dependencies(rel, f)


_CHAIN = """im AS (SELECT p_brand AS file_path, p_partkey AS ord, CASE WHEN p_size % 7 > 0 THEN p_type END AS resolved_path, string_split(p_name, ' ') AS names, CASE WHEN p_size % 2 = 0 THEN p_container END AS alias FROM v_part),
sy AS (SELECT p_partkey AS symbol_id, p_type AS file_path, string_split(p_name, ' ')[1] AS name, p_mfgr AS parent, p_partkey AS ord FROM v_part), sf AS (SELECT file_path, name, arg_min(symbol_id, ord) AS id FROM sy GROUP BY 1, 2),
vi AS (SELECT file_path, resolved_path, ord, 0 AS kind, unnest(names) AS name, CAST(NULL AS VARCHAR) AS original FROM im UNION ALL SELECT file_path, resolved_path, ord, 1, alias, names[1] FROM im WHERE alias IS NOT NULL),
iv AS (SELECT vi.file_path, vi.name, arg_min(id, ord * 2 + kind) AS symbol_id FROM vi JOIN sf ON sf.file_path = resolved_path AND sf.name = coalesce(original, vi.name) GROUP BY 1, 2)"""


def _imports(s, d):
    return view(s, d, "v_part").select(F.col("p_brand").alias("file_path"), F.col("p_partkey").alias("ord"), F.when(F.col("p_size") % 7 > 0, F.col("p_type")).alias("resolved_path"), F.split("p_name", " ").alias("imported_names"), F.when(F.col("p_size") % 2 == 0, F.col("p_container")).alias("alias"))


def _import_symbols(s, d):
    return view(s, d, "v_part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_type").alias("file_path"), F.split("p_name", " ")[0].alias("name"), F.col("p_mfgr").alias("parent"), F.col("p_partkey").alias("ord"))


@query(f"{_CHAIN} SELECT * FROM iv", "v_part")
def import_chain(s, d):
    return N.imported_names(_imports(s, d), _import_symbols(s, d))


def _scoped(order):
    """The oracle: calls of a file by its own object (every third) or by name, each way in turn."""
    ways = {"parent": "(SELECT min(symbol_id) FROM sy WHERE sy.file_path = c.file_path AND sy.parent = c.parent AND sy.name = c.callee)", "import": "CASE WHEN c.parent IS NULL THEN (SELECT min(symbol_id) FROM iy WHERE iy.file_path = c.file_path AND iy.name = c.callee) END", "file": "CASE WHEN c.parent IS NULL THEN (SELECT min(symbol_id) FROM sy WHERE sy.file_path = c.file_path AND sy.name = c.callee) END", "global": "CASE WHEN c.parent IS NULL THEN (SELECT min(symbol_id) FROM sy WHERE sy.name = c.callee) END"}
    cols = ", ".join(f"{ways[w]} AS {w}_id" for w in order)
    return f"""sy AS (SELECT p_partkey AS symbol_id, p_type AS file_path, string_split(p_name, ' ')[1] AS name, p_mfgr AS parent FROM v_part), iy AS (SELECT p_type AS file_path, string_split(p_name, ' ')[2] AS name, min(p_partkey) AS symbol_id FROM v_part WHERE p_size % 2 = 0 GROUP BY 1, 2),
c AS (SELECT p_partkey AS call_id, p_type AS file_path, CASE WHEN p_partkey % 3 = 0 THEN p_mfgr END AS parent, string_split(p_name, ' ')[p_partkey % 2 + 1] AS callee FROM v_part), r AS (SELECT c.*, {cols} FROM c)
SELECT call_id, file_path, parent, callee, coalesce({', '.join(f'{w}_id' for w in order)}) AS target, CASE {' '.join(f"WHEN {w}_id IS NOT NULL THEN '{w}'" for w in order)} ELSE 'unresolved' END AS how FROM r"""


def _member_calls(s, d, order):
    p = view(s, d, "v_part")
    word = lambda i: F.get(F.split("p_name", " "), i)
    calls = p.select(F.col("p_partkey").alias("call_id"), F.col("p_type").alias("file_path"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_mfgr")).alias("parent"), word((F.col("p_partkey") % 2).cast("int")).alias("callee"))
    imported = p.where("p_size % 2 = 0").groupBy(F.col("p_type").alias("file_path"), word(F.lit(1)).alias("name")).agg(F.min("p_partkey").alias("symbol_id"))
    return N.resolve_scoped(calls, _import_symbols(s, d), imported, order)


@query(_scoped(("parent", "file", "import", "global")), "v_part")
def member_calls_file_first(s, d):
    return _member_calls(s, d, ("parent", "file", "import", "global"))


@query(_scoped(("parent", "import", "file")), "v_part")
def member_calls_import_first(s, d):
    return _member_calls(s, d, ("parent", "import", "file"))


@query("""sy AS (SELECT p_partkey AS symbol_id, p_type AS file_path, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_container END AS name FROM v_part), co AS (SELECT p_partkey AS component_id, p_type AS file_path, p_name AS name FROM v_part WHERE p_size % 2 = 0)
SELECT symbol_id, coalesce((SELECT max(component_id) FROM co WHERE co.file_path = sy.file_path AND co.name = sy.name), (SELECT CASE WHEN count(*) = 1 THEN min(component_id) END FROM co WHERE co.file_path = sy.file_path)) AS component_id FROM sy""", "v_part")
def symbol_components(s, d):
    p = view(s, d, "v_part")
    symbols = p.select(F.col("p_partkey").alias("symbol_id"), F.col("p_type").alias("file_path"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.col("p_container")).alias("name"))
    return N.symbol_components(symbols, p.where("p_size % 2 = 0").select(F.col("p_partkey").alias("component_id"), F.col("p_type").alias("file_path"), F.col("p_name").alias("name")))


@query("SELECT DISTINCT a.p_partkey AS component_id, b.p_partkey AS depends_on FROM v_part a JOIN v_part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey WHERE a.p_size = 1", "v_part")
def sources_by_basename(s, d):
    p = view(s, d, "v_part")
    wanted = p.where("p_size = 1").select(F.col("p_partkey").alias("component_id"), F.concat(F.lit("a/b/"), "p_brand").alias("source"))
    return N.sources_by_basename(wanted, p.select(F.col("p_partkey").alias("component_id"), F.concat_ws("/", "p_type", "p_brand").alias("file_path")))


def _dirs(s, d):
    return view(s, d, "v_component").select("component_id", F.col("top_dir").alias("module_id"))


@query("e AS (SELECT DISTINCT top_dir AS module_id, ev_file, ev_line, edge_type FROM v_edge JOIN v_component ON component_id = from_id) SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY module_id ORDER BY ev_file, ev_line, edge_type) <= 20", "v_edge", "v_component")
def evidence_snippets(s, d):
    return P.evidence(view(s, d, "v_edge"), _dirs(s, d))


@query("""u AS (SELECT DISTINCT b.top_dir AS module_id, from_id, to_id FROM v_edge JOIN v_component a ON a.component_id = from_id JOIN v_component b ON b.component_id = to_id WHERE a.top_dir <> b.top_dir),
c AS (SELECT DISTINCT module_id, from_id FROM u), r AS (SELECT module_id, from_id, CASE WHEN p_size % 10 = 0 THEN 'tests/' ELSE 'src/' END || p_brand AS path, p_name FROM c JOIN v_part ON p_partkey = from_id WHERE p_container <> 'C3'),
t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY module_id ORDER BY path NOT LIKE 'tests/%', path, from_id) <= 4)
SELECT t.module_id, t.from_id AS component_id, path, string_agg(CAST(to_id AS VARCHAR), ',' ORDER BY to_id) AS calls, any_value(substr(p_name, 1, 12)) AS snippet, any_value(length(p_name) > 12) AS truncated FROM t JOIN u ON u.module_id = t.module_id AND u.from_id = t.from_id GROUP BY 1, 2, 3""", "v_edge", "v_component", "v_part")
def usage_examples(s, d):
    c = view(s, d, "v_part").select(F.col("p_partkey").alias("component_id"), F.concat(F.when(F.col("p_size") % 10 == 0, "tests/").otherwise("src/"), "p_brand").alias("path"), F.when(F.col("p_container") == "C3", "").otherwise(F.col("p_name")).alias("source"))
    return P.usage_examples(view(s, d, "v_edge"), _dirs(s, d), c, chars=12).withColumn("calls", F.array_join("calls", ","))


@query("""p AS (SELECT DISTINCT from_id, to_id FROM v_edge WHERE to_id IS NOT NULL) SELECT from_id AS component_id, count(*) FILTER (WHERE a.top_dir = b.top_dir) AS "inner", count(*) FILTER (WHERE a.top_dir <> b.top_dir) AS "outer" FROM p JOIN v_component a ON a.component_id = from_id JOIN v_component b ON b.component_id = to_id GROUP BY 1""", "v_edge", "v_component")
def dependency_sides(s, d):
    return P.dependency_sides(view(s, d, "v_edge"), _dirs(s, d))


@query("""p AS (SELECT DISTINCT from_id, to_id FROM v_edge JOIN v_component a ON a.component_id = from_id JOIN v_component b ON b.component_id = to_id WHERE a.top_dir = b.top_dir), n AS (SELECT from_id AS c FROM p UNION SELECT to_id FROM p)
SELECT c AS component_id, coalesce((SELECT string_agg(CAST(to_id AS VARCHAR), ',' ORDER BY to_id) FROM p WHERE from_id = c), '') AS calls, coalesce((SELECT string_agg(CAST(from_id AS VARCHAR), ',' ORDER BY from_id) FROM p WHERE to_id = c), '') AS called_by FROM n""", "v_edge", "v_component")
def call_lists(s, d):
    return P.call_lists(view(s, d, "v_edge"), _dirs(s, d)).select("component_id", F.array_join("calls", ",").alias("calls"), F.array_join("called_by", ",").alias("called_by"))


@query("""f AS (SELECT DISTINCT p_mfgr AS module_id, lower(p_type || '/src/' || p_brand || '.py') AS path FROM v_part), e AS (SELECT s_name AS key, lower(p_type || '/src/' || p_brand || '.py') AS path, lower(s_name) AS name FROM supplier JOIN v_part ON p_partkey = s_suppkey),
g AS (SELECT DISTINCT module_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM f), mt AS (SELECT DISTINCT module_id, unnest(string_split(replace(replace(replace(replace(path, '/src/', '/'), '.py', ''), '-', '_'), '/', '_'), '_')) AS w FROM f), m AS (SELECT DISTINCT module_id, unnest(string_split(w, ' ')) AS t FROM mt),
et AS (SELECT key, unnest(string_split(replace(replace(replace(replace(path, '/src/', '/'), '.py', ''), '-', '_'), '/', '_'), '_')) AS w FROM e UNION SELECT key, name FROM e WHERE name NOT LIKE '%.%' AND name NOT LIKE '%-%'), t AS (SELECT DISTINCT key, unnest(string_split(w, ' ')) AS t FROM et),
x AS (SELECT DISTINCT module_id, key, 10 AS points FROM e JOIN f USING (path) UNION ALL SELECT DISTINCT module_id, key, 6 FROM e JOIN g ON starts_with(path, folder || '/') UNION ALL SELECT module_id, key, count(*) FROM t JOIN m USING (t) WHERE t.t <> '' GROUP BY 1, 2)
SELECT module_id, key, CAST(sum(points) AS BIGINT) AS score FROM x GROUP BY 1, 2""", "v_part")
def link_relevance(s, d):
    p = view(s, d, "v_part")
    at = F.concat("p_type", F.lit("/src/"), "p_brand", F.lit(".py"))
    entries = read(s, d, "supplier").join(p, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_name").alias("key"), at.alias("source_path"))
    return P.link_relevance(entries, p.select(F.col("p_mfgr").alias("module_id"), at.alias("file_path")))


@query("""m AS (SELECT p_partkey AS component_id, p_mfgr AS module_id FROM v_part), n AS (SELECT module_id, count(*) AS n FROM m GROUP BY 1 HAVING count(*) > 30), p AS (SELECT DISTINCT from_id, to_id FROM v_edge WHERE to_id IS NOT NULL),
g AS (SELECT b.module_id, to_id, count(*) AS d FROM p JOIN m a ON a.component_id = from_id JOIN m b ON b.component_id = to_id WHERE a.module_id = b.module_id GROUP BY 1, 2)
SELECT module_id, component_id, in_degree FROM (SELECT m.module_id, m.component_id, n, coalesce(d, 0) AS in_degree, row_number() OVER (PARTITION BY m.module_id ORDER BY coalesce(d, 0) DESC, m.component_id) AS r FROM m JOIN n USING (module_id) LEFT JOIN g ON g.module_id = m.module_id AND g.to_id = m.component_id) WHERE r <= greatest(n // 10, 50)""", "v_edge", "v_part")
def core_components(s, d):
    return P.core_components(view(s, d, "v_edge"), view(s, d, "v_part").select(F.col("p_partkey").alias("component_id"), F.col("p_mfgr").alias("module_id")), more_than=30)


@query("SELECT (SELECT count(*) FROM v_part) AS functions, (SELECT count(DISTINCT p_mfgr) FROM v_part) AS languages, count(*) AS calls, count(*) - count(to_id) AS unresolved, round(count(to_id) / count(*), 6) AS resolved_share FROM v_edge", "v_edge", "v_part")
def call_graph_summary(s, d):
    return P.call_graph_summary(view(s, d, "v_part").withColumnRenamed("p_mfgr", "language"), view(s, d, "v_edge"))


@query("r AS (SELECT conv_id, min(model) AS a, max(model) AS b, sum(chars) AS t FROM v_usage GROUP BY 1) SELECT '*' AS model, count(*) AS runs, CAST(sum(t) AS BIGINT) AS tokens FROM r UNION ALL SELECT a, count(*), CAST(sum(t) AS BIGINT) FROM r WHERE a = b GROUP BY 1", "v_usage")
def usage_attribution(s, d):
    return P.usage_attribution(view(s, d, "v_usage").select(F.col("conv_id").alias("run_id"), "model", F.col("chars").alias("tokens")))


@query("""z AS (SELECT p_mfgr AS tree, p_type AS module_id, count(*) AS n FROM v_part GROUP BY 1, 2), t AS (SELECT tree, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS components, max(n) AS largest FROM z GROUP BY 1), g AS (SELECT *, greatest(1, CAST(round_even(sqrt(components / 4), 0) AS BIGINT)) AS target FROM t)
SELECT tree, clusters, components, largest, clusters < CASE WHEN components >= 30 THEN greatest(6, target // 2) ELSE 1 END AND components >= 30 AS too_few, largest > greatest(30, floor(components / target * 1.5)) AS too_large FROM g""", "v_part")
def cluster_issues(s, d):
    return P.cluster_issues(view(s, d, "v_part").select(F.col("p_mfgr").alias("tree"), F.col("p_type").alias("module_id"), F.col("p_partkey").alias("component_id")))


@query("m AS (SELECT top_dir AS module_id, count(*) AS components, count(DISTINCT file_path) AS files FROM v_component GROUP BY 1) SELECT module_id, CAST(length(module_id) % 4 AS INTEGER) AS depth, components, files, files > 1 AS is_complex FROM m WHERE length(module_id) % 4 < 3 AND components >= 3 AND files >= 2", "v_component")
def split_candidates(s, d):
    c = view(s, d, "v_component")
    modules = c.select(F.col("top_dir").alias("module_id")).distinct().withColumn("depth", F.length("module_id") % 4)
    return P.split_candidates(modules, c.select(F.col("top_dir").alias("module_id"), "component_id", "file_path"), 3, 3, 2)


@query("""p AS (SELECT DISTINCT from_id, to_id FROM v_edge WHERE to_id IS NOT NULL), x AS (SELECT from_id, to_id, a.p_mfgr = b.p_mfgr AS w, a.p_mfgr = b.p_mfgr AND a.p_brand <> b.p_brand AS z FROM p JOIN v_part a ON a.p_partkey = from_id JOIN v_part b ON b.p_partkey = to_id),
r AS (SELECT from_id AS c, 0 AS i, CAST(w AS INT) AS o, CAST(NOT w AS INT) AS x, z FROM x UNION ALL SELECT to_id, 1, 0, 0, z FROM x WHERE w) SELECT c AS component_id, CAST(sum(i) AS BIGINT) AS inbound, CAST(sum(o) AS BIGINT) AS outbound, CAST(sum(x) AS BIGINT) AS external, bool_or(z) AS "cross" FROM r GROUP BY 1""", "v_edge", "v_part")
def cross_child(s, d):
    return P.cross_child(view(s, d, "v_edge"), view(s, d, "v_part").select(F.col("p_partkey").alias("component_id"), F.col("p_brand").alias("child_id"), F.col("p_mfgr").alias("parent_id")))


@query("SELECT l.o_orderkey AS path, CAST(l.o_totalprice AS DOUBLE) AS mtime FROM orders l LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 > 0 WHERE c_custkey IS NULL OR abs(CAST(l.o_totalprice AS DOUBLE) - CAST(c_acctbal AS DOUBLE)) > 100000")
def user_modified(s, d):
    o, c = read(s, d, "orders"), read(s, d, "customer").where("c_custkey % 3 > 0")
    stamps = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("path"), F.col("c_acctbal").cast("double").alias("stamp"))
    return P.user_modified(o.select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").cast("double").alias("mtime")), stamps, 100000.0)


@query("SELECT c_custkey AS path, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def orphan_artifacts(s, d):
    return P.orphans(read(s, d, "customer").select(F.col("c_custkey").alias("path"), "c_name"), read(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("path")))


@query("SELECT p_container AS output_file, count(DISTINCT p_brand) AS artifacts FROM v_part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1", "v_part")
def output_collisions(s, d):
    return P.output_collisions(view(s, d, "v_part").select(F.col("p_container").alias("output_file"), F.col("p_brand").alias("artifact_id")))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'completed' END AS status FROM orders WHERE o_orderstatus <> 'O' AND CAST(o_orderdate AS TIMESTAMP) < TIMESTAMP '1996-01-01 00:00:00' - INTERVAL 72 HOUR")
def expired_jobs(s, d):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "running").otherwise("completed")
    return P.expired_jobs(read(s, d, "orders").select("o_orderkey", status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("ts")), F.lit("1996-01-01 00:00:00").cast("timestamp"), 72).select("o_orderkey", "status")


_HIDDEN = "trim(coalesce(text, ''), chr(32))"
for _short in T.ABBREVIATIONS:  # one replacement after the other, as many as there are abbreviations
    _HIDDEN = f"replace({_HIDDEN}, '{_short}', '{_short}'.replace('.', chr(1)))"


@query(rf"""WITH h AS (SELECT doc_id, lang, source, {_HIDDEN} AS t FROM documents), s AS (SELECT *, trim(regexp_split_to_array(t, '([.!?])\s+')[1], chr(32)) AS head FROM h),
g AS (SELECT *, CASE WHEN length(t) > length(head) AND regexp_matches(substr(t, length(head) + 1, 1), '[.!?]') THEN head || substr(t, length(head) + 1, 1) ELSE head END AS r FROM s), f AS (SELECT *, replace(r, chr(1), '.') AS f FROM g)
SELECT doc_id, trim(CASE WHEN f = '' OR regexp_matches(f, '[.!?]$') THEN f ELSE f || '.' END || ' (' || lang || ', ' || source || ')', chr(32)) AS definition FROM f""")
def glossary_definitions(s, d):
    return read(s, d, "documents").select("doc_id", T.definition(F.col("text"), F.col("lang"), F.col("source")).alias("definition"))


@query(r"""f AS (SELECT DISTINCT replace(p_name, ' ', '-') || '.md' AS name FROM v_part WHERE p_size % 3 > 0), n AS (SELECT name, regexp_replace(replace(replace(lower(name), '-', '_'), ' ', '_'), '_+', '_', 'g') AS f FROM f),
w AS (SELECT p_partkey AS key, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN upper(replace(p_name, ' ', '_')) ELSE 'moved_' || p_name END || '.md' AS canonical, string_split(p_name, ' ')[-1] || '.md' AS leaf FROM v_part), v AS (SELECT *, regexp_replace(replace(replace(replace(lower(canonical), '.MD', '.md'), '-', '_'), ' ', '_'), '_+', '_', 'g') AS f FROM w),
x AS (SELECT key, (SELECT min(name) FROM f WHERE f.name = canonical) AS a, (SELECT min(name) FROM n WHERE n.f = v.f) AS b, (SELECT min(name) FROM n WHERE ends_with(n.f, leaf)) AS c FROM v)
SELECT key, coalesce(a, b, c) AS name, CASE WHEN a IS NOT NULL THEN 'exact' WHEN b IS NOT NULL THEN 'folded' WHEN c IS NOT NULL THEN 'suffix' ELSE 'none' END AS how FROM x""", "v_part")
def fuzzy_documents(s, d):
    p, k = view(s, d, "v_part"), F.col("p_partkey") % 3
    files = p.where("p_size % 3 > 0").select(F.concat(F.translate("p_name", " ", "-"), F.lit(".md")).alias("name")).distinct()
    spelled = F.when(k == 0, F.translate("p_name", " ", "-")).when(k == 1, F.upper(F.translate("p_name", " ", "_"))).otherwise(F.concat(F.lit("moved_"), "p_name"))
    return T.find_document(p.select(F.col("p_partkey").alias("key"), F.concat(spelled, F.lit(".md")).alias("canonical"), F.concat(F.substring_index("p_name", " ", -1), F.lit(".md")).alias("leaf")), files)


@query("SELECT p_partkey, coalesce(nullif(trim(regexp_replace(regexp_replace(lower(replace(p_container, ' ', '--')), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-'), ''), 'part-' || p_partkey) AS slug FROM v_part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'part-' || p_partkey FROM v_part WHERE p_size % 2 > 0", "v_part")
def safe_slugs(s, d):
    p = view(s, d, "v_part")
    return p.select("p_partkey", T.safe_slug(F.when(F.col("p_size") % 2 == 0, F.replace("p_container", F.lit(" "), F.lit("--"))).otherwise("模块"), F.col("p_partkey")).alias("slug"))


# Links


def _fold(x):
    return f"regexp_replace(translate(regexp_replace(replace(lower({x}), '&', ' and '), '[^\\w.\\s-]', '_', 'g'), '- ', '__'), '_+', '_', 'g')"


@query(f"""fi AS (SELECT DISTINCT replace(p_name, ' ', CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '_' END) || '.md' AS f FROM part WHERE p_size % 4 > 0),
ta AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN '../' || replace(p_name, ' ', '_') || '.html#a' WHEN 1 THEN replace(p_name, ' ', '_') || '.md' WHEN 2 THEN upper(p_name) || '.md#b' ELSE 'https://' || p_brand END AS target FROM part),
n AS (SELECT target, {_fold("regexp_replace(regexp_replace(replace(target, '../', ''), '#.*$', ''), '[.][a-z]*$', '')")} AS k, regexp_extract(target, '#.*$') AS anchor FROM ta),
d AS (SELECT {_fold("replace(f, '.md', '')")} AS k, count(*) AS c, min(f) AS f FROM fi GROUP BY 1), r AS (SELECT target, CASE WHEN target LIKE 'https:%' THEN target WHEN c = 1 THEN f || anchor END AS new FROM n LEFT JOIN d USING (k))
SELECT target, coalesce(new, target) AS new_target, CASE WHEN new IS NULL THEN 'removed' WHEN new = target THEN 'kept' ELSE 'rewritten' END AS action FROM r""", "v_part")
def link_targets(s, d):
    p, k, folded = read(s, d, "part"), F.col("p_partkey") % 4, F.translate("p_name", " ", "_")
    files = p.where("p_size % 4 > 0").select(F.concat(F.when(F.col("p_partkey") % 3 == 0, F.translate("p_name", " ", "-")).otherwise(folded), F.lit(".md")).alias("file_name"))
    target = F.when(k == 0, F.concat(F.lit("../"), folded, F.lit(".html#a"))).when(k == 1, F.concat(folded, F.lit(".md"))).when(k == 2, F.concat(F.upper("p_name"), F.lit(".md#b"))).otherwise(F.concat(F.lit("https://"), "p_brand"))
    return L.aimed_targets(p.select(target.alias("target")), files)
