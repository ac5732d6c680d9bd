"""Named queries over the provided tables, each an application of an operator, with the DuckDB statement that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clusters as P
from ..operators import context as C
from ..operators import documents as D
from ..operators import edges as E
from ..operators import graph as G
from ..operators import matching as M
from ..operators import modularity as Q
from ..operators import trees as R
from ..sources.tables import ctes, read, view
from ..streaming import registry as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_WEIGHT = "CASE WHEN edge_type IN ('imports', 'extends') THEN CASE confidence WHEN 'low' THEN 0.7 ELSE 1.0 END ELSE CASE confidence WHEN 'high' THEN 0.5 WHEN 'medium' THEN 0.3 ELSE 0.2 END END"


def query(sql: str | None = None, *views: str):
    """Registers a query under its function's name; sql may read the named views as common table expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (f"WITH RECURSIVE {ctes(*views)}{', ' if not sql.lstrip().upper().startswith('SELECT') else ' '}{sql}" if views else sql)
        return f

    return add


# Statistics and lookups


@query("SELECT coalesce(edge_type, '*') AS edge_type, count(*) AS edges, count(to_unresolved) AS unresolved, round(count(to_unresolved) / count(*), 6) AS ratio FROM v_edge GROUP BY ROLLUP (edge_type)", "v_edge")
def graph_stats(s, d):
    return E.graph_stats(view(s, d, "v_edge"))


@query("SELECT from_id, to_id, edge_type FROM v_edge WHERE to_id IN (SELECT component_id FROM v_component WHERE component_type = 'class')", "v_edge", "v_component")
def callers_of_classes(s, d):
    return E.callers_of(view(s, d, "v_edge"), view(s, d, "v_component").where("component_type = 'class'")).select("from_id", "to_id", "edge_type")


@query("SELECT from_id, to_id, to_unresolved, edge_type FROM v_edge WHERE from_id IN (SELECT component_id FROM v_component WHERE component_type = 'method')", "v_edge", "v_component")
def callees_of_methods(s, d):
    return E.callees_of(view(s, d, "v_edge"), view(s, d, "v_component").where("component_type = 'method'")).select("from_id", "to_id", "to_unresolved", "edge_type")


@query("""b AS (SELECT from_id AS component_id, from_id, to_id, edge_type, ev_file, ev_line FROM v_edge WHERE to_id IS NOT NULL UNION ALL SELECT to_id, from_id, to_id, edge_type, ev_file, ev_line FROM v_edge WHERE to_id IS NOT NULL AND to_id <> from_id)
SELECT component_id, from_id, to_id, edge_type, ev_file, ev_line FROM (SELECT *, row_number() OVER (PARTITION BY component_id, from_id, to_id, edge_type ORDER BY ev_file, ev_line) AS r FROM b) WHERE r = 1""", "v_edge")
def edges_of_dedup(s, d):
    return E.incident(view(s, d, "v_edge"))


@query("SELECT from_id, to_id, edge_type FROM v_edge WHERE from_id IN (SELECT component_id FROM v_component WHERE component_type <> 'method') AND to_id IN (SELECT component_id FROM v_component WHERE component_type <> 'method')", "v_edge", "v_component")
def induced_subgraph(s, d):
    return E.induced(view(s, d, "v_edge"), view(s, d, "v_component").where("component_type <> 'method'")).select("from_id", "to_id", "edge_type")


@query("SELECT component_id, name FROM v_component WHERE contains(lower(name), 'ring')", "v_component")
def symbol_search(s, d):
    return view(s, d, "v_component").where(F.lower("name").contains("ring")).select("component_id", "name")


@query("SELECT component_id, name, file_path FROM v_component WHERE component_type = 'class'", "v_component")
def public_api(s, d):
    return view(s, d, "v_component").where("component_type = 'class'").select("component_id", "name", "file_path")


@query("SELECT DISTINCT a.file_path, b.file_path AS depends_on FROM v_edge e JOIN v_component a ON a.component_id = e.from_id JOIN v_component b ON b.component_id = e.to_id WHERE a.file_path <> b.file_path", "v_edge", "v_component")
def file_dependency_graph(s, d):
    return E.file_dependencies(view(s, d, "v_edge"), view(s, d, "v_component"))


@query("SELECT b.file_path, count(DISTINCT a.file_path) AS importers FROM v_edge e JOIN v_component a ON a.component_id = e.from_id JOIN v_component b ON b.component_id = e.to_id WHERE edge_type = 'imports' AND a.file_path <> b.file_path GROUP BY 1", "v_edge", "v_component")
def importers_of(s, d):
    e = view(s, d, "v_edge").where("edge_type = 'imports'")
    return E.file_dependencies(e, view(s, d, "v_component")).groupBy(F.col("depends_on").alias("file_path")).agg(F.count("*").alias("importers"))


@query("SELECT component_type, top_dir, count(*) AS n FROM v_component GROUP BY GROUPING SETS ((component_type), (top_dir), ())", "v_component")
def breakdown(s, d):
    c = view(s, d, "v_component")
    return c.groupingSets([[F.col("component_type")], [F.col("top_dir")], []], "component_type", "top_dir").agg(F.count("*").alias("n")).select("component_type", "top_dir", "n")


# Resolution


def _imports(s, d):
    e, c = view(s, d, "v_edge").where("edge_type = 'imports'"), view(s, d, "v_component")
    to = c.select(F.col("component_id").alias("to_id"), F.col("file_path").alias("resolved_path"), F.col("name").alias("imported"))
    names = e.join(c.select(F.col("component_id").alias("from_id"), "file_path"), "from_id").join(to, "to_id")
    return names.groupBy("file_path", "resolved_path").agg(F.sort_array(F.collect_set("imported")).alias("imported_names"))


def _symbols(s, d):
    return view(s, d, "v_component").select(F.col("component_id").alias("symbol_id"), "file_path", "name", F.col("component_id").alias("ord"), "component_type")


@query("""i AS (SELECT DISTINCT a.file_path, b.file_path AS resolved_path, b.name AS imported FROM v_edge e JOIN v_component a ON a.component_id = e.from_id JOIN v_component b ON b.component_id = e.to_id WHERE edge_type = 'imports')
SELECT i.file_path, i.resolved_path, imported, max(c.component_id) AS to_symbol, CAST(CASE WHEN max(c.component_id) IS NULL THEN imported END AS VARCHAR) AS to_unresolved, CASE WHEN max(c.component_id) IS NULL THEN 'low' ELSE 'high' END AS confidence
FROM i LEFT JOIN v_component c ON c.file_path = i.resolved_path AND c.name = i.imported AND c.component_type = 'class' GROUP BY 1, 2, 3""", "v_edge", "v_component")
def import_resolution(s, d):
    return E.resolve_imports(_imports(s, d), _symbols(s, d).where("component_type = 'class'"))


_SCOPED = """k AS (SELECT e.ev_file * 1000 + e.ev_line AS call_id, a.file_path, b.name AS callee FROM (SELECT DISTINCT from_id, to_id, edge_type, ev_file, ev_line FROM v_edge) e JOIN v_component a ON a.component_id = e.from_id JOIN v_component b ON b.component_id = e.to_id WHERE edge_type = '{0}'),
l AS (SELECT file_path, name, min(component_id) AS id FROM v_component WHERE {1} GROUP BY 1, 2), g AS (SELECT name, min(component_id) AS id FROM v_component WHERE {1} GROUP BY 1)
SELECT k.call_id, k.file_path, k.callee, coalesce(l.id, g.id) AS to_id, CASE WHEN l.id IS NOT NULL THEN 'same_file' WHEN g.id IS NOT NULL THEN 'global' ELSE 'unresolved' END AS scope
FROM k LEFT JOIN l ON l.file_path = k.file_path AND l.name = k.callee LEFT JOIN g ON g.name = k.callee"""


def _calls(s, d, kind):
    e, c = view(s, d, "v_edge").where(F.col("edge_type") == kind).select("from_id", "to_id", "edge_type", "ev_file", "ev_line").distinct(), view(s, d, "v_component")
    return e.join(c.select(F.col("component_id").alias("from_id"), "file_path"), "from_id").join(c.select(F.col("component_id").alias("to_id"), F.col("name").alias("callee")), "to_id").select((F.col("ev_file") * 1000 + F.col("ev_line")).alias("call_id"), "file_path", "callee")


@query(_SCOPED.format("extends", "component_type = 'class'"), "v_edge", "v_component")
def extends_priority(s, d):
    return E.resolve_by_priority(_calls(s, d, "extends"), _symbols(s, d).where("component_type = 'class'"))


@query(_SCOPED.format("calls", "component_type <> 'class'"), "v_edge", "v_component")
def scoped_call_resolution(s, d):
    return E.resolve_by_priority(_calls(s, d, "calls"), _symbols(s, d).where("component_type <> 'class'"))


@query("""p AS (SELECT DISTINCT p_type AS file, p_size * 20 AS line FROM part), r AS (SELECT p_type AS file, p_partkey AS symbol_id, p_size * 10 AS first, p_size * 10 + p_size % 7 * 100 AS last FROM part)
SELECT p.file, p.line, (SELECT symbol_id FROM r WHERE r.file = p.file AND p.line BETWEEN first AND last ORDER BY last - first, symbol_id LIMIT 1) AS symbol_id FROM p""", "v_component")
def enclosing_range_join(s, d):
    p = read(s, d, "part")
    ranges = p.select(F.col("p_type").alias("file"), F.col("p_partkey").alias("symbol_id"), (F.col("p_size") * 10).alias("first"), (F.col("p_size") * 10 + F.col("p_size") % 7 * 100).alias("last"))
    return E.enclosing(p.select(F.col("p_type").alias("file"), (F.col("p_size") * 20).alias("line")).distinct(), ranges)


@query("SELECT p_brand AS stem, min(CASE WHEN p_size % 2 = 0 THEN p_name END) AS header, min(CASE WHEN p_size % 2 = 1 THEN p_name END) AS source FROM part GROUP BY 1 HAVING header IS NOT NULL AND source IS NOT NULL")
def header_source_pairs(s, d):
    return E.header_pairs(read(s, d, "part").select(F.col("p_name").alias("path"), F.col("p_brand").alias("stem"), F.when(F.col("p_size") % 2 == 0, "header").otherwise("source").alias("kind")))


# Weights, borders, rankings, budgets


@query(f"SELECT least(from_id, to_id) AS u, greatest(from_id, to_id) AS v, round(least(sum({_WEIGHT}), 3.0)::DOUBLE, 6) AS w FROM v_edge WHERE to_id IS NOT NULL AND from_id <> to_id GROUP BY 1, 2", "v_edge")
def weighted_pairs(s, d):
    return E.weighted_pairs(view(s, d, "v_edge"))


@query(f"SELECT least(a.file_path, b.file_path) AS u, greatest(a.file_path, b.file_path) AS v, round(least(sum({_WEIGHT}), 3.0)::DOUBLE, 6) AS w FROM v_edge e JOIN v_component a ON a.component_id = e.from_id JOIN v_component b ON b.component_id = e.to_id WHERE a.file_path <> b.file_path GROUP BY 1, 2", "v_edge", "v_component")
def weighted_pairs_capped(s, d):
    c = view(s, d, "v_component")
    e = view(s, d, "v_edge").join(c.select(F.col("component_id").alias("from_id"), F.col("file_path").alias("a")), "from_id").join(c.select(F.col("component_id").alias("to_id"), F.col("file_path").alias("b")), "to_id")
    return E.weighted_pairs(e, "a", "b")


@query("SELECT file_path, count(*) AS members, count(*) * (count(*) - 1) // 2 AS pairs, round(0.3::DOUBLE * (count(*) * (count(*) - 1) // 2), 6) AS weight FROM v_component GROUP BY 1", "v_component")
def colocation_pairs(s, d):
    return E.colocated(view(s, d, "v_component"))


@query("SELECT component_id, CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) ELSE '_root' END AS part FROM v_component", "v_component")
def directory_partition(s, d):
    return view(s, d, "v_component").select("component_id", F.when(F.col("file_path").contains("/"), F.substring_index("file_path", "/", 1)).otherwise("_root").alias("part"))


@query(f"""w AS (SELECT least(from_id, to_id) AS u, greatest(from_id, to_id) AS v, round(least(sum({_WEIGHT}), 3.0)::DOUBLE, 6) AS w FROM v_edge WHERE to_id IS NOT NULL AND from_id <> to_id GROUP BY 1, 2)
SELECT least(a.file_path, b.file_path) AS u, greatest(a.file_path, b.file_path) AS v, round(sum(w), 6) AS w FROM w JOIN v_component a ON a.component_id = w.u JOIN v_component b ON b.component_id = w.v WHERE a.file_path <> b.file_path GROUP BY 1, 2""", "v_edge", "v_component")
def edge_weight_contraction(s, d):
    return E.contract(E.weighted_pairs(view(s, d, "v_edge")), view(s, d, "v_component").select(F.col("component_id").alias("node"), F.col("file_path").alias("label")))


_SIDES = """x AS (SELECT DISTINCT from_id, to_id, edge_type, a.top_dir AS fm, b.top_dir AS tm FROM v_edge e JOIN v_component a ON a.component_id = e.from_id JOIN v_component b ON b.component_id = e.to_id),
y AS (SELECT fm AS module_id, CASE WHEN fm = tm THEN 'inside' ELSE 'out' END AS side, from_id, to_id, edge_type FROM x UNION ALL SELECT tm, 'in', from_id, to_id, edge_type FROM x WHERE fm <> tm)"""


def _dirs(s, d):
    return view(s, d, "v_component").select("component_id", F.col("top_dir").alias("module_id"))


@query(f"{_SIDES} SELECT * FROM y", "v_edge", "v_component")
def boundary_internal_edges(s, d):
    return E.boundary(view(s, d, "v_edge"), _dirs(s, d))


@query(f"""{_SIDES}, c AS (SELECT module_id, count(*) FILTER (WHERE side = 'inside') AS n_inside, count(*) FILTER (WHERE side = 'in') AS n_in, count(*) FILTER (WHERE side = 'out') AS n_out FROM y GROUP BY 1),
w AS (SELECT least(a.top_dir, b.top_dir) AS u, greatest(a.top_dir, b.top_dir) AS v, round(least(sum({_WEIGHT}), 3.0)::DOUBLE, 6) AS w FROM v_edge e JOIN v_component a ON a.component_id = e.from_id JOIN v_component b ON b.component_id = e.to_id WHERE a.top_dir <> b.top_dir GROUP BY 1, 2)
SELECT c.module_id, n_inside, n_in, n_out, coalesce((SELECT round(sum(w), 6) FROM w WHERE u = c.module_id OR v = c.module_id), 0.0) AS border_weight, round(n_inside / (n_inside + n_in + n_out), 6) AS cohesion FROM c""", "v_edge", "v_component")
def module_boundary_report(s, d):
    return E.module_report(view(s, d, "v_edge"), _dirs(s, d))


@query("""p AS (SELECT DISTINCT least(from_id, to_id) AS u, greatest(from_id, to_id) AS v FROM v_edge WHERE to_id IS NOT NULL AND from_id <> to_id), n AS (SELECT u AS component_id FROM p UNION ALL SELECT v FROM p)
SELECT component_id, count(*) AS degree FROM n GROUP BY 1 ORDER BY degree DESC, component_id LIMIT 20""", "v_edge")
def degree_topk(s, d):
    return E.most_connected(view(s, d, "v_edge"), 20)


@query("""p AS (SELECT to_id AS component_id, count(DISTINCT from_id) AS callers FROM v_edge WHERE to_id IS NOT NULL GROUP BY 1)
SELECT top_dir, component_id, callers, CAST(rank AS INTEGER) AS rank FROM (SELECT top_dir, component_id, callers, row_number() OVER (PARTITION BY top_dir ORDER BY callers DESC, component_id) AS rank FROM p JOIN v_component USING (component_id)) WHERE rank <= 2""", "v_edge", "v_component")
def representatives_per_child(s, d):
    n = E.resolved(view(s, d, "v_edge")).groupBy(F.col("to_id").alias("component_id")).agg(F.count_distinct("from_id").alias("callers"))
    return E.top_per_group(n.join(view(s, d, "v_component"), "component_id").select("top_dir", "component_id", "callers"), ["top_dir"], [F.desc("callers"), "component_id"], 2)


@query("""f AS (SELECT from_id, to_id, edge_type, min(ROW(ev_file, ev_line)) AS e FROM v_edge WHERE to_id IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY e, to_id, edge_type) AS k FROM f), l AS (SELECT from_id, string_agg(edge_type || ':' || to_id, ',' ORDER BY k) AS targets FROM r WHERE k <= 5 GROUP BY 1)
SELECT component_id, name, file_path || '#' || name AS location, coalesce(targets, '') AS targets FROM v_component LEFT JOIN l ON l.from_id = component_id""", "v_edge", "v_component")
def top_cards(s, d):
    return E.cards(view(s, d, "v_component"), view(s, d, "v_edge"))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM orders) WHERE used <= 500000")
def budget_prefix(s, d):
    o = read(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.floor("o_totalprice").alias("size"))
    return E.within_budget(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "size", 500000).select("o_custkey", "o_orderkey", "used")


@query("""o AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
f AS (SELECT o_custkey, r, CASE WHEN s <= 500000 THEN s ELSE 0 END AS used, CASE WHEN s <= 500000 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS taken FROM o WHERE r = 1
UNION ALL SELECT o.o_custkey, o.r, CASE WHEN f.used + s <= 500000 THEN f.used + s ELSE f.used END, CASE WHEN f.used + s <= 500000 THEN f.taken || CASE WHEN f.taken = '' THEN '' ELSE ',' END || o.o_orderkey ELSE f.taken END FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.r = f.r + 1)
SELECT o_custkey, arg_max(taken, r) AS taken, arg_max(used, r) AS used FROM f GROUP BY 1""", "v_component")
def budget_greedy_skip(s, d):
    o = read(s, d, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("size"))
    return E.greedy_budget(o, ["o_custkey"], "o_orderkey", "o_orderkey", "size", 500000)


@query("SELECT component_type, top_dir, n FROM (SELECT component_type, top_dir, count(*) AS n, row_number() OVER (PARTITION BY component_type ORDER BY count(*) DESC, top_dir) AS r FROM v_component GROUP BY 1, 2) WHERE r = 1", "v_component")
def dominant_dir(s, d):
    return E.dominant(view(s, d, "v_component"), "component_type", "top_dir")


@query("SELECT coalesce(role, '*') AS model, count(*) AS requests, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY ROLLUP (role)")
def usage_rollup(s, d):
    return E.usage_rollup(view(s, d, "v_usage"))


@query("SELECT from_id, to_id, edge_type, ev_file, ev_line FROM (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, edge_type ORDER BY ev_file, ev_line) AS r FROM v_edge WHERE to_id IS NOT NULL) WHERE r = 1", "v_edge")
def dedup_relationships(s, d):
    return E.dedup_first(E.resolved(view(s, d, "v_edge")), ["from_id", "to_id", "edge_type"], ["ev_file", "ev_line"]).select("from_id", "to_id", "edge_type", "ev_file", "ev_line")


# Text and hashes


@query("SELECT module_id, lane, CAST(snapshot AS INTEGER) AS snapshot, substr(sha256(string_agg(component_id::VARCHAR, '|' ORDER BY component_id::VARCHAR)), 1, 12) AS hash FROM v_member GROUP BY 1, 2, 3", "v_member")
def module_id_hash(s, d):
    return view(s, d, "v_member").groupBy("module_id", "lane", "snapshot").agg(T.module_id(F.collect_list(F.col("component_id").cast("string"))).alias("hash"))


@query("SELECT p_partkey, sha256(p_name || chr(0) || p_brand || chr(0) || p_type || chr(0)) AS hash FROM part")
def stable_hash(s, d):
    return read(s, d, "part").select("p_partkey", T.stable_hash(F.array("p_name", "p_brand", "p_type")).alias("hash"))


@query(r"""SELECT doc_id, CASE WHEN length(h) > 300 THEN substr(h, 1, 300) || '…' ELSE h END AS summary FROM
(SELECT doc_id, array_to_string(list_slice(string_split_regex(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1, 2), ' ') AS h FROM documents)""")
def first_sentences(s, d):
    return read(s, d, "documents").select("doc_id", T.first_sentences(F.col("text")).alias("summary"))


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(lower(p_type), '&', 'and'), '[\s/-]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_') || '-' || trim(regexp_replace(regexp_replace(replace(lower(p_brand || ' & ' || p_name), '&', 'and'), '[\s/-]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_') || '.md' AS file FROM part")
def doc_filename_norm(s, d):
    return read(s, d, "part").select("p_partkey", T.doc_filename(F.array("p_type", F.concat_ws(" & ", "p_brand", "p_name"))).alias("file"))


@query(r"SELECT p_partkey, s || CASE WHEN n > 0 THEN '-' || n ELSE '' END AS unique_name FROM (SELECT p_partkey, s, row_number() OVER (PARTITION BY s ORDER BY p_partkey) - 1 AS n FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9_\s-]', '', 'g'), '\s', '-', 'g') AS s FROM part))")
def slug_dedup(s, d):
    return R.unique_names(read(s, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("s")), "s", ["p_partkey"]).select("p_partkey", "unique_name")


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS n, p AS paragraph FROM (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n[ \\t]*\\n'), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> '') AS l FROM documents))")
def paragraph_split(s, d):
    return read(s, d, "documents").select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("n", "paragraph"))


@query("SELECT event_id, CASE WHEN event_type = 'error' AND value > 50 THEN 'quota' WHEN CAST(floor(value) AS BIGINT) % 4 = 1 THEN 'auth' WHEN CAST(floor(value) AS BIGINT) % 4 = 2 THEN 'rate_limit' WHEN CAST(floor(value) AS BIGINT) % 4 = 3 THEN 'timeout' ELSE 'server' END AS class, least(0.5 * pow(2, user_id % 10), 32.0) AS delay FROM events")
def error_class(s, d):
    e = read(s, d, "events")
    status = F.element_at(F.array(F.lit(500), F.lit(401), F.lit(429), F.lit(504)), (F.floor("value") % 4 + 1).cast("int"))
    return e.select("event_id", T.error_class(F.when((F.col("event_type") == "error") & (F.col("value") > 50), "Quota exceeded"), status).alias("class"), T.retry_delay(F.col("user_id") % 10 + 1).alias("delay"))


# Matching and change


def _snapshot(s, d, year):
    m = view(s, d, "v_member").where(F.col("snapshot") == year)
    return m.select(F.concat_ws("/", "module_id", "lane").alias("set_id"), F.col("component_id").alias("item"), F.col("module_id"))


_SETS = "n AS (SELECT module_id || '/' || lane AS set_id, component_id AS item FROM v_member WHERE snapshot = 1998), o AS (SELECT module_id || '/' || lane AS set_id, component_id AS item FROM v_member WHERE snapshot = 1997)"
_MATCH = _SETS + """, p AS (SELECT n.set_id AS new_id, o.set_id AS old_id, count(*) AS c FROM n JOIN o USING (item) GROUP BY 1, 2), ns AS (SELECT set_id, count(*) AS k FROM n GROUP BY 1), os AS (SELECT set_id, count(*) AS k FROM o GROUP BY 1),
q AS (SELECT new_id, old_id, c / {0}.k AS overlap, c = ns.k AND c = os.k AS eq FROM p JOIN ns ON ns.set_id = new_id JOIN os ON os.set_id = old_id),
r AS (SELECT *, row_number() OVER w AS r, lead(overlap) OVER w AS nxt FROM q WINDOW w AS (PARTITION BY {1} ORDER BY eq DESC, overlap DESC, {2}))
SELECT new_id, old_id, round(overlap, 6) AS overlap FROM r WHERE r = 1 AND (eq OR (overlap >= {3} AND round(overlap - coalesce(nxt, 0), 9) >= {4}))"""


@query(_MATCH.format("ns", "new_id", "old_id", 0.2, 0.1), "v_member")
def dominant_match(s, d):
    return M.dominant_match(_snapshot(s, d, 1998), _snapshot(s, d, 1997), 0.2, 0.1)


@query(_MATCH.format("os", "old_id", "new_id", 0.2, 0.1), "v_member")
def split_successor(s, d):
    return M.dominant_match(_snapshot(s, d, 1998), _snapshot(s, d, 1997), 0.2, 0.1, of="old")


@query(_SETS + """, i AS (SELECT n.item IS NOT NULL AND o.item IS NOT NULL AS b FROM (SELECT DISTINCT item FROM n) n FULL JOIN (SELECT DISTINCT item FROM o) o USING (item)),
u AS (SELECT set_id, count(*) FILTER (WHERE a = 1 AND b = 1) AS i, count(*) AS u, count(a) AS n, count(b) AS o FROM (SELECT set_id, item, max(a) AS a, max(b) AS b FROM (SELECT set_id, item, 1 AS a, NULL AS b FROM n UNION ALL SELECT set_id, item, NULL, 1 FROM o) GROUP BY 1, 2) GROUP BY 1)
SELECT (SELECT round(count(*) FILTER (WHERE b) / count(*), 6) FROM i) AS coverage, (SELECT round(count(*) FILTER (WHERE n > 0 AND o > 0) / count(*), 6) FROM u) AS id_consistency, (SELECT round(avg(CASE WHEN n > 0 AND o > 0 THEN i / u END), 6) FROM u) AS mean_jaccard""", "v_member")
def stability_report(s, d):
    return M.stability(_snapshot(s, d, 1998), _snapshot(s, d, 1997))


@query("""n AS (SELECT module_id AS set_id, component_id AS item, count(*) AS h FROM v_member WHERE snapshot = 1998 GROUP BY 1, 2), o AS (SELECT module_id AS set_id, component_id AS item, count(*) AS h FROM v_member WHERE snapshot = 1997 GROUP BY 1, 2),
j AS (SELECT coalesce(n.set_id, o.set_id) AS set_id, n.h AS nh, o.h AS oh FROM n FULL JOIN o ON n.set_id = o.set_id AND n.item = o.item)
SELECT set_id, count(*) FILTER (WHERE nh IS NULL OR oh IS NULL OR nh <> oh) AS changed, count(nh) AS size, round(CASE WHEN count(nh) = 0 THEN 0.0 ELSE least(count(*) FILTER (WHERE nh IS NULL OR oh IS NULL OR nh <> oh) / count(nh), 1.0) END, 6) AS ratio FROM j GROUP BY 1""", "v_member")
def leaf_change_ratio(s, d):
    return M.change_ratio(*_hashed(s, d))


def _hashed(s, d):
    return [_snapshot(s, d, y).groupBy(F.col("module_id").alias("set_id"), "item").agg(F.count("*").alias("hash")) for y in (1998, 1997)]


def _children(s, d, year):
    o, c = read(s, d, "orders"), read(s, d, "customer")
    rows = o.where(F.year("o_orderdate") == year).join(c, o.o_custkey == c.c_custkey)
    return rows.groupBy(F.col("c_mktsegment").alias("parent_id"), F.col("c_custkey").alias("module_id")).agg(F.min("o_orderpriority").alias("title"))


@query("""n AS (SELECT c_mktsegment AS parent_id, c_custkey AS module_id, min(o_orderpriority) AS t FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = 1998 GROUP BY 1, 2), o AS (SELECT c_mktsegment AS parent_id, c_custkey AS module_id, min(o_orderpriority) AS t FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) = 1997 GROUP BY 1, 2)
SELECT * FROM (SELECT coalesce(n.parent_id, o.parent_id) AS parent_id, coalesce(n.module_id, o.module_id) AS module_id, CASE WHEN o.t IS NULL THEN 'child_added' WHEN n.t IS NULL THEN 'child_removed' WHEN n.t <> o.t THEN 'title_changed' END AS "trigger" FROM n FULL JOIN o ON n.parent_id = o.parent_id AND n.module_id = o.module_id) WHERE "trigger" IS NOT NULL""", "v_component")
def hard_triggers(s, d):
    return M.hard_triggers(_children(s, d, 1998), _children(s, d, 1997))


def _terms(s, d):
    part = read(s, d, "part").select(F.col("p_brand").alias("doc"), F.explode(F.transform(F.split(F.lower("p_name"), " "), lambda w: F.concat_ws("_", "p_type", w))).alias("term"))
    return part.groupBy("doc", "term").agg(F.count("*").alias("n"))


@query("""t AS (SELECT doc, term, count(*) AS n FROM (SELECT p_brand AS doc, p_type || '_' || unnest(string_split(lower(p_name), ' ')) AS term FROM part) GROUP BY 1, 2), k AS (SELECT count(DISTINCT doc) AS docs FROM t),
i AS (SELECT term, ln(docs / count(*)) AS idf FROM t, k GROUP BY term, docs HAVING count(*) <= 0.8 * docs), w AS (SELECT doc, t.term, (1 + ln(n)) * idf AS w FROM t JOIN i USING (term)), m AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1)
SELECT x.doc AS a, y.doc AS b, round(sum(x.w * y.w / a.norm / b.norm), 6) AS score FROM w x JOIN w y ON x.term = y.term AND x.doc < y.doc JOIN m a ON a.doc = x.doc JOIN m b ON b.doc = y.doc GROUP BY 1, 2 HAVING sum(x.w * y.w / a.norm / b.norm) >= 0.2""", "v_component")
def tfidf_pairs(s, d):
    return M.tfidf_pairs(_terms(s, d), 0.2)


_LINES = "list_distinct(list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x)), lambda x: x <> ''))"


@query(f"""g AS (SELECT source || '/' || lang || '/' || (n_chars // 50) AS key, doc_id AS name, text FROM documents WHERE text IS NOT NULL), k AS (SELECT key, count(*) AS n, arg_min(name, ROW(-length(text), name)) AS kept, arg_min(text, ROW(-length(text), name)) AS kt FROM g GROUP BY 1 HAVING count(*) > 1),
j AS (SELECT g.key, kept, {_LINES.format('text')} AS a, {_LINES.format('kt')} AS b FROM g JOIN k USING (key) WHERE name <> kept)
SELECT key, kept, count(*) AS others, CASE WHEN bool_and(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN true ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) > 0.8 END) THEN 'dropped' ELSE 'conflict' END AS verdict FROM j GROUP BY 1, 2""", "v_component")
def near_dup_groups(s, d):
    docs = read(s, d, "documents").where("text is not null")
    return M.near_duplicate_groups(docs.select(F.col("doc_id").alias("name"), F.concat_ws("/", "source", "lang", F.floor(F.col("n_chars") / 50).cast("string")).alias("key"), "text"))


# Trees


@query("""t AS (SELECT module_id, 1 AS depth, title AS path FROM v_module WHERE parent_id = 'root' UNION ALL SELECT m.module_id, t.depth + 1, t.path || '/' || m.title FROM v_module m JOIN t ON m.parent_id = t.module_id) SELECT * FROM t""", "v_module")
def tree_paths(s, d):
    return R.paths(view(s, d, "v_module"))


@query("""h AS (SELECT module_id, parent_id, 0 AS level FROM v_module WHERE module_id NOT IN (SELECT parent_id FROM v_module) UNION ALL SELECT m.module_id, m.parent_id, h.level + 1 FROM v_module m JOIN h ON h.parent_id = m.module_id) SELECT module_id, max(level) AS level FROM h GROUP BY 1""", "v_module")
def tree_levels(s, d):
    return R.heights(view(s, d, "v_module"))


@query("""b AS (SELECT DISTINCT module_id, component_id FROM v_member WHERE snapshot = 1998), x AS (SELECT o_orderpriority AS module_id, o_custkey AS component_id FROM orders WHERE o_orderstatus = 'P'), a AS (SELECT * FROM b UNION SELECT * FROM x)
SELECT 'duplicate_component' AS kind, component_id::VARCHAR AS item FROM a GROUP BY component_id HAVING count(*) > 1 UNION ALL SELECT 'unassigned_component', c_custkey::VARCHAR FROM customer WHERE c_custkey NOT IN (SELECT component_id FROM a)
UNION ALL SELECT 'missing_parent', module_id FROM v_module WHERE depth = 2 AND parent_id IN ('r0', 'r3')""", "v_member", "v_module")
def tree_violations(s, d):
    modules = view(s, d, "v_module").where("module_id not in ('r0', 'r3')")
    members = view(s, d, "v_member").where("snapshot = 1998").select("module_id", "component_id").unionByName(read(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("module_id"), F.col("o_custkey").alias("component_id")))
    return R.violations(modules, members, read(s, d, "customer").select(F.col("c_custkey").alias("component_id")))


@query("""SELECT 'module:' || m.module_id AS doc_id, CASE WHEN k.parent_id IS NULL THEN 'leaf' ELSE 'parent' END AS kind, coalesce(k.n, 0) AS n_deps, coalesce(k.deps, '') AS deps FROM v_module m LEFT JOIN (SELECT parent_id, count(*) AS n, string_agg(module_id, ',' ORDER BY module_id) AS deps FROM v_module GROUP BY 1) k ON k.parent_id = m.module_id
UNION ALL SELECT 'overview', 'overview', count(*), string_agg(module_id, ',' ORDER BY module_id) FROM v_module WHERE parent_id = 'root'""", "v_module")
def generation_tasks(s, d):
    return R.tasks(view(s, d, "v_module"))


_RATIOS = """n AS (SELECT module_id AS set_id, component_id AS item, count(*) AS h FROM v_member WHERE snapshot = 1998 GROUP BY 1, 2), o AS (SELECT module_id AS set_id, component_id AS item, count(*) AS h FROM v_member WHERE snapshot = 1997 GROUP BY 1, 2),
j AS (SELECT coalesce(n.set_id, o.set_id) AS set_id, n.h AS nh, o.h AS oh FROM n FULL JOIN o ON n.set_id = o.set_id AND n.item = o.item), q AS (SELECT set_id, least(count(*) FILTER (WHERE nh IS NULL OR oh IS NULL OR nh <> oh) / nullif(count(nh), 0), 1.0) AS ratio FROM j GROUP BY 1)"""


def _titles(s, d, year):
    """Modules as children of their regions, with titles that change with the year."""
    m = view(s, d, "v_member").where(F.col("snapshot") == year).groupBy("module_id").agg(F.floor(F.min("component_id") / 20).cast("string").alias("title"))
    return m.join(view(s, d, "v_module").select("module_id", "parent_id"), "module_id")


_TITLES = "SELECT m.module_id, v.parent_id, min(m.component_id) // 20 AS t FROM v_member m JOIN v_module v USING (module_id) WHERE snapshot = {} GROUP BY 1, 2"


@query(f"""{_RATIOS}, l AS (SELECT module_id, parent_id FROM v_module JOIN q ON set_id = module_id WHERE round(ratio, 6) >= 0.9), a AS ({_TITLES.format(1998)}), b AS ({_TITLES.format(1997)}),
h AS (SELECT DISTINCT coalesce(a.parent_id, b.parent_id) AS parent_id FROM a FULL JOIN b ON a.module_id = b.module_id AND a.parent_id = b.parent_id WHERE a.t IS DISTINCT FROM b.t)
SELECT module_id, 0 AS level, 'leaf_ratio' AS reason FROM l UNION ALL SELECT parent_id, 1, CASE WHEN parent_id IN (SELECT parent_id FROM h) THEN 'hard_trigger' ELSE 'child_ratio' END
FROM (SELECT parent_id, count(*) AS n, count(l.module_id) AS k FROM v_module LEFT JOIN l USING (module_id, parent_id) WHERE parent_id <> 'root' GROUP BY 1) WHERE k / n >= 0.3 OR parent_id IN (SELECT parent_id FROM h)""", "v_member", "v_module")
def invalidation_plan(s, d):
    triggers = M.hard_triggers(_titles(s, d, 1998), _titles(s, d, 1997))
    return R.invalidation_plan(view(s, d, "v_module"), M.change_ratio(*_hashed(s, d)), triggers, leaf=0.9)


# Graphs


@query("""z AS (SELECT p_partkey AS node FROM part WHERE p_size = 1), r AS (SELECT node, 0 AS distance FROM z UNION SELECT g.src, r.distance + 1 FROM r JOIN v_dag g ON g.dst = r.node) SELECT node, min(distance) AS distance FROM r GROUP BY 1""", "v_dag")
def cascade_invalidate(s, d):
    return G.affected(view(s, d, "v_dag"), read(s, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("node")))


@query("""n AS (SELECT src AS node FROM v_dag UNION SELECT dst FROM v_dag), r AS (SELECT node, 0 AS level FROM n UNION SELECT g.src, r.level + 1 FROM r JOIN v_dag g ON g.dst = r.node) SELECT node, max(level) AS level FROM r GROUP BY 1""", "v_dag")
def topo_levels(s, d):
    return G.topological_levels(view(s, d, "v_dag"))


@query("""r AS (SELECT src AS a, dst AS b FROM v_digraph UNION SELECT r.a, g.dst FROM r JOIN v_digraph g ON g.src = r.b), c AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY 1)
SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM c""", "v_digraph")
def scc_labels(s, d):
    return G.strong_components(view(s, d, "v_digraph"))


@query("""e AS (SELECT DISTINCT fm AS community, tm AS other FROM (SELECT a.top_dir AS fm, b.top_dir AS tm FROM v_edge e JOIN v_component a ON a.component_id = e.from_id JOIN v_component b ON b.component_id = e.to_id) WHERE fm <> tm) SELECT community, string_agg(other, ',' ORDER BY other) AS others FROM e GROUP BY 1""", "v_edge", "v_component")
def cross_cluster_edges(s, d):
    of = lambda c, m: _dirs(s, d).select(F.col("component_id").alias(c), F.col("module_id").alias(m))
    j = E.resolved(view(s, d, "v_edge")).join(of("from_id", "community"), "from_id").join(of("to_id", "other"), "to_id").where("community <> other")
    return j.groupBy("community").agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("others"))


@query(f"""c AS (SELECT component_id AS node, p_size * 1000 + component_id % 300 AS community FROM v_component), z AS (SELECT community, count(*) AS size FROM c GROUP BY 1), p AS (SELECT DISTINCT least(from_id, to_id) AS u, greatest(from_id, to_id) AS v FROM v_edge WHERE to_id IS NOT NULL AND from_id <> to_id),
l AS (SELECT a.community AS x, b.community AS y FROM p JOIN c a ON a.node = u JOIN c b ON b.node = v WHERE a.community <> b.community), b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
k AS (SELECT x, y, count(*) AS n FROM b JOIN z s ON s.community = x AND s.size < 3 JOIN z t ON t.community = y AND t.size >= 3 GROUP BY 1, 2), m AS (SELECT x, y FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY n DESC, y) AS r FROM k) WHERE r = 1)
SELECT node, coalesce(y, community) AS community FROM c LEFT JOIN m ON x = community""", "v_edge", "v_component")
def tiny_merge(s, d):
    labels = view(s, d, "v_component").select(F.col("component_id").alias("node"), (F.col("p_size") * 1000 + F.col("component_id") % 300).alias("community"))
    return G.merge_tiny(labels, E.weighted_pairs(view(s, d, "v_edge")))


@query()
def communities(s, d):
    return Q.communities(E.weighted_pairs(view(s, d, "v_edge")))


@query()
def partition(s, d):
    return P.partition(view(s, d, "v_layered"), view(s, d, "v_file"))


@query("""e AS (SELECT a.path AS src, b.path AS dst, count(*) AS n_edges FROM v_layered JOIN v_file a ON a.component_id = from_id JOIN v_file b ON b.component_id = to_id GROUP BY 1, 2), n AS (SELECT path, count(*) AS n FROM v_file GROUP BY 1)
SELECT src, dst, n_edges, x.n AS n_src, y.n AS n_dst, (SELECT count(*) FROM v_file p, v_file q WHERE p.path = src AND q.path = dst AND p.component_id <> q.component_id) AS n_pairs FROM e JOIN n x ON x.path = src JOIN n y ON y.path = dst""", "v_layered", "v_file")
def file_pairs(s, d):
    return P.file_pairs(view(s, d, "v_layered"), view(s, d, "v_file"))


# State and documents


@query("SELECT artifact_id, arg_max(status, ROW(ts, event_id)) AS status, count(*) FILTER (WHERE status IN ('valid', 'failed')) AS attempts, max(ts) AS updated_at FROM v_registry_event GROUP BY 1", "v_registry_event")
def registry_latest(s, d):
    return S.latest(view(s, d, "v_registry_event"))


@query("SELECT event_id, user_id FROM events WHERE epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts) < 5 * 86400000000")
def ttl_valid(s, d):
    return S.live(read(s, d, "events").withColumnRenamed("ts", "created_at"), "2024-01-20 00:00:00", 5).select("event_id", "user_id")


def _pages(s, d):
    """Pages as Markdown: headings and links, and a section of notes that links to its own and the next page's."""
    body = F.regexp_replace(F.regexp_replace("html", r"<a href=\"([^\"]*)\">([^<]*)</a>", "\n[$2]($1)\n"), r"<h([1-6])>([^<]*)</h[1-6]>", "\n# $2\n")
    notes = F.concat(F.lit("\n## Notes, *new*\n[own](#notes-new)\n[next](p"), (F.col("page_id") + 1).cast("string"), F.lit(".md#notes-new)\n[gone](#nowhere)\n## Notes, new\n[twice](#notes-new-1)\n"))
    return read(s, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".md")).alias("file_name"), F.concat(body, notes).alias("text"))


_MD = """m AS (SELECT 'p' || page_id || '.md' AS file_name, regexp_replace(regexp_replace(html, '<a href="([^"]*)">([^<]*)</a>', chr(10) || '[\\2](\\1)' || chr(10), 'g'), '<h([1-6])>([^<]*)</h[1-6]>', chr(10) || '# \\2' || chr(10), 'g') || chr(10) || '## Notes, *new*' || chr(10) || '[own](#notes-new)' || chr(10) || '[next](p' || (page_id + 1) || '.md#notes-new)' || chr(10) || '[gone](#nowhere)' || chr(10) || '## Notes, new' || chr(10) || '[twice](#notes-new-1)' || chr(10) AS text FROM pages),
l AS (SELECT file_name, line, row_number() OVER () AS x, i AS line_no FROM (SELECT file_name, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m)),
k AS (SELECT file_name, line_no, unnest(regexp_extract_all(line, '\\[[^\\]]*\\]\\(([^)]*)\\)', 1)) AS target FROM l)"""


@query(f"{_MD} SELECT file_name, CAST(line_no AS INTEGER) AS line_no, target FROM k", "v_component")
def link_extract(s, d):
    return D.links(_pages(s, d))


_ANCHORS = r"""h AS (SELECT file_name, line_no, regexp_replace(regexp_replace(regexp_replace(line, '^\s*#{1,6}\s+', ''), '\*([^*]+)\*', '\1', 'g'), '\s+#+\s*$', '') AS title FROM l WHERE regexp_matches(line, '^#{1,6}\s+\S')),
g AS (SELECT file_name, line_no, regexp_replace(regexp_replace(lower(trim(title)), '[^\p{L}\p{M}\p{N}_\s-]', '', 'g'), '\s', '-', 'g') AS s FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY file_name, s ORDER BY line_no) - 1 AS n FROM g),
a AS (SELECT file_name, line_no, CASE WHEN n > 0 THEN s || '-' || n ELSE s END AS anchor FROM n)"""
_ISSUES = """t AS (SELECT *, CASE WHEN starts_with(target, '#') OR trim(target) = '' THEN file_name ELSE ltrim(string_split(target, '#')[1], '/') END AS f, CASE WHEN contains(target, '#') THEN substr(target, instr(target, '#') + 1) ELSE '' END AS x FROM k WHERE NOT regexp_matches(lower(target), '^(https?:|mailto:)')),
b AS (SELECT file_name, line_no, target, CASE WHEN trim(target) = '' THEN 'empty_link' WHEN f NOT IN (SELECT file_name FROM m) THEN 'file_not_found' WHEN x <> '' AND NOT EXISTS (SELECT 1 FROM a WHERE a.file_name = f AND a.anchor = x) THEN 'anchor_not_found' END AS issue FROM t)"""


@query(f"{_MD}, {_ANCHORS}, {_ISSUES} SELECT file_name, CAST(line_no AS INTEGER) AS line_no, target, issue FROM b WHERE issue IS NOT NULL", "v_component")
def broken_links(s, d):
    return D.link_issues(_pages(s, d))


@query(f"{_MD}, {_ANCHORS}, {_ISSUES} SELECT issue, count(*) AS n, count(DISTINCT file_name) AS files FROM b WHERE issue IS NOT NULL GROUP BY 1", "v_component")
def lint_summary(s, d):
    return D.lint_summary(D.link_issues(_pages(s, d)))


@query(f"{_MD}, {_ANCHORS} SELECT file_name, CAST(line_no AS INTEGER) AS line_no, anchor FROM a", "v_component")
def page_anchors(s, d):
    return D.anchors(_pages(s, d))


# Context, identity and scheduling


@query("SELECT 'n' || n_nationkey AS module_id, CASE WHEN n_nationkey % 7 = 0 THEN 'failed' ELSE 'done' END AS outcome FROM nation UNION ALL SELECT 'r' || r_regionkey, CASE WHEN r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey % 7 = 0) THEN 'skipped' ELSE 'done' END FROM region")
def queue_outcomes(s, d):
    failed = read(s, d, "nation").where("n_nationkey % 7 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("module_id"))
    return C.queue_outcomes(view(s, d, "v_module"), failed)


def _ranked_overlaps(s, d):
    o = M.overlaps(_snapshot(s, d, 1998), _snapshot(s, d, 1997)).withColumn("overlap", F.col("common") / F.col("new_size"))
    return o.select(F.col("new_id").alias("ord"), "new_id", "old_id", "overlap")


@query()
def greedy_identity(s, d):
    return C.assign_identities(_ranked_overlaps(s, d), 0.1)


@query()
def layered_budget(s, d):
    p = read(s, d, "documents").select(F.concat_ws("/", "source", "lang").alias("grp"), F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("idx", "p"))
    return C.layered_budget(p.select("grp", "doc", "idx", F.length("p").alias("size")), 4000)


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name || '.md') = 1 THEN p_name || '.md' ELSE p_name || '.md-' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8) END AS file_name FROM part")
def frozen_names(s, d):
    return C.freeze_names(read(s, d, "part").select("p_partkey", F.concat("p_name", F.lit(".md")).alias("stem")), "stem", "p_partkey").select("p_partkey", "file_name")


@query("""o AS (SELECT o_orderpriority AS parent_id, o_custkey AS module_id, min(o_orderstatus) AS t, count(*) AS n FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1, 2), n AS (SELECT o_orderpriority AS parent_id, o_custkey AS module_id, min(o_orderstatus) AS t, count(*) AS n FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1, 2)
SELECT coalesce(o.parent_id, n.parent_id) AS parent_id, coalesce(o.module_id, n.module_id) AS module_id, coalesce(o.t, n.t) AS title, coalesce(n.n, o.n) AS n FROM o FULL JOIN n ON o.parent_id = n.parent_id AND o.module_id = n.module_id""", "v_component")
def merged_children(s, d):
    of = lambda y: read(s, d, "orders").where(F.year("o_orderdate") == y).groupBy(F.col("o_orderpriority").alias("parent_id"), F.col("o_custkey").alias("module_id")).agg(F.min("o_orderstatus").alias("title"), F.count("*").alias("n"))
    return C.merge_children(of(1997), of(1998))


@query("""f AS (SELECT file_path || '/' || name AS path, p_size AS size, top_dir, file_path FROM v_component) SELECT '' AS folder, 0 AS depth, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM f UNION ALL SELECT top_dir, 1, count(*), CAST(sum(size) AS BIGINT) FROM f GROUP BY 1 UNION ALL SELECT file_path, 2, count(*), CAST(sum(size) AS BIGINT) FROM f GROUP BY 1""", "v_component")
def folder_sizes(s, d):
    return C.folder_sizes(view(s, d, "v_component").select(F.concat_ws("/", "file_path", "name").alias("path"), F.col("p_size").alias("size")))


@query("""SELECT '{"data":{"id":"' || component_id || '","label":"' || name || '","type":"' || component_type || '"}}' AS element FROM v_component UNION ALL SELECT DISTINCT '{"data":{"id":"' || from_id || '-' || to_id || '","source":"' || from_id || '","target":"' || to_id || '"}}' FROM v_edge WHERE to_id IS NOT NULL""", "v_component", "v_edge")
def graph_export(s, d):
    return C.export_elements(view(s, d, "v_component"), view(s, d, "v_edge"))


@query("SELECT e.from_id AS caller, e.to_id AS callee, CAST(i - 1 AS INTEGER) AS position, string_split(p_name, ' ')[i] AS parameter FROM v_edge e JOIN part ON p_partkey = to_id CROSS JOIN (VALUES (1), (2)) v(i) WHERE edge_type = 'calls' AND len(string_split(p_name, ' ')) >= i", "v_edge")
def flow_edges(s, d):
    c = read(s, d, "part").select(F.col("p_partkey").alias("component_id"), F.split("p_name", " ").alias("parameters"))
    return C.flow_edges(view(s, d, "v_edge"), c)


@query("""i AS (SELECT name AS known, min(component_id) AS id FROM v_component GROUP BY 1), w AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(replace(p_name, ' ', '_')) ELSE p_name || 's' END AS name FROM part UNION SELECT 'x' || p_name FROM part WHERE p_size > 25),
k AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM w), j AS (SELECT *, regexp_replace(lower(known), '[^a-z0-9]', '', 'g') AS k FROM i),
f AS (SELECT name, min(id) AS f FROM k JOIN j USING (k) GROUP BY 1), s AS (SELECT name, id, 1 - levenshtein(lower(name), lower(known)) / greatest(length(name), length(known)) AS s FROM k CROSS JOIN j WHERE name NOT IN (SELECT name FROM f)),
b AS (SELECT name, arg_min(id, ROW(-s, id)) AS n FROM s WHERE s >= 0.85 GROUP BY 1)
SELECT w.name, coalesce(i.id, f.f, b.n) AS component_id, CASE WHEN i.id IS NOT NULL THEN 'exact' WHEN f.f IS NOT NULL THEN 'folded' WHEN b.n IS NOT NULL THEN 'similar' ELSE 'none' END AS how FROM w LEFT JOIN i ON i.known = w.name LEFT JOIN f ON f.name = w.name LEFT JOIN b ON b.name = w.name""", "v_component")
def healed_names(s, d):
    k = F.col("p_partkey") % 3
    names = read(s, d, "part").select(F.when(k == 0, F.col("p_name")).when(k == 1, F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))).otherwise(F.concat("p_name", F.lit("s"))).alias("name"))
    names = names.unionByName(read(s, d, "part").where("p_size > 25").select(F.concat(F.lit("x"), "p_name").alias("name")))
    return C.heal_names(names, view(s, d, "v_component"))


from . import packs, state  # noqa: E402, F401 - register their queries beside these
