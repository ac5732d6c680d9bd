"""Queries of entry states, fitted files, input hashes, free names and diagrams, registered beside the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagrams as M
from ..operators import digests as H
from ..operators import fitting as B
from ..operators import trees as R
from ..sources.tables import read, view
from ..streaming import machine as S
from .catalog import query

_ACTION = "CASE status WHEN 'missing' THEN 'plan' WHEN 'running' THEN 'start' WHEN 'valid' THEN 'done' WHEN 'failed' THEN 'fail' ELSE 'invalidate' END"


@query(f"""k AS (SELECT CAST(artifact_id AS VARCHAR) AS artifact_id, event_id, ts, {_ACTION} AS action FROM v_registry_event),
p AS (SELECT *, count(*) FILTER (WHERE action IN ('start', 'done', 'fail')) OVER w AS part, count(*) FILTER (WHERE action IN ('done', 'fail')) OVER w AS attempts FROM k WINDOW w AS (PARTITION BY artifact_id ORDER BY ts, event_id)),
b AS (SELECT *, coalesce(first_value(CASE action WHEN 'start' THEN 'running' WHEN 'done' THEN 'valid' WHEN 'fail' THEN 'failed' END) OVER w, 'missing') AS base, count(*) FILTER (WHERE action = 'invalidate') OVER w AS stales FROM p WINDOW w AS (PARTITION BY artifact_id, part ORDER BY ts, event_id)),
c AS (SELECT *, count(*) FILTER (WHERE action = 'plan' AND (base <> 'valid' OR stales > 0)) OVER (PARTITION BY artifact_id, part ORDER BY ts, event_id) AS plans FROM b),
a AS (SELECT *, CASE WHEN base = 'missing' OR plans > 0 THEN 'missing' WHEN stales > 0 THEN 'stale' ELSE base END AS "after" FROM c),
l AS (SELECT *, lag("after") OVER w AS was, lag(ts) OVER w AS since FROM a WINDOW w AS (PARTITION BY artifact_id ORDER BY ts, event_id)),
z AS (SELECT *, CASE WHEN was = 'running' AND ts > since + INTERVAL 30 MINUTE THEN 'stale' ELSE coalesce(was, 'missing') END AS "before" FROM l)
SELECT artifact_id, event_id, action, "before", "after", attempts, CASE WHEN action = 'start' THEN "before" <> 'running' WHEN action IN ('done', 'fail') THEN "before" = 'running' ELSE true END AS legal FROM z""", "v_registry_event")
def registry_transitions(s, d):
    events = view(s, d, "v_registry_event").select("artifact_id", "event_id", "ts", F.expr(_ACTION).alias("action"))
    return S.transitions(events).drop("ts")


_BUDGET = 20_000


@query(rf"""f AS (SELECT coalesce(source, '-') AS m, doc_id AS p, coalesce(text, '') AS t FROM documents),
lv AS (SELECT m, p, 0 AS r, t FROM f UNION ALL SELECT m, p, r + 1, h FROM (SELECT *, array_to_string(x[1:a] || ['', '// ... (' || (n - g) || ' lines truncated) ...', ''] || x[n - g + a + 1:n], chr(10)) AS h
 FROM (SELECT *, CAST(floor(g * 0.6) AS INTEGER) AS a FROM (SELECT *, greatest(n // 2, 6) AS g FROM (SELECT *, string_split(t, chr(10)) AS x, len(string_split(t, chr(10))) AS n FROM lv)))) WHERE r < 20 AND n > 6 AND length(h) // 4 < length(t) // 4),
s AS (SELECT *, length(t) // 4 AS k, length(t) // 4 - lead(length(t) // 4) OVER (PARTITION BY m, p ORDER BY r) AS saved FROM lv), o AS (SELECT m, sum(k) AS total FROM s WHERE r = 0 GROUP BY 1),
c AS (SELECT m, p, total - coalesce(sum(saved) OVER (PARTITION BY m ORDER BY r, length(t) DESC, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM s JOIN o USING (m) WHERE saved IS NOT NULL),
h AS (SELECT m, p, count(c.over) AS halvings FROM f LEFT JOIN (SELECT * FROM c WHERE over > {_BUDGET}) c USING (m, p) GROUP BY 1, 2), n AS (SELECT h.m, h.p, halvings, t, k FROM h JOIN s ON s.m = h.m AND s.p = h.p AND s.r = halvings),
g AS (SELECT *, '// ── signatures only (body omitted) ──' || chr(10) || CASE WHEN len(y) > 0 THEN array_to_string(y, chr(10)) ELSE '// (see ' || p || ')' END AS z FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(ltrim(x, ' '), '^(?:{B.SIGNATURES})')) AS y FROM n)),
q AS (SELECT m, p, z, sum(k) OVER (PARTITION BY m) AS total, k - length(z) // 4 AS won, length(t) AS size FROM g), u AS (SELECT m, p, z, total - coalesce(sum(won) OVER (PARTITION BY m ORDER BY size, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM q WHERE won > 0)
SELECT n.m AS module_id, n.p AS path, length(coalesce(u.z, n.t)) // 4 AS tokens, CAST(halvings AS INTEGER) AS halvings, CASE WHEN u.z IS NOT NULL THEN 'signatures' WHEN halvings > 0 THEN 'halved' ELSE 'whole' END AS form, md5(coalesce(u.z, n.t)) AS content_md5
FROM n LEFT JOIN (SELECT * FROM u WHERE over > {_BUDGET}) u ON u.m = n.m AND u.p = n.p""".replace("f AS (SELECT coalesce", "WITH RECURSIVE f AS (SELECT coalesce", 1))
def fitted_files(s, d):
    docs = read(s, d, "documents").select(F.coalesce("source", F.lit("-")).alias("module_id"), F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return B.fitted(docs, _BUDGET).select("module_id", "path", "tokens", "halvings", "form", F.md5("content").alias("content_md5"))


_INPUTS = """c AS (SELECT DISTINCT module_id, CAST(component_id AS VARCHAR) AS c FROM v_member WHERE snapshot = 1998), t AS (SELECT m.module_id, m.title, r.r_name || '/' || m.title AS path FROM v_module m JOIN region r ON m.parent_id = 'r' || r.r_regionkey),
j AS (SELECT module_id, string_agg(c || chr(0), '' ORDER BY c) AS ids, string_agg(sha256(c_name) || chr(0), '' ORDER BY c) AS src FROM c JOIN customer ON c = CAST(c_custkey AS VARCHAR) GROUP BY 1),
i AS (SELECT module_id, sha256(title || chr(0) || path || chr(0) || coalesce(ids, '') || coalesce(src, '') || 'en' || chr(0) || 'v7' || chr(0)) AS hash FROM t LEFT JOIN j USING (module_id))"""


def _inputs(s, d):
    modules = view(s, d, "v_module").where("depth = 2").join(read(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("parent_id"), "r_name"), "parent_id")
    members = view(s, d, "v_member").where("snapshot = 1998").select("module_id", "component_id")
    sources = read(s, d, "customer").select(F.col("c_custkey").alias("component_id"), F.col("c_name").alias("source_code"))
    return H.module_inputs(modules.select("module_id", "title", F.concat_ws("/", "r_name", "title").alias("path")), members, sources, ["en", "v7"])


@query(f"{_INPUTS} SELECT module_id, hash FROM i", "v_member", "v_module")
def module_input_hashes(s, d):
    return _inputs(s, d)


@query(f"""{_INPUTS}, l AS (SELECT module_id, parent_id, sha256(hash || chr(0)) AS hash FROM i JOIN v_module USING (module_id))
SELECT module_id, hash FROM l UNION ALL SELECT parent_id, sha256(chr(0) || string_agg(hash || chr(0), '' ORDER BY module_id)) FROM l GROUP BY 1""", "v_member", "v_module")
def tree_hashes(s, d):
    return H.tree_hashes(view(s, d, "v_module"), _inputs(s, d))


@query("""WITH n AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name || '-' || (p_size % 7) ELSE p_name END AS name FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) - 1 AS i FROM n),
m AS (SELECT name, count(*) AS c FROM n GROUP BY 1), f AS (SELECT a.name, k, row_number() OVER (PARTITION BY a.name ORDER BY k) AS i FROM m a CROSS JOIN LATERAL (SELECT unnest(range(1, a.c + 8)) AS k) WHERE a.name || '-' || k NOT IN (SELECT name FROM m))
SELECT r.p_partkey, CASE WHEN r.i = 0 THEN r.name ELSE r.name || '-' || f.k END AS free_name FROM r LEFT JOIN f ON f.name = r.name AND f.i = r.i""")
def free_names(s, d):
    name = F.when(F.col("p_size") % 3 == 0, F.concat_ws("-", "p_name", (F.col("p_size") % 7).cast("string"))).otherwise(F.col("p_name"))
    return R.free_names(read(s, d, "part").select("p_partkey", name.alias("name")), "name", ["p_partkey"]).select("p_partkey", "free_name")


def _diagrams(s, d):
    """A page with a diagram for each part; sizes decide on brackets, letters and quotes in it."""
    n = F.col("p_size")
    label = F.concat(F.lit("A["), "p_name", F.when(n % 5 == 0, "'s x").otherwise(""), F.when(n % 3 == 0, "").otherwise("]"), F.lit(" --> B"), F.when(n % 4 == 0, " é").otherwise(""), F.when(n % 7 == 0, "]]").otherwise(""))
    text = F.concat(F.lit("# "), "p_name", F.lit("\n\n```mermaid\ngraph TD\n"), label, F.lit("\nB & C --> D\n```\nend\n"))
    return M.blocks(read(s, d, "part").select(F.col("p_partkey").alias("file_name"), text.alias("text")))


_LABEL = "'A[' || p_name || CASE WHEN p_size % 5 = 0 THEN '''s x' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '' ELSE ']' END || ' --> B' || CASE WHEN p_size % 4 = 0 THEN ' é' ELSE '' END || CASE WHEN p_size % 7 = 0 THEN ']]' ELSE '' END"
_OPEN = "(1 - CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END - CASE WHEN p_size % 7 = 0 THEN 2 ELSE 0 END)"


@query(f"""WITH x AS (SELECT p_partkey AS file_name, {_LABEL} AS row, {_OPEN} AS open FROM part)
SELECT file_name, 0 AS block, 5 AS line, 'Unbalanced square brackets' AS issue FROM x WHERE open < 0 UNION ALL SELECT file_name, 0, 4, 'Unbalanced square brackets (+' || open || ')' FROM x WHERE open > 0
UNION ALL SELECT file_name, 0, 5, 'Non-ASCII characters outside quoted strings' FROM x WHERE contains(row, 'é') UNION ALL SELECT file_name, 0, 5, 'Single-quote character inside a node label bracket' FROM x WHERE contains(row, '''') AND contains(row, ']')""")
def diagram_issues(s, d):
    return M.issues(_diagrams(s, d))


@query(f"""SELECT p_partkey AS file_name, 'graph TD' || chr(10) || {_LABEL} || chr(10) || 'B --> D' || chr(10) || 'C --> D' || repeat(']', CAST(greatest({_OPEN}, 0) AS INTEGER)) AS cleaned FROM part""")
def diagram_clean_up(s, d):
    return _diagrams(s, d).select("file_name", M.cleaned(F.col("content")).alias("cleaned"))
