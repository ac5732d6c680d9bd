"""The provided tables and the code-graph views derived from them, in SQL that Spark and DuckDB run alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import matched, spread

VIEWS = {
    "v_component": """SELECT p_partkey AS component_id, p_name AS name, concat(p_type, '/', p_brand) AS file_path, p_type AS top_dir, p_size,
 CASE WHEN p_size % 5 = 0 THEN 'class' WHEN p_size % 5 = 1 THEN 'method' ELSE 'function' END AS component_type FROM part""",
    "v_part": "SELECT *, concat('M', p_size % 5) AS p_mfgr, concat('C', p_partkey % 40) AS p_container FROM part",
    "v_step": """SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_partkey AS from_id,
 lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax) AS to_id FROM lineitem""",
    "v_edge": """SELECT s.from_id, CASE WHEN p.p_size <= 45 THEN s.to_id END AS to_id, CASE WHEN p.p_size > 45 THEN p.p_name END AS to_unresolved,
 CASE s.l_returnflag WHEN 'A' THEN 'imports' WHEN 'N' THEN 'calls' ELSE 'extends' END AS edge_type,
 CASE WHEN p.p_size > 45 THEN 'low' WHEN s.l_linestatus = 'F' THEN 'high' ELSE 'medium' END AS confidence, s.l_orderkey AS ev_file, s.l_linenumber AS ev_line
 FROM v_step s JOIN part p ON p.p_partkey = s.to_id WHERE s.to_id IS NOT NULL""",
    "v_module": """SELECT concat('n', n_nationkey) AS module_id, concat('r', n_regionkey) AS parent_id, n_name AS title, 2 AS depth FROM nation
 UNION ALL SELECT concat('r', r_regionkey), 'root', r_name, 1 FROM region""",
    "v_member": """SELECT DISTINCT concat('n', c.c_nationkey) AS module_id, o.o_orderpriority AS lane, year(o.o_orderdate) AS snapshot, c.c_custkey AS component_id
 FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey""",
    "v_registry_event": """SELECT user_id AS artifact_id, event_id, ts,
 CASE event_type WHEN 'signup' THEN 'missing' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'valid' WHEN 'error' THEN 'failed' ELSE 'stale' END AS status FROM events""",
    "v_digraph": "SELECT DISTINCT from_id AS src, to_id AS dst FROM v_step WHERE to_id IS NOT NULL AND from_id <> to_id",
    "v_dag": "SELECT DISTINCT least(from_id, to_id) AS dst, greatest(from_id, to_id) AS src FROM v_step WHERE to_id IS NOT NULL AND from_id <> to_id",
    "v_file": "SELECT p_partkey AS component_id, concat(p_type, '/', p_brand, '/s', p_size, '.py') AS path FROM part",
    "v_layered": """SELECT CASE WHEN a.p_size >= b.p_size THEN e.from_id ELSE e.to_id END AS from_id, CASE WHEN a.p_size >= b.p_size THEN e.to_id ELSE e.from_id END AS to_id, e.edge_type, e.confidence
 FROM v_edge e JOIN part a ON a.p_partkey = e.from_id JOIN part b ON b.p_partkey = e.to_id""",
    "v_usage": "SELECT role AS model, conv_id, turn, CAST(length(text) AS BIGINT) AS chars FROM conversations",
}
#: Views that a view reads.
_NEEDS = {"v_edge": ["v_step"], "v_digraph": ["v_step"], "v_dag": ["v_step"], "v_layered": ["v_edge"]}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a lazy DataFrame; scans read only the columns and rows that its reader asks for.

    Large lineitem is dealt by order over tasks that grow in number with it, and so is part where the rows of a view are joined to it.
    """
    body = VIEWS[name]
    given = {v: view(spark, sf_dir, v) for v in _NEEDS.get(name, ())}
    rows = next(iter(given.values()), None)
    words = set(body.replace("(", " ").replace(",", " ").split())
    given |= {t: read(spark, sf_dir, t) for t in _TABLES if t in words}
    if name == "v_step":
        given["lineitem"] = spread(given["lineitem"], "l_orderkey")
    elif rows is not None and "part" in given:
        given["part"] = matched(given["part"], "p_partkey", rows)
    for v in given:
        body = " ".join(f"{{{v}}}" if w == v and before.upper() in ("FROM", "JOIN") else w for before, w in zip(["", *body.split()], body.split(), strict=False))
    return spark.sql(body, **given)


def ctes(*names: str) -> str:
    """The views as common table expressions for a DuckDB statement."""
    every: list[str] = []
    def add(n: str) -> None:
        for v in _NEEDS.get(n, []):
            add(v)
        if n not in every:
            every.append(n)

    for n in names:
        add(n)
    return ", ".join(f"{v} AS ({VIEWS[v]})" for v in every)
