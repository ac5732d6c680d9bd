"""Composed partitions against spelled-out cliques and plain graphs."""

import itertools
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tesserae.operators import clusters, modularity

WEIGHT = {("imports", "high"): 1.0, ("calls", "high"): 0.5, ("calls", "low"): 0.2, ("extends", "low"): 0.7}
EDGES, FILES = "from_id long, to_id long, edge_type string, confidence string", "component_id long, path string"


class Plain:
    """The same graph with every pair spelled out."""

    def __init__(self, edges, files):
        self.files, path, n = files, dict(files), len(files)
        pairs, of = defaultdict(float), defaultdict(list)
        for c, p in files:
            of[p].append(c)
        for a, b, k, c in edges:
            if a != b:
                pairs[min(a, b), max(a, b)] += WEIGHT[k, c]
        for a, b in itertools.combinations(range(n), 2):
            if path[a] == path[b]:
                pairs[a, b] += 0.3
        reach = {i: set() for i in range(n)}
        for a, b, _, _ in edges:
            for x in of[path[a]]:
                reach[x] |= set(of[path[b]]) - {x}
        self.directed = sum(map(len, reach.values()))
        while any((new := set().union(*(reach[y] for y in reach[x])) | reach[x]) != reach[x] and (reach.update({x: new}) or True) for x in reach):
            pass
        self.head = {x: min([x, *(y for y in reach[x] if x in reach[y])]) for x in reach}
        self.weights = defaultdict(float)
        for (a, b), w in pairs.items():
            a, b = sorted((self.head[a], self.head[b]))
            if a != b:
                self.weights[a, b] += min(w, 3.0)
        self.folders = defaultdict(set)
        for c, p in files:
            self.folders[p.split("/")[0] if "/" in p else "_root"].add(self.head[c])
        for members in self.folders.values():
            for pair in itertools.combinations(sorted(members), 2):
                self.weights[pair] += 2.0

    def modularity(self, label):
        total, degree, inner = sum(self.weights.values()), defaultdict(float), 0.0
        for (a, b), w in self.weights.items():
            degree[label[a]] += w
            degree[label[b]] += w
            inner += w * (label[a] == label[b])
        return inner / total - sum(k * k for k in degree.values()) / 4 / total / total


def graph(seed, n=36):
    r = random.Random(seed)
    files = [(i, f"d{i // 12}/f{i // 3}.py" if i < 33 else f"root{i}.py") for i in range(n)]
    edges = []
    for _ in range(80):
        a, b = r.randrange(n), r.randrange(n)
        b = b if r.random() < 0.3 else min(a // 12 * 12 + b % 12, n - 1)
        a, b = max(a, b), min(a, b)
        if a // 3 != b // 3:
            edges.append((a, b, *r.choice(list(WEIGHT))))
    return edges + [(0, 3, "imports", "high"), (30, 31, "calls", "low")], files  # a cycle of two files, a file that calls itself


@pytest.mark.parametrize(("seed", "few"), [(3, modularity.FEW), (4, 0)])
def test_partition_equals_spelled_out_cliques(spark, seed, few):
    edges, files = graph(seed)
    plain = Plain(edges, files)
    e, f = spark.createDataFrame(edges, EDGES), spark.createDataFrame(files, FILES)
    assert {r.component_id: r.head for r in clusters.cycle_heads(e, f).collect()} == plain.head and len(set(plain.head.values())) < len(files)
    assert sum(r.n_pairs for r in clusters.file_pairs(e, f).collect()) == plain.directed
    got = {r.component_id: (r.cluster, r["size"]) for r in clusters.partition(e, f, few=few).collect()}
    assert sorted(got) == [c for c, _ in files]
    members = defaultdict(set)
    for c, (k, _) in got.items():
        members[k].add(c)
    assert all(k == min(v) and {got[c][1] for c in v} == {len(v)} and (len(v) >= 3 or len(members) == 1) for k, v in members.items())
    label = {h: got[h][0] for h in plain.head.values()}
    assert all(got[c][0] == label[plain.head[c]] for c, _ in files)
    assert plain.modularity(label) >= plain.modularity({h: k for k, v in plain.folders.items() for h in v}) - 1e-9
    if few:  # one task sees cliques as plain links
        spelled = spark.createDataFrame([(a, b, w) for (a, b), w in plain.weights.items()], "u long, v long, w double")
        same = {r.node: r.community for r in modularity.communities(spelled).collect()}
        assert plain.modularity(label) == pytest.approx(plain.modularity(same))


def test_hubs_weigh_like_cliques(spark):
    """Degrees, modularity and best moves by sums equal those of spelled-out pairs, in any state."""
    r = random.Random(7)
    links = [(a, b, r.randrange(1, 9) * 1000) for a, b in itertools.combinations(range(24), 2) if r.random() < 0.1]
    members = [(n, n // 4, 3000, 1, 100 + n // 12) for n in range(24)] + [(n, 100 + n // 12, 20_000, 1, None) for n in range(24)]
    label = {n: r.randrange(9) for n in range(24)}
    both = spark.createDataFrame(links + [(b, a, w) for a, b, w in links], "u long, v long, w long")
    hubs = spark.createDataFrame(members, "node long, hub long, h long, m long, up long")
    weight = defaultdict(int)
    for a, b, w in links:
        weight[a, b] += w
        weight[b, a] += w
    for a, b in itertools.permutations(range(24), 2):
        weight[a, b] += 3000 * (a // 4 == b // 4) + 20_000 * (a // 12 == b // 12)
    degree = {a: sum(w for (x, _), w in weight.items() if x == a) for a in range(24)}
    assert {x.node: x.k for x in modularity._degrees(both, hubs).collect()} == degree
    total = sum(degree.values())
    nodes = spark.createDataFrame([(n, label[n], degree[n], float(total)) for n in range(24)], "node long, c long, k long, m2 double")
    best = {}
    for a in range(24):
        score = lambda c: sum(weight[a, b] for b in range(24) if b != a and label[b] == c) - degree[a] * sum(degree[b] for b in range(24) if b != a and label[b] == c) / total  # noqa: B023, E731
        to = max((c for c in set(label.values()) if c != label[a]), key=lambda c: (score(c), -c))
        if score(to) - score(label[a]) > 1e-9 * degree[a]:
            best[a] = pytest.approx(score(to) - score(label[a]))
    got = modularity._best(both, hubs, nodes, 1.0, 1e-9).collect()
    assert {x.node: x.gain for x in got} == best and best
    value = modularity.modularities(both, hubs, nodes.select("node", "k", F.lit(0).alias("g")), nodes.select("node", "c")).first().modularity
    inner = sum(w for (a, b), w in weight.items() if label[a] == label[b])
    assert value == pytest.approx(inner / total - sum((sum(degree[n] for n in range(24) if label[n] == c) / total) ** 2 for c in set(label.values())))


def test_strong_components_of_one_task_equal_those_of_rounds(spark):
    from tesserae.operators.graph import strong_components

    r = random.Random(9)
    edges = [(a, b) for a in range(30) for b in range(30) if r.random() < 0.05] + [(100, 101), (101, 100), (101, 102), (5, 5)]
    df = spark.createDataFrame(edges, "src long, dst long")
    reach = {n: {n} for e in edges for n in e}
    for _ in range(6):
        reach = {n: set().union(*(reach[b] | {b} for a, b in edges if a == n), s, *(reach[m] for m in s)) for n, s in reach.items()}
    want = set()
    for n in reach:
        same = {m for m in reach[n] if n in reach[m]}
        if len(same) > 1:
            want.add((n, min(same), len(same)))
    assert {tuple(x) for x in strong_components(df).collect()} == want == {tuple(x) for x in strong_components(df, few=0).collect()} and want


def test_small_and_odd_partitions(spark):
    none = spark.createDataFrame([], EDGES)
    two = spark.createDataFrame([(1, "a/x"), (2, None), (2, "b/y"), (None, "c")], FILES)
    assert sorted(map(tuple, clusters.partition(none, two).collect())) == [(1, 1, 2), (2, 1, 2)]
    assert clusters.partition(none, two.where("false")).count() == 0
    alone = spark.createDataFrame([(i, f"f{i // 4}/x{i}.py") for i in range(8)], FILES)
    odd = spark.createDataFrame([(0, None, "calls", "low"), (None, 1, "calls", "low"), (3, 99, "calls", "low"), (2, 2, "imports", "high")], EDGES)
    assert {(r.component_id, r.cluster) for r in clusters.partition(odd, alone).collect()} == {(i, i // 4 * 4) for i in range(8)}


def test_few_communities_of_a_hub_are_asked_and_the_best_is_among_them():
    """the edge holds the best other community for every weight of degrees, and far fewer than one for each number held."""
    import pyarrow as pa

    r = random.Random(1)
    rows = [(c, held, held * r.randrange(40, 60)) for c, held in enumerate(range(1, 400))] + [(1000, 5, 200), (1001, 5, 200), (1002, 10, 400)]
    table = pa.table({"hub": [7] * len(rows), "c": [x[0] for x in rows], "held": [x[1] for x in rows], "all_k": [x[2] for x in rows]})
    edge = set(modularity._edge(table).column("c").to_pylist())
    assert len(edge) < 60
    for weight in [0, *(r.random() / r.choice([10, 100, 1000]) for _ in range(200))]:
        weight = weight or 1e-9
        order = sorted(rows, key=lambda x: (weight * x[2] - x[1], x[0]))
        for own in (None, order[0][0]):
            best = next(x for x in order if x[0] != own)
            assert any(weight * x[2] - x[1] <= weight * best[2] - best[1] + 1e-9 for x in rows if x[0] in edge and x[0] != own)


def test_single_moves_settle_in_few_rounds(spark):
    """a drawn half of all gaining nodes goes in a round; modularity ends above where it began, with nothing left to gain."""
    r = random.Random(3)
    links = [(a, b, 10_000) for a, b in itertools.combinations(range(200), 2) if r.random() < (0.5 if a % 5 == b % 5 else 0.02)]
    both = spark.createDataFrame(links + [(b, a, w) for a, b, w in links], "u long, v long, w long").cache()
    degree = defaultdict(int)
    for a, b, w in links:
        degree[a] += w
        degree[b] += w
    label = {n: r.randrange(5) for n in range(200)}
    nodes = spark.createDataFrame([(n, degree[n], float(sum(degree.values())), label[n]) for n in range(200)], "node long, k long, m2 double, c long").cache()
    value = lambda x: modularity.modularities(both, None, nodes.select("node", F.lit(0).alias("g"), "k"), x.select("node", "c")).first().modularity
    after, turns = modularity._settled(both, None, nodes, 1.0, 1e-9, 0, 1e-3)
    assert turns <= 12 and value(after) > value(nodes) + 0.3
    rise = modularity._best(both, None, after, 1.0, 1e-9).agg(F.sum(F.col("gain") / F.col("m2"))).first()[0] or 0
    assert 2 * rise < 1e-3
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, modularity._settled(both.repartition(5), None, nodes.repartition(3), 1.0, 1e-9, 0, 1e-3)[0].collect()))


def _planted(r, n, groups, shift=0):
    return [(a + shift, b + shift, float(r.randrange(1, 4))) for a, b in itertools.combinations(range(n), 2) if r.random() < (0.4 if a % groups == b % groups else 0.08)]


def test_strong_components_in_a_row_are_cut_apart_in_few_rounds(spark, monkeypatch):
    """edges between unlike colours go, so 40 cycles, each with a way to the next, take rounds by the logarithm of their number."""
    from tesserae.operators import graph as g

    r = random.Random(2)
    names = r.sample(range(1000), 80)
    pairs = [names[2 * i : 2 * i + 2] for i in range(40)]
    edges = [e for a, b in pairs for e in ((a, b), (b, a))] + [(p[1], q[0]) for i, p in enumerate(pairs) for q in pairs[i + 1 :]]
    rounds = []
    trim = g._trim
    monkeypatch.setattr(g, "_trim", lambda *x: rounds.append(1) or trim(*x))
    got = {tuple(x) for x in g.strong_components(spark.createDataFrame(edges, "src long, dst long"), few=0).collect()}
    assert got == {(n, min(p), 2) for p in pairs for n in p} and len(rounds) <= 6


def test_groups_are_solved_by_a_task_each_however_many(spark, monkeypatch):
    """what is split alike takes no rounds over all groups unless one of them is large itself; groups keep their own communities."""
    r = random.Random(8)
    pairs = [x for i in range(4) for x in _planted(r, 30, 3, 30 * i)]
    links = modularity.both_ways(spark.createDataFrame(pairs, "u long, v long, w double")).cache()
    nodes = spark.createDataFrame([(n, n // 30) for n in range(120)], "node long, g long")
    found = {}
    for few in (links.count() // 2, 0):
        if few:
            monkeypatch.setattr(modularity, "_climb", lambda *_: pytest.fail("rounds"))
        got = {x.node: x.community for x in modularity._optimise(links, None, nodes, 1.0, 1e-9, few, 1e-3).collect()}
        monkeypatch.undo()
        assert sorted(got) == list(range(120)) and all(c // 30 == n // 30 for n, c in got.items())
        found[few] = sum(x.modularity for x in modularity.modularities(links, None, nodes.join(modularity._degrees(links, None), "node"), spark.createDataFrame(list(got.items()), "node long, c long")).collect())
    assert max(found.values()) < 1.1 * min(found.values())


def test_one_task_leaves_no_node_that_gains(spark):
    """merges of a small graph are followed by moves of its single nodes, in turn, until neither gains."""
    r = random.Random(5)
    links = modularity.both_ways(spark.createDataFrame(_planted(r, 150, 5), "u long, v long, w double")).cache()
    k = modularity._degrees(links, None)
    total = float(k.agg(F.sum("k")).first()[0])
    nodes = k.select("node", "k", F.lit(total).alias("m2"), F.col("node").alias("c"))
    labels = modularity._solved(links, None, nodes, 1.0, 1e-9)
    assert labels.count() == 150 and labels.select("c").distinct().count() < 20
    placed = nodes.drop("c").join(labels, "node")
    assert modularity._best(links, None, placed, 1.0, 1e-9).isEmpty()
    _, _, merged = modularity._contracted(links, None, nodes, labels)
    graph, _, _ = modularity._contracted(links, None, nodes, labels)
    assert modularity._best(graph, None, merged, 1.0, 1e-9).isEmpty()


def test_file_pairs_of_large_tables_hold_no_table_whole(spark, monkeypatch):
    from oracle import check, connect

    from tesserae import runtime
    from tesserae.plans.catalog import ORACLES, QUERIES
    from tesserae.sources.tables import read

    small = "/root/testdata/sf0.001"
    monkeypatch.setattr(runtime, "WHOLE_BYTES", 0, raising=False)
    monkeypatch.setattr(runtime, "SMALL_BYTES", 0, raising=False)
    monkeypatch.setattr(runtime, "TASK_BYTES", 10_000, raising=False)
    plan = QUERIES["file_pairs"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any("BroadcastHashJoin" in x and ("p_partkey" in x or "_id#" in x) for x in plan.splitlines())
    assert plan.count("ShuffledHashJoin") == 5
    lines = read(spark, small, "lineitem")
    n = runtime.tasks(lines)
    assert n > 8 and abs(runtime.tasks(lines.union(lines)) - 2 * n) <= 1
    assert re.search(rf"Exchange hashpartitioning\(l_orderkey#\w+, {n}\)", plan)  # the window's
    check(spark, connect(small), small, QUERIES["file_pairs"], ORACLES["file_pairs"])
    rows = spark.createDataFrame([(1, 2)], "from_id long, to_id long")
    assert runtime.file_bytes(rows) == 0 and runtime.matched(rows, "to_id", rows) is rows and runtime.spread(rows, "to_id") is rows
