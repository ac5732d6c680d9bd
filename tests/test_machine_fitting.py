"""State machines as a stream and in batch; files fitted into budgets against a plain loop."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tesserae.operators import fitting
from tesserae.streaming import machine

EVENTS = "artifact_id string, event_id long, ts timestamp, action string"


def fold(rows, lease):
    """Event by event."""
    out, entries = [], {}
    for a, e, t, action in sorted(rows, key=lambda r: (r[2], r[1])):
        status, attempts, since = entries.get(a, ("missing", 0, None))
        if status == "running" and t > since + lease:
            status = "stale"
        after, legal = machine.step(status, action)
        attempts += action in ("done", "fail")
        out.append((a, e, t, action, status, after, attempts, legal))
        entries[a] = (after, attempts, t)
    return sorted(out)


def some_events(seed, n):
    r = random.Random(seed)
    at = datetime(2024, 1, 1)
    return [(f"a{r.randrange(6)}", i, at + timedelta(minutes=r.randrange(600)), r.choice(["plan", "start", "done", "fail", "invalidate"])) for i in range(n)]


def test_transitions_equal_a_fold(spark):
    rows = some_events(1, 400)
    got = machine.transitions(spark.createDataFrame([*rows, (None, 1, rows[0][2], "plan"), ("a0", 999, rows[0][2], "odd"), ("a0", 998, None, "plan")], EVENTS)).collect()
    want = fold(rows, machine.LEASE)
    assert sorted(map(tuple, got)) == want
    assert {(r[4], r[5]) for r in want} >= {("valid", "stale"), ("stale", "missing"), ("missing", "missing"), ("running", "failed")} and any(not r[7] for r in want)
    assert machine.transitions(spark.createDataFrame([], EVENTS)).count() == 0


def test_stream_of_shuffled_batches_equals_batch(spark, tmp_path):
    rows = some_events(2, 120)
    r = random.Random(3)
    r.shuffle(rows)
    late = [("z", 10_000, datetime(2024, 3, 1), "plan"), ("z", 10_001, datetime(2024, 4, 1), "plan")]  # move the watermark past all
    for k in range(4):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for row in late:
        spark.createDataFrame([row], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    before = {k: spark.conf.get(k, None) for k in machine.STORE}
    for k, v in machine.STORE.items():
        spark.conf.set(k, v)
    try:
        events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = machine.stream(events, "1 day").writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start()
        assert query.awaitTermination(240)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    got = [tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(x for x in got if x[1] is not None and x[0] != "z") == fold(rows, machine.LEASE)
    expired = {x[0] for x in got if x[3] == "expire"}
    last = {}
    for x in fold(rows, machine.LEASE):
        if x[0] not in last or (x[2], x[1]) > last[x[0]][:2]:
            last[x[0]] = (x[2], x[1], x[5])
    assert expired >= {a for a, x in last.items() if x[2] == "running"}


def loop(files, budget):
    """One module, file by file: {path: (content, halvings, form)}."""
    estimate = lambda t: len(t) // 4
    now = {p: (c, 0, "whole") for p, c in sorted(files.items())}
    total = sum(estimate(c) for c, _, _ in now.values())
    for _ in range(20):
        if total <= budget:
            break
        progress = False
        for p in sorted(now, key=lambda p: -len(now[p][0])):
            if total <= budget:
                break
            content, times, _ = now[p]
            lines = content.split("\n")
            if len(lines) <= 6:
                continue
            target = max(len(lines) // 2, 6)
            head = int(target * 0.6)
            cut = "\n".join(lines[:head]) + f"\n\n// ... ({len(lines) - target} lines truncated) ...\n\n" + "\n".join(lines[head - target :])
            if estimate(cut) >= estimate(content):
                continue
            total -= estimate(content) - estimate(cut)
            now[p], progress = (cut, times + 1, "halved"), True
        if not progress:
            break
    for p in sorted(now, key=lambda p: len(now[p][0])):
        if total <= budget:
            break
        content, times, _ = now[p]
        kept = [x for x in content.split("\n") if x.lstrip(" ").startswith(tuple(fitting.SIGNATURES.split("|")))]
        short = "// ── signatures only (body omitted) ──\n" + ("\n".join(kept) if kept else f"// (see {p})")
        if estimate(short) < estimate(content):
            total -= estimate(content) - estimate(short)
            now[p] = (short, times, "signatures")
    return now


@pytest.mark.parametrize("budget", [30, 400, 3000])
def test_fitting_equals_a_loop(spark, budget):
    r = random.Random(budget)
    words = ["def f(x):", "class A:", "    return 1", "", "x = y", "import os", "  # a comment of some length that goes on", "pub fn z() {"]
    rows = [(f"m{m}", f"p{p:02}", "\n".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 6, 7, 9, 12, 40, 300])))) for m in range(330) for p in range(r.randrange(1, 6))]
    rows += [("m0", "q", None), ("m1", "q", rows[0][2]), ("m1", "r", rows[0][2])]
    got = {(x.module_id, x.path): (x.content, x.halvings, x.form, x.tokens) for x in fitting.fitted(spark.createDataFrame(rows, "module_id string, path string, content string"), budget).collect()}
    modules = {}
    for m, p, c in rows:
        modules.setdefault(m, {})[p] = c or ""
    want = {(m, p): (*x, len(x[0]) // 4) for m, files in modules.items() for p, x in loop(files, budget).items()}
    assert got == want and {x[2] for x in want.values()} >= {"halved", "signatures" if budget < 400 else "whole"}
    assert fitting.fitted(spark.createDataFrame(rows, "module_id string, path string, content string").where("false"), budget).count() == 0
