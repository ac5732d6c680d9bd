"""Entries as state machines: events (artifact_id, event_id, ts, action) in order of time, in batch and as a stream.

Actions: plan, start, done, fail, invalidate. plan makes an entry missing unless it is valid; start makes it running, done valid,
fail failed; invalidate makes it stale unless it is missing. An entry that has been running for longer than the lease is
stale. start is expected of what is not running, done and fail of what is; other uses happen as well and are reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..shipping import ship

#: An entry may be running for so long.
LEASE = timedelta(minutes=30)
TRANSITIONS = "artifact_id string, event_id long, ts timestamp, action string, before string, after string, attempts int, legal boolean"
_SET = {"start": "running", "done": "valid", "fail": "failed"}


def step(status: str, action: str) -> tuple[str, bool]:
    """(status after an action, whether the action was expected)."""
    if action == "plan":
        return ("valid" if status == "valid" else "missing"), True
    if action == "invalidate":
        return ("missing" if status == "missing" else "stale"), True
    return _SET[action], (status == "running") == (action != "start")


def transitions(events: DataFrame, lease: timedelta = LEASE) -> DataFrame:
    """A row for each event with the status before and after it: windows by artifact, no loop.

    start, done and fail set the status whatever it was. Among the plans and invalidations that follow one of them: behind
    valid, a plan counts only after an invalidation; else a plan makes missing for good, an invalidation alone stale. Events
    with a null artifact_id, ts or unknown action drop out; equal times go by event_id.
    """
    known = events.where(F.col("action").isin("plan", "start", "done", "fail", "invalidate") & F.col("artifact_id").isNotNull() & F.col("ts").isNotNull())
    known = known.select(F.col("artifact_id").cast("string").alias("artifact_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "action")
    by = W.Window.partitionBy("artifact_id").orderBy("ts", "event_id")
    setting = F.col("action").isin(*_SET)
    known = known.withColumn("part", F.sum(setting.cast("int")).over(by))
    inside = W.Window.partitionBy("artifact_id", "part").orderBy("ts", "event_id")
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in _SET.items() for x in kv])[F.first(F.when(setting, F.col("action")), True).over(inside)], F.lit("missing"))
    known = known.withColumn("base", base).withColumn("stales", F.sum((F.col("action") == "invalidate").cast("int")).over(inside))
    plan = (F.col("action") == "plan") & ((F.col("base") != "valid") | (F.col("stales") > 0))
    known = known.withColumn("plans", F.sum(plan.cast("int")).over(inside))
    after = F.when((F.col("plans") > 0) | (F.col("base") == "missing"), "missing").when(F.col("stales") > 0, "stale").otherwise(F.col("base"))
    known = known.withColumn("after", after).withColumn("was", F.coalesce(F.lag("after").over(by), F.lit("missing"))).withColumn("then", F.lag("ts").over(by))
    over = (F.col("was") == "running") & (F.col("ts") > F.col("then") + F.expr(f"INTERVAL {int(lease.total_seconds())} SECONDS"))
    known = known.withColumn("before", F.when(over, "stale").otherwise(F.col("was")))
    attempts = F.sum(F.col("action").isin("done", "fail").cast("int")).over(by)
    return known.select("artifact_id", "event_id", "ts", "action", "before", "after", attempts.cast("int").alias("attempts"), _legal().alias("legal"))


def _legal() -> Column:
    running = F.col("before") == "running"
    return F.when(F.col("action") == "start", ~running).when(F.col("action").isin("done", "fail"), running).otherwise(True)


def _processor(lease: timedelta):
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Entries(StatefulProcessor):
        """Holds events until the watermark has passed them, then applies them in order; a timer ends what runs too long."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.held = handle.getListState("held", "event_id long, at long, action string")
            self.entry = handle.getValueState("entry", "status string, attempts int, at long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            for some in rows:
                micros = some["ts"].astype("datetime64[us]").astype("int64")
                self.held.appendList([(int(e), int(t), a) for e, t, a in zip(some["event_id"], micros, some["action"], strict=True)])
                for at in {int(t) // 1000 for t in micros}:
                    self.handle.registerTimer(at)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            upto = expiredTimerInfo.getExpiryTimeInMs() * 1000 + 999
            held = sorted(self.held.get(), key=lambda r: (r[1], r[0]))
            status, attempts, since = self.entry.get() if self.entry.exists() else ("missing", 0, 0)
            out = []
            for event, at, action in [(r[0], r[1], r[2]) for r in held if r[1] <= upto]:
                if status == "running" and at > since + lease // timedelta(microseconds=1):
                    status = "stale"
                after, legal = step(status, action)
                attempts += action in ("done", "fail")
                out.append((key[0], event, datetime.fromtimestamp(0) + timedelta(microseconds=at), action, status, after, attempts, legal))
                status, since = after, at
            if out:
                rest = [(r[0], r[1], r[2]) for r in held if r[1] > upto]
                self.held.put(rest) if rest else self.held.clear()
                self.entry.update((status, attempts, since))
                if status == "running":
                    self.handle.registerTimer((since + lease // timedelta(microseconds=1)) // 1000 + 1)
            elif status == "running" and upto > since + lease // timedelta(microseconds=1):
                self.entry.update(("stale", attempts, since))
                out.append((key[0], None, datetime.fromtimestamp(upto // 1_000_000), "expire", status, "stale", attempts, True))
            names = [f.split(" ")[0] for f in TRANSITIONS.split(", ")]
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({"event_id": "Int64"}) if len(frame) else frame

        def close(self) -> None:
            pass

    return Entries()


def stream(events: DataFrame, watermark: str = "1 hour", lease: timedelta = LEASE) -> DataFrame:
    """The same transitions of a stream of events, as soon as the watermark has passed them, and expiries of running entries.

    Events come in any order within the watermark. Needs a state store with timers (RocksDB) and the package on the workers.
    """
    ship(events.sparkSession)
    known = events.where(F.col("action").isin("plan", "start", "done", "fail", "invalidate") & F.col("artifact_id").isNotNull())
    known = known.select(F.col("artifact_id").cast("string").alias("artifact_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "action")
    return known.withWatermark("ts", watermark).groupBy("artifact_id").transformWithStateInPandas(statefulProcessor=_processor(lease), outputStructType=TRANSITIONS, outputMode="Append", timeMode="EventTime")


STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
