"""Conversations and drift over streams, against batch."""

import os
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from gaugewright.streaming import stateful

START = datetime(2024, 5, 1, 8, 0)


@pytest.fixture(autouse=True)
def provider(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def streamed(spark, tmp_path, batches, schema, build):
    """Run ``build`` over files that come one a batch."""
    source = tmp_path / "source"
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{source}")
        files = sorted(source.glob("part-*.parquet"), key=lambda p: p.stat().st_mtime_ns)
        os.utime(files[-1], (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
    query = build(stream).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table("out").collect()


def test_conversations_equal_batch(spark, tmp_path):
    """Turns out of order within a batch and over batches, repeated, null; sessions that a late turn joins; then time passes."""
    rng = random.Random(2)
    rows = []
    for key in ("a", "b", None):
        at = 0
        for turn in range(14):
            at += rng.choice([1, 3, 5, 40, 70])
            rows.append((key, START + timedelta(minutes=at), turn, rng.choice(["user", "assistant", None]), rng.choice([f"t{turn}", None])))
    rows.append(rows[3])
    order = rows.copy()
    # by time, shuffled within half an hour: never later than the watermark allows
    order.sort(key=lambda r: r[1] + timedelta(minutes=rng.randint(0, 30)))
    size = -(-len(order) // 5)
    batches = [order[i : i + size] for i in range(0, len(order), size)]
    last = max(r[1] for r in rows)
    batches += [[("end", last + timedelta(hours=h), 0, "user", "x")] for h in (3, 6)]
    schema = "conv string, ts timestamp, turn int, role string, text string"
    got = streamed(spark, tmp_path, batches, schema, lambda s: stateful.assembled_conversations(s, "ts", "conv", "turn", "role", "text", "30 minutes", "60 minutes"))
    want = []
    by = defaultdict(list)
    for key, ts, turn, role, text in rows:
        by[key].append((ts, turn, role or "", text or ""))
    for key, turns in by.items():
        turns.sort()
        session = [turns[0]]
        for t in [*turns[1:], None]:
            if t is not None and t[0] - session[-1][0] < timedelta(minutes=30):
                session.append(t)
            else:
                want.append((key, session[0][0], session[-1][0] + timedelta(minutes=30), sorted(x[1:] for x in session)))
                session = [t]
    found = [(r["conv"], r["start"], r["end"], [tuple(t) for t in r["turns"]]) for r in got if r["conv"] != "end"]
    assert sorted(found, key=repr) == sorted(want, key=repr) and len(want) > 8


def test_turns_after_the_watermark_are_left_out(spark, tmp_path):
    schema = "conv string, ts timestamp, turn int, role string, text string"
    batches = [[("a", START, 0, "user", "x")], [("z", START + timedelta(hours=5), 0, "user", "x")], [("z", START + timedelta(hours=6), 0, "user", "x")], [("a", START + timedelta(minutes=1), 1, "user", "late")], [("z", START + timedelta(hours=9), 1, "user", "x")], [("z", START + timedelta(hours=12), 2, "user", "x")]]
    got = streamed(spark, tmp_path, batches, schema, lambda s: stateful.assembled_conversations(s, "ts", "conv", "turn", "role", "text"))
    assert [[t["text"] for t in r["turns"]] for r in got if r["conv"] == "a"] == [["x"]]


def test_drift_alarms(spark, tmp_path):
    """Two low windows in a row raise the alarm, a good one clears it; windows over several batches, NaN and null scores."""
    plan = {"a": [0.9, 0.5, 0.9, 0.5, 0.4, 0.3, 0.9], "b": [0.5, None, 0.5, 0.5, 0.9, 0.9, 0.9]}
    rows = []
    for i in range(7):
        for name, means in plan.items():
            at = START + timedelta(minutes=5 * i + 1)
            rows.append((name, at, float("nan")))
            rows.append((name, at, None))
            if means[i] is not None:
                rows += [(name, at, means[i] + d) for d in (-0.05, 0.05)]
    random.Random(1).shuffle(rows)
    rows.sort(key=lambda r: r[1] - timedelta(minutes=4 * (len(r[0]) % 2)))
    size = -(-len(rows) // 4)
    batches = [rows[i : i + size] for i in range(0, len(rows), size)] + [[("end", START + timedelta(hours=h), 1.0)] for h in (5, 9)]
    got = streamed(spark, tmp_path, batches, "slice string, ts timestamp, score double", lambda s: stateful.drift_alarms(s, "ts", "score", "slice", 0.8, 0.1))
    minutes = lambda r: int((r["start"] - START).total_seconds() // 60)
    assert sorted((r["slice"], minutes(r), r["state"]) for r in got) == [("a", 20, "alarm"), ("a", 30, "cleared"), ("b", 10, "alarm"), ("b", 20, "cleared")]
    assert {r["n"] for r in got} == {4}


class _Handle:
    """State and timers of one key, and how often they were called."""

    def __init__(self):
        self.calls, self.times = 0, set()

    def __getattr__(self, name):
        def called(*more):
            self.calls += 1
            return self if name.startswith("get") and more else getattr(self, f"_{name}")(*more)

        return called

    _rows: list = []

    def _exists(self):
        return bool(self._rows)

    def _get(self):
        return iter(self._rows)

    def _appendList(self, rows):  # noqa: N802
        self._rows = self._rows + rows

    def _put(self, rows):
        self._rows = rows

    def _clear(self):
        self._rows = []

    def _listTimers(self):  # noqa: N802
        return iter(self.times)

    def _registerTimer(self, at):  # noqa: N802
        self.times.add(at)

    def _deleteTimer(self, at):  # noqa: N802
        self.times.discard(at)


def test_state_is_called_a_few_times_a_key():
    """200 conversations of a key: each is given out once, by one timer, with a few calls of the state."""
    import pandas as pd

    class _At:
        def __init__(self, millis):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: millis

    times = [START + timedelta(hours=h, minutes=m) for h in range(200) for m in (0, 5)]
    rows = pd.DataFrame({"ts_": times, "turn_": range(400), "role_": "user", "text_": "x"})
    handle, found = _Handle(), stateful._Assembler(600_000)
    found.init(handle)
    list(found.handleInputRows(("a",), iter([rows]), None))
    assert len(handle.times) == 1
    over = stateful._millis(times[-3]) + 600_000
    out = pd.concat(found.handleExpiredTimer(("a",), _At(over), _At(over)))
    assert len(out) == 199 and {len(x) for x in out["turns"]} == {2}
    assert len(handle._rows) == 2 and handle.times == {stateful._millis(times[-1]) + 600_000} and handle.calls < 15
