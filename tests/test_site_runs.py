"""Site runs kept as state with timers equal the runs of the whole table."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd

from crawlframe.session import work_path
from crawlframe.streaming import sites

SCHEMA = "event_id bigint, ts timestamp, site string, uri string, status int, location string"


def test_stream_equals_batch_over_shuffled_late_input(spark):
    rng = random.Random(11)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    events, t = [], 0
    for i in range(400):
        t += rng.choice([5, 30, 200, 2000])
        site = rng.choice(["a", "b", "c", "d"])
        root = f"https://{site}.example/"
        kind = rng.random()
        if kind < 0.15:
            row = (root + "robots.txt", rng.choice([200, 404, 503, 301]), rng.choice([None, "/elsewhere.txt"]))
        elif kind < 0.35:
            row = (root + f"p{rng.randrange(5)}", 301, f"/q{rng.randrange(5)}")
        else:
            row = (root + rng.choice([f"q{rng.randrange(5)}", f"p{rng.randrange(5)}"]), 200, None)
        events.append((i, start + timedelta(seconds=t), root, *row))
    # Ten files in time order, shuffled inside, and some rows one file late (less than the allowed lateness).
    files = [events[k * 40 : (k + 1) * 40] for k in range(10)]
    for k in range(9):
        for _ in range(4):
            files[k + 1].append(files[k].pop(rng.randrange(len(files[k]))))
        rng.shuffle(files[k])
    folder = work_path(spark, "runs-feed")
    for part in files:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    end = [(None, datetime(2100, 1, 1, tzinfo=timezone.utc), None, None, None, None)]
    for _ in range(2):
        spark.createDataFrame(end, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    out, state = work_path(spark, "runs-out"), work_path(spark, "runs-state")
    query = (sites.stream_site_runs(stream, idle_s=1500, late="1 day").writeStream.trigger(availableNow=True)
             .option("checkpointLocation", state).outputMode("append").format("parquet").start(out))
    query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    want = sorted(tuple(r) for r in sites.site_runs_batch(spark.createDataFrame(events, SCHEMA), idle_s=1500).collect())
    assert got == want
    assert {r[-1] for r in want} >= {"completed", "stalled"} and len(want) > 10


class Kept:
    """State of one key that counts its calls."""

    def __init__(self):
        self.calls, self.values = 0, {}
        self.timers = set()

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "get":
                return self.values.get(None)
            if name == "update":
                self.values[None] = args[0]
            elif name == "clear":
                self.values.clear()
            elif name == "getValue":
                return self.values[args[0]]
            elif name == "updateValue":
                self.values[args[0]] = args[1]
            elif name == "removeKey":
                del self.values[args[0]]
            elif name == "iterator":
                return iter(self.values.items())
            elif name == "listTimers":
                return iter(sorted(self.timers))
            elif name == "registerTimer":
                self.timers.add(args[0])
            elif name == "deleteTimer":
                self.timers.discard(args[0])
            elif name in ("getMapState", "getValueState"):
                state = Kept()
                self.values[args[0]] = state
                return state

        return call


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


def test_state_is_not_read_and_written_for_each_row():
    rng = random.Random(5)
    n, handle, runs = 3000, Kept(), sites.SiteRuns(1000)
    runs.init(handle)
    rows = [(rng.randrange(600_000), f"u{rng.randrange(900)}", f"u{rng.randrange(900)}" if rng.random() < 0.3 else None) for _ in range(n)]
    want, last = [], None
    for ms, uri, target in sorted(rows, key=lambda r: r[0]):
        if last is None or ms > last + 1000:
            want.append([ms, ms, 0, {}, {}])
        last = ms
        run = want[-1]
        run[1], run[2] = ms, run[2] + 1
        run[4][uri] = ms
        if target:
            run[3][target] = ms
    want = sorted((a * 1000, b * 1000, k, sum(got.get(u, -1) < ms for u, ms in asked.items())) for a, b, k, asked, got in want)
    frame = pd.DataFrame({"ms": [r[0] for r in rows], "uri": [r[1] for r in rows], "page": True, "refused": False,
                          "target": pd.Series([r[2] for r in rows], dtype=object)})
    for half in (frame[: n // 2], frame[n // 2 :]):
        assert list(runs.handleInputRows(("s",), iter([half[:500], half[500:]]), At(0))) == []
    calls = handle.calls + sum(s.calls for s in handle.values.values())
    assert calls < n / 10
    got, timers = [], sorted(handle.timers)
    while timers:  # a run ends at its own time, with one timer set at once
        handle.timers.discard(timers[0])
        for out in runs.handleExpiredTimer(("s",), At(timers[0]), At(timers[0])):
            got += [tuple(r)[1:5] for r in out.itertuples(index=False)]
        timers = sorted(handle.timers)
    assert sorted(got) == want and max(r[2] for r in want) > 300 and len(want) > 10
    assert not any(s.values for s in handle.values.values())
