"""Each site's run of activity as state with an event-time timer, appended when the run ends.

A run is what a site did with gaps of at most ``idle`` between its requests. A site's state holds its
open runs (first and last time, requests, pages, robots refusals) and the queue of each: when each URI was last
asked for as a redirect's target and last fetched. A row joins the open runs within ``idle`` of it, bridging them if it
falls between two, as a session window does, so the order in which rows arrive does not matter. An open
run ends when the watermark passes its last request plus ``idle``, and is put out: a
target waits if it was not fetched in the run since it was last asked for in the run. Its entries leave
the state. State is read and written once for a site's rows of a batch, not for each row.

A run's state: ``skipped`` if robots.txt was refused (a status that forbids a crawl, or a redirect without
a target), ``robots`` if only robots.txt was asked for, ``completed`` if nothing waits, else ``stalled``:
URLs wait, but the site did not answer for ``idle``.

Results equal ``site_runs_batch`` over the same rows, in any order, when every row arrives before the
watermark passes its run's end (a delay within ``late``); later rows are dropped. Rows without a time are dropped; rows without a
site only move the watermark (they are not filtered ahead of it, so a last such row can close a stream).
Targets are resolved by the URL functions in the JVM ahead of the state, so Python sees only short rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from crawlframe.functions import urls

OUTPUT = "site string, first_us long, last_us long, requests long, waiting long, state string"
#: Before all times.
NEVER = -(1 << 62)
#: Most URIs of a run that are kept beside it.
HELD = 256


def prepared(log: DataFrame) -> DataFrame:
    """(site, ts, ms, uri, page, refused, target) of each request, targets resolved against the URI."""
    robots = F.col("uri").endswith("/robots.txt")
    moved = F.col("status").between(300, 399)
    location = F.col("location") if "location" in log.columns else F.lit(None).cast("string")
    refused = robots & (
        (~F.col("status").isin(200, 400, 403, 404, 500) & ~moved) | (moved & location.isNull())
    )
    rows = log.where(F.col("ts").isNotNull()).select(
        "site", "ts", "uri", "status", location.alias("location"),
        F.coalesce(~robots, F.lit(True)).alias("page"), F.coalesce(refused, F.lit(False)).alias("refused"),
    )
    target = F.when(moved & F.col("location").isNotNull(), F.element_at(urls.resolved("uri", "_hrefs"), 1)["url"])
    return rows.withColumn("_hrefs", F.array("location")).select(
        "site", "ts", F.floor(F.unix_micros("ts") / 1000).cast("long").alias("ms"), "uri", "page", "refused", target.alias("target")
    )


def run_state(first: int, last: int, requests: int, pages: int, refused: int, waiting: int) -> str:
    if refused:
        return "skipped"
    if not pages:
        return "robots"
    return "completed" if waiting == 0 else "stalled"


def pieces(frame: pd.DataFrame, idle: int) -> list[list]:
    """Runs of the rows of one frame: [first, last, requests, pages, refused, parts, entries]."""
    ms = frame["ms"].to_numpy()
    order = np.argsort(ms, kind="stable")
    ms = ms[order]
    start = np.flatnonzero(np.diff(ms, prepend=ms[0] - idle - 1) > idle)
    end = np.append(start[1:], len(ms))
    pages, refused = (np.add.reduceat(frame[c].to_numpy(dtype=np.int64)[order], start).tolist() for c in ("page", "refused"))
    uris, targets = (frame[c].to_numpy()[order].tolist() for c in ("uri", "target"))
    times, runs = ms.tolist(), []
    for n, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        entries: dict[str, list[int]] = {}
        # In order of time, so the last ask and the last fetch stay.
        for at, uri, target in zip(times[a:b], uris[a:b], targets[a:b], strict=True):
            if isinstance(target, str):
                entries.setdefault(target, [NEVER, NEVER])[0] = at
            if isinstance(uri, str):
                entries.setdefault(uri, [NEVER, NEVER])[1] = at
        runs.append([times[a], times[b - 1], b - a, pages[n], refused[n], [], entries])
    return runs


def latest(a: dict[str, list[int]], b: dict[str, list[int]]) -> dict[str, list[int]]:
    """The later ask and the later fetch of each URI; the larger of both is changed."""
    if len(a) < len(b):
        a, b = b, a
    for uri, (asked, got) in b.items():
        have = a.setdefault(uri, [asked, got])
        have[0], have[1] = max(have[0], asked), max(have[1], got)
    return a


def bridged(runs: list[list], idle: int) -> list[list]:
    """Runs in order of time; those at most ``idle`` apart become one."""
    out: list[list] = []
    for run in sorted(runs, key=itemgetter(0)):
        if out and run[0] <= out[-1][1] + idle:
            have = out[-1]
            have[1] = max(have[1], run[1])
            have[2:6] = [x + y for x, y in zip(have[2:6], run[2:6], strict=True)]
            have[6] = latest(have[6], run[6])
        else:
            out.append(run)
    return out


class SiteRuns(StatefulProcessor):
    """A site's open runs with their queues in one value, read and written once a batch; long queues are put
    out to parts, which are read when their run ends. One timer: that of the run which may end first."""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.site = handle.getValueState("site", "open string")
        self.parts = handle.getMapState("parts", "number long", "entries string")

    def load(self) -> tuple[list[list], int | None, int]:
        """Open runs, the earliest timer that is set, and the number of the next part."""
        saved = self.site.get()
        return json.loads(saved[0]) if saved is not None else ([], None, 0)

    def save(self, runs: list[list], timer: int | None, number: int) -> None:
        if not runs:
            self.site.clear()
            return
        due = min(run[1] for run in runs) + self.idle + 1
        # A timer that is set for too early a time finds nothing to do and sets the next.
        if timer is None or due < timer:
            self.handle.registerTimer(due)
            timer = due
        self.site.update((json.dumps([runs, timer, number]),))

    def waiting(self, run: list) -> int:
        entries = run[6]
        for number in run[5]:
            entries = latest(entries, json.loads(self.parts.getValue((number,))[0]))
            self.parts.removeKey((number,))
        return sum(got < asked for asked, got in entries.values())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            # Rows without a site move the watermark only (a last request can close a stream).
            for _ in rows:
                pass
            return iter(())
        runs, timer, number = self.load()
        for frame in rows:
            if not len(frame):
                continue
            runs = bridged(runs + pieces(frame, self.idle), self.idle)
            for run in runs:
                if len(run[6]) > HELD:
                    self.parts.updateValue((number,), (json.dumps(run[6]),))
                    run[5], run[6], number = [*run[5], number], {}, number + 1
        self.save(runs, timer, number)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        runs, timer, number = self.load()
        ended = [run for run in runs if run[1] + self.idle + 1 <= due]
        waiting = [self.waiting(run) for run in ended]
        # The timers up to this time are used up; one for a later time may be set.
        self.save([run for run in runs if run[1] + self.idle + 1 > due], None if timer is None or timer <= due else timer, number)
        if ended:
            first, last, requests, pages, refused = ([run[i] for run in ended] for i in range(5))
            state = [run_state(*run[:5], n) for run, n in zip(ended, waiting, strict=True)]
            yield pd.DataFrame({"site": key[0], "first_us": [t * 1000 for t in first], "last_us": [t * 1000 for t in last],
                                "requests": requests, "waiting": waiting, "state": state})

    def close(self) -> None:
        pass


def stream_site_runs(log: DataFrame, idle_s: int = 600, late: str = "1 hour") -> DataFrame:
    """(site, first_us, last_us, requests, waiting, state) of each run, appended once its timer fires.

    ``log`` is a stream of (site, ts, uri, status) with ``location`` where known.
    """
    # Only whole milliseconds go to Python: the watermark stays with the plan.
    rows = prepared(log.withWatermark("ts", late)).drop("ts")
    return rows.groupBy("site").transformWithStateInPandas(
        SiteRuns(idle_s * 1000), OUTPUT, "Append", "EventTime"
    )


def site_runs_batch(log: DataFrame, idle_s: int = 600) -> DataFrame:
    """The same runs over a table: gaps over ``idle_s`` part runs; a run's queue by latest asks and fetches."""
    rows = prepared(log).where(F.col("site").isNotNull())
    # A session ends where the next request is ``idle_s`` and a millisecond or more later.
    spans = rows.groupBy("site", F.session_window("ts", f"{idle_s * 1000 + 1} milliseconds").alias("w")).agg(
        F.min("ms").alias("first"), F.max("ms").alias("last"), F.count("*").alias("requests"),
        F.count_if("page").alias("pages"), F.count_if("refused").alias("refused"),
    )
    # Each request finds its run: the run of its site that covers its time (runs of a site do not overlap).
    keyed = rows.join(spans.select("site", "first", "last"), "site").where(F.col("ms").between(F.col("first"), F.col("last")))
    asked = keyed.where(F.col("target").isNotNull()).groupBy("site", "first", F.col("target").alias("uri")).agg(F.max("ms").alias("asked"))
    got = keyed.groupBy("site", "first", "uri").agg(F.max("ms").alias("got"))
    waiting = asked.join(got, ["site", "first", "uri"], "left").where(F.col("got").isNull() | (F.col("got") < F.col("asked")))
    waiting = waiting.groupBy("site", "first").agg(F.count("*").alias("waiting"))
    runs = spans.join(waiting, ["site", "first"], "left").fillna(0, ["waiting"])
    state = (
        F.when(F.col("refused") > 0, F.lit("skipped")).when(F.col("pages") == 0, F.lit("robots"))
        .when(F.col("waiting") == 0, F.lit("completed")).otherwise(F.lit("stalled"))
    )
    return runs.select("site", (F.col("first") * 1000).alias("first_us"), (F.col("last") * 1000).alias("last_us"),
                       "requests", F.col("waiting").cast("long").alias("waiting"), state.alias("state"))
