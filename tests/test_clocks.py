"""Site clocks carried over rounds keep every gap at the wait, as a plain loop does."""

import random

from crawlframe.operators import frontier


def test_three_rounds(spark):
    rng = random.Random(6)
    clocks = spark.createDataFrame([], "site string, free_ms bigint")
    waits = spark.createDataFrame([("a/", 7.0), ("b/", 1.0)], "site string, wait_s double")
    times, free = {}, {}
    for r, start in enumerate([0, 3_000, 200_000]):
        rows = [(s, f"{s}{r}-{i}") for s in ("a/", "b/", "c/") for i in range(rng.randrange(0, 12))]
        fetches = spark.createDataFrame(rows, "site string, uri string")
        schedule, clocks = frontier.clocked_schedule(fetches, clocks, start, waits)
        clocks = spark.createDataFrame(clocks.collect(), "site string, free_ms bigint")
        got = schedule.collect()
        for row in got:
            times.setdefault(row.site, []).append(row.at_ms)
        # The loop: a site's slots start where its clock or the round does, whichever is later.
        wait = {"a/": 7000, "b/": 5000, "c/": 5000}
        for s in {x for x, _ in rows}:
            n = sum(1 for x, _ in rows if x == s)
            base = max(start, free.get(s, start))
            free[s] = base + n * (wait[s] + 199)
            assert all(base <= row.at_ms < free[s] for row in got if row.site == s)
        assert {c.site: c.free_ms for c in clocks.collect()} == free
    for s, ts in times.items():
        ts.sort()
        gaps = [b - a for a, b in zip(ts, ts[1:])]
        assert not gaps or min(gaps) >= {"a/": 7000}.get(s, 5000)
