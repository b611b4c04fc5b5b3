"""The stored frontier over ten rounds against a plain set, and its plan."""

import random

from crawlframe.operators import frontier_store as fs


def test_ten_rounds(spark):
    rng = random.Random(2)
    store = fs.create(spark, "frontier_test")
    waiting = set()
    for _ in range(10):
        added = [(f"s{rng.choice([0, 0, 0, 1, 2])}/", f"u{rng.randrange(300)}") for _ in range(200)] + [(None, "x")]
        fetched = rng.sample(sorted(waiting), min(len(waiting), 80)) + [("s9/", "never")]
        store = fs.advance(store, spark.createDataFrame(added, "site string, uri string"),
                           spark.createDataFrame(fetched, "site string, uri string"))
        waiting = (waiting | {a for a in added if a[0] is not None}) - set(fetched)
        # What a round fetches was waiting before it; what it adds again after a fetch waits again.
        got = {tuple(r) for r in fs.waiting(spark, store).collect()}
        assert got == waiting
        counts = {r.site: r.pending for r in fs.pending(spark, store).collect()}
        want = {}
        for site, _ in waiting:
            want[site] = want.get(site, 0) + 1
        assert counts == want
    assert not spark.catalog.tableExists(f"{store.name}_uris_{store.version - 1}")
    fs.drop(spark, store)
    assert not spark.catalog.tableExists(store.uris)


def test_old_frontier_is_read_without_exchange(spark):
    store = fs.create(spark, "frontier_plan")
    store = fs.advance(store, spark.createDataFrame([("a/", "a/1")], "site string, uri string"),
                       spark.createDataFrame([], "site string, uri string"))
    old = fs.waiting(spark, store)
    taken = spark.createDataFrame([("a/", "a/1")], "site string, uri string").repartition(store.buckets, "site", "uri")
    plan = old.join(taken, ["site", "uri"], "left_anti")._jdf.queryExecution().sparkPlan().toString()
    fs.drop(spark, store)
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
