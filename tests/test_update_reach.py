"""Reach brought up to date by changes equals a full run after each batch."""

import random

from crawlframe.operators import graph


def test_batches_of_edges_and_seeds(spark):
    rng = random.Random(3)
    schema = "src bigint, dst bigint"
    seeds = [(0,)]
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)]
    known = graph.reachable(spark.createDataFrame(seeds, "node bigint"), spark.createDataFrame(edges, schema))
    for batch in range(4):
        added = [(rng.randrange(40), rng.randrange(40)) for _ in range(15)]
        more = [(rng.randrange(40),)] if batch % 2 else []
        edges += added
        seeds += more
        known = graph.update_reach(
            known, spark.createDataFrame(edges, schema), spark.createDataFrame(added, schema),
            spark.createDataFrame(more, "node bigint"),
        )
        full = graph.reachable(spark.createDataFrame(seeds, "node bigint"), spark.createDataFrame(edges, schema))
        assert sorted(map(tuple, known.collect())) == sorted(map(tuple, full.collect()))
