"""The sieve gives the rows of drop_viewed; extending equals building at once."""

import random

from crawlframe.operators import frontier, sieve


def test_sieve_equals_drop_viewed(spark):
    rng = random.Random(8)
    sites = ["https://hot.example"] * 6 + [f"https://s{i}.example" for i in range(5)]
    handled = [(s + "/", f"{s}/p{rng.randrange(400)}?q={rng.randrange(3)}") for s in (rng.choice(sites) for _ in range(1500))]
    candidates = [(s + "/", f"{s}/p{rng.randrange(500)}") for s in (rng.choice(sites) for _ in range(1500))]
    candidates += [(None, None), ("https://x.example/", None)]
    h = spark.createDataFrame(handled, "site string, uri string")
    c = spark.createDataFrame(candidates, "site string, uri string")
    blocks = sieve.blocks_for(len(handled))
    filters = sieve.build(h, blocks)
    got = sieve.sieve(c, filters, h, blocks)
    assert sorted(map(repr, got.drop("_hit").collect())) == sorted(map(repr, frontier.drop_viewed(c, h).collect()))
    rows = got.collect()
    false_hits = sum(1 for r in rows if r["_hit"])
    assert false_hits < 0.05 * len(rows)
    # Built in two steps or at once: the same bitmaps.
    half = sieve.extend(sieve.build(h.limit(700), blocks), h.subtract(h.limit(700)), blocks)
    assert sorted((r.block, bytes(r.bitmap)) for r in half.collect()) == sorted((r.block, bytes(r.bitmap)) for r in filters.collect())
