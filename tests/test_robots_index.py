"""Robots decisions by a prefix table equal those that try every rule."""

import random

from crawlframe.operators import robots


def test_prefix_table_equals_every_rule(spark):
    rng = random.Random(12)
    words = ["/a", "/ab", "/b", "/the", "/x/y", "/*.php", "/*a$", "/en", "/", "*", "/a*b", "/p?q", "/$"]
    bodies = []
    for s in range(6):
        lines = ["User-agent: *"] + [f"{rng.choice(['Allow', 'Disallow'])}: {rng.choice(words)}" for _ in range(rng.randrange(0, 12))]
        bodies.append((f"https://s{s}.example/", "\n".join(lines)))
    sets = robots.rule_sets(spark.createDataFrame(bodies, "site string, body string"), "crawlframe")
    paths = ["/", "/a", "/abc", "/b.php", "/there", "/x/y/z", "/en/a", "/p?q=1", "/a/b", "/qa", "", "/index.php?x"]
    links = [(f"https://s{rng.randrange(7)}.example/", None) for _ in range(3)]
    links += [(site := f"https://s{rng.randrange(7)}.example/", site.rstrip("/") + rng.choice(paths)) for _ in range(400)]
    df = spark.createDataFrame(links, "site string, uri string")
    want = sorted(map(repr, robots.robots_decisions(df, sets).collect()))
    got = sorted(map(repr, robots.robots_decisions_indexed(df, sets).collect()))
    assert got == want
