import random

from crawlframe.operators import graph


def walk(edges, src, limit):
    seen, node, hops = {src}, src, 0
    while node in edges:
        node, hops = edges[node], hops + 1
        if node in seen:
            return (None, None, "loop")
        seen.add(node)
        if hops > limit:
            return (None, None, "too_many")
    return (node, hops, "final")


def resolve(spark, edges, limit=10):
    df = spark.createDataFrame(list(edges.items()), "src string, dst string")
    return {r.src: (r.target, r.hops, r.outcome) for r in graph.resolve_redirects(df, limit).collect()}


def test_redirect_chains(spark):
    edges = {f"c{i}": f"c{i + 1}" for i in range(12)}
    edges |= {"self": "self", "a": "b", "b": "a", "tail": "a", "one": "end"}
    got = resolve(spark, edges)
    assert got == {src: walk(edges, src, 10) for src in edges}
    assert got["c2"] == ("c12", 10, "final") and got["c1"][2] == "too_many"


def test_long_loops(spark):
    edges = {f"r{i}": f"r{(i + 1) % 11}" for i in range(11)} | {f"l{i}": f"l{(i + 1) % 12}" for i in range(12)}
    assert resolve(spark, edges) == {src: walk(edges, src, 10) for src in edges}


def test_random_redirects_and_other_limits(spark):
    rng = random.Random(6)
    edges = {str(i): str(rng.randrange(300)) for i in range(200)}
    for limit in (1, 5):
        assert resolve(spark, edges, limit) == {src: walk(edges, src, limit) for src in edges}


def test_reachable(spark):
    links = [(i, i + 1) for i in range(12)] + [(3, 1), (50, 51), (12, 0), (0, 7)]
    df = spark.createDataFrame(links, "src bigint, dst bigint")
    seeds = spark.createDataFrame([(0,), (0,), (99,)], "node bigint")
    got = {r.node: r.depth for r in graph.reachable(seeds, df).collect()}
    assert got == {99: 0} | {i: i for i in range(7)} | {i: i - 6 for i in range(7, 13)}
    assert {r.node for r in graph.reachable(seeds, df, max_rounds=1).collect()} == {0, 1, 7, 99}


def test_redirects_end_at_another_authority(spark):
    edges = {"http://a/1": "http://a/2", "http://a/2": "http://b/1", "http://b/1": "http://b/2", "http://b/2": "http://b/3", "http://b/9": "http://b/9"}
    df = spark.createDataFrame(list(edges.items()), "src string, dst string")
    got = {r.src: (r.target, r.hops, r.outcome) for r in graph.resolve_redirects(df, same_authority=True).collect()}
    assert got == {
        "http://a/1": ("http://b/1", 2, "final"), "http://a/2": ("http://b/1", 1, "final"), "http://b/1": ("http://b/3", 2, "final"),
        "http://b/2": ("http://b/3", 1, "final"), "http://b/9": (None, None, "loop"),
    }
