"""As-of join and robots.txt chains against plain loops."""

import datetime as dt
import random

from crawlframe.operators import asof, robots


def at(seconds):
    return dt.datetime.fromtimestamp(seconds, dt.UTC).replace(tzinfo=None)


def test_asof_against_a_scan(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", "b"]), rng.randrange(0, 50000)) for i in range(600)]
    probes = [(1000 + i, rng.choice(["hot", "a", "b", "none"]), rng.randrange(0, 52000)) for i in range(300)]
    probes += [(5000, "hot", rows[0][2] if rows[0][1] == "hot" else 7)]
    got = asof.asof_next(
        spark.createDataFrame([(i, k, at(t)) for i, k, t in rows], "id bigint, key string, ts timestamp"),
        spark.createDataFrame([(i, k, at(t)) for i, k, t in probes], "pid bigint, key string, ts timestamp"),
        stretch_s=600,
    ).collect()
    want = {}
    for pid, key, t in probes:
        later = [(rt, i) for i, k, rt in rows if k == key and rt >= t]
        want[pid] = min(later)[1] if later else None
    assert {r.pid: r.next_id for r in got} == want


def chain_log():
    """Sites with 0 to 12 redirects, loops, a cross-site answer, a missing answer, stale and late answers."""
    rows = []
    for n in range(13):
        site = f"https://s{n}.example/"
        for k in range(n + 1):
            uri = site + ("robots.txt" if k == 0 else f"r{k}/robots.txt")
            last = k == n
            rows.append((site, uri, 100 + 10 * k, 200 if last else 301, None if last else f"/r{k + 1}/robots.txt",
                         "User-agent: *\nDisallow: /x\n" if last else None))
            if k:
                rows.append((site, uri, 95 + 10 * k - 10, 500, None, None))  # before the redirect: not its answer
                rows.append((site, uri, 900 + k, 404, None, None))  # later than the answer
    rows += [("https://loop.example/", "https://loop.example/robots.txt", 100, 301, "/a", None),
             ("https://loop.example/", "https://loop.example/a", 110, 302, "https://loop.example/robots.txt", None),
             ("https://loop.example/", "https://loop.example/robots.txt", 120, 200, None, "User-agent: *\n"),
             ("https://away.example/", "https://away.example/robots.txt", 50, 301, "https://s0.example/robots.txt", None),
             ("https://gone.example/", "https://gone.example/robots.txt", 50, 301, "https://nowhere.example/robots.txt", None),
             ("https://wait.example/", "https://wait.example/robots.txt", 50, 302, "/later.txt", None),
             ("https://wait.example/", "https://wait.example/later.txt", 10, 200, None, "too early"),
             ("https://bare.example/", "https://bare.example/robots.txt", 50, 404, None, None),
             (None, None, None, None, None, None)]
    return rows


def test_chains(spark):
    schema = "site string, uri string, ts timestamp, status int, location string, body string"
    log = spark.createDataFrame([(s, u, None if t is None else at(t), st, loc, b) for s, u, t, st, loc, b in chain_log()], schema)
    got = {r.site: r for r in robots.robots_chains(log).collect()}
    for n in range(11):
        r = got[f"https://s{n}.example/"]
        assert (r.status, r.hops, r.looped, r.body) == (200, n, False, "User-agent: *\nDisallow: /x\n")
    for n in (11, 12):
        r = got[f"https://s{n}.example/"]
        assert (r.status, r.hops, r.looped) == (301 + 0, 11, False)
    assert (got["https://loop.example/"].looped, got["https://loop.example/"].hops) == (True, 2)
    assert (got["https://away.example/"].status, got["https://away.example/"].body) == (200, "User-agent: *\nDisallow: /x\n")
    assert (got["https://gone.example/"].status, got["https://gone.example/"].location) == (301, None)
    assert (got["https://wait.example/"].status, got["https://wait.example/"].hops) == (302, 1)
    assert got["https://bare.example/"].status == 404
    outcome = {r.site: r.outcome for r in robots.robots_outcome(robots.robots_chains(log), "crawlframe").collect()}
    assert outcome["https://s3.example/"] == "rules" and outcome["https://s12.example/"] == "redirect_overflow"
    assert outcome["https://loop.example/"] == "allow_all" and outcome["https://gone.example/"] == "skip"
    assert outcome["https://wait.example/"] == "follow" and outcome["https://away.example/"] == "rules"
    assert len(got) == 18


def test_empty_log(spark):
    schema = "site string, uri string, ts timestamp, status int, location string, body string"
    assert robots.robots_chains(spark.createDataFrame([], schema)).collect() == []
