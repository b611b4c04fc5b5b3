"""robots.txt bodies to rules, and rules to decisions.

A body is read inside its own row: groups are cut by pattern, so neither rules nor
delays need a shuffle. The size cap on bodies bounds the rules of a site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.functions import urls
from crawlframe.operators import asof
from crawlframe.session import stored

# Fixed pattern: the records that matter; anything else leaves groups as they are.
_RECORD = r"(?i)^\s*(user-agent|allow|disallow|crawl-delay)\s*:"


def _groups(body: Column) -> Column:
    """Array of group texts, one ``field:value`` record per line."""
    lines = F.split(F.regexp_replace(body, r"#[^\r\n]*|^\x{FEFF}", ""), r"[\r\n]+")
    records = F.transform(
        F.filter(lines, lambda line: line.rlike(_RECORD)),
        lambda line: F.concat(
            F.lower(F.trim(F.substring_index(line, ":", 1))),
            F.lit(":"),
            F.trim(F.regexp_replace(line, r"^[^:]*:", "")),
        ),
    )
    text = F.array_join(records, "\n")
    cut = F.regexp_replace(text, r"(?m)^((?!user-agent:).*)\n(?=user-agent:)", "$1\u0001")
    return F.split(cut, "\u0001")


def _chosen(groups: Column, agent: str) -> Column:
    """Groups that name our agent, or else those for everyone."""
    agents = lambda group: F.flatten(
        F.transform(
            F.regexp_extract_all(group, F.lit(r"(?m)^user-agent:(.*)$"), F.lit(1)),
            lambda name: F.split(F.lower(name), r"[\s,]+"),
        )
    )
    ours = lambda group: F.exists(
        agents(group), lambda name: (name != "") & F.lit(agent.lower()).startswith(name)
    )
    named = F.filter(groups, ours)
    return F.when(F.size(named) > 0, named).otherwise(
        F.filter(groups, lambda group: F.array_contains(agents(group), "*"))
    )


def _rule(record: Column) -> Column:
    """``allow:/x`` or ``disallow:/x*`` as allow flag, pattern, length and how to match it."""
    pattern = urls.percent_encode(F.regexp_replace(record, r"^[^:]*:", ""))
    open_end = F.regexp_replace(pattern, r"\$$", "")
    return F.struct(
        record.startswith("allow:").alias("allow"),
        pattern.alias("pattern"),
        F.length(pattern).alias("length"),
        F.when(pattern.rlike(r"[*]|\$$"), F.split(open_end, r"\*+")).alias("parts"),
        pattern.endswith("$").alias("closed"),
    )


def _fits(rule: Column, target: Column) -> Column:
    """Whether a pattern of parts fits: each is looked for behind the one before it, in one pass."""
    first, last = rule.parts[0], F.element_at(rule.parts, -1)
    middle = F.when(rule.closed, F.slice(rule.parts, 2, F.greatest(F.size(rule.parts) - 2, F.lit(0)))).otherwise(
        F.slice(rule.parts, 2, F.size(rule.parts))
    )

    def behind(at: Column, part: Column) -> Column:
        """First place behind ``part``, or 0 once one is missing."""
        found = F.call_function("locate", part, target, at)
        return F.when(at == 0, at).when(part == "", at).when(found > 0, found + F.length(part)).otherwise(0)

    start = F.when(target.startswith(first), F.length(first) + 1).otherwise(0)
    at = F.aggregate(middle, start, behind)
    ends = F.when(F.size(rule.parts) == 1, target == first).otherwise(
        target.endswith(last) & (F.length(target) - F.length(last) + 1 >= at)
    )
    return (at > 0) & (~rule.closed | ends)


def with_rules(robots_docs: DataFrame, agent: str) -> DataFrame:
    """Replace ``body`` by (rules, delay_s, allow_none); a null body gives nulls."""
    kept = [c for c in robots_docs.columns if c != "body"]
    grouped = robots_docs.select(*kept, _groups(F.col("body")).alias("_groups"))
    chosen = grouped.select(*kept, _chosen(F.col("_groups"), agent).alias("_chosen"))

    def records(fields: str) -> Column:
        pattern = F.lit(rf"(?m)^(?:{fields}):.*$")
        return F.flatten(F.transform("_chosen", lambda g: F.regexp_extract_all(g, pattern, F.lit(0))))

    delays = F.transform(
        records("crawl-delay"), lambda d: F.substring_index(d, ":", -1).try_cast("double")
    )
    ruled = chosen.select(
        *kept,
        F.filter(F.transform(records("allow|disallow"), _rule), lambda r: r.length > 0).alias("rules"),
        F.get(F.filter(delays, lambda d: d >= 0), F.lit(0)).alias("delay_s"),
    )
    closed = F.exists("rules", lambda r: ~r.allow & r.pattern.isin("/", "/*", "*")) & ~F.exists(
        "rules", lambda r: r.allow
    )
    return ruled.withColumn("allow_none", closed)


def rule_sets(robots_docs: DataFrame, agent: str) -> DataFrame:
    """(site, rules, delay_s, allow_none) of each robots document (site, body)."""
    return with_rules(robots_docs.select("site", "body"), agent)


def robots_rules(robots_docs: DataFrame, agent: str) -> DataFrame:
    """Rules for ``agent`` as rows (site, rule_no, allow, pattern)."""
    return rule_sets(robots_docs, agent).select(
        "site", F.posexplode("rules").alias("rule_no", "rule")
    ).select("site", F.col("rule_no").cast("bigint").alias("rule_no"), "rule.allow", "rule.pattern")


def robots_meta(robots_docs: DataFrame, agent: str) -> DataFrame:
    """(site, delay_s, allow_none, rules) of each robots body."""
    return rule_sets(robots_docs, agent).select(
        "site", "delay_s", "allow_none", F.size("rules").cast("bigint").alias("rules")
    )


def allowed_by(rules: Column, target: Column) -> Column:
    """Longest matching rule decides, allow wins ties, no match allows."""
    hits = F.filter(
        rules,
        lambda r: F.when(r.parts.isNull(), target.startswith(r.pattern)).otherwise(_fits(r, target)),
    )
    best = F.array_max(F.transform(hits, lambda r: F.struct(r.length.alias("length"), r.allow.alias("allow"))))
    return F.coalesce(best.getField("allow"), F.lit(True))


def robots_decisions(links: DataFrame, sets: DataFrame) -> DataFrame:
    """Add ``allowed`` to (site, uri) rows. ``sets`` has one row per site.

    The join keeps one row per link, and a site with a third of all links is cut up by
    Spark's skew join, since its other side is a single row.
    """
    target = F.concat(urls.path("uri"), urls.query("uri"))
    joined = links.withColumn("_target", target).join(sets.select("site", "rules"), "site", "left")
    return joined.withColumn("allowed", allowed_by(F.col("rules"), F.col("_target"))).drop("rules", "_target")


def robots_allow(links: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (site, uri) that robots.txt permits."""
    return robots_decisions(links, sets).filter("allowed").drop("allowed")


def robots_outcome(
    robots_log: DataFrame,
    agent: str,
    default_wait_s: float = 5.0,
    reconnect_above_s: float = 20.0,
    skip_above_s: float = 120.0,
    max_hops: int = 10,
) -> DataFrame:
    """What to do with each site after its last robots response.

    Input: (site, status, location, hops, looped, body). Output: (site, outcome, wait_s,
    reconnect), outcome being ``rules``, ``allow_all``, ``follow``, ``redirect_overflow``
    or ``skip``. Bodies are only read where the answer was 200.
    """
    body = F.when(F.col("status") == 200, F.col("body"))
    answered = robots_log.select(
        "site", "status", "location", "hops", "looped", body.isNull().alias("unread"), body.alias("body")
    )
    meta = with_rules(answered, agent)
    wait = F.coalesce("delay_s", F.lit(default_wait_s))
    outcome = (
        F.when(
            F.col("status") == 200,
            F.when(F.col("unread") | F.col("allow_none") | (wait > skip_above_s), F.lit("skip")).otherwise(
                F.lit("rules")
            ),
        )
        .when(
            F.col("status").between(300, 399),
            F.when(F.col("location").isNull(), F.lit("skip"))
            .when(F.col("looped"), F.lit("allow_all"))
            .when(F.col("hops") > max_hops, F.lit("redirect_overflow"))
            .otherwise(F.lit("follow")),
        )
        .when(F.col("status").isin(400, 403, 404, 500), F.lit("allow_all"))
        .otherwise(F.lit("skip"))
    )
    judged = meta.withColumn("outcome", outcome)
    wait_s = F.when(F.col("outcome") == "rules", wait).when(F.col("outcome") == "allow_all", F.lit(default_wait_s))
    return judged.select(
        "site", "outcome", wait_s.alias("wait_s"),
        ((F.col("outcome") == "rules") & (wait > reconnect_above_s)).alias("reconnect"),
    )


def robots_cross_domain(robots_log: DataFrame) -> DataFrame:
    """Robots documents that apply to a site by a redirect to another authority.

    Input: (site, uri, status, location, body). Output: (site, robots_uri, body) with the
    body found at the redirect's target and the site that was redirected.
    """
    moved = robots_log.filter("status BETWEEN 300 AND 399 AND location IS NOT NULL")
    hops = moved.select("site", "uri", F.array("location").alias("_hrefs")).select(
        "site", "uri", F.explode(urls.resolved("uri", "_hrefs")).alias("_to")
    ).select("site", "uri", F.col("_to.url").alias("robots_uri"))
    away = hops.filter(urls.address("uri") != urls.address("robots_uri")).select("site", "robots_uri")
    found = robots_log.filter("status = 200").groupBy(F.col("uri").alias("robots_uri")).agg(F.min("body").alias("body"))
    return away.join(found, "robots_uri").select("site", "robots_uri", "body")


def robots_chains(fetches: DataFrame, max_hops: int = 10, stretch_s: int = asof.STRETCH_S) -> DataFrame:
    """Each site's robots.txt answer after following its redirects through a fetch log.

    Input: (site, uri, ts, status, location, body), a row per response, in any order. Output: (site, status,
    location, hops, looped, body), the input of ``robots_outcome``. A site's chain starts at its first
    response for ``<site>robots.txt``; a redirect (3xx with a location) is resolved against its URI and
    followed to the first response for its target at or after its own time (an as-of join). The chain ends at
    a response that is no redirect; at a redirect whose target it has seen (``looped``); at redirect
    ``max_hops + 1`` (``hops`` above ``max_hops``); at a redirect with no later response for its target yet
    (``follow``); or at a redirect to another authority, where the rules found there apply to the first site:
    the target's next response, if it is a 200, gives status 200 and its body, else the location is dropped
    (``skip``). ``hops`` counts the redirects taken and the one that ends the chain.

    Chains are followed a hop per round for all sites at once, over the redirects only; each round's
    sites are one row each, and the rounds are bounded by ``max_hops``. Sites with no robots.txt response
    have no row.
    """
    rows = stored(
        fetches.select("site", "uri", "ts", "status", "location", "body").withColumn("id", F.monotonically_increasing_id()),
        "robots-fetches",
    )
    moved = rows.where(F.col("status").between(300, 399) & F.col("location").isNotNull()).select(
        "id", "uri", "ts", F.array("location").alias("_hrefs")
    )
    moved = moved.select("id", "uri", "ts", F.element_at(urls.resolved("uri", "_hrefs"), 1)["url"].alias("target"))
    moved = moved.withColumn("away", urls.address("uri") != urls.address("target"))
    found = asof.asof_next(
        rows.select("id", F.col("uri").alias("key"), "ts"),
        moved.where(F.col("target").isNotNull()).select(F.col("id").alias("pid"), F.col("target").alias("key"), "ts"),
        stretch_s,
    )
    links = stored(moved.join(found, moved.id == found.pid, "left").select("id", "target", "away", "next_id"), "robots-links")
    first = rows.where(F.col("uri") == F.concat("site", F.lit("robots.txt"))).groupBy("site").agg(
        F.min(F.struct("ts", "id"))["id"].alias("cur")
    )
    state = first.select("site", "cur", F.array(F.concat("site", F.lit("robots.txt"))).alias("seen"), F.lit(0).alias("hops"))
    ends = [state.where(F.lit(False)).select(
        "site", "cur", "hops", F.lit(False).alias("looped"), F.lit(False).alias("away"), F.lit(None).cast("long").alias("next_id")
    )]
    for _ in range(max_hops + 1):
        if state.isEmpty():
            break
        step = state.join(links, state.cur == links.id, "left").drop("id")
        moving = F.col("target").isNotNull() & ~F.col("away")
        looped = moving & F.array_contains("seen", F.col("target"))
        go = moving & ~looped & (F.col("hops") + 1 <= max_hops) & F.col("next_id").isNotNull()
        step = stored(step.withColumn("looped", F.coalesce(looped, F.lit(False))).withColumn("go", F.coalesce(go, F.lit(False))), "robots-step")
        ends.append(step.where(~F.col("go")).select(
            "site", "cur", F.when(F.col("target").isNotNull(), F.col("hops") + 1).otherwise(F.col("hops")).alias("hops"),
            "looped", F.coalesce("away", F.lit(False)).alias("away"), "next_id",
        ))
        state = step.where("go").select("site", F.col("next_id").alias("cur"), F.array_append("seen", F.col("target")).alias("seen"),
                                        (F.col("hops") + 1).alias("hops"))
    ended = ends[0]
    for part in ends[1:]:
        ended = ended.unionByName(part)
    own = rows.select(F.col("id").alias("cur"), "status", "location", "body")
    there = rows.select(F.col("id").alias("next_id"), F.col("status").alias("t_status"), F.col("body").alias("t_body"))
    out = ended.join(own, "cur").join(there, "next_id", "left")
    granted = F.col("away") & (F.col("t_status") == 200)
    return out.select(
        "site",
        F.when(granted, F.lit(200)).otherwise(F.col("status")).alias("status"),
        F.when(F.col("away") & ~F.coalesce(granted, F.lit(False)), F.lit(None)).otherwise(F.col("location")).alias("location"),
        F.col("hops").cast("int").alias("hops"),
        "looped",
        F.when(F.col("away"), F.when(granted, F.col("t_body"))).otherwise(F.col("body")).alias("body"),
    )


def robots_decisions_indexed(links: DataFrame, sets: DataFrame) -> DataFrame:
    """``robots_decisions`` by a prefix table: no link is tried against every rule of its site.

    Rules become rows keyed by (site, head): the whole pattern of a literal rule, the part before the
    first ``*`` of a wildcard rule. Each link is looked up under the prefixes of its path and query, up to
    its site's longest head; a literal rule found there matches, a wildcard rule found there is tried on the
    whole target. The longest match decides, allow wins ties, no match allows. The lookups are one join on
    (site, prefix) with one row per rule on the other side, so a hot site's links are cut by Spark's skew join.
    """
    rules = sets.select("site", F.explode("rules").alias("rule")).select(
        "site", "rule", F.coalesce(F.col("rule.parts")[0], F.col("rule.pattern")).alias("_head")
    )
    rules = stored(rules, "robots-rules")
    longest = rules.groupBy("site").agg(F.max(F.length("_head")).alias("_longest"))
    target = F.concat(urls.path("uri"), urls.query("uri"))
    rows = stored(links.withColumn("_lid", F.monotonically_increasing_id()), "robots-links")
    probes = rows.select("_lid", "site", target.alias("_target")).join(longest, "site")
    probes = probes.select(
        "_lid", "site", "_target",
        F.explode(F.sequence(F.lit(0), F.least(F.length("_target"), F.col("_longest")))).alias("_k"),
    ).select("_lid", "site", "_target", F.substring("_target", 1, F.col("_k")).alias("_head"))
    found = probes.join(rules, ["site", "_head"]).where(
        F.col("rule.parts").isNull() | _fits(F.col("rule"), F.col("_target"))
    )
    best = found.groupBy("_lid").agg(F.max(F.struct(F.col("rule.length").alias("length"), F.col("rule.allow").alias("allow"))).alias("_best"))
    return rows.join(best, "_lid", "left").select(
        *[F.col(f"`{c}`") for c in links.columns], F.coalesce(F.col("_best.allow"), F.lit(True)).alias("allowed")
    )
