"""Prefix trie of conversations, named by van Emde Boas recursion.

Conversations are first *rebuilt*: conversation ``c`` takes the first ``h`` turns of conversation
``c - c % base`` (all of them if it has fewer, none if it is absent), then its own turns after its first ``h``;
``h`` is the unsigned CRC-32 of ``c`` in decimal, modulo ``shifts``. So conversations of one block of ``base``
share openings, the way chats forked from one prompt do.

A node of the trie is a distinct sequence of first ``d`` rebuilt turns (role, text); its members are the
conversations that start with it, and it is named by its smallest member (with its depth). Naming every
prefix directly would group every conversation by every one of its prefixes, which is quadratic in its
length. Instead all prefixes are named by the recursion of the van Emde Boas layout: a stretch of depths
``(lo, hi]`` below a named node is cut at half depth, the prefix at the cut is named by grouping on (name at
``lo``, turns ``lo+1 .. cut``), and the upper stretch ``(lo, cut)`` and the lower forest ``(cut, hi]``, rooted at
the new name, are named in the next round. All stretches of all conversations go through one grouping per
round, so the upper tries and lower forests are built side by side; there are ``log2`` of the longest
conversation rounds and every turn is grouped once a round.

Totals are grafted upward along member paths: each node's own amount (it is a leaf; its ``(n_convs - 1)``
times the code points of its last text) is put on its smallest member's path at its depth, suffix sums
along each rebuilt conversation give every (conversation, depth) what lies below it on that path, and a
node's total is the sum over its members: every node of its subtree is counted once, by its smallest member.

Turns are compared by the SHA-256 of (length of role, role, text); equal digests are taken as equal turns.
Groupings are aggregations (combined ahead of the shuffle) joined back by key, so a hot opening is cut by
Spark's skew join; one window per conversation orders its turns.

Defined results: turns are ordered by ``turn`` with nulls first, ties by role and text; a null role or text
is empty; rows without ``conv_id`` belong to no conversation and are dropped; repeated rows are turns of
their own; a conversation without turns (only possible as an absent base) is a member of the root only;
an empty table gives no rows (there is no conversation, so not even a root). Other columns are ignored.
``ends_sha256`` is the hash of the decimal ids of the members whose rebuilt conversation ends at the
node, numerically ascending and comma-joined; these ids are gathered in one row per node (8 bytes each).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.session import stored

#: Conversations ``c`` and ``c - c % BASE`` share their first turns.
BASE = 100
#: The number of shared turns is the CRC-32 of ``c`` modulo this.
SHIFTS = 6


def turns(conversations: DataFrame) -> DataFrame:
    """(c, pos, role, text) of every conversation, ``pos`` counting from 1."""
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("c"),
        F.col("turn").alias("_turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where(F.col("c").isNotNull())
    order = Window.partitionBy("c").orderBy(F.col("_turn").asc_nulls_first(), "role", "text")
    return rows.select("c", F.row_number().over(order).cast("int").alias("pos"), "role", "text")


def rebuild(conversations: DataFrame, base: int = BASE, shifts: int = SHIFTS) -> tuple[DataFrame, DataFrame]:
    """(c, m) of every conversation with its rebuilt length, and its rebuilt turns (c, pos, role, text)."""
    own = stored(turns(conversations), "trie-turns")
    sizes = own.groupBy("c").agg(F.count("*").cast("int").alias("n"))
    plan = sizes.select(
        "c", "n", (F.col("c") - F.col("c") % base).alias("b"),
        (F.crc32(F.col("c").cast("string")) % shifts).cast("int").alias("h"),
    )
    plan = plan.join(sizes.select(F.col("c").alias("b"), F.col("n").alias("n_b")), "b", "left")
    plan = plan.select("c", "b", "h", F.least("h", F.coalesce("n_b", F.lit(0))).alias("k"), "n")
    plan = stored(plan.withColumn("m", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie-plan")
    # Every base gives at most ``shifts - 1`` turns to at most ``base`` conversations.
    opening = own.where(F.col("pos") < shifts).withColumnRenamed("c", "b")
    head = plan.select("c", "b", "h").join(opening, "b").where(F.col("pos") <= F.col("h"))
    tail = own.join(plan.select("c", "h", "k"), "c").where(F.col("pos") > F.col("h"))
    rebuilt = head.select("c", "pos", "role", "text").unionByName(
        tail.select("c", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "role", "text")
    )
    return plan.select("c", "m"), stored(rebuilt, "trie-rebuilt")


def name_prefixes(plan: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(c, depth, name) for every conversation and depth 0 .. m; a name is the smallest member of the node.

    Stretches are cut at the same depths for all conversations (the halves of ``(0, longest]``), so each
    depth is named in one round by one key for all its members; a conversation that ends above a cut
    goes on in the upper stretch only.
    """
    spark = plan.sparkSession
    top = plan.agg(F.min("c").alias("root"), F.max("m").alias("longest")).first()
    if top["root"] is None:
        return spark.createDataFrame([], "c bigint, depth int, name bigint")
    root = F.lit(top["root"]).cast("bigint")
    symbol = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    paths = rebuilt.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("pos", symbol.alias("s")))).alias("p"))
    items = stored(
        paths.select("c", F.lit(0).alias("lo"), F.lit(top["longest"]).alias("hi"), root.alias("top"), F.col("p.s").alias("syms")),
        "trie-items",
    )
    named = [plan.select("c", F.lit(0).alias("depth"), root.alias("name"))]
    while not items.isEmpty():
        cut = (F.col("lo") + F.floor((F.col("hi") - F.col("lo") + 1) / 2)).cast("int")
        reach = F.col("lo") + F.size("syms")
        items = items.withColumn("cut", cut)
        keyed = items.where(reach >= F.col("cut")).withColumn("head", F.slice("syms", 1, F.col("cut") - F.col("lo")))
        names = keyed.groupBy("lo", "top", "head").agg(F.min("c").alias("name"))
        keyed = stored(keyed.join(names, ["lo", "top", "head"]).drop("head"), "trie-cut")
        named.append(keyed.select("c", F.col("cut").alias("depth"), "name"))
        upper = items.where(F.col("cut") > F.col("lo") + 1).select(
            "c", "lo", (F.col("cut") - 1).alias("hi"), "top", F.slice("syms", 1, F.col("cut") - 1 - F.col("lo")).alias("syms")
        )
        lower = keyed.where(reach > F.col("cut")).select(
            "c", F.col("cut").alias("lo"), "hi", F.col("name").alias("top"),
            F.slice("syms", F.col("cut") - F.col("lo") + 1, F.size("syms")).alias("syms"),
        )
        items = stored(upper.unionByName(lower).where(F.size("syms") > 0), "trie-items")
    out = named[0]
    for part in named[1:]:
        out = out.unionByName(part)
    return out


def trie(conversations: DataFrame, base: int = BASE, shifts: int = SHIFTS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    plan, rebuilt = rebuild(conversations, base, shifts)
    names = name_prefixes(plan, rebuilt)
    lengths = rebuilt.select("c", F.col("pos").alias("depth"), F.length("text").cast("bigint").alias("chars"))
    path = Window.partitionBy("c").orderBy("depth")
    rows = names.join(plan, "c").join(lengths, ["c", "depth"], "left").select(
        "c", F.col("depth").cast("int").alias("depth"), "name", "m",
        F.coalesce("chars", F.lit(0)).alias("chars"), F.lag("name").over(path).alias("parent"),
    )
    rows = stored(rows, "trie-rows")
    nodes = rows.groupBy("depth", "name").agg(
        F.count("*").alias("n_convs"),
        F.max("parent").alias("parent_conv_id"),
        F.max("chars").alias("chars"),
        F.sort_array(F.collect_list(F.when(F.col("m") == F.col("depth"), F.col("c")))).alias("ends"),
    )
    children = nodes.where(F.col("parent_conv_id").isNotNull()).groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("name")
    ).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, ["depth", "name"], "left").fillna(0, ["n_children"]), "trie-nodes")
    own = nodes.select(
        F.col("name").alias("c"), "depth",
        (F.col("n_children") == 0).cast("bigint").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    below = Window.partitionBy("c").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    graft = rows.select("c", "depth", "name").join(own, ["c", "depth"], "left").select(
        "depth", "name",
        F.sum(F.coalesce("leaf", F.lit(0))).over(below).alias("leaves"),
        F.sum(F.coalesce("saved", F.lit(0))).over(below).alias("saving"),
    )
    totals = graft.groupBy("depth", "name").agg(
        F.sum("leaves").cast("bigint").alias("n_leaves"), F.sum("saving").cast("bigint").alias("saved_tokens")
    )
    return nodes.join(totals, ["depth", "name"]).select(
        F.col("name").alias("conv_id"),
        F.col("depth").cast("bigint").alias("depth"),
        "parent_conv_id",
        F.col("n_convs").cast("bigint").alias("n_convs"),
        F.col("n_children").cast("bigint").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.sha2(F.array_join(F.transform("ends", lambda x: x.cast("string")), ","), 256).alias("ends_sha256"),
    )
