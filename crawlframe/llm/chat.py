"""Reply trees to conversations in a chat template.

Messages name their parents. Root-to-leaf paths are found by iterated self-joins that double their reach:
after round k each message knows its ancestor 2**k steps up and the score on the way, so a thread
of a million replies takes twenty joins on unique message keys. Branches (leaves) of a tree are ranked by their summed score, and the
messages of the chosen ones are listed by the stored ancestors of each round in turn. A path becomes one text, as one
conversation always must; texts meet in one task only per conversation.

The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles ``\\`` becomes ``\\\\``
and ``<|`` becomes ``<\\|``, in roles a line end becomes ``\\n``; so no text holds a control string, and
``read_back`` recovers every turn. ``loss`` lists the code-point spans of the assistants' texts.

Nulls and repeats: null texts and roles are empty; a message whose parent is null or missing is a root; of messages with the same key
one stays (the least of parent, role, text, score); messages in or below a circle of parents have no
root and are left out; null scores count 0; branches of equal score are ranked by leaf; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.llm.common import map_batches
from crawlframe.operators.ordered import split_rank
from crawlframe.session import stored

START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans that are learned."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += head, body, f"{END}\n"
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def branches(messages: DataFrame, top: int | None = None) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(unique messages, chosen leaves with rank and score, ancestors 1, 2, 4, … steps up).

    ``messages``: tree, node, parent, role, text, score.
    """
    body = F.min(F.struct("parent", "role", "text", "score")).alias("m")
    unique = stored(messages.groupBy("tree", "node").agg(body).select("tree", "node", "m.*"), "messages")
    keys = unique.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = keys.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    step = keys.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("total"))
    state, jumps, open_before = stored(step, "paths"), [], None
    while (still := state.where("up IS NOT NULL").count()) and still != open_before:
        open_before = still
        jumps.append(state.where("up IS NOT NULL").select("tree", "node", "up"))
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"))
        going = state.where("up IS NOT NULL").join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"))
        state = stored(state.where("up IS NULL").select("tree", "node", "up", "total").union(going), "paths")
    replied = step.where("up IS NOT NULL").select("tree", F.col("up").alias("node")).distinct()
    leaves = state.where("up IS NULL").join(replied, ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    ranked = leaves.select("tree", F.col("node").alias("leaf"), F.col("total").alias("score"), F.row_number().over(order).alias("rank"))
    return unique, ranked if top is None else ranked.where(F.col("rank") <= top), jumps


def format_trees(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, score, formatted, loss): one row for each chosen branch."""
    tree_type, node_type = (messages.schema[c].dataType.simpleString() for c in ("tree", "node"))
    # Null trees are a tree of their own: keys are never null in the joins below.
    stand = messages.withColumn("tree", F.struct(F.col("tree").isNull().alias("n"), F.coalesce(F.col("tree").cast("string"), F.lit("")).alias("v")))
    unique, chosen, jumps = branches(stand.select("tree", "node", "parent", "role", "text", F.col("score").cast("double").alias("score")), top)
    chosen = stored(chosen, "leaves")
    on_path = chosen.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("bigint").alias("up"))
    for k in reversed(range(len(jumps))):
        higher = on_path.join(jumps[k].withColumnRenamed("up", "above"), ["tree", "node"])
        on_path = stored(on_path.union(higher.select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))), "on-path")
    texts = unique.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.struct((-F.col("up")).alias("at"), "role", "text")
    paths = on_path.join(texts, ["tree", "node"]).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    rows = paths.join(chosen, ["tree", "leaf"]).select(
        F.when(~F.col("tree.n"), F.col("tree.v")).cast(tree_type).alias("tree"), "leaf", "rank", "score", "turns"
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [render([(t["role"], t["text"]) for t in turns.as_py()]) for turns in batch.column(4)]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in made], kind)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:4], pa.array([f for f, _ in made], pa.string()), spans], names=["tree", "leaf", "rank", "score", "formatted", "loss"]
        )

    return map_batches(rows, work, f"tree {tree_type}, leaf {node_type}, rank int, score double, formatted string, loss array<struct<start bigint, end bigint>>")


def from_turns(rows: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages of plain conversations: each row answers the one before it, in the order of ``turn``.

    Null turns come first; rows of one turn are ordered by a hash of role and text. The place in a
    conversation is found by pieces, so a conversation of any length is numbered by many tasks.
    """
    cut = rows.select(
        F.col(tree).alias("tree"), "role", "text",
        F.coalesce(F.col(turn).cast("bigint"), F.lit(-(1 << 63))).alias("_turn"), F.xxhash64("role", "text").alias("_hash"),
    )
    placed = split_rank(cut, ["tree"], ["_turn", "_hash"], [F.col("_turn"), F.shiftright("_hash", 56)], name="node")
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return placed.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: DataFrame, learn: str = "assistant") -> DataFrame:
    """Digests of what ``formatted`` and its ``loss`` spans say: see the query's contract."""
    tree_type = formatted.schema["tree"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns, all_turns, loss, n = parse(text), hashlib.sha256(), hashlib.sha256(), 0
            for role, said in turns:
                all_turns.update(f"{role}\n{said}\n".encode())
            for s in spans:
                said = unescape(text[s["start"] : s["end"]])
                loss.update(said.encode())
                n += len(said)
            out.append((len(turns), all_turns.hexdigest(), n, loss.hexdigest(), len(text)))
        kinds = pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
        columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = f"tree {tree_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return map_batches(formatted.select("tree", "formatted", "loss"), work, schema)
