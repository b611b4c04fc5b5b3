"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND.

The test items are indexed: each word's list of (item, weight), in blocks of items with the
block's largest weight. A weight is the word's BM25 share of the item's score against itself, so
an item's score against a passage runs from 0 to 1 and one threshold serves all items. Every
passage of every training text is a query: windows of ``2 * span`` words, ``span`` apart, where
``span`` is the length of the longest item, so each occurrence of an item lies in one passage. All items above the threshold are
retrieved:

* the sum of the largest weights of a passage's words bounds every item's score: passages below the
  threshold are done;
* the sum of the block maxima bounds the items of a block: other blocks are skipped;
* in the blocks that remain, WAND's pivots pick the items whose words' bounds reach the threshold,
  and only those are scored.

A retrieved item counts as leaked if enough of the three-word windows of its question
and of its answer (its last sentence; the whole item if it has one only) are in the passage.

The index is cut into shards of at most ``SHARD_WORDS`` words, so what is sent to
the tasks is bounded whatever the number of items; texts are read once per shard. How many shards
there are depends on the number of words alone, not on files or partitions. Words
are runs of letters, digits and underscores, lower-cased.

Nulls and repeats: null and wordless texts and items match nothing; repeated items give a
row each if their ids differ; repeated documents get equal results; empty tables give empty results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.llm.common import map_batches
from crawlframe.session import stored

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
BLOCK = 8
#: Words of all items of a shard, at most (one longer item is a shard of its own).
SHARD_WORDS = 1 << 16
#: Words of a text that are worked on at once.
STRETCH = 1 << 16


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last."""
    parts = [w for s in re.split(r"(?<=[.!?])\s+", text) if (w := words_of(s))]
    if len(parts) < 2:
        whole = words_of(text)
        return whole, whole
    return [w for p in parts[:-1] for w in p], parts[-1]


@dataclass
class Shard:
    """Items, their words' numbers, and the index by word."""

    items: list[tuple[object, list[int], list[int]]]  # id, question, answer
    numbers: dict[str, int]
    starts: np.ndarray  # postings of word t: starts[t] to starts[t + 1]
    item: np.ndarray
    weight: np.ndarray
    block_max: np.ndarray  # by word and block of items
    best: np.ndarray  # by word
    span: int

    @classmethod
    def of(cls, rows: list, span: int) -> Shard:
        """From rows (id, text, words: [(word, weight)])."""
        vocabulary = sorted({w["word"] for r in rows for w in r["words"]})
        numbers = {w: i for i, w in enumerate(vocabulary)}
        posted = sorted((numbers[w["word"]], i, w["weight"]) for i, r in enumerate(rows) for w in r["words"])
        term = np.array([p[0] for p in posted], np.int64)
        item = np.array([p[1] for p in posted], np.int64)
        weight = np.array([p[2] for p in posted])
        block_max = np.zeros((len(numbers), -(-len(rows) // BLOCK)))
        np.maximum.at(block_max, (term, item // BLOCK), weight)
        items = [(r["id"], *([numbers[w] for w in part] for part in question_and_answer(r["text"]))) for r in rows]
        return cls(items, numbers, np.searchsorted(term, np.arange(len(numbers) + 1)), item, weight, block_max, block_max.max(1), span)

    def wand(self, terms: np.ndarray, block: int, threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items of a block that reach the threshold."""
        cursors, low, high = [], block * BLOCK, (block + 1) * BLOCK
        for t in terms.tolist():
            if (bound := self.block_max[t, block]) > 0:
                a, b = self.starts[t], self.starts[t + 1]
                a, b = a + np.searchsorted(self.item[a:b], (low, high))
                cursors.append([int(self.item[a]), float(bound), int(a), int(b)])
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for c in cursors:
                bound += c[1]
                if bound >= threshold:
                    pivot = c[0]
                    break
            if pivot < 0:
                break
            if cursors[0][0] == pivot:
                score = sum(float(self.weight[c[2]]) for c in cursors if c[0] == pivot)
                if score >= threshold:
                    found.append((pivot, score))
                pivot += 1
            for c in cursors:  # move every cursor that lies before the pivot
                while c[2] < c[3] and self.item[c[2]] < pivot:
                    c[2] += 1
                c[0] = int(self.item[c[2]]) if c[2] < c[3] else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def candidates(self, terms: np.ndarray, threshold: float):
        """(first word, item, score) of the passages of a text given as word numbers (-1: in no item)."""
        at = np.flatnonzero(terms >= 0)
        if not len(at):
            return
        # Each word lies in the passages that begin at (k - 1) * span and k * span.
        k = at // self.span
        key = np.unique(np.concatenate([k, k[k > 0] - 1]) * len(self.numbers) + np.concatenate([terms[at], terms[at][k > 0]]))
        passage, word = np.divmod(key, len(self.numbers))
        first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        slack = threshold - 1e-9  # sums are rounded
        hopeful = np.add.reduceat(self.best[word], first) >= slack
        last = np.append(first[1:], len(word))
        for a, b in zip(first[hopeful].tolist(), last[hopeful].tolist(), strict=True):
            bounds = self.block_max[word[a:b]].sum(0)
            for block in np.flatnonzero(bounds >= slack).tolist():
                for item, score in self.wand(word[a:b], block, slack):
                    yield int(passage[a]) * self.span, item, score


def overlap(part: list[int], grams: set, width: int) -> float:
    """Share of the windows of ``part`` that are among ``grams``."""
    width = min(width, len(part))
    windows = [tuple(part[i : i + width]) for i in range(len(part) - width + 1)]
    return sum(w in grams for w in windows) / len(windows)


def grams_of(passage: list[int], widths: set[int]) -> set:
    return {tuple(passage[i : i + n]) for n in widths for i in range(len(passage) - n + 1)}


def index(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(shard, id, text, words) of all items with words, and the length of the longest item.

    Word counts, document frequencies and weights are worked out by Spark.
    """

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([words_of(t.as_py()) for t in batch.column(1)], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([*batch.columns, found], names=["id", "text", "all"])

    slim = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    cut_schema = f"id {benchmark.schema[id_col].dataType.simpleString()}, text string, `all` array<string>"
    items = map_batches(slim, cut, cut_schema).where("size(`all`) > 0").withColumn("row", F.monotonically_increasing_id())
    items = stored(items, "items")
    facts = items.agg(F.count(F.lit(1)), F.avg(F.size("all")), F.max(F.size("all")), F.sum(F.size("all"))).first()
    count, mean, longest = facts[0], float(facts[1] or 1), int(facts[2] or 1)
    counted = items.select("row", F.size("all").alias("n"), F.explode("all").alias("word")).groupBy("row", "n", "word").agg(F.count(F.lit(1)).alias("tf"))
    common = counted.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.lit(count) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / mean))
    listed = counted.join(common, "word").groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("word", weight.alias("weight")))).alias("words"), F.sum(weight).alias("whole")
    )
    shares = F.transform("words", lambda w: F.struct(w["word"].alias("word"), (w["weight"] / F.col("whole")).alias("weight")))
    sized = items.join(listed, "row").select("row", "id", "text", F.size("all").alias("n"), shares.alias("words"))
    # Rows are dealt to buckets of half a shard by a hash of their number; a bucket that turns out fuller is cut.
    buckets = max(1, -(-2 * int(facts[3] or 0) // SHARD_WORDS))
    dealt = sized.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    local = Window.partitionBy("bucket").orderBy("id", "text", "row").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("n").over(local), F.lit(0))
    cut = dealt.withColumn("shard", F.concat_ws("#", "bucket", F.floor(ahead / SHARD_WORDS)))
    return stored(cut.select("shard", "id", "text", "words"), "shards"), longest


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.6,
    question: float = 0.6,
    answer: float = 0.6,
    width: int = 3,
) -> DataFrame:
    """Rows (doc id, item id, bm25, question_overlap, answer_overlap, first_word): one per document and leaked item."""
    shards, span = index(benchmark, item_col, item_text_col)
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("_id"), text_col)
    schema = (
        f"_id {docs.schema[id_col].dataType.simpleString()}, item bigint, bm25 double, "
        "question_overlap double, answer_overlap double, first_word bigint"
    )
    found = None
    numbers = [r.shard for r in shards.select("shard").distinct().orderBy("shard").collect()]
    for number in numbers:
        rows = shards.where(F.col("shard") == number).orderBy("id").collect()
        shared = spark.sparkContext.broadcast(Shard.of(rows, span))
        names = spark.createDataFrame([(i, r.id) for i, r in enumerate(rows)], f"item bigint, _item {benchmark.schema[item_col].dataType.simpleString()}")

        def work(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch | None:
            shard: Shard = shared.value
            owner, out = [], []
            for row, text in enumerate(batch.column(1)):
                best: dict[int, tuple] = {}
                terms = [shard.numbers.get(w, -1) for w in words_of(text.as_py())]
                # Stretches share a passage's length of words, so that no passage is cut.
                for s in range(0, max(1, len(terms)), STRETCH // span * span or span):
                    part = np.array(terms[s : s + max(STRETCH, span) + 2 * span], np.int64)
                    for first, item, score in shard.candidates(part, threshold):
                        _, asked, given = shard.items[item]
                        passage = terms[s + first : s + first + 2 * span]
                        grams = grams_of(passage, {min(width, len(asked)), min(width, len(given))})
                        q, a = overlap(asked, grams, width), overlap(given, grams, width)
                        if q >= question and a >= answer:
                            best[item] = max(best.get(item, (-1.0,)), (score, q, a, -(s + first)))
                owner += [row] * len(best)
                out += [(i, *best[i]) for i in sorted(best)]
            if not out:
                return None
            item, score, q, a, first = zip(*out, strict=True)
            columns = [pa.array(item, pa.int64()), *(pa.array(x, pa.float64()) for x in (score, q, a)), pa.array([-f for f in first], pa.int64())]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *columns], names=["_id", "item", "bm25", "question_overlap", "answer_overlap", "first_word"])

        some = map_batches(slim, work, schema).join(names, "item").drop("item")
        found = some if found is None else found.union(some)
    if found is None:
        found = spark.createDataFrame([], schema).withColumn("_item", F.lit(None).cast(benchmark.schema[item_col].dataType)).drop("item")
    return found.withColumnsRenamed({"_id": id_col, "_item": item_col})


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that hold a leaked item; documents are named by id and hash of their text."""
    name = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")).alias("_name")
    found = leaks(docs.select(name, text_col), benchmark, "_name", text_col, **how)
    bad = found.select(F.col("_name.id").alias("_leaked"), F.col("_name.text").alias("_leaked_text")).distinct()
    same = docs[id_col].eqNullSafe(bad["_leaked"]) & (F.xxhash64(docs[text_col]) == bad["_leaked_text"])
    return docs.join(bad, same, "left_anti")
