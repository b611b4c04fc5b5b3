"""Alignment of two tokenizers' tokens by interval coalescing, and corpus-wide counts of linked ids.

Tokenizer A is a byte-level BPE (a ``tokenizers`` JSON file) that encodes a blank and the text; tokenizer B
is a SentencePiece model that encodes the text and puts its own blank in front. Special tokens are not
parsed: their strings are plain text. Each token is given its bytes (A: its vocabulary entry, byte-level
decoded; B: its piece in UTF-8 with the meta symbol as a blank and ``<0xHH>`` as byte HH), so both token
lists become intervals over the same bytes when each joins to the blank and the text.

Groups come from interval coalescing: all A and B tokens are lexsorted by (start, end), the running
maximum of their ends is taken, and a group breaks where a start reaches the running maximum; overlaps
widen a group within. A break is exactly a byte offset where an A token and a B token both end.
Links are the A-B token pairs whose byte ranges overlap: the union of both lists' ends cuts the bytes into
elementary pieces, each inside one A and one B token, and each gives one link. An (A id, B id) pair's count is
the number of documents that link it; ``n_best`` counts the links whose count is the highest of their A id.

The tokenizers run in the tasks on Arrow batches; the distinct pairs of each document with their number of
links go to Spark, which counts documents per pair with an aggregation that combines ahead of the shuffle
(a pair in every document is one row a task), takes the best count per A id, and joins the counts back.

Defined results: a null or empty text, or one whose joined A or B bytes are not the blank and the text in
UTF-8 (a B ``<unk>``, say), has no tokens: zeros and ``groups_sha256`` ''. Repeated rows are documents of
their own and count once each; a null ``doc_id`` stays null. Other columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import os
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.llm.common import map_batches
from crawlframe.session import stored

META = "▁"

DOCS = T.StructType([
    T.StructField("_rid", T.LongType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_a", T.LongType()),
    T.StructField("n_b", T.LongType()),
    T.StructField("n_groups", T.LongType()),
    T.StructField("n_links", T.LongType()),
    T.StructField("groups_sha256", T.StringType()),
    T.StructField("pairs", T.ArrayType(T.StructType([
        T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType()),
    ]))),
])


EMPTY = (np.zeros(0, np.int64),) * 3
PAIRS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]))
ARROW = pa.schema([(f.name, t) for f, t in zip(DOCS.fields, [pa.int64()] * 6 + [pa.string(), PAIRS], strict=True)])


def byte_level_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the other 68 for 256 and up, in order."""
    # The bytes that stand for themselves.
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    extra = (b for b in range(256) if b not in kept)
    chars = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(extra)}
    return {c: b for b, c in chars.items()}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(META, " ").encode()


def table_of(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All byte strings end to end, and where each starts (one more offset at the end)."""
    offsets = np.zeros(len(items) + 1, np.int64)
    offsets[1:] = np.cumsum([len(x) for x in items])
    return np.frombuffer(b"".join(items), np.uint8), offsets


def gather(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """The byte strings of ``ids`` end to end, in one vectorised step."""
    flat, offsets = table
    starts = offsets[ids]
    sizes = offsets[ids + 1] - starts
    at = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - at, sizes) + np.arange(sizes.sum())]


class Tools:
    """Both tokenizers, the bytes of every id and the decimal text of every id, once a Python worker.

    A's ids come from the JSON tokenizer, or, given ``a_ranks``, from tiktoken over the same vocabulary
    as ranks: this is checked on loading (every rank's bytes are the JSON entry's, byte-level decoded),
    and both give the same ids (tested); tiktoken is four times faster.
    """

    def __init__(self, a_json: str, b_model: bytes, a_ranks: bytes | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        alphabet = byte_level_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.b_bytes = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.sizes = (np.array([len(x) for x in self.a_bytes], np.int64), np.array([len(x) for x in self.b_bytes], np.int64))
        self.tables = (table_of(self.a_bytes), table_of(self.b_bytes))
        self.fast = None
        if a_ranks is not None:
            import base64

            import public_tokenizers
            import tiktoken

            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, a_ranks.splitlines())}
            if any(r >= len(self.a_bytes) or self.a_bytes[r] != x for x, r in ranks.items()):
                raise ValueError("the ranks are not the vocabulary of the JSON tokenizer")
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def a_ids(self, texts: list[str]) -> list[list[int]]:
        if self.fast is not None:
            return self.fast.encode_ordinary_batch(texts, num_threads=1)
        return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]


@cache
def loaded(a_json: str, b_model: bytes, a_ranks: bytes | None = None) -> Tools:
    return Tools(a_json, b_model, a_ranks)


def coalesce(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each A token and of each B token, from their byte sizes."""
    a_end, b_end = np.cumsum(a_sizes), np.cumsum(b_sizes)
    starts = np.concatenate([a_end - a_sizes, b_end - b_sizes])
    ends = np.concatenate([a_end, b_end])
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    opens = np.concatenate([[0], (starts[order][1:] >= reach[:-1]).astype(np.int64)])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens)
    return group[: len(a_sizes)], group[len(a_sizes) :]


def links(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A position, B position) of every overlapping pair, one per elementary piece of the bytes."""
    a_end, b_end = np.cumsum(a_sizes), np.cumsum(b_sizes)
    cuts = np.union1d(a_end, b_end)
    return np.searchsorted(a_end, cuts), np.searchsorted(b_end, cuts)


#: Decimal text of ids, each with room for the mark after it; the marks in ``a1,a2|b1;a3|b2,b3``.
DECIMAL = table_of([b"%d," % i for i in range(1 << 17)])
MARKS = np.frombuffer(b",|;", np.uint8)


def groups_text(a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> bytes:
    """Groups in order, each its A ids, a bar and its B ids, as UTF-8."""
    group = np.concatenate([a_group, b_group])
    side = np.concatenate([np.zeros(len(a_ids), np.int64), np.ones(len(b_ids), np.int64)])
    order = np.lexsort((side, group))
    group, side = group[order], side[order]
    ids = np.concatenate([a_ids, b_ids])[order]
    out = gather(DECIMAL, ids)
    ends = np.cumsum(DECIMAL[1][ids + 1] - DECIMAL[1][ids]) - 1
    out[ends[:-1]] = MARKS[np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))]
    return out[:-1].tobytes()


def align_one(text: str | None, tools: Tools, a_ids=None, b_ids=None) -> tuple:
    """(n_a, n_b, n_groups, n_links, groups_sha256, (A ids, B ids, links) of the distinct linked pairs) of one text."""
    none = (0, 0, 0, 0, "", EMPTY)
    if not text:
        return none
    body = (" " + text).encode()
    a_ids = np.asarray(tools.a_ids([" " + text])[0] if a_ids is None else a_ids, np.int64)
    b_ids = np.asarray(tools.b.encode(text) if b_ids is None else b_ids, np.int64)
    a_sizes, b_sizes = tools.sizes[0][a_ids], tools.sizes[1][b_ids]
    if a_sizes.sum() != len(body) or b_sizes.sum() != len(body):
        return none
    whole = np.frombuffer(body, np.uint8)
    if not (np.array_equal(gather(tools.tables[0], a_ids), whole) and np.array_equal(gather(tools.tables[1], b_ids), whole)):
        return none
    a_group, b_group = coalesce(a_sizes, b_sizes)
    i, j = links(a_sizes, b_sizes)
    pairs, counts = np.unique((a_ids[i] << 32) | b_ids[j], return_counts=True)
    digest = hashlib.sha256(groups_text(a_ids, b_ids, a_group, b_group)).hexdigest()
    return len(a_ids), len(b_ids), int(a_group[-1]) + 1, len(i), digest, (pairs >> 32, pairs & 0xFFFFFFFF, counts.astype(np.int64))


def per_document(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", id_col: str = "doc_id",
                 a_ranks_path: str | None = None) -> DataFrame:
    """One row per document: _rid, doc_id, counts, groups_sha256 and its distinct pairs with their links."""
    with open(a_path, encoding="utf-8") as f:
        a_json = f.read()
    with open(b_path, "rb") as f:
        b_model = f.read()
    a_ranks = None
    if a_ranks_path is not None:
        with open(a_ranks_path, "rb") as f:
            a_ranks = f.read()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tools = loaded(a_json, b_model, a_ranks)
        texts = batch.column(2).to_pylist()
        some = [k for k, t in enumerate(texts) if t]
        a_enc = tools.a_ids([" " + texts[k] for k in some])
        b_enc = tools.b.encode([texts[k] for k in some])
        rows = [align_one(None, tools)] * len(texts)
        for k, ae, be in zip(some, a_enc, b_enc, strict=True):
            rows[k] = align_one(texts[k], tools, ae, be)
        counts = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
        digests = pa.array([r[4] for r in rows], pa.string())
        lengths = np.array([len(r[5][0]) for r in rows], np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        fields = [pa.array(np.concatenate([r[5][k] for r in rows]), pa.int64()) for k in range(3)]
        pairs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=["a", "b", "n"]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts, digests, pairs], schema=ARROW)

    rows = docs.select(
        F.monotonically_increasing_id().alias("_rid"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return map_batches(rows, work, DOCS)


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", id_col: str = "doc_id",
          a_ranks_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    ``a_ranks_path``: A's vocabulary as tiktoken ranks, for faster encoding with the same ids (see ``Tools``).
    """
    rows = stored(per_document(docs, a_path, b_path, text_col, id_col, a_ranks_path), "align-docs")
    linked = rows.select(F.explode("pairs").alias("p")).select("p.a", "p.b")
    counts = linked.groupBy("a", "b").agg(F.count("*").alias("docs"))
    top = counts.groupBy("a").agg(F.max("docs").alias("top"))
    counts = stored(counts.join(top, "a").select("a", "b", "docs", (F.col("docs") == F.col("top")).alias("best")), "align-counts")
    per = rows.select("_rid", F.explode("pairs").alias("p")).select("_rid", "p.a", "p.b", "p.n").join(counts, ["a", "b"])
    per = per.groupBy("_rid").agg(
        F.sum(F.col("n") * F.col("docs")).cast("bigint").alias("count_sum"),
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("bigint").alias("n_best"),
    )
    out = rows.join(per, "_rid", "left")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0).cast("bigint")).alias("n_best"),
        F.coalesce("count_sum", F.lit(0).cast("bigint")).alias("count_sum"),
        "groups_sha256",
    )
