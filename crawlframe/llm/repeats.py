"""Removal of repeated byte windows by a sparse, depth-limited radix order of suffixes.

A window is ``length`` bytes. Suffixes are ordered only as deep as a window, digit by digit
from the most significant, and a group of one is never looked at again; the groups that are
left at full depth are exactly the repeated windows. Ordering every byte's suffix would
move many times the input, so each pass works on as few suffixes as it can:

* **Which suffixes.** Every window stands for the suffix at its anchor: its 64-byte gram of
  the least hash, the rightmost if tied. Anchors depend on a window's bytes alone, so equal
  windows have equal anchors at equal places. Neighbouring windows share anchors: one is
  left for about 169 bytes, with the run of windows that it stands for.
* **First digit: the anchor's gram.** Anchors whose gram occurs once drop out.
* **Second digit: all bytes of the run.** Anchors whose whole runs are equal (copies, the
  inside of shared passages) are one group, counted ahead of the shuffle. All of it repeats.
* **Last digit: single windows.** For one member of each different run under a shared gram,
  the bytes of the run go to the gram's partition, where its windows are ordered and equal
  neighbours kept. Grams with over ``WIDE_GROUP`` different runs are not worked on in one
  task: their windows are dealt out one by one by hash, and counted.

Windows count as equal if their anchor's gram hash, their place at the anchor and their own
64-bit hash agree (polynomial hashes; the runs are far shorter than the strings that trouble
such hashes). Texts are worked on in stretches, so their length is not bounded.

With ``passage_words`` there is a second kind of window, which goes the same way in the same passes: so many words
in a row, from the first byte of the first to the last byte of the last, with grams of ``GRAM_WORDS`` words.

Nulls and repeats: a null text is an empty one; texts shorter than a window have no
windows; repeated rows repeat each other's windows and are removed whole if long enough. Rows are told apart
by id and text, so repeated or null ids do no harm. Other columns are passed through;
those named like an output column are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.llm.common import list_of, map_batches, raw, without
from crawlframe.session import discard, stored

GRAM = 64
#: Words of a passage's gram.
GRAM_WORDS = 8
#: Whether a byte belongs to a word.
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Windows worked on at once; below 2**24, the places that fit beside a hash.
STRETCH = 1 << 18
#: Most different runs under one gram that are ordered by one task (about 12 MB).
WIDE_GROUP = 20_000
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACE = np.uint64((1 << 24) - 1)


class Powers:
    """Powers of the base and its inverse, as far as they were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            steps = np.full(size, BASE), np.full(size, INVERSE)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up, self.down


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of any substrings of some bytes."""

    def __init__(self, body: np.ndarray):
        up, self.down = POWERS.upto(len(body) + 1)
        self.sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[: len(body)], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def least_grams(gram: np.ndarray, grams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each run of windows, which hold so many grams each."""
    place = np.arange(len(gram), dtype=np.uint64)
    least, width = (gram & ~PLACE) | (~place & PLACE), 1
    while 2 * width <= grams:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if rest := grams - width:
        least = np.minimum(least[:-rest], least[rest:])
    turn = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate([[0], turn])
    return (~least[first] & PLACE).astype(np.int64), first, np.concatenate([turn - 1, [len(least) - 1]])


def words_of(body: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; a word ends at an edge, too (edges are the places of texts put together)."""
    inside = IN_WORD[body]
    cut = np.zeros(len(body) + 1, bool)
    cut[edges] = cut[0] = cut[-1] = True
    return (
        np.flatnonzero(inside & (cut[:-1] | ~np.concatenate([[False], inside[:-1]]))),
        np.flatnonzero(inside & (cut[1:] | ~np.concatenate([inside[1:], [False]]))) + 1,
    )


def windows(offsets: np.ndarray, body: np.ndarray, length: int, words: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, end) of every window of texts put together: of ``length`` bytes, or of ``words`` words."""
    if words:
        start, end = words_of(body, offsets)
        owner = np.searchsorted(offsets, start, side="right") - 1
        n = max(len(start) - words + 1, 0)
        one = owner[:n] == owner[len(owner) - n :]
        return owner[:n][one], start[:n][one], end[len(end) - n :][one]
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    start = offsets[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, start, start + length


def passage_anchors(body: np.ndarray, words: int, length: int):
    """As ``anchors``, of windows of words; the last window is named by its end less ``length``, as theirs is."""
    starts, ends = words_of(body, np.zeros(0, np.int64))
    found = []
    for s in range(0, len(starts) - words + 1, STRETCH):
        start, end = starts[s : s + STRETCH + words - 1], ends[s : s + STRETCH + words - 1]
        at = start[0]
        hashes = Hashes(body[at : end[-1]])
        gram = mix(~hashes.at(start[: len(start) - GRAM_WORDS + 1] - at, end[GRAM_WORDS - 1 :] - at))
        anchor, first, last = least_grams(gram, words - GRAM_WORDS + 1)
        # Windows of ``length`` bytes and more are made of windows of the other kind, so a run without shorter ones is not needed.
        short = end[words - 1 :] - start[: len(start) - words + 1] < length
        some = np.logical_or.reduceat(short, first)
        anchor, first, last = anchor[some], first[some], last[some]
        a, b, place = start[first], end[last + words - 1], start[anchor]
        run = mix(~hashes.at(a - at, b - at) ^ mix((((place - a) << 32) + (b - a)).astype(np.uint64)))
        found.append((place, a, b - length, gram[anchor].view(np.int64), run.view(np.int64)))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else None


def anchors(body: np.ndarray, length: int):
    """Arrays (anchor, first window, last window, gram hash, run hash) of one text."""
    grams, found = length - GRAM + 1, []
    for s in range(0, len(body) - length + 1, STRETCH):
        part = body[s : s + STRETCH + length - 1]
        hashes = Hashes(part)
        gram = hashes.every(GRAM)
        anchor, first, last = least_grams(gram, grams)
        run = hashes.at(first, last + length)
        run = mix(run ^ mix(((anchor - first) * 1024 + (last - first)).astype(np.uint64)))
        found.append((anchor + s, first + s, last + s, gram[anchor].view(np.int64), run.view(np.int64)))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else None


def equal_windows(table: pa.Table, length: int, words: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, end) of each window of the runs (gram, offset, bytes), and whether it equals one of another run."""
    body, offsets = raw(table["_bytes"].combine_chunks())
    body, offsets = body[offsets[0] : offsets[-1]], offsets - offsets[0]
    owner, start, end = windows(offsets, body, length, words)
    hashes = np.empty(len(owner), np.uint64)
    done = 0
    for a in range(0, len(offsets) - 1, 512):  # few runs at once: small sums, small tables of powers
        b = min(a + 512, len(offsets) - 1)
        some = slice(done, done := int(np.searchsorted(owner, b)))
        hashes[some] = Hashes(body[offsets[a] : offsets[b]]).at(start[some] - offsets[a], end[some] - offsets[a])
    start, end = start - offsets[:-1][owner], end - offsets[:-1][owner]
    gram = table["_gram"].to_numpy()[owner]
    before = table["_before"].to_numpy()[owner] - start
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    same &= (gram[order][1:] == gram[order][:-1]) & (before[order][1:] == before[order][:-1])
    out = np.zeros(len(owner), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return owner, start, end, out


def runs_of(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the runs of set flags, within each owner's stretch."""
    edge = np.concatenate([[True], owner[1:] != owner[:-1], [True]])
    on = flags & (edge[:-1] | ~np.concatenate([[False], flags[:-1]]))
    off = flags & (edge[1:] | ~np.concatenate([flags[1:], [False]]))
    return np.flatnonzero(on), np.flatnonzero(off)


def merged(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, passage_words: int | None = None
) -> DataFrame:
    """All columns of ``docs``, and ``removed`` (spans of bytes) and ``kept`` (the bytes left).

    With ``passage_words`` also ``passages`` (the spans of what is in ``removed`` or in so many words in a row that
    also stand anywhere else, with equal bytes between them) and ``passage_free`` (the bytes outside these).
    """
    if length < 2 * GRAM or length > 1000:
        raise ValueError("windows of 128 to 1000 bytes")
    if passage_words is not None and not 2 * GRAM_WORDS <= passage_words <= 1000:
        raise ValueError("passages of 16 to 1000 words")
    kinds = [None, passage_words] if passage_words else [None]
    made = ["removed", "kept", *(["passages", "passage_free"] if passage_words else [])]
    docs = without(docs, *made)
    id_type = docs.schema[id_col].dataType.simpleString()
    key = ["_id", "_text_hash"]
    slim = docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(id_col, text_col).alias("_text_hash"),
        F.col(text_col).cast("binary").alias("_bytes"),
    ).where(F.octet_length(text_col) >= (min(length, 2 * passage_words - 1) if passage_words else length))

    def find(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        body, at = raw(batch.column(2))
        texts = [body[at[i] : at[i + 1]] for i in range(batch.num_rows)]
        parts = [anchors(t, length) for t in texts]
        if passage_words:
            parts += [passage_anchors(t, passage_words, length) for t in texts]
        counts = [len(p[0]) if p else 0 for p in parts]
        if not sum(counts):
            return None
        owner = np.repeat(np.arange(len(parts)) % len(texts), counts)
        words = np.repeat(np.arange(len(parts)) >= len(texts), counts)
        anchor, first, last, gram, run = (np.concatenate(x) for x in zip(*filter(None, parts), strict=True))
        # Equal runs of one text (a line said over and over) are one row with all their places.
        order = np.lexsort((first, run, gram, words, owner))
        same = [(x[order][1:] == x[order][:-1]) for x in (owner, words, gram, run)]
        head = np.flatnonzero(np.concatenate([[True], ~(same[0] & same[1] & same[2] & same[3])]))
        one, times = order[head], np.diff(np.append(head, len(order)))
        who = pa.array(owner[one])
        columns = [pa.array(x[one]) for x in (anchor, first, last, gram, run)]
        places = list_of(first[order], times, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(who), batch.column(1).take(who), *columns, pa.array(times), places, pa.array(words[one])],
            names=[*key, "_anchor", "_first", "_last", "_gram", "_run", "_times", "_places", "_words"],
        )

    numbers = "_anchor bigint, _first bigint, _last bigint, _gram bigint, _run bigint, _times bigint, _places array<bigint>, _words boolean"
    found = stored(map_batches(slim, find, f"_id {id_type}, _text_hash bigint, {numbers}"), "anchors", compression="zstd")

    one = F.struct(*key, "_anchor", "_first", "_last", "_words")
    runs = found.groupBy("_gram", "_run").agg(F.sum("_times").alias("_n"), F.min(one).alias("_one"))
    shared = runs.groupBy("_gram").agg(F.count(F.lit(1)).alias("_width")).where("_width > 1")

    # Whole runs that repeat.
    again = runs.where("_n > 1").select("_gram", "_run")
    spread = F.col("_last") - F.col("_first") + length
    whole = found.join(again, ["_gram", "_run"], "left_semi").select(*key, F.explode("_places").alias("a"), spread.alias("_size"), "_words")
    whole = whole.select(*key, "a", (F.col("a") + F.col("_size")).alias("b"), "_words")

    # One member of each different run, with its bytes.
    members = runs.join(shared, "_gram").select("_one.*", "_gram", "_n", "_width")
    # They are written first: the anchors' shuffles make room before the texts are shuffled.
    members = stored(members, "members", compression="zstd", release=True)
    wanted = members.groupBy(*key).agg(F.collect_list(F.struct("_gram", "_anchor", "_first", "_last", "_n", "_width", "_words")).alias("_want"))
    same_text = slim["_text_hash"].eqNullSafe(wanted["_text_hash"]) & slim["_id"].eqNullSafe(wanted["_id"])
    with_bytes = slim.join(wanted, same_text).select(wanted["_id"], wanted["_text_hash"], "_bytes", "_want")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        want = batch.column(3)
        owner, flat = pc.list_parent_indices(want), pc.list_flatten(want)
        body, at = raw(batch.column(2))
        first, last = flat.field("_first").to_numpy(), flat.field("_last").to_numpy()
        start = at[:-1][owner.to_numpy()] + first
        view = memoryview(body)
        pieces = [bytes(view[s:e]) for s, e in zip(start.tolist(), (start + last - first + length).tolist(), strict=True)]
        before = flat.field("_anchor").to_numpy() - first
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(owner), batch.column(1).take(owner), flat.field("_gram"), pa.array(before), pa.array(first),
             pa.array(flat.field("_n").to_numpy() == 1), flat.field("_width"), pa.array(pieces, pa.binary()), flat.field("_words")],
            names=[*key, "_gram", "_before", "_start", "_single", "_width", "_bytes", "_words"],
        )

    cut_schema = f"_id {id_type}, _text_hash bigint, _gram bigint, _before bigint, _start bigint, _single boolean, _width bigint, _bytes binary, _words boolean"
    pieces = stored(map_batches(with_bytes, cut, cut_schema), "runs", compression="zstd", release=True)
    discard(members)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches sorted by gram; the last gram of what has come waits for the rest of it."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            gram = batch.column(2)
            if held[0].column(2)[0] == gram[-1] or sum(b.num_rows for b in held) < 2000:
                continue
            end = pc.index(gram, gram[-1]).as_py()
            if end == 0 and held[-2].column(2)[-1] == gram[-1]:
                continue
            yield from settle(pa.Table.from_batches([*held[:-1], batch.slice(0, end)]))
            held = [batch.slice(end)]
        if held:
            yield from settle(pa.Table.from_batches(held))

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for words in kinds:
            some = table.filter(pc.equal(table["_words"], words is not None)).combine_chunks()
            if some.num_rows:
                yield from settle_kind(some, words)

    def settle_kind(table: pa.Table, words: int | None) -> Iterator[pa.RecordBatch]:
        owner, a, b, flags = equal_windows(table, length, words)
        first, last = runs_of(flags & table["_single"].to_numpy(zero_copy_only=False)[owner], owner)
        owner, a, b = owner[first], a[first], b[last]
        start = table["_start"].to_numpy()[owner]
        some = table.select(key).take(pa.array(owner))
        some = some.append_column("a", pa.array(start + a)).append_column("b", pa.array(start + b))
        some = some.append_column("_words", pa.array(np.full(len(owner), words is not None)))
        yield from some.combine_chunks().to_batches()

    spans = f"_id {id_type}, _text_hash bigint, a bigint, b bigint, _words boolean"
    narrow = pieces.where(F.col("_width") <= WIDE_GROUP).repartition("_gram").sortWithinPartitions("_gram")
    part = narrow.mapInArrow(order, spans)

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for words in kinds:
            some = batch.filter(pc.equal(batch.column(8), words is not None))
            body, at = raw(some.column(7))
            body, at = body[at[0] : at[-1]], at - at[0]
            owner, start, end = windows(at, body, length, words)
            hashes = Hashes(body).at(start, end)
            start, end = start - at[:-1][owner], end - at[:-1][owner]
            rows = pa.Table.from_batches([some]).select([*key, "_gram", "_single", "_words"]).take(pa.array(owner))
            rows = rows.append_column("_at", pa.array(some.column(3).to_numpy()[owner] - start))
            rows = rows.append_column("_start", pa.array(some.column(4).to_numpy()[owner] + start))
            rows = rows.append_column("_end", pa.array(some.column(4).to_numpy()[owner] + end))
            out.append(rows.append_column("_window", pa.array(hashes.view(np.int64))))
        batches = pa.concat_tables(out).combine_chunks().to_batches()
        return batches[0] if batches else None

    deal_schema = f"_id {id_type}, _text_hash bigint, _gram bigint, _single boolean, _words boolean, _at bigint, _start bigint, _end bigint, _window bigint"
    window = ["_gram", "_at", "_window"]
    single = map_batches(pieces.where(F.col("_width") > WIDE_GROUP), deal, deal_schema)
    twice = single.groupBy(*window).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    wide = single.where("_single").join(twice, window, "left_semi").select(*key, F.col("_start").alias("a"), F.col("_end").alias("b"), "_words")

    gone = whole.union(part).union(wide).groupBy(*key).agg(F.collect_list(F.struct("a", "b", "_words")).alias("_spans"))
    # The tables of anchors and runs make room before the texts are shuffled for the last time.
    gone = stored(gone, "spans", release=True)
    discard(found)
    discard(pieces)
    both = F.xxhash64(docs[id_col], docs[text_col]).eqNullSafe(gone["_text_hash"]) & docs[id_col].eqNullSafe(gone["_id"])
    body = docs[text_col].cast("binary").alias("_bytes")
    joined = docs.join(gone, both, "left").select(*[docs[c] for c in docs.columns], body, gone["_spans"])

    names = [*docs.columns, *made]

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        *rest, texts, lists = batch.columns
        outs: list[list] = [[] for _ in made]
        for text, spans in zip(texts, lists, strict=True):
            body, all_spans = text.as_py() or b"", spans.as_py() or []
            for n, words in enumerate(kinds):
                some = all_spans if words else [s for s in all_spans if not s["_words"]]
                out = merged(some, len(body))
                ends = [0, *[b for _, b in out]]
                outs[2 * n].append([{"start": a, "end": b} for a, b in out])
                outs[2 * n + 1].append(
                    b"".join(body[a:b] for a, b in zip(ends, [*[a for a, _ in out], len(body)], strict=True)) if out else body
                )
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        made_columns = [pa.array(x, pa.binary() if n % 2 else kind) for n, x in enumerate(outs)]
        return pa.RecordBatch.from_arrays([*rest, *made_columns], names=names)

    kind_of = {"removed": "array<struct<start bigint, end bigint>>", "passages": "array<struct<start bigint, end bigint>>"}
    extra = T.StructType.fromDDL(", ".join(f"{name} {kind_of.get(name, 'binary')}" for name in made))
    return map_batches(joined, keep, T.StructType([*docs.schema.fields, *extra.fields]))
