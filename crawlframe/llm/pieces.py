"""SentencePiece encoding and decoding that keeps every piece's place in the source.

The model file is read here: pieces, scores, kinds, the normaliser's switches and its
compiled character map (a double-array trie of source strings and the block of their
replacements). Normalising takes the longest prefix that the map knows, else one code
point, and notes for each piece of its output the source byte that it came from; blanks
become the meta symbol. Pairs of neighbouring symbols are then merged, best score first and
leftmost among equals; symbols unknown to the model become their UTF-8 bytes. As
the pieces follow each other without gaps, ``n + 1`` source offsets give all spans.

No piece of a model holds a meta symbol behind another symbol (this is checked; else the
text is one unit), so no merge crosses such a place: units are encoded apart and those seen lately are
kept. The others of many texts are merged side by side in arrays, one pair of each unit a round; long
ones with a heap. The map is applied to the whole text.

Nulls and repeats: a null or empty text has no pieces; repeated rows get equal results;
other columns are passed through, those named like an output column are replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from crawlframe.llm.common import list_of, map_batches, without

META = "▁"
UNKNOWN, CONTROL, USER, UNUSED, BYTE = 2, 3, 4, 5, 6
#: Units kept in a generation (there are two), and their longest.
KEPT, KEPT_LENGTH = 150_000, 64
#: Units of more code points are merged with a heap.
HEAP_FROM = 100
#: Short units merged together, and code points of the texts they are gathered from.
TOGETHER, AT_ONCE = 4096, 1 << 20
#: The rank of pairs that do not merge.
NONE = (1 << 31) - 1


def fields(body: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = body[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(body):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        part = body[at : at + size]
        at += size
        yield tag >> 3, struct.unpack("<f", part)[0] if kind == 5 else part


class CharMap:
    """The compiled character map: longest source prefix to replacement."""

    def __init__(self, blob: bytes):
        self.units = self.texts = None
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    def longest(self, body: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest entry that starts at a place."""
        if self.units is None:
            return None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node, found = offset(self.units[0]), None
        for i in range(at, len(body)):
            node ^= body[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != body[i]:
                break
            unit = self.units[node]
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if not found:
            return None
        return found[0], self.texts[found[1] : self.texts.index(0, found[1])]


class Pairs:
    """Pairs of neighbouring symbols that merge, as numbers; symbol 0 is any code point that no piece holds."""

    def __init__(self, ranks: dict[str, int], ids: dict[str, int], unknown: int):
        names = dict.fromkeys([c for piece in ranks for c in piece])
        names |= dict.fromkeys([piece for piece in ids if len(piece) == 1])
        names |= dict.fromkeys(ranks)
        numbers = {name: n for n, name in enumerate(names, 1)}
        self.count = len(numbers) + 1
        self.ids = np.array([unknown, *[ids.get(name, unknown) for name in names]], np.int32)
        self.rank = np.array([NONE, *[ranks.get(name, NONE) for name in names]], np.int32)
        self.symbol = np.zeros(0x110000, np.int32)
        for name, n in numbers.items():
            if len(name) == 1:
                self.symbol[ord(name)] = n
        known = numbers.get
        cuts = [(known(p[:i], 0), known(p[i:], 0), numbers[p]) for p in ranks for i in range(1, len(p))]
        left, right, both = np.array(cuts, np.int64).reshape(-1, 3).T
        keys, both = (left * self.count + right)[use := (left > 0) & (right > 0)], both[use]
        order = np.argsort(keys)
        # A last key that no pair reaches, so that each search ends at a key.
        self.keys = np.append(keys[order], self.count**2)
        self.both = np.append(both[order], 0).astype(np.int32)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol of each pair, 0 where it does not merge."""
        keys = left.astype(np.int64) * self.count + right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.both[at], 0)


class Model:
    def __init__(self, body: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        spec: dict[int, int | float | bytes] = {}
        trainer: dict[int, int | float | bytes] = {}
        for number, value in fields(body):
            if number == 1:
                piece = dict(fields(value))
                text, score, kind = piece[1].decode(), piece.get(2, 0.0), piece.get(3, 1)
                if kind in (1, USER, UNUSED):
                    scores[text] = score
                self.ids[text] = len(self.pieces)
                self.pieces.append(text)
                self.kinds.append(kind)
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                spec = dict(fields(value))
        if trainer.get(3) != 2 or USER in self.kinds or UNUSED in self.kinds or trainer.get(24):
            raise ValueError("a merge model without pieces of the user and blanks in front is needed")
        self.bytes = [self.ids.get(f"<0x{b:02X}>") for b in range(256)] if BYTE in self.kinds else None
        self.unknown = self.kinds.index(UNKNOWN)
        self.map = CharMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        order = {score: n for n, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {text: order[score] for text, score in scores.items()}
        self.pairs = Pairs(self.rank, self.ids, self.unknown)
        joined = any(re.search(f"[^{META}]{META}", p) for p in self.rank)
        self.unit = re.compile("(?s).+" if joined else f"{META}*[^{META}]+|{META}+")
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # What a piece is in a text by itself, and whether it is not always that.
        self.plain = [p.replace(META, " ") if k != BYTE else chr(int(p[3:5], 16)) for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.tied = np.array([k in (CONTROL, UNKNOWN) or k == BYTE and t > "\x7f" for t, k in zip(self.plain, self.kinds, strict=True)])

    # Normalising

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normal form, and for each of its code points and the end the source byte."""
        blank = META if self.escape else " "
        if self.map.units is None and not self.squeeze:
            out = (blank if self.prefix and text else "") + (text.replace(" ", blank) if self.escape else text)
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            sizes = 1 + (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
            return out, np.concatenate([np.zeros(1 + (len(out) > len(text)), np.int32), np.cumsum(sizes, dtype=np.int32)])
        body, chars, places, at = text.encode(), [], [], 0
        while at < len(body):
            size = 1 if body[at] < 0x80 else 2 if body[at] < 0xE0 else 3 if body[at] < 0xF0 else 4
            taken, new = self.map.longest(body, at) or (size, body[at : at + size])
            for c in new.decode():
                if not (self.squeeze and c == " " and (not chars or chars[-1] == " ")):
                    chars.append(c)
                    places.append(at)
            at += taken
        end = at
        while self.squeeze and chars and chars[-1] == " ":
            chars.pop()
            end = places.pop()
        if self.prefix and chars:
            chars.insert(0, " ")
            places.insert(0, places[0])
        return "".join(chars).replace(" ", blank), np.array([*places, end], np.int32)

    # Encoding

    def long_pieces(self, unit: str) -> list[str]:
        """The symbols of one unit after all merges, best rank first, leftmost among equals: with a heap, for long units."""
        text: list[str] = list(unit)
        n = len(text)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (known := self.rank.get(text[a] + text[b], NONE)) < NONE:
                heapq.heappush(heap, (known, a, text[a] + text[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, both = heapq.heappop(heap)
            b = right[a]
            if not text[a] or b < 0 or text[a] + text[b] != both:
                continue
            text[a], text[b] = both, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [t for t in text if t]

    def numbered(self, pieces: list[str]) -> bytes:
        """For each id of a unit the id and the code points of the unit up to its end, as 32-bit numbers."""
        out, at = array("i"), 0
        for piece in pieces:
            at += len(piece)
            found = self.ids.get(piece, self.unknown)
            if found != self.unknown or self.bytes is None:
                out.append(found)
                out.append(at)
            else:
                *some, last = piece.encode()
                for b in some:
                    out.append(self.bytes[b])
                    out.append(at - len(piece))
                out.append(self.bytes[last])
                out.append(at)
        return out.tobytes()

    def merged(self, units: list[str]) -> list[bytes]:
        """As ``numbered``, of short units side by side: a round merges the best pair of each, leftmost among equals."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        n, width = len(units), int(sizes.max()) + 1  # the last column stays empty, and is that before the first
        inside = np.arange(width) < sizes[:, None]
        symbols = np.zeros((n, width), np.int32)
        symbols[inside] = self.pairs.symbol[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        both = np.zeros((n, width), np.int32)
        both[:, :-1] = self.pairs.joined(symbols[:, :-1], symbols[:, 1:])
        ranks = self.pairs.rank[both]
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
        gone = np.zeros((n, width), bool)
        symbol, pair, rank, right, left, lost = (x.reshape(-1) for x in (symbols, both, ranks, after, before, gone))
        rows = np.flatnonzero((ranks < NONE).any(axis=1))
        while len(rows):
            base = rows * width
            best = base + ranks[rows].argmin(axis=1)
            on = rank[best] < NONE
            rows, base, best = rows[on], base[on], best[on]
            second = base + right[best]
            third = base + right[second]
            symbol[best] = pair[best]
            lost[second], rank[second] = True, NONE
            right[best] = third - base
            left[third] = best - base
            first = base + left[best]
            for a, b in ((best, third), (first, best)):
                pair[a] = self.pairs.joined(symbol[a], symbol[b])
                rank[a] = self.pairs.rank[pair[a]]
        stay = inside & ~gone
        ids, ends, counts = self.pairs.ids[symbols[stay]], after[stay], stay.sum(axis=1)
        cuts = np.concatenate([[0], 8 * np.cumsum(counts)]).tolist()
        body = np.stack([ids, ends], axis=1).tobytes()
        out = [body[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for i in np.unique(np.repeat(np.arange(n), counts)[ids == self.unknown]).tolist():
            stops = [0, *np.frombuffer(out[i], np.int32)[1::2].tolist()]
            out[i] = self.numbered([units[i][a:b] for a, b in zip(stops, stops[1:], strict=False)])
        return out

    def encode_units(self, units: list[str]) -> dict[str, bytes]:
        """What each unit becomes; of like lengths together, so that little of a round is empty."""
        out = {}
        units = sorted(units, key=len)
        while units and len(units[-1]) > HEAP_FROM:
            unit = units.pop()
            out[unit] = self.numbered(self.long_pieces(unit))
        for s in range(0, len(units), TOGETHER):
            some = units[s : s + TOGETHER]
            out.update(zip(some, self.merged(some), strict=True))
        return out

    def fill(self, units: list[list[str]], found: list[list[bytes | None]]) -> None:
        """Fill the gaps of ``found``; units move on to the newer of two generations when met."""
        gaps = dict.fromkeys(chain.from_iterable([u for u, p in zip(some, parts, strict=True) if p is None] for some, parts in zip(units, found, strict=True)))
        older = self.older
        gaps = {u: older.get(u) for u in gaps}
        gaps |= self.encode_units([u for u, known in gaps.items() if known is None])
        for some, parts in zip(units, found, strict=True):
            parts[:] = [p or gaps[u] for u, p in zip(some, parts, strict=True)]
        for unit, known in gaps.items():
            if len(unit) <= KEPT_LENGTH:
                if len(self.seen) >= KEPT:
                    self.older, self.seen = self.seen, {}
                self.seen[unit] = known

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, source byte offsets): piece i covers bytes offsets[i] to offsets[i + 1].

        Of a symbol written as bytes, the last piece covers the whole symbol.
        """
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``encode`` of each text; units not met before are merged for many texts at once."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= AT_ONCE:
                yield from self.encode_some(held)
                held, size = [], 0
        yield from self.encode_some(held)

    def encode_some(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        normal = [self.normalise(t) for t in texts]
        units = [self.unit.findall(t) for t, _ in normal]
        found = [list(map(self.seen.get, some)) for some in units]
        self.fill(units, found)
        for (_, places), some, parts in zip(normal, units, found, strict=True):
            if not some:
                yield np.zeros(0, np.int32), np.zeros(1, np.int32)
                continue
            counts = np.fromiter(map(len, parts), np.int64, len(parts)) >> 3
            ids, ends = np.frombuffer(b"".join(parts), np.int32).reshape(-1, 2).T
            sizes = ends[np.cumsum(counts) - 1]  # a unit's last id ends where the unit does
            ends = ends + np.repeat(np.cumsum(sizes) - sizes, counts)
            yield ids.copy(), np.concatenate([places[:1], places[ends]])

    # Decoding

    def decode(self, ids: list[int]) -> str:
        """The text of ids; ill-formed bytes become replacement characters."""
        if ids and not self.squeeze and not self.tied[ids].any():
            text = "".join(map(self.plain.__getitem__, ids))
            return text[1:] if self.prefix and self.pieces[ids[0]].startswith(META) else text
        out, waiting = [], bytearray()
        first = True
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                waiting.append(int(self.pieces[i][3:5], 16))
                first = False
                continue
            if waiting:
                out.append(readable(bytes(waiting)))
                waiting.clear()
            if kind == CONTROL:
                continue
            piece = " ⁇ " if kind == UNKNOWN else self.pieces[i]
            if first and (self.prefix or self.squeeze) and piece.startswith(META):
                piece = piece[1:]
                if self.squeeze:
                    out.append(piece.replace(META, " "))
                    first = not piece
                    continue
            out.append(piece.replace(META, " "))
            first = False
        if waiting:
            out.append(readable(bytes(waiting)))
        return "".join(out)


def readable(body: bytes) -> str:
    """UTF-8 text; each byte that fits into no code point becomes one replacement character."""
    try:
        return body.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(body):
            for size in (1, 2, 3, 4):
                try:
                    out.append(body[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@cache
def loaded(body: bytes) -> Model:
    return Model(body)


def model_bytes(path: str) -> bytes:
    """The model file, read where the job starts and sent to the tasks (its size is checked)."""
    with open(path, "rb") as f:
        body = f.read()
    if len(body) > 16 << 20:
        raise ValueError("a model of more than 16 MB")
    return body


def encode(docs: DataFrame, model_path: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """All columns of ``docs``, ``ids`` and ``offsets`` (one more than ids; source bytes).

    With ``decoded`` also what ``decode`` would add: the text of the ids. It is worked out where the ids are, so
    they are not sent to a second Python process of the task.
    """
    extra = T.StructType.fromDDL("ids array<int>, offsets array<int>" + (", decoded string" if decoded else ""))
    docs = without(docs, *extra.names)
    names, at = [*docs.columns, *extra.names], docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = loaded(shared.value)
        parts = list(model.encode_all(t.as_py() or "" for t in batch.column(at)))
        made = [
            list_of(np.concatenate([p[k] for p in parts]), np.array([len(p[k]) for p in parts]), pa.int32()) for k in (0, 1)
        ]
        if decoded:
            made.append(pa.array([model.decode(ids.tolist()) for ids, _ in parts], pa.string()))
        return pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    return map_batches(docs, work, T.StructType([*docs.schema.fields, *extra.fields]))


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the text of the ids."""
    encoded = without(encoded, "decoded")
    names, at = [*encoded.columns, "decoded"], encoded.columns.index(ids_col)
    shared = encoded.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = loaded(shared.value)
        texts = [model.decode(ids.values.to_numpy().tolist() if ids.is_valid else []) for ids in batch.column(at)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return map_batches(encoded, work, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
