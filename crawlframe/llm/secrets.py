"""Secrets in texts: base patterns, and a credential grammar inferred from what they find.

Base spans are the leftmost non-overlapping matches of three patterns per text, of which matches that
fail their length rule are dropped (they still take their place):

- ``assign``: a keyword, an optional quote, blanks, ``:`` or ``=``, blanks, an optional quote and a value of
  6 characters or more (letters in either case);
- ``access``: ``AKIA`` and capitals or digits, 20 characters or more;
- ``hex``: lower-case hex digits, 24 characters or more.

The values they find are labelled credentials. Their shapes (each character as a capital, small letter,
digit or symbol) are learned as a probabilistic automaton by state merging (ALERGIA): a prefix tree of the
shapes with counts, whose states are merged red-blue, a blue state into the first red one whose next-symbol
and end frequencies pass the Hoeffding test at ``alpha`` in it and in all its descendants. Every run of
credential characters of ``min_length`` or more that no base span covers is a candidate; its score is the
mean log-likelihood ratio per symbol of the automaton against a background chain of shapes counted over all
candidates of the corpus. Candidates that reach ``threshold`` are added as ``learned`` spans; base spans
stay as they are. A candidate leaving the automaton (a transition never seen) scores nothing.

The fit uses at most ``FIT`` credentials of at most ``FIT_LENGTH`` characters, drawn by a hash of their text
(a bounded, documented sample); the background counts and all scanning cover every text. The scans run in
the tasks on Arrow batches, once for base spans and candidates and once for the scores, from a stored table.

Defined results: positions are code points, ends exclusive; spans are ordered by start, then kind in the
order assign, access, hex, learned; a null text is empty and has no spans; repeated rows give equal rows;
an empty table gives an empty result, and a corpus without credentials learns nothing (no learned spans).
Other columns are ignored; ``doc_id`` is carried as given.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.llm.common import map_batches
from crawlframe.session import stored

# The base patterns and their rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Leftmost matches of [0-9a-f]+ are the maximal runs, so those of 24 or more are the matches of this.
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "learned")

#: Runs of these characters are candidates.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
MIN_LENGTH = 16
#: Bound of the fitted sample: credentials, and characters of each.
FIT, FIT_LENGTH = 2000, 256
ALPHA = 0.05
#: Mean log-likelihood ratio (nats a symbol) from which a candidate is a secret.
THRESHOLD = 0.5

#: Shapes: capital, small letter, digit, symbol; then start and end of a string.
SHAPES = str.maketrans({**{c: "U" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "L" for c in "abcdefghijklmnopqrstuvwxyz"},
                        **{c: "D" for c in "0123456789"}})
SYMBOLS = "ULDS"
START, END = 4, 4

BASE = T.StructType([
    T.StructField("_rid", T.LongType()), T.StructField("doc_id", T.LongType()),
    T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()),
    T.StructField("base", T.StringType()),
    T.StructField("credentials", T.ArrayType(T.StringType())),
    T.StructField("candidates", T.ArrayType(T.StringType())),
    T.StructField("background", T.ArrayType(T.LongType())),
])


def shape(text: str) -> str:
    return re.sub("[^ULD]", "S", text.translate(SHAPES))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[str]]:
    """(start, kind, end) of the base spans, and the credentials they hold."""
    spans, found = [], []
    for m in ASSIGN.finditer(text):
        if len(m.group(2)) >= 6:
            spans.append((m.start(), 0, m.end()))
            found.append(m.group(2))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= 20:
            spans.append((m.start(), 1, m.end()))
            found.append(m.group())
    for m in HEX.finditer(text):
        spans.append((m.start(), 2, m.end()))
        found.append(m.group())
    return sorted(spans), found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of credential characters that no base span touches."""
    starts = np.array([s for s, _, _ in spans], np.int64)
    ends = np.array([e for _, _, e in spans], np.int64)
    reach = np.maximum.accumulate(ends) if len(ends) else ends
    out = []
    for m in CANDIDATE.finditer(text):
        k = np.searchsorted(starts, m.end())  # spans starting before the run ends
        if k == 0 or reach[k - 1] <= m.start():
            out.append((m.start(), m.end()))
    return out


def background_counts(shapes: list[str]) -> np.ndarray:
    """Counts of (previous, next) shape over strings, start and end included: 5 x 5."""
    counts = np.zeros((5, 5), np.int64)
    for s in shapes:
        codes = [START] + [SYMBOLS.index(c) for c in s] + [END]
        np.add.at(counts, (codes[:-1], [c if c < 4 else END for c in codes[1:]]), 1)
    return counts


def fit_automaton(shapes: list[str], alpha: float = ALPHA) -> dict:
    """ALERGIA over shape strings: {state: (total, counts of ULDS and end, next states)}, state 0 first."""
    trans: list[dict[int, int]] = [{}]
    count: list[list[int]] = [[0] * 5]
    total = [0]
    parent: list[tuple[int, int] | None] = [None]
    for s in shapes:
        node = 0
        total[0] += 1
        for c in s:
            a = SYMBOLS.index(c)
            count[node][a] += 1
            if a not in trans[node]:
                trans.append({})
                count.append([0] * 5)
                total.append(0)
                parent.append((node, a))
                trans[node][a] = len(trans) - 1
            node = trans[node][a]
            total[node] += 1
        count[node][END] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def different(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(r: int, b: int) -> bool:
        stack = [(r, b)]
        while stack:
            x, y = stack.pop()
            if total[x] == 0 or total[y] == 0:
                continue
            if any(different(count[x][a], total[x], count[y][a], total[y]) for a in range(5)):
                return False
            stack.extend((trans[x][a], trans[y][a]) for a in trans[y] if a in trans[x])
        return True

    def fold(r: int, b: int) -> None:
        stack = [(r, b)]
        while stack:
            x, y = stack.pop()
            total[x] += total[y]
            for a in range(5):
                count[x][a] += count[y][a]
            for a, child in trans[y].items():
                if a in trans[x]:
                    stack.append((trans[x][a], child))
                else:
                    trans[x][a] = child
                    parent[child] = (x, a)

    red = [0]
    while True:
        blue = sorted({c for r in red for c in trans[r].values()} - set(red))
        if not blue:
            break
        b = blue[0]
        for r in red:
            if compatible(r, b):
                p, a = parent[b]
                trans[p][a] = r
                fold(r, b)
                break
        else:
            red.append(b)
    return {q: (total[q], list(count[q]), dict(trans[q])) for q in red}


def score(text_shape: str, automaton: dict, background: np.ndarray) -> float:
    """Mean log-likelihood ratio per symbol (end included); minus infinity off the automaton."""
    probs = (background + 1) / (background + 1).sum(axis=1, keepdims=True)
    q, prev, total = 0, START, 0.0
    for c in text_shape + "E":
        a = END if c == "E" else SYMBOLS.index(c)
        n, counts, nxt = automaton[q]
        if counts[a] == 0:
            return -math.inf
        total += math.log(counts[a] / n) - math.log(probs[prev, a])
        if a == END:
            break
        q, prev = nxt[a], a
    return total / (len(text_shape) + 1)


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Base spans, credentials, candidates ``start:end:shape`` and background counts of every document."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(2).to_pylist()
        cols = {k: [] for k in ("n_assign", "n_access", "n_hex", "base", "credentials", "candidates", "background")}
        for text in texts:
            spans, found = base_spans(text or "")
            runs = candidates(text or "", spans)
            shapes = [shape(text[s:e]) for s, e in runs]
            for k, n in enumerate(("n_assign", "n_access", "n_hex")):
                cols[n].append(sum(1 for _, kind, _ in spans if kind == k))
            cols["base"].append(joined(spans))
            cols["credentials"].append(found)
            cols["candidates"].append([f"{s}:{e}:{h}" for (s, e), h in zip(runs, shapes, strict=True)])
            cols["background"].append(background_counts(shapes).ravel().tolist())
        arrays = [batch.column(0), batch.column(1)] + [pa.array(cols[n], pa.int64()) for n in ("n_assign", "n_access", "n_hex")]
        arrays += [pa.array(cols["base"], pa.string()), pa.array(cols["credentials"], pa.list_(pa.string())),
                   pa.array(cols["candidates"], pa.list_(pa.string())), pa.array(cols["background"], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, names=BASE.names)

    rows = docs.select(
        F.monotonically_increasing_id().alias("_rid"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string")
    )
    return map_batches(rows, work, BASE)


def find(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", fit: int = FIT, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_learned of every document."""
    scanned = stored(scan(docs, text_col, id_col), "secrets-scan")
    sample = (
        scanned.select(F.explode("credentials").alias("c")).where(F.length("c") <= FIT_LENGTH)
        .orderBy(F.xxhash64("c"), "c").limit(fit).collect()
    )
    automaton = fit_automaton([shape(r.c) for r in sample])
    sums = scanned.select(F.posexplode("background").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    background = np.zeros(25, np.int64)
    for r in sums:
        background[r.k] = r.n
    background = background.reshape(5, 5)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, found = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        spans, learned = [], []
        for b, cands in zip(base, found, strict=True):
            extra = []
            for c in cands or []:
                s, e, h = c.split(":")
                if score(h, automaton, background) >= threshold:
                    extra.append(f"learned:{s}:{e}")
            text = ",".join(x for x in (b, ",".join(extra)) if x)
            key = lambda x: (int(x.split(":")[1]), KINDS.index(x.split(":")[0]))
            spans.append(",".join(sorted(text.split(","), key=key)) if text else "")
            learned.append(len(extra))
        return pa.RecordBatch.from_arrays([pa.array(spans, pa.string()), pa.array(learned, pa.int64())], names=["spans", "n_learned"])

    both = scanned.select("doc_id", "n_assign", "n_access", "n_hex", "base", "candidates")

    def paired(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = work(batch.select(["base", "candidates"]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), batch.column(3),
             pa.array([hashlib.sha256(b.encode()).hexdigest() for b in batch.column(4).to_pylist()], pa.string()),
             out.column(0), out.column(1)],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned"],
        )

    return map_batches(both, paired, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_learned bigint")
