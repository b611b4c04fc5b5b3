"""Which language a text is in.

Scores are whole numbers (log shares in ten-thousandths), so a result does not depend on
the order in which partitions are added up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from crawlframe.session import stored

SCALE = 10_000
# Weight of a gram a language never showed: a share of one in ten million.
UNSEEN = -161_181

# Scripts told apart when minority scripts are removed.
SCRIPTS = (
    "Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Devanagari", "Bengali",
    "Gurmukhi", "Gujarati", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Thai",
    "Lao", "Tibetan", "Myanmar", "Georgian", "Hangul", "Ethiopic", "Khmer", "Hiragana",
    "Katakana", "Bopomofo", "Han",
)


def script_filter(
    docs: DataFrame, text: str = "text", threshold: float = 0.02, max_chars: int | None = None
) -> DataFrame:
    """Remove from ``text`` the scripts with less than ``threshold`` of its scripted characters.

    ``max_chars`` cuts the text first; by default it is used whole. Adds ``scripts_removed``.
    """
    source = F.substring(text, 1, max_chars) if max_chars else F.col(text)
    cut = docs.withColumn("_source", source)
    cut = cut.withColumn("_rest", F.regexp_replace("_source", r"[\p{IsLatin}\p{IsCommon}\p{IsInherited}]+", ""))
    latin = F.length("_source") - F.length(F.regexp_replace("_source", r"\p{IsLatin}+", ""))
    counted = cut.withColumn("_latin", latin).withColumn("_all", F.col("_latin") + F.length("_rest"))
    share = lambda n: (n > 0) & (n / F.col("_all") < threshold)
    minor = [F.when(share(F.col("_latin")), F.lit("Latin"))]
    for script in SCRIPTS[1:]:
        found = F.length("_rest") - F.length(F.regexp_replace("_rest", rf"\p{{Is{script}}}+", ""))
        minor.append(F.when(share(found), F.lit(script)))
    # Most texts hold one script, and one alone is never a minority.
    names = F.when(F.col("_rest") != "", F.array_compact(F.array(*minor))).otherwise(
        F.array().cast("array<string>")
    )
    named = counted.withColumn("_names", names)
    pattern = F.concat(F.lit(r"[\p{Is"), F.array_join("_names", r"}\p{Is"), F.lit("}]+"))
    kept = F.when(F.size("_names") > 0, F.regexp_replace(F.col("_source"), pattern, F.lit(""))).otherwise(
        F.col("_source")
    )
    rest = [c for c in docs.columns if c != text]
    return named.select(
        *rest, kept.alias(text), F.size("_names").cast("bigint").alias("scripts_removed")
    )


# Stands after the end of a text, so that every character starts a window of three.
_END = "\uffff"
# Stands for it in codes of windows, above all code points.
_PAST = (1 << 21) - 1
#: Characters worked on at once; different windows a task counts before it puts them out; largest table of steps.
CHUNK, HELD, DENSE = 1 << 18, 4_000_000, 1 << 22


def gram_counts(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, gram, n): how often each run of one to three characters occurs in the whole texts.

    Each character is listed once, with the two after it; windows are counted before the
    shuffle, and only counted windows are taken apart into the grams they start with.
    """
    padded = F.concat(F.col(text), F.lit(_END * 2))
    windows = F.concat(
        *[F.regexp_extract_all(F.substring(padded, start, 2**31 - 1), F.lit("(?s)..."), F.lit(0)) for start in (1, 2, 3)]
    )
    counted = (
        docs.select(*keys, F.explode(windows).alias("_window"))
        .groupBy(*keys, "_window")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    starts = [F.substring("_window", 1, size) for size in (1, 2, 3)]
    listed = F.filter(F.array(*starts), lambda gram: ~F.endswith(gram, F.lit(_END)))
    return counted.select(*keys, F.explode(listed).alias("gram"), "_n").groupBy(*keys, "gram").agg(F.sum("_n").alias("n"))


def joined_windows(texts: list[str]) -> np.ndarray:
    """Code (21 bits a character) of the three characters at each place, with ``_PAST`` past a text's end."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    points = _code_points("".join(texts))
    last = np.cumsum(lengths[lengths > 0]) - 1
    second = np.append(points[1:], _PAST)
    second[last] = _PAST
    third = np.append(second[1:], _PAST)
    third[last] = _PAST
    return points | second << 21 | third << 42


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order, and the sum of the counts of each."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def grams_of(codes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[list[str], np.ndarray]]:
    """Grams of one to three characters that the windows start with, and how often each occurs."""
    for size in (1, 2, 3):
        last = codes >> 21 * (size - 1) & _PAST
        inside = (last != _PAST) & (last != ord(_END))
        found, n = summed(codes[inside] & (1 << 21 * size) - 1, counts[inside])
        points = np.stack([found >> 21 * i & _PAST for i in range(size)], axis=1).astype("<u4")
        text = points.tobytes().decode("utf-32-le", "surrogatepass")
        yield [text[i : i + size] for i in range(0, len(text), size)], n


def lang_grams(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) of (lang, text as bytes): ``gram_counts`` by language, with windows counted as numbers in each task."""

    kind = labelled.schema["lang"].dataType
    arrow = to_arrow_type(kind)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def add(lang: str, texts: list[str]) -> None:
            have = held.setdefault(lang, [])
            have.append(np.unique(joined_windows(texts), return_counts=True))
            # The first is the sum so far: it grows by as much as it holds before it is summed again.
            if sum(len(codes) for codes, _ in have[1:]) > max(len(have[0][0]), CHUNK):
                held[lang] = [summed(*map(np.concatenate, zip(*have, strict=True)))]

        def put_out() -> Iterator[pa.RecordBatch]:
            for lang, have in held.items():
                for grams, n in grams_of(*summed(*map(np.concatenate, zip(*have, strict=True)))):
                    columns = [pa.array([lang] * len(grams), arrow), pa.array(grams, pa.string()), pa.array(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            texts: dict[str, list[str]] = {}
            sizes: dict[str, int] = {}
            for lang, text in zip(*batch.columns, strict=True):
                if not (body := (text.as_py() or b"").decode("utf-8", "replace")):
                    continue
                lang = lang.as_py()
                texts.setdefault(lang, []).append(body)
                sizes[lang] = sizes.get(lang, 0) + len(body)
                if sizes[lang] >= CHUNK:
                    add(lang, texts.pop(lang))
                    sizes[lang] = 0
            for lang, rest in texts.items():
                add(lang, rest)
            if sum(len(codes) for have in held.values() for codes, _ in have) > HELD:
                yield from put_out()
        yield from put_out()

    counted = labelled.mapInArrow(count, T.StructType().add("lang", kind).add("gram", T.StringType()).add("n", T.LongType()))
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train_lang_profiles(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, weight): log share of each gram among its language's grams of equal length.

    Counting is partial before the shuffle, so what travels is the alphabet, not the text.
    """
    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text")).filter("lang IS NOT NULL")
    counts = lang_grams(labelled).withColumn("_size", F.length("gram"))
    totals = counts.groupBy("lang", "_size").agg(F.sum("n").alias("_total"))
    weight = F.round(F.ln(F.col("n") / F.col("_total")) * SCALE).cast("bigint")
    return counts.join(totals, ["lang", "_size"]).select("lang", "gram", weight.alias("weight"))


def wide_profiles(profiles: DataFrame, languages: Sequence[str]) -> DataFrame:
    """One row per gram with a weight column per language."""
    columns = [
        F.coalesce(F.max(F.when(F.col("lang") == name, F.col("weight"))), F.lit(UNSEEN)).alias(f"w_{name}")
        for name in languages
    ]
    return profiles.groupBy("gram").agg(*columns)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


class Step(NamedTuple):
    """The node that a node and a next character lead to: a table of all pairs, or the known ones in order."""

    width: int
    keys: np.ndarray | None
    nodes: np.ndarray

    def take(self, node: np.ndarray, character: np.ndarray) -> np.ndarray:
        asked = node * self.width + character
        if self.keys is None:
            return self.nodes[asked]
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[at] == asked, self.nodes[at], 0)


class Scores(NamedTuple):
    """Grams as a tree of characters. ``sums``: a node's weights and number of grams, those of its prefixes included."""

    characters: np.ndarray
    steps: list[Step]
    sums: np.ndarray


def score_table(wide: pd.DataFrame) -> Scores:
    """The tree of the grams, with a column of weights per language and one for the number of grams."""
    wide = wide[wide["gram"].str.len().between(1, 3)]
    grams = wide["gram"].tolist()
    sizes = wide["gram"].str.len().to_numpy(dtype=np.int64)
    points = np.zeros((len(grams), 3), dtype=np.int64)
    points[np.arange(3) < sizes[:, None]] = _code_points("".join(grams))
    alphabet = np.unique(points[np.arange(3) < sizes[:, None]])
    characters = np.zeros(0x110000, dtype=np.int64)
    characters[alphabet] = np.arange(1, len(alphabet) + 1)
    letters, width = characters[points], len(alphabet) + 1
    # Node 0 is no gram, the next are the single characters.
    nodes, parents, steps = letters[:, 0], [np.zeros(width, dtype=np.int64)], []
    for level in (1, 2):
        deeper = sizes > level
        asked, inverse = np.unique(nodes[deeper] * width + letters[deeper, level], return_inverse=True)
        before = sum(map(len, parents))
        made = before + np.arange(len(asked))
        parents.append(asked // width)
        nodes = nodes.copy()
        nodes[deeper] = made[inverse]
        # Steps lead on from the nodes so far only.
        if before * width <= DENSE:
            full = np.zeros(before * width, dtype=np.int64)
            full[asked] = made
            steps.append(Step(width, None, full))
        else:
            steps.append(Step(width, np.append(-1, asked), np.append(0, made)))
    parent = np.concatenate(parents)
    weights = wide.drop(columns="gram").to_numpy(dtype=np.int64)
    sums = np.zeros((len(parent), weights.shape[1] + 1), dtype=np.int64)
    np.add.at(sums, nodes, np.column_stack([weights, np.ones(len(weights), dtype=np.int64)]))
    # A node's parent is of the level before it, whose sums are complete then.
    begin = width
    for level in parents[1:]:
        sums[begin : begin + len(level)] += sums[level]
        begin += len(level)
    return Scores(characters, steps, sums)


def score_texts(texts: Sequence[str], table: Scores) -> list[list[int] | None]:
    """Summed weights of the grams of each text, None where no gram is known."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    if not lengths.sum():
        return [None] * len(texts)
    first = table.characters[_code_points("".join(texts))]
    last = np.cumsum(lengths[lengths > 0]) - 1
    second = np.append(first[1:], 0)
    second[last] = 0
    third = np.append(second[1:], 0)
    third[last] = 0
    # The longest known gram at each place stands for those that it starts with.
    two = np.where(second > 0, table.steps[0].take(first, second), 0)
    three = np.where((two > 0) & (third > 0), table.steps[1].take(two, third), 0)
    node = np.where(three > 0, three, np.where(two > 0, two, first))
    totals = np.zeros((len(texts), table.sums.shape[1]), dtype=np.int64)
    totals[lengths > 0] = np.add.reduceat(table.sums[node], np.append(0, last[:-1] + 1), axis=0)
    return [row[:-1] if row[-1] else None for row in totals.tolist()]


def _scorer(table):
    """Arrow UDF of ``score_texts``; the table comes as a broadcast variable."""

    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = texts.fillna("").tolist()
            found, begin, size = [], 0, 0
            for end, text in enumerate(texts, 1):
                size += len(text)
                if size >= CHUNK or end == len(texts):
                    found += score_texts(texts[begin:end], table.value)
                    begin, size = end, 0
            yield pd.Series(found, dtype=object)

    scores.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    # As parse_markup: a filter on the language must not score every text twice.
    return F.pandas_udf(scores, T.ArrayType(T.LongType())).asNondeterministic()


def detect_language(
    docs: DataFrame,
    profiles: DataFrame,
    languages: Sequence[str],
    key: str = "doc_id",
    text: str = "text",
    min_confidence: float = 0.7,
    broadcast_rows: int = 2_000_000,
) -> DataFrame:
    """(key, lang, confidence) of each text; lang is null below ``min_confidence``.

    ``profiles`` should be a stored table. Up to ``broadcast_rows`` grams they are
    broadcast and texts are scored where they lie, in Arrow batches without a shuffle;
    beyond, grams are counted per text and joined by shuffle. Both give the same numbers.
    """
    names = [f"w_{name}" for name in languages]
    wide = wide_profiles(profiles, languages)
    if profiles.select("gram").distinct().limit(broadcast_rows + 1).count() <= broadcast_rows:
        table = docs.sparkSession.sparkContext.broadcast(score_table(wide.toPandas()))
        scored = docs.select(key, _scorer(table)(F.col(text)).alias("_scores"))
        totals = scored.select(key, *[F.get("_scores", F.lit(i)).alias(n) for i, n in enumerate(names)])
    else:
        sums = [F.sum(F.col(name) * F.col("n")).alias(name) for name in names]
        # Numbered rows: keys may be null or repeated.
        numbered = docs.select(key, F.col(text).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
        numbered = stored(numbered, "texts")
        found = gram_counts(numbered, ["_row"], "_text").join(wide, "gram").groupBy("_row").agg(*sums)
        totals = numbered.select(key, "_row").join(found, "_row", "left").drop("_row")
    ranked = F.array_sort(
        F.array(*[F.struct((-F.col(n)).alias("cost"), F.lit(l).alias("lang")) for n, l in zip(names, languages)])
    )
    best = totals.withColumn("_best", ranked[0])
    odds = sum((F.exp((F.col("_best.cost") + F.col(n)) / float(SCALE)) for n in names), F.lit(0.0))
    sure = best.withColumn("confidence", F.round(1.0 / odds, 6))
    return sure.select(
        key, F.when(F.col("confidence") >= min_confidence, F.col("_best.lang")).alias("lang"), "confidence"
    )
