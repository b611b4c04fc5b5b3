"""Quality rules as a short-circuit cascade, in built-in expressions only.

A rule rejects a text by a measure of it. The order of the rules does not change which texts are kept, only
what that costs: each rule is timed and its rejections are counted on a bounded sample, and
rules run in the order of rejections per second, each on what the ones before it left. The cascade is one
CASE expression, of which Spark evaluates no more branches than it must.

Measures (words are runs of characters other than blank and ``\\t`` to ``\\r``):

* ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (``# * $ % & | < >``);
* ``n_dup_lines``: lines with a word that equal an earlier line;
* ``n_repeat_words``: words in three-word windows that occur twice or more in the text, the first
  ones included. Windows are sorted with their places in the row, and neighbours compared; no
  text is taken apart into rows.

Nulls and repeats: a null or wordless text has only zeros and fails the base rules; repeated rows get
equal results; an empty table gives an empty result; a rule never sees other columns than its text.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.common import SPACE, let
from crawlframe.session import stored

#: Rows of the sample on which rules are timed.
SAMPLE = 2000
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def without_chars(text: Column, chars: str) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), chars, "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def word_chars(text: Column) -> Column:
    return F.length(without_chars(text, BLANKS)).cast("bigint")


def n_symbols(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(without_chars(text, SYMBOLS))).cast("bigint")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(without_chars(x, BLANKS)) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def n_repeat_words(text: Column) -> Column:
    def windows(w: Column) -> Column:
        """(window, first word) in the order of the windows. A space parts the words and is in none."""
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("g"), i.alias("i"))))

    def places(s: Column) -> Column:
        """First words of the windows that have an equal neighbour, in the order of the text."""
        same = lambda x, k: F.coalesce(F.get(s, k)["g"] == x["g"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        """Each window adds the words up to the next one's first, three at most."""
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda n, x: n + x)

    of_words = lambda w: F.when(F.size(w) < 4, F.lit(0).cast("bigint")).otherwise(let(windows(w), lambda s: let(places(s), covered)))
    return let(words(text), of_words)


MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """Rejects if ``fails`` holds; it is given a function from a measure's name to its column."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


BASE = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repetitive", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
)
FURTHER = (
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    Rule("long_words", lambda m: m("word_chars") > 15 * m("n_words")),
    Rule("repeated_lines", lambda m: (m("n_dup_lines") > 3) & (10 * m("n_dup_lines") > m("n_words"))),
)


def in_text(text: Column) -> Callable[[str], Column]:
    return lambda name: MEASURES[name](text)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-3)


def estimates(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text") -> list[Estimate]:
    """Cost and selectivity of each rule on at most ``SAMPLE`` rows, best rejections per cost first."""
    # Rows are drawn by a hash of their text, about SAMPLE of them wherever they lie, then at most SAMPLE are kept.
    share = min(1.0, 2 * SAMPLE / max(docs.count(), 1))
    drawn = F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)
    sample = stored(docs.select(F.col(text_col).alias("text")).where(drawn).limit(SAMPLE), "quality-sample")
    counted = lambda c: sample.agg(F.count(F.lit(1)), F.coalesce(F.sum(c.cast("int")), F.lit(0))).first()
    counted(F.col("text").isNull())  # the first run also opens the files
    out = []
    for rule in rules:
        fails = F.coalesce(rule.fails(in_text(F.col("text"))), F.lit(False))
        counted(fails)  # compiles the code
        began = time.perf_counter()
        rows, rejected = counted(fails)
        out.append(Estimate(rule, time.perf_counter() - began, rejected / max(rows, 1)))
    return sorted(out, key=lambda e: (-e.worth, e.seconds, e.rule.name))


def rejected_by(rules: list[Rule], measure: Callable[[str], Column]) -> Column:
    """Name of the first rule that rejects, in the given order; null if none does."""
    first, *rest = rules
    found = F.when(first.fails(measure), first.name)
    for rule in rest:
        found = found.when(rule.fails(measure), rule.name)
    return found


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = BASE + FURTHER, text_col: str = "text") -> DataFrame:
    """``docs`` that no rule rejects. Measures of later rules are not worked out for rejected texts."""
    order = [e.rule for e in estimates(docs, rules, text_col)]
    return docs.where(rejected_by(order, in_text(F.col(text_col))).isNull())


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = FURTHER) -> DataFrame:
    """One row per document: all measures, whether a base rule fails, and the cascade's verdict."""
    order = [e.rule for e in estimates(docs, rules, text_col)]
    rows = docs.select(F.col(id_col).alias("doc_id"), *[m(F.col(text_col)).alias(n) for n, m in MEASURES.items()])
    base = rejected_by(list(BASE), F.col).isNotNull()
    rows = rows.withColumn("base_failed", base)
    kept = F.when(F.col("base_failed"), False).otherwise(rejected_by(order, F.col).isNull())
    return rows.withColumn("kept", kept)
