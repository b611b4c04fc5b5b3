"""HTML as Column expressions, and the per-page parser where those do not reach."""

from __future__ import annotations

import codecs
import html
import re
from collections.abc import Iterator
from html.entities import name2codepoint
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed pattern: what hides markup, or else an anchor with its href as group 2. Hidden parts
# left open reach to the end of the page. Nothing is tried twice (possessive loops), so that an
# anchor of any number of attributes is matched in one pass.
ANCHOR_HREF = (
    r"(?is)<(?:!--.*?(?:-->|\z)"
    r"|(script|style|textarea|title)\b.*?(?:</\1\s*>|\z)"
    r"|a(?:[\s/]+(?!href[\s=>/])[^\s=>/\"']+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))?)*+"
    r"(?:[\s/]+href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?+)"
)
_META_CHARSET = re.compile(rb"(?is)<meta\b[^>]*?charset\s*=\s*[\"']?\s*([A-Za-z0-9_\-:]+)")
_XML_CHARSET = re.compile(rb"(?is)^\s*<\?xml\b[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9_\-:]+)")


#: Parts literal lists; it is in none of their texts.
_CUT = "\uffff"

# One character reference, or what lies between two.
_REFERENCE = r"(?s)&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);|[^&]+|&"


def _code_point(part: Column, base: int) -> Column:
    """The text of a numeric reference, by the rules of HTML for numbers that are no characters."""
    # One literal, cut into its 160 texts: building an array of 160 literals costs a call into the JVM each.
    low = F.split(F.lit(_CUT.join(html.unescape(f"&#{n};") for n in range(160))), _CUT)
    digits = F.regexp_replace(part, "^&#[xX]?0*|;$", "")
    n = F.when(F.length(digits).between(1, 7), F.conv(digits, base, 10).cast("bigint"))
    lost = n.isNull() | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    nothing = n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    other = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(lost, "\ufffd").when(n < 160, F.get(low, n.cast("int"))).when(nothing, "").otherwise(other)


def unescape_basic(text: Column) -> Column:
    """Undo numeric references and those named in HTML 4 in one pass; texts without ``&`` skip the work."""
    known = sorted((name2codepoint | {"apos": 39}).items())
    names = F.map_from_arrays(
        F.split(F.lit(_CUT.join(name for name, _ in known)), _CUT), F.split(F.lit(_CUT.join(chr(n) for _, n in known)), _CUT)
    )

    def plain(part: Column) -> Column:
        named = F.try_element_at(names, F.substring(part, F.lit(2), F.length(part) - 2))
        return (
            F.when(~part.startswith("&") | (F.length(part) == 1), part)
            .when(part.rlike("^&#[xX]"), _code_point(part, 16))
            .when(part.startswith("&#"), _code_point(part, 10))
            .otherwise(F.coalesce(named, part))
        )

    parts = F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), plain)
    return F.when(text.contains("&"), F.array_join(parts, "")).otherwise(text)


def href_values(html_: Column) -> Column:
    """Distinct href values of a page's anchors as an array."""
    found = F.filter(F.regexp_extract_all(html_, F.lit(ANCHOR_HREF), F.lit(2)), lambda v: v != "")
    bare = F.transform(found, lambda v: unescape_basic(F.regexp_replace(v, r"^[\"']|[\"']$", "")))
    return F.array_distinct(bare)


def page_lang(html_: Column) -> Column:
    """Primary language subtag declared on ``<html>``, or null."""
    found = F.regexp_extract(html_, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    return F.nullif(F.lower(found), F.lit(""))


def decode_bytes(body: bytes, charset: str | None) -> str:
    """Byte-order mark, else declared charset, else one named in the page, else UTF-8."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if body.startswith(mark):
            return body.decode(name, "replace")
    if not charset:
        named = _META_CHARSET.search(body) or _XML_CHARSET.search(body)
        charset = named.group(1).decode("ascii") if named else "utf-8"
        try:
            codecs.lookup(charset)
        except LookupError:
            charset = "utf-8"
    return body.decode(charset, "replace")


@F.pandas_udf(T.StringType())
def decode_body(body: pd.Series, charset: pd.Series) -> pd.Series:
    """Text of page bodies; null where the declared charset does not exist."""

    def decode(raw, name):
        try:
            return None if raw is None else decode_bytes(raw, name)
        except LookupError:
            return None

    return pd.Series([decode(raw, name) for raw, name in zip(body, charset)], dtype=object)


class _PageReader(HTMLParser):
    """Collects title, text and anchors of one page."""

    # Elements that do not break a line of text.
    INLINE = frozenset(
        "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s "
        "samp small span strike strong sub sup time tt u var wbr".split()
    )
    # Elements whose content is not text of the page.
    SILENT = frozenset(("script", "style", "template"))

    def __init__(self, xml: bool):
        super().__init__(convert_charrefs=True)
        self.xml = xml
        self.title: list[str] = []
        self.text: list[str] = []
        self.hrefs: list[str] = []
        self.lang = None
        self.silent = 0
        self.in_title = False
        self.titles = 0

    def handle_starttag(self, tag, attrs):
        values = dict(reversed(attrs))
        if tag == "a" and values.get("href") is not None:
            self.hrefs.append(values["href"])
        elif tag == "a" and "href" in values:
            self.hrefs.append("")
        elif tag == "html":
            self.lang = values.get("lang") or values.get("xml:lang") or self.lang
        elif tag == "title":
            self.in_title = True
            self.titles += 1
        if tag in self.SILENT and not self.xml:
            self.silent += 1
        if tag not in self.INLINE:
            self.text.append(" ")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.xml:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.SILENT and self.silent:
            self.silent -= 1
        if tag not in self.INLINE:
            self.text.append(" ")

    def handle_data(self, data):
        if self.silent:
            return
        self.text.append(data)
        if self.in_title and self.titles == 1:
            self.title.append(data)

    def result(self):
        lang = (self.lang or "").strip().replace("_", "-").split("-")[0].lower() or None
        fold = lambda parts: " ".join("".join(parts).split())
        return fold(self.title), fold(self.text), lang, self.hrefs


PARSED_TYPE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("declared_lang", T.StringType()),
        T.StructField("hrefs", T.ArrayType(T.StringType())),
        T.StructField("ok", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)


def read_page(markup, charset, kind):
    """One page to the fields of ``PARSED_TYPE``; any fault becomes a failed record."""
    try:
        if markup is None:
            raise ValueError("no body")
        text = markup if isinstance(markup, str) else decode_bytes(bytes(markup), charset)
        reader = _PageReader(kind == "xml")
        reader.feed(text)
        reader.close()
        return (*reader.result(), True, None)
    except Exception as fault:  # a broken page must not stop the job
        return None, None, None, None, False, f"{type(fault).__name__}: {fault}"


@F.pandas_udf(PARSED_TYPE)
def parse_markup(
    batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]],
) -> Iterator[pd.DataFrame]:
    """Parse page bodies batch by batch; one record per page."""
    for markup, charset, kind in batches:
        rows = [read_page(*page) for page in zip(markup, charset, kind)]
        yield pd.DataFrame(rows, columns=PARSED_TYPE.names)


# Keeps a filter on the result from being pushed below it, which would parse every page twice.
parse_markup = parse_markup.asNondeterministic()
