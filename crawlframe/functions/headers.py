"""HTTP header values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media types parsed as XML; all others, also none, are parsed as HTML.
XML_MEDIA_TYPES = ("text/xml", "application/xhtml+xml", "application/xml")


def header(headers, name: str) -> Column:
    """Value of a header in a map whose names are lower-case."""
    return F.try_element_at(headers, F.lit(name.lower()))


def media_type(content_type) -> Column:
    return F.lower(F.trim(F.substring_index(content_type, ";", 1)))


def parser_kind(content_type) -> Column:
    """``xml`` or ``html``."""
    return F.when(media_type(content_type).isin(*XML_MEDIA_TYPES), F.lit("xml")).otherwise(
        F.lit("html")
    )


def charset_of(content_type) -> Column:
    """Charset parameter as written, or null."""
    found = F.regexp_extract(content_type, r"(?i);\s*charset\s*=\s*[\"']?([^\s;\"']+)", 1)
    return F.nullif(found, F.lit(""))
