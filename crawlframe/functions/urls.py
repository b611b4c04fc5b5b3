"""URL work as Column expressions: all of it runs in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.config import DEFAULT_PORTS, HOST_SCHEMES, IGNORED_SUFFIXES

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"
# Fixed pattern: what a path or query must percent-encode.
_UNSAFE = r"[^\x21-\x7E]|[\"<>`]"
# An address that ends in its scheme's own port, or in a colon without one.
_OWN_PORT = (
    "^(?:" + "|".join(rf"({name}://.*):0*{port}" for name, port in DEFAULT_PORTS.items()) + "|(.*):)$"
)
_WITHOUT_PORT = "".join(f"${i}" for i in range(1, len(DEFAULT_PORTS) + 2))


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_col(url), _SCHEME, 1))


def authority(url) -> Column:
    """Everything between ``//`` and the path, userinfo included."""
    return F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def path(url) -> Column:
    """Path of an absolute URL; ``/`` when it has none."""
    found = F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("/"))


def query(url) -> Column:
    """Query with its question mark, or an empty string."""
    return F.regexp_extract(_col(url), r"^[^?#]*(\?[^#]*)", 1)


def site_root(url) -> Column:
    """Scheme, host and port without userinfo or the scheme's own port; empty if there is no host."""
    origin = F.lower(F.regexp_extract(_col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1))
    return F.regexp_replace(F.regexp_replace(origin, r"//.*@", "//"), _OWN_PORT, _WITHOUT_PORT)


def address(url) -> Column:
    """Userinfo, host and port, the scheme's own port left out: what two sites differ by."""
    login = F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*@)", 1)
    return F.concat(login, F.regexp_replace(site_root(url), r"^[^:]*://", ""))


def site_key(url) -> Column:
    """Scheme, host and port with path ``/``; null if the URL names no host."""
    return F.nullif(F.concat(site_root(url), F.lit("/")), F.lit("/"))


def strip_fragment(url) -> Column:
    return F.regexp_replace(_col(url), r"(?s)#.*$", "")


def last_segment(path_) -> Column:
    return F.substring_index(_col(path_), "/", -1)


def suffix_filter(path_, suffixes: Sequence[str] = IGNORED_SUFFIXES) -> Column:
    """True unless the last path segment ends with one of ``suffixes``."""
    if not suffixes:
        return F.lit(True)
    pattern = "(?:" + "|".join(re.escape(s) for s in suffixes) + r")\z"
    return F.coalesce(~last_segment(path_).rlike(pattern), F.lit(True))


def href_scheme_filter(href) -> Column:
    """False for script and mail hrefs."""
    return ~F.lower(_col(href)).rlike(r"^(?:javascript|mailto):")


def fetchable_scheme(url) -> Column:
    return scheme(url).isin("http", "https")


def percent_encode(text: Column, also: str = "") -> Column:
    """Percent-encode unsafe characters; untouched texts skip the work."""
    unsafe = _UNSAFE + (f"|[{re.escape(also)}]" if also else "")
    encoded = F.array_join(
        F.transform(
            F.split(text, ""),
            lambda c: F.when(
                c.rlike(unsafe),
                F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"),
            ).otherwise(c),
        ),
        "",
    )
    return F.when(text.rlike(unsafe), encoded).otherwise(text)


def remove_dot_segments(path_: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; paths without any skip the work.

    The path is cut at ``..`` only, and each cut takes one segment off what lies before it.
    """
    plain = F.regexp_replace(F.regexp_replace(path_, r"(/\.\.?)$", "$1/"), r"/\.(?=/)", "")
    parts = F.split(plain, r"/\.\.(?=/)")
    without_last = lambda kept: F.left(kept, F.length(kept) - F.length(F.substring_index(kept, "/", -1)) - 1)
    resolved = F.aggregate(
        F.slice(parts, F.lit(2), F.size(parts)), parts[0], lambda kept, part: F.concat(without_last(kept), part)
    )
    return F.when(path_.rlike(r"/\.\.?(?:/|$)"), resolved).otherwise(path_)


def clean_href(href) -> Column:
    """Drop surrounding blanks and control characters, inner tabs and line ends."""
    return F.regexp_replace(_col(href), r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", "")


def _forward_slashes(href: Column) -> Column:
    """Backslashes ahead of the query count as slashes."""
    return F.when(
        href.contains("\\"),
        F.concat(
            F.translate(F.regexp_extract(href, r"^([^?#]*)", 1), "\\", "/"),
            F.regexp_extract(href, r"(?s)^[^?#]*(.*)$", 1),
        ),
    ).otherwise(href)


def _joined(base: Column, own: Column, href: Column) -> Column:
    """Absolute form of ``href``, whose own scheme is ``own``; null for an opaque scheme."""
    return (
        F.when(own.isin(*HOST_SCHEMES), F.regexp_replace(href, r"^([A-Za-z]+):/*", "$1://"))
        .when(own != "", F.lit(None).cast("string"))
        .when(href.startswith("//"), F.concat(base["scheme"], F.lit(":"), href))
        .when(href.startswith("/"), F.concat(base["origin"], href))
        .when(href.startswith("?"), F.concat(base["page"], href))
        .when((href == "") | href.startswith("#"), F.concat(base["plain"], href))
        .otherwise(F.concat(base["folder"], href))
    )


def _fault(place: Column, host: Column, port: Column) -> Column:
    return (
        F.when(place.isNull() | (host == ""), F.lit("no_host"))
        .when(~port.rlike(r"^[0-9]*$") | (port.try_cast("bigint") > 65535), F.lit("bad_port"))
        .when(host.rlike(r"[\x00-\x20<>^|%\\`{}\"]"), F.lit("bad_host"))
    )


def resolved(base: str, hrefs: str) -> Column:
    """Array column ``hrefs`` resolved against column ``base`` and normalised.

    Elements are (raw_href, url, site, path, fault): the absolute URL with lower-case
    scheme and host, no default port, encoded path and query and no fragment. ``fault`` is
    null, ``no_host``, ``bad_port`` or ``bad_host``; a faulty href has no URL.

    Each step names its intermediate values in a struct, so nothing is computed twice and
    the expression stays small; the base is read once, not once per href. The expression
    holds no data and is built once per pair of names.
    """
    base, hrefs = F.col(base), F.col(hrefs)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(?:/(?:[^?#]*/)?)?)", 1)
    parts = F.struct(
        scheme(base).alias("scheme"),
        F.regexp_extract(base, _ORIGIN, 1).alias("origin"),
        F.regexp_extract(base, r"^([^?#]*)", 1).alias("page"),
        strip_fragment(base).alias("plain"),
        F.regexp_replace(folder, r"([^/])$", "$1/").alias("folder"),
    )
    started = F.zip_with(
        F.array_repeat(parts, F.size(hrefs)),
        hrefs,
        lambda b, h: F.struct(b.alias("base"), h.alias("raw_href"), _forward_slashes(clean_href(h)).alias("href")),
    )
    schemed = F.transform(
        started, lambda s: F.struct(s["base"].alias("base"), s["raw_href"].alias("raw_href"),
                                    s["href"].alias("href"), scheme(s["href"]).alias("own"))
    )
    joined = F.transform(
        schemed,
        lambda s: F.struct(s["raw_href"].alias("raw_href"), _joined(s["base"], s["own"], s["href"]).alias("abs")),
    )
    cut = F.transform(
        joined,
        lambda s: F.struct(
            s["raw_href"].alias("raw_href"),
            authority(s["abs"]).alias("authority"),
            site_root(s["abs"]).alias("root"),
            path(s["abs"]).alias("path"),
            query(s["abs"]).alias("query"),
        ),
    )
    placed = F.transform(
        cut,
        lambda s: F.struct(
            s["raw_href"].alias("raw_href"),
            s["root"].alias("root"),
            F.regexp_extract(s["authority"], r"^(.*@)", 1).alias("login"),
            F.regexp_replace(s["authority"], r"^.*@", "").alias("place"),
            remove_dot_segments(s["path"]).alias("path"),
            percent_encode(s["query"]).alias("query"),
        ),
    )
    checked = F.transform(
        placed,
        lambda s: F.struct(
            s["raw_href"].alias("raw_href"),
            s["root"].alias("root"),
            s["login"].alias("login"),
            percent_encode(s["path"], "{}").alias("path"),
            s["query"].alias("query"),
            _fault(
                s["place"],
                F.regexp_replace(s["place"], r":[^:\]]*$", ""),
                F.regexp_extract(s["place"], r":([^:\]]*)$", 1),
            ).alias("fault"),
        ),
    )
    return F.transform(
        checked,
        lambda s: F.struct(
            s["raw_href"].alias("raw_href"),
            F.when(
                s["fault"].isNull(),
                F.concat(
                    F.regexp_replace(s["root"], "//", F.concat(F.lit("//"), F.regexp_replace(s["login"], r"([\\$])", r"\\$1"))),
                    s["path"],
                    s["query"],
                ),
            ).alias("url"),
            F.when(s["fault"].isNull(), F.concat(s["root"], F.lit("/"))).alias("site"),
            F.when(s["fault"].isNull(), s["path"]).alias("path"),
            s["fault"].alias("fault"),
        ),
    )


def _decoded(text: Column) -> Column:
    # Control characters stay encoded, for they would break output lines.
    safe = F.regexp_replace(text, r"(?i)%(?=[01][0-9a-f]|7f)", "%25")
    plain = F.try_url_decode(F.replace(safe, F.lit("+"), F.lit("%2B")))
    lost = plain.contains("\ufffd") & ~F.upper(text).contains("%EF%BF%BD") & ~text.contains("\ufffd")
    return F.when(text.contains("%"), F.coalesce(F.when(~lost, plain), text)).otherwise(text)


def human_url(url) -> Column:
    """URL with path and query percent-decoded, for output lines.

    Encoded control characters stay as they are, and so does a URL whose bytes are no UTF-8.
    """
    url = _col(url)
    origin = F.regexp_extract(url, _ORIGIN, 1)
    rest = F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$", 1)
    return F.when(origin == "", url).otherwise(F.concat(origin, _decoded(rest)))


@F.pandas_udf(T.StringType())
def unicode_host(url: pd.Series) -> pd.Series:
    """Show ``xn--`` host labels in their own script; apply only where they occur."""

    def label(match: re.Match) -> str:
        try:
            return match.group(0).encode("ascii").decode("idna")
        except UnicodeError:
            return match.group(0)

    def show(text: str) -> str:
        return re.sub(r"(?i)(?<=[/.@])xn--[a-z0-9-]+(?=[^?#]*)", label, text, count=0)

    return url.map(show, na_action="ignore")


@F.pandas_udf(T.StringType())
def ascii_host(host: pd.Series) -> pd.Series:
    """Internationalised host as ASCII labels; null if it has no such form."""

    def encode(name: str | None) -> str | None:
        try:
            return name and name.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return host.map(encode, na_action="ignore")
