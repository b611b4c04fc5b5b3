"""WARC archives of pages and their merged capture index.

Pages become WARC 1.1 records: of equal payloads the one of the largest id is a ``response``, the others are
``revisit`` records that refer to it and hold its HTTP header, with the length of the full payload, but no body.
Spark's text writer makes the gzip files (a record and its payload are UTF-8 text), one of each partition
of the join that finds a payload's response, so payloads move once. Reading back walks each file by ``Content-Length``, so payloads may hold anything.

Each file's index entries are a run, sorted where the file is read. The runs are cut by ranges of
(URL key, time, id), and each range is merged from its slices of all runs by a loser tree: one
comparison per level and entry. Ranges, put after each other, are the capture histories of all URLs in order;
a URL of very many captures is cut by time and id.

Nulls and repeats: a null payload is empty; a null URL is written as ``urn:page:<id>`` and read as null; a null id
is written as ``-``; of equal payloads whose ids are all null each is a response; rows that repeat the largest
id are responses, too. Control characters and blanks of URLs are percent-encoded in the header and restored by reading.
An empty table gives an empty index. Only id, URL and payload are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.llm.common import map_batches
from crawlframe.session import work_path

LINE = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = datetime(2000, 1, 1, tzinfo=UTC)
INDEX = ["url_key", "captured", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "file", "offset"]
INDEX_SCHEMA = (
    "url_key string, captured string, page_id bigint, url string, record_type string, payload_bytes bigint, "
    "payload_digest string, refers_to bigint, file string, offset bigint"
)


def payload_digest(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def captured(page_id: int | None) -> str:
    """The capture's time: pages have none, so ids stand for seconds."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 36))).strftime("%Y-%m-%dT%H:%M:%SZ")


def url_key(url: str | None) -> str:
    """Host with its parts reversed, then the rest: captures of a site sort together."""
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return url or ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + (rest[cut:].partition("#")[0] or "/")


def name(page_id: int | None) -> str:
    return f"<urn:page:{'-' if page_id is None else page_id}>"


def number(text: str) -> int | None:
    found = text[len("<urn:page:") : -1]
    return None if found == "-" else int(found)


def record(page_id: int | None, url: str | None, html: str, response_id: int | None, is_response: bool) -> str:
    """A record without its last line end, which the writer adds."""
    body = html.encode()
    http = LINE.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""])
    target = name(page_id)[1:-1] if url is None else quote(url, safe="!#$&'()*+,/:;=?@[]~", encoding="utf-8")
    head = ["WARC/1.1", f"WARC-Type: {'response' if is_response else 'revisit'}", f"WARC-Record-ID: {name(page_id)}",
            f"WARC-Date: {captured(page_id)}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{payload_digest(body)}"]
    if not is_response:
        head += [f"WARC-Refers-To: {name(response_id)}", f"WARC-Profile: {PROFILE}"]
    size = len(http) + (len(body) if is_response else 0)
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {size}", "", ""]
    return LINE.join(head) + http + (html if is_response else "") + LINE


def archive_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(value): the records; of equal payloads of ``least_bytes`` or more one is a response."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("_sum", F.sha2("html", 256))
    largest = rows.groupBy("_sum").agg(F.max("page_id").alias("_response"))
    # One row per payload on the right: Spark may split a payload of very many pages on the left.
    # A merge join deals pages out by payload, which spreads a table of few files, too; no second shuffle follows.
    joined = rows.join(largest.hint("merge"), "_sum").select("page_id", "url", "html", "_response")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for page_id, url, html, response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            alone = page_id == response or len(html.encode()) < least_bytes
            out.append(record(page_id, url, html, response, alone))
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return map_batches(joined, work, "value string")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Gzip WARC files below ``path``; equal payloads of ``least_bytes`` or more are stored once."""
    archive_records(pages, least_bytes).write.option("lineSep", LINE).option("compression", "gzip").text(path)


def records(packed: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, block) of the records of a gzip WARC file, read piece by piece."""
    unzip, waiting, source, at = zlib.decompressobj(31), bytearray(), io.BytesIO(packed), 0

    def more() -> bool:
        piece = source.read(1 << 18)
        waiting.extend(unzip.decompress(piece) if piece else unzip.flush())
        return bool(piece)

    while True:
        while (end := waiting.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0:
            if waiting:
                raise ValueError("a record without an end")
            return
        lines = waiting[:end].decode().split(LINE)
        header = dict(line.split(": ", 1) for line in lines[1:])
        size = end + 4 + int(header["Content-Length"]) + 4
        while len(waiting) < size and more():
            pass
        if not lines[0].startswith("WARC/") or waiting[size - 4 : size] != b"\r\n\r\n":
            raise ValueError("not a record")
        yield at, header, bytes(waiting[end + 4 : size - 4])
        del waiting[:size]
        at += size


def entry(file: str, offset: int, header: dict[str, str], block: bytes) -> tuple:
    """The index entry of a record; a response's digest is that of the bytes read."""
    page_id, http, body = number(header["WARC-Record-ID"]), *block.split(b"\r\n\r\n", 1)
    revisit = header["WARC-Type"] == "revisit"
    digest = header["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and payload_digest(body) != digest:
        raise ValueError(f"a damaged payload in {file} at {offset}")
    full = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
    target = header["WARC-Target-URI"]
    url = None if target == name(page_id)[1:-1] else unquote(target)
    refers = number(header["WARC-Refers-To"]) if revisit else None
    return url_key(url), header["WARC-Date"], page_id, url, header["WARC-Type"], full, digest, refers, file, offset


class LoserTree:
    """Merges sorted lists. Inner nodes hold the losers; the winner climbs with one comparison per level."""

    def __init__(self, runs: list[list], key):
        self.runs = [iter(r) for r in runs]
        self.key, k = key, max(1, len(runs))
        self.heads = [self.pull(i) for i in range(len(runs))] or [None]
        self.losers = [0] * k
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.first(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def pull(self, i: int):
        value = next(self.runs[i], None)
        return None if value is None else (self.key(value), value)

    def first(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def __iter__(self):
        k = len(self.heads)
        while (head := self.heads[self.winner]) is not None:
            yield head[1]
            i = self.winner
            self.heads[i] = self.pull(i)
            node = (i + k) // 2
            while node > 0 and k > 1:
                if self.first(self.losers[node], i):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.winner = i


def order_of(e: tuple) -> tuple:
    """Index order: URL key, time, id (null first), type."""
    return e[0], e[1], e[2] is not None, e[2] or 0, e[4]


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """The merged index of the archives below ``path``, in the order of URL key, time and id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")

    def table(entries: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64() if c in ("page_id", "payload_bytes", "refers_to", "offset") else pa.string() for c in INDEX]
        columns = list(zip(*entries, strict=True)) or [[]] * len(INDEX)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=INDEX)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                file = path.as_py()
                yield table(sorted((entry(file, *r) for r in records(content.as_py())), key=order_of))

    runs = files.mapInArrow(read, INDEX_SCHEMA)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[tuple]] = {}
        for batch in batches:
            for e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slices.setdefault(e[8], []).append(e)
        for part in slices.values():
            part.sort(key=order_of)  # a slice comes in order already unless the shuffle turned it; then this is one pass
        out = []
        for e in LoserTree([slices[f] for f in sorted(slices)], order_of):
            out.append(e)
            if len(out) == 4096:
                yield table(out)
                out = []
        if out:
            yield table(out)

    return runs.repartitionByRange("url_key", "captured", "page_id").mapInArrow(merge, INDEX_SCHEMA)


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a new folder in the shared space and read its index."""
    path = work_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return capture_index(pages.sparkSession, path)
