"""Main text of pages: blocks by markup, and differencing with the page of the nearest URL.

A page's html becomes lines, one for each block, with references decoded and white space made single blanks.
Parts that the markup itself marks as other than content (menus, headers, footers, asides, adverts, forms, comments,
scripts and so on, by element, role, class or id) give no lines; a form, role, class or id does not hide an element with
an article in it or, on a page without articles, over half of the page's text. Every page, with an article or without, is compared with its
neighbour: within each host pages are ordered by path, the neighbours are the two pages before and the two after, and the page is
paired with that of the longest common path that shares a line with it. Their lines are aligned by a
longest common subsequence, and the lines of the subsequence go, but for those within ``article`` or ``main``, which are content.
On a page with an article, single short words outside of it that are no headings go as well. Copies (pages of a host with the same
lines) are paired as one page, at the least of their paths, and get the same text.

Neighbours come from ranks within the host found by pieces, so a host that holds a third of all pages is worked
on by many tasks; only 64-bit hashes of lines are sent to a neighbour.

Nulls and repeats: null html has no lines and an empty text; null URLs are a host of their own; repeated
pages are copies of each other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.common import map_batches
from crawlframe.operators.ordered import split_rank
from crawlframe.session import stored

# Elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup "
    "hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NOT_CONTENT = frozenset(
    "aside audio button canvas datalist dialog footer head iframe input map math menu nav noscript object option script "
    "search select style svg template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer "
    "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo "
    "promoted recommended related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
CLOSES_P = BLOCKS - {"body", "html", "li", "dd", "dt", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}
WHITE = re.compile(r"\s+")
MARK = re.compile(r"[a-z]+")
#: Parts of the ids of wrappers, which name what lies in them.
WRAPS = frozenset("has no with without is".split())
#: Text of these is content in an article.
INLINE = frozenset("button map math object option select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Marked elements in each other that are told apart.
DEPTH = 16
#: What becomes of a line: it stays, goes if the neighbour has it, or goes.
KEPT, COMPARED, DROPPED = range(3)
#: Single words shorter than this are no content outside of a page's article.
STRAY = 20
#: Places of the neighbours that a page may be compared with.
SIDES = (-2, -1, 1, 2)


class Lines(HTMLParser):
    """Collects (line, whether in an article, whether a heading, the marked elements it lies in).

    Whether a mark hides its element is known at the end only: it does not if an article lies in the element,
    or, on a page without articles, over half of the page's text.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, bool, bool, tuple[int, ...]]] = []
        self.open: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # element, hidden here, in an article, marked elements
        self.text: list[str] = []
        self.marks = 0
        self.holding: set[int] = set()  # marked elements with an article

    def state(self) -> tuple[bool, bool, tuple[int, ...]]:
        return self.open[-1][1:] if self.open else (False, False, ())

    def flush(self) -> None:
        line = WHITE.sub(" ", "".join(self.text)).strip()
        self.text = []
        hidden, inside, marked = self.state()
        if line and not hidden:
            self.found.append((line, inside, any(t[0] in HEADINGS for t in self.open[-8:]), marked))

    def lines(self) -> list[tuple[str, bool, bool]]:
        """(line, whether in an article, whether a heading) of what no mark hides."""
        sizes: dict[int, int] = {}
        for line, _, _, marked in self.found:
            for n in marked:
                sizes[n] = sizes.get(n, 0) + len(line)
        whole = sum(len(line) for line, *_ in self.found)
        article = any(inside for _, inside, _, marked in self.found if self.holding.issuperset(marked))
        shown = self.holding | {n for n, size in sizes.items() if not article and 2 * size > whole}
        return [(line, inside, heading) for line, inside, heading, marked in self.found if shown.issuperset(marked)]

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            elif tag == "hr":
                self.flush()
            return
        if tag in CLOSES_P and any(t[0] == "p" for t in self.open[-8:]):
            self.close_tag("p")
        if tag in BLOCKS or tag in NOT_CONTENT and not (tag in INLINE and self.state()[1]) or tag in ("form", "header"):
            self.flush()
        hidden, inside, marks = self.state()
        if not hidden:
            attrs = dict(attrs)
            hidden = tag in NOT_CONTENT and not (tag in INLINE and inside) or tag == "header" and not inside or self.unseen(tag, attrs)
            marked = not hidden and self.marked(tag, attrs)
            if hidden or marked:
                self.flush()
            if marked and len(marks) < DEPTH:
                self.marks += 1
                marks = (*marks, self.marks)
            elif tag in ("article", "main") and not hidden:
                self.holding.update(marks)
        inside = inside or tag in ("article", "main")
        self.open.append((tag, hidden, inside, marks))

    def unseen(self, tag: str, attrs: dict) -> bool:
        return tag not in ("html", "body", "article", "main") and ("hidden" in attrs or attrs.get("aria-hidden") == "true")

    def marked(self, tag: str, attrs: dict) -> bool:
        """Whether the element is a form or has a role, a whole class name, or an id or its last part, out of the marks."""
        names = (attrs.get("class") or "").lower().split()
        if tag in ("html", "body", "article", "main"):
            return tag == "article" and any("comment" in MARK.findall(n) for n in names)
        if tag == "form" or attrs.get("role") in ROLES:
            return True
        parts = MARK.findall((attrs.get("id") or "").lower())
        last = parts[-1:] if not WRAPS.intersection(parts) else []
        return any(w in MARKS for w in (*names, *last))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def close_tag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        # A wrong end tag in a hidden part does not end what lies around that part.
        if any(h or m for _, h, _, m in self.open[at + 1 :]) and not (self.open[at][1] or self.open[at][3]) and tag not in BLOCKS | {"article", "main", "body", "html"}:
            return
        inline = tag in INLINE and self.state()[1]
        before = self.open[at - 1][1:] if at else (False, False, ())
        if tag in BLOCKS or tag in NOT_CONTENT and not inline or tag in ("form", "header") or before != self.state():
            self.flush()
        del self.open[at:]

    def handle_endtag(self, tag):
        if tag == "br":
            self.text.append(" ")
        else:
            self.close_tag(tag)

    def handle_data(self, data):
        if not self.state()[0]:
            self.text.append(data)


def parsed_lines(html: str) -> list[tuple[str, bool, bool]]:
    """The page's lines in order, whether each is in an article, and whether it is a heading."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.lines()


def lines_of(html: str) -> list[tuple[str, bool]]:
    """The page's lines in order, and whether each is in an article."""
    return [(line, inside) for line, inside, _ in parsed_lines(html)]


def common_lines(a: list, b: list) -> set[int]:
    """Indices of ``a`` in a longest common subsequence with ``b``; bits of one number stand for a's lines."""
    where: dict = {}
    for i, line in enumerate(a):
        where[line] = where.get(line, 0) | 1 << i
    full = (1 << len(a)) - 1
    steps, s = [full], full
    for line in b:
        hit = s & where.get(line, 0)
        s = ((s + hit) | (s - hit)) & full
        steps.append(s)
    i, j, found = len(a), len(b), set()
    while i and j:
        bit = 1 << (i - 1)
        if steps[j] & bit:
            i -= 1
        elif not steps[j - 1] & bit:
            j -= 1
        else:
            found.add(i - 1)
            i, j = i - 1, j - 1
    return found


def common_prefix(a: str, b: str) -> int:
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a.count("/", 0, n) * 10_000 + n


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """(id, url, text, n_lines_deleted) of every page."""

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines, kinds, keys, marks = [], [], [], []
        for html in batch.column(2):
            found = parsed_lines(html.as_py() or "")
            article = any(inside for _, inside, _ in found)
            lines.append([line for line, _, _ in found])
            stray = lambda line, heading: article and not heading and len(line) < STRAY and " " not in line
            kinds.append([KEPT if inside else DROPPED if stray(line, heading) else COMPARED for line, inside, heading in found])
            keys.append(np.array([xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) for line in lines[-1]], np.uint64).view(np.int64))
            marks.append(xxhash.xxh64_intdigest(keys[-1].tobytes()))
        columns = [pa.array(lines, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.int8())), pa.array(keys, pa.list_(pa.int64()))]
        mark = pa.array(np.array(marks, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, mark], names=["id", "url", "lines", "kinds", "keys", "mark"])

    id_type = pages.schema[id_col].dataType.simpleString()
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html_col)
    # Written once: pages would be parsed anew for the texts and for the ranks.
    schema = f"id {id_type}, url string, lines array<string>, kinds array<tinyint>, `keys` array<bigint>, mark bigint"
    parsed = stored(map_batches(slim, parse, schema), "lines", "zstd")
    url = F.coalesce("url", F.lit(""))
    parsed = parsed.withColumns({
        "host": F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1)),
        "path": F.regexp_replace(url, r"^[A-Za-z][\w+.-]*://[^/?#]*", ""),
    })
    # Copies on a host are one row, so that neighbours always differ; ranked by path within their host.
    compared = parsed.where(F.size("keys") > 0)
    folded = stored(compared.groupBy("host", "mark").agg(F.min("path").alias("path"), F.first("keys").alias("keys")), "lists", "zstd")
    splits = [F.substring("path", 1, 6), F.col("path"), F.shiftright("mark", 48)]
    ranked = split_rank(folded, ["host"], ["path", "mark"], splits, name="at")
    sent = F.explode(F.array(*[F.lit(i) for i in SIDES])).alias("side")
    near = ranked.select("host", "at", "path", "keys", sent).select(
        "host", (F.col("at") + F.col("side")).alias("at"), F.struct("side", "path", "keys").alias("other")
    )
    near = near.groupBy("host", "at").agg(F.collect_list("other").alias("others"))  # four at most
    paired = ranked.join(near, ["host", "at"]).select("host", "mark", "path", "keys", "others")

    def difference(batch: pa.RecordBatch) -> pa.RecordBatch:
        shared = []
        for path, own, others in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
            nearest = sorted(others, key=lambda o: (-common_prefix(path, o["path"]), abs(o["side"]), o["side"]))
            gone = next(filter(None, (common_lines(own, o["keys"]) for o in nearest)), set())
            shared.append([i in gone for i in range(len(own))])
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shared, pa.list_(pa.bool_()))], names=["host", "mark", "shared"])

    # Written, since Spark would leave the comparison out of a table in which it decides on no line.
    shared = stored(map_batches(paired, difference, "host string, mark bigint, shared array<boolean>"), "shared", "zstd")
    stays = lambda line, i: (F.get("kinds", i) == KEPT) | (F.get("kinds", i) == COMPARED) & ~F.coalesce(F.get("shared", i), F.lit(False))
    # Every page is compared, but only texts with a line that the comparison decides on are sent to its outcome.
    undecided = F.exists("kinds", lambda kind: kind == COMPARED)
    joined = parsed.where(undecided).join(shared, ["host", "mark"], "left").select("id", "url", "lines", F.filter("lines", stays).alias("left"))
    decided = parsed.where(~undecided).select("id", "url", "lines", F.filter("lines", lambda line, i: F.get("kinds", i) == KEPT).alias("left"))
    return joined.union(decided).select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), F.array_join("left", "\n").alias("text"),
        (F.size("lines") - F.size("left")).cast("bigint").alias("n_lines_deleted"),
    )
