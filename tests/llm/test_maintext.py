"""Lines, alignment and whole pages."""

import html as entities
import random
import re

from crawlframe.llm import maintext as m


def text(page):
    return [line for line, _ in m.lines_of(page)]


def test_lines():
    assert text("") == [] and text("plain  text\n here") == ["plain text here"]
    assert text("<p>a &amp; b&#33; &eacute;&nbsp;x<br>y<p>c <b>d</b>e</p>") == ["a & b! é x y", "c de"]
    assert text("<nav>x</nav><header>h</header><p>k<script>if(a<b)</script></p><style>p{}</style><!-- <p>c</p> --><footer>f</footer>") == ["k"]
    assert text('<div class="ad big">x<div>y</div></div>z<div id="user-comments"><p>c</p></div><form>f</form><aside>s</aside>') == ["z"]
    assert text('<div class="header-shadow read">ok</div><p class="bad">fine</p>') == ["ok", "fine"]
    assert m.lines_of("<p>o</p><article><header><h1>t</h1></header><p>a<p>b</article><p>q") == [("o", False), ("t", True), ("a", True), ("b", True), ("q", False)]
    assert text("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>") == ["1", "2", "3", "4"]
    assert text("<div " + "a " * 5000 + ">x</div>" + "<b>" * 3000 + "y") == ["x", "y"]


def test_wrappers_do_not_hide_articles():
    article = "<article><p>the text of the article</p></article>"
    for wrapper in ('div class="layout has-sidebar"', 'div class="no-sidebar"', 'div class="with-nav"', 'div class="comments-open"', 'div class="elementor-widget wide"',
                    'div id="social-security"', 'div id="has-sidebar"', 'div class="widget"', 'form id="aspnetForm"', 'section role="form"'):
        tag = wrapper.split()[0]
        assert text(f'<{wrapper}><div class="ad">buy</div>{article}<form>mail</form></{tag}><form>search</form>') == ["the text of the article"], wrapper
        assert text(f"<{wrapper}><p>a page without an article</p></{tag}><p>end</p>") == ["a page without an article", "end"], wrapper
    assert text(article + '<div class="comments"><p>' + "long " * 50 + "</p></div>") == ["the text of the article"]
    assert text(article + '<div id="comments"><article class="comment-body">reply</article></div>') == ["the text of the article"]
    assert text("<main><p>a <math><mi>x</mi></math> b <button>c</button> d <select><option>e</option></select></p></main><button>no</button>") == ["a x b c d e"]
    assert text('<div class="ad">' * 40 + "x" + "</div>" * 40 + "<p>longer text</p>") == ["longer text"]


def test_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.choice("abcde") for _ in range(rnd.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = sorted(m.common_lines(a, b))
        assert len(found) == table[-1][-1]
        at = iter(b)
        assert all(a[i] in at for i in found)


def test_shared_lines_go(spark):
    page = lambda body: f"<div>Site name</div><p>{body}</p><p>Read more here</p><p>End {body}</p><div>Contact us</div>"
    rows = [(i, f"http://h.example/en/{i:03}", page(f"text {i}")) for i in range(40)]
    rows += [(100, "http://solo.example/", page("alone")), (101, None, None), (102, "", ""), (103, "http://c.example/1", page("copy")), (104, "http://c.example/1", page("copy"))]
    rows += [(200, "http://h.example/en/000x", "<p>x</p><article><h1>T</h1><p>a&lt;b</p></article>" + "<p>tail</p>"), (None, "http://h.example/en/z", page("null id"))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS main", "2 AS host")
    out = {r.page_id: r.text for r in m.extract(pages).collect()}
    assert len(out) == len(rows)
    assert all(out[i] == f"text {i}\nEnd text {i}" for i in range(40))
    whole = "Site name\n{0}\nRead more here\nEnd {0}\nContact us"
    assert out[100] == whole.format("alone") and out[101] == out[102] == "" and out[103] == out[104] == whole.format("copy")
    assert out[200] == "T\na<b" and out[None] == "null id\nEnd null id"
    assert m.extract(pages.where("false")).count() == 0


def test_copies_get_one_text(spark):
    page = lambda body: f"<div>Site name</div><p>{body}</p><div>Contact us</div>"
    rows = [(i, f"http://h.example/b/{i // 2}", page("copied text")) for i in range(9)] + [(20, "http://h.example/c", page("another"))]
    rows += [(21, "http://h.example/b/1", ""), (22, "http://h.example/b/2", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = {r.page_id: (r.text, r.n_lines_deleted) for r in m.extract(pages).collect()}
    assert out == {i: ("copied text", 2) for i in range(9)} | {20: ("another", 2), 21: ("", 0), 22: ("", 0)}


def test_pages_with_articles_are_compared(spark):
    def page(i):
        lead = f"<div>The site of all news</div><h1>Headline{i}</h1><p>Lead of page {i}</p>"
        return f"{lead}<article><p>Shared paragraph</p><p>Own {i}</p></article><div>First post of {i}</div><div>Contact us here</div>"

    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(6)] + [(9, "http://solo.example/", page(9))]
    out = {r.page_id: (r.text, r.n_lines_deleted) for r in m.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    own = "Headline{0}\nLead of page {0}\nShared paragraph\nOwn {0}\nFirst post of {0}"
    assert out == {i: (own.format(i), 2) for i in range(6)} | {9: (f"The site of all news\n{own.format(9)}\nContact us here", 0)}


def test_query(spark, sf_dir):
    """Against the articles cut out by patterns that suit these pages only."""
    from crawlframe.llm.queries import QUERIES

    out = {r.page_id: (r.url, r.text, r.n_chars) for r in QUERIES["op3_html_extraction"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", lambda t: " " if "br" in t[0] else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(b for b in blocks if b)
        assert out[r.page_id] == (r.url, want, len(want))


def test_only_undecided_texts_are_sent(spark):
    """Pages whose lines all lie in an article or go for themselves are compared, but their texts are not shuffled."""
    shared = "<p>the very same line of each page</p>"
    made = [(i, f"https://h/{i}", f"{shared}<article><p>own text {i} here</p></article>" if i % 2 else f"<p>plain page {i} says</p>{shared}") for i in range(10)]
    made += [(20 + i, f"https://a/{i}", f"<nav>x</nav><article><p>same</p><p>text {i}</p></article>") for i in range(4)]
    rows = spark.createDataFrame(made, "page_id bigint, url string, html string")
    got = m.extract(rows)
    want = {i: f"own text {i} here" if i % 2 else f"plain page {i} says" for i in range(10)} | {20 + i: f"same\ntext {i}" for i in range(4)}
    assert {r.page_id: r.text for r in got.collect()} == want
    assert {r.page_id: r.n_lines_deleted for r in got.collect()} == {i: int(i < 20) for i in want}
    # One side of the union reads the lines and joins nothing.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "Union" in line)
    sides = [i for i in range(at + 1, len(lines)) if depth(lines[i]) == depth(lines[at]) + 3]
    assert len(sides) == 2 and not any("Join" in line for line in lines[sides[1] :])
