"""Main texts of pages: markup by cases, comparison against a plain version over whole hosts."""

import html
import random
import re

import pytest
from llm_cases import FOLDER, in_order
from pyspark.sql import functions as F

import tributary.llm.pages as module
from tributary.llm.pages import OUT, Page, address, candidates, common, extract_articles, gone_lines, nearness, ruled

ARTICLE = "<article><h1>T &amp; x</h1><p>One  two\n three.<p>Four<br>five &eacute;.</article>"


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("cells", [1 << 27, 4])
def test_common_lines_are_a_longest_subsequence(monkeypatch, cells):
    monkeypatch.setattr(module, "CELLS", cells)
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(15))] for k in (rng.choice([2, 4, 9]),) * 2)
        found = common(a, b)
        rest = iter(b)
        assert found == sorted(set(found)) and len(found) == longest(a, b) and all(a[i] in rest for i in found)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (ARTICLE, ["T & x", "One two three.", "Four five é."]),
        ("<body><header>H</header><nav><ul><li>a<li>b</ul></nav>" + ARTICLE + "<footer>f</footer>", ["T & x", "One two three.", "Four five é."]),
        ("<title>t</title><p>a<script>if (1 < 2) '</p>'</script>b<style>p{}</style></p><!-- <p>c</p> -->d", ["ab", "d"]),
        ("<div class='ad'>buy</div><div class=cookie-notice>yes</div><div id='sidebar'><div>x</div>y</div><p>text", ["text"]),
        ("<main><h1>T</h1><div>m</div><article><p>a</p><form>q</form><div class='post-comments'>c</div></article></main><p>out</p>", ["T", "a"]),
        ("<div class='entry-content'><header><h2>s</h2></header>b</div>o", ["s", "b"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a b", "c"]),
        ("<article class='comment'>no</article><p>a &lt;b&gt; 1 < 2 &nbsp; c</p>", ["a <b> 1 < 2 c"]),
        ("<aside><p>x</aside><p hidden>y</p><p style='display: none'>z</p><span class=ad><span>i</span>j</span>k", ["k"]),
        ("<p title='a>b'>c</p><a href=\"x>d", ["c", "d"]),
        ("<ARTICLE><P>U</P></ARTICLE><body class='has-sidebar'>", ["U"]),
        ("", []), ("   ", []), ("plain", ["plain"]), ("<<<p>>", ["<<", ">"]), ("<script>never closed", []), ("<!-- never closed", []),
    ],
)
def test_markup(page, want):
    assert candidates(page) == want


def test_addresses():
    assert address("HTTP://u@A.b:8/x/y.html?q#f") == ("a.b:8", "/x/y") and address("//h/x/index.php") == ("h", "/x")
    assert address(None) == address("odd") == address("") == ("", "")
    assert nearness("/a/b/c", "/a/b/d") > nearness("/a/b/c", "/a/x") > nearness("/a/b", "/x")


def by_hand(pages):
    """Every host's pages in order, compared with no groups."""
    rows, out = sorted({(*address(u), k, u, h) for k, u, h in pages if address(u)[0]}), {}
    parsed = [ruled(r[4]) for r in rows]
    whole = [Page(r[0], r[1], p[0], [len(t) for t in p[0]], p[1]) for r, p in zip(rows, parsed)]
    for i, page in enumerate(whole):
        gone = gone_lines(whole, i)
        out[rows[i][2:]] = "\n\n".join(t for k, t in enumerate(page.lines) if k not in gone and page.rules[k] != OUT)
    return out


def made(rng, i):
    """A page of a site without telling markup: its lines stand among those of all pages."""
    own = [f"Line {rng.randrange(10**9)} of page {i} and nothing else." for _ in range(rng.choice([1, 3, 9]))]
    box = ["<div>", "</div>"] if i % 4 else ["<article><h1>Title</h1>", "<p>Share this</p></article>"]
    body = "".join(f"<p>{x}</p>" for x in own)
    return f"<html><div>Site name</div><div>Home</div>{box[0]}{body}{box[1]}<div>About us</div></html>", own


@pytest.mark.parametrize("group", [512, 7])
def test_comparison_against_whole_hosts(spark, monkeypatch, group):
    monkeypatch.setattr(module, "GROUP", group)
    rng = random.Random(2)
    pages, truth = [], {}
    for i in range(90):
        url = f"https://host{i % 4}.example/{rng.choice('abc')}/{rng.randrange(50)}.html"
        page, own = made(rng, i)
        pages.append((i, url, page))
        truth[i] = own
        if i % 10 == 0:  # the same article at other addresses
            pages += [(1000 + 100 * i + k, url.replace(".html", f"-{k}"), page) for k in range(rng.choice([1, 12]))]
    pages += [(50000, "https://alone.example/", ARTICLE), (50001, None, "<p>a</p>"), (50001, None, "<p>a</p>"), (None, "https://host0.example/a", None), (50002, "https://host0.example/a/1", "")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = extract_articles(table.withColumn("key", F.lit("clash")).withColumn("lines", F.lit(1))).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got}
    keys = {(r.page_id, r.url): r.key for r in module.parsed(table).collect()}
    want = by_hand([(keys[i, u], u, h or "") for i, u, h in pages])
    for i, u, h in pages:
        assert texts[i] == want.get((keys[i, u], u, h or ""), "a" if u is None else None)
    clean = sum(texts[i] == "\n\n".join((["Title"] if i % 4 == 0 else []) + own) for i, own in truth.items())
    assert clean >= 85


def test_given_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = in_order(extract_articles(pages).select("page_id", "url", "text").collect())
    want = []
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?p>|</?h1>", inner)]
        want.append((r.page_id, r.url, "\n\n".join(x for x in blocks if x)))
    assert got == in_order(want)


def test_no_pages(spark):
    assert extract_articles(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
