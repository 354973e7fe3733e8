"""Main texts of web pages: markup gives the text lines, and what pages with near addresses share is deleted."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.text import cut, slices, small_batches

#: Elements without a part of the article, and those whose content is no markup.
NO_ARTICLE = set(
    "head nav footer aside form script style noscript template iframe object svg canvas audio video button select textarea dialog menu title header".split()
)
RAW = "script style textarea title iframe xmp noembed noframes"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
NO_ARTICLE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in names of classes that tell of something beside the article; those of WEAK don't where a word of OWN stands beside them.
NOISE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent "
    "gdpr notice popup modal overlay newsletter subscribe subscription signup social share sharing comment comments disqus respond reply replies footer header masthead topbar toolbar "
    "related recommended widget widgets pagination pager login".split()
)
WEAK, OWN = {"header", "banner", "notice", "reply"}, set("article post entry story content".split())
NAMES_OF_ARTICLES = set("article article-body article-content article-text post-content post-body entry-content main-content story-body content-body".split())
#: Elements that a judgement needs, attributes that may tell something, and elements that stand for a space.
LEVELLED, RELEVANT, SPACED = {"article", "main"}, re.compile("class|id|role|style|item", re.I), {"br", "td", "th"}
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW.replace(' ', '|')})\b[^>]*+>.*?(?:</\1\s*+[^>]*+>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
ADDRESS = re.compile(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]+)([^?#]*)", re.I)
#: Rows of pages in the order of addresses that are compared in one group, and how far a page's partners may stand from it.
GROUP, REACH = 512, 4
#: Partners a page is compared with; share of both pages' text from which they are one article twice; words a line of a marked article has at most to be deleted.
PARTNERS, ONE_ARTICLE, SHORT = 2, 0.8, 8
OUT, STAYS, GOES_WITH_ANY, GOES_WITH_ALL = range(4)
#: Cells a comparison keeps at once.
CELLS = 1 << 27


def noise(name: str) -> bool:
    """Whether a class or id tells of something beside the article."""
    words = set(re.findall(r"[A-Z]?[a-z]+", name))
    words = {w.lower() for w in words}
    found = words & NOISE
    return bool(found and not words & {"has", "with", "no", "without"} and (found - WEAK or not words & OWN))


def judged(tag: str, text: str, inside: int) -> tuple[bool, int]:
    """Whether an element goes, and how surely it is the article: 3 its element or body, 2 the page's main part, else 0."""
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(text)} if text else {}
    role, names = found.get("role", "").lower(), f"{found.get('class', '')} {found.get('id', '')}".split()
    gone = tag in NO_ARTICLE and not (tag == "header" and inside) or role in NO_ARTICLE_ROLES or "hidden" in found
    gone = gone or "display:none" in found.get("style", "").replace(" ", "").lower()
    gone = gone or tag not in ("html", "body", "main") and any(map(noise, names))
    if tag == "article" or "articlebody" in found.get("itemprop", "").lower():
        return gone, 3
    lower = [x.lower() for x in names]
    return gone, 2 if tag == "main" or role == "main" or found.get("id", "").lower() in ("content", "main") or any(x in NAMES_OF_ARTICLES for x in lower) else 0


def text_lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, level, title) of the blocks of a page, those that markup shows to be no part of the article left out. An element's end also ends those inside it that aren't closed."""
    lines, held, open_, start = [], [], [], 0
    gone, level, tags = 0, [0], set()

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                title = any(x[0] == "h1" for x in open_)
                lines.append((text, 3 if title and level[-1] == 2 else level[-1], title))
            held.clear()

    place = page.find("<")
    while place >= 0:
        token = TOKEN.match(page, place)
        if token is None:
            place = page.find("<", place + 1)
            continue
        if not gone and place > start:
            held.append(page[start:place])
        start = token.end()
        place = page.find("<", start)
        tag = token[3] or token[6]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            if held:
                flush()
        elif tag in SPACED:
            held.append(" ")
        if token[2] or token[5]:
            if tag in tags:
                while open_:
                    name, off = open_.pop()
                    gone -= off
                    level.pop()
                    if name == tag:
                        break
                tags = {x[0] for x in open_}
        elif tag not in VOID:
            rest = token[4] or token[7] or ""
            off, own = judged(tag, rest, level[-1]) if tag in NO_ARTICLE or tag in LEVELLED or RELEVANT.search(rest) else (False, 0)
            # What decides nothing needs no place among the open elements, unless its end could be taken for another's.
            if (off or own or tag == "h1" or tag in tags) and not rest.endswith("/"):
                if off:
                    flush()
                open_.append((tag, off))
                tags.add(tag)
                level.append(max(level[-1], own))
                gone += off
    if not gone and start < len(page):
        held.append(page[start:])
    flush()
    return lines


def candidates(page: str) -> list[str]:
    """Lines of the surest level that has any."""
    lines = text_lines(page)
    best = max((x[1] for x in lines), default=0)
    return [x[0] for x in lines if x[1] == best]


def ruled(page: str) -> tuple[list[str], list[int]]:
    """All lines, and what may become of each: OUT, it is no candidate; STAYS; GOES_WITH_ANY or GOES_WITH_ALL of the partners that have it."""
    lines = text_lines(page)
    best = max((x[1] for x in lines), default=0)

    def rule(text: str, level: int, title: bool) -> int:
        if level < best:
            return OUT
        return GOES_WITH_ANY if not best else GOES_WITH_ALL if text.count(" ") < SHORT and not title else STAYS

    return [x[0] for x in lines], [rule(*x) for x in lines]


def address(url: str | None) -> tuple[str, str]:
    """Host and path, without what addresses of one page may differ in; no host for what isn't an address."""
    found = ADDRESS.match(url or "")
    if not found:
        return "", ""
    return found[1].lower(), re.sub(r"(?:/index)?(?:\.\w{2,5})?/*$", "", found[2])


def states(a: list[int], b: list[int]) -> Iterator[int]:
    """After each of ``b``, a number whose bit i is 0 where the longest common subsequence with ``a[:i + 1]`` is longer than with ``a[:i]``."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = state = (1 << len(a)) - 1
    for y in b:
        both = state & places.get(y, 0)
        state = ((state + both) | (state - both)) & every
        yield state


def gains(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``b`` and ``a[:i]``, for i from 0."""
    state = (1 << len(a)) - 1
    for state in states(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(state.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common(a: list[int], b: list[int], offset: int = 0) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    own = list(range(offset, offset + head))
    ends = list(range(offset + len(a) - tail, offset + len(a)))
    in_b = set(b[head : len(b) - tail])
    at = [i for i in range(head, len(a) - tail) if a[i] in in_b]
    x = [a[i] for i in at]
    in_a = set(x)
    y = [v for v in b[head : len(b) - tail] if v in in_a]
    if len(x) * len(y) > CELLS and len(y) > 1:
        # Halves of b, each with its part of a, so that memory has a bound.
        half = len(y) // 2
        split = int(np.argmax(gains(x, y[:half]) + gains(x[::-1], y[half:][::-1])[::-1]))
        found = common(x[:split], y[:half]) + common(x[split:], y[half:], split)
        return own + [offset + at[i] for i in found] + ends
    rows = list(states(x, y))
    i, j, found = len(x), len(y), []
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
            continue
        j -= 1
        if not j or rows[j - 1] >> (i - 1) & 1:
            i -= 1
            found.append(offset + at[i])
    return own + found[::-1] + ends


def nearness(a: str, b: str) -> int:
    """How many leading parts, and characters of the next one, two paths share."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return 1000 * a.count("/", 0, n + (n == len(a) or n == len(b))) + min(n, 999)


class Page(NamedTuple):
    host: str
    path: str
    lines: list[int]
    sizes: list[int]
    rules: list[int]


def gone_lines(pages: list[Page], i: int) -> list[int]:
    """Which of the candidates of page ``i`` go. Its partners are the PARTNERS nearest of the pages beside it that aren't the same article again."""
    page = pages[i]
    at = [k for k, rule in enumerate(page.rules) if rule != OUT]
    if not any(page.rules[k] > STAYS for k in at):
        return []
    own = [page.lines[k] for k in at]
    beside = [j for j in range(max(0, i - REACH), min(len(pages), i + REACH + 1)) if j != i and pages[j].host == page.host]
    beside.sort(key=lambda j: (-nearness(page.path, pages[j].path), abs(j - i), j))
    found: list[set[int]] = []
    for j in beside:
        if len(found) == PARTNERS:
            break
        shared = [at[k] for k in common(own, pages[j].lines)]
        whole = min(sum(x for x, rule in zip(p.sizes, p.rules) if rule != OUT) for p in (page, pages[j]))
        if sum(page.sizes[k] for k in shared) < ONE_ARTICLE * max(1, whole):
            found.append(set(shared))
    some = set().union(*found)
    every = set.intersection(*found) if len(found) == PARTNERS else set()
    return [k for n, k in enumerate(at) if page.rules[k] == GOES_WITH_ANY and k in some or page.rules[k] == GOES_WITH_ALL and k in every]


def parsed(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("key", F.xxhash64("page_id", "url", "html"))


def differences(pages: DataFrame) -> DataFrame:
    """(key, gone): for pages that share lines with their partners, the numbers of the lines that go.

    Pages are put in order by host and path; each is compared with those around it. Rows that are wholly equal count once, and pages without a host have no
    partner. Groups of pages overlap, so that the result doesn't depend on where they begin.
    """

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                out = []
                for key, url, page in zip(*(part.column(c).to_pylist() for c in ("key", "url", "html"))):
                    host, path = address(url)
                    if host:
                        texts, rules = ruled(page)
                        lines = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)
                        sizes = np.array([len(t) for t in texts], np.int32)
                        out.append((host, path, key, lines.tobytes(), sizes.tobytes(), np.array(rules, np.int8).tobytes()))
                columns = list(zip(*out)) or [()] * 6
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    names = ["host", "path", "key", "lines", "sizes", "rules"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    rows = parsed(pages).select("key", "url", "html").mapInArrow(hashed, "host string, path string, key long, lines binary, sizes binary, rules binary")
    rows = rows.dropDuplicates(["key"])
    ordered = cut(rows.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key"))
    ordered = ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("own"))
    counts = dict(ordered.groupBy("part").count().collect())  # a number for each partition
    before, so_far = [], 0
    for part in range(max(counts, default=-1) + 1):
        before.append((part, so_far))
        so_far += counts.get(part, 0)
    starts = pages.sparkSession.createDataFrame(before, "part int, before long")
    placed = ordered.join(F.broadcast(starts), "part").select("*", (F.col("before") + F.col("own")).alias("at"))
    groups = F.array_distinct(F.array(*[F.floor((F.col("at") + d) / GROUP) for d in (-REACH, 0, REACH)]))
    grouped = placed.select("host", "path", "key", "lines", "sizes", "rules", "at", F.explode(groups).alias("group"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        kinds = {"lines": np.uint64, "sizes": np.int32, "rules": np.int8}
        columns = [table[c].to_pylist() for c in ("host", "path")] + [[np.frombuffer(x, k).tolist() for x in table[c].to_pylist()] for c, k in kinds.items()]
        own_pages = [Page(*x) for x in zip(*columns)]
        group, found = table["group"][0].as_py(), []
        for i, (place, key) in enumerate(zip(table["at"].to_pylist(), table["key"].to_pylist())):
            gone = gone_lines(own_pages, i) if place // GROUP == group else []
            if gone:
                # Numbers among the candidates.
                number = np.cumsum(np.array(own_pages[i].rules) != OUT) - 1
                found.append((key, number[gone].tolist()))
        own, gone = zip(*found) if found else ((), ())
        return pa.table([pa.array(own, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])

    return grouped.groupBy("group").applyInArrow(compare, "key long, gone array<int>")


def extract_articles(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) for every row of ``pages`` (page_id, url, html): the main text.

    Markup is cut into blocks; those in menus, headers, footers, sidebars, notices, adverts, forms, scripts and comments go, and where the page has an article
    element or a main part, all outside it. The rest is compared with the pages of the same host whose paths are nearest, line by line, as a longest
    common subsequence; two pages that share nearly all text are one article twice and tell nothing. Without an article element, lines that one partner shares go; inside
    one, short lines but the title that all partners share. Character references are decoded, white space becomes one space, blocks are joined by an empty
    line. ``n_shared`` counts lines that went by comparison. A null or empty page has the text ''; a null or odd url has no partner; rows that repeat an id, an
    address or all of another row keep their rows; other columns are not read; an empty table gives none.
    """
    small_batches(pages.sparkSession)

    def lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                found = [candidates(page) for page in part.column("html").to_pylist()]
                yield pa.record_batch([part.column("page_id").cast(pa.int64()), part.column("url"), part.column("key"), pa.array(found, pa.list_(pa.string()))], ["page_id", "url", "key", "lines"])

    rows = parsed(pages).mapInArrow(lines, "page_id long, url string, key long, lines array<string>")
    found = rows.join(differences(pages), "key", "left")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)))
    shared = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    found = found.select("page_id", "url", F.array_join(kept, "\n\n").alias("text"), shared.alias("n_shared"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
