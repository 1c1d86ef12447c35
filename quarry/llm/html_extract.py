"""Main text of web pages by nearest-URL page differencing (operator 1).

Each page's HTML becomes blocks of text (lines), each marked as page furniture (by its element, or by a class, id or role
that says so), as part of an article, or as neither. Pages are put in order of host and URL path; each is paired with the
neighbour of its host whose path shares the longest prefix. The lines of every pair are aligned by a longest common
subsequence and the shared ones deleted; but a paragraph, heading or the like inside an article is the page's text even
where a neighbour has it too (a quotation, a notice all articles carry), and a page that shares every line is a copy of its
neighbour and keeps them all.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator
from itertools import takewhile
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_schema, scattered

# Elements of HTML that hold no text of the page, page furniture, and elements that begin a block.
SILENT = "script style noscript template head iframe object svg math canvas audio video select textarea title".split()
FURNITURE = "nav header footer aside form button menu dialog fieldset".split()
BLOCKS = "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
# Words that mark furniture when they are a part of a class or id, or a role.
MARKS = "ad ads advert adverts advertisement banner banners breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related respond replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split()
ROLES = "navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split()

# Elements whose text is prose, not a list of links or a box.
PROSE = "p h1 h2 h3 h4 h5 h6 blockquote pre dd dt td th li figcaption caption address article main".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()

_SILENT, _FURNITURE, _BLOCKS, _VOID, _MARKS, _ROLES, _PROSE, _HEADINGS = map(frozenset, (SILENT, FURNITURE, BLOCKS, VOID, MARKS, ROLES, PROSE, HEADINGS))
TAG = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^<>]*>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: OTHER: neither article nor furniture; ARTICLE: prose of an article; BOXED: of an article, but no prose; FURNISHED.
OTHER, ARTICLE, BOXED, FURNISHED = 0, 1, 2, 3


def _marked(attributes: str) -> tuple[bool, bool]:
    """Whether a role, class or id says furniture, and whether one says the body of an article.

    A class or id says so if it is a word of MARKS, or a compound that ends or begins with one (`site-header`,
    `commentList`); not if it says what a layout has or lacks (`no-sidebar`, `has-menu`, `search-open`).
    """
    furniture = body = False
    for name, *value in _ATTRIBUTE.findall(attributes):
        value, name = "".join(value), name.lower()
        if name == "role":
            furniture |= value.strip().lower() in _ROLES
        else:
            for token in value.split():
                parts = [x.lower() for x in _PARTS.findall(token)]
                body |= "".join(parts) == "articlebody"
                if name != "itemprop" and parts and parts[0] not in _STATES and parts[-1] not in _STATES:
                    furniture |= parts[0] in _MARKS or parts[-1] in _MARKS
    return furniture, body


# Words that begin or end a class that describes a state of a layout.
_STATES = frozenset("no has is with without not open opened closed enabled disabled active".split())
#: Elements that are never a layout's wrapper.
_NO_WRAPPERS = frozenset("nav footer aside menu dialog button".split())


class _Element:
    """An open or closed element: its name, the one around it, whether it is marked as furniture, or is an article."""

    __slots__ = ("name", "around", "marked", "article", "inside")

    def __init__(self, name: str, around: _Element | None, marked: bool, article: bool):
        self.name, self.around, self.marked, self.article = name, around, marked, article
        self.inside = article or (around is not None and around.inside)  # an article, or within one

    def chain(self) -> Iterator[_Element]:
        x: _Element | None = self
        while x is not None:
            yield x
            x = x.around


def _blocks_of(source: str) -> tuple[list[tuple[_Element, bool, str]], list[_Element]]:
    """(innermost block element, whether all its text lies in links, text) of each block; and all elements."""
    root = _Element("", None, False, False)
    stack, every, out = [root], [root], []
    held: list[str] = []
    free, at = False, 0  # free: some held text lies outside links

    def close_block():
        nonlocal free
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                own = next((x for x in reversed(stack) if x.name in _BLOCKS or x.marked), root)
                out.append((own, not free, text))
            free = False

    def hold(text: str):
        nonlocal free
        held.append(text)
        free = free or (not text.isspace() and all(x.name != "a" for x in stack))

    while m := TAG.search(source, at):
        if m.start() > at:
            hold(source[at : m.start()])
        at, name = m.end(), m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in _BLOCKS:
                close_block()
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            if k:
                if any(x.marked for x in stack[k:]):
                    close_block()
                del stack[k:]
            continue
        if name in _SILENT:
            if not m[3].endswith("/"):
                end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(source, at)
                if end:
                    at = end.end()
                elif name == "head":  # an unclosed head ends at the body
                    body = re.compile("<body", re.I).search(source, at)
                    at = body.start() if body else at
                else:
                    at = len(source)
            if name not in ("object", "math", "svg"):
                held.append(" ")
            continue
        if name in _BLOCKS:
            close_block()
            if name == "p" and stack[-1].name == "p":  # a paragraph ends the one before it
                stack.pop()
        elif name == "br":
            held.append(" ")
        if name in _VOID or m[3].endswith("/"):
            continue
        around = stack[-1]
        marked, body = _marked(m[3]) if m[3] else (False, False)
        marked = name not in ("body", "html") and name not in _HEADINGS and (marked or name in _FURNITURE)
        if name == "header" and around.inside:  # an article's own header, with its title
            marked = False
        if marked and name not in _BLOCKS:
            close_block()
        stack.append(_Element(name, around, marked, name in ("article", "main") or body))
        every.append(stack[-1])
    if at < len(source):
        hold(source[at:])
    close_block()
    return out, every


def lines_of(source: str | None) -> list[tuple[int, str]]:
    """(kind, text) of each non-empty block, in page order.

    Comments, scripts and the like are skipped whole; an element that is never closed ends with the element around it; a
    block's white space is one space. Character references are decoded in text only. Classes, ids, roles, forms and headers
    do not count on wrappers: those around a first-level heading within an article; and, where no article (else no such
    heading) is free of furniture around it, those around an article that is not itself marked (else around a heading).
    """
    if not source:
        return []
    found, every = _blocks_of(source)
    clear = [x for x in every if not any(y.name in _NO_WRAPPERS for y in x.chain())]
    articles, titles = [x for x in clear if x.article and not x.marked], [x for x in clear if x.name == "h1"]
    for x in titles:
        if x.inside:
            for y in takewhile(lambda y: not y.article, x.chain()):
                y.marked = False
    wanted = articles or titles
    if all(any(y.marked for y in x.chain()) for x in wanted):
        for x in wanted:
            for y in x.chain():
                y.marked = False
    out = []
    for own, linked, text in found:
        chain = list(own.chain())
        if any(x.marked for x in chain):
            kind = FURNISHED
        elif own.inside:
            kind = ARTICLE if own.name in _PROSE and not (linked and own.name not in _HEADINGS) else BOXED
        else:
            kind = OTHER
        out.append((kind, text))
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Lower-case host without `www.`, and the path without query and fragment."""
    rest = (url or "").split("://", 1)[-1]
    rest = rest.split("#", 1)[0].split("?", 1)[0]
    host, _, path = rest.partition("/")
    return host.lower().removeprefix("www."), path.strip("/")


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places of `a` on a longest common subsequence with `b`."""
    n, m, start = len(a), len(b), 0
    while start < n and start < m and a[start] == b[start]:
        start += 1
    while n > start and m > start and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    common = {*range(start), *range(n, len(a))}
    also = set(b[start:m])
    mine = [i for i in range(start, n) if a[i] in also]
    also = {a[i] for i in mine}
    theirs = [x for x in b[start:m] if x in also]
    if not mine:
        return common
    places: dict[str, list[int]] = {}
    for j, x in enumerate(theirs):
        places.setdefault(x, []).append(j)
    # Hunt and Szymanski: the longest strictly increasing run of places, each line's places tried from the last
    tails: list[int] = []
    ends: list[tuple] = []
    for i in mine:
        for j in reversed(places[a[i]]):
            k = bisect.bisect_left(tails, j)
            node = (i, ends[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                ends.append(node)
            elif j < tails[k]:
                tails[k], ends[k] = j, node
    node = ends[-1]
    while node:
        common.add(node[0])
        node = node[1]
    return common


class Page(NamedTuple):
    page_id: int | None
    url: str | None
    lines: list[str]
    kinds: list[int]


def _near(a: str, b: str) -> tuple[int, int]:
    """How near two paths are: equal leading parts, then equal leading characters."""
    x, y = a.split("/"), b.split("/")
    parts = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    chars = next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    return parts, chars


def main_text(page: Page, other: Page | None) -> str:
    """The page's own lines: of its articles if it has any, else all that are no furniture; without those it shares with
    the other page, but for the prose of articles. A page without a line of its own is a copy and keeps them."""
    article = any(k in (ARTICLE, BOXED) for k in page.kinds)
    own = [i for i, k in enumerate(page.kinds) if (k in (ARTICLE, BOXED) if article else k == OTHER)]
    if other is not None:
        shared = shared_lines(page.lines, other.lines)
        if not all(i in shared for i in own):
            own = [i for i in own if i not in shared or page.kinds[i] == ARTICLE]
    return "\n".join(page.lines[i] for i in own)


Key = tuple[str, str, bool, int]


def key_of(url: str | None, page_id: int | None) -> Key:
    """The order of pages: host, path, then id, a null id first."""
    return *split_url(url), page_id is not None, page_id or 0


def _parts(pages: DataFrame, each: int = 32 << 20, most: int = 50_000) -> int:
    """As many parts as the shuffles of the session have, or one for every `each` bytes of the input, up to `most`."""
    size = int(str(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # else the input does not say its size
    return min(most, max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // each)))


def _bounds(pages: DataFrame, parts: int, each: int = 20) -> list[Key]:
    """Sort keys that divide the pages into about equal parts, from a sample of at most `each` times `parts` keys. The
    bounds only balance the work: results are the same wherever they lie."""
    n = pages.count()
    want = parts * each
    share = min(1.0, 2.0 * want / max(n, 1))
    some = pages.select("url", "page_id").sample(share, seed=7) if share < 1 else pages.select("url", "page_id")
    keys = sorted(key_of(*r) for r in some.limit(3 * want).collect())
    return [keys[k * len(keys) // parts] for k in range(1, parts)] if len(keys) > parts else []


def extract(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row.

    Null or empty html: empty text. A null url is a host of its own name. Ties in host and path go by page_id (null first,
    negative ones before positive), then url. Pages of one host may lie in many parts: each part also gets the page right
    before and the page right after it, so a page's neighbours do not depend on the parts. Repeated rows are pages each.
    Very long pages are taken whole. Other columns are ignored. An empty table gives no rows.
    """
    pages = scattered(pages, "page_id", "url", "html")
    parts = parts or _parts(pages)
    bounds = _bounds(pages, parts)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, Key] = {}
        high: dict[int, Key] = {}
        for batch in batches:
            for i, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = key_of(u, i)
                p = bisect.bisect_right(bounds, key)
                low[p] = min(low.get(p, key), key)
                high[p] = max(high.get(p, key), key)
        rows = [{"part": p, "host": k[0], "path": k[1], "has": k[2], "id": k[3], "high": side} for side, of in ((False, low), (True, high)) for p, k in of.items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=edge_schema)

    edge = "part int, host string, path string, has boolean, id long, high boolean"
    edge_schema = arrow_schema(edge)
    found = pages.select("page_id", "url").mapInArrow(edges, edge)
    key = F.struct("host", "path", "has", "id")
    ends = found.groupBy("part").agg(F.min(F.when(~F.col("high"), key)).alias("low"), F.max(F.when(F.col("high"), key)).alias("high")).collect() if bounds else []  # a row for each part
    ends = sorted((r["part"], tuple(r["low"]), tuple(r["high"])) for r in ends)
    # the last page of a part is also sent to the next part that has pages, the first to the one before
    also: dict[tuple, set[int]] = {}
    for (p, _, high), (q, low, _) in zip(ends, ends[1:]):
        if high[0] == low[0]:
            also.setdefault(high, set()).add(q)
            also.setdefault(low, set()).add(p)

    schema = "part int, host string, path string, page_id long, url string, lines array<string>, kinds array<tinyint>, guest boolean"
    arrow = arrow_schema(schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), 500):
                rows = []
                for i, u, source in zip(ids[at : at + 500], urls[at : at + 500], batch.column(2)[at : at + 500]):
                    lines = lines_of(source.as_py())
                    k = key_of(u, i)
                    own = (k[0], k[1], i, u, [x for _, x in lines], [x for x, _ in lines])
                    rows.append((bisect.bisect_right(bounds, k), *own, False))
                    rows += [(p, *own, True) for p in also.get(k, ())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages in order; each is settled once the one after it is known."""
        out: list[tuple] = []
        before = here = None

        def settle(after):
            nonlocal out
            if here is None or here[5]:
                return
            near = [x for x in (before, after) if x is not None and x[:2] == here[:2]]
            near = max(near, key=lambda x: _near(here[2], x[2])) if near else None  # of equals the one before
            page = Page(here[3], here[4][0], here[4][1], here[4][2])
            text = main_text(page, Page(near[3], *near[4]) if near else None)
            out.append((page.page_id, page.url, text, len(text)))

        for batch in batches:
            part, host, path, ids, urls, lines, kinds, guest = (c.to_pylist() for c in batch.columns)
            for k in range(len(ids)):
                row = (part[k], host[k], path[k], ids[k], (urls[k], lines[k], kinds[k]), guest[k])
                settle(row)
                before, here = here, row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out), result)], schema=result)
                out = []
        settle(None)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out), result)], schema=result)

    returns = "page_id long, url string, text string, n_chars long"
    result = arrow_schema(returns)
    rows = pages.mapInArrow(parse, schema)
    # one part is one task, whatever the parts hash to
    ordered = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "host", "path", "page_id", "url")
    return ordered.mapInArrow(difference, returns)
