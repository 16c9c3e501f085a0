"""Main text of web pages: every page's lines are differenced against the page with the nearest URL.

A page is parsed into lines (the text of its blocks), each of a kind: in the article, in an element that by its name
is no part of one (navigation, footer, advert, comments ...), or open. The pages of a host are put in order of path
and query; each is aligned by longest common subsequence, over all its lines, with the different page before or
after it that shares more of the address, and shared lines are deleted. Lines of an article stay even if shared:
articles quote the same passages. Of what is left, lines in elements named so are dropped, and open lines too if one
of the page's articles is longer than they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealedspark.llm.common import cut, drop

# Elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Never text, and text of another kind than an article's.
SILENT = frozenset("script style noscript template svg math canvas iframe object head title button select textarea option audio video".split())
ASIDE = frozenset("nav footer aside form dialog menu".split())
# Elements that a new one of the same kind closes.
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
# Names of classes and ids: a token is split at - and _, and its first or last part counts.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertorial sponsor sponsored promo promotion banner sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "signup login share sharing social related recommended trending comment comments disqus replies respond pagination pager "
    "widget toolbar copyright disclaimer skip".split()
)
# First parts that say that a name is about the whole page or a topic.
ABOUT = frozenset("no has with without hide is category tag topic type layout page site post entry body".split())
TOPICS = frozenset("no has with without hide category tag topic type layout".split())
# Marks that a story may bear too; an element named so is text if it holds most of what is left of the page.
WEAK = frozenset("ad ads advert sponsor sponsored promo promotion banner cookie cookies consent notice alert overlay signup login share sharing social related recommended trending widget copyright disclaimer skip".split())
# Names of what an article stands in: an element that bears one beside a mark is none of the other parts.
STORY = frozenset("story article content entry post recipe text prose essay chapter".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Kinds of lines.
OPEN, OTHER, ARTICLE, MOST = 0, 1, 2, 255  # articles beyond the 254th count as one


def mark_of(names: str) -> str | None:
    """The part that a class or id names an element as, if that is no article: `nav` of `nav`, `footer` of `site-footer`,
    `comment` of `comment-list`; none of `no-sidebar`, `ad-free` or `cookies story`."""
    tokens = [[p for p in re.split(r"[-_]+", name) if p] for name in names.lower().split()]
    if any(len(t) == 1 and t[0] in STORY for t in tokens):
        return None
    for parts in tokens:
        if parts and parts[0] not in TOPICS and parts[-1] != "free":
            if parts[-1] in MARKS:
                return parts[-1]
            if parts[0] in MARKS and parts[0] not in ABOUT:
                return parts[0]
    return None


class _Parser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, tuple, int]] = []  # tag, silent, suspects, number of the article (0: none)
        self.lines: list[tuple[str, tuple, int]] = []
        self.articles = 0
        self.parts: list[str] = []
        self.size: list[int] = []  # text in each suspect
        self.holds: list[bool] = []  # whether a suspect holds an article
        self.weak: list[bool] = []  # whether only a name that a story may bear makes it one

    def top(self) -> tuple[str, bool, tuple, int]:
        return self.stack[-1] if self.stack else ("", False, (), 0)

    def flush(self) -> None:
        if self.parts:
            line = " ".join("".join(self.parts).split())
            self.parts = []
            if line:
                _, _, suspects, article = self.top()
                self.lines.append((line, suspects, article))
                for s in suspects:
                    self.size[s] += len(line)

    def close_to(self, tags, stop=()) -> None:
        """Close the innermost open element of `tags`, unless one of `stop` is open within it."""
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in tags:
                del self.stack[at:]
                return
            if self.stack[at][0] in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
            if tag != "br":
                self.close_to(("p",), BLOCK - {"p"})
        if tag in VOID:
            return
        if tag in SELF_CLOSING:
            self.close_to(SELF_CLOSING[tag], ("ul", "ol", "dl", "table"))
        a = {k: v or "" for k, v in attrs}
        starts = tag in ("article", "main") or a.get("role", "").lower() == "main" or a.get("itemprop") == "articleBody"
        if tag in ("article", "main"):
            self.close_to(("nav", "header", "footer", "aside", "menu"), ("article", "main"))  # left open
        _, silent, suspects, article = self.top()
        if starts:
            for s in suspects:
                self.holds[s] = True
        elif not silent and tag not in ("html", "body"):
            mark = mark_of(f"{a.get('class', '')} {a.get('id', '')}")
            firm = tag in ASIDE or (tag == "header" and not article) or a.get("role", "").lower() in ROLES
            if firm or mark:
                suspects = (*suspects, len(self.size))
                self.size.append(0)
                self.holds.append(False)
                self.weak.append(not firm and mark in WEAK)
        silent = silent or tag in SILENT or "hidden" in a or a.get("aria-hidden", "").lower() == "true"
        if starts and not article:
            self.articles += 1
            article = self.articles
        self.stack.append((tag, silent, suspects, article))

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.close_to((tag,))

    def handle_data(self, data):
        if not self.top()[1]:
            self.parts.append(data)


def _whole(html: str) -> str:
    """`html` without a comment or a tag that its end cuts off."""
    at = html.rfind("<!--")
    if at >= 0 and html.find("-->", at) < 0 and html.rfind("<script", 0, at) <= html.rfind("</script", 0, at):
        html = html[:at]
    at = html.rfind("<")
    return html[:at] if at > html.rfind(">") and re.match(r"</?[a-zA-Z!?]", html[at : at + 3]) else html


def lines(html: str | None) -> list[tuple[str, int]]:
    """The visible lines of a page, each with its kind: OPEN, OTHER, or the number of its article from ARTICLE on.

    An element that is named like no article counts as such only if it holds none; without any article on the page,
    only if it holds less than nine tenths of the text too: a whole page may stand in a form. There an element of a
    weak name (an advert, cookies) is text if half of the text outside other such elements or more is in it.
    """
    if not html:
        return []
    p = _Parser()
    p.feed(_whole(html))
    p.close()
    p.flush()
    total = sum(len(t) for t, _, _ in p.lines)
    firm = any(article and not suspects for _, suspects, article in p.lines)
    other = [not h and (firm or 10 * n < 9 * total) for h, n in zip(p.holds, p.size, strict=True)]
    if not firm and any(p.weak):
        strong = [o and not w for o, w in zip(other, p.weak, strict=True)]
        left = sum(len(t) for t, suspects, _ in p.lines if not any(strong[s] for s in suspects))
        other = [o and not (w and 2 * n >= left) for o, w, n in zip(other, p.weak, p.size, strict=True)]
    return [(t, OTHER if any(other[s] for s in suspects) else OPEN if not article else min(article + ARTICLE - 1, MOST)) for t, suspects, article in p.lines]


def kept(kinds: list[int], sizes: list[int], shared: list[bool]) -> list[bool]:
    """Which lines are the main text, given which of them the nearest page shares.

    Open lines are text beside articles if there are more of them than of the largest article: it may be a teaser. Of
    three articles and more, each less than half as long as the open text, all are teasers, and only the open text stays.
    """
    size: dict[int, int] = {}
    for k, n in zip(kinds, sizes, strict=True):
        if k >= ARTICLE:
            size[k] = size.get(k, 0) + n
    largest = max(size.values(), default=0)
    open_ = sum(n for k, n, s in zip(kinds, sizes, shared, strict=True) if k == OPEN and not s)
    teasers = len(size) > 2 and 2 * largest < open_
    return [(k >= ARTICLE and not teasers) or (k == OPEN and not s and open_ > largest) for k, s in zip(kinds, shared, strict=True)]


MOST_BITS = 1 << 28  # of the rows that one alignment keeps, 32 MB


def common(a: list, b: list) -> list[bool]:
    """Which elements of `a` are in a longest common subsequence with `b` (bit-parallel, rows kept as integers)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return [True] * head + _common(a[head : len(a) - tail], b[head : len(b) - tail]) + [True] * tail


def _lengths(a: list, b: list) -> np.ndarray:
    """The length of a longest common subsequence of `a` with each prefix of `b`, the empty one first."""
    full = (1 << len(b)) - 1
    at: dict = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    v = full
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _common(a: list, b: list) -> list[bool]:
    if len(a) > 1 and len(a) * len(b) > MOST_BITS:  # halves of a, each with its part of b: linear memory
        mid = len(a) // 2
        j = int((_lengths(a[:mid], b) + _lengths(a[:mid - 1 : -1], b[::-1])[::-1]).argmax())
        return _common(a[:mid], b[:j]) + _common(a[mid:], b[j:])
    full = (1 << len(b)) - 1
    at: dict = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    rows, v = [], full
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, j = [False] * len(a), len(b)
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count() if i >= 0 else 0
    i = len(a) - 1
    while i >= 0 and j > 0:
        here = length(i, j)
        if length(i - 1, j) == here:
            i -= 1
        elif length(i, j - 1) == here:
            j -= 1
        else:
            out[i] = True
            i, j = i - 1, j - 1
    return out


def address(url: str | None) -> tuple[str, str]:
    """Host, and path with query, of a URL; empty if it cannot be read."""
    try:
        u = urlsplit((url or "").strip())
        return (u.hostname or ""), u.path + ("?" + u.query if u.query else "")
    except ValueError:
        return "", ""


def _prints(found: list[tuple[str, int]]) -> list[int]:
    return [xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for t, _ in found]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What differencing needs of a page; its text is not kept."""
    for batch in batches:
        hosts, paths, prints, marks, kinds, sizes = [], [], [], [], [], []
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            h, p = address(url)
            found = lines(html)
            hosts.append(h)
            paths.append(p)
            prints.append(_prints(found))
            marks.append(xxhash.xxh64_intdigest(np.array(prints[-1], np.int64).tobytes()) - (1 << 63))
            kinds.append(bytes(k for _, k in found))
            sizes.append([len(t) for t, _ in found])
        cols = [batch.column("key"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(prints, pa.list_(pa.int64())),
                pa.array(marks, pa.int64()), pa.array(kinds, pa.binary()), pa.array(sizes, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(cols, names=["key", "host", "path", "prints", "mark", "kinds", "sizes"])


def _alike(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def against(mine: list, near: list[list]) -> list[bool]:
    """Which lines a page shares with the first of `near`, or with the second if the first is a version of the page.

    A version of a page shares all but a twentieth of its lines. If the only neighbour is one, nothing tells the
    article from the rest; if both are, what they share is no one's article.
    """
    found = []
    for other in near:
        shared = common(mine, other)
        if 20 * (len(mine) - sum(shared)) > len(mine):
            return shared
        found.append(shared)
    return found[0] if len(found) > 1 else [False] * len(mine)


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, mark, shared: which lines of a page are in its nearest page too, as bytes of 0 and 1."""
    for batch in batches:
        out = []
        for own, before, after in zip(*(batch.column(c).to_pylist() for c in ("own", "before", "after")), strict=True):
            near = [x for x in (before, after) if x is not None and x["host"] == own["host"]]
            near.sort(key=lambda x: -_alike(x["path"], own["path"]))
            out.append(bytes(against(own["prints"], [x["prints"] for x in near])))
        own = batch.column("own")
        cols = [own.field("host"), own.field("mark"), pa.array(out, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["host", "mark", "shared"])


def _open_left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and shared of the pages whose main text the differencing changes."""
    for batch in batches:
        change = []
        for kinds, sizes, shared in zip(*(batch.column(c).to_pylist() for c in ("kinds", "sizes", "shared")), strict=True):
            kinds, shared = list(kinds), [bool(x) for x in shared]
            change.append(kept(kinds, sizes, shared) != kept(kinds, sizes, [False] * len(kinds)))
        yield batch.select(["key", "shared"]).filter(pa.array(change, pa.bool_()))


def nearest(parsed: DataFrame) -> DataFrame:
    """host, mark, shared for the pages of `parsed`, one row for those with equal lines.

    Pages of one host with equal lines are one page, at the smallest of their addresses; so a neighbour always
    differs. The order of host and address is dealt out by range, so a host with many pages is spread; the pages
    at the ends of two ranges are passed on beside each other.
    """
    pages = parsed.where("host <> '' AND size(prints) > 0").groupBy("host", "mark").agg(F.min("path").alias("path"), F.min("prints").alias("prints"))
    order = ["own.host", "own.path", "own.mark"]
    own = pages.select(F.struct("host", "path", "mark", "prints").alias("own"))
    dealt = cut(own.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    by = Window.partitionBy("part").orderBy(*order)
    beside = dealt.select("part", "own", F.lag("own").over(by).alias("before"), F.lead("own").over(by).alias("after"))
    # ends of the ranges: one row per range, so their window is over a table of as many rows as partitions
    ends = dealt.groupBy("part").agg(F.min("own").alias("lo"), F.max("own").alias("hi"))
    along = Window.orderBy("part")
    ends = cut(ends.select("part", F.lag("hi").over(along).alias("hi_before"), F.lead("lo").over(along).alias("lo_after")))
    beside = beside.join(F.broadcast(ends), "part")  # as many rows as partitions
    beside = beside.select("own", F.coalesce("before", "hi_before").alias("before"), F.coalesce("after", "lo_after").alias("after"))
    out = cut(beside.mapInArrow(_difference, "host string, mark long, shared binary"))
    drop(dealt, ends)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html; other columns are ignored).

    A null, empty or article-less html has an empty text. Repeated rows and null ids give a row each; repeated rows
    fare alike. Pages without a readable host, and the only page of a host, are compared with none. Only pages whose
    text the differencing changes are shuffled; parsed pages are kept without their texts.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64("url", "html").alias("key"))
    parsed = cut(src.select("url", "html", "key").mapInArrow(_parse, "key long, host string, path string, prints array<long>, mark long, kinds binary, sizes array<int>"))
    shared = nearest(parsed)
    each = parsed.select("key", "host", "mark", "kinds", "sizes").join(shared, ["host", "mark"])
    changed = cut(each.mapInArrow(_open_left, "key long, shared binary").groupBy("key").agg(F.min("shared").alias("shared")))
    drop(parsed, shared)
    return src.join(changed, "key", "left").select("page_id", "url", "html", "shared").mapInArrow(_join, "page_id long, url string, text string, n_chars long")


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for html, shared in zip(batch.column("html").to_pylist(), batch.column("shared").to_pylist(), strict=True):
            found = lines(html)
            kinds, sizes = [k for _, k in found], [len(t) for t, _ in found]
            keep = kept(kinds, sizes, [bool(x) for x in shared] if shared is not None else [False] * len(found))
            out.append("\n".join(t for (t, _), k in zip(found, keep, strict=True) if k))
        cols = [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])
