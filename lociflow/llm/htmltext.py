"""Main text of web pages by nearest-URL page differencing.

Every page is cut into lines, one per block.  Pages are put in order of host and URL path, and each is aligned
by longest common subsequence with the nearest page of the same host that has another longest line, so that
copies of one article don't take it from each other; shared lines are the site's template and go, inside
articles only if at least two, and three quarters, of the nearest eight such pages (or of as many as there are) have them in the same order.  Where all pages near by have the same longest
line, the nearest that differs at all is taken, and lines of an article element that aren't links stay.  What markup names as no part of the text (menus, forms,
adverts, comments and the like) goes as well, unless it holds an article, or most of the text of a page without one; a name that is
only part of a longer one, and inside an article any but those of adverts and readers' comments, must be confirmed by links, or its lines by the comparison.
"""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, range_bounds, range_number, shuffle_partitions

#: Distinct pages of a host, on either side, among which the nearest with another article is looked for.
WINDOW = 16
#: Pages with other articles that are asked whether a line of an article is the site's; how many must have it at least, and what percentage of those there are.
WITNESSES, LEAST_WITNESSES, SHARE = 8, 2, 75

#: Element names of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("nav footer aside script style noscript template head title svg math iframe object button select textarea dialog menu canvas audio video datalist search".split())
#: Elements that may stand in a head; any other closes one left open.
HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())
#: Elements that markup or names only propose to drop.
PROPOSED = frozenset("header form".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that name what is no part of an article.
WORDS = (
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|sidebar|side-?bar|rail|widget|menu|nav\w*|breadcrumbs?|toc|pagination|pager|"
    r"header|masthead|footer|foot|comments?|comment-?list|commentlist|disqus|replies|responses|discussion|related|recommended|share|sharing|social|toolbar|skip|complementary|contentinfo|search|form)")  # fmt: skip
#: Those that count inside an article too, where the others may name a part of it.
OF_OTHERS = re.compile(r"(?:^|\s)(?:ads?|advert\w*|adsense|sponsor\w*|comments?|comment-?list|commentlist|disqus|replies)(?:$|\s)", re.I)
#: A whole name, as class="sidebar", and a part of one, as class="no-sidebar".
NAMED, PART_NAMED = re.compile(rf"(?:^|\s){WORDS}(?:$|\s)", re.I), re.compile(rf"(?:^|[\s_-]){WORDS}(?:$|[\s_-])", re.I)


class _Part:
    """An element that is proposed for removal."""

    def __init__(self, sure: bool, own_header: bool) -> None:
        self.sure, self.holds_article = sure, own_header
        self.chars = self.link_chars = 0

    def removed(self, page_chars: int, articles: bool) -> bool:
        """Never if it holds an article, or most of the text of a page without one; on a part of a name alone, if it is mostly links."""
        if self.holds_article or 2 * self.chars > page_chars and not (self.sure and articles):
            return False
        return self.sure or 2 * self.link_chars > self.chars


class _Lines(HTMLParser):
    """Lines of a page as (text, in an article, only links, the proposed elements around it)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, _Part | None]] = []
        self.dropped = self.articles = self.mains = self.links = 0
        self.parts: list[str] = []
        self.linked: list[bool] = []
        self.around: list[_Part] = []
        self.lines: list[tuple[str, int, bool, tuple[_Part, ...]]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, 2 if self.articles else 1 if self.mains else 0, all(self.linked), tuple(self.around)))
        self.parts, self.linked = [], []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag == "p" and any(x[0] == "p" for x in self.stack[-3:]):
            self.close("p")
        if tag not in HEAD and any(x[0] == "head" for x in self.stack):  # an end tag left out
            self.close("head")
        names = [v for k, v in attrs if k in ("class", "id", "role") and v]
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none", v) for k, v in attrs)
        part = None
        if tag in ("article", "main"):
            for x in self.around:
                x.holds_article = True
        elif tag not in ("html", "body"):
            sure = tag in PROPOSED or any((OF_OTHERS if self.articles else NAMED).search(x) for x in names)
            if sure or any(PART_NAMED.search(x) for x in names):
                if self.parts:
                    self.flush()
                part = _Part(sure, tag == "header" and self.articles > 0)
                self.around.append(part)
        self.stack.append((tag, tag in DROPPED or hidden, part))
        self.count(tag, self.stack[-1][1], 1)

    def count(self, tag: str, drop: bool, by: int) -> None:
        self.dropped += by * drop
        self.articles += by * (tag == "article")
        self.mains += by * (tag == "main")
        self.links += by * (tag == "a")

    def close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                for t, d, part in reversed(self.stack[i:]):
                    if part:
                        self.flush()
                        self.around.pop()
                    self.count(t, d, -1)
                del self.stack[i:]
                return
            if self.stack[i][0] in ("article", "main", "body", "nav", "aside", "footer", "table") and tag not in ("article", "main", "body", "html"):
                return

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.close(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.close(tag)

    def handle_data(self, data: str) -> None:
        if self.dropped and data.strip() and self.stack[-1][0] == "head":  # text ends a head left open
            self.close("head")
        if not self.dropped:
            self.parts.append(data)
            size = len(data.strip())
            if size:
                self.linked.append(self.links > 0)
                for x in self.around:
                    x.chars += size
                    x.link_chars += size * (self.links > 0)


def lines(html: str | None) -> list[tuple[str, int, bool]]:
    reader = _Lines()
    reader.feed(html or "")
    HTMLParser.close(reader)
    reader.flush()
    chars, articles = sum(len(x[0]) for x in reader.lines), any(x[1] == 2 for x in reader.lines)
    gone = {id(p) for x in reader.lines for p in x[3] if p.removed(chars, articles)}
    return [x[:3] for x in reader.lines if not any(id(p) in gone for p in x[3])]


def main_part(found: list[tuple[str, int, bool]]) -> list[tuple[str, int, bool]]:
    """The lines in articles, else those in main, where they hold a third of the text that isn't links; else all."""
    size = lambda part: sum(len(t) for t, p, links in found if p >= part and not links)
    part = next((p for p in (2, 1) if 3 * size(p) >= size(0) and any(x[1] >= p for x in found)), 0)
    return [x for x in found if x[1] >= part]


#: Bytes of the alignment's table that a task may hold; larger ones are cut in halves first.
TABLE_BYTES = 16 << 20


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of one longest common subsequence with ``b``; only lines that both have are aligned."""
    in_a, in_b = set(a), set(b)
    ia, ib = [i for i, x in enumerate(a) if x in in_b], [x for x in b if x in in_a]
    found, lo = set(), 0
    while lo < min(len(ia), len(ib)) and a[ia[lo]] == ib[lo]:
        found.add(ia[lo])
        lo += 1
    ia, ib = ia[lo:], ib[lo:]
    while ia and ib and a[ia[-1]] == ib[-1]:
        found.add(ia.pop())
        ib.pop()
    return found | {ia[i] for i in _aligned([a[i] for i in ia], ib)}


def _rows(x: list[str], y: list[str]) -> Iterator[int]:
    """The alignment's table, a row for each line of ``x``: bit j is 0 where the common length grows from j to j + 1 lines of ``y``."""
    masks: dict[str, int] = collections.defaultdict(int)
    for j, line in enumerate(y):
        masks[line] |= 1 << j
    full = (1 << len(y)) - 1
    row = full
    for line in x:
        same = row & masks.get(line, 0)
        row = (row + same | row - same) & full
        yield row


def _lengths(x: list[str], y: list[str]) -> np.ndarray:
    """Common length of ``x`` with the first j lines of ``y``, for each j."""
    row = (1 << len(y)) - 1
    for row in _rows(x, y):  # the last one  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _aligned(x: list[str], y: list[str]) -> list[int]:
    """Places in ``x`` of one longest common subsequence with ``y``, in memory linear in both: a large table is never held."""
    if not x or not y:
        return []
    if len(x) > 1 and len(x) * len(y) // 8 > TABLE_BYTES:
        mid = len(x) // 2
        best = int(np.argmax(_lengths(x[:mid], y) + _lengths(x[mid:][::-1], y[::-1])[::-1]))
        return _aligned(x[:mid], y[:best]) + [mid + i for i in _aligned(x[mid:], y[best:])]
    table, found = list(_rows(x, y)), []
    i, j = len(x), len(y)
    while i and j:
        if table[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or table[i - 1] >> (j - 1) & 1:
                found.append(i)
                j -= 1
    return found[::-1]


def template_lines(page: list[tuple], others: list[list[tuple]], same: bool = False) -> set[int]:
    """Places of the page's lines that comparison takes.

    Outside articles, and where a line is only links, those aligned with the nearest other page.  A line of an article goes if it is aligned with at
    least ``LEAST_WITNESSES`` of the other pages, and with ``SHARE`` percent of them; where they may hold the same article (``same``) it stays.
    """
    if not others:
        return set()
    text = [x[0] for x in page]
    drop = {i for i in common_lines(text, [x[0] for x in others[0]]) if page[i][1] < 2 or page[i][2]}
    need = max(LEAST_WITNESSES, -(-SHARE * len(others) // 100))
    if same or need > len(others):
        return drop
    on = collections.Counter(t for o in others for t in {x[0] for x in o})
    asked = [i for i, x in enumerate(page) if x[1] == 2 and not x[2] and on[x[0]] >= need]
    if asked:
        aligned = collections.Counter(i for o in others for i in common_lines(text, [x[0] for x in o]))
        drop |= {i for i in asked if aligned[i] >= need}
    return drop


def main_text(page: list[tuple], others: list[list[tuple]], same: bool = False) -> str:
    """The page's lines but for its template_lines()."""
    drop = template_lines(page, others, same)
    return "\n".join(x[0] for x in main_part([x for i, x in enumerate(page) if i not in drop]))


class _Page:
    def __init__(self, html: str | None) -> None:
        self.lines = lines(html)
        self.digest = hashlib.blake2b("\n".join(x[0] for x in self.lines).encode("utf-8", "surrogatepass"), digest_size=16).digest()
        self.lead = max((x[0] for x in self.lines if not x[2]), key=len, default="")


class _Waiting:
    """Rows of one line sequence that wait for further pages of the host."""

    def __init__(self, page: _Page, before: list[_Page]) -> None:
        self.page, self.rows, self.passed = page, [], set()
        self.others: dict[str, _Page] = {}
        self.near: _Page | None = None
        for x in before:
            self.meet(x)

    def meet(self, other: _Page) -> None:
        if other.digest != self.page.digest:
            self.near = self.near or other
            if other.lead != self.page.lead and len(self.others) < WITNESSES:
                self.others.setdefault(other.lead, other)

    def texts(self) -> list[tuple]:
        others = list(self.others.values()) or [self.near] * (self.near is not None)
        text = main_text(self.page.lines, [x.lines for x in others], not self.others)
        return [(*r, text) for r in self.rows]


def _host_texts(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(page_id, url, text) of a host's own rows, which come in order as (page_id, url, html, own)."""
    seen: dict[bytes, _Page] = {}
    waiting: list[_Waiting] = []
    for page_id, url, html, own in rows:
        page = _Page(html)
        if not page.lines:
            if own:
                yield page_id, url, ""
            continue
        left = []
        for w in waiting:
            w.meet(page)
            w.passed.add(page.digest)
            if len(w.others) >= WITNESSES or len(w.passed - {w.page.digest}) >= WINDOW:
                yield from w.texts()
            else:
                left.append(w)
        waiting = left
        if own:
            if not waiting or waiting[-1].page.digest != page.digest:
                waiting.append(_Waiting(page, list(reversed(seen.values()))))
            waiting[-1].rows.append((page_id, url))
            if len(waiting[-1].others) >= WITNESSES:
                yield from waiting.pop().texts()
        seen.pop(page.digest, None)
        seen[page.digest] = page
        if len(seen) > WINDOW:
            del seen[next(iter(seen))]
    for w in waiting:
        yield from w.texts()


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, host and path."""

    kind = None

    def pages():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("page_id").type
            yield from zip(*(batch.column(c).to_pylist() for c in ("bucket", "host", "page_id", "url", "html", "own")), strict=True)

    def batch(rows):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["page_id", "url", "text"])

    rows, size = [], 0
    for _, run in itertools.groupby(pages(), key=lambda r: r[:2]):
        for row in _host_texts(r[2:] for r in run):
            rows.append(row)
            size += len(row[2])
            if size > 8_000_000 or len(rows) >= 5000:
                yield batch(rows)
                rows, size = [], 0
    if rows:
        yield batch(rows)


def _carried(ends: list[dict]) -> list[tuple]:
    """(host, path, page_id, digest, to): which rows near a range's border are shown to the ranges beside it."""
    ranges: dict[int, list[dict]] = {}
    for r in ends:
        ranges.setdefault(r["bucket"], []).append(r)
    order, out = sorted(ranges), []
    for step, nth, edge, ways in ((-1, "from_end", "from_start", order), (1, "from_start", "from_end", order[::-1])):
        at = {b: i for i, b in enumerate(ways)}
        for b in ways:
            host = min(ranges[b], key=lambda r: r[edge])["host"]
            found: dict[int, dict] = {}
            for c in ways[: at[b]][::-1]:
                near = sorted((r for r in ranges[c] if r[nth] <= WINDOW), key=lambda r: r[nth])
                for r in itertools.takewhile(lambda r: r["host"] == host, near):
                    if len(found) < WINDOW:
                        found.setdefault(r["digest"], r)
                if len(found) >= WINDOW or not near or near[-1]["host"] != host:
                    break
            out += [(r["host"], *((r["last"] if step < 0 else r["first"])[k] for k in ("path", "page_id")), r["digest"], b) for r in found.values()]
    return out


def extract(df: DataFrame, n_ranges: int | None = None, range_bytes: int = 8 << 20) -> DataFrame:
    """page_id, url, text: the main text of every row's html, '' where there is none.

    A null html counts as empty.  Pages without a URL share the host ''.  Equal URLs follow each other by
    page_id, which may be null or repeat; a row that repeats gets its text each time.  Other columns are ignored, an
    empty table gives no rows, and of very long pages a task holds the ones it compares.  Hosts are ranged by URL, with
    about equal bytes, so that a large host is split; a range is shown the ``WINDOW`` nearest distinct pages of the same
    host on either side.  Only keys of a sample and of rows at borders pass through the driver.
    """
    spark = df.sparkSession
    rows = pick(df, "page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce("url", F.lit("")), "^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    placed = rows.withColumns({"host": host, "path": path, "digest": F.xxhash64("html")})
    size = F.octet_length(F.coalesce("html", F.lit(""))) + 64
    total = placed.agg(F.sum(size)).first()[0] or 0
    n = n_ranges or max(shuffle_partitions(spark), math.ceil(total / range_bytes))
    place = ["host", "path", "page_id"]
    bounds = range_bounds(placed.withColumn("size", size), place, n, "size", total)
    n = len(bounds) + 1
    dealt = placed.withColumn("bucket", range_number(bounds, place))
    shown = dealt.withColumn("own", F.lit(True))
    if bounds:
        place = F.struct("path", "page_id")
        distinct = dealt.groupBy("bucket", "host", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        nth = {"from_start": F.row_number().over(Window.partitionBy("bucket").orderBy("host", "first", "digest")), "from_end": F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("host"), F.desc("last"), "digest"))}
        ends = [r.asDict() for r in distinct.withColumns(nth).where(f"from_start <= {WINDOW} or from_end <= {WINDOW}").collect()]
        carried = _carried(ends)
        if carried:
            to = spark.createDataFrame(carried, f"c_host string, c_path string, c_id {kind}, c_digest long, to int")
            also = dealt.join(F.broadcast(to), F.expr("host = c_host and path = c_path and digest = c_digest and page_id <=> c_id"))
            shown = shown.unionByName(also.select("page_id", "url", "html", "host", "path", "digest", F.col("to").alias("bucket"), F.lit(False).alias("own")))
    near = shown.repartitionById(n, "bucket").sortWithinPartitions("bucket", "host", "path", "page_id", "url", "digest").drop("path", "digest")
    return near.mapInArrow(_difference, f"page_id {kind}, url string, text string")
