"""Main text of web pages: every page is aligned with the nearest page, and markup checks the lines shared."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobscope.llm.common import bounded_batches, stored

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_UNQUOTED = re.compile(r"[^'\">]*+")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+)|([a-zA-Z-]+)")

# Elements whose content is not marked-up text.
_RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
# Elements without end tag.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody tfoot thead tr ul".split()
)
_SPACE = frozenset("br td th".split())
# Page furniture, by element, by role and by the words of class and id.
_SKIP = frozenset("nav footer aside form menu dialog button select svg canvas object audio video map head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads adbox advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disclaimer footer gdpr login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices overlay pagination popup promo promos related replies respond share sharing sidebar "
    "signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
# Words that turn a class name into a remark on the layout ("has-sidebar"), and elements that hold
# the page, whatever furniture their classes speak of.
_REMARKS = frozenset("has have is no non not with without".split())
_HOLDERS = frozenset("html body main".split())
_CONTENT, _MAIN, _OPEN, _ASIDE = 2, 1, 0, -1
_SHOWN, _FORM, _FURNITURE = 0, 1, 2
# What markup says of a line: it is not main text, it may be, it is.
_DROPPED, _ASKED, _PROTECTED = 0, 1, 2


def _attributes(source: str) -> dict[str, str]:
    return {(m[1] or m[3]).lower(): (m[2] or "").strip("\"'").lower() for m in _ATTRIBUTE.finditer(source)}


def _furniture(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element is page furniture; a header inside an article is the article's."""
    if tag in _SKIP or (tag == "header" and not inside):
        return True
    if not attributes:
        return False
    names = attributes.get("class", "").split() + [attributes.get("id", "")]
    if tag in _HOLDERS:
        names = []
    if tag == "article":  # an article may be a comment or an advertisement by its whole name
        return not _WORDS.isdisjoint(names)
    parts = [set(re.split(r"[^a-z]+", name)) for name in names]
    words = set().union(*[p for p in parts if p.isdisjoint(_REMARKS)])
    return (
        attributes.get("role") in _ROLES
        or not words.isdisjoint(_WORDS)
        or (not inside and "header" in words)
        or "hidden" in attributes
        or attributes.get("aria-hidden") == "true"
        or "display:none" in attributes.get("style", "").replace(" ", "")
    )


class _Tokens:
    """Comments, declarations and tags of a page, from any place on.

    A tag ends at the first ``>`` outside quotes, or, if its quotes are never closed, at the first
    ``>``; a ``<`` without any ``>`` after it is text, unless it begins a tag that the page's end
    cuts off.  Time is in proportion to the page: what searches for closing quotes may cost in
    vain is bounded, after which tags end at the first ``>``.
    """

    def __init__(self, source: str) -> None:
        self.source, self.last = source, source.rfind(">")
        self.final = {quote: source.rfind(quote) for quote in "\"'"}
        self.budget = 8 * len(source)

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Where the next one begins and ends, closing or not, its name if a tag, and the rest."""
        source = self.source
        at = source.find("<", at)
        while at >= 0:
            closing = source.startswith("</", at)
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                return at, len(source) if end < 0 else end + 3, False, "", ""
            if at > self.last:
                sign = source[at + 1 : at + 2]
                if sign and (sign in "/!?" or (sign.isascii() and sign.isalpha())) and source.find("<", at + 1) < 0:
                    return at, len(source), False, "", ""
            elif source[at + 1 : at + 2] in ("!", "?"):
                return at, source.find(">", at + 2) + 1, False, "", ""
            elif m := _NAME.match(source, at + 1 + closing):
                stop = self._end(m.end())
                if stop >= 0:
                    return at, stop + 1, closing, m[0].lower(), source[m.end() : stop]
            at = source.find("<", at + 1)
        return None

    def _end(self, begin: int) -> int:
        """The ``>`` of a tag whose name ends at ``begin``; -1 if the name took the last one."""
        source, stop = self.source, begin
        while self.budget > 0:
            stop = _UNQUOTED.match(source, stop).end()
            quote = source[stop : stop + 1]
            if quote == ">":
                return stop
            if not quote or stop >= self.final[quote]:
                break
            stop = source.find(quote, stop + 1) + 1
        self.budget -= max(stop, begin) - begin
        return source.find(">", begin)


def page_blocks(source: str) -> list[tuple[int, str]]:
    """The page's blocks of text in order: (zone, text).

    Zone 2 lies in an article, 1 in the page's main element, 0 elsewhere, -1 in furniture.  Character
    references are decoded, white space becomes one space, empty blocks go.  A form is furniture, but not an
    article or main element that it holds.
    """
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int]] = [("", _OPEN, _SHOWN)]  # element, zone, furniture
    held: Counter = Counter()  # the names on the stack

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((_ASIDE if stack[-1][2] else stack[-1][1], text))

    at, size = 0, len(source)
    tokens = _Tokens(source)
    while token := tokens.after(at):
        start, end, closing, tag, rest = token
        if start > at:
            parts.append(source[at:start])
        at = end
        if not tag:
            continue
        if tag in _BLOCK:
            flush()
        elif tag in _SPACE:
            parts.append(" ")
        if closing:
            if held[tag]:
                flush()
                while held[tag] and (name := stack.pop()[0]):
                    held[name] -= 1
                    if name == tag:
                        break
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = close.end() if close else size
            continue
        if tag in _VOID or rest.endswith("/"):
            continue
        if tag in _BLOCK and stack[-1][0] == "p":  # a block ends an open paragraph
            held[stack.pop()[0]] -= 1
        _, zone, skipped = stack[-1]
        attributes = _attributes(rest) if rest.strip() else {}
        skip = skipped
        if _furniture(tag, attributes, zone > _OPEN):
            skip = max(skip, _FORM if tag == "form" else _FURNITURE)
        elif skip == _FORM and tag in ("article", "main"):
            skip = _SHOWN
        if tag == "article" or attributes.get("itemprop") == "articlebody":
            inner = _CONTENT
        elif tag == "main" or attributes.get("role") == "main":
            inner = max(zone, _MAIN)
        else:
            inner = zone
        if skip != skipped or inner != zone:
            flush()
        if skip or inner != zone or tag in ("div", "section", "p"):
            stack.append((tag, inner, skip))
            held[tag] += 1
    if at < size:
        parts.append(source[at:])
    flush()
    return out


def page_lines(source: str) -> list[tuple[int, str]]:
    """The page's blocks without furniture."""
    return [(zone, text) for zone, text in page_blocks(source) if zone > _ASIDE]


def main_zone(found: list[tuple[int, str]]) -> int:
    """The zone whose blocks, with those of higher zones, are the main text.

    An article is, but not a teaser beside a longer text in the page's main element.
    """
    chars: Counter = Counter()
    for zone, text in found:
        chars[zone] += len(text)
    if chars[_CONTENT] and chars[_CONTENT] >= chars[_MAIN]:
        return _CONTENT
    return _MAIN if chars[_MAIN] or chars[_CONTENT] else _OPEN


def marked_lines(source: str) -> list[tuple[int, str]]:
    """Every block of a page with what markup says of it: (``_DROPPED``, ``_ASKED`` or ``_PROTECTED``, text).

    Furniture is dropped, and what lies beside the article or main element the page names; the
    text of that is protected.  All other lines are asked for in the nearest page.
    """
    blocks = page_blocks(source)
    zone = main_zone([block for block in blocks if block[0] > _ASIDE])
    chosen = _PROTECTED if zone > _OPEN else _ASKED
    return [(chosen if at >= zone else _DROPPED, text) for at, text in blocks]


def shared_lines(own: list, other: list) -> np.ndarray:
    """Marks the lines of ``own`` in a longest common subsequence with ``other``."""
    marks = np.zeros(len(own), bool)
    begin, a, b = 0, len(own), len(other)
    while begin < min(a, b) and own[begin] == other[begin]:
        marks[begin] = True
        begin += 1
    while a > begin and b > begin and own[a - 1] == other[b - 1]:
        a, b = a - 1, b - 1
        marks[a] = True
    # Rows of the table of lengths as bits: bit j is 0 where the length grows at column j.  Every
    # 'step'-th row is kept, and those between are made again on the way back.
    holds: dict[str, int] = {}
    for j, line in enumerate(other[begin:b]):
        holds[line] = holds.get(line, 0) | 1 << j
    lines = own[begin:a]
    full = (1 << (b - begin)) - 1

    def following(row: int, line: str) -> int:
        both = row & holds.get(line, 0)
        return ((row + both) | (row - both)) & full

    step = math.isqrt(len(lines)) + 1
    kept, row = [full], full
    for n, line in enumerate(lines, 1):
        row = following(row, line)
        if n % step == 0:
            kept.append(row)
    i, j = len(lines), b - begin
    first, rows = len(lines) + 1, []
    while i and j:
        if i - 1 < first:  # the rows from the last kept one before i
            first = (i - 1) // step * step
            rows = [kept[first // step]]
            for line in lines[first:i]:
                rows.append(following(rows[-1], line))
        below, above = rows[i - first], rows[i - 1 - first]
        low = (1 << j) - 1
        if (below & low).bit_count() == (above & low).bit_count():
            i -= 1
        elif below >> (j - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            marks[begin + i] = True
    return marks


def line_prints(marked: list[tuple[int, str]]) -> np.ndarray:
    """Lines as numbers: 62 bits of a hash of the text, and in the two lowest what markup says."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text) & ~3 | kind for kind, text in marked], np.uint64).view(np.int64)


def kept_lines(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of a page's lines that markup has not dropped stay beside the nearest page; lines are ``line_prints``.

    Lines in a longest common subsequence of the two pages go, unless markup protects them in
    either page or the pages are copies.
    """
    kinds, names, theirs = own & 3, own >> 2, other >> 2
    if np.array_equal(names[kinds > _DROPPED], theirs[other & 3 > _DROPPED]):
        shared = np.zeros(len(own), bool)
    else:
        shared = shared_lines(names.tolist(), theirs.tolist())
    protected = (kinds == _PROTECTED) | np.isin(names, theirs[other & 3 == _PROTECTED])
    return (~shared | protected)[kinds > _DROPPED]


def _keyed(pages: DataFrame, id_column: str, url_column: str, html_column: str) -> DataFrame:
    """Id, URL, HTML, and two hashes, ``key`` and ``key2``, that together tell rows apart."""
    columns = [F.col(id_column), F.col(url_column), F.col(html_column)]
    all_ = [*columns, *[c.isNull() for c in columns]]
    return pages.select(*columns, F.xxhash64(*all_).alias("key"), F.xxhash64(F.lit(1), *all_).alias("key2"))


def _texts(keyed: DataFrame, id_column: str, url_column: str, html_column: str) -> DataFrame:
    """Id, URL, keys and the lines that markup has not dropped."""
    kind = keyed.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [[t for k, t in marked_lines(s.as_py() or "") if k > _DROPPED] for s in batch.column(4)]
            yield pa.record_batch(
                [*batch.columns[:4], pa.array(lines, pa.list_(pa.string()))],
                names=[id_column, url_column, "key", "key2", "lines"],
            )

    chosen = keyed.select(id_column, url_column, "key", "key2", html_column)
    schema = f"`{id_column}` {kind}, `{url_column}` string, key bigint, key2 bigint, lines array<string>"
    return chosen.mapInArrow(run, schema)


def _prints(keyed: DataFrame, url_column: str, html_column: str) -> DataFrame:
    """``row`` (the keys), ``host``, ``path`` and ``prints`` (all lines, furniture too) of every distinct row."""
    url = F.lower(F.coalesce(F.col(url_column), F.lit("")))
    parts = F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", 0)
    host = F.regexp_extract(parts, r"//([^/?#]*)", 1)
    path = F.regexp_extract(parts, r"//[^/?#]*(.*)$", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [line_prints(marked_lines(s.as_py() or "")) for s in batch.column(4)]
            yield pa.record_batch(
                [*batch.columns[:4], pa.array(prints, pa.list_(pa.int64()))],
                names=["key", "key2", "host", "path", "prints"],
            )

    chosen = keyed.select("key", "key2", host.alias("host"), path.alias("path"), F.col(html_column))
    found = chosen.mapInArrow(run, "key bigint, key2 bigint, host string, path string, prints array<bigint>")
    return found.dropDuplicates(["key", "key2"]).select(F.struct("key", "key2").alias("row"), "host", "path", "prints")


def nearest_pages(pages: DataFrame) -> DataFrame:
    """``row`` and ``partner``: for pages with ``row``, ``host`` and ``path``, the nearest of the host.

    Nearest is the neighbour in path order with the longer common beginning, the one before
    among equals.  The order is dealt by range, so a large host is split over tasks; the rows at
    the edges of tasks meet in a table of one row per task.
    """
    order = ["host", "path", "row"]
    ranged = pages.select(*order).repartitionByRange(*order).withColumn("task", F.spark_partition_id())
    ranged = stored(ranged, "page-order")
    mine = F.struct(*order)
    edge = ranged.groupBy("task").agg(F.min(mine).alias("first"), F.max(mine).alias("last"))
    tasks = Window.orderBy("task")
    edge = edge.select("task", F.lag("last").over(tasks).alias("left"), F.lead("first").over(tasks).alias("right"))
    inside = Window.partitionBy("task").orderBy(*order)
    around = ranged.select(
        "task", *order, F.lag(mine).over(inside).alias("before"), F.lead(mine).over(inside).alias("after")
    ).join(edge, "task")
    both = around.select(
        *order,
        F.coalesce("before", "left").alias("before"),
        F.coalesce("after", "right").alias("after"),
    )

    def common(side: str) -> F.Column:
        steps = F.zip_with(F.split("path", ""), F.split(F.col(f"{side}.path"), ""), lambda a, b: a.eqNullSafe(b))
        same = F.array_position(steps, False)
        return F.when(F.col(f"{side}.host") == F.col("host"), F.when(same == 0, F.length("path") + 1).otherwise(same))

    left, right = F.coalesce(common("before"), F.lit(-1)), F.coalesce(common("after"), F.lit(-1))
    partner = F.when((left < 0) & (right < 0), None).when(left >= right, F.col("before.row")).otherwise(F.col("after.row"))
    return both.select("row", partner.alias("partner"))


def aligned(prints: DataFrame) -> DataFrame:
    """``row``, its ``partner`` (NULL for the only page of a host) and which lines are ``kept`` beside that."""
    other = prints.select(F.col("row").alias("partner"), F.col("prints").alias("other"))
    paired = prints.select("row", "prints").join(nearest_pages(prints), "row").join(other, "partner", "left")

    @F.arrow_udf("array<boolean>")
    def kept(own: pa.Array, theirs: pa.Array) -> pa.Array:
        none = np.zeros(0, np.int64)
        lines = ((a.values.to_numpy(), b.values.to_numpy() if b.is_valid else none) for a, b in zip(own, theirs))
        return pa.array([kept_lines(a, b) for a, b in lines], pa.list_(pa.bool_()))

    return paired.select("row", "partner", kept("prints", "other").alias("kept"))


def main_text(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """Id, URL and ``text`` of every page; blocks joined by one newline, empty if there is none.

    Every page is paired with the nearest page by path within its host, and all its lines are
    aligned with those of that page: lines in the longest common subsequence of the two go.
    Markup checks what the alignment says.  It protects the blocks of an article, or else of a main
    element, that either of the two pages names (a short article beside a longer text in the main
    element joins that), because articles repeat too; and it drops what pages do not share:
    furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments) and all that
    lies beside the article.  Pages that are copies lose nothing to each other.  NULL html is empty; a page without
    URL or host is paired among such pages; rows that repeat are paired once and stay repeated.

    Pages are scanned twice: first for the numbers of their lines, which is what pairs move, then
    for the lines themselves, which meet what the alignment keeps of them.
    """
    bounded_batches(pages.sparkSession)
    keyed = _keyed(pages, id_column, url_column, html_column)
    kept = aligned(stored(_prints(keyed, url_column, html_column), "page-lines")).select("row.key", "row.key2", "kept")
    # The numbers grow with the pages, so both sides are moved by their key at every size.
    met = _texts(keyed, id_column, url_column, html_column).join(kept.hint("merge"), ["key", "key2"], "left")
    lines = F.filter("lines", lambda _, i: F.get("kept", i))
    return met.select(id_column, url_column, F.array_join(lines, "\n").alias("text"))
