"""Main text of web pages by nearest-URL differencing.

Pages of a host are ordered by URL path, and each is paired with the neighbour whose path has the
longer common beginning (if the two share no line, with the other one). Their text lines (the text of
each block) are aligned by a longest common subsequence, and lines that the alignment shares are
deleted: menus, headers, footers, notices and whatever else the site repeats. Neighbours whose lines
are all the same are copies, and the nearest page beyond a run of them is taken.

Differencing alone can't give right results: adverts, comments and forms that vary from page to page
are not shared, an article's own lines are where a neighbour quotes them, and a lone page of a host has
no neighbour. Structure refines it. Lines that a page marks as its article (article or main element, or
a known class) stay though shared, lines in elements that are no content (menu, advert, form, comment,
by element, role or class name) go though not shared, and a page without a neighbour is reduced to its
marked article if it has one. Scripts, styles and the like are never lines. Counts tell which of them
decided: n_deleted (by the alignment), n_held (shared, but marked), n_ruled (by structure alone).

Lines: character references are decoded, white space runs become one space, ends are trimmed, and
empty lines dropped; br ends a line. Broken pages are read as far as they go: an open comment,
script or tag runs to the end, and unclosed elements end with the page.

Rows: null and empty pages have an empty text; a page without a host has no neighbour; equal urls
are ordered by id and content; repeated rows are rows. Other columns are not read.

Scale: each page goes, compressed, to a range of (host, path) once, with the hashes of its lines;
the first pages of a range are also given to the range before, and the last ones to the range after,
so neighbours meet in one task wherever a host's pages are cut; a run of copies over several ranges
is bridged by a row for each range. No host is gathered.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as t
from ._order import dealt

TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|aria-label|hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object noframes".split())
SKIP = frozenset("nav header footer aside form button select dialog menu head".split())
MARKED = frozenset("article main".split())
#: Elements whose end is waited for; the others (p, li, td, ...) may be left open, and only part lines.
TRACKED = SKIP | MARKED | frozenset("html body div section ul ol dl table span".split())
MARKED_NAMES = frozenset("article articlebody article-body article-content post-content post-body entry-content story-body main-content".split())
SKIP_NAMES = re.compile(
    r"(?:^|[-_])(?:ads?|advert(?:s|isement|ising)?|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|alert|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|header|masthead|toolbar|comments?|comment-list|disqus|share|sharing|social|newsletter|subscribe|signup|login|popup|modal|overlay|related|recommended|widget|disclaimer)(?:[-_](?:s|box|slot|bar|list|wrap|wrapper|container|area|section|block|unit|panel|item|text|inner|top|bottom|left|right|links|main|site|page|\d+))*$",
    re.I,
)
SKIP_BEGINNINGS = re.compile(r"^(?:ads?|adsbygoogle|advert\w*|comment|comments|commentlist|cookie|sidebar|newsletter|sponsor\w*|promo|related|popup|modal|breadcrumbs?|share|social|disqus)(?:[-_].*)?$", re.I)
KEEP_NAMES = re.compile(r"^(?:no|has|with|without|hide)[-_]", re.I)
COUNTS = ("n_deleted", "n_held", "n_ruled")
#: Cells of an alignment that are held at once, a bit each.
CELLS = 1 << 26
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())


def _named(rest: str) -> tuple[bool, bool]:
    """Whether an element's attributes say to skip it, and whether they mark the article."""
    skip = marked = False
    for name, value in ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for x in value.split():
                marked |= x in MARKED_NAMES
                skip |= bool(SKIP_NAMES.search(x) or SKIP_BEGINNINGS.match(x)) and not KEEP_NAMES.match(x)
        elif name == "role":
            skip |= value in SKIP_ROLES
            marked |= value in ("main", "article")
        elif name == "itemprop":
            marked |= value == "articlebody"
        elif name == "aria-label":
            skip |= value.startswith("advert") or value in ("breadcrumb", "comments", "cookie notice")
        elif name == "hidden":
            skip |= value != "until-found"
        elif name == "style":
            skip |= bool(re.search(r"display\s*:\s*none", value))
    return skip and not marked, marked


PLAIN, MARK, RULED = 0, 1, 2


def all_lines(page: str) -> list[tuple[str, int]]:
    """The lines of a page, and of each whether it is in a marked article or ruled out by structure."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    aside: list[str] = []  # what structure rules out
    stack: list[tuple[str, bool, bool]] = []  # element, skipped, in a marked article

    def end() -> None:
        for text, kind in ((parts, MARK if stack and stack[-1][2] else PLAIN), (aside, RULED)):
            if text:
                line = " ".join(html.unescape("".join(text)).split())
                if line:
                    out.append((line, kind))
                text.clear()

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            (aside if stack and stack[-1][1] else parts).append(page[at:stop])
        if not m:
            break
        at = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            continue
        name, closing, rest = name.lower(), m.group(1) or m.group(4), m.group(3) or m.group(6) or ""
        if name not in INLINE:
            end()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at) if not rest.endswith("/") else None
            at = close.end() if close else (at if rest.endswith("/") else n)
            continue
        if name in VOID or rest.endswith("/"):
            continue
        skip, marked = _named(rest) if "=" in rest or "hidden" in rest else (False, False)
        under, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        skipped = under or (name in SKIP and not (name == "header" and inside)) or (skip and name not in ("html", "body", *MARKED))
        now = (skipped, not skipped and (inside or marked or name in MARKED))
        if now != (under, inside) or name in TRACKED:
            stack.append((name, *now))
    end()
    return out


def lines(page: str) -> list[tuple[str, bool]]:
    """The lines of a page that structure does not rule out, and whether each is in a marked article."""
    return [(x, kind == MARK) for x, kind in all_lines(page) if kind != RULED]


def _vector(a: list, b: list, rows: list | None = None) -> int:
    """The last bit vector of the alignment of a with b; rows: gets that of each line of a."""
    spots: dict = {}
    for j, y in enumerate(b):
        spots[y] = spots.get(y, 0) | 1 << j
    v = whole = (1 << len(b)) - 1
    for x in a:
        u = v & spots.get(x, 0)
        v = ((v + u) | (v - u)) & whole
        if rows is not None:
            rows.append(v)
    return v


def _lengths(a: list, b: list) -> np.ndarray:
    """The length of the longest common subsequence of a and each beginning of b."""
    v = _vector(a, b)
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(bits == 0)))


def common(a: list, b: list) -> list[int]:
    """Places in a of a longest common subsequence with b, by bit vectors; long ones in halves of a, so
    that memory does not grow with the product of the lengths."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    ends = list(range(first)), list(range(len(a) - last, len(a)))
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if len(a) > 1 and len(a) * len(b) > CELLS:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        inner = common(a[:half], b[:cut]) + [half + k for k in common(a[half:], b[cut:])]
        return ends[0] + [first + k for k in inner] + ends[1]
    rows: list[int] = []
    _vector(a, b, rows)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                out.append(i)
                j -= 1
    return ends[0] + [first + k for k in out[::-1]] + ends[1]


def _read(batches):
    for batch in t.sliced(batches, "_html"):
        body, marks, hashes = [], [], []
        for page in batch.column(batch.schema.get_field_index("_html")).to_pylist():
            found = all_lines(page)
            body.append(zlib.compress("\n".join(x for x, kind in found if kind != RULED).encode(), 6))
            marks.append(bytes(kind for _, kind in found))
            hashes.append(np.array([xxhash.xxh3_64_intdigest(x.encode()) for x, _ in found], np.uint64).view(np.int64))
        same = [batch.column(k) for k in range(batch.num_columns - 1)]
        tie = pa.array([xxhash.xxh3_64_intdigest(m + x) >> 1 for m, x in zip(marks, body)], pa.int64())
        yield pa.RecordBatch.from_arrays([*same, pa.array(body, pa.binary()), pa.array(marks, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), tie], [*batch.schema.names[:-1], "body", "marks", "lines", "tie"])


def _near(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _difference(batches):
    """The text of each page, from its lines and those of the pages before and after."""
    for batch in batches:
        col = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in batch.schema.names}
        text, counts = [], []
        for r in range(batch.num_rows):
            body, marks = zlib.decompress(col["body"][r]).decode(), col["marks"][r]
            own = iter(body.split("\n") if body else [])
            others = [(p, x, next_to) for p, x, next_to in ((col["before_path"][r], col["before"][r], col["_starts"][r]), (col["after_path"][r], col["after"][r], col["_ends"][r])) if p is not None]
            shared: set[int] = set()
            for _, x, _ in sorted(others, key=lambda o: (-_near(o[0], col["path"][r]), not o[2])):
                shared = set(common(col["lines"][r], x))
                if shared:
                    break
            alone = not others and MARK in marks
            kept, deleted, held, ruled = [], 0, 0, 0
            for k, kind in enumerate(marks):
                line = next(own) if kind != RULED else None
                if kind == MARK:
                    kept.append(line)
                    held += k in shared
                elif k in shared:
                    deleted += 1
                elif kind == RULED or alone:
                    ruled += 1
                else:
                    kept.append(line)
            text.append("\n".join(kept))
            counts.append((deleted, held, ruled))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), *(pa.array([x[k] for x in counts], pa.int64()) for k in range(3))], [*batch.schema.names[:2], "text", *COUNTS])


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html", ranges: int | None = None) -> DataFrame:
    """(id, url, text, n_deleted, n_held, n_ruled) of each page."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id, url)]
    link = F.coalesce(F.col(url).cast("string"), F.lit(""))
    where = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"
    rows = pages.select(F.col(id).alias("_id"), F.col(url).alias("_url"), F.lower(F.regexp_extract(link, where, 1)).alias("host"), F.regexp_extract(link, where, 2).alias("path"), F.coalesce(F.col(page), F.lit("")).alias("_html"))
    number = F.coalesce(F.lpad(F.col("_id").cast("string"), 20, "0"), F.lit(""))
    rows = rows.withColumn("key", F.concat_ws("\x00", "host", "path", number)).select("_id", "_url", "host", "path", "key", "_html")
    found = t.map_arrow(rows, _read, f"_id {kinds[0]}, _url {kinds[1]}, host string, path string, key string, body binary, marks binary, lines array<long>, tie long")
    spread = dealt(found, "key", ranges=ranges, keys=rows, both=True)
    order = Window.partitionBy("_range").orderBy("_order", "key", "tie")
    one = F.struct("host", "path", "lines")
    # copies in a row are a run: the page before is the last one of the run before, the page after the first of the next
    differs = lambda side: F.coalesce((side("host").over(order) != F.col("host")) | (side("lines").over(order) != F.col("lines")), F.lit(True))
    spread = spread.withColumns({"_starts": differs(F.lag), "_ends": differs(F.lead)}).where("_order = 0")
    spread = spread.withColumns({"_end": F.when(F.col("_ends"), one), "_start": F.when(F.col("_starts"), one)})
    spread = spread.withColumns({"_before": F.last("_end", True).over(order.rowsBetween(Window.unboundedPreceding, -1)), "_after": F.first("_start", True).over(order.rowsBetween(1, Window.unboundedFollowing))})
    # a run may go on over several ranges: their outermost pages, a row for each range, are carried over them
    place = F.struct("key", "tie")
    edges = spread.groupBy("_range").agg(F.max_by("_end", F.when(F.col("_ends"), place)).alias("_end"), F.min_by("_start", F.when(F.col("_starts"), place)).alias("_start"))
    across = Window.orderBy("_range")
    edges = edges.select(F.col("_range").alias("_at"), F.last("_end", True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"), F.first("_start", True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    spread = spread.join(F.broadcast(edges), F.col("_range") == F.col("_at"), "left").withColumns({"_before": F.coalesce("_before", "_earlier"), "_after": F.coalesce("_after", "_later")})
    same = lambda c: F.when((F.col(f"{c}.host") == F.col("host")) & (F.col("host") != ""), F.col(c))
    spread = spread.withColumns({"_before": same("_before"), "_after": same("_after")})
    ready = spread.select("_id", "_url", "_starts", "_ends", "path", "body", "marks", "lines", F.col("_before.path").alias("before_path"), F.col("_before.lines").alias("before"), F.col("_after.path").alias("after_path"), F.col("_after.lines").alias("after"))
    return t.map_arrow(ready, _difference, f"_id {kinds[0]}, _url {kinds[1]}, text string, " + ", ".join(f"{c} long" for c in COUNTS)).select(F.col("_id").alias(id), F.col("_url").alias(url), "text", *COUNTS)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    found = main_text(t.table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), *COUNTS)
