"""Main text of web pages: nearest-URL page differencing outside article containers, structure marks for the rest.

A page is cut into lines, one a block element. Every line outside an article container is compared with the
nearest pages of the same host: pages are ordered by host and path, each is paired with the neighbour whose path
agrees on more leading segments (the other neighbour if that one holds every unmarked line of the page, as a copy
tells nothing), both are aligned by a longest common subsequence of lines, and lines on it are deleted. Marks
decide the rest: scripts, menus, footers, adverts, forms, comments and the like go although no neighbour has
them, and the lines of an article container stay although a neighbour has them.

The order is a range partitioning of (host, path) keys, so a host with a third of all pages spreads over many
tasks, and neighbours across partition borders are found from the borders alone. Only line hashes are shuffled.

Results: null or empty html gives an empty text; a null url, or one without ``://``, is paired with no page;
repeated rows are each extracted, and paired as one page; extra columns are ignored; an empty table gives an
empty result; a page cut off inside a tag or a script keeps what came before.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.llm.common import Scratch, maybe_broadcast
from cairnspark.llm.url_filter import host_and_path

CHUNK = 200
DROP, OPEN, KEEP = 0, 1, 2

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^<>]*+)>|<[a-zA-Z/][^<>]*+\Z", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
SPACE = re.compile(r"\s+")

RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that an element of the same row ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
DROPPED = frozenset("head nav footer aside form dialog menu button select noscript template svg math canvas audio video object applet map datalist fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Words of a class or id that mark what is no part of an article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay paywall share sharing social related recommended recommendations widget toolbar pagination pager login searchbox masthead topbar skip".split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
HEADERS = frozenset("header heading masthead top".split())
CONTENT = frozenset("article post content entry story main".split())


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if "=" in raw or "hidden" in raw else {}


def _marked(tag: str, at: dict[str, str], level: int) -> tuple[bool, int]:
    """Whether an element is dropped with all inside, and how sure it is to hold an article (0 to 2)."""
    words = {w.lower() for w in WORD.findall(f"{at.get('class', '')} {at.get('id', '')}")} if at else set()
    role = at.get("role", "").lower()
    if words & COMMENTS or role in ROLES or "hidden" in at or at.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", at.get("style", "")):
        return True, 0
    if tag in ("article", "main") or role in ("main", "article") or at.get("itemprop", "") == "articleBody":
        return False, 2
    if tag in DROPPED or words & MARKS and tag not in ("html", "body"):
        return True, 0
    if not level and (tag == "header" or words & HEADERS and tag in ("div", "section", "table")):
        return True, 0
    return False, 1 if words & CONTENT and tag in ("div", "section", "td") else 0


def page_lines(html: str) -> list[tuple[str, int]]:
    """(line, DROP or OPEN or KEEP) of a page, in page order."""
    lines: list[tuple[str, bool, int, bool]] = []
    stack: list[tuple[str, bool, int]] = []
    parts: list[str] = []
    linked, plain, in_link = False, False, 0

    def flush() -> None:
        nonlocal linked, plain
        if parts:
            text = SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()
            if text:
                lines.append((text, bool(stack) and stack[-1][1], stack[-1][2] if stack else 0, linked and not plain))
            parts.clear()
        linked = plain = False

    def close(k: int) -> None:
        nonlocal in_link
        in_link -= sum(x[0] == "a" for x in stack[k:])
        del stack[k:]

    def text(part: str) -> None:
        nonlocal linked, plain
        if part:
            parts.append(part)
            if in_link:
                linked = True
            elif not part.isspace():
                plain = True

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    flush() if stack[k][1] else None
                    close(k)
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] in ENDS.get(tag, ()):
                    close(k)
                    break
                if stack[k][0] in LISTS.get(tag, ()) or stack[k][0] in ("div", "article", "section", "main", "body", "table", "td", "th", "blockquote"):
                    break
        dropped, level = stack[-1][1:] if stack else (False, 0)
        if not dropped:
            dropped, own = _marked(tag, _attributes(m[3] or m[6] or ""), level)
            level = max(level, own)
            if dropped:
                flush()
        if tag in BLOCK or dropped or tag in ("a", "b", "span", "i", "em", "strong"):
            stack.append((tag, dropped, level))
            in_link += tag == "a"
    flush()
    best = max((level for _, dropped, level, _ in lines if not dropped), default=0)
    state = lambda dropped, level, links: DROP if dropped or level < best or best == 0 and links else KEEP if level == 2 else OPEN
    return [(line, state(dropped, level, links)) for line, dropped, level, links in lines]


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a with each prefix of b, bit-parallel."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions of a on one longest common subsequence with b; memory is linear in both."""
    both = set(a) & set(b)
    out: list[int] = []
    todo = [([i for i, x in enumerate(a) if x in both], [x for x in b if x in both])]
    while todo:
        at, b = todo.pop()
        if not at or not b:
            continue
        if len(at) == 1:
            out += at if a[at[0]] in b else []
            continue
        half = len(at) // 2
        left = _prefix_lengths([a[i] for i in at[:half]], b)
        right = _prefix_lengths([a[i] for i in reversed(at[half:])], b[::-1])[::-1]
        cut = int((left + right).argmax())
        todo += [(at[:half], b[:cut]), (at[half:], b[cut:])]
    return sorted(out)


def shared_outside(lines: list[int], outside: list[int], opened: list[int], partners: list[list[int] | None]) -> list[int]:
    """Positions outside article containers on the common subsequence with the nearest page that leaves an unmarked line, if there are any."""
    for other in partners:
        if other:
            gone = set(common_lines(lines, other)).intersection(outside)
            if not opened or not gone.issuperset(opened):
                return sorted(gone)
    return []


def _hash(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _keyed(pages: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    page_id = F.col("page_id").cast("long")
    return pages.select(page_id.alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), F.xxhash64(page_id, "url", "html").alias("key"), host.alias("host"), path.alias("path"))


def line_hashes(keyed: DataFrame) -> DataFrame:
    """(key, host, path, lines, outside, opened): hashes of all lines of each page, the positions of those outside article containers, and of the unmarked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                found = [page_lines(h) for h in part.column(3).to_pylist()]
                hashes = pa.array([[_hash(x) for x, _ in f] for f in found], pa.list_(pa.int64()))
                outside, opened = (pa.array([[i for i, (_, s) in enumerate(f) if s in states] for f in found], pa.list_(pa.int32())) for states in ((DROP, OPEN), (OPEN,)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), hashes, outside, opened], ["key", "host", "path", "lines", "outside", "opened"])

    return keyed.select("key", "host", "path", "html").mapInArrow(run, "key long, host string, path string, lines array<long>, outside array<int>, opened array<int>")


def nearest(scratch: Scratch, urls: DataFrame) -> DataFrame:
    """(key, first, second): the neighbours of each key by path within its host, nearer first."""
    order = ("host", "path", "key")
    dealt = urls.where("host != ''").select(*order).repartitionByRange(*order)
    dealt = scratch.keep(dealt.withColumn("part", F.spark_partition_id()))
    row = F.struct(*order)
    inside = Window.partitionBy("part").orderBy(*order)
    placed = dealt.select("part", row.alias("own"), F.lag(row).over(inside).alias("before"), F.lead(row).over(inside).alias("after"))
    edges = dealt.groupBy("part").agg(F.min(row).alias("low"), F.max(row).alias("high"))  # a row a partition
    across = Window.orderBy("low")
    edges = edges.select("part", F.lag("high").over(across).alias("edge_before"), F.lead("low").over(across).alias("edge_after"))
    placed = placed.join(F.broadcast(edges), "part").select("own", F.coalesce("before", "edge_before").alias("before"), F.coalesce("after", "edge_after").alias("after"))
    segments = lambda c: F.split(F.col(f"{c}.path"), "/")

    def near(c: str):
        agree = F.zip_with(segments("own"), segments(c), lambda x, y: x == y)
        first_odd = F.array_position(F.transform(agree, lambda x: F.coalesce(x, F.lit(False))), False)
        return F.when(F.col(f"{c}.host") == F.col("own.host"), F.when(first_odd == 0, F.size(agree)).otherwise(first_odd - 1))

    scored = placed.select("own.key", F.struct(F.coalesce(near("before"), F.lit(-1)).alias("n"), F.lit(1).alias("o"), F.col("before.key").alias("k")).alias("x"), F.struct(F.coalesce(near("after"), F.lit(-1)).alias("n"), F.lit(0).alias("o"), F.col("after.key").alias("k")).alias("y"))
    best, other = F.greatest("x", "y"), F.least("x", "y")
    named = scored.select("key", best.alias("b"), other.alias("o"))
    return named.select("key", F.when(F.col("b.n") >= 0, F.col("b.k")).alias("first"), F.when(F.col("o.n") >= 0, F.col("o.k")).alias("second"))


def shared_lines(keyed: DataFrame) -> DataFrame:
    """(key, gone): the lines outside article containers that each page shares with its nearest page."""
    scratch = Scratch(keyed.sparkSession)
    pages = scratch.keep(line_hashes(keyed).dropDuplicates(["key"]))
    compared = pages.where(F.size("outside") > 0).select("key", "lines", "outside", "opened")
    pairs = nearest(scratch, pages).join(compared, "key")
    other = pages.select(F.col("key").alias("other"), F.col("lines").alias("theirs"))
    met = pairs.join(other, F.col("first") == F.col("other"), "left").select("key", "lines", "outside", "opened", "second", F.col("theirs").alias("near"))
    met = met.join(other, F.col("second") == F.col("other"), "left").select("key", "lines", "outside", "opened", "near", F.col("theirs").alias("far"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            gone = [shared_outside(r["lines"], r["outside"], r["opened"], [r["near"], r["far"]]) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])

    return met.mapInArrow(run, "key long, gone array<int>").where(F.size("gone") > 0)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) of every row of pages(page_id, url, html, ...)."""
    keyed = _keyed(pages)
    gone = Scratch(pages.sparkSession).keep(shared_lines(keyed))
    places = gone.agg(F.sum(F.size("gone") + 4)).first()[0] or 0
    both = keyed.select("page_id", "url", "html", "key").join(maybe_broadcast(gone, places), "key", "left").select("page_id", "url", "html", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                texts, counts = [], []
                for h, g in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    lost = set(g or ())
                    texts.append("\n".join(line for i, (line, state) in enumerate(page_lines(h)) if state != DROP and i not in lost))
                    counts.append(len(lost))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())], ["page_id", "url", "text", "n_chars", "n_shared"])

    return both.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_shared long")
