"""Cleaning of paged texts and chunking of documents into parents and children.

Splitting is a sequential fold over one text, so it runs inside Arrow batches, a document at a time; everything
around it (routes, page statistics, table groups, paths) is DataFrame work. A parent stands beside each of its
children, so what a batch of documents gives can be many times its size: rows leave a task in batches of bounded text,
and what needs all children of a document (limits, paths) is done in the same fold, so parents are not shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.batches import in_batches, in_slices
from cairnspark.functions import text as T

PAGE_HEIGHT, EDGE = 842.0, 0.05
PARENT, CHILD, OVERLAP, LEAST = 2500, 450, 70, 20

# Marks at which texts of a kind are split.
LAW_MARKS = r"(?m)^(?=第[一二三四五六七八九十百千\d]+条|本院认为|判决如下|裁定如下|经审理查明|事实与理由|事实和理由|诉讼请求)"
PAPER_TITLES = ("Abstract", "Introduction", "Methods?", "Methodology", r"Materials?\s+and\s+Methods?", "Results?", "Discussion", "Conclusions?", "References", "Bibliography", "Acknowledgements?", "Appendix", r"Related\s+Work", "Background", r"Experiment(?:s|al)?(?:\s+(?:Setup|Results))?", "Evaluation", "Limitations?", r"Future\s+Work")
PAPER_MARKS = r"(?mi)^(?=(?:\d+\.?\s*)?(?:" + "|".join(PAPER_TITLES) + r")\s*$)"
QA_PAIR = r"(?ms)^\s*(?:Q|问)\s*[:：]\s*(.*?)\s*^\s*(?:A|答)\s*[:：]\s*(.*?)(?=^\s*(?:Q|问)\s*[:：]|\Z)"
MARKS = "|".join((*(m.replace("^(原告", "^(?:原告") for m in T.STRUCTURE_MARKS), r"^#{1,6}\s+"))
STRUCTURE = f"(?m)(?={MARKS})"
TABLE = r"(?ms)(<table>.*?</table>|(?:^\|.*\|$\n?){2,})"
SECTION_LINES = tuple((n, re.compile(p)) for n, p in T.SECTION_HEADINGS)
SENTENCE_END = r"(?<=[。！？.!?\n])"


def without_edge_blocks(blocks: Column, height: float = PAGE_HEIGHT) -> Column:
    """Blocks struct(y, text) of a page without short ones in its top and bottom twentieth."""
    return F.filter(blocks, lambda b: ~(((b["y"] < height * EDGE) | (b["y"] > height * (1 - EDGE))) & (F.length(b["text"]) < 100)))


def repeated_headers(pages: DataFrame, book: str, text: str) -> DataFrame:
    """(book, line, n): short lines among the first and last three of a page, on more than half of the pages."""
    lines = F.split(F.trim(text), "\n")
    edges = F.concat(F.slice(lines, 1, 3), F.slice(lines, -F.least(F.size(lines), F.lit(3)), F.lit(3)))
    total = pages.groupBy(book).agg(F.count(F.lit(1)).alias("n_pages"))
    found = pages.select(book, F.explode(edges).alias("line")).select(book, F.trim("line").alias("line")).where("length(line) > 2 and length(line) < 50")
    return found.groupBy(book, "line").agg(F.count(F.lit(1)).alias("n")).join(total, book).where("n_pages >= 2 and n > 0.5 * n_pages").select(book, "line", "n")


def clean(docs: DataFrame, headers: Column) -> DataFrame:
    """I4: docs(text) without repeated headers and page numbers."""
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(headers, F.trim(x)))
    return docs.withColumn("text", T.remove_page_numbers(F.array_join(kept, "\n")))


def chunker_for(file_type: Column, override: Column) -> Column:
    """I5"""
    return F.coalesce(override, F.when(F.lower(file_type).isin("csv", "xlsx"), "table").otherwise("naive"))


def strategies(headings: Column, marks: Column) -> Column:
    """I6"""
    return F.when(headings >= 3, "heading,heuristic,legacy").when(marks >= 2, "heuristic,legacy").otherwise("legacy")


def reassemble(chunks: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """The parts of each group in order, joined by a blank line."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return chunks.groupBy(by).agg(parts.alias("parts")).select(by, F.array_join(F.transform("parts", lambda p: p[text]), "\n\n").alias(text))


def table_chunks(rows: DataFrame, by: str, order: str, columns: list[str], size: int = 5) -> DataFrame:
    """(by, parent, n_rows, text): groups of rows as Markdown tables with the header repeated."""
    cell = lambda c: F.translate(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), "\r\n", "  ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    numbered = rows.select(by, F.col(order).alias("o"), line.alias("line"), (F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).alias("i"))
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |\n"
    grouped = numbered.groupBy(by, F.floor(F.col("i") / size).cast("long").alias("parent")).agg(F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_list(F.struct("o", "line"))).alias("x"))
    return grouped.select(by, "parent", "n_rows", F.concat(F.lit(head), F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("text"))


def key_values(names: list[str]) -> Column:
    """A row as name: value lines, empty ones left out, values clipped to 500 letters."""
    pairs = [F.when(F.trim(F.coalesce(F.col(n).cast("string"), F.lit(""))) != "", F.concat(F.lit(f"{n}: "), F.substring(F.trim(F.col(n).cast("string")), 1, 500))) for n in names]
    return F.concat_ws("\n", *pairs)


# --- folds over one text -------------------------------------------------------------------------------------


def pack(parts: list[str], most: int, glue: str = "") -> list[str]:
    """Neighbours joined while they fit."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + len(glue) + len(p) <= most:
            out[-1] += glue + p
        else:
            out.append(p)
    return out


def sentences(text: str, most: int) -> list[str]:
    """Sentences packed up to a size; a longer sentence is cut hard."""
    pieces = [s[i : i + most] for s in re.split(SENTENCE_END, text) if s for i in range(0, len(s), most)]
    return [x for x in (c.strip() for c in pack(pieces, most)) if x] or [text]


def fixed(text: str, size: int = CHILD, overlap: int = OVERLAP, slack: int = 50) -> list[str]:
    """Windows that end at a sentence end near the size, and overlap."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            low = max(start, end - slack)
            ends = (low + m.end() for m in re.finditer(r"[。！？.!?\n]", text[low : end + slack]))
            end = next((e for e in ends if e >= start + size // 2), end)
        if part := text[start:end].strip():
            out.append(part)
        if end >= len(text):
            break
        start = end - overlap
    return out or [text]


def parents(text: str, most: int = PARENT) -> list[str]:
    """Parts by the densest structure of a text, packed up to a size; tables stay whole."""
    headings = len(re.findall(T.HEADING, text))
    marks = sum(1 for _ in re.finditer("(?m)" + "|".join(T.STRUCTURE_MARKS), text))
    tried = ["paragraph"]
    if marks >= 2:
        tried.insert(0, "structure")
    if headings >= 3:
        tried.insert(0, "heading")
    for how in tried:
        rough, whole = units(text, how), re.compile(TABLE)
        packed = normalise(rough, most) if how == "paragraph" else [q for p in rough for q in ([p] if len(p) <= most or whole.fullmatch(p) else sentences(p, most))]
        if how == tried[-1] or all(LEAST <= len(p) <= most for p in packed):
            return packed
    return [text]


def children(parent: str, size: int = CHILD) -> list[str]:
    """Units at structure marks, packed up to a size, tiny ones joined to a neighbour."""
    if re.fullmatch(TABLE, parent):
        return [parent]
    parts = [u.strip() for u in re.split(STRUCTURE, parent) if u.strip()]
    if len(parts) < 2:
        return fixed(parent, size)
    fine = [q for u in parts for q in fixed(u, size)]
    out: list[str] = []
    crumbs = Breadcrumb(parent)
    for u in fine:
        heading = crumbs.heading(u.split("\n", 1)[0])  # a chapter starts a child of its own
        if out and not heading and (len(u) < LEAST or len(out[-1]) < LEAST or len(out[-1]) + len(u) < size // 2) and len(out[-1]) + len(u) + 1 <= size:
            out[-1] += "\n" + u
        else:
            out.append(u)
    return out


class Breadcrumb:
    """H4: the stack of headings above a place: Markdown headings, or others in a text that has none of those."""

    def __init__(self, text: str = "") -> None:
        self.stack: list[tuple[int, str]] = []
        self.plain = [] if re.search(T.HEADING, text) else [(level, re.compile(p)) for level, p in T.PLAIN_HEADINGS]

    def heading(self, line: str) -> tuple[int, str] | None:
        if m := re.match(r"(#{1,6})\s+(.+)$", line.strip()):
            return len(m[1]), f"{m[1]} {m[2].strip()}"
        for level, p in self.plain:
            if m := p.match(line):
                title = m[1].strip()
                return (level, title) if len(title) <= T.LONGEST_HEADING else None
        return None

    def feed(self, text: str) -> str:
        for line in text.split("\n"):
            if found := self.heading(line):
                self.stack = [x for x in self.stack if x[0] < found[0]] + [found]
        return " > ".join(t for _, t in self.stack)


SPLITS = {"heading": r"(?m)(?=^#{1,6}\s+)", "structure": STRUCTURE, "paragraph": r"\n\n+"}


def units(text: str, how: str) -> list[str]:
    """Parts of a text at its headings, structure marks or blank lines; tables are parts of their own."""
    out: list[str] = []
    for k, part in enumerate(re.split(TABLE, text)):
        if k % 2:
            out.append(part.strip())
        elif how == "table":
            out += [part.strip()] if part.strip() else []
        else:
            out += [p.strip() for p in re.split(SPLITS[how], part) if p.strip()]
    return out


def normalise(parts: list[str], most: int = PARENT) -> list[str]:
    """Neighbours joined by a blank line while they fit; tables stay as they are, longer parts are cut into sentences."""
    out: list[str] = []
    open_part = False
    for p in parts:
        table = p.startswith("<table>") or bool(re.fullmatch(TABLE, p))
        if table or len(p) > most:
            out += [p] if table else sentences(p, most)
            open_part = False
        elif open_part and len(out[-1]) + 2 + len(p) <= most:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
            open_part = True
    return out


CUTS = {"normal": lambda t: normalise(units(t, "paragraph")), "child": lambda t: children(t), "sentence": lambda t: sentences(t, PARENT), "fixed": lambda t: fixed(t)}


KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def folded(rows_of: Callable[[int, str | None], Iterable[tuple]], schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow batches (doc_id, text) to batches of the rows that a function gives of each; few texts are Python objects at one time."""
    kinds = pa.schema([(c.split()[0], KINDS[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = (doc for b in in_slices(batches) for doc in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for f in in_batches((row for d, t in docs for row in rows_of(d, t)), kinds.names):
            yield pa.RecordBatch.from_pandas(f, kinds, preserve_index=False)

    return run


def fold_texts(docs: DataFrame, rows_of: Callable[[int, str | None], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that a function gives of each of docs(doc_id, text), a document at a time."""
    return docs.select("doc_id", "text").mapInArrow(folded(rows_of, schema), schema)


def split_documents(docs: DataFrame, how: str) -> DataFrame:
    """(doc_id, part, text) of docs(doc_id, text); how is a key of SPLITS or CUTS, or table."""

    def rows_of(doc_id: int, text: str | None) -> Iterator[tuple]:
        cut = CUTS[how](text or "") if how in CUTS else units(text or "", how)
        return ((doc_id, i, p) for i, p in enumerate(cut))

    return fold_texts(docs, rows_of, "doc_id long, part int, text string")


def heading_trails(docs: DataFrame) -> DataFrame:
    """H4: (doc_id, line, text, trail) of every line that is no heading, with the headings above it."""

    def rows_of(doc_id: int, text: str | None) -> Iterator[tuple]:
        crumbs = Breadcrumb(text or "")
        for i, line in enumerate((text or "").split("\n")):
            trail = crumbs.feed(line)
            if line.strip() and not crumbs.heading(line):
                yield doc_id, i, line, trail

    return fold_texts(docs, rows_of, "doc_id long, line int, text string, trail string")


def chunk_text(text: str | None, mode: str = "naive") -> list[tuple[int, int, str, str, str]]:
    """(parent number, child number, parent, child, breadcrumb) of one text."""
    body = (text or "").strip()
    if not body:
        return []
    if mode == "qa":
        pairs = [(q.strip(), a.strip()) for q, a in re.findall(QA_PAIR, body) if q.strip() or a.strip()]
        split = [(f"Q: {q}\nA: {a}", [q, a]) for q, a in pairs] or [(body, [body])]
    elif mode in ("laws", "paper"):
        parts = [p.strip() for p in re.split(LAW_MARKS if mode == "laws" else PAPER_MARKS, body) if p.strip()]
        cut = r"\n+" if mode == "laws" else r"\n\n+"
        split = [(p, [c.strip() for c in re.split(cut, p) if c.strip()]) for p in parts]
    elif mode == "fixed":
        split = [(body, fixed(body))]
    elif mode == "sentences":
        split = [(p, [p]) for p in sentences(body, PARENT)]
    elif len(body) <= CHILD:
        split = [(body, [body])]
    else:
        split = [(p, children(p)) for p in parents(body)]
    out, n, crumbs = [], 0, Breadcrumb(body)
    for k, (p, cs) in enumerate(split):
        for c in cs:
            out.append((k, n, p, c, crumbs.feed(c)))
            n += 1
    return out


CHUNKS = "doc_id long, parent_index int, child_index int, parent string, child string, context_header string"


def chunk_documents(docs: DataFrame, mode: str = "naive", limits: tuple[int, int] | None = None) -> DataFrame:
    """docs(doc_id, text) to child rows with their parents; with limits of parents and children they are enforced (I16) in the same fold."""

    def rows_of(doc_id: int, text: str | None) -> Iterator[tuple]:
        rows = chunk_text(text, mode)
        return ((doc_id, *r) for r in (within_limits(rows, *limits) if limits else rows))

    return fold_texts(docs, rows_of, CHUNKS)


LIMITS = (PARENT * 2, CHILD + 50)


def within_limits(rows: Iterable[tuple[int, int, str, str, str]], parent: int = LIMITS[0], child: int = LIMITS[1]) -> Iterator[tuple[int, int, str, str, str]]:
    """I16: of one document's rows of chunk_text, in order: children over the limit are cut again and numbered anew; parents over it become their children's windows."""
    n = 0
    for k, _, p, c, header in rows:
        for piece in [c] if len(c) <= child else sentences(c, CHILD):
            yield k, n, p if len(p) <= parent else piece, piece, header
            n += 1


def enforce_limits(chunks: DataFrame, parent: int = LIMITS[0], child: int = LIMITS[1]) -> DataFrame:
    """I16 of chunk rows that are there already. Children alone pass through Python; chunk_documents with limits needs no shuffle."""

    @F.pandas_udf("array<string>")
    def cut(children: pd.Series) -> pd.Series:
        return children.map(lambda c: [c] if len(c) <= child else sentences(c, CHILD))

    pieces = chunks.select("*", F.posexplode(cut("child")).alias("piece", "__c"))
    own = F.when(F.length("parent") <= parent, F.col("parent")).otherwise(F.col("__c"))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("old", "piece")) - 1
    cut_rows = pieces.select("doc_id", "parent_index", F.col("child_index").alias("old"), "piece", own.alias("parent"), F.col("__c").alias("child"), "context_header")
    return cut_rows.select("doc_id", "parent_index", at.alias("child_index"), "parent", "child", "context_header")


def heading_paths(text: str) -> tuple[list[int], list[list[str]]]:
    """Places of a text's headings and the path of titles that holds from each on: a heading ends all deeper ones."""
    places, paths, now, at = [], [], {}, 0
    for line in text.split("\n"):
        level = next((n for n, p in SECTION_LINES if p.fullmatch(line)), None)
        title = line.strip()
        if level and len(title) <= T.LONGEST_HEADING:
            now = {n: t for n, t in now.items() if n < level} | {level: title}
            places.append(at)
            paths.append([now[n] for n in sorted(now)])
        at += len(line) + 1
    return places, paths


def child_paths(parents: list[str], children: list[str], anchor: int = 50, many: int = 100) -> list[list[str]]:
    """The section path of each child of one document: that of the last heading before the place where its first letters first occur.

    Documents of more than ``many`` parents with one child each were cut beforehand and have no paths.
    """
    whole = "\n".join(parents)
    cut_before = len(parents) > many and len(parents) == len(children)
    places, paths = ([], []) if cut_before else heading_paths(whole)
    out: list[list[str]] = []
    for child in children:
        start = child[:anchor].strip()
        at = whole.find(start) if start and places else -1
        last = bisect_left(places, at) - 1 if at >= 0 else -1
        out.append(paths[last] if last >= 0 else [])
    return out


PATHS = "doc_id long, child_index int, section_path array<string>, child string"


def path_rows(doc_id: int, rows: Iterable[tuple[int, int, str, str]], anchor: int, many: int) -> Iterator[tuple]:
    """PATHS of one document's (parent_index, child_index, parent, child), in any order."""
    rows = sorted(rows, key=lambda r: r[1])
    parents: dict[int, str] = {}
    for k, _, p, _ in rows:
        parents.setdefault(k, p or "")
    found = child_paths([parents[k] for k in sorted(parents)], [c or "" for *_, c in rows], anchor, many)
    return ((doc_id, n, path, c) for (_, n, _, c), path in zip(rows, found, strict=True))


def section_paths(chunks: DataFrame, anchor: int = 50, many: int = 100) -> DataFrame:
    """(doc_id, child_index, section_path, element_type) of chunk rows(doc_id, parent_index, child_index, parent, child) that are there already.

    Rows are dealt and sorted by document, and read one document after another.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for f in frames for row in f.itertuples(index=False, name=None))
        found = (row for d, own in groupby(rows, key=lambda r: r[0]) for row in path_rows(d, [r[1:] for r in own], anchor, many))
        yield from in_batches(found, ["doc_id", "child_index", "section_path", "child"])

    dealt = chunks.select("doc_id", "parent_index", "child_index", "parent", "child").repartition("doc_id").sortWithinPartitions("doc_id")
    return typed_paths(dealt.mapInPandas(run, PATHS))


def document_paths(docs: DataFrame, mode: str = "naive", anchor: int = 50, many: int = 100) -> DataFrame:
    """I24 of docs(doc_id, text): chunks and their paths in one fold, without a shuffle."""
    return typed_paths(fold_texts(docs, lambda doc_id, text: path_rows(doc_id, [r[:4] for r in chunk_text(text, mode)], anchor, many), PATHS))


def typed_paths(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "child_index", "section_path", T.element_type(F.col("child")).alias("element_type"))
