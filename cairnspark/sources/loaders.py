"""Readers: a format registry over Spark's sources, office archives through Arrow batches, and web pages."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from cairnspark.batches import in_slices

LOADED = StructType([StructField("path", StringType()), StructField("content", StringType()), StructField("flag", BooleanType())])
# The file types that can be loaded, and the reader of each.
READERS = {"text": ("md", "txt"), "table": ("csv", "xlsx"), "office": ("pdf", "doc", "docx", "pptx"), "image": ("jpg", "jpeg", "png"), "audio": ("mp3", "wav", "m4a", "flac", "ogg")}
SUPPORTED = tuple(sorted(kind for kinds in READERS.values() for kind in kinds))


def unsupported(kind: str) -> str:
    return f"unsupported file type: {kind}; supported: {', '.join(SUPPORTED)}"


def read_text(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """A2: whole files; bytes that are no UTF-8 are left out."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return raw.select("path", F.regexp_replace(F.col("content").cast("string"), "�", "").alias("content"), F.lit(False).alias("flag"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A3"""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def rows_per_chunk(table: DataFrame, columns: list[str], budget: int = 5000, sample: int = 200) -> DataFrame:
    """A4: one row, n: how many rows fit a chunk, by the 90th percentile of the width of the first rows as they are read; the sample is the rule itself."""
    width = sum((F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) + 3 for c in columns), F.lit(1))
    widths = table.limit(sample).agg(F.array_sort(F.collect_list(width)).alias("w"))
    p90 = F.coalesce(F.get("w", F.least(F.floor(F.size("w") * 0.9), F.size("w") - 1).cast("int")), F.lit(1))
    head = sum(len(c) + 3 for c in columns) + 1 + 6 * len(columns)
    return widths.select(F.greatest(F.lit(1), F.least(F.lit(30), F.floor((budget - head) / p90))).cast("long").alias("n"))


def docx_text(raw: bytes) -> str:
    """Paragraphs with text, joined by blank lines."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    texts = ("".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")).strip() for p in root.iter() if p.tag.endswith("}p"))
    return "\n\n".join(t for t in texts if t)


def pptx_text(raw: bytes) -> str:
    """A10: a heading and the text lines of each slide."""
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for k, name in slides:
            lines = [t.text for t in ElementTree.fromstring(z.read(name)).iter() if t.tag.endswith("}t") and t.text]
            out.append(f"[Slide {k}]\n" + "\n".join(lines))
    return "\n\n".join(out)


def xlsx_text(raw: bytes) -> str:
    """The cells of each sheet, a line a row, under the sheet's number."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if si.tag.endswith("}si")]
        out = []
        for k, name in sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n))):
            rows = []
            for row in (r for r in ElementTree.fromstring(z.read(name)).iter() if r.tag.endswith("}row")):
                cells = []
                for c in row:
                    v = next((x.text for x in c.iter() if x.tag.endswith(("}v", "}t"))), "") or ""
                    cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                rows.append("| " + " | ".join(cells) + " |")
            out.append(f"[Sheet {k}]\n" + "\n".join(rows))
    return "\n\n".join(out)


PARSERS: dict[str, Callable[[bytes], str]] = {"docx": docx_text, "pptx": pptx_text, "xlsx": xlsx_text}


def parsed(files: DataFrame, kind: str) -> DataFrame:
    """Texts of archives(path, content) of one kind; a broken one gives a null content."""
    parse = PARSERS[kind]

    def safe(raw: bytes) -> str | None:
        try:
            return parse(raw)
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            texts = pa.array([safe(raw) for raw in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts, pa.array([False] * b.num_rows)], LOADED.names)

    return files.select("path", "content").mapInArrow(run, LOADED)


def read_office(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Archives of one kind under a path."""
    return parsed(spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path), kind)


def read_media(spark: SparkSession, path: str, kinds: tuple[str, ...]) -> DataFrame:
    """Empty texts with a flag, for a provider to fill."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(kinds) + "}").load(path)
    return raw.select("path", F.lit("").alias("content"), F.lit(True).alias("flag"))


def load(spark: SparkSession, path: str, file_type: str) -> DataFrame:
    """A1: dispatch by extension; an unknown type is an error, and so is one whose parser isn't here (pdf, doc)."""
    kind = file_type.lower().strip(".")
    if kind not in SUPPORTED:
        raise ValueError(unsupported(kind))
    if kind in READERS["text"]:
        return read_text(spark, path, f"*.{kind}")
    if kind == "csv":
        return read_csv(spark, path)
    if kind in PARSERS:
        return read_office(spark, path, kind)
    if kind in READERS["image"] + READERS["audio"]:
        return read_media(spark, path, (kind,))
    raise NotImplementedError(f"no parser for {kind}")


def recognise(rows: DataFrame, provider: Callable[[str], str], fallback: Callable[[str], str]) -> DataFrame:
    """Contents by an injected provider, by the fallback where it fails, null where both do."""

    def one(path: str) -> str | None:
        for p in (provider, fallback):
            try:
                return p(path)
            except Exception:  # a page that no provider reads is tolerated
                continue
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(content=[one(p) for p in f["path"]])

    return rows.mapInPandas(run, LOADED)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """A20"""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_text(html: Column) -> Column:
    """The text of a page: no scripts, styles or tags, single spaces."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def share_image(html: Column) -> Column:
    """A16"""
    tag = F.regexp_extract(html, r"(?is)(<meta[^>]*(?:og:image|twitter:image)[^>]*>)", 1)
    return F.nullif(F.regexp_extract(tag, r'(?i)content="([^"]*)"', 1), F.lit(""))


def article_markdown(title: Column, body: Column, url: Column, author: Column | None = None, published: Column | None = None, site: Column | None = None) -> Column:
    """A heading, what is known of the source, the link, the text. The labels are fixed values."""
    bits = [F.concat(F.lit(label), c) for label, c in (("作者：", author), ("发布时间：", published), ("来源：", site)) if c is not None]
    known = F.concat_ws(" | ", *bits) if bits else F.lit("")
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.lit(""), F.when(known != "", F.concat(F.lit("> "), known)), F.concat(F.lit("> 原文链接："), url), F.lit(""), body)


def question_problems(questions: DataFrame) -> DataFrame:
    """(id, problem) of questions(id, question, gold_doc_ids) that are refused."""
    counts = questions.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    q = questions.join(counts, "id", "left")
    problem = F.when(F.col("id").isNull() | F.col("question").isNull(), "missing key").when(F.col("n") > 1, "repeated id").when(F.coalesce(F.size("gold_doc_ids"), F.lit(0)) <= 0, "no gold")
    return q.select("id", problem.alias("problem")).where("problem is not null")
