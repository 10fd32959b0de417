"""Queries of source operators (A*) that the driver's tables can feed; file readers are tested on written fixtures."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from cairnspark.batches import in_slices
from cairnspark.operators.chunking import key_values, table_chunks
from cairnspark.plans.registry import query, table
from cairnspark.sources import loaders as A


@query("a4_rows_per_chunk", "WITH w AS (SELECT 1 + length(s_suppkey::VARCHAR) + 3 + length(s_name) + 3 AS w FROM (SELECT * FROM supplier LIMIT 200)), x AS (SELECT list_sort(list(w)) AS w FROM w) SELECT greatest(1, least(30, floor((5000 - 34) / w[least(floor(len(w) * 0.9)::BIGINT, len(w) - 1) + 1]::DOUBLE)))::BIGINT AS n FROM x")
def a4(spark, sf):
    return A.rows_per_chunk(table(spark, sf, "supplier").select("s_suppkey", "s_name"), ["s_suppkey", "s_name"])


@query("a5_markdown_groups", "WITH r AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation) SELECT n_regionkey, (i // 2)::BIGINT AS parent, '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS text FROM r GROUP BY ALL")
def a5(spark, sf):
    return table_chunks(table(spark, sf, "nation"), "n_regionkey", "n_nationkey", ["n_nationkey", "n_name"], 2).select("n_regionkey", "parent", "text")


@query("a6_key_values", "SELECT s_suppkey, 's_suppkey: ' || s_suppkey || chr(10) || 's_name: ' || s_name AS lines FROM supplier")
def a6(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", key_values(["s_suppkey", "s_name"]).alias("lines"))


@query("a15_web_text", r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS body FROM pages")
def a15(spark, sf):
    return table(spark, sf, "pages").select("page_id", A.page_title(F.col("html")).alias("title"), F.md5(A.page_text(F.col("html"))).alias("body"))


@query("a16_share_image", "SELECT page_id, 'https://i.example/' || page_id || '.png' AS image FROM pages")
def a16(spark, sf):
    made = F.concat(F.lit('<meta property="og:image" content="https://i.example/'), "page_id", F.lit('.png">'), "html")
    return table(spark, sf, "pages").select("page_id", A.share_image(made).alias("image"))


@query("a17_article_markdown", "SELECT page_id, md5('# Page ' || page_id || chr(10) || chr(10) || '> 来源：' || string_split(url, '/')[3] || chr(10) || '> 原文链接：' || url || chr(10) || chr(10) || html) AS article FROM pages")
def a17(spark, sf):
    site = F.element_at(F.split("url", "/"), 3)
    made = A.article_markdown(F.concat(F.lit("Page "), "page_id"), F.col("html"), F.col("url"), site=site)
    return table(spark, sf, "pages").select("page_id", F.md5(made).alias("article"))


@query("a18_relational_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderstatus = 'F'")
def a18(spark, sf):
    return table(spark, sf, "orders").where((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_totalprice")


@query("a19_vector_projection", "SELECT vec_id, label FROM embeddings WHERE label IN (1, 2)")
def a19(spark, sf):
    return table(spark, sf, "embeddings").where("label in (1, 2)").select("vec_id", "label")


@query("a21_question_checks", "SELECT item_id, 'no gold' AS problem FROM benchmark WHERE item_id % 4 = 0")
def a21(spark, sf):
    gold = F.when(F.col("item_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("d")))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), gold.alias("gold_doc_ids"))
    return A.question_problems(q).withColumnRenamed("id", "item_id")


@query("a23_topology", "SELECT len(embedding)::INTEGER AS dim, label % 4 AS bucket, count(*)::BIGINT AS n FROM embeddings GROUP BY ALL")
def a23(spark, sf):
    return table(spark, sf, "embeddings").groupBy(F.size("embedding").alias("dim"), (F.col("label") % 4).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def archived(rows, member, body):
    """Archives(path, content) with one XML member made of the lines of rows(path, lines)."""

    def pack(lines):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            z.writestr(member, body([escape(x) for x in lines]))
        return raw.getvalue()

    def run(batches):
        for b in in_slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack(x) for x in b.column(1).to_pylist()], pa.binary())], ["path", "content"])

    return rows.select("path", "lines").mapInArrow(run, "path string, content binary")


def text_lines(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))


@query("a9_docx_text", "SELECT doc_id::VARCHAR AS path, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10) || chr(10))) AS content FROM documents")
def a9(spark, sf):
    files = archived(text_lines(spark, sf), "word/document.xml", lambda x: '<d xmlns:w="w">' + "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in x) + "</d>")
    return A.parsed(files, "docx").select("path", F.md5("content").alias("content"))


@query("a10_pptx_text", "SELECT doc_id::VARCHAR AS path, md5('[Slide 1]' || chr(10) || array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10))) AS content FROM documents")
def a10(spark, sf):
    files = archived(text_lines(spark, sf), "ppt/slides/slide1.xml", lambda x: '<s xmlns:a="a">' + "".join(f"<a:t>{t}</a:t>" for t in x) + "</s>")
    return A.parsed(files, "pptx").select("path", F.md5("content").alias("content"))


@query("a7_xlsx_text", "SELECT n_regionkey::VARCHAR AS path, '[Sheet 1]' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS content FROM nation GROUP BY n_regionkey")
def a7(spark, sf):
    line = F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name")
    rows = table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("string").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda x: x["l"]).alias("lines"))
    sheet = lambda x: "<w xmlns=\"w\"><sheetData>" + "".join("<row>" + "".join(f"<c><v>{v}</v></c>" for v in r.split("\t")) + "</row>" for r in x) + "</sheetData></w>"
    return A.parsed(archived(rows, "xl/worksheets/sheet1.xml", sheet), "xlsx").select("path", "content")


def read_page(path):
    if path.endswith("3"):
        raise OSError(path)
    return "text of " + path


@query("a13_recognised_pages", "SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 10 = 3 THEN 'fallback' ELSE 'text of ' || page_id END AS content FROM pages")
def a13(spark, sf):
    rows = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("").alias("content"), F.lit(True).alias("flag"))
    return A.recognise(rows, read_page, lambda path: "fallback").select("path", "content")


@query("a14_transcribed_audio", "SELECT conv_id || '/' || turn AS path, CASE WHEN turn % 10 = 3 THEN NULL ELSE 'text of ' || conv_id || '/' || turn END AS content FROM conversations")
def a14(spark, sf):
    rows = table(spark, sf, "conversations").select(F.concat("conv_id", F.lit("/"), "turn").alias("path"), F.lit("").alias("content"), F.lit(True).alias("flag"))
    return A.recognise(rows, read_page, read_page).select("path", "content")
