"""Queries of library upkeep, task lanes and lenient parsing (A1-A3, A12, A20, B*, F5, H8, H9, K8, K15, L*, N16, N17, O7)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.operators import lifecycle as C
from cairnspark.operators.chunking import heading_trails, split_documents
from cairnspark.operators.evaluation import chunk_pages
from cairnspark.operators.retrieval import funnel, ranked
from cairnspark.plans.registry import LIBRARY_SQL, library, query, table
from cairnspark.sources import sinks as S

L = f"WITH {LIBRARY_SQL}"
TYPES = "['Txt', 'md', 'CSV', 'xlsx', 'pdf', 'doc', 'Docx', 'pptx', 'jpg', 'jpeg', 'png', 'mp3', 'wav', 'm4a', 'flac', 'ogg', 'exe', 'webp']"
NAME = f"concat('report.v2.', element_at(array{TYPES}, cast(page_id % 18 as int) + 1))".replace("array[", "array(").replace("'], ", "'), ").replace("']", "')")


@query("a1_reader_dispatch", f"""SELECT page_id, CASE WHEN k IN ('txt', 'md') THEN 'text' WHEN k IN ('csv', 'xlsx') THEN 'table' WHEN k IN ('pdf', 'doc', 'docx', 'pptx') THEN 'office'
 WHEN k IN ('jpg', 'jpeg', 'png') THEN 'image' WHEN k IN ('mp3', 'wav', 'm4a', 'flac', 'ogg') THEN 'audio' END AS reader FROM (SELECT page_id, lower(({TYPES})[page_id % 18 + 1]) AS k FROM pages)""")
def a1(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.reader(F.expr(NAME)).alias("reader"))


@query("a2_lenient_text", "SELECT doc_id, md5(text) AS text FROM documents")
def a2(spark, sf):
    broken = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))
    return table(spark, sf, "documents").select("doc_id", F.md5(C.decoded(broken)).alias("text"))


@query("a3_csv_rows", "SELECT s_suppkey, s_suppkey::VARCHAR AS id, s_name || ', \"Ltd\"' AS name FROM supplier")
def a3(spark, sf):
    line = F.to_csv(F.struct(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(', "Ltd"')).alias("name")))
    cells = C.csv_cells(line, ["id", "name"])
    return table(spark, sf, "supplier").select("s_suppkey", cells.alias("c")).select("s_suppkey", "c.id", "c.name")


@query("a12_media_rows", "SELECT page_id, '' AS content, page_id % 18 >= 11 AS is_audio FROM pages WHERE page_id % 18 BETWEEN 8 AND 15")
def a12(spark, sf):
    kind = C.reader(F.expr(NAME))
    return table(spark, sf, "pages").where(kind.isin("image", "audio")).select("page_id", F.lit("").alias("content"), (kind == "audio").alias("is_audio"))


@query("a20_object_listing", "SELECT props AS path, max(ts) AS modified, arg_max(event_id, ts) AS length FROM (SELECT * FROM events ORDER BY event_id) WHERE starts_with(props, '{\"k\": 1') GROUP BY props")
def a20(spark, sf):
    e = table(spark, sf, "events").select(F.col("props").alias("path"), F.col("ts").alias("modified"), F.col("event_id").alias("length"))
    return C.newest(e, '{"k": 1').select("path", "modified", "length")


@query("b1_vector_insert", "SELECT vec_id, 'kb1' AS kb_id, 'en' AS tenant_id, len(embedding)::INTEGER AS dim FROM embeddings")
def b1(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return S.stamped(v, "kb1", "en").select("vec_id", "kb_id", "tenant_id", "dim")


@query("b11_drop_graph", "SELECT p_brand AS kb_id, count(*)::BIGINT AS n FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1")
def b11(spark, sf):
    e = table(spark, sf, "part").select(F.col("p_brand").alias("kb_id"), F.col("p_partkey").alias("name"))
    gone = spark.createDataFrame([("Brand#11",)], "kb_id string")
    return S.delete_matching(e, gone, ["kb_id"]).groupBy("kb_id").agg(F.count(F.lit(1)).alias("n"))


@query("b12_replace_summaries", "SELECT n_regionkey AS kb_id, n_name AS summary FROM nation WHERE n_regionkey % 2 = 0 UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey % 2 = 1")
def b12(spark, sf):
    old = table(spark, sf, "nation").select(F.col("n_regionkey").alias("kb_id"), F.col("n_name").alias("summary"))
    new = table(spark, sf, "region").where("r_regionkey % 2 = 1").select(F.col("r_regionkey").alias("kb_id"), F.col("r_name").alias("summary"))
    return S.replace_documents(old, new, "kb_id")


@query("b13_cached_results", "SELECT substr(sha256(event_type || chr(31) || user_id), 1, 16) AS key, event_id FROM events WHERE ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-20'")
def b13(spark, sf):
    e = table(spark, sf, "events").withColumn("expires_at", F.col("ts") + F.expr("interval 1 hour")).withColumn("user", F.col("user_id").cast("string"))
    return S.unexpired(e, F.lit("2024-01-20").cast("timestamp_ntz")).select(S.cache_key("event_type", "user").alias("key"), "event_id")


@query("b15_audit_rows", "SELECT o_orderkey AS id, 'order' AS kind, o_orderstatus AS action FROM orders UNION ALL SELECT event_id, 'event', event_type FROM events")
def b15(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_orderstatus").alias("action"))
    return o.unionByName(table(spark, sf, "events").select(F.col("event_id").alias("id"), F.lit("event").alias("kind"), F.col("event_type").alias("action")))


@query("b16_config_upsert", "SELECT c_custkey AS key, 'segment' AS name, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS value FROM customer")
def b16(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.lit("segment").alias("name"), F.col("c_mktsegment").alias("value"))
    some = c.where("key % 3 = 0").select("key")
    patch = some.select("key", F.lit("segment").alias("name"), F.lit("new").alias("value")).unionByName(some.select("key", F.lit("colour").alias("name"), F.lit("red").alias("value")))
    return C.merge_config(c, patch, ["segment"])


@query("b18_report", "WITH m AS (SELECT event_type AS mode, avg(value) AS v FROM events GROUP BY 1), b AS (SELECT v AS w FROM m WHERE mode = 'view') SELECT mode, '| ' || mode || ' | ' || printf('%.2f', v) || ' (' || CASE WHEN v - w >= 0 THEN '+' ELSE '' END || printf('%.2f', v - w) || ') |' AS line FROM m, b")
def b18(spark, sf):
    m = table(spark, sf, "events").groupBy(F.col("event_type").alias("mode")).agg(F.avg("value").alias("mean"))
    return C.report_lines(m, "mode", ["mean"], "view")


@query("b25_missing_tables", "SELECT DISTINCT p_brand AS name FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 3)")
def b25(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("name"), "p_size")
    return C.missing_tables(p, p.where("p_size < 3"), "name")


@query("b26_keep_dimension", "SELECT vec_id FROM embeddings WHERE len(embedding) = 64")
def b26(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("dim"))
    other = v.withColumn("dim", F.lit(32))
    return C.keep_dimension(v.unionByName(other), 64).select("vec_id")


@query("f5_image_dedup", "WITH x AS (SELECT conv_id, turn, md5(text) AS h, row_number() OVER (PARTITION BY conv_id, md5(text) ORDER BY turn) AS r FROM conversations) SELECT conv_id, turn, h FROM x WHERE r = 1")
def f5(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.md5("text").alias("h"))
    return c.groupBy("conv_id", "h").agg(F.min("turn").alias("turn"))


COST = "(length(text) // 4 + 3)"


@query("h8_release", f"WITH x AS (SELECT conv_id, turn, sum({COST}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM conversations) SELECT conv_id, turn, coalesce(s, 0) < 60 AS gone FROM x")
def h8(spark, sf):
    cost = F.floor(F.length("text") / 4) + 3
    return C.release(table(spark, sf, "conversations"), cost, F.lit(60)).select("conv_id", "turn", "gone")


@query("h9_rounds", "SELECT conv_id, turn, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS round FROM conversations")
def h9(spark, sf):
    return C.rounds(table(spark, sf, "conversations")).select("conv_id", "turn", "round")


@query("o7_redact_results", "WITH x AS (SELECT *, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS k FROM conversations), y AS (SELECT *, max(k) OVER (PARTITION BY conv_id) AS m FROM x) SELECT conv_id, turn, md5(CASE WHEN role = 'assistant' AND k < m THEN '[omitted]' ELSE text END) AS text FROM y")
def o7(spark, sf):
    return C.redact_old_results(table(spark, sf, "conversations")).select("conv_id", "turn", F.md5("text").alias("text"))


@query("k8_intents", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'chitchat' ELSE 'kb_search' END AS intent, CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 3 = 1 THEN event_type ELSE props END AS rewrite, 'a,b c' AS names FROM events")
def k8(spark, sf):
    said = F.when(F.col("event_type") == "view", " ChitChat ").otherwise(F.col("event_type"))
    longer = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.repeat(F.col("event_type"), 60))
    answer = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(said.alias("intent"), longer.alias("rewrite_query"))), F.lit("\n```\ndone"))
    names = C.name_list(F.lit('Names:\n["a", " b c ", "", "a"] done'))
    return table(spark, sf, "events").select("event_id", C.intent(answer).alias("intent"), C.rewrite(answer, F.col("props")).alias("rewrite"), F.array_join(names, ",").alias("names"))


@query("k15_progress", "SELECT event_id, CASE event_type WHEN 'view' THEN 10 + floor(least(value, 80) / 80 * 20) WHEN 'click' THEN 50 + floor(least(value, 80) / 80 * 40) ELSE 100 END::INTEGER AS progress FROM events")
def k15(spark, sf):
    stage = F.when(F.col("event_type") == "view", "ocr").when(F.col("event_type") == "click", "embed").otherwise("index")
    total = F.when(F.col("event_type").isin("view", "click"), 80.0).otherwise(0.0)
    return table(spark, sf, "events").select("event_id", C.progress(stage, F.col("value"), total).alias("progress"))


@query("l4_reclaim", "SELECT user_id, count(*)::BIGINT AS deliveries, max(ts) AS last FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0) GROUP BY user_id HAVING max(ts) <= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 60 SECOND")
def l4(spark, sf):
    e = table(spark, sf, "events")
    return C.reclaim(e, e.where("event_type = 'purchase' and event_id % 2 = 0"), "user_id", F.lit("2024-01-30 12:00:00"), 60)


@query("l6_retries", "SELECT event_id, CASE WHEN event_type <> 'signup' AND user_id % 6 <= 3 THEN 'retry' ELSE 'dead' END AS outcome, CASE WHEN event_type <> 'signup' AND user_id % 6 <= 3 THEN ts + to_seconds(CASE user_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END) END AS not_before FROM events")
def l6(spark, sf):
    return C.retries(table(spark, sf, "events"), F.col("user_id") % 6, F.col("event_type") != "signup").select("event_id", "outcome", "not_before")


@query("l8_lanes", f"{L}, x AS (SELECT doc_id, kb_id, CASE WHEN file_size >= 2000 THEN 'slow' ELSE 'fast' END AS lane FROM library WHERE status <> 'completed') SELECT doc_id, lane, row_number() OVER (PARTITION BY kb_id, lane ORDER BY doc_id) <= CASE lane WHEN 'fast' THEN 3 ELSE 1 END AS admitted FROM x")
def l8(spark, sf):
    d = library(spark, sf).where("status <> 'completed'").select("doc_id", "kb_id", F.when(F.col("file_size") >= 2000, "slow").otherwise("fast").alias("lane"))
    return C.admit(d, ["kb_id"], "doc_id", "lane", {"fast": 3, "slow": 1}).select("doc_id", "lane", "admitted")


@query("l16_micro_batches", "SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4)::BIGINT AS batch FROM conversations")
def l16(spark, sf):
    return C.micro_batches(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn", 4)


@query("l17_queue_stats", "SELECT event_type, count(*)::BIGINT AS n, min(ts) AS oldest, max(ts) AS newest, count(DISTINCT user_id)::BIGINT AS consumers FROM events GROUP BY 1")
def l17(spark, sf):
    return C.queue_stats(table(spark, sf, "events"), "event_type", "ts", "user_id")


@query("n16_job_ledger", f"{L} SELECT doc_id, status, chunk_count FROM library WHERE status IN ('completed', 'failed') ORDER BY chunk_count DESC, doc_id LIMIT 50")
def n16(spark, sf):
    return library(spark, sf).where(F.col("status").isin("completed", "failed")).orderBy(F.desc("chunk_count"), "doc_id").limit(50).select("doc_id", "status", "chunk_count")


@query("n17_config_merge", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE '7' END AS k, 'true' AS enabled, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 2 END::INTEGER AS n FROM events")
def n17(spark, sf):
    patch = F.when(F.col("event_id") % 2 == 0, '{"enabled": true, "k": null}').otherwise('{"enabled": true, "k": 7}')
    m = C.merge_json(F.col("props"), patch)
    return table(spark, sf, "events").select("event_id", m.alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["enabled"].alias("enabled"), F.size("m").alias("n"))


@query("g1_best_of_group", "WITH x AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) SELECT user_id, event_id, value AS score FROM x WHERE r <= 3")
def g1(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("chunk_id"), F.col("value").alias("score"))
    return ranked(e, ["user_id"], 3).select("user_id", F.col("chunk_id").alias("event_id"), "score")


@query("i26_enricher", "SELECT doc_id, md5(text) AS text FROM documents")
def i26(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5("text").alias("text"))


@query("i7_heading_parts", "WITH n AS (SELECT n_regionkey AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name)::INTEGER AS part, '## ' || n_name || chr(10) || 'text of ' || n_name AS text FROM nation) SELECT r_regionkey::BIGINT AS doc_id, 0::INTEGER AS part, '# ' || r_name AS text FROM region UNION ALL SELECT doc_id, part, text FROM n")
def i7(spark, sf):
    return split_documents(outlines(spark, sf), "heading")


@query("i8_structure_parts", "SELECT r_regionkey::BIGINT AS doc_id, (i - 1)::INTEGER AS part, list_extract(['preface of ' || r_name, '1. first', '第二条 second', '原告 third', '[Image] fourth', '（三）fifth'], i) AS text FROM region, range(1, 7) t(i)")
def i8(spark, sf):
    text = F.concat(F.lit("preface of "), "r_name", F.lit("\n1. first\n第二条 second\n原告 third\n[Image] fourth\n（三）fifth"))
    return split_documents(table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), text.alias("text")), "structure")


@query("i9_table_parts", "SELECT r_regionkey::BIGINT AS doc_id, (i - 1)::INTEGER AS part, list_extract(['Before ' || r_name, '| a | b |' || chr(10) || '| - | - |' || chr(10) || '| 1 | 2 |', 'Between', '<table><tr><td>x</td></tr></table>', 'After'], i) AS text FROM region, range(1, 6) t(i)")
def i9(spark, sf):
    text = F.concat(F.lit("Before "), "r_name", F.lit("\n| a | b |\n| - | - |\n| 1 | 2 |\nBetween\n<table><tr><td>x</td></tr></table>\nAfter"))
    return split_documents(table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), text.alias("text")), "table")


@query("i11_normalised_parts", "SELECT r_regionkey::BIGINT AS doc_id, (i - 1)::INTEGER AS part, list_extract(['One ' || r_name || chr(10) || chr(10) || 'Two', '| a | b |' || chr(10) || '| - | - |' || chr(10) || '| 1 | 2 |', 'Three', repeat('x', 2500), repeat('x', 500), 'Four'], i) AS text FROM region, range(1, 7) t(i)")
def i11(spark, sf):
    text = F.concat(F.lit("One "), "r_name", F.lit("\n\nTwo\n\n| a | b |\n| - | - |\n| 1 | 2 |\n\nThree\n\n" + "x" * 3000 + "\n\nFour"))
    return split_documents(table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), text.alias("text")), "normal")


@query("h4_heading_trails", "SELECT n_regionkey::BIGINT AS doc_id, 'text of ' || n_name AS text, '# ' || r_name || ' > ## ' || n_name AS trail FROM nation JOIN region ON r_regionkey = n_regionkey")
def h4(spark, sf):
    return heading_trails(outlines(spark, sf)).select("doc_id", "text", "trail")


@query("h4_plain_heading_trails", "SELECT r_regionkey::BIGINT AS doc_id, list_extract(['preface', 'one', 'two', 'three'], i) AS text, list_extract(['', 'Chapter 1 ' || r_name, 'Chapter 1 ' || r_name || ' > 第二节', 'Kapitel IV'], i) AS trail FROM region, range(1, 5) t(i)")
def h4_plain(spark, sf):
    text = F.concat(F.lit("preface\nChapter 1 "), "r_name", F.lit("\none\n第二节\ntwo\nKapitel IV\nthree"))
    return heading_trails(table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), text.alias("text"))).select("doc_id", "text", "trail")


def outlines(spark, sf):
    """A text with Markdown headings for each region: its nations, each with a line."""
    part = F.concat(F.lit("\n## "), "n_name", F.lit("\ntext of "), "n_name")
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(part)), "").alias("body"))
    r = table(spark, sf, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    return r.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("# "), "r_name", "body").alias("text"))


@query("d17_page_anchor", "WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS pages, substr(trim(string_split(text, chr(10))[len(string_split(text, chr(10))) // 2 + 1]), 1, 50) AS anchor FROM documents), y AS (SELECT doc_id, i AS page, instr(pages[i], anchor) AS pos FROM x, range(1, 3000) t(i) WHERE i <= len(pages) AND anchor <> '') SELECT doc_id, min(struct_pack(p := pos, g := page)).g::INTEGER AS page FROM y WHERE pos > 0 GROUP BY doc_id")
def d17(spark, sf):
    pages = F.split("text", "\n")
    d = table(spark, sf, "documents").select("doc_id", pages.alias("pages"), F.element_at(pages, (F.floor(F.size(pages) / 2) + 1).cast("int")).alias("chunk"))
    return chunk_pages(d)


@query("e10_funnel", "SELECT 0::INTEGER AS ordinal, 'recalled' AS stage, user_id AS query_id, count(*)::BIGINT AS n FROM events GROUP BY user_id UNION ALL SELECT 1, 'filtered', user_id, count(*) FROM events WHERE value > 30 GROUP BY user_id UNION ALL SELECT 2, 'reranked', user_id, count(*) FROM events WHERE value > 60 GROUP BY user_id")
def e10(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), "value")
    return funnel([("recalled", e), ("filtered", e.where("value > 30")), ("reranked", e.where("value > 60"))])


@query("n13_summary_chunks", "WITH c AS (SELECT p_brand AS community, count(*)::BIGINT AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, community)::INTEGER AS rank FROM c ORDER BY rank LIMIT 10) SELECT 'community:' || community AS chunk_id, community || ': ' || n || ' members' AS content, rank, round(1.0::DOUBLE / rank, 9) AS score FROM r")
def n13(spark, sf):
    c = table(spark, sf, "part").groupBy(F.col("p_brand").alias("community")).agg(F.count(F.lit(1)).alias("n"))
    top = c.orderBy(F.desc("n"), "community").limit(10)  # the summaries that a question reads
    placed = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "community")))
    return placed.select(F.concat(F.lit("community:"), "community").alias("chunk_id"), F.concat("community", F.lit(": "), "n", F.lit(" members")).alias("content"), "rank", F.round(1 / F.col("rank"), 9).alias("score"))


PARTS = "SELECT r_regionkey::BIGINT AS doc_id, (i - 1)::INTEGER AS part, list_extract({}, i) AS text FROM region, range(1, {}) t(i)"


def child_rows(spark, sf, text):
    return split_documents(table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), text.alias("text")), "child")


@query("i13_child_parts", PARTS.format("['1. ' || repeat('a', 300), '2. ' || repeat('b', 300) || chr(10) || '3. ' || r_name, '第一章 c' || chr(10) || repeat('d', 240)]", 4))
def i13(spark, sf):
    return child_rows(spark, sf, F.concat(F.lit("1. " + "a" * 300 + "\n2. " + "b" * 300 + "\n3. "), "r_name", F.lit("\n第一章 c\n" + "d" * 240)))


@query("h11_tiny_children", PARTS.format("['1. ' || r_name || chr(10) || '2. x' || chr(10) || '3. y', '第二章 z' || chr(10) || '4. w']", 3))
def h11(spark, sf):
    return child_rows(spark, sf, F.concat(F.lit("1. "), "r_name", F.lit("\n2. x\n3. y\n第二章 z\n4. w")))


@query("i12_sentence_parts", PARTS.format("['One ' || r_name || '. ' || repeat('a', 2480) || '.', repeat('b', 2500), repeat('b', 100) || '! Last.']", 4))
def i12(spark, sf):
    return split_rows(spark, sf, F.concat(F.lit("One "), "r_name", F.lit(". " + "a" * 2480 + "." + "b" * 2600 + "! Last.")), "sentence")


@query("i14_fixed_windows", "SELECT r_regionkey::BIGINT AS doc_id, (i - 1)::INTEGER AS part, CASE i WHEN 1 THEN repeat('a', 440) || '.' ELSE repeat('a', 69) || '.' || r_name || repeat('b', 30) END AS text FROM region, range(1, 3) t(i)")
def i14(spark, sf):
    return split_rows(spark, sf, F.concat(F.lit("a" * 440 + "."), "r_name", F.lit("b" * 30)), "fixed")


def split_rows(spark, sf, text, how):
    return split_documents(table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), text.alias("text")), how)
