"""Queries of relational listings, scopes, quotas and conversation memory (B*, C*, D*, E*, F*, G*, H*, I21, K9, K23, O*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.functions import text as T
from cairnspark.operators import governance as G
from cairnspark.operators import memory as M
from cairnspark.plans.registry import LIBRARY_SQL, library, query, table

L = f"WITH {LIBRARY_SQL}"
COST = "(length(text) // 4 + 3)"


@query("c5_identifiers", "SELECT page_id, regexp_full_match(string_split(url, '/')[-1], '[0-9a-zA-Z_-]{1,64}') AS valid FROM pages")
def c5(spark, sf):
    return table(spark, sf, "pages").select("page_id", G.valid_id(F.element_at(F.split("url", "/"), -1)).alias("valid"))


@query("c2_in_filter", f"{L} SELECT doc_id, kb_id FROM library WHERE kb_id IN ('src1', 'src2') AND status IN ('completed', 'failed')")
def c2(spark, sf):
    return library(spark, sf).where(F.col("kb_id").isin("src1", "src2") & F.col("status").isin("completed", "failed")).select("doc_id", "kb_id")


@query("c6_tenant_scope", f"{L} SELECT doc_id, tenant_id, kb_id FROM library WHERE tenant_id = 'en' OR kb_id = 'src3'")
def c6(spark, sf):
    shared = spark.createDataFrame([("src3",)], "kb_id string")
    return G.scoped(library(spark, sf).select("doc_id", "tenant_id", "kb_id"), "en", shared=shared).select("doc_id", "tenant_id", "kb_id")


KB = "kb AS (SELECT c_custkey AS kb_id, CASE WHEN c_custkey % 3 = 0 THEN 't1' ELSE 't0' END AS kb_tenant, c_custkey % 7 AS owner, CASE WHEN c_custkey % 4 = 0 THEN 'organization' ELSE 'private' END AS visibility, CASE WHEN c_custkey % 8 = 0 THEN 'write' ELSE 'read' END AS org_permission, c_custkey % 5 % 3 AS g FROM customer)"


def bases(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("kb_id"), F.when(k % 3 == 0, "t1").otherwise("t0").alias("kb_tenant"), (k % 7).alias("owner"), F.when(k % 4 == 0, "organization").otherwise("private").alias("visibility"),
        F.when(k % 8 == 0, "write").otherwise("read").alias("org_permission"), (k % 5 % 3).alias("grant"), F.lit("t0").alias("tenant"), F.lit("member").alias("role"), F.lit(1).cast("long").alias("subject"), F.lit(None).cast("boolean").alias("in_scope"),
    )


@query("c7_authorisation", f"WITH {KB} SELECT kb_id, (CASE WHEN kb_tenant <> 't0' THEN CASE WHEN g >= 1 THEN 200 ELSE 404 END WHEN owner = 1 THEN 200 WHEN visibility = 'organization' THEN 200 WHEN g >= 1 THEN 200 ELSE 404 END)::INTEGER AS can_read, (CASE WHEN kb_tenant <> 't0' THEN 404 WHEN owner = 1 THEN 200 WHEN visibility = 'organization' THEN CASE WHEN org_permission = 'write' THEN 200 ELSE 403 END WHEN g >= 2 THEN 200 WHEN g = 1 THEN 403 ELSE 404 END)::INTEGER AS can_write FROM kb")
def c7(spark, sf):
    return bases(spark, sf).select("kb_id", G.decision(F.lit(False)).alias("can_read"), G.decision(F.lit(True)).alias("can_write"))


@query("c8_reader_listing", f"{L} SELECT doc_id FROM library WHERE status = 'completed'")
def c8(spark, sf):
    return library(spark, sf).where("status = 'completed'").select("doc_id")


@query("c9_name_search", "SELECT s_suppkey FROM supplier WHERE s_name ILIKE '%r#00000001%'")
def c9(spark, sf):
    return table(spark, sf, "supplier").where(F.col("s_name").ilike("%r#00000001%")).select("s_suppkey")


@query("c10_relation_label", f"WITH {KB} SELECT kb_id, CASE WHEN owner = 1 THEN 'mine' WHEN g > 0 THEN 'shared' WHEN visibility = 'organization' THEN 'org' ELSE 'others' END AS label FROM kb")
def c10(spark, sf):
    return bases(spark, sf).select("kb_id", G.relation_label(F.col("owner"), F.col("subject"), F.col("grant") > 0, F.col("visibility"), F.lit(True)).alias("label"))


@query("c11_preset_visibility", "SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0 OR c_nationkey = 3 OR c_mktsegment = 'BUILDING'")
def c11(spark, sf):
    return table(spark, sf, "customer").where((F.col("c_custkey") % 10 == 0) | (F.col("c_nationkey") == 3) | (F.col("c_mktsegment") == "BUILDING")).select("c_custkey")


@query("c13_link_validity", "SELECT event_id, (event_type <> 'error' AND ts > TIMESTAMP '2024-01-10' AND user_id % 5 < 3) AS active FROM events")
def c13(spark, sf):
    a = G.link_active(F.col("event_type") != "error", F.col("ts"), F.col("user_id") % 5, F.lit(3), F.lit("2024-01-10").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", a.alias("active"))


@query("c15_folder_upload", "WITH p AS (SELECT page_id, string_split(string_split(url, '://')[2], '/') AS parts FROM pages) SELECT DISTINCT array_to_string(parts[:i], '/') AS folder FROM p, range(1, 9) t(i) WHERE i < len(parts)")
def c15(spark, sf):
    return G.parent_folders(table(spark, sf, "pages").select(F.element_at(F.split("url", "://"), 2).alias("path")))


@query("c16_lanes", f"{L} SELECT doc_id, CASE WHEN file_size >= 2000 THEN 'slow' ELSE 'fast' END AS lane FROM library")
def c16(spark, sf):
    return library(spark, sf).select("doc_id", F.when(F.col("file_size") >= 2000, "slow").otherwise("fast").alias("lane"))


@query("c19_owner_filter", "SELECT event_id FROM events WHERE user_id = 7")
def c19(spark, sf):
    return table(spark, sf, "events").where(F.col("user_id") == 7).select("event_id")


@query("c20_attachment", "WITH x AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN 'doc_' || doc_id || '.txt' = 'doc_15.txt' THEN 0 ELSE 1 END, doc_id) AS r FROM documents) SELECT source, doc_id FROM x WHERE r = 1")
def c20(spark, sf):
    d = library(spark, sf).select(F.col("kb_id").alias("source"), "doc_id", "filename")
    w = Window.partitionBy("source").orderBy(F.lower(F.trim("filename")) != "doc_15.txt", "doc_id")
    return d.withColumn("r", F.row_number().over(w)).where("r = 1").select("source", "doc_id")


@query("c21_requested_bases", f"WITH {KB}, s AS (SELECT kb_id, kb_id % 20 AS request_id, CASE WHEN kb_tenant <> 't0' THEN CASE WHEN g >= 1 THEN 200 ELSE 404 END WHEN owner = 1 OR visibility = 'organization' OR g >= 1 THEN 200 ELSE 404 END AS st FROM kb) SELECT request_id, coalesce(arg_min(st, kb_id) FILTER (st <> 200), 200)::INTEGER AS status FROM s GROUP BY request_id")
def c21(spark, sf):
    s = bases(spark, sf).select((F.col("kb_id") % 20).alias("request_id"), F.col("kb_id").alias("pos"), G.decision(F.lit(False)).alias("status"))
    return G.first_failure(s)


@query("d4_sessions", "SELECT conv_id, count(*)::BIGINT AS n_messages FROM conversations GROUP BY conv_id")
def d4(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id").distinct().join(c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages")), "conv_id")


@query("d5_grants", "SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def d5(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "o_orderkey")


@query("d6_cross_tenant", "SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderkey % 25 <> c_nationkey")
def d6(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") % 25).alias("t"))
    return table(spark, sf, "customer").join(o, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("t") != F.col("c_nationkey"))).select("c_custkey").distinct()


@query("d7_page_enrichment", "SELECT c_custkey, n_name, r_name, coalesce(n, 0)::BIGINT AS n_orders FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def d7(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return c.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("d8_page_children", "SELECT o_orderkey, array_to_string(list_sort(list(l_linenumber)), ',') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def d8(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_linenumber")), ",").alias("lines"))
    return table(spark, sf, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "lines")


@query("d13_dangling", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def d13(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("d15_page_text_merge", "WITH p AS (SELECT doc_id AS page, text FROM documents), o AS (SELECT page_id * 3 AS page, url AS ocr FROM pages) SELECT coalesce(p.page, o.page) AS page, md5(concat_ws(chr(10), text, ocr)) AS merged FROM p FULL JOIN o ON p.page = o.page")
def d15(spark, sf):
    p = table(spark, sf, "documents").select(F.col("doc_id").alias("page"), "text")
    o = table(spark, sf, "pages").select((F.col("page_id") * 3).alias("page"), F.col("url").alias("ocr"))
    return p.join(o, "page", "full").select("page", F.md5(F.concat_ws("\n", "text", "ocr")).alias("merged"))


@query("d18_breadcrumb", "WITH RECURSIVE f AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), a AS (SELECT id, parent_id AS ancestor, 1 AS depth FROM f WHERE parent_id IS NOT NULL UNION ALL SELECT a.id, f.parent_id, depth + 1 FROM a JOIN f ON f.id = a.ancestor WHERE f.parent_id IS NOT NULL) SELECT id, ancestor, depth::INTEGER AS depth FROM a")
def d18(spark, sf):
    return G.ancestors(folders(spark, sf))


def folders(spark, sf):
    f = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    f = f.union(table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
    return f.union(table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")))


@query("d19_descendants", "SELECT 'c' || c_custkey AS id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1")
def d19(spark, sf):
    return G.descendants(folders(spark, sf), spark.createDataFrame([("r1",)], "root string")).select("id")


@query("e1_counts", f"{L} SELECT count(*)::BIGINT AS n, count(*) FILTER (status = 'completed')::BIGINT AS n_completed FROM library")
def e1(spark, sf):
    return library(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "completed", 1)).alias("n_completed"))


@query("e2_group_counts", f"{L} SELECT kb_id, status, count(*)::BIGINT AS n FROM library GROUP BY ALL")
def e2(spark, sf):
    return library(spark, sf).groupBy("kb_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("e3_used_chunks", f"{L} SELECT kb_id, coalesce(sum(chunk_count) FILTER (doc_id <> 1), 0)::BIGINT AS used FROM library GROUP BY kb_id")
def e3(spark, sf):
    return library(spark, sf).groupBy("kb_id").agg(F.coalesce(F.sum(F.when(F.col("doc_id") != 1, F.col("chunk_count"))), F.lit(0)).alias("used"))


@query("e4_capacity", f"{L}, u AS (SELECT kb_id, sum(chunk_count) AS used FROM library GROUP BY 1) SELECT kb_id, used::BIGINT AS used, round(least(1.0::DOUBLE, used / 300.0::DOUBLE), 6) AS percent, 1::BIGINT AS approx_files FROM u")
def e4(spark, sf):
    u = library(spark, sf).groupBy("kb_id").agg(F.sum("chunk_count").alias("used"))
    return u.select("kb_id", "used", *[c.alias(n) for n, c in G.capacity(F.col("used"), F.lit(300)).items()])


@query("e13_job_counters", "SELECT user_id, max(event_id % 3) AS attempt, sum(value) FILTER (event_id % 3 = 2) AS total FROM events GROUP BY user_id")
def e13(spark, sf):
    e = table(spark, sf, "events").withColumn("attempt", F.col("event_id") % 3)
    newest = F.max("attempt").over(Window.partitionBy("user_id"))
    return e.withColumn("newest", newest).groupBy("user_id").agg(F.max("newest").alias("attempt"), F.sum(F.when((F.col("attempt") == F.col("newest")) & (F.col("newest") == 2), F.col("value"))).alias("total"))


@query("e17_scope_counts", "SELECT label, len(embedding)::INTEGER AS dim, count(*)::BIGINT AS n FROM embeddings GROUP BY ALL")
def e17(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label", F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


@query("f1_visible_bases", "SELECT c_custkey FROM customer WHERE c_nationkey = 1 UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def f1(spark, sf):
    c = table(spark, sf, "customer")
    return c.where("c_nationkey = 1").select("c_custkey").union(c.where("c_mktsegment = 'BUILDING'").select("c_custkey")).union(table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey")).distinct()


@query("f2_requested_and_allowed", "SELECT c_custkey FROM customer WHERE c_nationkey = 1 AND c_custkey IN (SELECT o_custkey FROM orders)")
def f2(spark, sf):
    return table(spark, sf, "customer").where("c_nationkey = 1").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("f3_ordered_ids", "WITH x AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL), y AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first) AS place FROM x) SELECT user_id, event_type, first, place::INTEGER AS place FROM y WHERE place <= 2")
def f3(spark, sf):
    return G.ordered_ids(table(spark, sf, "events"), "user_id", "event_type", "event_id", 2)


@query("g12_fan_out_cap", "WITH x AS (SELECT DISTINCT source FROM documents) SELECT source, (SELECT count(*) > 8 FROM x) AS truncated FROM x ORDER BY source LIMIT 8")
def g12(spark, sf):
    x = table(spark, sf, "documents").select("source").distinct()
    n = x.agg((F.count(F.lit(1)) > 8).alias("truncated"))
    return x.orderBy("source").limit(8).crossJoin(n)  # one row


@query("f4_duplicate_files", f"{L} SELECT doc_id, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY kb_id, file_hash) THEN min(doc_id) OVER (PARTITION BY kb_id, file_hash) END AS first_id FROM library")
def f4(spark, sf):
    return G.duplicates(library(spark, sf).select("kb_id", "doc_id", "file_hash")).select("doc_id", "first_id")


@query("g4_paging", f"{L} SELECT doc_id, status FROM library ORDER BY doc_id DESC LIMIT 20 OFFSET 40")
def g4(spark, sf):
    return G.page(library(spark, sf).select("doc_id", "status"), [F.desc("doc_id")], 3, 20)


@query("g5_last_page", f"{L} SELECT doc_id FROM library ORDER BY doc_id LIMIT 100 OFFSET ((SELECT (count(*) - 1) // 100 * 100 FROM library))")
def g5(spark, sf):
    d = library(spark, sf).select("doc_id")
    return G.page(d, ["doc_id"], G.last_page(10**9, d.count(), 100), 100)


@query("g6_status_order", f"{L} SELECT doc_id, status FROM library ORDER BY CASE status WHEN 'completed' THEN 0 WHEN 'failed' THEN 1 WHEN 'processing' THEN 2 WHEN 'pending' THEN 3 ELSE 4 END DESC, doc_id DESC LIMIT 100")
def g6(spark, sf):
    return G.page(library(spark, sf).select("doc_id", "status"), [F.desc(G.status_order(F.col("status"))), F.desc("doc_id")], 1, 100)


@query("g7_multi_sort", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS place FROM customer ORDER BY 2 LIMIT 100")
def g7(spark, sf):
    top = table(spark, sf, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(100)
    return top.select("c_custkey", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("place"))


@query("g9_clamp", "SELECT event_id, greatest(10, least(value, 50))::DOUBLE AS held FROM events")
def g9(spark, sf):
    return table(spark, sf, "events").select("event_id", G.clamp(F.col("value"), 10, 50).cast("double").alias("held"))


@query("g11_recommended_capacity", "SELECT i::BIGINT AS gb, least(10000000, floor(floor(i * 1073741824 * 0.35::DOUBLE / 8192 / 2) / 1000) * 1000)::BIGINT AS capacity FROM range(1, 65) t(i)")
def g11(spark, sf):
    return spark.range(1, 65).select(F.col("id").alias("gb"), G.recommended_capacity(F.col("id") * 1073741824, F.lit(2)).alias("capacity"))


@query("i21_capacity_gate", f"{L}, u AS (SELECT kb_id, sum(chunk_count) AS used FROM library WHERE doc_id % 2 = 0 GROUP BY 1) SELECT doc_id, coalesce(used, 0) + chunk_count <= 120 AS accepted FROM library LEFT JOIN u USING (kb_id) WHERE doc_id % 2 = 1")
def i21(spark, sf):
    d = library(spark, sf).select("kb_id", "doc_id", F.col("chunk_count").alias("n_chunks"))
    return G.gate(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), 120).select("doc_id", "accepted")


@query("k9_config_fallback", "SELECT event_id, CASE WHEN value BETWEEN 10 AND 60 THEN value ELSE 25.0 END AS setting FROM events")
def k9(spark, sf):
    return table(spark, sf, "events").select("event_id", G.with_fallback(F.col("value"), 10, 60, 25.0).alias("setting"))


@query("k23_config_diff", "SELECT c_custkey AS id, 'balance' AS name, CAST(c_nationkey AS VARCHAR) AS old, CAST(c_nationkey % 5 AS VARCHAR) AS new FROM customer WHERE c_nationkey <> c_nationkey % 5")
def k23(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("balance").alias("name"), F.col("c_nationkey").cast("string").alias("value"))
    return G.changed_fields(c, c.withColumn("value", (F.col("value").cast("int") % 5).cast("string")))


@query("b3_idempotent_index", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS version FROM documents")
def b3(spark, sf):
    from cairnspark.sources.sinks import replace_documents

    d = table(spark, sf, "documents").select("doc_id")
    return replace_documents(d.withColumn("version", F.lit("old")), d.where("doc_id % 4 = 0").withColumn("version", F.lit("new")))


@query("b4_scoped_delete", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src1')")
def b4(spark, sf):
    from cairnspark.sources.sinks import delete_matching

    gone = table(spark, sf, "documents").where("source = 'src1'").select(F.col("doc_id").alias("vec_id"))
    return delete_matching(table(spark, sf, "embeddings").select("vec_id"), gone, ["vec_id"])


@query("b14_counter_merge", "SELECT c_custkey, (c_nationkey + coalesce(n, 0))::BIGINT AS count, last_used FROM customer LEFT JOIN (SELECT user_id, count(*) AS n, max(ts) AS last_used FROM events GROUP BY 1) ON user_id = c_custkey")
def b14(spark, sf):
    from cairnspark.sources.sinks import merge_counters

    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("count"), F.lit(None).cast("timestamp_ntz").alias("last_used"))
    return merge_counters(old, table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts")).withColumnRenamed("key", "c_custkey")


@query("b17_orphans", "SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def b17(spark, sf):
    return table(spark, sf, "pages").select("page_id").join(table(spark, sf, "labels").select(F.col("doc_id").alias("page_id")), "page_id", "left_anti")


@query("b19_xml_output", "SELECT item_id, '<result rank=\"' || item_id || '\">' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</result>' AS xml FROM benchmark")
def b19(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.concat(F.lit('<result rank="'), "item_id", F.lit('">'), T.xml_escape(F.col("text")), F.lit("</result>")).alias("xml"))


@query("b20_ownership_transfer", "SELECT c_custkey, CASE WHEN c_nationkey = 2 THEN 9 ELSE c_nationkey END::INTEGER AS owner FROM customer")
def b20(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_nationkey") == 2, 9).otherwise(F.col("c_nationkey")).alias("owner"))


@query("b21_batch_cancel", f"{L} SELECT doc_id, CASE WHEN kb_id = 'src1' AND status IN ('pending', 'processing') THEN 'cancelled' ELSE status END AS status FROM library")
def b21(spark, sf):
    hit = (F.col("kb_id") == "src1") & F.col("status").isin("pending", "processing")
    return library(spark, sf).select("doc_id", F.when(hit, "cancelled").otherwise(F.col("status")).alias("status"))


@query("b22_batch_retry", f"{L} SELECT doc_id, CASE WHEN file_size >= 2000 THEN 'slow' ELSE 'fast' END AS lane FROM library WHERE status = 'failed'")
def b22(spark, sf):
    return library(spark, sf).where("status = 'failed'").select("doc_id", F.when(F.col("file_size") >= 2000, "slow").otherwise("fast").alias("lane"))


@query("b23_purge_inventory", "SELECT 'documents' AS name, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def b23(spark, sf):
    out = None
    for n in ("documents", "pages", "embeddings"):
        p = table(spark, sf, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
        out = p if out is None else out.union(p)
    return out


@query("b24_interrupted_reset", f"{L} SELECT doc_id, CASE WHEN status = 'processing' THEN 'failed' ELSE status END AS status FROM library")
def b24(spark, sf):
    return library(spark, sf).select("doc_id", F.when(F.col("status") == "processing", "failed").otherwise(F.col("status")).alias("status"))


# --- conversation memory -------------------------------------------------------------------------------------


def log(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("x")).select("conv_id", "turn", "x.role", "x.text")


LOG = "log AS (SELECT conv_id, turn, x.role AS role, x.text AS text FROM (SELECT conv_id, turn, min({'role': role, 'text': text}) AS x FROM conversations GROUP BY ALL))"


@query("h5_last_turns", f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM log) SELECT conv_id, turn FROM r WHERE r <= 3")
def h5(spark, sf):
    return M.last_turns(log(spark, sf), 3).select("conv_id", "turn")


@query("h6_tail", f"WITH {LOG} SELECT conv_id, turn, turn >= coalesce(max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id), max(turn) OVER (PARTITION BY conv_id)) AS in_tail FROM log")
def h6(spark, sf):
    return log(spark, sf).select("conv_id", "turn", (F.col("turn") >= M.tail_start()).alias("in_tail"))


TOOLED = f"{LOG}, tl AS (SELECT conv_id, turn, CASE WHEN role = 'system' OR turn % 3 = 2 THEN 'tool' ELSE role END AS role, text FROM log)"


def tooled(spark, sf):
    return log(spark, sf).withColumn("role", F.when((F.col("role") == "system") | (F.col("turn") % 3 == 2), "tool").otherwise(F.col("role")))


GROUPED = f"{TOOLED}, gr AS (SELECT *, sum(CASE WHEN role = 'tool' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS grp FROM tl)"


@query("h7_tool_groups", f"WITH {GROUPED} SELECT conv_id, turn, grp FROM gr")
def h7(spark, sf):
    return tooled(spark, sf).select("conv_id", "turn", M.group_id().alias("grp"))


MARKED = f"""{GROUPED}, mk AS (SELECT *, {COST} AS cost, coalesce(max(CASE WHEN role = 'user' THEN turn END) OVER w, max(turn) OVER w) AS tail, min(turn) OVER w AS first, count(*) OVER w AS n FROM gr WINDOW w AS (PARTITION BY conv_id)),
 tt AS (SELECT conv_id, sum(cost) AS total FROM mk GROUP BY 1), gc AS (SELECT conv_id, grp, sum(CASE WHEN turn > first AND turn < tail THEN cost ELSE 0 END) AS c, sum(CASE WHEN turn > first AND turn < tail THEN 1 ELSE 0 END) AS size FROM mk GROUP BY ALL)"""


@query("o5_group_truncation", f"WITH {MARKED}, fr AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY conv_id ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM gc) SELECT mk.conv_id, turn FROM mk JOIN fr USING (conv_id, grp) JOIN tt USING (conv_id) WHERE NOT (turn > first AND turn < tail AND n > 2 AND total > 160 AND freed < total - 160)")
def o5(spark, sf):
    return M.truncate_groups(tooled(spark, sf), 200).select("conv_id", "turn")


@query("o3_keep_boundary", f"WITH {MARKED}, bd AS (SELECT conv_id, 600 - 500 - sum(CASE WHEN turn = first OR turn >= tail THEN cost ELSE 0 END) AS budget FROM mk GROUP BY 1), rn AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY grp DESC) AS run FROM gc WHERE size > 0) SELECT bd.conv_id, coalesce(sum(size) FILTER (run <= budget), 0)::BIGINT AS n_keep FROM bd LEFT JOIN rn USING (conv_id) GROUP BY ALL")
def o3(spark, sf):
    return M.keep_boundary(tooled(spark, sf), 2000)


@query("o1_usage_delta", f"WITH {LOG} SELECT conv_id, sum(CASE WHEN turn > 2 THEN {COST} ELSE 0 END)::BIGINT AS tokens FROM log GROUP BY 1")
def o1(spark, sf):
    return M.usage_delta(log(spark, sf), 2)


@query("o2_consolidate", f"WITH {LOG} SELECT conv_id, sum({COST}) > 100 AS due FROM log GROUP BY 1")
def o2(spark, sf):
    return log(spark, sf).groupBy("conv_id").agg(F.sum(T.message_tokens(F.col("text"))).alias("t")).select("conv_id", M.should_consolidate(F.col("t"), 200).alias("due"))


@query("o4_archive", f"WITH {LOG} SELECT conv_id, md5(string_agg(role || ': ' || text[:500], chr(10) ORDER BY turn)) AS rendered FROM log GROUP BY 1")
def o4(spark, sf):
    return M.render(log(spark, sf), 500).select("conv_id", F.md5("rendered").alias("rendered"))


@query("o6_round_compression", f"WITH {LOG}, r AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS round FROM log), x AS (SELECT *, max(round) OVER (PARTITION BY conv_id) AS rounds FROM r) SELECT conv_id, turn, md5(CASE WHEN role = 'assistant' AND round <= rounds - 2 THEN '[omitted]' ELSE text END) AS text FROM x")
def o6(spark, sf):
    return M.compress_rounds(log(spark, sf)).select("conv_id", "turn", F.md5("text").alias("text"))


@query("o8_reconstruct", "WITH s AS (SELECT user_id AS conv_id, event_id % 4 AS iteration, count(*) AS n FROM events GROUP BY ALL) SELECT conv_id, iteration, (n + 1)::BIGINT AS n_rows FROM s")
def o8(spark, sf):
    s = table(spark, sf, "events").select(F.col("user_id").alias("conv_id"), (F.col("event_id") % 4).alias("iteration"), F.col("event_type").alias("tool"), F.col("props").alias("arguments"))
    return M.reconstruct(s).groupBy("conv_id", "iteration").agg(F.count(F.lit(1)).alias("n_rows"))


@query("o9_history", f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM log) SELECT conv_id, md5(string_agg(role || ': ' || text[:200], chr(10) ORDER BY turn)) AS rendered FROM r WHERE r <= 6 GROUP BY 1")
def o9(spark, sf):
    return M.render(M.last_turns(log(spark, sf), 6), 200).select("conv_id", F.md5("rendered").alias("rendered"))
