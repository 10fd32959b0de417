"""Queries of the graph route and of single steps of a search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.functions import names as N
from cairnspark.functions import text as T
from cairnspark.functions import vectors as V
from cairnspark.operators import evaluation as E
from cairnspark.operators import graph as G
from cairnspark.operators import retrieval as R
from cairnspark.plans.graph import ENT, MEN, REL, entities, full, mentions, relations
from cairnspark.plans.registry import query, table
from cairnspark.plans.retrieval import COSINE
from cairnspark.providers import Graph, Providers, embedding_route, routed

NAMED = r"l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), m AS (SELECT DISTINCT doc_id, i, unnest(list_distinct(list_filter(string_split_regex(line, '[\s\p{P}]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{5,}')))) AS name FROM l WHERE trim(line) <> '')"


def line_names(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(F.trim("text") != "")
    return G.line_entities(lines, N.capital_entities)


@query("c1_hit_projection", "SELECT event_id, props, NULL::VARCHAR AS author, value AS score FROM events")
def c1(spark, sf):
    return R.project_hits(table(spark, sf, "events"), ["event_id", "props", "author"], "value")


@query("c3_predicate_merge", "SELECT event_id FROM events WHERE (event_type = 'click' OR event_type = 'view') AND (value > 50)")
def c3(spark, sf):
    return table(spark, sf, "events").where(R.merge_predicates(["event_type = 'click' or event_type = 'view'", None, "  ", "value > 50"])).select("event_id")


@query("c12_type_whitelist", f"WITH {ENT}, {REL} SELECT source, target, type FROM rel WHERE type IN ('A', 'R')")
def c12(spark, sf):
    return G.of_types(relations(spark, sf), [" A", "R", ""]).select("source", "target", "type")


@query("c18_subset_filter", f"WITH {ENT} SELECT name, type FROM ent WHERE type = 'Brand#11' OR name IN ('s1', 'p2')")
def c18(spark, sf):
    centre = spark.createDataFrame([("s1",), ("p2",)], "name string")
    return G.of_types(entities(spark, sf), ["Brand#11"], centre).select("name", "type")


@query("d11_event_pairs", f"WITH {MEN} SELECT a.event_id, b.event_id AS other, count(DISTINCT a.name)::BIGINT AS shared FROM men a JOIN men b ON a.name = b.name AND a.event_id <> b.event_id WHERE a.event_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') GROUP BY ALL")
def d11(spark, sf):
    seeds = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.col("o_orderkey").alias("event_id"))
    return G.shared_mentions(mentions(spark, sf), seeds)


@query("d16_inside_communities", f"WITH {ENT}, {REL} SELECT source, target, type FROM rel WHERE substr(source, 2)::BIGINT % 5 = substr(target, 2)::BIGINT % 5")
def d16(spark, sf):
    labels = entities(spark, sf).select("name", (F.substring("name", 2, 20).cast("long") % 5).alias("community"))
    return G.inside(relations(spark, sf), labels).select("source", "target", "type")


@query("e14_distinct_mentions", f"WITH {MEN} SELECT name, count(DISTINCT event_id)::BIGINT AS n FROM men GROUP BY name")
def e14(spark, sf):
    return mentions(spark, sf).groupBy("name").agg(F.count_distinct("event_id").alias("n"))


@query("h1_route_ranks", "SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id)::INTEGER AS rank FROM events")
def h1(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("chunk_id"), F.col("value").alias("score"))
    return R.ranked(e, ["user_id", "event_type"]).select("user_id", "event_type", F.col("chunk_id").alias("event_id"), "rank")


@query("h3_position_scores", "SELECT event_id, round(1.0::DOUBLE / row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id), 9) AS position_score FROM events")
def h3(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("chunk_id"), F.col("value").alias("score"))
    return R.position_score(e, ["user_id"]).select(F.col("chunk_id").alias("event_id"), F.round("position_score", 9).alias("position_score"))


@query("j13_coarse_rank", f"WITH q AS (SELECT label, arg_min(embedding, vec_id) AS qv FROM embeddings GROUP BY label), s AS (SELECT e.label, vec_id, CASE WHEN vec_id % 5 = 0 THEN vec_id / 1000000.0::DOUBLE ELSE {COSINE.format(a='embedding', b='qv')} END AS score FROM embeddings e JOIN q USING (label)) SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, vec_id)::INTEGER AS rank FROM s")
def j13(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query_vector"))
    rows = e.join(q, "label").select(F.col("label").alias("query_id"), F.col("vec_id").alias("ordinal"), F.when(F.col("vec_id") % 5 != 0, V.as_double(F.col("embedding"))).alias("vector"), V.as_double(F.col("query_vector")).alias("query_vector"), (F.col("vec_id") / 1000000.0).alias("base"))
    return R.coarse_rank(rows).select(F.col("ordinal").alias("vec_id"), "rank")


@query("j20_event_vectors", f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS event_id, round({COSINE.format(a='a.embedding', b='b.embedding')}, 12) AS score FROM embeddings a JOIN embeddings b ON b.label = 2 WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) AS rank FROM s) SELECT query_id, event_id, rank::INTEGER AS rank FROM r WHERE rank <= 5")
def j20(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("kb_id"))
    q = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return R.dense_topk(R.scope(v, [2]), q, 5).select("query_id", F.col("chunk_id").alias("event_id"), "rank")


@query("j21_assembled_routes", "SELECT c_custkey, 'dense' || CASE WHEN c_custkey % 2 = 0 THEN ',bm25' ELSE '' END || CASE WHEN c_custkey % 3 = 0 AND c_nationkey > 5 THEN ',graph' ELSE '' END AS routes FROM customer")
def j21(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", F.array_join(G.assembled(k % 3 == 0, F.col("c_nationkey") > 5, k % 2 == 0), ",").alias("routes"))


@query("n1_line_relations", f"WITH {NAMED}, f AS (SELECT name AS source, lead(name) OVER (PARTITION BY doc_id, i ORDER BY name) AS target FROM m) SELECT source, target, count(*)::BIGINT AS n FROM f WHERE target IS NOT NULL GROUP BY ALL")
def n1(spark, sf):
    return G.line_relations(line_names(spark, sf))


@query("n1_line_events", f"WITH {NAMED} SELECT doc_id, (i - 1)::INTEGER AS line, count(DISTINCT name)::BIGINT AS n_names FROM m GROUP BY ALL HAVING count(DISTINCT name) >= 2")
def n1_events(spark, sf):
    return G.line_events(line_names(spark, sf))


@query("n18_dispatch", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 OR c_custkey % 3 = 0 THEN 'none' WHEN c_custkey % 2 = 0 THEN 'events' ELSE 'bridge' END AS route, NOT (c_custkey % 7 = 0 OR c_custkey % 5 = 0 OR c_custkey % 3 = 0) AND c_custkey % 4 = 1 AS communities, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 OR c_custkey % 3 = 0 THEN 0 WHEN c_nationkey > 0 THEN least(c_nationkey, 20) ELSE 20 END::BIGINT AS hits FROM customer")
def n18(spark, sf):
    k = F.col("c_custkey")
    asked = F.when(k % 7 == 0, "  ").when(k % 4 == 1, "give me an overview of all of it").otherwise("who makes part 7")
    d = G.dispatch(asked, k % 5 != 0, k % 3 != 0, k % 2 == 0, T.is_global_query(asked), F.col("c_nationkey"), F.lit(20))
    return table(spark, sf, "customer").select("c_custkey", d.alias("d")).select("c_custkey", "d.route", "d.communities", "d.hits")


@query("n19_question_entities", r"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(trim(text)), '\s+'), lambda w: length(w) > 1 AND NOT regexp_full_match(w, '[\p{P}\p{S}]+'))))[1:8], ' ') AS names FROM benchmark")
def n19(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(G.question_entities(T.tokens(F.col("text"))), " ").alias("names"))


@query("n20_chunk_subtask", f"WITH {NAMED} SELECT lower(name) AS name, count(*)::BIGINT AS n_chunks, count(DISTINCT doc_id)::BIGINT AS n_docs FROM m GROUP BY lower(name)")
def n20(spark, sf):
    return G.write_subtask(line_names(spark, sf), N.normalize_name)


FIRST = "h AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events), f AS (SELECT g.user_id, min(rank) AS first FROM (SELECT DISTINCT user_id, event_id FROM events WHERE event_type = 'purchase') g LEFT JOIN (SELECT * FROM h WHERE rank <= 10) h ON h.user_id = g.user_id AND h.event_id = g.event_id GROUP BY g.user_id)"


def measured(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), F.col("value").alias("score"), "event_type")
    gold = e.where("event_type = 'purchase'").select("query_id", F.col("chunk_id").alias("doc_id")).distinct()
    return E.metrics(R.ranked(e, ["query_id"], 10), gold)


@query("p2_mrr", f"WITH {FIRST} SELECT round(avg(coalesce(1.0::DOUBLE / first, 0)), 9) AS mrr FROM f")
def p2(spark, sf):
    return measured(spark, sf).select("mrr")


@query("p3_hit_rate", f"WITH {FIRST} SELECT count(*)::BIGINT AS n_questions, round(avg(CASE WHEN first IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 9) AS hit_rate FROM f")
def p3(spark, sf):
    return measured(spark, sf).select("n_questions", "hit_rate")


@query("e15_retrieval_metrics", f"WITH {FIRST} SELECT count(*)::BIGINT AS n_questions, round(avg(CASE WHEN first <= 2 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall_2, round(avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall_5, round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall_10, round(avg(coalesce(1.0::DOUBLE / first, 0)), 9) AS mrr, round(avg(CASE WHEN first IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 9) AS hit_rate FROM f")
def e15(spark, sf):
    return measured(spark, sf)


@query("c4_partition_scope", "SELECT vec_id FROM embeddings WHERE label IN (2, 4) AND vec_id % 3 = 0")
def c4(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("kb_id"), F.when(F.col("vec_id") % 3 == 0, "pdf").otherwise("txt").alias("file_type"))
    return R.scope(v, [2, 4], ["pdf"]).select("vec_id")


@query("m2_embedding_route", "SELECT item_id AS query_id, min(item_id) OVER (PARTITION BY text) AS chunk_id FROM benchmark")
def m2(spark, sf):
    """The default embedder finds each question as its own nearest text, the first of those that repeat."""
    docs = table(spark, sf, "benchmark").select(F.col("item_id").alias("chunk_id"), "text")
    found = routed(docs, docs.withColumnRenamed("chunk_id", "query_id"), 1, Providers(routes={"dense": embedding_route(Providers().embed)}))
    return found.select("query_id", "chunk_id")


@query("m1_injected_model", "SELECT item_id, 'Answer: ' || md5(text) AS answer FROM benchmark")
def m1(spark, sf):
    p = Providers(generate=lambda prompt: F.concat(F.lit("Answer: "), F.md5(prompt)))
    return table(spark, sf, "benchmark").select("item_id", p.answer(F.col("text")).alias("answer"))


@query("m3_default_reranker", r"SELECT item_id, CASE WHEN len(list_filter(string_split_regex(lower(trim(text)), '\s+'), lambda w: length(w) > 1 AND NOT regexp_full_match(w, '[\p{P}\p{S}]+'))) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rerank FROM benchmark")
def m3(spark, sf):
    same = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("query"), F.concat(F.lit("before "), "text", F.lit(" after")).alias("content"))
    return Providers().rerank(same).select("item_id", "rerank")


@query("m4_injected_route", "SELECT item_id AS query_id, 'first' AS route, doc_id AS chunk_id, rank::INTEGER AS rank FROM benchmark, (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents ORDER BY doc_id LIMIT 3)")
def m4(spark, sf):
    def first(docs, queries, k):
        ids = [r["chunk_id"] for r in docs.select("chunk_id").orderBy("chunk_id").limit(k).collect()]
        hits = queries.select("query_id", F.posexplode(F.array(*map(F.lit, ids))).alias("pos", "chunk_id"))
        return hits.select("query_id", "chunk_id", F.lit(0.0).alias("score"), (F.col("pos") + 1).alias("rank"))

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return routed(docs, asked, 3, Providers(routes={"first": first})).select("query_id", "route", "chunk_id", "rank")


@query("m5_injected_chunker", "SELECT doc_id, (i - 1)::INTEGER AS child_index, md5(string_split(text, chr(10))[i]) AS child FROM documents, range(1, 5000) t(i) WHERE i <= len(string_split(text, chr(10)))")
def m5(spark, sf):
    p = Providers(chunk=lambda docs: docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("child_index", "child")))
    return p.chunk(table(spark, sf, "documents")).select("doc_id", "child_index", F.md5("child").alias("child"))


@query("m6_injected_loader", "SELECT page_id::VARCHAR AS path, md5(html) AS content FROM pages")
def m6(spark, sf):
    p = Providers(load=lambda session, path, kind: table(session, path, kind).select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content")))
    return p.load(spark, sf, "pages").select("path", F.md5("content").alias("content"))


@query("m10_graph_store", f"WITH {ENT}, {REL}, {MEN} SELECT 'entities' AS part, count(*)::BIGINT AS n FROM ent UNION ALL SELECT 'relations', count(*) FROM rel UNION ALL SELECT 'mentions', count(*) FROM men UNION ALL SELECT 'events', count(*) FROM orders")
def m10(spark, sf):
    g = Graph(entities(spark, sf), relations(spark, sf), table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id")), mentions(spark, sf))
    return g.sizes()


@query("m10_graph_operations", f"""WITH {ENT}, {REL}, {MEN}, ends AS (SELECT source AS name FROM rel UNION ALL SELECT target FROM rel), deg AS (SELECT e.name, e.type, count(x.name)::BIGINT AS degree FROM ent e LEFT JOIN ends x ON x.name = e.name GROUP BY ALL)
 SELECT 'search' AS op, name, 1::BIGINT AS n FROM ent WHERE contains(name, '19') UNION ALL SELECT 'overview', name, degree FROM (SELECT * FROM deg ORDER BY degree DESC, name LIMIT 20)
 UNION ALL SELECT 'detail', other, count(*) FROM (SELECT DISTINCT target AS other, type FROM rel WHERE source = 's1') GROUP BY other UNION ALL SELECT 'stats', coalesce(type, 'unknown'), count(*) FROM deg GROUP BY type
 UNION ALL SELECT 'events', event_id::VARCHAR, count(DISTINCT name) FROM men WHERE name IN ('p1', 'p2', 'p3') GROUP BY event_id""")
def m10_operations(spark, sf):
    """What users ask a graph store for, through the one interface."""
    e, r = full(spark, sf)
    g = Graph(e, r, table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id")), mentions(spark, sf))
    names = lambda *found: spark.createDataFrame([(x,) for x in found], "name string")
    row = lambda op, rows, name, n: rows.select(F.lit(op).alias("op"), F.col(name).cast("string").alias("name"), n.cast("long").alias("n"))
    parts = [
        row("search", g.search(spark.createDataFrame([(1, "19")], "pid long, pattern string")), "name", F.lit(1)),
        row("overview", g.overview(20)[0], "name", F.col("degree")),
        row("detail", g.detail(names("s1")).groupBy("other").count(), "other", F.col("count")),
        row("stats", g.stats(), "type", F.col("n")),
        row("events", g.events_of(names("p1", "p2", "p3")), "event_id", F.col("mention_count")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("p6_harness", f"WITH {FIRST}, x AS (SELECT round(avg(coalesce(1.0::DOUBLE / first, 0)), 9) AS mrr, count(*)::BIGINT AS n_questions FROM f) SELECT 'all' AS mode, n_questions, mrr FROM x UNION ALL SELECT 'first only', n_questions, (SELECT round(avg(CASE WHEN first = 1 THEN 1.0::DOUBLE ELSE 0 END), 9) FROM f) FROM x")
def p6(spark, sf):
    """The same questions under two modes, one row each."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), F.col("value").alias("score"), "event_type")
    gold = e.where("event_type = 'purchase'").select("query_id", F.col("chunk_id").alias("doc_id")).distinct()
    modes = {"all": 10, "first only": 1}
    rows = [E.metrics(R.ranked(e, ["query_id"], k), gold).select(F.lit(m).alias("mode"), "n_questions", "mrr") for m, k in modes.items()]
    return rows[0].unionByName(rows[1])
