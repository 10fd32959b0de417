"""Queries of graph operators (B6-B12, D10-D12, D16, E5, E11, G8, N*) over the star schema as a property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnspark.functions import names as N
from cairnspark.functions import vectors as V
from cairnspark.operators import communities as C
from cairnspark.operators import graph as G
from cairnspark.operators.substrings import contains_join
from cairnspark.plans.registry import query, table
from cairnspark.scratch import Scratch

ENT = "ent AS (SELECT 'p' || p_partkey AS name, p_brand AS type FROM part UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier)"
REL = "raw AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_returnflag AS type, l_orderkey AS doc_id FROM lineitem), rel AS (SELECT source, target, type, count(DISTINCT doc_id)::BIGINT AS weight, max(doc_id) AS doc_id FROM raw WHERE source IN (SELECT name FROM ent) AND target IN (SELECT name FROM ent) GROUP BY ALL)"
DEG = "ends AS (SELECT source AS name FROM rel UNION ALL SELECT target FROM rel), deg AS (SELECT e.name, e.type, count(x.name)::BIGINT AS degree FROM ent e LEFT JOIN ends x ON x.name = e.name GROUP BY ALL)"
MEN = "men AS (SELECT DISTINCT l_orderkey AS event_id, 'p' || l_partkey AS name FROM lineitem)"
GRAPH = f"{ENT}, {REL}, {DEG}"


def entities(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("name"), F.col("p_brand").alias("type"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.lit("supplier").alias("type"))
    return p.union(s).select(F.lit("kb").alias("kb_id"), "name", "type")


def relations(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(F.lit("kb").alias("kb_id"), F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.col("l_returnflag").alias("type"), F.col("l_orderkey").alias("doc_id"), F.col("l_orderkey").alias("seq"))
    return G.upsert_relations(rows, entities(spark, sf))


def full(spark, sf):
    r = relations(spark, sf)
    return G.degrees(entities(spark, sf), r), r


def mentions(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.concat(F.lit("p"), "l_partkey").alias("name")).distinct()


@query("b6_entity_upsert", "SELECT p_brand AS name, arg_min(p_type, p_partkey) AS type, array_to_string(list_sort(list_distinct(list(p_size))), ',') AS doc_ids FROM part GROUP BY p_brand")
def b6(spark, sf):
    rows = table(spark, sf, "part").select(F.lit("kb").alias("kb_id"), F.col("p_brand").alias("name"), F.col("p_type").alias("type"), F.array("p_size").alias("doc_ids"), F.col("p_partkey").alias("seq"))
    return G.upsert_entities(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")).select("name", "type", F.array_join("doc_ids", ",").alias("doc_ids"))


@query("b7_relation_upsert", f"WITH {ENT}, {REL} SELECT source, target, type, weight, doc_id FROM rel")
def b7(spark, sf):
    return relations(spark, sf).select("source", "target", "type", "weight", "doc_id")


@query("b8_degrees", f"WITH {GRAPH} SELECT name, degree FROM deg")
def b8(spark, sf):
    return full(spark, sf)[0].select("name", "degree")


@query("b9_event_upsert", f"WITH {MEN} SELECT event_id, count(*)::BIGINT AS n FROM men WHERE event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY ALL")
def b9(spark, sf):
    events = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("event_id"))
    return G.upsert_mentions(mentions(spark, sf), events, entities(spark, sf)).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("b5_event_latest", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def b5(spark, sf):
    return G.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("b10_delete_document", f"WITH {ENT}, {REL}, kept AS (SELECT * FROM rel WHERE doc_id <> 1), sup AS (SELECT 'p' || l_partkey AS name FROM lineitem WHERE l_orderkey <> 1 UNION SELECT 's' || l_suppkey FROM lineitem WHERE l_orderkey <> 1), k2 AS (SELECT * FROM kept WHERE source IN (SELECT name FROM sup) AND target IN (SELECT name FROM sup)) SELECT name, ((SELECT count(*) FROM k2 WHERE source = name) + (SELECT count(*) FROM k2 WHERE target = name))::BIGINT AS degree FROM sup")
def b10(spark, sf):
    li = table(spark, sf, "lineitem")
    ends = li.select(F.explode(F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"))).alias("name"), F.col("l_orderkey").alias("d"))
    e = ends.groupBy("name").agg(F.collect_set("d").alias("doc_ids")).withColumn("kb_id", F.lit("kb"))
    events = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").alias("doc_id"))
    return G.delete_document(F.lit(1).cast("long"), e, relations(spark, sf), events, mentions(spark, sf))["entities"].select("name", "degree")


@query("e5_graph_stats", f"WITH {GRAPH} SELECT type, count(*)::BIGINT AS n, sum(CASE WHEN degree = 0 THEN 1 ELSE 0 END)::BIGINT AS n_orphans FROM deg GROUP BY type")
def e5(spark, sf):
    return G.stats(full(spark, sf)[0])


@query("e11_name_merge", "SELECT lower(trim(p_brand)) AS name, count(*)::BIGINT AS n FROM part GROUP BY 1")
def e11(spark, sf):
    p = table(spark, sf, "part").select(N.normalize_name(F.concat(F.lit("「"), F.upper("p_brand"), F.lit("」"))).alias("name"))
    return p.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("d10_events_by_entities", f"WITH {MEN} SELECT event_id, count(DISTINCT name)::BIGINT AS mention_count FROM men WHERE name IN (SELECT 'p' || p_partkey FROM part WHERE p_size < 10) GROUP BY ALL")
def d10(spark, sf):
    seeds = table(spark, sf, "part").where("p_size < 10").select(F.concat(F.lit("p"), "p_partkey").alias("name"))
    return G.events_by_entities(mentions(spark, sf), seeds)


@query("n4_event_hops", f"WITH {MEN}, s0 AS (SELECT 1::BIGINT AS event_id UNION SELECT 2), h1 AS (SELECT DISTINCT event_id FROM men WHERE name IN (SELECT name FROM men WHERE event_id IN (SELECT event_id FROM s0)) AND event_id NOT IN (SELECT event_id FROM s0)), h2 AS (SELECT DISTINCT event_id FROM men WHERE name IN (SELECT name FROM men WHERE event_id IN (SELECT event_id FROM h1)) AND event_id NOT IN (SELECT event_id FROM s0) AND event_id NOT IN (SELECT event_id FROM h1)) SELECT event_id, 1::INTEGER AS hop FROM h1 UNION ALL SELECT event_id, 2 FROM h2")
def n4(spark, sf):
    return G.expand_events(mentions(spark, sf), spark.createDataFrame([(1,), (2,)], "event_id long"), 2)


@query("n5_ego", f"WITH {GRAPH}, u AS (SELECT source AS a, target AS b FROM rel UNION SELECT target, source FROM rel), h1 AS (SELECT DISTINCT b AS name FROM u WHERE a = 's1' AND b <> 's1'), h2 AS (SELECT DISTINCT b AS name FROM u WHERE a IN (SELECT name FROM h1) AND b <> 's1' AND b NOT IN (SELECT name FROM h1)), x AS (SELECT 's1' AS name, 0 AS hop UNION ALL SELECT name, 1 FROM h1 UNION ALL SELECT name, 2 FROM h2) SELECT name, hop::INTEGER AS hop, degree FROM x JOIN deg USING (name)")
def n5(spark, sf):
    e, r = full(spark, sf)
    return G.neighbourhood(e, r, spark.createDataFrame([("s1",)], "name string"), 2)


@query("g8_overview", f"WITH {GRAPH}, top AS (SELECT name FROM deg ORDER BY degree DESC, name LIMIT 300) SELECT source, target, type, weight FROM rel WHERE source IN (SELECT name FROM top) AND target IN (SELECT name FROM top)")
def g8(spark, sf):
    e, r = full(spark, sf)
    return G.overview(e, r, 300)[1].select("source", "target", "type", "weight")


@query("n6_overview_nodes", f"WITH {GRAPH} SELECT name, degree FROM deg ORDER BY degree DESC, name LIMIT 100")
def n6(spark, sf):
    return G.overview(*full(spark, sf), 100)[0].select("name", "degree")


@query("d12_internal_edges", f"WITH {ENT}, {REL} SELECT source, target, type FROM rel WHERE source IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0) AND target IN (SELECT 'p' || p_partkey FROM part WHERE p_size > 25)")
def d12(spark, sf):
    nodes = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("name")).union(table(spark, sf, "part").where("p_size > 25").select(F.concat(F.lit("p"), "p_partkey")))
    return G.internal_edges(relations(spark, sf), nodes).select("source", "target", "type")


@query("n7_entity_detail", f"WITH {ENT}, {REL} SELECT DISTINCT name, other, type FROM (SELECT source AS name, target AS other, type FROM rel UNION ALL SELECT target, source, type FROM rel) WHERE name IN ('s1', 'p1', 's2')")
def n7(spark, sf):
    return G.detail(relations(spark, sf), spark.createDataFrame([("s1",), ("p1",), ("s2",)], "name string"))


@query("n8_event_detail", f"WITH {MEN} SELECT o_orderkey AS event_id, o_orderstatus AS status, array_to_string(list_sort(list(name)), ',') AS names FROM orders JOIN men ON event_id = o_orderkey GROUP BY ALL")
def n8(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("status"))
    return o.join(mentions(spark, sf), "event_id").groupBy("event_id", "status").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


@query("n10_with_events", f"WITH {MEN}, n AS (SELECT 'p' || p_partkey AS name FROM part WHERE p_size = 1) SELECT name AS id, 'entity' AS node_type FROM n UNION ALL SELECT DISTINCT 'event:' || event_id, 'event' FROM men WHERE name IN (SELECT name FROM n)")
def n10(spark, sf):
    return G.with_events(table(spark, sf, "part").where("p_size = 1").select(F.concat(F.lit("p"), "p_partkey").alias("name")), mentions(spark, sf))


@query("n11_communities")
def n11(spark, sf):
    return C.louvain(*full(spark, sf)).labels


@query("n12_community_summaries")
def n12(spark, sf):
    r = Scratch(spark).keep(relations(spark, sf).select("source", "target", "weight"))  # read by the communities and by their summaries
    return C.summaries(C.louvain(entities(spark, sf), r).labels, r)


@query("n3_alias_resolution")
def n3(spark, sf):
    p = table(spark, sf, "part").select(F.lower("p_name").alias("name"), F.col("p_brand").alias("type"))
    p = Scratch(spark).keep(p.distinct())  # written, or Spark drops the distinct before that of entities and embeds every row
    e = p.union(p.select(F.concat("name", F.lit(" inc")), "type")).distinct()
    return G.resolve_aliases(e.withColumn("vector", V.hash_embedder()("name")), least=0.6)


@query("n2_event_filter", "WITH x AS (SELECT user_id AS chunk_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type <> 'error') SELECT chunk_id, event_id FROM x WHERE r <= 3")
def n2(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("chunk_id"), "event_id", F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("content"), F.array("event_type").alias("names"), F.array(F.lit("click")).alias("known"))
    return G.filter_events(e).select("chunk_id", "event_id")


RECALL = f"""{MEN}, seeds AS (SELECT s_suppkey AS query_id, l_orderkey AS event_id, max(l_quantity) AS base FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_quantity >= 50 GROUP BY ALL),
 re AS (SELECT query_id, m2.event_id, count(DISTINCT m2.name)::DOUBLE AS base FROM seeds s JOIN men m ON m.event_id = s.event_id JOIN men m2 ON m2.name = m.name GROUP BY ALL),
 re2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY base DESC, event_id) AS r FROM re WHERE (query_id, event_id) NOT IN (SELECT (query_id, event_id) FROM seeds)),
 bo AS (SELECT query_id, event_id, base, 0 AS o FROM seeds UNION ALL SELECT query_id, event_id, base, 1 FROM re2 WHERE r <= 50), pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, base DESC, event_id) AS place FROM bo),
 ch AS (SELECT query_id, event_id % 1000 AS chunk_id, min(place) AS place FROM pl WHERE place <= 15 GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, chunk_id) AS rank FROM ch)"""


@query("n14_event_recall", f"WITH {RECALL} SELECT query_id, chunk_id, rank::INTEGER AS rank, round(1.0::DOUBLE / rank, 9) AS score FROM rk WHERE rank <= 20")
def n14(spark, sf):
    li = table(spark, sf, "lineitem")
    seeds = li.where("l_quantity >= 50").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("event_id")).agg(F.max("l_quantity").alias("base"))
    chunks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), (F.col("o_orderkey") % 1000).alias("chunk_id"))
    return G.event_recall(mentions(spark, sf), chunks, seeds)


@query("n15_entity_bridge", f"WITH {MEN} SELECT 'p' || p_partkey AS name, count(DISTINCT event_id)::BIGINT AS n_chunks FROM part JOIN men ON name = 'p' || p_partkey GROUP BY ALL")
def n15(spark, sf):
    e = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("name"))
    return e.join(mentions(spark, sf), "name").groupBy("name").agg(F.count_distinct("event_id").alias("n_chunks"))


@query("n9_centre", "WITH c AS (SELECT 's' || s_suppkey AS id, s_name AS name FROM supplier), q AS (SELECT * FROM (VALUES ('s3'), ('Supplier#00000000')) t(q)), m AS (SELECT q, id, CASE WHEN id = q THEN 0 ELSE 1 END AS o FROM q JOIN c ON id = q OR contains(name, q)) SELECT q, arg_min(id, o * 1000000 + CAST(substr(id, 2) AS BIGINT)) AS id FROM m GROUP BY q")
def n9(spark, sf):
    c = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"))
    asked = spark.createDataFrame([(1, "s3"), (2, "Supplier#00000000")], "pid long, pattern string")
    inside = contains_join(c.select(F.col("s_suppkey").alias("tid"), F.col("name").alias("text")), asked).select(F.col("tid").alias("s_suppkey"), "pid")
    same = c.join(asked, F.col("id") == F.col("pattern")).select("s_suppkey", "pid")
    m = inside.union(same).distinct().join(c, "s_suppkey").join(asked.withColumnRenamed("pattern", "q"), "pid")
    return m.groupBy("q").agg(F.min(F.struct((F.col("id") != F.col("q")).alias("o"), "s_suppkey", "id"))["id"].alias("id"))


@query("p5_corpus_graph", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), m AS (SELECT DISTINCT doc_id, i, unnest(list_distinct(list_filter(string_split_regex(line, '[\\s\\p{P}]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{5,}')))) AS name FROM l WHERE trim(line) <> '') SELECT name, count(*)::BIGINT AS degree FROM m GROUP BY name".replace("\\\\", "\\"))
def p5(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.trim("line") != "")
    return lines.select(F.explode(N.capital_entities(F.col("line"))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("degree"))


@query("k2_normal_names", "SELECT s_suppkey, lower(s_name) AS name FROM supplier")
def k2(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", N.normalize_name(F.concat(F.lit(" «"), "s_name", F.lit("» "))).alias("name"))


@query("k6_lenient_json", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def k6(spark, sf):
    made = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n``` done"))
    return table(spark, sf, "events").select("event_id", F.get_json_object(N.first_json(made), "$.k").cast("long").alias("k"))


@query("k7_confidence", "SELECT event_id, CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE greatest(0, least(1, value / 100))::DOUBLE END AS confidence FROM events")
def k7(spark, sf):
    raw = F.when(F.col("event_type") == "error", "x").otherwise((F.col("value") / 100).cast("string"))
    return table(spark, sf, "events").select("event_id", N.confidence(raw).alias("confidence"))


@query("k22_rule_entities", "SELECT n_nationkey, n_name || ',星河科技' AS names FROM nation")
def k22(spark, sf):
    text = F.concat(F.lit("见「"), "n_name", F.lit("」，又见 星河科技；「"), "n_name", F.lit("」与「这个名字太长了所以不能算是一个实体名称」"))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(N.rule_entities(text), ",").alias("names"))


@query("n21_serialise", f"WITH {GRAPH}, top AS (SELECT name, degree FROM deg ORDER BY degree DESC, name LIMIT 50) SELECT name, '{{\"id\":\"' || name || '\",\"degree\":' || degree || '}}' AS node FROM top")
def n21(spark, sf):
    top = G.overview(*full(spark, sf), 50)[0]
    return top.select("name", F.to_json(F.struct(F.col("name").alias("id"), "degree")).alias("node"))
