"""Queries of vector, ranking and fusion operators (C1-C4, D1-D3, E6-E10, F*, G1-G3, G10, H1-H3, J*, P*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.functions import text as T
from cairnspark.functions import vectors as V
from cairnspark.operators import cells as K
from cairnspark.operators import evaluation as E
from cairnspark.operators import postings as P
from cairnspark.operators import retrieval as R
from cairnspark.plans.registry import query, table
from cairnspark.providers import Providers, routed
from cairnspark.scratch import Scratch, exists, maybe_broadcast

WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 1)"
DOC_TERMS = f"d AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents), t AS (SELECT doc_id, unnest(ws) AS term FROM d), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)"
QUERY_TERMS = f"q AS (SELECT DISTINCT item_id, unnest({WORDS.format('text')}) AS term FROM benchmark)"
COSINE = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"
DENSE = f"dense AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round({COSINE.format(a='a.embedding', b='b.embedding')}, 12) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0), dtop AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM dense)"
BM25 = f"""{DOC_TERMS}, {QUERY_TERMS}, s AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM d), idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, s GROUP BY term, n),
 b AS (SELECT item_id AS query_id, tf.doc_id AS chunk_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(ws) / avgdl))), 9) AS score FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN d ON d.doc_id = tf.doc_id, s GROUP BY ALL),
 btop AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM b)"""
TF = f"{DOC_TERMS}, {QUERY_TERMS}, sp AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(sqrt(tf::DOUBLE)), 9) AS score FROM q JOIN tf USING (term) GROUP BY ALL), stop AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sp)"


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("kb_id"))


def dense_hits(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    v = vectors(spark, sf)
    return R.dense_topk(v, v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector"), k)


_indexes: dict[tuple[str, str], P.Postings] = {}


def index_of(spark: SparkSession, sf: str) -> P.Postings:
    """The postings of the documents: written by the first query of a session that needs them, read by all others."""
    name = (spark.sparkContext.applicationId, sf)
    found = _indexes.get(name)
    if found is None or not exists(spark, found.path):
        found = _indexes[name] = P.append(chunks(spark, sf), f"{Scratch(spark).folder}/index")
    return found


def defaults(spark: SparkSession, sf: str) -> Providers:
    return Providers(routes=P.routes(index_of(spark, sf)))


def bm25_hits(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    return P.search(index_of(spark, sf), asked(spark, sf), k, "bm25").hits


def sparse_hits(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    return P.search(index_of(spark, sf), asked(spark, sf), k, "sparse").hits


def routes(spark: SparkSession, sf: str, k: int = 20, providers: Providers | None = None) -> DataFrame:
    return routed(chunks(spark, sf), asked(spark, sf), k, providers or defaults(spark, sf))


ROUTES = BM25 + ", " + TF.split(QUERY_TERMS + ", ")[1] + ", r AS (SELECT query_id, 'bm25' AS route, chunk_id, score, rank FROM btop WHERE rank <= 20 UNION ALL SELECT query_id, 'sparse', chunk_id, score, rank FROM stop WHERE rank <= 20)"


@query("j1_dense_topk", f"WITH {DENSE} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM dtop WHERE rank <= 10")
def j1(spark, sf):
    return dense_hits(spark, sf).withColumn("score", F.round("score", 6))


@query("j12_cosine", f"WITH p AS (SELECT vec_id, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) SELECT vec_id, round(coalesce({COSINE.format(a='a', b='b')}, 0), 6) AS score FROM p")
def j12(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("a"), "label")
    p = v.withColumn("b", F.lag("a").over(Window.partitionBy("label").orderBy("vec_id")))
    return p.select("vec_id", F.round(F.coalesce(V.cosine(F.col("a"), F.col("b")), F.lit(0.0)), 6).alias("score"))


@query("j4_scoped_dense", f"WITH {DENSE}, sc AS (SELECT dense.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dense JOIN embeddings e ON e.vec_id = chunk_id WHERE e.label IN (1, 3, 5)) SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM sc WHERE rank <= 5")
def j4(spark, sf):
    v = vectors(spark, sf)
    q = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return R.dense_topk(R.scope(v, [1, 3, 5]), q, 5).withColumn("score", F.round("score", 6))


_cells: dict[tuple[str, str], K.Cells] = {}


def cells_of(spark: SparkSession, sf: str) -> K.Cells:
    """The vectors in cells, written by the first query of a session that needs them; the labels are the knowledge bases."""
    name = (spark.sparkContext.applicationId, sf)
    if name not in _cells or not exists(spark, _cells[name].path):
        _cells[name] = K.build(vectors(spark, sf), f"{Scratch(spark).folder}/cells")
    return _cells[name]


def probing(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")


@query("j1_cell_search")
def j1_cells(spark, sf):
    """The nearest cells alone; its recall against j1_dense_topk is tested."""
    return K.search(cells_of(spark, sf), probing(spark, sf)).withColumn("score", F.round("score", 6))


@query("j4_scoped_cells", f"WITH {DENSE}, sc AS (SELECT dense.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dense JOIN embeddings e ON e.vec_id = chunk_id WHERE e.label IN (2, 4)) SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM sc WHERE rank <= 5")
def j4_cells(spark, sf):
    """Every cell of two bases; folders of other buckets are not opened."""
    return K.search(cells_of(spark, sf), probing(spark, sf), 5, share=1.0, kb_ids=[2, 4]).withColumn("score", F.round("score", 6))


@query("j17_direct_mode", f"WITH {DENSE} SELECT query_id, chunk_id, round(score, 6) AS score FROM dtop WHERE rank <= 10 AND score >= 0.2")
def j17(spark, sf):
    return dense_hits(spark, sf).where("score >= 0.2").select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("j2_sparse_topk", f"WITH {TF} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM stop WHERE rank <= 10")
def j2(spark, sf):
    return sparse_hits(spark, sf).withColumn("score", F.round("score", 6))


@query("j3_bm25", f"WITH {BM25} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM btop WHERE rank <= 10")
def j3(spark, sf):
    return bm25_hits(spark, sf).withColumn("score", F.round("score", 6))


@query("j3_term_statistics", f"WITH {DOC_TERMS} SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term")
def j3_terms(spark, sf):
    """A new index in two batches, and what it says of every term."""
    docs, folder = chunks(spark, sf), f"{Scratch(spark).folder}/index"
    P.append(docs.where("chunk_id % 3 = 0"), folder, 0)
    return P.term_stats(P.append(docs.where("chunk_id % 3 <> 0"), folder, 1))


@query("e6_rrf", f"WITH {ROUTES} SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM r GROUP BY ALL")
def e6(spark, sf):
    return R.rrf(routes(spark, sf)).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@query("e9_provenance", f"WITH {ROUTES} SELECT query_id, chunk_id, array_to_string(list_sort(list(route)), ',') AS routes, max(CASE WHEN route = 'bm25' THEN rank END)::INTEGER AS bm25_rank FROM r GROUP BY query_id, chunk_id")
def e9(spark, sf):
    return R.rrf(routes(spark, sf)).select("query_id", "chunk_id", F.array_join("routes", ",").alias("routes"), F.col("ranks")["bm25"].alias("bm25_rank"))


FUSED = f"{ROUTES}, f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) * CASE WHEN chunk_id % 4 = 0 AND chunk_id % 8 <> 0 THEN 0.8::DOUBLE ELSE 1 END AS base FROM r GROUP BY query_id, chunk_id)"


def fused(spark, sf, providers=None, found=None):
    kind = F.when(F.col("chunk_id") % 4 == 0, "table").otherwise("text")
    file_type = F.when(F.col("chunk_id") % 8 == 0, "csv").otherwise("txt")
    return R.rrf(routes(spark, sf, providers=providers) if found is None else found).select("query_id", "chunk_id", (F.col("score") * R.type_weight(kind, file_type)).alias("base"))


@query("j5_weighted_fusion", f"WITH {FUSED} SELECT query_id, chunk_id, round(base, 9) AS score FROM f")
def j5(spark, sf):
    return fused(spark, sf).select("query_id", "chunk_id", F.round("base", 9).alias("score"))


TOK = r"list_distinct(list_filter(string_split_regex(lower(trim({})), '\s+'), lambda w: length(w) > 1 AND NOT regexp_full_match(w, '[\p{{P}}\p{{S}}]+')))"
RERANKED = f"""{FUSED}, rr AS (SELECT query_id, chunk_id, base, d2.text AS content, CASE WHEN len({TOK.format('b.text')}) > 0 THEN len(list_intersect({TOK.format('b.text')}, {TOK.format('d2.text')}))::DOUBLE / len({TOK.format('b.text')}) ELSE 0 END AS rerank
 FROM f JOIN documents d2 ON d2.doc_id = chunk_id JOIN benchmark b ON b.item_id = query_id)"""


def reranked(spark, sf, providers=None, hits=None):
    """Fused hits with their texts and reranking. Texts of chunks that were hit are dealt out by chunk before they are split into tokens, each once."""
    scratch = Scratch(spark)
    providers = providers or defaults(spark, sf)
    hits = scratch.keep(fused(spark, sf, providers) if hits is None else hits)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = maybe_broadcast(hits.select("chunk_id").distinct())
    tokens = lambda name: [F.col("text").alias(name), T.tokens(F.col("text")).alias(f"{name}_tokens")]
    texts = scratch.keep(chunks(spark, sf).join(found, "chunk_id", "left_semi").repartition(n, "chunk_id").select("chunk_id", *tokens("content")))
    asked_tokens = scratch.keep(asked(spark, sf).select("query_id", *tokens("query")))
    both = hits.repartition(n, "chunk_id").join(texts.repartition(n, "chunk_id"), "chunk_id").join(asked_tokens, "query_id")
    scored = providers.rerank(both).drop("content_tokens", "query_tokens")
    return scratch.keep(scored.withColumn("rerank", R.penalised(F.col("rerank"), F.col("content"))))


@query("j6_rerank", f"WITH {RERANKED} SELECT query_id, chunk_id, round(rerank, 9) AS rerank FROM rr")
def j6(spark, sf):
    return reranked(spark, sf).select("query_id", "chunk_id", F.round("rerank", 9).alias("rerank"))


@query("j7_fragment_penalty", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS score FROM documents")
def j7(spark, sf):
    content = F.when(F.col("doc_id") % 5 == 0, " 目录 ").otherwise(F.concat(F.lit("目录 "), "text"))
    return table(spark, sf, "documents").select("doc_id", R.penalised(F.lit(1.0), content).alias("score"))


FILTERED = f"""{RERANKED}, m AS (SELECT *, max(rerank) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id) AS pos FROM rr),
 k AS (SELECT * FROM m WHERE CASE WHEN best >= 0.5 THEN rerank >= 0.5 WHEN best >= 0.35 THEN rerank >= 0.35 ELSE pos = 1 AND rerank >= 0.15 END)"""


@query("j8_soft_threshold", f"WITH {FILTERED} SELECT query_id, chunk_id, round(rerank, 9) AS rerank FROM k")
def j8(spark, sf):
    return R.soft_threshold(reranked(spark, sf)).select("query_id", "chunk_id", F.round("rerank", 9).alias("rerank"))


COMPOSED = f"""{FILTERED}, c AS (SELECT query_id, chunk_id, base, rerank, content, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id) - 1 AS place, count(*) OVER (PARTITION BY query_id) AS n FROM k),
 g AS (SELECT query_id, chunk_id, content, round(greatest(0, least(1, 0.6::DOUBLE * rerank + 0.3::DOUBLE * base + 0.1::DOUBLE * CASE WHEN n = 1 THEN 1 ELSE greatest(0.1::DOUBLE, 1 - place / n::DOUBLE) END)), 12) AS score FROM c),
 final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM g)"""


def hybrid(spark, sf, k=10, providers=None):
    """Fused, reranked, filtered and composed hits; the k best of each query."""
    return R.ranked(R.composite(R.soft_threshold(reranked(spark, sf, providers))), ["query_id"], k)


@query("j9_composite", f"WITH {COMPOSED} SELECT query_id, chunk_id, round(score, 9) AS score FROM g")
def j9(spark, sf):
    return R.composite(R.soft_threshold(reranked(spark, sf))).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@query("j14_hybrid", f"WITH {COMPOSED} SELECT query_id, chunk_id, round(score, 9) AS score, rank::INTEGER AS rank FROM final WHERE rank <= 10")
def j14(spark, sf):
    return hybrid(spark, sf).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query("j15_traced_hybrid", f"WITH {COMPOSED}, u AS (SELECT 0 AS ordinal, 'routes' AS stage, query_id FROM r UNION ALL SELECT 1, 'fused', query_id FROM f UNION ALL SELECT 2, 'filtered', query_id FROM k UNION ALL SELECT 3, 'returned', query_id FROM final WHERE rank <= 10) SELECT ordinal::INTEGER AS ordinal, stage, query_id, count(*)::BIGINT AS n FROM u GROUP BY ALL")
def j15(spark, sf):
    scratch = Scratch(spark)
    found = scratch.keep(routes(spark, sf))
    hits = scratch.keep(fused(spark, sf, found=found))
    kept = scratch.keep(R.soft_threshold(reranked(spark, sf, hits=hits)))
    return R.funnel([("routes", found), ("fused", hits), ("filtered", kept), ("returned", R.ranked(R.composite(kept), ["query_id"], 10))])


@query("j10_mmr")
def j10(spark, sf):
    return R.mmr(hybrid(spark, sf))


@query("h2_position_prior", "WITH x AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, round(CASE WHEN n = 1 THEN 1 ELSE greatest(0.1::DOUBLE, 1 - i / n::DOUBLE) END, 9) AS prior, round(1 / (1 + i)::DOUBLE, 9) AS reciprocal FROM x")
def h2(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    x = R.placed(d, "source", F.desc("n_chars"), F.col("doc_id")).withColumnRenamed("place", "i")
    return x.select("doc_id", F.round(F.when(F.col("n") == 1, 1.0).otherwise(F.greatest(F.lit(0.1), 1 - F.col("i") / F.col("n"))), 9).alias("prior"), F.round(1 / (1 + F.col("i")), 9).alias("reciprocal"))


@query("g2_topk_per_source", "WITH x AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) SELECT source, doc_id, rank::INTEGER AS rank FROM x WHERE rank <= 3")
def g2(spark, sf):
    return R.ranked(table(spark, sf, "documents").select("source", F.col("doc_id").alias("chunk_id"), "n_chars"), ["source"], 3, "n_chars").select("source", F.col("chunk_id").alias("doc_id"), "rank")


@query("g3_source_k", "SELECT n::BIGINT AS n, CASE WHEN n <= 4 THEN 30 ELSE greatest(10, 120 // n) END::BIGINT AS k FROM range(1, 30) t(n)")
def g3(spark, sf):
    return spark.range(1, 30).select(F.col("id").alias("n"), R.source_k(F.col("id"), 10).alias("k"))


@query("g10_context_packing", "WITH x AS (SELECT label_source AS query_id, doc_id, rank, '[' || rank || '] ' || text AS item FROM (SELECT source AS label_source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents)), y AS (SELECT *, sum(length(item)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM x) SELECT query_id, doc_id, used::BIGINT AS used FROM y WHERE used <= 8000")
def g10(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("query_id"), "doc_id", F.length("text").alias("size"))
    # an item takes 4 letters or more, so none past the first 2000 can fit; texts stay out of the shuffle
    few = R.first_rows(d, "query_id", "doc_id", 2000)
    placed = few.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    length = F.length(F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "))) + F.coalesce("size", F.lit(0))
    used = F.sum(length).over(Window.partitionBy("query_id").orderBy("rank")).cast("long")
    return placed.withColumn("used", used).where("used <= 8000").select("query_id", "doc_id", "used")


@query("d1_parent_expansion", "WITH p AS (SELECT doc_id // 10 AS pid, string_agg(text, chr(10) ORDER BY doc_id) AS t FROM documents WHERE doc_id // 10 % 3 <> 0 GROUP BY 1) SELECT doc_id AS chunk_id, md5(coalesce(trim(t, ' '), text)) AS content, md5(text) AS child_content FROM documents LEFT JOIN p ON p.pid = doc_id // 10")
def d1(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.expr("doc_id div 10").alias("parent_id"), F.col("text").alias("content"))
    p = d.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "content"))).alias("x")).select(F.col("parent_id").alias("chunk_id"), F.array_join(F.transform("x", lambda r: r["content"]), "\n").alias("content"))
    out = R.expand_parents(d, p.where("chunk_id % 3 = 1"), p.where("chunk_id % 3 = 2"))
    return out.select("chunk_id", F.md5("content").alias("content"), F.md5("child_content").alias("child_content"))


@query("d2_hit_enrichment", "WITH h AS (SELECT vec_id AS chunk_id, vec_id % 400 AS doc_id FROM embeddings) SELECT chunk_id, coalesce('doc_' || d.doc_id || '.txt', 'session_' || h.doc_id) AS filename, CASE WHEN d.doc_id IS NOT NULL THEN 'knowledge_base' ELSE 'session' END AS source_type FROM h LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 <> 0) d ON d.doc_id = h.doc_id")
def d2(spark, sf):
    h = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 400).alias("doc_id"))
    d = table(spark, sf, "documents").where("doc_id % 3 <> 0").select("doc_id", F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("name"))
    s = h.select("doc_id").distinct().select("doc_id", F.concat(F.lit("session_"), "doc_id").alias("session_name"))
    both = h.join(d, "doc_id", "left").join(s, "doc_id", "left")
    return both.select("chunk_id", F.coalesce("name", "session_name").alias("filename"), F.when(F.col("name").isNotNull(), "knowledge_base").otherwise("session").alias("source_type"))


@query("d3_references", r"SELECT doc_id, md5(CASE WHEN regexp_replace('[' || source || '] ' || text, '^\[[^\]]*\]\s*', '')[:500] = text THEN '' ELSE regexp_replace('[' || source || '] ' || text, '^\[[^\]]*\]\s*', '')[:500] END) AS child, md5(text[:1500]) AS parent FROM documents")
def d3(spark, sf):
    child = F.substring(T.without_prefix(F.concat(F.lit("["), "source", F.lit("] "), "text")), 1, 500)
    return table(spark, sf, "documents").select("doc_id", F.md5(F.when(child == F.col("text"), "").otherwise(child)).alias("child"), F.md5(F.substring("text", 1, 1500)).alias("parent"))


@query("d14_query_fan_out", "SELECT item_id, source, count(*)::BIGINT AS n FROM benchmark, documents GROUP BY ALL")
def d14(spark, sf):
    n = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    listed = R.source_list(n)
    return table(spark, sf, "benchmark").select("item_id", F.explode(listed).alias("x")).select("item_id", "x.source", "x.n")


@query("e7_best_per_chunk", "WITH x AS (SELECT user_id, event_type, value, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r FROM events) SELECT user_id, event_type, event_id, value FROM x WHERE r = 1")
def e7(spark, sf):
    x = table(spark, sf, "events").select("user_id", "event_type", "value", "event_id")
    return R.best_per_chunk(x, ["user_id", "event_type"], "value", "event_id").select("user_id", "event_type", "event_id", "value")


@query("e8_weighted_merge", "WITH x AS (SELECT user_id, event_id, value * CASE event_type WHEN 'purchase' THEN 2.0::DOUBLE WHEN 'view' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS score FROM events), y AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS r FROM x) SELECT user_id, event_id, score FROM y WHERE r = 1")
def e8(spark, sf):
    weight = F.when(F.col("event_type") == "purchase", 2.0).when(F.col("event_type") == "view", 0.5).otherwise(1.0)
    x = table(spark, sf, "events").select("user_id", "event_id", (F.col("value") * weight).alias("score"))
    return R.best_per_chunk(x, ["user_id"], "score", "event_id")


@query("f6_candidate_merge", "WITH x AS (SELECT user_id AS id, 0 AS o FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, 1 FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, 2 FROM events) SELECT id, min(o)::INTEGER AS source FROM x GROUP BY id")
def f6(spark, sf):
    e = table(spark, sf, "events")
    parts = [e.where("event_type = 'click'"), e.where("event_type = 'view'"), e]
    x = None
    for i, p in enumerate(parts):
        p = p.select(F.col("user_id").alias("id"), F.lit(i).alias("o"))
        x = p if x is None else x.union(p)
    return x.groupBy("id").agg(F.min("o").alias("source"))


@query("f7_seen_chunks", "SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type) < event_id AS already_retrieved FROM events")
def f7(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("call_no"), F.col("event_type").alias("chunk_id"), F.col("props").alias("content"))
    return R.seen_before(e).select(F.col("call_no").alias("event_id"), "already_retrieved")


@query("f8_chunk_ranks", "WITH x AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first)::INTEGER AS rank FROM x")
def f8(spark, sf):
    x = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return x.select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("first")).alias("rank"))


@query("j16_multi_source", f"WITH {FUSED}, w AS (SELECT query_id, chunk_id, source, base * CASE WHEN source = 'src0' THEN 1.5::DOUBLE ELSE 1 END AS score FROM f JOIN documents dd ON dd.doc_id = chunk_id), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM w) SELECT query_id, chunk_id, source, round(score, 9) AS score, rank::INTEGER AS rank FROM z WHERE rank <= 10")
def j16(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    w = fused(spark, sf).join(d, "chunk_id").withColumn("score", F.round(F.col("base") * F.when(F.col("source") == "src0", 1.5).otherwise(1.0), 12))
    return R.ranked(w, ["query_id"], 10).select("query_id", "chunk_id", "source", F.round("score", 9).alias("score"), "rank")


@query("c17_route", "SELECT event_id, CASE WHEN event_type = 'click' THEN CASE WHEN value > 50 THEN 'chitchat' WHEN user_id % 2 = 0 OR user_id % 3 = 0 THEN 'agent' ELSE 'none' END WHEN value > 50 THEN 'chitchat' WHEN user_id % 3 = 0 THEN 'multi_kb' WHEN user_id % 2 = 0 THEN 'single_kb' ELSE 'none' END AS route FROM events")
def c17(spark, sf):
    n_kbs, files, skip = F.when(F.col("user_id") % 2 == 0, 1).otherwise(0), F.col("user_id") % 3 == 0, F.col("value") > 50
    return table(spark, sf, "events").select("event_id", E.route(F.when(F.col("event_type") == "click", "agent").otherwise("hybrid"), n_kbs, files, skip).alias("route"))


GOLD = "gold AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def gold(spark, sf):
    """Documents that hold a benchmark item; candidates share a run of three words with it, then the whole item is looked for."""
    return E.containment(chunks(spark, sf), asked(spark, sf)).select("query_id", F.col("chunk_id").alias("doc_id"))


@query("d9_contains_join", f"WITH {GOLD} SELECT query_id, doc_id FROM gold")
def d9(spark, sf):
    return gold(spark, sf)


METRICS = "m AS (SELECT g.query_id, min(CASE WHEN g.doc_id = h.chunk_id THEN h.rank END) AS first FROM (SELECT * FROM gold) g LEFT JOIN (SELECT * FROM btop WHERE rank <= 10) h ON h.query_id = g.query_id GROUP BY g.query_id)"


@query("p1_retrieval_metrics", f"WITH {BM25}, {GOLD}, {METRICS} SELECT count(*)::BIGINT AS n_questions, round(avg(CASE WHEN first <= 2 THEN 1.0 ELSE 0 END), 9) AS recall_2, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 9) AS recall_5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0 END), 9) AS recall_10, round(avg(coalesce(1.0::DOUBLE / first, 0)), 9) AS mrr, round(avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0 END), 9) AS hit_rate FROM m")
def p1(spark, sf):
    return E.metrics(bm25_hits(spark, sf), Scratch(spark).keep(gold(spark, sf)))


TWO = f"{ROUTES}, {GOLD}, a AS (SELECT g.query_id, min(CASE WHEN g.doc_id = h.chunk_id THEN h.rank END) AS first FROM gold g LEFT JOIN (SELECT * FROM btop WHERE rank <= 10) h ON h.query_id = g.query_id GROUP BY 1), b2 AS (SELECT g.query_id, min(CASE WHEN g.doc_id = h.chunk_id THEN h.rank END) AS first FROM gold g LEFT JOIN (SELECT * FROM stop WHERE rank <= 10) h ON h.query_id = g.query_id GROUP BY 1)"
RR = "avg(coalesce(1.0::DOUBLE / first, 0))"
IN_10 = "avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0 END)"


@query("p4_two_modes", f"WITH {TWO} SELECT round((SELECT {RR} FROM a) - (SELECT {RR} FROM b2), 9) AS mrr_delta, round((SELECT {IN_10} FROM a) - (SELECT {IN_10} FROM b2), 9) AS recall_10_delta")
def p4(spark, sf):
    g = Scratch(spark).keep(gold(spark, sf))  # read four times
    return E.delta(E.metrics(bm25_hits(spark, sf), g), E.metrics(sparse_hits(spark, sf), g))
