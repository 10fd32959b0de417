"""Property graphs as four DataFrames: entities, relations, events and mentions.

Keys: entities(kb_id, name), relations(kb_id, source, target, type), events(kb_id, event_id), mentions(event_id, name).
Upserts are unions reduced by key, so a merge is one shuffle and repeated evidence changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.functions.vectors import cosine
from cairnspark.operators.communities import louvain
from cairnspark.operators.substrings import contains_join
from cairnspark.scratch import Scratch

#: A name is heavy that HEAVY_EVENTS events and so large a share of all events mention; heavy names are bits of a long.
HEAVY_SHARE, HEAVY_EVENTS, HEAVY_BITS = 0.01, 1000, 62
#: Pairs of a query and an event that one task counts.
PAIRS_PART = 500_000


def upsert_entities(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Rows (kb_id, name, type, doc_ids, seq) merged by name: first type that is not empty, union of documents."""
    rows = new if old is None else old.unionByName(new)
    kind = F.min(F.when(F.coalesce("type", F.lit("")) != "", F.struct("seq", "type")))
    return rows.groupBy("kb_id", "name").agg(kind["type"].alias("type"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("doc_ids")))).alias("doc_ids"), F.min("seq").alias("seq"))


def upsert_relations(rows: DataFrame, entities: DataFrame, by_evidence: bool = True) -> DataFrame:
    """Relations whose ends exist; weight is the number of distinct documents (or of rows), provenance the last writer's."""
    names = entities.select("kb_id", "name")
    kept = rows.join(names.withColumnRenamed("name", "source"), ["kb_id", "source"], "left_semi").join(names.withColumnRenamed("name", "target"), ["kb_id", "target"], "left_semi")
    weight = F.count_distinct("doc_id") if by_evidence else F.count(F.lit(1))
    return kept.groupBy("kb_id", "source", "target", "type").agg(weight.alias("weight"), F.max_by("doc_id", "seq").alias("doc_id"))


def degrees(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities with their number of undirected edges; a self loop counts once."""
    ends = relations.select("kb_id", F.explode(F.array_distinct(F.array("source", "target"))).alias("name"))
    n = ends.groupBy("kb_id", "name").agg(F.count(F.lit(1)).alias("degree"))
    return entities.drop("degree").join(n, ["kb_id", "name"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def upsert_mentions(rows: DataFrame, events: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct mentions whose two ends exist."""
    return rows.select("event_id", "name").distinct().join(events.select("event_id"), "event_id", "left_semi").join(entities.select("name"), "name", "left_semi").select("event_id", "name")


def delete_document(doc_id: Column, entities: DataFrame, relations: DataFrame, events: DataFrame, mentions: DataFrame) -> dict[str, DataFrame]:
    """The four tables without what only this document supports."""
    left = entities.withColumn("doc_ids", F.array_remove("doc_ids", doc_id)).where(F.size("doc_ids") > 0)
    names = left.select("kb_id", "name")
    edges = relations.where(F.col("doc_id") != doc_id)
    edges = edges.join(names.withColumnRenamed("name", "source"), ["kb_id", "source"], "left_semi").join(names.withColumnRenamed("name", "target"), ["kb_id", "target"], "left_semi")
    kept = events.where(F.col("doc_id") != doc_id)
    return {"entities": degrees(left, edges), "relations": edges, "events": kept, "mentions": mentions.join(kept.select("event_id"), "event_id", "left_semi").join(left.select("name"), "name", "left_semi")}


def events_by_entities(mentions: DataFrame, seeds: DataFrame) -> DataFrame:
    """(event_id, mention_count) of events that mention seeds(name)."""
    return mentions.join(seeds.select("name").distinct(), "name", "left_semi").groupBy("event_id").agg(F.count_distinct("name").alias("mention_count"))


def expand_events(mentions: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """(event_id, hop) of events reached through shared entities; each once, seeds left out."""
    edges = mentions.select("event_id", "name").distinct()
    seen = seeds.select("event_id").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        names = edges.join(front.select("event_id"), "event_id", "left_semi").select("name").distinct()
        front = edges.join(names, "name", "left_semi").select("event_id").distinct().join(seen.select("event_id"), "event_id", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def neighbourhood(entities: DataFrame, relations: DataFrame, centre: DataFrame, hops: int = 1) -> DataFrame:
    """(name, hop, degree, place) of entities within some undirected hops of centre(name): centre first, then by degree and name."""
    both = relations.select(F.col("source").alias("a"), F.col("target").alias("b")).union(relations.select("target", "source")).distinct()
    seen = centre.select("name").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        front = both.join(front.select(F.col("name").alias("a")), "a", "left_semi").select(F.col("b").alias("name")).distinct().join(seen.select("name"), "name", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return entities.select("name", "degree").join(seen, "name")


def internal_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations with both ends among nodes(name)."""
    return relations.join(nodes.select(F.col("name").alias("source")), "source", "left_semi").join(nodes.select(F.col("name").alias("target")), "target", "left_semi")


def overview(entities: DataFrame, relations: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The n entities of highest degree and the relations among them."""
    top = entities.orderBy(F.desc("degree"), "name").limit(n)
    return top, internal_edges(relations, top)


def stats(entities: DataFrame) -> DataFrame:
    """E5: (type, n, n_orphans)."""
    return entities.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("degree") == 0, 1).otherwise(0)).cast("long").alias("n_orphans"))


def detail(relations: DataFrame, centre: DataFrame) -> DataFrame:
    """(name, other, type) of the direct neighbours of centre(name), each once by relation type."""
    c = centre.select("name").distinct()
    out = relations.join(c.withColumnRenamed("name", "source"), "source", "left_semi").select(F.col("source").alias("name"), F.col("target").alias("other"), "type")
    back = relations.join(c.withColumnRenamed("name", "target"), "target", "left_semi").select(F.col("target").alias("name"), F.col("source").alias("other"), "type")
    return out.union(back).distinct()


def with_events(nodes: DataFrame, mentions: DataFrame) -> DataFrame:
    """Nodes with the events that mention them, as (id, node_type)."""
    events = mentions.join(nodes.select("name"), "name", "left_semi").select(F.concat(F.lit("event:"), "event_id").alias("id")).distinct()
    return nodes.select(F.col("name").alias("id"), F.lit("entity").alias("node_type")).union(events.withColumn("node_type", F.lit("event")))


def communities(entities: DataFrame, relations: DataFrame, rounds: int = 10) -> DataFrame:
    """(name, community) by Louvain, of at most so many rounds of moves a level."""
    return louvain(entities, relations, passes=rounds).labels


def resolve_aliases(entities: DataFrame, least: float = 0.92) -> DataFrame:
    """(name, canonical): entities(name, type, vector) whose name holds another's of the same type, at a cosine of least or more.

    Names meet by the substring join, so a part of a word is a candidate too; all candidates of a name are compared,
    and the last best wins ties.
    """
    scratch = Scratch(entities.sparkSession)
    keyed = scratch.keep(entities.withColumn("tid", F.xxhash64("name", "type")).dropDuplicates(["tid"]).withColumn("nid", F.xxhash64("name")))
    # a name that stands under many types is compared once; types meet after that
    texts = keyed.select("nid", "name").distinct()
    pairs = contains_join(texts.select(F.col("nid").alias("tid"), F.col("name").alias("text")), texts.select(F.col("nid").alias("pid"), F.col("name").alias("pattern")))
    pairs = pairs.where("tid <> pid").select(F.col("tid").alias("nid"), F.col("pid").alias("__n"))
    held = keyed.select(F.col("tid").alias("pid"), F.col("nid").alias("__n"), F.col("name").alias("canonical"), F.col("type").alias("__t"))
    names = pairs.join(keyed.select("tid", "nid", "name", "type"), "nid")
    near = names.join(held, (names["__n"] == held["__n"]) & F.col("type").eqNullSafe(F.col("__t")) & (F.col("name") != F.col("canonical"))).select("tid", "name", "pid", "canonical")
    vectors = keyed.select("tid", "vector")
    both = near.join(vectors, "tid").join(vectors.select(F.col("tid").alias("pid"), F.col("vector").alias("v2")), "pid")
    scored = both.withColumn("s", cosine(F.col("vector"), F.col("v2"))).where(F.col("s") >= least)
    return scored.groupBy("tid", "name").agg(F.max(F.struct("s", "canonical"))["canonical"].alias("canonical")).select("name", "canonical")


def filter_events(events: DataFrame, most: int = 3) -> DataFrame:
    """events(chunk_id, event_id, content, names, known) with content, known names only, at most some a chunk."""
    kept = events.where(F.trim(F.coalesce("content", F.lit(""))) != "").withColumn("names", F.array_intersect("names", "known"))
    return kept.withColumn("__r", F.row_number().over(Window.partitionBy("chunk_id").orderBy("event_id"))).where(F.col("__r") <= most).drop("__r", "known")


def heavy_names(mentions: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """(name, bit): names that so large a share of all events mention, the most frequent HEAVY_BITS at most."""
    n = mentions.agg(F.approx_count_distinct("event_id")).first()[0]
    held = mentions.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(HEAVY_EVENTS, share * n))
    top = held.orderBy(F.desc("n"), "name").limit(HEAVY_BITS)
    return Scratch(mentions.sparkSession).keep(top.withColumn("bit", F.row_number().over(Window.orderBy(F.desc("n"), "name")) - 1).select("name", "bit"))  # HEAVY_BITS rows


def shared_names(mentions: DataFrame, seeds: DataFrame, k: int, share: float = HEAVY_SHARE) -> DataFrame:
    """N14's step: (query_id, event_id, shared) with the names that an event shares with a query's seed events; of each query at least the k best by (shared, event_id) that are no seeds.

    Light names meet by a join. Heavy ones, which a large share of events mention, are bits: an event tests the names
    of a query by one bitwise and. Events with the same bits are equal for every query, so of each pattern only the
    first k and as many more as a query has seeds are offered; those that light names reach are tested one by one. So
    rows don't grow with the events that mention a hub.
    """
    scratch = Scratch(mentions.sparkSession)
    mentions = scratch.keep(mentions.select("event_id", "name").distinct())
    heavy = heavy_names(mentions, share)
    asked = scratch.keep(seeds.select("query_id", "event_id").distinct())
    names = scratch.keep(mentions.join(asked, "event_id").select("query_id", "name").distinct())
    more = k + (asked.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0)
    if heavy.isEmpty():
        return best_met(names.withColumn("mask", F.lit(0).cast("long")), mentions.withColumn("bits", F.lit(0).cast("long")), more)
    heavy = F.broadcast(heavy)
    bit = F.expr("shiftleft(1L, bit)")
    masks = scratch.keep(names.join(heavy, "name").groupBy("query_id").agg(F.bit_or(bit).alias("mask")))
    bits = scratch.keep(mentions.join(heavy, "name").groupBy("event_id").agg(F.bit_or(bit).alias("bits")))
    light = scratch.keep(names.join(heavy, "name", "left_anti").join(masks, "query_id", "left").select("query_id", "name", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")))
    held = scratch.keep(mentions.join(heavy, "name", "left_anti").join(bits, "event_id", "left").select("event_id", "name", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))
    first = bits.withColumn("r", F.row_number().over(Window.partitionBy("bits").orderBy("event_id"))).where(F.col("r") <= more)
    patterns = first.select("bits").distinct().join(heavy, (F.col("bits").bitwiseAND(bit)) != 0).select("bits", "name")
    met = names.join(patterns, "name").groupBy("query_id", "bits").agg(F.count(F.lit(1)).alias("shared"))
    offered = met.join(first.select("bits", "event_id"), "bits").select("query_id", "event_id", "shared")
    both = best_met(light, held, more).unionByName(offered).groupBy("query_id", "event_id").agg(F.max("shared").alias("shared"))
    # an offered event that light names reach too, but that is not among the best, stands below all of those
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("shared"), "event_id"))
    return both.withColumn("r", best).where(F.col("r") <= more).drop("r")


def best_met(names: DataFrame, held: DataFrame, most: int) -> DataFrame:
    """(query_id, event_id, shared): names(query_id, name, mask) and held(event_id, name, bits) counted where they meet, with the bits that mask and bits share; of each query, or each slice of its events, the best ``most``.

    What meets is many times the input, so it is counted first (names x events of each), and dealt to as many tasks as
    that needs: none holds more than some PAIRS_PART pairs. A query that reaches more than that lies in slices.
    """
    n = held.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    total, largest = names.join(n, "name").groupBy("query_id").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    parts = max(-(-total // PAIRS_PART), min(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * 16 // PAIRS_PART)), 1)
    cut = F.pmod(F.xxhash64("event_id"), F.lit(max(1, -(-largest // PAIRS_PART)))).alias("slice")
    pairs = names.repartition(parts, "name").join(held.repartition(parts, "name"), "name").select("query_id", cut, "event_id", "mask", "bits")
    common = F.bit_count(F.max("bits").bitwiseAND(F.max("mask")))
    counted = pairs.repartition(parts, "query_id", "slice").groupBy("query_id", "slice", "event_id").agg((F.count(F.lit(1)) + common).cast("long").alias("shared"))
    best = F.row_number().over(Window.partitionBy("query_id", "slice").orderBy(F.desc("shared"), "event_id"))
    return counted.withColumn("r", best).where(F.col("r") <= most).select("query_id", "event_id", "shared")


def event_recall(mentions: DataFrame, chunks: DataFrame, seeds: DataFrame, expand: int = 50, coarse: int = 15, k: int = 20) -> DataFrame:
    """(query_id, chunk_id, score): seed events(query_id, event_id, base), one hop more, ranked, then their chunks.

    Each limit is a top-k of the recall: how many events are reached, ranked, and chunks returned.
    """
    reached = shared_names(mentions, seeds, expand)
    reached = reached.join(seeds.select("query_id", "event_id"), ["query_id", "event_id"], "left_anti").select("query_id", "event_id", F.col("shared").cast("double").alias("base"), F.lit(1).alias("o"))
    few = reached.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("base"), "event_id"))).where(F.col("r") <= expand).drop("r")
    both = seeds.select("query_id", "event_id", "base", F.lit(0).alias("o")).unionByName(few)
    ranked = both.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("o", F.desc("base"), "event_id"))).where(F.col("place") <= coarse)
    found = ranked.join(chunks.select("event_id", "chunk_id"), "event_id").groupBy("query_id", "chunk_id").agg(F.min("place").alias("place"))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "chunk_id"))
    return found.withColumn("rank", at).where(F.col("rank") <= k).select("query_id", "chunk_id", "rank", F.round(1 / F.col("rank"), 9).alias("score"))


def of_types(rows: DataFrame, types: list[str] | None, keep: DataFrame | None = None) -> DataFrame:
    """rows(name, type, ...) of the listed types; no list, no filter; the centre names in keep(name) always stay."""
    wanted = sorted({t.strip() for t in types or [] if t.strip()})
    if not wanted:
        return rows
    if keep is None:
        return rows.where(F.col("type").isin(*wanted))
    centre = keep.select("name", F.lit(True).alias("__centre")).distinct()
    return rows.join(centre, "name", "left").where(F.col("type").isin(*wanted) | F.col("__centre")).drop("__centre")


def shared_mentions(mentions: DataFrame, seeds: DataFrame) -> DataFrame:
    """(event_id, other, shared): how many entities each of seeds(event_id) shares with every other event."""
    own = mentions.join(seeds.select("event_id").distinct(), "event_id", "left_semi").select("event_id", "name").distinct()
    other = mentions.select(F.col("event_id").alias("other"), "name").distinct()
    return own.join(other, "name").where("event_id <> other").groupBy("event_id", "other").agg(F.count(F.lit(1)).alias("shared"))


def inside(relations: DataFrame, labels: DataFrame) -> DataFrame:
    """Relations whose two ends lie in one community of labels(name, community)."""
    ends = relations.join(labels.select(F.col("name").alias("source"), "community"), "source").join(labels.select(F.col("name").alias("target"), F.col("community").alias("__c")), "target")
    return ends.where(F.col("community") == F.col("__c")).drop("__c")


def line_entities(lines: DataFrame, extract: Callable[[Column], Column]) -> DataFrame:
    """N1, first step: (doc_id, line, name) by an injected column function over text."""
    return lines.select("doc_id", "line", F.explode(extract(F.col("text"))).alias("name"))


def line_relations(found: DataFrame) -> DataFrame:
    """N1, second step: (source, target, n): names that follow each other in the sorted list of one line."""
    follows = F.lead("name").over(Window.partitionBy("doc_id", "line").orderBy("name"))
    return found.withColumn("target", follows).where("target is not null").groupBy(F.col("name").alias("source"), "target").agg(F.count(F.lit(1)).alias("n"))


def line_events(found: DataFrame) -> DataFrame:
    """N1, third step: (doc_id, line, n_names): a line with two names or more is an event."""
    return found.groupBy("doc_id", "line").agg(F.count_distinct("name").alias("n_names")).where("n_names >= 2")


def write_subtask(found: DataFrame, canonical: Callable[[Column], Column]) -> DataFrame:
    """(name, n_chunks, n_docs) of the entities that chunks name, under their canonical names, stamped with chunk and document."""
    named = found.withColumn("name", canonical(F.col("name"))).where("name <> ''")
    chunk = F.struct("doc_id", "line")
    return named.groupBy("name").agg(F.count_distinct(chunk).alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"))


def dispatch(query: Column, has_store: Column, enabled: Column, with_events: Column, is_global: Column, top_k: Column, most: Column) -> Column:
    """struct(route, communities, hits): which recall a question takes, whether community summaries come first, how many hits stay."""
    route = F.when(~has_store | (F.trim(F.coalesce(query, F.lit(""))) == "") | ~enabled, "none").when(with_events, "events").otherwise("bridge")
    hits = F.when(top_k > 0, F.least(top_k, most)).otherwise(most)
    return F.struct(route.alias("route"), ((route != "none") & is_global).alias("communities"), F.when(route == "none", 0).otherwise(hits).cast("long").alias("hits"))


def question_entities(tokens: Column, most: int = 8) -> Column:
    """The names that a question is looked up by where no model gives any: its first tokens in order."""
    return F.slice(F.array_sort(tokens), 1, most)


def assembled(graph_on: Column, has_store: Column, lexical: Column) -> Column:
    """The routes that a retriever is put together from."""
    return F.array_compact(F.array(F.lit("dense"), F.when(lexical, "bm25"), F.when(graph_on & has_store, "graph")))
