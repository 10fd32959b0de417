"""Louvain, substring join and paths through hubs against brute force."""

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairnspark.operators import communities as C
from cairnspark.operators import graph as G
from cairnspark.operators import retrieval as R
from cairnspark.operators import substrings as S
from cairnspark.plans.catalog import QUERIES
from cairnspark.providers import Graph


def q_of(edges, part):
    m2 = 2 * sum(w for _, _, w in edges)
    k, inside = Counter(), 0.0
    for a, b, w in edges:
        k[part[a]] += w
        k[part[b]] += w
        inside += 2 * w * (part[a] == part[b])
    return inside / m2 - sum(x * x for x in k.values()) / m2**2


def partitions(nodes):
    if not nodes:
        yield {}
        return
    for rest in partitions(nodes[1:]):
        used = sorted(set(rest.values()))
        for c in [*used, len(used)]:
            yield {nodes[0]: c} | rest


def louvain(spark, edges, names):
    e = spark.createDataFrame([(x,) for x in names], "name string")
    r = spark.createDataFrame(edges, "source string, target string, weight double")
    return C.louvain(e, r)


@pytest.mark.parametrize("seed", [1, 2])
def test_louvain_comes_near_the_best_partition(spark, seed):
    rng = random.Random(seed)
    nodes = list("abcdefgh")
    edges = [(a, b, float(rng.randint(1, 4))) for a, b in itertools.combinations(nodes, 2) if rng.random() < (0.9 if (a < "e") == (b < "e") else 0.2)]
    found = louvain(spark, edges, nodes)
    part = {r["name"]: r["community"] for r in found.labels.collect()}
    assert set(part) == set(nodes) and all(part[c] == c and min(x for x in nodes if part[x] == c) == c for c in part.values())
    assert found.modularity == sorted(found.modularity)
    assert q_of(edges, part) == pytest.approx(found.modularity[-1])
    best = max(q_of(edges, p) for p in partitions(nodes))
    assert q_of(edges, part) >= 0.9 * best


def test_louvain_finds_cliques_round_a_hub(spark):
    edges = [(f"n{c}{i}", f"n{c}{j}", 1.0) for c in range(6) for i in range(5) for j in range(i)]
    edges += [("hub", f"n{c}{i}", 0.05) for c in range(6) for i in range(5)] + [("n00", "n00", 1.0), ("n00", None, 1.0), ("n11", "n12", -1.0)]
    names = [f"n{c}{i}" for c in range(6) for i in range(5)] + ["hub", "alone"]
    found = louvain(spark, edges, names)
    part = {r["name"]: r["community"] for r in found.labels.collect()}
    assert part["alone"] == "alone" and found.levels >= 1 and found.modularity == sorted(found.modularity)
    for c in range(6):
        assert len({part[f"n{c}{i}"] for i in range(5)}) == 1
    assert len({part[f"n{c}0"] for c in range(6)}) == 6
    r = spark.createDataFrame([e for e in edges if e[1]], "source string, target string, weight double")
    top = C.summaries(found.labels, r, least=3, most=2, members=4).collect()
    assert len(top) == 2 and all(len(x["members"]) == 4 and x["n_members"] >= 5 and x["n_relations"] >= 10 for x in top)


def test_louvain_without_relations(spark):
    found = louvain(spark, [], ["x", "y"])
    assert {(r["name"], r["community"]) for r in found.labels.collect()} == {("x", "x"), ("y", "y")} and found.levels == 0


def test_moves_at_once_are_independent(spark):
    moves = spark.createDataFrame([("a", "y", 0.3, "x"), ("b", "x", 0.2, "y"), ("c", "w", 0.1, "z"), ("d", "v", 0.05, "w")], "node string, target string, gain double, community string")
    assert {r["node"] for r in C.independent(moves).collect()} == {"a", "c"}


def test_substring_join_against_all_pairs(spark):
    rng = random.Random(4)
    words = ["corp", "megacorp", "a", "ab", "é", "星河", "x y", "data", "ata b", " ", "database"]
    texts = [(i, "".join(rng.choice([*words, " ", "z"]) for _ in range(rng.randrange(0, 12)))) for i in range(150)] + [(900, None), (901, ""), (902, "pad " * 40_000 + "needle in it" + " pad" * 40_000)]
    patterns = [(i, w) for i, w in enumerate(words)] + [(50, "megacorp data"), (51, ""), (52, None), (53, "absent gram"), (54, "needle in"), (55, "corp"), (56, "one two three four five")]
    got = [(r["tid"], r["pid"]) for r in S.contains_join(spark.createDataFrame(texts, "tid long, text string"), spark.createDataFrame(patterns, "pid long, pattern string")).collect()]
    want = {(i, p) for i, t in texts for p, w in patterns if t and w and w in t}
    assert len(got) == len(set(got)) and set(got) == want and (902, 54) in want
    assert S.contains_join(spark.createDataFrame([], "tid long, text string"), spark.createDataFrame(patterns, "pid long, pattern string")).count() == 0


def test_substring_join_has_no_unchecked_broadcast_or_cross_join(spark):
    t = spark.createDataFrame([(1, "abc")], "tid long, text string")
    plan = S.contains_join(t, t.select(F.col("tid").alias("pid"), F.col("text").alias("pattern")))._jdf.queryExecution().analyzed().toString()
    assert "CartesianProduct" not in plan and "Join Cross" not in plan and "strategy=broadcast" not in plan


def test_aliases_inside_words(spark):
    rows = [("megacorp", "org", [1.0, 0.1]), ("corp", "org", [1.0, 0.0]), ("corporate", "org", [0.0, 1.0]), ("corp", "person", [1.0, 0.0]), ("ego", "person", [1.0, 0.1])]
    got = G.resolve_aliases(spark.createDataFrame(rows, "name string, type string, vector array<double>"))
    assert {tuple(r) for r in got.collect()} == {("megacorp", "corp")}


def shared_by_hand(mentions, seeds):
    names = {q: {n for e, n in mentions if (q, e) in seeds} for q, _ in seeds}
    return {(q, e): len(own & {n for x, n in mentions if x == e}) for q, own in names.items() for e in {x for x, _ in mentions} if own & {n for x, n in mentions if x == e}}


def test_paths_through_hubs_are_linear_and_exact(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(G, "HEAVY_EVENTS", 20)
    mentions = {(e, "hub") for e in range(0, 300, 3)} | {(e, "other hub") for e in range(0, 300, 4)} | {(rng.randrange(300), f"n{rng.randrange(200)}") for _ in range(500)}
    seeds = {(q, rng.randrange(300)) for q in range(12) for _ in range(4)} | {(q, 0) for q in range(6)}
    m = spark.createDataFrame(sorted(mentions), "event_id long, name string")
    s = spark.createDataFrame(sorted(seeds), "query_id long, event_id long")
    k = 7
    got = {(r["query_id"], r["event_id"]): r["shared"] for r in G.shared_names(m, s, k).collect()}
    want = shared_by_hand(mentions, seeds)
    assert got.items() <= want.items()

    def top(found):
        out = set()
        for q in {q for q, _ in seeds}:
            rest = sorted((-n, e) for (x, e), n in found.items() if x == q and (q, e) not in seeds)
            out |= {(q, e, n) for n, e in rest[:k]}
        return out

    assert top(got) == top(want)
    assert sum(1 for q, e in got if q < 6) < 6 * 120  # every one of these queries has the hub, which 100 events name
    assert {r["name"] for r in G.heavy_names(m).collect()} == {"hub", "other hub"}


def test_graph_store_changes(spark):
    kinds = "kb_id string, name string, type string, doc_ids array<long>, seq long"
    old = spark.createDataFrame([("k", "a", "t", [1], 1), ("k", "b", "t", [1, 2], 2)], kinds)
    edges = "kb_id string, source string, target string, type string, doc_id long, seq long"
    rel = spark.createDataFrame([("k", "a", "b", "r", 1, 1)], edges)
    mentions = spark.createDataFrame([(10, "a"), (11, "b"), (11, "c")], "event_id long, name string")
    g = Graph(old.withColumn("degree", F.lit(1)), rel, spark.createDataFrame([(10, 1), (11, 2)], "event_id long, doc_id long"), mentions)
    more = g.upserted(spark.createDataFrame([("k", "c", "t", [2], 3), ("k", "a", "", [3], 4)], kinds), spark.createDataFrame([("k", "b", "c", "r", 2, 5), ("k", "c", "gone", "r", 2, 6)], edges))
    assert {(r["name"], tuple(r["doc_ids"]), r["degree"]) for r in more.entities.collect()} == {("a", (1, 3), 1), ("b", (1, 2), 2), ("c", (2,), 1)}
    assert {(r["source"], r["target"]) for r in more.relations.collect()} == {("a", "b"), ("b", "c")}
    left = more.without_document(F.lit(2).cast("long"))
    assert {(r["name"], r["degree"]) for r in left.entities.collect()} == {("a", 1), ("b", 1)}
    assert [(r["event_id"], r["name"]) for r in left.mentions.collect()] == [(10, "a")] and left.events.count() == 1
    assert {r["name"] for r in more.ego(spark.createDataFrame([("a",)], "name string"), 2).collect()} == {"a", "b", "c"}
    assert len({r["community"] for r in more.communities().collect()}) == 1


def test_places_in_hot_groups(spark):
    rows = [(i, "hot" if i % 3 else None, i % 7) for i in range(500)]
    got = R.placed(spark.createDataFrame(rows, "id long, g string, v int"), "g", F.desc("v"), F.col("id")).collect()
    for g in ("hot", None):
        own = sorted([r for r in rows if r[1] == g], key=lambda r: (-r[2], r[0]))
        assert [r["id"] for r in sorted((x for x in got if x["g"] == g), key=lambda x: x["place"])] == [r[0] for r in own]
        assert {r["n"] for r in got if r["g"] == g} == {len(own)} and {r["place"] for r in got if r["g"] == g} == set(range(len(own)))


def test_pairs_of_queries_and_events_are_dealt_by_their_number(spark, monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(G, "PAIRS_PART", 60, raising=False)
    mentions = {(e, f"n{rng.randrange(60)}") for e in range(400) for _ in range(3)}
    seeds = {(q, rng.randrange(400)) for q in range(10) for _ in range(3)}
    m = spark.createDataFrame(sorted(mentions), "event_id long, name string")
    s = spark.createDataFrame(sorted(seeds), "query_id long, event_id long")
    found = G.shared_names(m, s, 7)
    want = shared_by_hand(mentions, seeds)
    pairs = sum(want.values())
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(query_id#\d+L?, slice#\d+L?, (\d+)\)", found._jdf.queryExecution().executedPlan().toString())]
    assert dealt and min(dealt) >= pairs / 60 > 20  # tasks follow the pairs that meet, not spark.sql.shuffle.partitions
    got = {(r["query_id"], r["event_id"]): r["shared"] for r in found.collect()}
    assert got.items() <= want.items() and len(got) < len(want)
    for q in {q for q, _ in seeds}:
        best = lambda rows: sorted((-n, e) for (x, e), n in rows.items() if x == q and (q, e) not in seeds)[:7]
        assert best(got) == best(want)


def test_aliases_compare_distinct_names_and_embed_them_once(spark, monkeypatch, tmp_path):
    rows = [("megacorp", f"t{i}", [1.0, 0.1]) for i in range(12)] + [("corp", f"t{i}", [1.0, 0.0]) for i in range(3, 15)] + [("corp", None, [1.0, 0.0]), ("megacorp", None, [1.0, 0.1])]
    seen = {}
    join = G.contains_join
    monkeypatch.setattr(G, "contains_join", lambda texts, patterns: seen.update(n=(texts.count(), patterns.count())) or join(texts, patterns))
    got = G.resolve_aliases(spark.createDataFrame(rows, "name string, type string, vector array<double>")).collect()
    assert seen["n"] == (2, 2) and [tuple(r) for r in got] == [("megacorp", "corp")] * 10  # t3 to t11, and no type

    embedded = []
    resolve = G.resolve_aliases
    monkeypatch.setattr(G, "resolve_aliases", lambda e, **k: embedded.append(e) or resolve(e, **k))
    spark.createDataFrame([(i, "Red Ring", "b") for i in range(5000)], "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    assert [tuple(r) for r in QUERIES["n3_alias_resolution"](spark, str(tmp_path)).collect()] == [("red ring inc", "red ring")]
    plan = embedded[0].withColumn("tid", F.xxhash64("name", "type")).dropDuplicates(["tid"])._jdf.queryExecution().optimizedPlan().toString()
    assert "part.parquet" not in plan and "p_name" not in plan  # rows of the table are made distinct before any is embedded


def test_all_candidates_of_a_name_are_compared(spark):
    parts = [f"{c}{c}" for c in "abcdefghijklmnopqrst"]
    rows = [(" ".join(parts), "org", [1.0, 0.0]), *((p, "org", [1.0, 2.0 - 0.1 * i]) for i, p in enumerate(parts))]
    got = G.resolve_aliases(spark.createDataFrame(rows, "name string, type string, vector array<double>"))
    assert [tuple(r) for r in got.collect()] == [(" ".join(parts), "tt")]


def test_texts_are_scanned_and_not_shuffled_for_few_candidates(spark):
    t = spark.createDataFrame([(1, "x" * 250_000 + "needle" + "y" * 10), (2, "need le" * 9), (2, "needle"), (None, "needle")], "tid long, text string")
    found = S.contains_join(t, spark.createDataFrame([(5, "needle"), (6, "le")], "pid long, pattern string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "MapInArrow" not in plan  # candidates are written: what is left is one scan that verifies them
    assert sorted(map(tuple, found.collect())) == [(1, 5), (1, 6), (2, 5), (2, 6)]


def test_both_modes_read_the_gold_that_is_written_once(spark):
    plan = QUERIES["p4_two_modes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "contains(" not in plan.lower()


def test_communities_by_arrays_are_those_by_tables_in_fewer_jobs(spark, monkeypatch):
    rng = random.Random(21)
    names = [f"n{i}" for i in range(240)] + ["alone", "é", "星"]
    edges = [(f"n{i}", f"n{j}", rng.randrange(1, 4)) for i in range(240) for j in range(i) if rng.random() < (0.3 if i // 20 == j // 20 else 0.01)]
    edges += [("n1", "n1", 2), ("é", "n2", 1), ("n2", "é", 1), ("星", "星", 3)] + edges[:30]
    e = spark.createDataFrame([(n,) for n in names], "name string")
    r = spark.createDataFrame(edges, "source string, target string, weight long")
    sc, found, jobs = spark.sparkContext, {}, {}
    for way, most in (("arrays", 10_000), ("tables", 0)):
        monkeypatch.setattr(C, "DENSE_NODES", most, raising=False)
        monkeypatch.setattr(C, "PART_EDGES", 100, raising=False)
        monkeypatch.setattr(C, "BUCKET_ROWS", 100)
        sc.setJobGroup(way, way)
        found[way] = C.louvain(e, r)
        jobs[way] = len(sc.statusTracker().getJobIdsForGroup(way))
    sc.setLocalProperty("spark.jobGroup.id", None)
    labels = {way: sorted(map(tuple, f.labels.select("name", "community").collect())) for way, f in found.items()}
    assert labels["arrays"] == labels["tables"] and len(labels["arrays"]) == len(names)
    assert found["arrays"].modularity == pytest.approx(found["tables"].modularity) and found["arrays"].levels == found["tables"].levels > 1
    assert jobs["arrays"] * 2 < jobs["tables"]


def test_summaries_read_written_relations_and_labels(spark):
    read = QUERIES["n12_community_summaries"](spark, "/root/testdata/sf0.001").inputFiles()
    assert read and not [f for f in read if "/testdata/" in f]
