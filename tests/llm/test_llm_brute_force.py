"""More of the ten operators against brute force, and odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import DOCS, LABELS, docs, shingles, tokenizer

from cairnspark.llm import compression_toxicity as tox
from cairnspark.llm import importance_resampling as imp
from cairnspark.llm import line_dedup
from cairnspark.llm import queries as Q
from cairnspark.llm.common import Scratch, components
from cairnspark.llm.jaccard_join import PARITY, _parity, jaccard_components, one_of_each
from cairnspark.llm.line_dedup import dedup_lines, shared_blocks
from cairnspark.llm.packing import pack_documents
from cairnspark.llm.page_difference import extract
from cairnspark.llm.robust_graph import search
from cairnspark.llm.rule_ledger import ledger
from cairnspark.llm.url_filter import judge
from cairnspark.llm.word_bpe import encode_decode
from cairnspark.llm.word_hash import shingle_sets


def runs_held_before(rows, blanks):
    """Positions of each document in runs of 20 or more words that an earlier one holds in a row."""
    split = {i: [(k, x) for k, x in enumerate(t.split("\n")) if blanks or x.strip()] for i, t in rows}
    out = {}
    for i, lines in split.items():
        gone = set()
        for j, other in split.items():
            if j >= i:
                continue
            theirs = [x for _, x in other]
            for a in range(len(lines)):
                for b in range(len(theirs)):
                    n = words = 0
                    while a + n < len(lines) and b + n < len(theirs) and lines[a + n][1] == theirs[b + n] and lines[a + n][1].strip():
                        words += len(lines[a + n][1].split())
                        n += 1
                    if words >= 20:
                        gone.update(k for k, _ in lines[a : a + n])
        out[i] = gone
    return out


def test_op2_against_all_pairs_of_documents(spark):
    rng = random.Random(7)
    pool = [" ".join(rng.choice("ab cd ef gh ij kl mn".split()) + str(k) for _ in range(rng.choice((3, 6, 9, 12)))) for k in range(25)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 25)))) for i in range(40)]
    for i in range(40, 60):  # pieces of earlier documents, some moved
        a, b = (rng.choice(rows)[1].split("\n") for _ in range(2))
        rows.append((i, "\n".join([*a[: len(a) // 2], f"own {i}", *b[len(b) // 3 :]])))
    held, least, most = docs(spark, rows), runs_held_before(rows, True), runs_held_before(rows, False)
    got = {r["doc_id"]: set(r["gone"]) for r in shared_blocks(held).collect()}
    assert sum(map(len, least.values())) > 100
    for i, _ in rows:
        assert least[i] <= got.get(i, set()) <= most[i], i


def test_op2_odd_columns(spark):
    rows = [(None, "a b c"), (1, "x" * 300_000), (1, "other text of one"), (2, "")]
    found = dedup_lines(docs(spark, rows).withColumn("n_removed", F.lit("clash")).withColumn("line", F.lit(1)))
    assert sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in found.collect()) == sorted((str(i), t, 0) for i, t in rows)


def family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(120)]
    return [" ".join(rng.choice(words) if rng.random() < edits else w for w in base) for _ in range(n)]


def test_op3_large_family_null_bridge_and_repeated_ids(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = list(enumerate([*family(rng, words, 300, 0.02), *family(rng, words, 60, 0.05), *family(rng, words, 20, 0.5)]))
    base = [f"b{k}" for k in range(60)]
    left, middle, right = (" ".join(x) for x in (base, [*base[5:], *base[:5]], [*base[10:], *base[:10]]))
    rows += [(1000, " ".join(base[:-6])), (None, " ".join(base)), (1002, " ".join(base[6:])), (1003, left), (1003, "a text of its own under the same id"), (None, middle), (1004, right)]
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(k)
    least = {k: min((rows[x][0] for x in g if rows[x][0] is not None), default=None) for g in groups.values() for k in g}
    want = Counter((rows[k][0], len(sets[k]), least[k]) for k in range(len(rows)))
    got = jaccard_components(docs(spark, rows).withColumn("sid", F.lit(1)).withColumn("component", F.lit("clash")))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == want
    kept = one_of_each(docs(spark, rows)).collect()
    assert len(kept) == len(groups)
    assert {k for k in range(len(rows)) if (rows[k][0], rows[k][1]) in {(r["doc_id"], r["text"]) for r in kept}} <= {k for k in range(len(rows)) if rows[k][0] == least[k]}


def test_op3_repeated_rows_leave_one(spark):
    rows = [(7, "one two three four five six")] * 3 + [(None, "seven eight nine ten eleven twelve")] * 2 + [(8, "")] * 2 + [(9, None)]
    assert Counter((r["doc_id"], r["text"]) for r in one_of_each(docs(spark, rows)).collect()) == Counter({rows[0]: 1, rows[3]: 1, (8, ""): 2, (9, None): 1})


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(1)
    sets = list(shingle_sets([" ".join(map(str, rng.integers(0, 30, 80))).encode() for _ in range(40)]))
    bits = [_parity(s) for s in sets]
    assert all(len(b) == PARITY for b in bits)
    for a in range(40):
        for b in range(40):
            odd = sum(int(x).bit_count() for x in (bits[a] ^ bits[b]).view(np.uint64))
            assert odd <= len(np.setxor1d(sets[a], sets[b]))


def test_components_of_paths_and_random_graphs(spark):
    rng = random.Random(2)
    for edges in ([(i, i + 1) for i in range(30)], [(rng.randrange(200), rng.randrange(200)) for _ in range(130)]):
        best = {x: x for e in edges for x in e}
        for _ in best:
            for a, b in edges:
                best[a] = best[b] = min(best[a], best[b])
        got = {r["node"]: r["component"] for r in components(Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: c for x, c in best.items() if any(x in e for e in edges if e[0] != e[1])}


def test_op1_weights_against_counts(spark):
    rows = [(1, "good words here"), (2, "good words again"), (3, "bad junk bad"), (4, None), (5, ""), (5, "bad junk"), (6, "good " * 3000)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0)], LABELS)
    found = {(r["doc_id"], r["log_ratio"]) for r in imp.resample(docs(spark, rows).withColumn("key", F.lit("clash")), labels, keep=3).collect()}

    def grams(t):
        w = (t or "").lower().split()
        return [*w, *zip(w, w[1:])]

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in (1, 2):
            target.update(grams(t))
    p = {g: (raw[g] + 1) / (sum(raw.values()) + imp.BUCKETS) for g in raw}
    prior = min(imp.BUCKETS, sum(target.values()))
    q = {g: (target[g] + prior * p[g]) / (sum(target.values()) + prior) for g in raw}
    for i, t in rows:
        mean = float(np.mean([math.log(q[g] / p[g]) for g in grams(t)])) if grams(t) else 0.0
        assert any(d == i and abs(x - mean) < 1e-9 for d, x in found), (i, mean)


def test_op1_noise_samples_in_proportion(spark):
    """Of equal rows, each is drawn about equally often over many seeds."""
    base = spark.createDataFrame([(i, "same text") for i in range(20)], "doc_id long, text string")
    drawn = Counter()
    for seed in range(12):
        scored = imp.weigh(base, np.zeros(imp.BUCKETS), seed=seed)
        drawn.update(r["doc_id"] for r in imp.top_k(scored, 10).where("selected").collect())
    assert sum(drawn.values()) == 120 and max(drawn.values()) < 12 and len(drawn) == 20


def test_op1_includes_in_proportion_to_unequal_weights(spark):
    """The first of k draws has the share of its weight; two of three follow the product of shares without replacement."""
    weights = {0: 1.0, 1: 2.0, 2: 5.0}
    rows = [(100 * s + i, 7 * s, math.log(w)) for s in range(4000) for i, w in weights.items()]
    keyed = imp.with_keys(Scratch(spark).keep(spark.createDataFrame(rows, "doc_id long, text_key long, log_ratio double")), strength=1.0)
    by = {}
    for r in keyed.collect():
        by.setdefault(r["doc_id"] // 100, []).append((-r["key"], r["doc_id"] % 100))
    order = [[i for _, i in sorted(v)] for v in by.values()]
    first = Counter(o[0] for o in order)
    left_out = Counter(o[2] for o in order)
    for i, w in weights.items():
        assert abs(first[i] / 4000 - w / 8) < 0.03
        others = [x for j, x in weights.items() if j != i]
        wanted = sum(a / 8 * b / (8 - a) for a, b in (others, others[::-1]))
        assert abs(left_out[i] / 4000 - wanted) < 0.03


def test_op1_rows_that_repeat_or_lack_an_id_draw_each_for_itself(spark):
    rows = [(None, f"text {i}") for i in range(20)] + [(7, "same")] * 10
    keys = [r["key"] for r in imp.weigh(docs(spark, rows), np.zeros(imp.BUCKETS)).collect()]
    assert len(keys) == len(set(keys)) == 30
    single = {(r["doc_id"], r["text_key"]): r["key"] for r in imp.weigh(docs(spark, rows[:20]).repartition(5), np.zeros(imp.BUCKETS)).collect()}
    assert set(single.values()) <= set(keys)


def test_op2_deletes_nothing_without_alignment(spark, monkeypatch):
    shared = [(k, k + 3, True) for k in range(6)]
    moved = [(0, 10, 2), (2, 0, 2)]
    words = dict.fromkeys(range(6), 12)
    assert line_dedup.aligned(shared, [], words, 20) == set(range(6))
    assert line_dedup.aligned([], moved, words, 20) == {0, 1, 2, 3}  # the second run by a second alignment
    monkeypatch.setattr(line_dedup, "patience", lambda pairs: [])
    assert line_dedup.aligned(shared, [(0, 3, 2), *moved], words, 20) == set()


def test_op5_learns_planted_words_and_takes_odd_rows(spark):
    rng = random.Random(3)
    say = [f"{a}{b}" for a in "ba ko mi tu re".split() for b in "lon sen dar vik".split()]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(say) for _ in range(80)]
        if i % 4 == 0:
            for _ in range(4):
                words[rng.randrange(80)] = rng.choice(("vilescum", "dreadfool"))
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(i % 4 == 0)))
    odd = [(900, None), (901, ""), (902, " ".join(rng.choice(say) for _ in range(60_000))), (903, "vilescum dreadfool vilescum"), (903, "vilescum dreadfool vilescum"), (None, "mi")]
    held = docs(spark, rows + odd + [rows[0]] * 50).withColumn("score", F.lit("clash"))
    found = tox.toxicity(held, spark.createDataFrame(labels, LABELS)).collect()
    by = {r["doc_id"]: r["predicted"] for r in found}
    assert len(found) == 456 and all(0 <= r["score"] <= 1 for r in found)
    assert np.mean([by[i] == (i % 4 == 0) for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]) > 0.95
    assert by[903] == 1 and by[900] == by[901] == by[902] == 0
    assert tox.toxicity(docs(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0


def test_op6_marks_and_copies(spark):
    art = "<body><div><p>Site wide line</p></div><article><p>Shared story</p><p>More of it</p></article></body>"
    rows = [(1, "http://h.example/a/1", art), (2, "http://h.example/a/2", art), (2, "http://h.example/a/2", art), (3, "http://k.example/", "<p>" + "long text " * 60_000 + "</p>"), (None, "x", "<p>y</p>")]
    found = extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit(1))).collect()
    assert Counter((r["page_id"], r["text"][:12], r["n_shared"]) for r in found) == Counter({(1, "Shared story", 1): 1, (2, "Shared story", 1): 2, (3, "long text lo", 0): 1, (None, "y", 0): 1})


def test_op10_checksums(spark):
    t = tokenizer()
    rows = [(1, "some words " * 3000), (2, None), (3, "short"), (3, "short"), (None, "nobody")]
    pieces = pack_documents(docs(spark, rows).withColumn("start", F.lit("clash")), Q.vocabulary()).collect()
    for i, text in set(rows):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = [r for r in pieces if r["doc_id"] == i]
        assert sum(r["length"] for r in mine) == len(ids) * rows.count((i, text))
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)


@pytest.mark.parametrize("apply", [lambda s: encode_decode(docs(s, []), Q.vocabulary()), lambda s: ledger(docs(s, [])), lambda s: judge(s.createDataFrame([], "page_id long, url string"))])
def test_empty_tables(spark, apply):
    assert apply(spark).count() == 0


def test_op4_and_op9_odd_rows(spark):
    found = ledger(docs(spark, [(1, "w " * 30_000), (1, "w " * 30_000), (None, None)]).withColumn("n_words", F.lit("clash"))).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_repeat_words"]) for r in found) == Counter({(1, 30_000, 30_000): 2, (None, 0, 0): 1})
    rows = [(1, "http://a.com/en/x"), (1, "http://a.com/en/x"), (None, "http://a.com/")]
    found = judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit(1))).collect()
    assert Counter((r["page_id"], r["rule"], r["verdict"]) for r in found) == Counter({(1, "com/en/", "block"): 2, (None, None, "allow"): 1})


def test_op8_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.5]), (2, [0.5, 1.0, 2.0]), (3, [0.1, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.5])]
    found = search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(found.collect(), key=lambda r: r["rank"])]
    assert got == [(0, 1, 1), (0, 2, 3)]


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    text = "\n".join(f"passage {i} has nine words of its own here" for i in range(8))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None), (4, ""), (5, "z" * 100_000), (5, "another text of five " * 8)]
    start = docs(spark, rows).withColumn("component", F.lit("clash")).withColumn("n_removed", F.lit(1))
    start.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    for held in (start, start.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            held = stage(spark, held, str(tmp_path))
            assert held.columns == start.columns
        pieces = corpus_pipeline.STAGES[-1][1](spark, held, str(tmp_path)).collect()
        texts = [r["text"] for r in held.collect()]
        assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in held.collect()}
        assert len([t for t in texts if t and re.search("passage 0", t)]) <= 1


assert DOCS
