"""The ten operators against brute force, exact round trips and held-out accuracy, with odd rows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnspark.llm import queries as Q
from cairnspark.llm.compression_toxicity import toxicity
from cairnspark.llm.importance_resampling import resample, top_k
from cairnspark.llm.jaccard_join import jaccard_components, one_of_each
from cairnspark.llm.line_dedup import dedup_lines, patience, shared_blocks
from cairnspark.llm.packing import pack_documents
from cairnspark.llm.page_difference import common_lines, extract, page_lines
from cairnspark.llm.robust_graph import Graph, search
from cairnspark.llm.rule_ledger import ablations, apply_policy, ledger
from cairnspark.llm.url_filter import judge
from cairnspark.llm.word_bpe import encode_decode

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_op3_against_all_pairs(spark):
    sets = {i: shingles(t) for i, t in texts(spark).items()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in Q.op3_ngram_jaccard_join(spark, SF).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in ids}


def test_op3_odd_rows(spark):
    rows = [(1, "a b c"), (2, "A  b c"), (3, None), (4, " "), (5, "x" * 5000), (6, "a b d")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    assert jaccard_components(docs(spark, [])).count() == 0
    assert sorted(r["doc_id"] for r in one_of_each(docs(spark, rows)).collect()) == [1, 3, 4, 5, 6]


def test_op2_blocks(spark):
    shared = [f"shared line number {i} with rather more words than eight in it" for i in range(6)]
    rows = [(1, "\n".join(["own start one", *shared, "own end one"])), (2, "\n".join(["other start two", *shared, "short"])), (3, None), (4, ""), (5, "nothing of that kind here")]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in dedup_lines(docs(spark, rows)).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("other start two\nshort", 6)
    assert got[3] == (None, 0) and got[4] == ("", 0) and got[5][1] == 0
    assert patience([(0, 5), (1, 2), (2, 3), (3, 1)]) == [(1, 2), (2, 3)]
    assert dedup_lines(docs(spark, [])).count() == 0


def test_op2_repeated_moved_and_mixed_runs(spark):
    say = [f"passage {i} has nine words of its own here" for i in range(12)]
    rows = [
        (1, "\n".join([say[0], "again and again", say[0], "again and again", say[0], "again and again"])),
        (2, "\n".join(["second start", say[0], "again and again", say[0], "again and again", say[0], "again and again"])),  # no line is unique
        (3, "\n".join([say[1], "third", say[2], "third", say[3]])),
        (4, "\n".join([say[1], say[2], say[3], say[4]])),
        (5, "\n".join([say[1], say[2], say[3], say[4], "fifth end"])),  # lines first held by 3 and by 4, the run by 4
        (6, "\n".join(["sixth start", *say[9:12], "between", *say[6:9]])),
        (7, "\n".join(["seventh start", *say[6:9], "other", *say[9:12]])),  # passages of 6 in another order
        (8, "\n".join(["one two three"] * 3)),  # 9 words in all: no block
        (9, "\n".join(["ninth", *["one two three"] * 3])),
    ]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in dedup_lines(docs(spark, rows)).collect()}
    assert got[2] == ("second start", 6) and got[5] == ("fifth end", 4) and got[7] == ("seventh start\nother", 6)
    assert all(got[i] == (rows[i - 1][1], 0) for i in (1, 3, 4, 6, 8, 9))


def test_op2_repeated_rows(spark):
    say = [f"passage {i} has nine words of its own here" for i in range(6)]
    first, later = (1, "\n".join(["first start", *say])), (2, "\n".join(["second start", *say]))
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in dedup_lines(docs(spark, [first] * 3 + [later] * 40)).collect())
    assert got == [(*first, 0)] * 3 + [(2, "second start", 6)] * 40
    n = docs(spark, [first] * 3 + [later] * 40)
    assert [sorted(r["gone"]) for r in shared_blocks(n).collect()] == [[1, 2, 3, 4, 5, 6]]


def test_op4_against_brute_force_and_ablations(spark):
    rows = [(1, "a b c a b c " * 20), (2, None), (3, ""), (4, " ".join(f"word{i}" for i in range(80))), (5, "w\nw\n\nw | & #")]
    got = {r["doc_id"]: r for r in ledger(docs(spark, rows)).collect()}
    assert (got[1]["n_words"], got[1]["n_repeat_words"]) == (120, 120) and got[2]["n_words"] == got[3]["n_words"] == 0
    assert (got[5]["n_dup_lines"], got[5]["n_symbols"], got[5]["word_chars"]) == (1, 3, 6)
    led = ledger(docs(spark, rows))
    assert sorted(r["doc_id"] for r in led.where(apply_policy(led, "keep-1")).collect()) == [4]
    by = {r["rule"]: r for r in ablations(led, "base-1").collect()}
    assert by["few_words"]["n_failed"] == 3 and by["repeated_words"]["n_only"] == 1


def test_op5_held_out(spark):
    found = Q.op5_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("score", "predicted", "toxic").collect()
    y, p, s = (np.array([r[c] for r in found]) for c in ("toxic", "predicted", "score"))
    ranks = s.argsort().argsort() + 1
    n1, n0 = y.sum(), (1 - y).sum()
    assert (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.9
    assert (p == y).mean() > 0.9
    odd = toxicity(docs(spark, [(1, None), (2, "")]), spark.createDataFrame([], LABELS)).collect()
    assert {r["predicted"] for r in odd} == {0} and len(odd) == 2


def test_op1_weights_and_ties(spark):
    found = Q.op1_quality_classifier(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    mean = {r["quality"]: r["m"] for r in found.join(labels, "doc_id").groupBy("quality").agg(F.avg("log_ratio").alias("m")).collect()}
    assert mean[1] > mean[0]
    rows = found.collect()
    keys = {r["doc_id"]: r["key"] for r in rows}
    chosen = {r["doc_id"] for r in rows if r["selected"]}
    assert chosen == set(sorted(keys, key=lambda i: (-keys[i], i))[: len(chosen)])
    tied = spark.createDataFrame([(i, 1.0) for i in range(9)], "doc_id long, key double")
    assert sorted(r["doc_id"] for r in top_k(tied, 4).where("selected").collect()) == [0, 1, 2, 3]
    assert resample(docs(spark, []), spark.createDataFrame([], LABELS)).count() == 0


ARTICLE = "<html><head><title>T</title></head><body><nav>Menu</nav><header>Site</header>{}<aside>More</aside><footer>F</footer></body></html>"


@pytest.mark.parametrize(
    "html, text",
    [
        (ARTICLE.format("<article><header><h1>A &amp; B</h1></header><p>One<br>two <b>three</b><p>Four</article>"), "A & B\nOne two three\nFour"),
        (ARTICLE.format("<main><div class='cookie-notice'>Ok?</div><p>x  y</p><section id=comments><p>me too</p></section></main>"), "x y"),
        ("<article><p>a<script>var p = '</p>';</script> b</p><form>Mail <input></form><article class='comment'>hi</article>", "a b"),
        ("<div class='ad'>buy</div><div id='content'><p>kept</p><div class='share'>s</div></div><p>outside</p>", "kept"),
        ("<p>cut off <a href='x", "cut off"),
        ("", ""),
    ],
)
def test_op6_marks(html, text):
    assert "\n".join(line for line, state in page_lines(html) if state) == text


def test_op6_differencing(spark):
    page = "<p>Welcome to the site</p><p>Own text number {}</p><p>All rights kept</p>"
    rows = [(i, f"http://h.example/a/{i}", page.format(i)) for i in range(4)] + [(9, None, None), (10, "http://solo.example/", "<p>alone</p>")]
    found = extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in found.collect()}
    assert all(got[i][0] == f"Own text number {i}" for i in range(4))
    assert got[9] == ("", 0) and got[10] == ("alone", 5)
    same = [(i, f"http://h.example/b/{i}", page.format(7)) for i in range(3)]
    assert {r["n_shared"] for r in extract(spark.createDataFrame(same, "page_id long, url string, html string")).collect()} == {0}
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_common_lines_against_dynamic_programming():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(0, 14)).tolist() for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = common_lines(a, b)
        it = iter(b)
        assert len(got) == best[-1][-1] and all(any(a[i] == y for y in it) for i in got)


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(Q.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


ODD = [(1, None), (2, ""), (3, "Hello  WORLD, it's 42!"), (4, "naïve ÄÖ 漢字 🙂 <|endoftext|> x"), (5, "a" * 3000), (6, "Hello  WORLD, it's 42!")]


def test_op7_round_trip(spark):
    t, all_texts = tokenizer(), {**texts(spark), **{i + 10**6: x or "" for i, x in ODD}}
    both = spark.read.parquet(f"{SF}/documents.parquet").unionByName(docs(spark, [(i + 10**6, x) for i, x in ODD]))
    for r in encode_decode(both, Q.vocabulary()).collect():
        ids = t.encode(all_texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_packs(rows, sizes):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["doc_tokens"] == sizes[r["doc_id"]] and r["length"] > 0
    for i, pieces in by_doc.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == sizes[i]
    assert set(by_doc) == set(sizes)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    return sum(sizes.values()), sum(max(2048 if n & (n - 1) else n, n) for n in (sum(x for _, x in p) for p in by_sequence.values()))


def test_op10_packs_every_token_once(spark):
    t = tokenizer()
    sizes = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in texts(spark).items()}
    used, room = check_packs(Q.op10_packing(spark, SF).collect(), sizes)
    assert used / room > 0.95
    odd = {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in ODD}
    check_packs(pack_documents(docs(spark, ODD), Q.vocabulary()).collect(), odd)
    assert pack_documents(docs(spark, []), Q.vocabulary()).count() == 0


def test_op8_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16))
    x[100:300] = x[100]  # a third are copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [])]
    found = search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 20, 20, Graph(shard_rows=200, batch=64, insert=128)).collect()
    x = x.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 600, 20):
        got = [(r["vec_id"], r["score"]) for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])]
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:20].tolist()
        assert len(got) == 20 and all(abs(v - s[i]) < 1e-9 for i, v in got)
        assert got == sorted(got, key=lambda g: (-g[1], g[0]))
        hits += len(set(best) & {i for i, _ in got})
    assert hits / (30 * 20) >= 0.9
    assert not {r["query_id"] for r in found} & {1000, 1001}
    assert search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    few = search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in few] == [(0, 1, 1)]


def test_op9_rules(spark):
    urls = ["http://A.example.com/en/7x", "http://b.example.com/en/8", "https://x.net/de/81", "https://www.example.net/de/8", "http://spam-farm.example.com/fr/1", "http://notspam-farm.example.com/", "no scheme", None, "http://o.org/es/?q#f"]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got == {0: ("example.com/en/7", "allow"), 1: ("com/en/", "block"), 2: ("net/de/", "allow"), 3: ("example.net/de/8", "block"), 4: (None, "block"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: ("org/es/", "block")}


def test_pipeline_packs_what_its_stages_keep(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "line dedup", "n-gram Jaccard join", "packing"]
    start = spark.read.parquet(f"{SF}/documents.parquet")
    held = start
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, SF)
        assert out.columns == start.columns and 0 < out.count() <= held.count()
        held = out
    t = tokenizer()
    sizes = {r["doc_id"]: len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in held.collect()}
    check_packs(corpus_pipeline.run(spark, SF).collect(), sizes)


def test_op8_repeated_rows_share_a_vector(spark):
    rows = [(0, [1.0, 0.1])] + [(5, [1.0, 0.0])] * 30 + [(i, [1.0, 0.0]) for i in range(6, 31)] + [(i, [-1.0, 0.0]) for i in range(41, 50)]
    found = search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).where("query_id = 0").collect()
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"])] == list(range(5, 25))
