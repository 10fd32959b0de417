"""Splits of whole documents: what every cut has to keep, and small models of the embedder and of diversity."""

import hashlib
import itertools
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cairnspark.functions import vectors as V
from cairnspark.operators import chunking as K
from cairnspark.operators import retrieval as R
from cairnspark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def parts_of(spark, how):
    got = {}
    for r in K.split_documents(spark.read.parquet(f"{SF}/documents.parquet"), how).collect():
        got.setdefault(r["doc_id"], []).append((r["part"], r["text"]))
    return {i: [t for _, t in sorted(v)] for i, v in got.items()}


def letters(text):
    return re.sub(r"\s", "", text)


def test_sentences_are_whole_full_and_complete(spark, texts):
    for i, parts in parts_of(spark, "sentence").items():
        assert letters("".join(parts)) == letters(texts[i])
        assert all(len(p) <= K.PARENT for p in parts)
        ends = {m.end() for m in re.finditer(r"[。！？.!?\n]", texts[i])}
        at = 0
        for p, after in itertools.pairwise(parts):
            at = texts[i].index(p, at) + len(p)
            # a part ends at a sentence's end unless one sentence alone is longer, and the next sentence would not have fitted
            cut_hard = not any(at <= e <= at + 1 or e == at for e in ends) and at not in ends
            if not cut_hard:
                following = next(e for e in sorted(ends) + [len(texts[i])] if e > texts[i].index(after, at))
                assert len(p) + following - texts[i].index(after, at) > K.PARENT - 2 or len(after) == K.PARENT


def test_fixed_windows_overlap_and_cover(spark, texts):
    for i, parts in parts_of(spark, "fixed").items():
        text, covered = texts[i], 0
        for k, p in enumerate(parts):
            at = text.index(p, max(0, covered - K.OVERLAP) if k else 0)  # a window begins so far before the last one's end
            assert at <= covered or not text[covered:at].strip()
            assert len(p) <= K.CHILD + 50 and at + len(p) > covered
            covered = at + len(p)
        assert not text[covered:].strip()


@pytest.mark.parametrize("mode", ["naive", "laws", "paper", "fixed", "sentences"])
def test_chunks_keep_their_documents(spark, texts, mode):
    by = {}
    for r in K.chunk_documents(spark.read.parquet(f"{SF}/documents.parquet"), mode).collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {i for i, t in texts.items() if t.strip()}
    for i, rows in by.items():
        rows.sort(key=lambda r: r["child_index"])
        assert [r["child_index"] for r in rows] == list(range(len(rows)))
        numbers = [r["parent_index"] for r in rows]
        assert numbers == sorted(numbers)
        parents = {r["parent_index"]: r["parent"] for r in rows}
        assert letters("".join(parents[k] for k in sorted(parents))) == letters(texts[i])
        if mode != "fixed":
            for k, p in parents.items():
                own = [r["child"] for r in rows if r["parent_index"] == k]
                assert all(letters(c) in letters(p) for c in own)
        if mode == "laws":
            assert all(letters("".join(r["child"] for r in rows if r["parent_index"] == k)) == letters(p) for k, p in parents.items())


def test_size_guard(spark, texts):
    chunks = K.chunk_documents(spark.read.parquet(f"{SF}/documents.parquet"), "laws")
    rows = K.enforce_limits(chunks).collect()
    assert max(len(r["child"]) for r in rows) <= K.CHILD + 50 and max(len(r["parent"]) for r in rows) <= 2 * K.PARENT
    by = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["child_index"])):
        by.setdefault(r["doc_id"], []).append(r)
    before = {}
    for r in sorted(chunks.collect(), key=lambda r: (r["doc_id"], r["child_index"])):
        before.setdefault(r["doc_id"], []).append(r["child"])
    for i, own in by.items():
        assert [r["child_index"] for r in own] == list(range(len(own)))
        assert letters("".join(r["child"] for r in own)) == letters("".join(before[i]))


def test_question_pairs(spark):
    text = "intro\nQ: one?\nA: first\nmore\n问：二？\n答：第二"
    rows = K.chunk_documents(spark.createDataFrame([(1, text), (2, "no pairs"), (3, None)], "doc_id long, text string"), "qa").orderBy("doc_id", "child_index").collect()
    assert [(r["doc_id"], r["parent"], r["child"]) for r in rows] == [(1, "Q: one?\nA: first\nmore", "one?"), (1, "Q: one?\nA: first\nmore", "first\nmore"), (1, "Q: 二？\nA: 第二", "二？"), (1, "Q: 二？\nA: 第二", "第二"), (2, "no pairs", "no pairs")]


def test_hash_embedding(spark):
    texts = ["Hello hello world", "", None, "你好 abc", "!!"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(V.hash_embedder(32)("t")).collect()]
    for t, v in zip(texts, got):
        want = [0.0] * 32
        low = (t or "").lower()
        han = [c for c in low if "\u4e00" <= c <= "\u9fff"]
        for token in han + [a + b for a, b in zip(han, han[1:])] + re.findall("[a-z0-9]+", low):
            h = int(hashlib.md5(token.encode()).hexdigest(), 16)
            want[h % 32] += 1 if (h >> 8) % 2 else -1
        size = math.sqrt(sum(x * x for x in want)) or 1.0
        assert v == pytest.approx([x / size for x in want])


def test_diversity_against_all_orders(spark):
    hits = [(1, c, s, t) for c, s, t in [(1, 0.9, "aa bb cc"), (2, 0.88, "aa bb cc"), (3, 0.5, "dd ee"), (4, 0.5, "aa dd"), (5, 0.1, "")]]
    got = [r["chunk_id"] for r in R.mmr(spark.createDataFrame(hits, "query_id long, chunk_id long, score double, content string")).orderBy("mmr_rank").collect()]
    sets = {c: set(t.split()) for _, c, _, t in hits}
    score = {c: s for _, c, s, _ in hits}
    order = []
    while len(order) < len(hits):
        def value(c):
            like = max((len(sets[c] & sets[o]) / len(sets[c] | sets[o]) if sets[c] | sets[o] else 0.0 for o in order), default=0.0)
            return 0.7 * score[c] - 0.3 * like
        left = [c for c in sorted(score, key=lambda c: (-score[c], c)) if c not in order]
        order.append(max(left, key=lambda c: (round(value(c), 12), -left.index(c))))
    assert got == order


def test_a_document_is_one_part_whatever_it_holds(spark, tmp_path):
    texts = [None, "", " \n\t\r ", "　 全　", "\xa0a\x0b", "\x1fb\x85", "| x | y |\n| 1 | 2 |", "before\n|x|\n|y|\nafter\n| z |", "<table><tr></tr></table>", "a <table>", "| one", "\ue000p\ue000\ue000e| <\ue000", "\ue0000", "\ue000", "\r\n two lines \r\n\r\n three \f"]
    rows = [(i + 2**60 + 1, t, len(t or "")) for i, t in enumerate(texts)] + [(None, "no id", 5), (None, None, 0), (7, "same id", 7), (7, "same id", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    got = catalog.QUERIES["i9_document_parts"](spark, str(tmp_path)).select("doc_id", "part", "text").collect()
    assert key(got) == key(c.sql(catalog.ORACLES["i9_document_parts"]).fetchall()) and len(got) == 3 * len(rows)
