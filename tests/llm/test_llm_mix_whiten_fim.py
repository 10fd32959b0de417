"""Source mixing, whitening and fill-in-middle against brute force, exact round trips and SQL, with odd rows."""

import hashlib
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnspark.llm import queries as Q
from cairnspark.llm import source_mixing as mixing
from cairnspark.llm import whitening as white
from cairnspark.llm.common import Scratch
from cairnspark.llm.fill_in_middle import fill_in_middle, restored

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


def seats_by_hand(votes, most, house):
    """Sainte-Lague, one seat at a time."""
    got = [0] * len(votes)
    for _ in range(house):
        open_ = [i for i in range(len(votes)) if got[i] < most[i] and votes[i] > 0]
        if not open_:
            break
        got[max(open_, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
    return got


@pytest.mark.parametrize("votes, most, house", [([10.0, 20.0, 30.0, 0.0], [99] * 4, 17), ([5.0] * 7, [99] * 7, 10), ([1000.0, 1.0, 1.0], [3, 40, 40], 20), ([3.0, 1.0], [1, 1], 9), ([1.0, 2.0], [9, 9], 0)])
def test_op11_highest_quotients(spark, votes, most, house):
    rows = spark.createDataFrame([(i, float(v), m) for i, (v, m) in enumerate(zip(votes, most))], "place long, votes double, most_seats long")
    got = mixing.apportion(Scratch(spark), rows, house).orderBy("place").collect()
    assert [r["seats"] for r in got] == seats_by_hand(votes, most, house)


def test_op11_shards_get_their_source_s_seats(spark):
    cells = [("a", s, b, 50) for s, b in enumerate([10, 0, 7, 7, 3])] + [("b", 0, 4, 12), ("b", 1, 1, 12)] + [("c", 5, 9, 0)]
    got = mixing.shard_quotas(spark.createDataFrame(cells, "key string, shard long, blocks long, seats long")).collect()
    for key in "abc":
        own = sorted((r["shard"], r["blocks"], r["quota"], r["seats"]) for r in got if r["key"] == key)
        assert [q for _, _, q, _ in own] == seats_by_hand([float(b) for _, b, _, _ in own], [3 * b for _, b, _, _ in own], own[0][3])


def targets_by_hand(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, total, full = {s: 1 + i % 3 for i, s in enumerate(names)}, sum(sizes.values()), set()
    while True:
        level = Fraction(total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in names if s not in full) or 1)
        more = {s for s in names if s not in full and weight[s] * level > 3 * sizes[s]}
        if not more:
            return {s: float(3 * sizes[s] if s in full else weight[s] * level) for s in names}
        full |= more


@pytest.mark.parametrize("seed", [1, 9])
def test_op11_takes_near_the_targets(spark, seed):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))) if i % 13 else None, [None, "b", "a", "é", "", "B", "hot", "hot", "hot"][i % 9]) for i in range(1500)]
    rows += [(7, "x y", "tiny"), (7, "x y", "tiny"), (None, "a b c", "tiny"), (5000, "v " * 40_000, "hot"), (5001, "", "empty")]
    made = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit("clash")).withColumn("key", F.lit(1))
    mixed = mixing.mix(made, seed=seed)
    mixed = Scratch(spark).keep(mixed)
    got = mixed.collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = targets_by_hand(sizes), {}
    assert sorted(r["doc_id"] or -1 for r in got) == sorted(i or -1 for i, _, _ in rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    block = got[0]["block_words"]
    for s, n in taken.items():  # rounding, and the last block of a source may be short
        assert abs(n - want[s]) <= 4 * block, (s, n, want[s])
    again = mixing.mix(made.repartition(7), seed=seed).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    spans = mixing.spans(mixed).groupBy("doc_id", "source").agg(F.sum(F.col("length") * F.col("copies")).alias("n"), F.max("copies").alias("most")).collect()
    assert max(r["most"] for r in spans) <= 3
    by = mixed.groupBy("doc_id", "source").agg(F.sum("taken").alias("n")).where("n > 0").collect()
    assert {(r["doc_id"], r["source"]): r["n"] for r in spans} == {(r["doc_id"], r["source"]): r["n"] for r in by}


def test_op11_empty_and_wordless_tables(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], DOCS)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("name", ["op11_source_mixing", "op13_fill_in_middle"])
def test_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = Q.QUERIES[name](spark, SF)
    rel = duck.sql(Q.ORACLES[name])
    at = [list(rel.columns).index(c) for c in df.columns]

    def plain(row):
        return repr([round(v, 6) if isinstance(v, float) else v for v in row])

    assert sorted(plain(r) for r in df.collect()) == sorted(plain([r[i] for i in at]) for r in rel.fetchall())


def whitened_by_hand(rows):
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - s[j] for j in range(d)] for r in x]
    exact = [[sum(r[i] * r[j] for r in y) for j in range(d)] for i in range(d)]
    return n, y, exact


def test_op12_against_exact_integers(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    n, y, exact = whitened_by_hand([r["embedding"] for r in df.collect()])
    rows = white.usable(df).select("vec_id", "v")
    m, total, widest = white.sums(rows)
    assert m == n and white.scatter(rows, n, total, widest) == exact
    v = np.array([[e / n**3 for e in row] for row in exact])
    values, vectors = np.linalg.eigh(v)
    by = {}
    for r in Q.op12_embedding_whitening(spark, SF).collect():
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    own = {r["vec_id"]: yy for r, yy in zip(df.collect(), y)}
    assert by.keys() == own.keys()
    for i, comps in by.items():
        assert sorted(comps) == list(range(1, 9))
        for k, r in comps.items():
            e, axis = values[-k], vectors[:, -k]
            assert r["n"] == n and r["deviation"] == sum(c * c for c in own[i])
            assert r["explained"] == pytest.approx(e / np.trace(v), rel=1e-9)
            assert abs(r["whitened"]) == pytest.approx(abs(np.dot(np.array(own[i], float) / n, axis) / np.sqrt(e)), abs=1e-6)
            assert r["identity_error"] < 1e-9


def test_op12_primes_and_remainders():
    basis = white.primes(10**40)
    assert len(set(basis)) == len(basis) and all(all(p % q for q in range(2, 1100)) for p in basis) and np.prod([float(p) for p in basis]) > 1e40
    wanted = [[-(10**38), 5], [5, 10**38]]
    residues = np.array([[x % p for row in wanted for x in row] for p in basis])
    assert white.chinese(residues, basis, 2) == wanted
    y = np.array([[-(1 << 61), 3, (1 << 61) - 1], [0, -1, 7]])
    assert white.squares(y) == [sum(int(c) ** 2 for c in row) for row in y] == white.squares(y.astype(object))


def test_op12_odd_rows(spark):
    kind = "vec_id long, embedding array<float>, label int, n int, whitened string"
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=3).tolist(), 0, 1, "clash") for i in range(20)] + [(3, [0.5, 0.25, 0.125], 0, 1, ""), (None, [0.5, 0.25, 0.125], 0, 1, "")]
    odd = [(90, None, 0, 1, ""), (91, [], 0, 1, ""), (92, [1.0, None, 2.0], 0, 1, ""), (93, [1.0, float("nan"), 2.0], 0, 1, ""), (94, [1.0, float("-inf"), 2.0], 0, 1, ""), (95, [1.0] * 5, 0, 1, "")]
    got = white.whiten(spark.createDataFrame(good + odd, kind)).collect()
    assert sorted(r["vec_id"] or -1 for r in got) == sorted(r[0] or -1 for r in good) and {len(r["whitened"]) for r in got} == {3}
    n, y, _ = whitened_by_hand([np.float32(r[1]) for r in good])
    assert sorted(int(r["deviation"]) for r in got) == sorted(sum(c * c for c in row) for row in y) and got[0]["identity_error"] < 1e-9
    same = white.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, 1, "")] * 3, kind)).collect()
    assert [(r["whitened"], list(r["explained"]), r["identity_error"], int(r["deviation"])) for r in same] == [([None, None], [0.0, 0.0], 0.0, 0)] * 3
    huge = white.whiten(spark.createDataFrame([(i, [3e38 if i == 1 else float(i), 1.0 * i * i], 0, 1, "") for i in range(1500)], kind))  # beyond 64 bits
    assert huge.where("deviation is null or whitened[0] is null").count() == 0
    assert white.whiten(spark.createDataFrame([], kind)).count() == 0


FIM_ROWS = [(1, ""), (2, None), (3, "a"), (4, "<"), (5, "x <S> y"), (6, "a\x01b\x02c\x020\x021\n\r d"), (7, "\x01\x01\x02\x02"), (8, "é😀 word٣ Word<P"), (None, "one two three"), (9, "M><S< P>" * 9), (10, "lo ng " * 60_000)]


def test_op13_against_brute_force(spark):
    rows = FIM_ROWS + [(100 + i, f"Ab{i}, c<d>e\x01 f! <" * (i % 5)) for i in range(300)]
    made = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows + rows[:3]], "doc_id long, text string, form string, extra int")
    got = fill_in_middle(made).withColumn("again", restored()).collect()
    assert len(got) == len(rows) + 3 and {r["form"] for r in got} == {"plain", "psm", "spm"}
    seen = {}
    for r in got:
        seen.setdefault((r["doc_id"], r["text"]), r)
    for i, t in rows:
        r, text = seen[i, t], t or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        name = hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
        h = [int(name[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        chars = (None, None) if form == "plain" else (len(p), len(m))
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["again"], r["extra"]) == (len(units), form, *chars, out, text, 1)


def test_op13_every_cut_and_empty_table(spark):
    made = spark.createDataFrame([(i, "a b\x01") for i in range(400)], "doc_id long, text string")
    got = fill_in_middle(made, seed=4).withColumn("again", restored()).collect()
    assert all(r["again"] == "a b\x01" for r in got) and {(r["prefix_chars"], r["middle_chars"]) for r in got if r["form"] != "plain"} == {(p, m) for p in range(5) for m in range(5 - p)}
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
