"""N-gram Jaccard join: exact grouped prefix join on word shingles.

Links are defined on distinct shingle sets, so exact copies collapse first. A document that can link at
all has, in the prefix of its set under one fixed order, a share of shingles that other sets have too; one
shuffle of those prefixes drops all others. The rest is ordered by frequency, rarest first. Documents with
identical prefixes and size form one group. Groups meet on prefix shingles, pass the size and position
filters, then expand to members that are verified on whole sets.

Large families of near copies never become all pairs: each group is first verified against the most central
group that it shares a prefix shingle with (that whose shingles are most frequent on average), then, where it
still lies apart, against the most central one of every shingle and its neighbour in size. Only pairs that lie
in different components even then are tried through every shared prefix shingle, if the parity bits of both
sets do not already show that they differ in too many shingles. No candidate is capped, so components are exact.

Results: documents with null or word-free text have n_shingles 0 and are their own component; repeated rows
keep one row each; extra columns are ignored; an empty table gives an empty result. A null doc_id is a
document like any other: it links others, and its component is null unless a member has an id. Sets are told
apart by size and a 64-bit digest of their shingles' 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.llm.common import Scratch, byte_groups, components, maybe_broadcast, text_or_empty, worker_caches
from cairnspark.llm.word_hash import shingle_sets

#: Longs of a set's parity bits.
PARITY = 8


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity num / den or more."""

    num: int = 75
    den: int = 100

    def least_overlap(self, n):
        return -((-self.num * n) // self.den)

    def extra(self, n):
        """Shared shingles asked of the longer of two prefixes; grows with the set."""
        return n // 8 + 1

    def prefix(self, n):
        return np.minimum(n, n - self.least_overlap(n) + self.extra(n))

    def need(self, n):
        """Every link leaves at least so many shared shingles in the prefix of a set of n."""
        return self.extra(self.least_overlap(n))


def _digest(s: np.ndarray) -> int:
    """Order-free 64-bit digest of a set of well mixed hashes."""
    with np.errstate(over="ignore"):
        x = np.uint64(len(s)) * np.uint64(0x9E3779B97F4A7C15) + s.sum(dtype=np.uint64)
        y = np.bitwise_xor.reduce(s * np.uint64(0xC2B2AE3D27D4EB4F)) if len(s) else np.uint64(0)
        return int((x ^ (y >> np.uint64(17)) ^ (y << np.uint64(47))).astype(np.int64))


def _sets(batch: pa.RecordBatch, n_words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for at, part in byte_groups(batch.column(batch.schema.get_field_index("text"))):
        yield at, list(shingle_sets([t.lower() for t in part], n_words))


def _parity(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each bit: two sets differ in at least as many shingles as bits."""
    odd = np.bincount((s & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_digests(docs: DataFrame, n_words: int = 5) -> DataFrame:
    """(doc_id, text_key, n, sid): size and digest of each document's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_caches("shingles")
        for b in batches:
            for at, sets in _sets(b, n_words):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(sets)), b.column(1).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.int64())],
                    ["doc_id", "text_key", "n", "sid"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, text_key long, n long, sid long")


def _prefix_rows(docs: DataFrame, n_words: int, at_least: Threshold) -> DataFrame:
    """(token, sid, known): prefix shingles of each set under the order of their hashes.

    A shingle that two sets of one batch hold is known to be shared: two witnesses stand for it, and its
    sets carry a count instead of a row, so a frequent shingle costs two rows a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_caches("shingles")
        for b in batches:
            seen: dict[int, np.ndarray] = {}
            for _, sets in _sets(b, n_words):
                for s in sets:
                    if len(s):
                        seen.setdefault(_digest(s), s[: int(at_least.prefix(len(s)))].copy())
            if not seen:
                continue
            sid = np.fromiter(seen, np.int64, len(seen))
            sizes = np.array([len(s) for s in seen.values()])
            token = np.concatenate(list(seen.values()))
            own = np.repeat(np.arange(len(sid)), sizes)
            order = np.argsort(token, kind="stable")
            token, own = token[order], own[order]
            fresh = np.r_[True, token[1:] != token[:-1]]
            start = np.flatnonzero(fresh)
            place = np.arange(len(token)) - np.repeat(start, np.diff(np.r_[start, len(token)]))
            counted = np.bincount(own[place >= 2], minlength=len(sid))
            row = place < 2
            more = counted > 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((token[row].view(np.int64), sid[more]))),
                    pa.array(np.concatenate((sid[own[row]], sid[more]))),
                    pa.array(np.concatenate((np.zeros(row.sum(), np.int32), counted[more].astype(np.int32)))),
                ],
                ["token", "sid", "known"],
            )

    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "token long, sid long, known int")


def _set_rows(docs: DataFrame, n_words: int) -> DataFrame:
    """(sid, n, tokens, bits): whole sets and their parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_caches("shingles")
        for b in batches:
            for at, sets in _sets(b, n_words):
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_digest(s) for s in sets], pa.int64()),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, PARITY * len(sets) + 1, PARITY, dtype=np.int32)), pa.array(np.concatenate([_parity(s) for s in sets]))),
                    ],
                    ["sid", "n", "tokens", "bits"],
                )

    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "sid long, n long, tokens array<long>, bits array<long>")


def _verify(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """The pairs (a, b) of set ids whose whole sets reach the threshold."""
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b").where(t.den * both >= t.num * (F.col("na") + F.col("nb") - both)).select("a", "b")


def jaccard_components(docs: DataFrame, n_words: int = 5, threshold: Threshold = Threshold()) -> DataFrame:
    """(doc_id, text_key, n_shingles, component, component_id) of every row of docs(doc_id, text, ...).

    component is the smallest set digest of the component, component_id its smallest doc_id.
    """
    spark, t = docs.sparkSession, threshold
    scratch = Scratch(spark)
    digests = scratch.keep(shingle_digests(docs, n_words))
    reps = digests.where("n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("rep"))

    # sets that can link at all
    by_token = Window.partitionBy("token")
    rows = _prefix_rows(docs, n_words, t)
    tested = rows.select("sid", F.when(F.col("known") > 0, F.col("known")).when(F.min("sid").over(by_token) != F.max("sid").over(by_token), 1).otherwise(0).alias("hits"))
    hits = tested.where("hits > 0").groupBy("sid").agg(F.sum("hits").alias("hits"))
    low = F.ceil(F.col("n") * t.num / t.den)
    able = scratch.keep(hits.join(reps, "sid").where(F.col("hits") >= F.floor(low / 8) + 1).select("sid", "n", "rep"))
    n_able = able.count()
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = whole.join(maybe_broadcast(able.select("rep"), n_able), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    sets = _set_rows(whole, n_words).join(maybe_broadcast(able.select("sid", "n"), n_able), ["sid", "n"], "left_semi")
    sets = scratch.keep(sets.dropDuplicates(["sid"]))

    # frequency order, prefixes and groups
    token = sets.select("sid", "n", F.explode("tokens").alias("token"))
    shared = token.select("sid", "n", "token", F.count(F.lit(1)).over(by_token).alias("df")).where("df > 1")
    lists = shared.groupBy("sid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("list"))
    alone = F.col("n") - F.size("list")
    room = F.col("n") - low + 1 - alone
    weight = F.aggregate("list", F.lit(0.0), lambda total, x: total + x["df"]) / F.col("n")
    heads = lists.where(room > 0).select("sid", "n", alone.alias("alone"), weight.alias("weight"), F.transform(F.slice("list", F.lit(1), room.cast("int")), lambda x: x["token"]).alias("head"))
    heads = scratch.keep(heads.withColumn("head_id", F.xxhash64("head")))
    group = Window.partitionBy("head_id", "n", "alone")
    members = scratch.keep(heads.select("sid", "n", F.min("sid").over(group).alias("gid")))
    groups = heads.join(members.where("sid = gid").select("sid"), "sid")
    entries = groups.select(F.col("sid").alias("gid"), "n", "alone", "weight", F.posexplode("head").alias("pos", "token"))
    entries = scratch.keep(entries.select("token", "gid", "n", "weight", (F.col("n") - F.col("alone") - F.col("pos")).alias("left")))
    scratch.drop(heads)

    def fits(na: str, la: str, nb: str, lb: str):
        """Size and position filters: the shingles from here on can still reach the overlap."""
        reach = F.least(F.col(la), F.col(lb))
        return (t.num + t.den) * reach >= t.num * (F.col(na) + F.col(nb))

    def sized(na: str, nb: str):
        return t.den * F.least(na, nb) >= t.num * F.greatest(na, nb)

    def alike(na: str, ba: str, nb: str, bb: str):
        """Parity filter: sets that differ in more shingles than the overlap allows are no link; unknown bits pass."""
        odd = sum((F.bit_count(F.col(ba)[i].bitwiseXOR(F.col(bb)[i])) for i in range(PARITY)), F.lit(0))
        most = F.col(na) + F.col(nb) - 2 * F.ceil(t.num * (F.col(na) + F.col(nb)) / (t.num + t.den))
        return F.col(ba).isNull() | F.col(bb).isNull() | (odd <= most)

    def place(held: DataFrame, links: DataFrame) -> DataFrame:
        """held(gid, sid, n, component) after new links, which join whole components."""
        at = held.select("sid", "component")
        ends = links.join(at.select(F.col("sid").alias("a"), F.col("component").alias("ca")), "a").join(at.select(F.col("sid").alias("b"), F.col("component").alias("cb")), "b")
        label = components(scratch, ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select("node", F.col("component").alias("joined"))
        return scratch.keep(held.join(label, F.col("component") == F.col("node"), "left").select("gid", "sid", "n", F.coalesce("joined", "component").alias("component")))

    # first round: each group against the most central one that it meets, each member against its group
    central = F.max(F.struct("weight", "gid", "n")).over(by_token)
    star = entries.select("gid", "n", central.alias("hub")).groupBy("gid", "n").agg(F.max("hub").alias("hub"))
    star = star.where((F.col("gid") != F.col("hub.gid")) & sized("n", "hub.n")).select(F.least("gid", "hub.gid").alias("a"), F.greatest("gid", "hub.gid").alias("b"))
    tried = scratch.keep(star.union(members.where("sid != gid").select(F.col("gid").alias("a"), F.col("sid").alias("b"))).distinct())
    placed = place(members.withColumn("component", F.col("sid")), scratch.keep(_verify(tried, sets, t)))

    # second round: those that lie apart so far against the most central one and the next in size of every shingle
    chain = Window.partitionBy("token").orderBy("n", "gid")
    near = entries.join(placed.where("sid = gid").select("gid", "component"), "gid")
    met = F.array(F.max(F.struct("weight", "gid", "n", "component")).over(by_token), F.lag(F.struct("weight", "gid", "n", "component")).over(chain))
    near = near.select("gid", "n", "component", met.alias("met")).where(F.exists("met", lambda x: x["component"] != F.col("component")))
    near = near.select("gid", "n", F.explode(F.filter("met", lambda x: x["component"] != F.col("component"))).alias("x")).select(F.least("gid", "x.gid").alias("a"), F.greatest("gid", "x.gid").alias("b"), "n", F.col("x.n").alias("xn")).where(sized("n", "xn"))
    near = scratch.keep(near.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
    tried, members = tried.union(near), place(placed, scratch.keep(_verify(near, sets, t)))

    # last round: all candidates that still lie apart
    spread = members.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"))
    bits = sets.select(F.col("sid").alias("gid"), "bits")
    placed = entries.join(spread, "gid").select("token", "gid", "n", "left", F.when(F.col("low") == F.col("high"), F.col("low")).alias("one"), (F.col("size") == 1).alias("single"))
    main = F.max_by("one", "same").over(by_token)
    placed = placed.withColumn("same", F.count("one").over(Window.partitionBy("token", "one")))
    placed = placed.withColumn("main", main).withColumn("others", F.count(F.when(F.col("one").isNull() | (F.col("one") != F.col("main")), 1)).over(by_token)).where("others > 0")
    placed = placed.join(bits, "gid").withColumn("bits", F.when(F.col("single"), F.col("bits")))  # members of a group share the prefix alone
    step = lambda n: F.floor(F.log(n) / F.log(F.lit(1.08)))
    index = placed.select("token", F.col("gid").alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"), F.col("one").alias("ob"), F.col("bits").alias("bb"), step(F.col("n")).alias("band"))
    probe = placed.where("one is null or one != main").select("token", F.col("gid").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"), F.col("one").alias("oa"), F.col("bits").alias("ba"))
    most = F.floor((F.col("la") * (t.num + t.den)) / t.num - F.col("na"))
    probe = probe.withColumn("most", F.least(most, F.floor(F.col("na") * t.den / t.num))).where(F.col("most") >= F.ceil(F.col("na") * t.num / t.den))
    probe = probe.withColumn("band", F.explode(F.sequence(step(F.ceil(F.col("na") * t.num / t.den)), step(F.col("most")))))
    apart = F.col("oa").isNull() | F.col("ob").isNull() | (F.col("oa") != F.col("ob"))
    pairs = probe.join(index, ["token", "band"]).where((F.col("a") != F.col("b")) & apart & fits("na", "la", "nb", "lb") & alike("na", "ba", "nb", "bb"))
    within = spread.where("low != high").select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(within).distinct()
    left = members.select(F.col("gid").alias("a"), F.col("sid").alias("sa"), F.col("component").alias("ca"))
    right = members.select(F.col("gid").alias("b"), F.col("sid").alias("sb"), F.col("component").alias("cb"))
    before = tried
    tried = pairs.join(left, "a").join(right, "b").where("ca != cb and (a != b or sa < sb)")
    tried = tried.select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b")).distinct().join(before, ["a", "b"], "left_anti")
    final = place(members, scratch.keep(_verify(tried, sets, t))).select(F.col("sid").alias("node"), "component")
    scratch.drop(entries, sets)

    # smallest doc_id of each component, over all copies
    owner = reps.join(final, F.col("sid") == F.col("node")).select("sid", "n", "component", "rep")
    linked = scratch.keep(owner.select("sid", "n", "component", F.min("rep").over(Window.partitionBy("component")).alias("least")))
    known = reps.join(linked, ["sid", "n"], "left").select("sid", "n", F.coalesce("component", "sid").alias("component"), F.coalesce("least", "rep").alias("component_id"))
    known = known.join(digests.where("n > 0"), ["sid", "n"], "right").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component", "component_id")
    none = digests.where("n = 0").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return known.unionByName(none)


def one_of_each(docs: DataFrame, n_words: int = 5, threshold: Threshold = Threshold()) -> DataFrame:
    """One row of docs for each component: of its smallest doc_id (null only if no member has an id).

    Rows are told apart by id and text, so a doc_id that repeats loses only the texts that are copies. Of rows
    with the same id and text one stays. Texts without words are no copies and all stay.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(jaccard_components(docs, n_words, threshold).where("n_shingles > 0"))
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    heads = found.where(first).groupBy("component").agg(F.min("text_key").alias("best"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    rivals = found.where(first).join(heads, "component").where("text_key != best")
    later = found.where(~first).select("doc_id", "text_key").unionByName(rivals.select("doc_id", "text_key"))
    later = scratch.keep(later.distinct().select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")))
    twice = found.groupBy("doc_id", "text_key").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    twice = scratch.keep(twice)
    n_twice = twice.count()
    keyed = docs.withColumn("__doc", F.col("doc_id").cast("long")).withColumn("__text", F.xxhash64("text"))
    same = F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key"))
    kept = keyed.join(maybe_broadcast(later), same, "left_anti")
    if not n_twice:
        return kept.select(docs.columns)
    again = kept.join(maybe_broadcast(twice, n_twice), same, "left_semi").dropDuplicates(["__doc", "__text"])
    return kept.join(maybe_broadcast(twice, n_twice), same, "left_anti").unionByName(again).select(docs.columns)
