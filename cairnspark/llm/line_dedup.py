"""Line dedup by pairwise alignment: delete from later documents the blocks that they share with earlier ones.

Every shared line is traced to the first document (smallest doc_id) that has it, and so is every shared run of
consecutive lines that is just ``least_block`` words long. A later document overlaps with such a first holder when
they share a rare line (``least_words`` words or more, at most ``rare`` occurrences in all) or a run, however
frequent: frequent single lines pair nobody. Each such pair is aligned by patience diff: lines that stand once in
either document, and runs, are the anchors; the longest series of anchors in the same order is kept, and each
grows over equal neighbours (blank lines don't count). An aligned block goes from the later document when it
holds ``least_block`` words in all. Runs that the alignment leaves, since they stand in another order, are aligned
again by themselves, so moved passages go too; nothing goes that no alignment holds.

Any block of that many words without a blank line is made up of such runs, so no shared block is lost because its
lines were first seen in several documents or are frequent. Tracing to the first holder makes pairs linear in the
occurrences of a line or run, so nothing is capped, and each later document needs only its own lines and the
positions that they have in first holders: no document is sent to its partners. A line that repeats inside its own
first document is kept.

Results: null text stays null and an empty text stays empty; null doc_id rows stay as they are; rows that
repeat a doc_id are aligned each by its own text, a repeated row like a single one, and a document is never its own partner; extra columns stay
(one named n_removed is replaced); an empty table gives an empty result. A document that loses all
its lines stays, with empty text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import BROADCAST_ROWS, Scratch, maybe_broadcast, worker_caches

LEAST_WORDS = 8
LEAST_BLOCK = 20
RARE = 100
PIECES = "doc_id long, text_key long, place int, rank int, line long, words int, n int, times int"
PIECE_ROWS = 50_000


def patience(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (position here, position there) that increases in both; positions here are sorted."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = [-1] * len(pairs)
    for k, (_, there) in enumerate(pairs):
        j = bisect_left(tails, there)
        back[k] = at[j - 1] if j else -1
        tails[j : j + 1] = [there]
        at[j : j + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(lines: list[tuple[int, int, bool]], runs: list[tuple[int, int, int]], words: dict[int, int], least_block: int) -> set[int]:
    """Ranks that go of one document, from what it shares with one other.

    lines has (rank here, rank there, whether the line stands once in either), runs (rank here, rank there, lines),
    words those of each shared line here. Lines that repeat are no anchors; they join a block beside one. What one
    alignment leaves because it stands in another order is aligned again by its runs, until a round deletes nothing.
    """
    there_of = {here: there for here, there, _ in lines}
    anchors = {(here, there): 1 for here, there, once in lines if once} | {(here, there): n for here, there, n in runs}
    gone: set[int] = set()
    while anchors:
        matched: dict[int, int] = {}
        for here, there in patience(sorted(anchors, key=lambda a: (a[0], -a[1]))):
            for k in range(anchors[here, there]):
                matched.setdefault(here + k, there + k)
        for here, there in list(matched.items()):
            for step in (-1, 1):
                k = 1
                while here + step * k not in matched and there_of.get(here + step * k) == there + step * k:
                    matched[here + step * k] = there + step * k
                    k += 1
        found: set[int] = set()
        block: list[int] = []
        for here in [*sorted(matched), None]:
            if block and (here is None or here != block[-1] + 1 or matched[here] != matched[block[-1]] + 1):
                if sum(words.get(x, 0) for x in block) >= least_block:
                    found.update(block)
                block = []
            if here is not None:
                block.append(here)
        if anchors.keys() <= {(here, there) for here, there, _ in runs} and found <= gone:
            break
        gone |= found
        # a chain's first run is matched as a whole, so every round of runs deletes at least one of them
        anchors = {(here, there): n for here, there, n in runs if any(here + k not in gone for k in range(n))}
    return gone


def runs(words: list[int], least_block: int) -> set[tuple[int, int]]:
    """(place, lines) of the shortest runs of least_block words from and up to every line; a blank line (0 words) ends a run."""
    found: set[tuple[int, int]] = set()
    start = 0
    for stop in [*(i for i, w in enumerate(words) if not w), len(words)]:
        total, j = 0, start
        for i in range(start, stop):
            while j < stop and total < least_block:
                total += words[j]
                j += 1
            if total < least_block:
                break
            found.add((i, j - i))
            total -= words[i]
        total, i = 0, stop
        for j in range(stop, start, -1):
            while i > start and total < least_block:
                i -= 1
                total += words[i]
            if total < least_block:
                break
            found.add((i, j - i))
            total -= words[j - 1]
        start = stop + 1
    return found


def _pieces(least_block: int):
    """Arrow batches of (doc_id, text_key, lines, words) to rows of PIECES: every line (n = 0) and every run of n lines."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        types = [pa.int64() if c.endswith("long") else pa.int32() for c in PIECES.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

        worker_caches("line_dedup")
        for b in batches:
            rows: list[tuple[int, ...]] = []
            at = b.column("lines").offsets.to_numpy()
            at = at - at[0]
            flat, counts = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("lines", "words"))
            for k, (doc, key) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text_key").to_pylist())):
                own = flat[at[k] : at[k + 1]]
                words = counts[at[k] : at[k + 1]].tolist()
                rank = list(accumulate((w > 0 for w in words), initial=0))
                times = Counter(own.tolist())
                rows.extend((doc, key, i, rank[i], line, w, 0, times[line]) for i, (line, w) in enumerate(zip(own.tolist(), words)) if w)
                raw = own.tobytes()
                for i, n in runs(words, least_block):
                    name = int.from_bytes(blake2b(raw[8 * i : 8 * (i + n)], digest_size=8).digest(), "little", signed=True)
                    rows.append((doc, key, i, rank[i], name, sum(words[i : i + n]), n, 1))
                if len(rows) >= PIECE_ROWS:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return cut


def shared_blocks(docs: DataFrame, least_words: int = LEAST_WORDS, least_block: int = LEAST_BLOCK, rare: int = RARE) -> DataFrame:
    """(doc_id, text_key, gone): the line positions that each later document loses."""
    space = r"[\x20\x09-\x0D]+"
    text = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.split("text", "\n").alias("lines"))
    words = F.transform("lines", lambda x: F.when(F.length(F.trim(x)) > 0, F.size(F.split(F.trim(x), space))).otherwise(0))
    text = text.select("doc_id", "text_key", F.transform("lines", lambda x: F.xxhash64(x)).alias("lines"), words.alias("words"))
    lines = Scratch(docs.sparkSession).keep(text.mapInArrow(_pieces(least_block), PIECES))
    # the first holder of each line and run; partial minima keep a frequent line small before the shuffle
    holder = F.struct("doc_id", "text_key", "rank", "times")
    first = lines.groupBy("line").agg(F.min(holder).alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("held"))
    first = first.where("first.doc_id != last").select("line", "first", (F.col("held") <= rare).alias("rare"))
    mine = lines.join(first, "line").where("doc_id != first.doc_id")
    # a set: a row that stands several times counts once, and partial sets keep it small before the shuffle
    what = F.struct(F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"), F.col("first.rank").alias("there"), F.col("first.times").alias("first_times"), "rare", "place", "rank", "line", "words", "n", "times")
    found = mine.groupBy("doc_id", "text_key").agg(F.collect_set(what).alias("found"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            gone = []
            for own in f["found"]:
                by = defaultdict(list)
                for x in own:
                    by[x["first_id"], x["first_key"]].append(x)
                words = {x["rank"]: x["words"] for x in own if not x["n"]}
                place = {x["rank"]: x["place"] for x in own if not x["n"]}
                lost: set[int] = set()
                for shared in by.values():
                    runs = [(x["rank"], x["there"], x["n"]) for x in shared if x["n"]]
                    # only documents that share a run or a rare line of some length are aligned
                    if runs or any(x["rare"] and x["words"] >= least_words for x in shared):
                        lines = [(x["rank"], x["there"], x["times"] == x["first_times"] == 1) for x in shared if not x["n"]]
                        lost |= aligned(lines, runs, words, least_block)
                gone.append(sorted(place[x] for x in lost if x in place))
            yield pd.DataFrame({"doc_id": f["doc_id"], "text_key": f["text_key"], "gone": gone})

    return found.mapInPandas(run, "doc_id long, text_key long, gone array<int>").where(F.size("gone") > 0)


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, least_block: int = LEAST_BLOCK) -> DataFrame:
    """docs with shared blocks deleted from text, and n_removed: lines lost."""
    gone = Scratch(docs.sparkSession).keep(shared_blocks(docs, least_words, least_block).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("gone").alias("__gone")))
    places = gone.agg(F.sum(F.size("__gone") + 4)).first()[0] or 0
    gone = maybe_broadcast(gone, places, 4 * BROADCAST_ROWS)
    keyed = docs.withColumn("__key2", F.xxhash64("text"))
    both = keyed.join(gone, (keyed["doc_id"].cast("long") == gone["__id"]) & (keyed["__key2"] == gone["__key"]), "left")
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__gone", i)), "\n")
    both = both.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left))
    return both.withColumn("n_removed", F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")).drop("__id", "__key", "__key2", "__gone")
