"""Substring join by signatures: which texts contain which patterns, without comparing all pairs and without a broadcast.

Every pattern stands under one of its q-grams: the rarest, by a count of slots over all texts. A text
offers only q-grams that are in use, which it knows by a bit array of fixed size; texts and patterns meet on the
q-gram, and what meets is verified. Patterns shorter than q are their own gram. A pattern may be part of a word or
run over several. Grams are taken of slices of a text, so memory doesn't follow the longest text. A gram is a hash of
its letters, computed for a slice at once; two grams of one hash only bring more candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.batches import in_slices
from cairnspark.scratch import Scratch

Q = 4
#: Bits of the array that tells grams in use: 512 KB, whatever the number of patterns.
BITS = 1 << 22
SLICE = 100_000
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _grams(text: str, lengths: list[int]) -> np.ndarray:
    """Hashes of the grams of a text at all its places."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for n in lengths:
        places = len(letters) - n + 1
        if places > 0:
            h = np.full(places, n, np.uint64)
            for i in range(n):
                h = h * _FACTOR + letters[i : i + places]
            h = (h ^ h >> np.uint64(32)) * _MIX
            out.append((h ^ h >> np.uint64(29)).view(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _slots(grams: np.ndarray) -> np.ndarray:
    return grams & (BITS - 1)


def pattern_grams(patterns: DataFrame, q: int) -> DataFrame:
    """(pid, gram) of patterns(pid, pattern): the distinct q-grams of each, or the whole pattern if it is shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pid, pattern in zip(b.column(0).to_pylist(), b.column(1)):
                pattern = pattern.as_py()
                grams = np.unique(_grams(pattern, [min(q, len(pattern))]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), pid)), pa.array(grams)], ["pid", "gram"])

    return patterns.select("pid", "pattern").mapInArrow(run, "pid long, gram long")


def in_use(grams: DataFrame) -> np.ndarray:
    """The bit array of grams(gram): one of BITS bits each, or-ed in every task and then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for b in batches:
            bits[_slots(b.column(0).to_numpy())] = True
        words = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(words[at])], ["at", "word"])

    found = grams.select("gram").mapInArrow(run, "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()  # BITS / 64 rows at most
    words = np.zeros(BITS // 64, np.int64)
    words[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return words.view(np.uint8)


def _slices(texts: pa.Array, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(row, grams) of each slice of each text."""
    most = max(lengths, default=1)
    for row, text in enumerate(texts):
        text = text.as_py()
        for at in range(0, len(text), SLICE):
            yield row, _grams(text[at : at + SLICE + most - 1], lengths)


def text_grams(texts: DataFrame, lengths: list[int], bits: np.ndarray, key: str = "tid") -> DataFrame:
    """(tid, gram): distinct grams of texts(tid, text) within each slice whose bit is set."""
    table = texts.sparkSession.sparkContext.broadcast(bits)  # BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = np.unpackbits(table.value).astype(bool)
        for b in in_slices(batches):
            found = [(row, np.unique(grams[use[_slots(grams)]])) for row, grams in _slices(b.column(1), lengths)]
            if found:
                own = np.repeat(b.column(0).to_numpy()[[row for row, _ in found]], [len(g) for _, g in found])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate([g for _, g in found]))], [key, "gram"])

    return texts.where(f"{key} is not null").select(key, "text").mapInArrow(run, f"{key} long, gram long")


def slot_counts(texts: DataFrame, lengths: list[int], bits: np.ndarray) -> DataFrame:
    """(slot, n): how often the grams of texts(text) fall on each bit that is set; a task adds them up in one array of BITS longs."""
    table = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(BITS, np.int64), [], 0
        for b in batches:
            for _, grams in _slices(b.column(0), lengths):
                held.append(_slots(grams))
                size += len(grams)
                if size >= BITS:
                    counts += np.bincount(np.concatenate(held), minlength=BITS)
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=BITS)
        at = np.flatnonzero(counts * np.unpackbits(table.value))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["slot", "n"])

    return texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))


def contains_join(texts: DataFrame, patterns: DataFrame, q: int = Q) -> DataFrame:
    """(tid, pid): every text of texts(tid, text) that contains a pattern of patterns(pid, pattern), each pair once.

    Null texts and null or empty patterns meet nothing; ids are longs, and rows that repeat an id count as one text each.
    Candidates are written before they are verified, so Spark knows their size: where they are few, texts aren't shuffled.
    """
    scratch = Scratch(texts.sparkSession)
    texts = texts.where("text is not null").select(F.col("tid").cast("long").alias("tid"), "text")
    patterns = scratch.keep(patterns.where("length(pattern) > 0").select(F.col("pid").cast("long").alias("pid"), "pattern").distinct())
    grams = scratch.keep(pattern_grams(patterns, q))
    lengths = [r[0] for r in patterns.select(F.least(F.length("pattern"), F.lit(q))).distinct().collect()]  # q values at most
    counted = slot_counts(texts, lengths, in_use(grams))
    rarity = grams.withColumn("slot", F.col("gram").bitwiseAND(F.lit(BITS - 1))).join(counted, "slot").groupBy("pid").agg(F.min(F.struct("n", "gram")).alias("r"), F.count(F.lit(1)).alias("known"))
    # a pattern with a gram that no text holds is in no text
    whole = grams.groupBy("pid").agg(F.count(F.lit(1)).alias("all"))
    signed = scratch.keep(rarity.join(whole, "pid").where("known = all").select("pid", F.col("r.gram").alias("gram")))
    near = scratch.keep(text_grams(texts, lengths, in_use(signed)).join(signed, "gram").select("tid", "pid").distinct())
    found = texts.join(near.join(patterns, "pid"), "tid").where(F.contains(F.col("text"), F.col("pattern")))
    return found.select("tid", "pid").distinct()
