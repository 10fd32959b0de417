"""Packing: hierarchical multi-length packing of token ids into sequences.

Each document is its ids and a final end id. Whole windows of the longest tier are cut off first; what is
left is routed to the shortest tier that holds it (2048, 1024, 512 or 256 tokens). Tiers are packed from
long to short: a window takes the longest piece there is, its gap the longest shorter pieces that fit, and
the last of the gap a cut of the shortest longer piece, whose rest goes on to a shorter tier. So every
window is full and its length a power of two. What remains of a task at its end is cut into powers of two.
Full windows of a tier join step groups of equal token counts.

Each task packs what it reads, batch after batch, holding at most one unfilled window's pieces between
batches: nothing is shuffled, and no task or group grows with the table. A rerun of a lost task reads the
same split and gives the same rows.

Results: null and empty texts are one piece with the end id alone; repeated rows are packed each; extra
columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import text_or_empty
from cairnspark.llm.word_bpe import groups, ids_of, load, packed

TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 64 * 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class Packer:
    """Windows of one task; a piece is (length, number, doc_id, start, ids, tokens of its document)."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS):
        self.base = task << 32
        self.tiers = tiers
        self.sequence = count()
        self.number = count()
        self.pool: list[tuple] = []
        self.rows: list[tuple] = []
        self.step: dict[int, tuple[int, int]] = {}
        self.steps = count()

    def add(self, doc_id: int | None, ids: bytes) -> None:
        whole, total, at = self.tiers[0], len(ids) // 4, 0
        while total - at >= whole:
            self.emit([(whole, 0, doc_id, at, ids[4 * at : 4 * (at + whole)], total)], whole)
            at += whole
        if at < total:
            insort(self.pool, (total - at, next(self.number), doc_id, at, ids[4 * at :], total))

    def emit(self, pieces: list[tuple], tier: int) -> None:
        sequence = self.base | next(self.sequence)
        left, group = self.step.get(tier, (0, 0))
        if left < tier:
            left, group = STEP_TOKENS, self.base | next(self.steps)
        self.step[tier] = left - tier, group
        offset = 0
        for length, _, doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, length, zlib.crc32(ids), total, sequence, offset, tier, group))
            offset += length

    def cut(self, piece: tuple, length: int) -> tuple:
        """The first so many tokens of a piece; the rest goes back, to a shorter tier."""
        n, _, doc_id, start, ids, total = piece
        insort(self.pool, (n - length, next(self.number), doc_id, start + length, ids[4 * length :], total))
        return length, next(self.number), doc_id, start, ids[: 4 * length], total

    def pack(self) -> None:
        """Fill windows from long to short while pieces last."""
        pool = self.pool
        while pool:
            first = pool.pop()
            tier = min(t for t in self.tiers if t >= first[0])
            window, gap = [first], tier - first[0]
            while gap and pool:
                k = bisect_right(pool, (gap, float("inf")))
                piece = pool.pop(k - 1) if k else self.cut(pool.pop(0), gap)
                window.append(piece)
                gap -= piece[0]
            if gap:
                for piece in window:
                    insort(pool, piece)
                return
            self.emit(window, tier)

    def finish(self) -> None:
        """What is left fills no window: cut it into ever smaller powers of two."""
        self.pack()
        left = sum(p[0] for p in self.pool)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            window, gap = [], size
            while gap:
                piece = self.pool.pop()
                window.append(piece if piece[0] <= gap else self.cut(piece, gap))
                gap -= window[-1][0]
            self.emit(window, size)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(NAMES)
        self.rows = []
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], NAMES)


def pack_documents(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """A row for each piece of each row of docs(doc_id, text, ...); ids by the tokenizers library's model."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, packed, library=True)
        packer = Packer(TaskContext.get().partitionId())
        for b in batches:
            doc_ids = b.column(0)
            for at, texts in groups(b.column(1)):
                for doc_id, ids in zip(doc_ids.slice(at, len(texts)).to_pylist(), ids_of(texts, bpe), strict=True):
                    packer.add(doc_id, ids + end)
                packer.pack()
                yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA)
