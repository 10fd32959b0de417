"""Toxicity by compression distance: windows of text under dictionaries of toxic and of ordinary text.

Training takes a bounded sample of labelled documents. Most text of a toxic document is as ordinary as any
other, so its toxic passages are found first: byte runs that toxic documents hold far more often than ordinary
ones. Two zstandard dictionaries are trained, one on toxic passages and one on ordinary windows. Each window of a
text is compressed with the ordinary one, and with the toxic one before it; the bytes saved measure how much of
the window is toxic text that ordinary text does not explain. Thresholds of the savings are calibrated on
ordinary windows that no dictionary was trained on: a tenth, a hundredth and a thousandth of them save more. A
document's windows beyond each threshold, by count and by share, give its score through a logistic curve fitted
on the sample.

Scores use the text alone. A null text is an empty text, scored like a text without savings; repeated rows
are scored each, and one row of a doc_id trains; extra columns are ignored; unlabelled tables, or labels of one
kind only, give every document the share of toxic labels (0 without labels); an empty table gives an empty
result. Texts are cut into pieces for training and windows for scoring, so memory does not follow the longest
text and no length is left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import Scratch, byte_groups, text_or_empty, worker_caches

WINDOW, STEP = 64, 48
GRAM = 7
BUCKETS = 1 << 22
#: A telling gram is in so large a share of the toxic sample, and so many times the ordinary share.
SUPPORT, LIFT = 0.03, 5.0
#: The most frequent telling passages that the toxic dictionary is trained on, and how often it sees each.
RUNS, WEIGHT = 100, 20
#: Bytes of the toxic dictionary's own text, and of the ordinary one, which stands behind it.
OWN, COMMON = 768, 16 << 10
#: Bytes of a trained dictionary at most that come before its text, and are of no use here.
HEADER = 512
#: Shares of ordinary windows below each threshold.
CALIBRATION = (0.9, 0.99, 0.999)
LEVEL = 12


@dataclass(frozen=True)
class Sample:
    """Bound of the training sample: labelled rows of each kind, as many pieces of their texts, and bytes of a piece."""

    toxic: int = 2500
    ordinary: int = 4500
    piece: int = 20_000


@dataclass(frozen=True)
class Dictionaries:
    """toxic ends in ordinary; thresholds are in bytes saved."""

    ordinary: bytes = b""
    toxic: bytes = b""
    thresholds: tuple[int, ...] = ()


@dataclass(frozen=True)
class Model:
    dictionaries: Dictionaries
    weights: tuple[float, ...]
    middle: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()


def _folded(text: str) -> bytes:
    return b" " + b" ".join(text.encode().lower().split()) + b" "


def _windows(data: bytes) -> list[bytes]:
    return [data[at : at + WINDOW] for at in range(0, max(1, len(data) - WINDOW + STEP), STEP)]


def _grams(data: bytes) -> np.ndarray:
    """Bucket of each run of GRAM bytes."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(a) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(GRAM):
            h = h * np.uint64(0x100000001B3) + a[j : j + n]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(42)).astype(np.int64)


class Scorer:
    def __init__(self, d: Dictionaries):
        raw = zstandard.DICT_TYPE_RAWCONTENT
        make = lambda x: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(x, dict_type=raw), write_content_size=False, write_checksum=False, write_dict_id=False)
        self.ordinary, self.toxic, self.thresholds = make(d.ordinary).compress, make(d.toxic).compress, d.thresholds

    def saved(self, windows: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one, by window."""
        return np.array([len(self.ordinary(w)) - len(self.toxic(w)) for w in windows])

    def features(self, text: str) -> np.ndarray:
        """Per threshold: log of the windows whose savings reach it, and their share."""
        data = _folded(text)
        hits, n = np.zeros(len(self.thresholds)), 0
        for at in range(0, len(data), STEP * 4096):
            saved = self.saved(_windows(data[at : at + STEP * 4096 + WINDOW - STEP]))
            n += len(saved)
            hits += [(saved >= t).sum() for t in self.thresholds]
        return np.concatenate((np.log1p(hits), np.sqrt(hits / max(n, 1))))


def _telling_passages(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The most frequent passages of toxic texts that are covered by grams which toxic texts hold far more often, none inside another."""
    held = []
    for texts in (toxic, ordinary):
        n = np.zeros(BUCKETS, np.int32)
        for t in texts:
            n[np.unique(_grams(t))] += 1
        held.append(n)
    share = (held[0] / len(toxic)) / ((held[1] + 1) / len(ordinary))
    telling = (share >= LIFT) & (held[0] >= max(3, SUPPORT * len(toxic)))
    runs: Counter[bytes] = Counter()
    for t in toxic:
        at = np.flatnonzero(telling[_grams(t)])
        parts = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ()
        runs.update({t[part[0] : part[-1] + GRAM] for part in parts})
    best: list[bytes] = []
    for r in sorted((r for r in runs if runs[r] > 1), key=lambda r: (-runs[r], r)):
        if len(best) < RUNS and not any(r in b for b in best):
            best.append(r)
    return best


def _trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A zstandard dictionary of the samples; too few of them are their own dictionary."""
    try:
        return zstandard.train_dictionary(size + HEADER, samples, k=k, d=d).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> Dictionaries:
    """Both dictionaries and the thresholds, from folded pieces of text of either kind."""
    windows = [w for t in ordinary for w in _windows(t)]
    windows = windows[:: max(1, len(windows) // 60_000)]
    even, rest = windows[0::2], windows[1::2] or windows
    # a passage counts alike however often it occurs, else the trainer fills the dictionary with the most frequent one
    passages = [r for r in _telling_passages(toxic, ordinary) for _ in range(WEIGHT)]
    common = _trained(even, COMMON, 64, 8)
    d = Dictionaries(common, _trained(passages, OWN, 16, 6) + common)
    saved = Scorer(d).saved(rest)
    return replace(d, thresholds=tuple(sorted({max(1, int(np.quantile(saved, q)) + 1) for q in CALIBRATION})))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    """(weights, middle, scale) of a ridge logistic fit by Newton steps."""
    middle, scale = x.mean(0), x.std(0) + 1e-6
    x = np.c_[np.ones(len(x)), (x - middle) / scale]
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
    return tuple(w), tuple(middle), tuple(scale)


def _log_odds(share: float) -> float:
    return float(np.log((share + 1e-6) / (1 - share + 1e-6)))


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: Sample = Sample()) -> Model:
    """A model from a bounded sample of the labelled rows of docs: those of least hash, by label."""
    scratch = Scratch(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic in (0, 1)")
    known = known.where(usable) if usable is not None else known
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("label"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = [known.where(F.col("label") == y).orderBy(*by_hash).limit(n) for y, n in ((1, sample.toxic), (0, sample.ordinary))]
    share = known.agg(F.avg("label")).first()[0] or 0.0
    some = F.broadcast(ids[0].union(ids[1]))
    # one row of each sampled id, whole; partial aggregation leaves one row a task of an id that repeats
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(some, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = scratch.keep(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, label, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "label", "text")), strict=True):
                data = _folded(text)
                parts = [data[at : at + sample.piece] for at in range(0, len(data), sample.piece)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([label] * n, pa.int32()), pa.array(parts, pa.binary())], ["doc_id", "at", "label", "data"])

    pieces = rows.mapInArrow(cut, "doc_id long, at int, label int, data binary")
    found = [[r["data"] for r in pieces.where(F.col("label") == y).orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at").limit(n).select("data").collect()] for y, n in ((1, sample.toxic), (0, sample.ordinary))]
    if not found[0] or not found[1]:
        return Model(Dictionaries(), (_log_odds(1.0 if found[0] else 0.0),))
    d = dictionaries(*found)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(d)
        for b in batches:
            x = [scorer.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    # as many rows as the sample has, a few numbers each
    fitted = sorted(rows.mapInArrow(measure, "doc_id long, label int, x array<double>").collect(), key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in fitted], float)
    weights, middle, scale = logistic(np.array([r["x"] for r in fitted]), y)
    shift = _log_odds(share) - _log_odds(y.mean()) if 0 < share < 1 else 0.0
    return Model(d, (weights[0] + shift, *weights[1:]), middle, scale)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text_key, score) of every row of docs(doc_id, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_caches("toxicity")
        scorer = Scorer(model.dictionaries) if model.middle else None
        weights, middle, scale = (np.array(x) for x in (model.weights, model.middle, model.scale))
        for b in batches:
            for at, texts in byte_groups(b.column(2)):
                x = np.array([(scorer.features(t.decode()) - middle) / scale for t in texts]) if scorer else np.zeros((len(texts), 0))
                p = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -500, 500)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)), pa.array(p)], ["doc_id", "text_key", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, text_key long, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that no training may see: crc32 of the id's digits divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, text_key) of every row of docs."""
    found = score(docs, train(docs, labels, ~held_out()))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_key")
