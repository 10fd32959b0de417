"""Embedding whitening by residue-number scatter.

Entries become integers x = floor(scale * c) + shift. One pass gives n, the sums S and the range of every
dimension; with them y = n * x - S is an exact integer, and the scatter, the sum of y y' over all rows, is at most
n * (n * range) ** 2. As many primes below 2 ** 20 are taken as make a product over twice that. Each task reduces
its y modulo every prime, multiplies blocks of at most 4,096 rows as doubles (every partial sum stays below
2 ** 53, so BLAS is exact) and sends one residue per prime and pair of dimensions. The residues are summed by Spark
and the driver, which holds d * d integers, puts them together by Chinese remaindering: the covariance
scatter / n ** 3 is exact before its single rounding to double. Its eigenvectors give the components.

Each row is then projected once and written; identity_error is measured on the written values, whose covariance
is centred before multiplying.

Results: rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are those whose
length isn't the most frequent one (the greater of equals); entries beyond +-2 ** 52 / scale count as that bound; rows
with a null vec_id and repeated rows count each; a component without variance (all rows equal, one row) has a null
whitened and explained 0; extra columns are ignored; without rows that remain the result is empty. The
eigenvectors' largest entry is positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import Scratch, worker_caches

SCALE, SHIFT = 1024, 100_000
BOUND = float(1 << 52)
PRIME_BELOW = 1 << 20
BLOCK = 4096
LOW = 20


def primes(product: int) -> list[int]:
    """The largest primes below PRIME_BELOW whose product exceeds the given one."""
    found, total, p = [], 1, PRIME_BELOW - 1
    while total <= product:
        if all(p % q for q in range(3, isqrt(p) + 1, 2)):
            found.append(p)
            total *= p
        p -= 2
    return found


def integers(vectors: pa.Array, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """x of a block of vectors of one length, one row each."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * scale), -BOUND, BOUND).astype(np.int64).reshape(len(vectors), -1) + shift


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v, size) of rows with finite vectors, as doubles."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & whole).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size(vector).alias("size"))


def sums(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> tuple[int, list[int], int]:
    """n, the sums of each dimension and the widest range of x, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_caches("whitening")
        n, total, low, high = 0, None, None, None
        for b in batches:
            if b.num_rows:
                x = integers(b.column(0), scale, shift)
                # in two parts, so that no sum of 2 ** 30 rows leaves 64 bits
                part = np.stack((x >> LOW, x & ((1 << LOW) - 1))).sum(axis=1)
                n += len(x)
                total = part if total is None else total + part
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1], dtype=np.int32)), pa.array(np.full(total.shape[1], n)), pa.array(total[0]), pa.array(total[1]), pa.array(low), pa.array(high)], ["j", "n", "hi", "lo", "low", "high"])

    found = rows.select("v").mapInArrow(run, "j int, n long, hi long, lo long, low long, high long")
    big = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("hi", "lo")]
    by = found.groupBy("j").agg(F.sum("n").alias("n"), *big, F.min("low").alias("low"), F.max("high").alias("high")).orderBy("j").collect()  # a row a dimension
    return by[0]["n"], [(int(r["hi"]) << LOW) + int(r["lo"]) for r in by], max(r["high"] - r["low"] for r in by)


def scatter(rows: DataFrame, n: int, total: list[int], widest: int, scale: int = SCALE, shift: int = SHIFT) -> list[list[int]]:
    """The sum of (n x - S)(n x - S)' over all rows, exact, d by d."""
    d, basis = len(total), primes(2 * n * (n * widest) ** 2 + 1)
    own = [(p, n % p, np.array([s % p for s in total], np.int64)) for p in basis]
    upper = np.triu_indices(d)
    cells = (upper[0] * d + upper[1]).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_caches("whitening")
        held = np.zeros((len(own), d, d), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                x = integers(b.column(0).slice(at, BLOCK), scale, shift)
                for k, (p, n_p, s_p) in enumerate(own):
                    y = ((n_p * (x % p) - s_p) % p).astype(np.float64)
                    held[k] = (held[k] + (y.T @ y).astype(np.int64)) % p
        for k in range(len(own)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), k, np.int32)), pa.array(cells), pa.array(held[k][upper])], ["k", "cell", "r"])

    # a task sends about d * d / 2 residues a prime, so each takes many times d rows
    few = max(rows.sparkSession.sparkContext.defaultParallelism, n // (64 * d))
    sent = rows.select("v").coalesce(few).mapInArrow(run, "k int, cell int, r long")
    got = sent.groupBy("k", "cell").agg(F.sum("r").alias("r")).toArrow()  # primes * d * (d + 1) / 2 rows
    residues = np.zeros((len(basis), d * d), np.int64)
    residues[got.column("k").to_numpy(), got.column("cell").to_numpy()] = got.column("r").to_numpy() % np.array(basis)[got.column("k").to_numpy()]
    return chinese(residues, basis, d)


def chinese(residues: np.ndarray, basis: list[int], d: int) -> list[list[int]]:
    """The symmetric matrix of signed integers with the residues of its upper half."""
    product = 1
    for p in basis:
        product *= p
    weights = [product // p * pow(product // p, -1, p) for p in basis]
    out = [[0] * d for _ in range(d)]
    for i in range(d):
        for j in range(i, d):
            v = sum(w * int(r) for w, r in zip(weights, residues[:, i * d + j])) % product
            out[i][j] = out[j][i] = v - product if 2 * v > product else v
    return out


def axes(exact: list[list[int]], n: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvectors in columns by falling eigenvalue, eigenvalues (0 where there is no variance) and the trace, of scatter / n ** 3."""
    cube = n**3
    v = np.array([[x / cube for x in row] for row in exact])  # integer division rounds once
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    trace = sum(exact[i][i] for i in range(len(exact))) / cube
    values = np.where(values > trace * len(exact) * np.finfo(float).eps * 4, values, 0.0)
    return vectors, values, trace


def whiten(df: DataFrame, components: int = 8, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, n, deviation decimal, whitened array, explained array, identity_error) of each remaining row.

    deviation is the sum over dimensions of (n x - S) ** 2, exact (null beyond 38 digits).
    """
    spark = df.sparkSession
    schema = "vec_id long, n long, deviation decimal(38,0), whitened array<double>"
    result = f"{schema}, explained array<double>, identity_error double"
    rows = usable(df, vector)
    sizes = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], result)
    rows = rows.where(F.col("size") == sizes[0]["size"]).select("vec_id", "v")
    n, total, widest = sums(rows, scale, shift)
    vectors, values, trace = axes(scatter(rows, n, total, widest, scale, shift), n, components)
    alive = values > 0
    project = np.where(alive, vectors / np.sqrt(np.where(alive, values, 1.0)), 0.0) / n
    # y and n x stay within 62 bits unless entries are huge; those rows are worked on as Python's integers
    kind = np.int64 if n * widest + max(map(abs, total)) < 1 << 62 else object

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_caches("whitening")
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                x = integers(b.column(1).slice(at, BLOCK), scale, shift)
                y = n * x.astype(kind) - np.array(total, kind)
                deviation = pa.array([Decimal(s) if s < 10**38 else None for s in squares(y)], pa.decimal128(38, 0))
                w = y.astype(np.float64) @ project
                flat = pa.array(w.ravel(), mask=np.tile(~alive, len(w)))
                white = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), flat)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, BLOCK), pa.array(np.full(len(x), n)), deviation, white], ["vec_id", "n", "deviation", "whitened"])

    found = Scratch(spark).keep(rows.mapInArrow(run, schema))
    explained = F.array(*[F.lit(float(e / trace) if trace else 0.0) for e in values])
    return found.select("*", explained.alias("explained"), F.lit(identity_error(found, n, np.flatnonzero(alive).tolist())).alias("identity_error"))


def squares(y: np.ndarray) -> list[int]:
    """The exact sum of squares of each row, of 64-bit integers below 2 ** 62 in limbs of 21 bits or of Python's integers."""
    if y.dtype == object:
        return (y * y).sum(axis=1).tolist()
    a, b, c = y >> 42, y >> 21 & (1 << 21) - 1, y & (1 << 21) - 1
    parts = [(a * a, 84), (2 * a * b, 63), (2 * a * c + b * b, 42), (2 * b * c, 21), (c * c, 0)]
    limbs = [(p.sum(axis=1).tolist(), s) for p, s in parts]
    return [sum(p[k] << s for p, s in limbs) for k in range(len(y))]


def identity_error(found: DataFrame, n: int, alive: list[int]) -> float:
    """The largest absolute entry of the covariance of whitened components, less the identity; 0 without components."""
    if not alive:
        return 0.0
    w = [F.col("whitened")[k] for k in alive]
    means = found.agg(*[F.sum(c) for c in w]).first()
    centred = [c - F.lit(m / n) for c, m in zip(w, means)]
    pairs = [(i, j) for i in range(len(w)) for j in range(i, len(w))]
    products = found.agg(*[F.sum(centred[i] * centred[j]) for i, j in pairs]).first()
    return max(abs(s / n - (i == j)) for (i, j), s in zip(pairs, products))
