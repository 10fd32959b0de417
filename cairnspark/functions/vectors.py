"""Column functions over vectors and token sets, and the deterministic hash embedder."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EMBED_DIM = 256


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for zero vectors and unequal lengths."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def finite(v: Column) -> Column:
    """Components that are not finite become 0."""
    return F.transform(v, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))


def sparse_or_placeholder(m: Column) -> Column:
    """Drops weights that are not positive and finite; an empty map becomes a placeholder."""
    kept = F.map_filter(m, lambda k, x: ~F.isnan(x) & (x > 0) & (x != float("inf")))
    return F.when(F.size(kept) > 0, kept).otherwise(F.create_map(F.lit(0), F.lit(1e-30)))


def embeddable(text: Column, longest: int = 8000) -> Column:
    """Blank texts become a word, long ones are clipped as the model's input limit asks."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").otherwise(F.substring(text, 1, longest))


def hash_tokens(text: str) -> list[str]:
    low = text.strip().lower()
    chars = [c for c in low if "一" <= c <= "鿿"]
    return chars + [a + b for a, b in zip(chars, chars[1:], strict=False)] + re.findall(r"[a-z0-9]+", low)


def hash_vector(text: str | None, dim: int = EMBED_DIM) -> np.ndarray:
    """Signed md5 buckets of the tokens, of unit length."""
    out = np.zeros(dim)
    for t in hash_tokens(text or ""):
        h = int(hashlib.md5(t.encode()).hexdigest(), 16)
        out[h % dim] += 1.0 if h >> 8 & 1 else -1.0
    size = np.linalg.norm(out)
    return out / size if size > 0 else out


def hash_embedder(dim: int = EMBED_DIM):
    """J19 as a pandas UDF: string to array<double>."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash_vector(t, dim))

    return embed
