"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

The raw model counts hashed word unigrams and bigrams over all documents, in buckets whose number follows theirs, the target model over the labelled
documents of good quality. A document's weight is the mean log ratio of the two models over its n-grams,
times ``strength``; its key is the weight plus Gumbel noise, a hash of its id, its text and the seed, and for rows
that repeat both also of the row itself. The rows of the k largest keys are a sample without replacement in proportion to the weights. k is, unless given, the
upper bound (three standard errors) of the share of good labels, of all rows; ties in the key go to the smaller doc_id.

Counts are partial sums of fixed width per task, added up by bucket. The top k is found without a global
sort: keys are counted in fine bins, whole bins above the border stay, and only the border bin is ranked.

Results: null and empty texts have no n-grams and weight 0, as neutral as a text that both models find
equally likely; rows with a null id are told apart by their texts; repeated rows are drawn each for itself; extra columns are ignored; without labels the target is the
raw model, so all weights are 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.llm.common import Scratch, byte_groups, maybe_broadcast, text_or_empty, worker_caches
from cairnspark.llm.word_hash import ngrams, word_hashes

#: Buckets of the n-gram models: a power of two that follows the number of documents between these bounds; what a task sends and a scorer holds is bounded by the upper one.
BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 22
STRENGTH = 20.0
SEED = 11


def bucket_count(n_docs: int) -> int:
    """One bucket for every two documents or more."""
    return min(MOST_BUCKETS, max(BUCKETS, 1 << max(0, (n_docs // 2 - 1).bit_length())))


def _bags(batch: pa.RecordBatch, buckets: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Buckets of the words and word pairs of each text."""
    for at, part in byte_groups(batch.column(batch.schema.get_field_index("text"))):
        texts = [t.lower() for t in part]
        words, counts = word_hashes(texts)
        out, first = [], 0
        for n in counts.tolist():
            own = words[first : first + n]
            first += n
            out.append((np.concatenate((own, ngrams(own, 2))) % np.uint64(buckets)).astype(np.int64))
        yield at, out


def ngram_counts(docs: DataFrame, group: str, buckets: int = BUCKETS) -> DataFrame:
    """(group, bucket, n): n-gram counts over all documents, by a boolean column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_caches("ngrams")
        total = np.zeros((2, buckets), np.int64)
        for b in batches:
            flag = b.column(b.schema.get_field_index(group)).to_pylist()
            for at, bags in _bags(b, buckets):
                for k in (0, 1):
                    mine = [x for x, f in zip(bags, flag[at : at + len(bags)], strict=True) if bool(f) == bool(k)]
                    if mine:
                        total[k] += np.bincount(np.concatenate(mine), minlength=buckets)
        for k in (0, 1):
            at = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), bool(k))), pa.array(at.astype(np.int32)), pa.array(total[k][at])], ["grp", "bucket", "n"])

    return docs.select(group, text_or_empty().alias("text")).mapInArrow(run, "grp boolean, bucket int, n long").groupBy("grp", "bucket").agg(F.sum("n").alias("n"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p(target) - log p(raw) by bucket, from at most two rows a bucket; each with add-one smoothing in the raw proportions."""
    rows = counts.toArrow()
    group, bucket, n = (rows.column(c).to_numpy() for c in ("grp", "bucket", "n"))
    raw = np.bincount(bucket, n, buckets)
    target = np.bincount(bucket[group], n[group], buckets)
    if not target.sum():
        return np.zeros(buckets)
    p = (raw + 1) / (raw.sum() + buckets)
    prior = min(float(buckets), target.sum())
    q = (target + prior * p) / (target.sum() + prior)
    return np.log(q) - np.log(p)


def weigh(docs: DataFrame, ratios: np.ndarray, strength: float = STRENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, log_ratio, key) of every row of docs."""
    table = docs.sparkSession.sparkContext.broadcast(ratios.astype(np.float64))  # MOST_BUCKETS doubles at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_caches("ngrams")
        for b in batches:
            for at, bags in _bags(b, len(table.value)):
                mean = [float(table.value[x].mean()) if len(x) else 0.0 for x in bags]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(bags)), b.column(1).slice(at, len(bags)), pa.array(mean, pa.float64())], ["doc_id", "text_key", "log_ratio"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, text_key long, log_ratio double")
    return with_keys(Scratch(docs.sparkSession).keep(found), strength, seed)


def with_keys(found: DataFrame, strength: float = STRENGTH, seed: int = SEED) -> DataFrame:
    """found(doc_id, text_key, log_ratio), a written table, with key: the weight plus a Gumbel draw of each row.

    Rows whose id and text stand once draw by these alone, however the table is dealt; rows that repeat both add
    their place in it.
    """
    again = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    both = found.withColumn("__row", F.monotonically_increasing_id()).join(maybe_broadcast(again), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left")
    row = F.when(F.col("__key").isNull(), F.lit(-1).cast("long")).otherwise(F.col("__row"))
    share = (F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text_key", row, F.lit(seed)).bitwiseAND((1 << 52) - 1) + F.lit(0.5)) / F.lit(float(1 << 52))
    return both.withColumn("key", F.col("log_ratio") * strength - F.log(-F.log(share))).drop("__id", "__key", "__row")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """scored with selected: whether a row is among the k largest keys, ties to the smaller doc_id."""
    bins = 1 << 16
    low, high, n = scored.agg(F.min("key"), F.max("key"), F.count(F.lit(1))).first()
    if not n or k >= n or low == high and k <= 0:
        return scored.withColumn("selected", F.lit(bool(n and k >= n)))
    place = F.least(F.floor((F.col("key") - low) / F.lit(max(high - low, 1e-300)) * bins), F.lit(bins - 1)).cast("int")
    binned = scored.withColumn("bin", place)
    above, border = 0, 0
    for r in sorted(binned.groupBy("bin").count().collect(), key=lambda r: -r["bin"]):  # at most `bins` rows
        border = r["bin"]
        if above + r["count"] >= k:
            break
        above += r["count"]
    edge = binned.where(F.col("bin") == border)
    ranked = edge.withColumn("rank", F.row_number().over(Window.partitionBy("bin").orderBy(F.desc("key"), "doc_id")))
    inside = ranked.withColumn("selected", F.col("rank") <= k - above).drop("rank", "bin")
    rest = binned.where(F.col("bin") != border).withColumn("selected", F.col("bin") > border).drop("bin")
    return rest.unionByName(inside)


def resample(docs: DataFrame, labels: DataFrame, keep: int | None = None, strength: float = STRENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, log_ratio, key, selected) of every row of docs."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"))
    n_known, n_good = known.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0))).first()
    good = maybe_broadcast(known.where("label = 1").select(F.col("doc_id").alias("__good")), n_good)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(good, F.col("doc_id") == F.col("__good"), "left").select("doc_id", "text", F.col("__good").isNotNull().alias("good"))
    buckets = bucket_count(docs.count())
    ratios = log_ratios(ngram_counts(marked, "good", buckets), buckets)
    scored = Scratch(docs.sparkSession).keep(weigh(docs, ratios, strength, seed))
    if keep is None:
        n = scored.count()
        share = n_good / n_known if n_known else 1.0
        keep = min(n, int(np.ceil(n * (share + 3 * np.sqrt(share * (1 - share) / max(1, n_known))))))
    return top_k(scored, keep)
