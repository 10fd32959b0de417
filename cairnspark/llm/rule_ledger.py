"""Quality rules: a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once per document; the ledger keeps the measurements and one long whose bit k says
that rule k failed. Policies are versioned masks over those bits: applying one, or asking what a policy
would keep without one of its rules, reads the ledger alone.

Repeated words are counted inside each row: the hashes of all 3-word windows are sorted with their places,
equal neighbours mark places, and the union of the marked windows is summed over gaps. Nothing is exploded
or shuffled, so neither a hot source nor a frequent line gathers rows anywhere.

Results: null text has no words; empty texts measure 0 everywhere and fail the base rules; ratios of empty
texts are 0; repeated rows and extra columns are kept as they are, but a column named like a measurement is
replaced; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition over the measurements holds."""

    name: str
    fails: str


#: Bit k is rule k. New rules are appended, so old ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("shouting", "10 * n_upper > 6 * word_chars"),
    Rule("no_words", "n_words = 0"),
)

#: Policy versions: the rules that each applies.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "keep-1": ("few_words", "repeated_words", "many_symbols", "repeated_lines", "long_words", "short_words", "shouting"),
    "lenient-1": ("no_words", "repeated_words"),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_repeat_words")


def mask(policy: str) -> int:
    return sum(1 << k for k, r in enumerate(RULES) if r.name in POLICIES[policy])


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def _with_repeat_words(df: DataFrame) -> DataFrame:
    """df(__words, n_words) with n_repeat_words: words inside 3-word windows that occur twice or more.

    Every array that several expressions read is a column of its own step, so it is computed once.
    """
    inner = F.greatest(F.size("__h") - 2, F.lit(0))
    df = df.withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))
    pair = F.zip_with(F.slice("__h", F.lit(1), inner), F.slice("__h", F.lit(2), inner), lambda a, b: F.xxhash64(a, b))
    window = F.zip_with(pair, F.slice("__h", F.lit(3), inner), lambda a, c: F.xxhash64(a, c))
    df = df.withColumn("__placed", F.sort_array(F.transform(window, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    before = F.concat(F.array(F.lit(None)), F.transform("__placed", lambda x: x["h"]))
    after = F.transform(F.slice("__placed", F.lit(2), F.greatest(F.size("__placed"), F.lit(1))), lambda x: x["h"])
    beside = F.zip_with(before, after, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    marked = F.zip_with("__placed", beside, lambda x, y: F.when((x["h"] == y["p"]) | (x["h"] == y["q"]), x["i"]))
    df = df.withColumn("__places", F.sort_array(F.filter(marked, lambda i: i.isNotNull())))
    gaps = F.zip_with("__places", F.slice("__places", F.lit(2), F.greatest(F.size("__places"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return df.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x))


def ledger(docs: DataFrame) -> DataFrame:
    """docs with the measurements (long) and failures, the bits of the rules that failed."""
    own = [c for c in docs.columns if c not in (*MEASURES, "failures")]
    text = text_or_empty()
    base = docs.select(*own, F.filter(F.split(text, SPACE), lambda w: w != "").alias("__words"), F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, BLANKS)) > 0).alias("__lines"), _without(text, BLANKS).alias("__letters"))
    n = F.size("__words")
    measured = base.select(
        *own,
        n.cast("long").alias("n_words"),
        F.length("__letters").cast("long").alias("word_chars"),
        (F.length("__letters") - F.length(_without(F.col("__letters"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        (F.length("__letters") - F.length(F.regexp_replace("__letters", r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        "__words",
    )
    measured = _with_repeat_words(measured).select(*own, *MEASURES)
    bits = [F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(RULES)]
    failures = bits[0].cast("long")
    for b in bits[1:]:
        failures = failures.bitwiseOR(b.cast("long"))
    return measured.withColumn("failures", failures)


def apply_policy(found: DataFrame, policy: str) -> Column:
    """Whether a ledger's row passes a policy."""
    return found["failures"].bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(found: DataFrame, policy: str) -> DataFrame:
    """(rule, n_failed, n_only, n_kept_without): per rule of a policy, from the failure bits alone.

    Rows with equal bits are counted before anything moves: at most 2 ** rules groups.
    """
    m = mask(policy)
    counts = found.groupBy(F.col("failures").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(RULES) if r.name in POLICIES[policy]]
    each = counts.select("bits", "n", F.explode(F.array(*rules)).alias("r"))
    failed = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(alone | (F.col("bits") == 0), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
