"""What keeps a document library going: stored rows and configurations, task lanes, retries and queue figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.sources.loaders import READERS

# Per cent of progress at which each stage begins and ends.
STAGES = {"load": (0, 10), "ocr": (10, 30), "chunk": (30, 50), "embed": (50, 90), "index": (90, 100)}
# Intents that need no retrieval, and the longest rewritten question.
NO_RETRIEVAL, LONGEST_REWRITE = ("greeting", "chitchat", "follow_up"), 200


def reader(filename: Column, strict: bool = False) -> Column:
    """The reader of a file by its extension, lower-cased; of an unknown type null, or an error if strict."""
    kind = F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))
    out = F.raise_error(F.concat(F.lit("unsupported file type: "), kind)).cast("string") if strict else F.lit(None).cast("string")
    for name, kinds in READERS.items():
        out = F.when(kind.isin(*kinds), name).otherwise(out)
    return out


def decoded(raw: Column) -> Column:
    """A2: bytes as UTF-8; letters that are none are left out."""
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))


def csv_cells(line: Column, names: list[str]) -> Column:
    """A3: a line of a CSV file as a struct of strings."""
    return F.from_csv(line, ", ".join(f"{n} string" for n in names))


def newest(files: DataFrame, prefix: str, path: str = "path", time: str = "modified") -> DataFrame:
    """(path, modified, length) under a prefix, each path once, as last modified."""
    under = files.where(F.startswith(F.col(path), F.lit(prefix)))
    return under.groupBy(path).agg(F.max_by("length", time).alias("length"), F.max(time).alias(time))


def merge_config(old: DataFrame, patch: DataFrame, known: list[str]) -> DataFrame:
    """(key, name, value): known fields of the patch replace the old ones, others are refused."""
    new = patch.where(F.col("name").isin(*known)).select("key", "name", F.lit(1).alias("turn"), "value")
    both = old.select("key", "name", F.lit(0).alias("turn"), "value").unionByName(new)
    return both.groupBy("key", "name").agg(F.max_by("value", "turn").alias("value"))


def merge_json(base: Column, patch: Column) -> Column:
    """A JSON object with the fields of a patch over its own, as a map; null fields of the patch change nothing."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    changes = F.map_filter(as_map(patch), lambda k, v: v.isNotNull())
    kept = F.map_filter(as_map(base), lambda k, v: ~F.array_contains(F.map_keys(changes), k))
    return F.map_concat(kept, changes)


def keep_dimension(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors of one dimension; all others are dropped."""
    return vectors.where(F.col("dim") == dim)


def missing_tables(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """What has to be created, each once."""
    return wanted.select(key).distinct().join(there.select(key).distinct(), key, "left_anti")


def report_lines(rows: DataFrame, mode: str, figures: list[str], baseline: str) -> DataFrame:
    """A Markdown table line a mode, each figure with its difference from the baseline mode."""
    base = rows.where(F.col(mode) == baseline).select(*[F.col(f).alias(f"__{f}") for f in figures])
    sign = lambda c: F.concat(F.when(c >= 0, "+").otherwise(""), F.format_string("%.2f", c))
    cells = [F.concat(F.format_string("%.2f", F.col(f)), F.lit(" ("), sign(F.col(f) - F.col(f"__{f}")), F.lit(")")) for f in figures]
    return rows.crossJoin(F.broadcast(base)).select(mode, F.concat(F.lit("| "), F.concat_ws(" | ", mode, *cells), F.lit(" |")).alias("line"))  # base is one row


def progress(stage: Column, done: Column, total: Column) -> Column:
    """Per cent of a document's progress, linear within its stage; an empty stage is over."""
    first = F.create_map(*[F.lit(x) for k, v in STAGES.items() for x in (k, v[0])])[stage]
    last = F.create_map(*[F.lit(x) for k, v in STAGES.items() for x in (k, v[1])])[stage]
    part = F.greatest(F.lit(0), F.least(done, total)) / F.nullif(total, F.lit(0))
    return F.when(total <= 0, last).otherwise(first + F.floor(part * (last - first)).cast("int"))


def _answered(answer: Column) -> Column:
    """From the first brace of a model's answer to the last: fences and words around the JSON don't matter."""
    return F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)(\{.*\})", 1)


def intent(answer: Column) -> Column:
    """K8: the intent of a model's JSON answer; what is unknown or unreadable needs retrieval."""
    found = F.lower(F.trim(F.coalesce(F.get_json_object(_answered(answer), "$.intent"), F.lit(""))))
    return F.when(found.isin(*NO_RETRIEVAL), found).otherwise("kb_search")


def rewrite(answer: Column, question: Column) -> Column:
    """K8: the rewritten question of an answer; the question itself where there is none or it is too long."""
    found = F.trim(F.coalesce(F.get_json_object(_answered(answer), "$.rewrite_query"), F.lit("")))
    return F.when((found == "") | (F.length(found) > LONGEST_REWRITE), question).otherwise(found)


def name_list(answer: Column) -> Column:
    """K8: distinct trimmed names of the first array of a model's answer, in order."""
    body = F.regexp_extract(answer, r"(?s)(\[.*\])", 1)
    names = F.coalesce(F.from_json(body, "array<string>"), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != ""))


def retries(tasks: DataFrame, attempts: Column, retryable: Column, most: int = 3, at: str = "ts") -> DataFrame:
    """Outcome and not_before of failed tasks: 1, 2, 4 seconds later, then, or if nothing helps, dead."""
    again = retryable & (attempts <= most)
    wait = F.pow(F.lit(2), attempts - 1).cast("long")
    return tasks.withColumn("outcome", F.when(again, "retry").otherwise("dead")).withColumn("not_before", F.when(again, F.col(at) + F.make_dt_interval(secs=wait)))


def reclaim(deliveries: DataFrame, acknowledged: DataFrame, key: str, as_of: Column, idle_s: int, at: str = "ts") -> DataFrame:
    """L4: (key, deliveries, last) of messages that nobody acknowledged and that idle, each once."""
    last = deliveries.groupBy(key).agg(F.count(F.lit(1)).alias("deliveries"), F.max(at).alias("last"))
    idle = as_of.cast("timestamp") - F.make_dt_interval(secs=F.lit(idle_s))
    return last.join(acknowledged.select(key).distinct(), key, "left_anti").where(F.col("last").cast("timestamp") <= idle)


def admit(waiting: DataFrame, by: list[str], order: str, lane: str, slots: dict[str, int]) -> DataFrame:
    """Waiting tasks with admitted: whether one of its lane's reserved slots is free, first come first served."""
    place = F.row_number().over(Window.partitionBy(*by, lane).orderBy(order))
    free = F.create_map(*[F.lit(x) for k, v in slots.items() for x in (k, v)])[F.col(lane)]
    return waiting.withColumn("admitted", place <= free)


def micro_batches(chunks: DataFrame, by: str, order: str, size: int = 32) -> DataFrame:
    """Chunks with batch: runs of so many chunks of one document that are embedded together."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return chunks.withColumn("batch", F.floor(place / size).cast("long"))


def queue_stats(messages: DataFrame, queue: str, at: str, consumer: str) -> DataFrame:
    """(queue, n, oldest, newest, consumers)."""
    return messages.groupBy(queue).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("oldest"), F.max(at).alias("newest"), F.count_distinct(consumer).alias("consumers"))


def release(log: DataFrame, cost: Column, target: Column) -> DataFrame:
    """H8: log(conv_id, turn) with gone: the oldest rows until their cost reaches the target."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("gone", F.coalesce(F.sum(cost).over(before), F.lit(0)) < target)


def rounds(log: DataFrame) -> DataFrame:
    """H9: log with round: how many model answers there are up to each row."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("round", F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(w).cast("long"))


def redact_old_results(log: DataFrame, marker: str = "[omitted]") -> DataFrame:
    """Answers of all rounds but the last become a marker."""
    last = F.max("round").over(Window.partitionBy("conv_id"))
    old = (F.col("role") == "assistant") & (F.col("round") < last)
    return rounds(log).withColumn("text", F.when(old, marker).otherwise(F.col("text"))).drop("round")
