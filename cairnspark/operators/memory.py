"""Conversation memory: bounded contexts of message logs (conv_id, turn, role, text), as windows over each conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.functions import text as T


def _conv(order: bool = True):
    w = Window.partitionBy("conv_id")
    return w.orderBy("turn") if order else w


def last_turns(log: DataFrame, n: int) -> DataFrame:
    """H5"""
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return log.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def tail_start() -> Column:
    """H6: the turn of the last user message, else the last turn."""
    w = _conv(False)
    return F.coalesce(F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w), F.max("turn").over(w))


def group_id() -> Column:
    """H7: a tool row belongs to the group that the assistant row before it opens."""
    return F.sum(F.when(F.col("role") == "tool", 0).otherwise(1)).over(_conv().rowsBetween(Window.unboundedPreceding, 0)).cast("long")


def truncate_groups(log: DataFrame, most: int, ratio: float = 0.8) -> DataFrame:
    """Drops the oldest groups until the context fits ``ratio`` of a window; the first message and the tail stay."""
    cost = T.message_tokens(F.col("text"))
    all_rows = _conv(False)
    m = log.withColumn("cost", cost).withColumn("tail", tail_start()).withColumn("first", F.min("turn").over(all_rows)).withColumn("total", F.sum("cost").over(all_rows)).withColumn("n", F.count(F.lit(1)).over(all_rows))
    m = m.withColumn("grp", group_id())
    middle = (F.col("turn") > F.col("first")) & (F.col("turn") < F.col("tail"))
    over = (F.col("total") > F.lit(int(most * ratio))) & (F.col("n") > 2)
    before = Window.partitionBy("conv_id").orderBy("grp").rangeBetween(Window.unboundedPreceding, -1)
    freed = F.coalesce(F.sum(F.when(middle, F.col("cost"))).over(before), F.lit(0))
    gone = middle & over & (freed < F.col("total") - int(most * ratio))
    return m.withColumn("gone", gone).where(~F.col("gone")).drop("cost", "tail", "first", "total", "n", "grp", "gone")


def should_consolidate(tokens: Column, most: int) -> Column:
    """O2"""
    return tokens > int(most * 0.5)


def keep_boundary(log: DataFrame, most: int, reserve: int = 500) -> DataFrame:
    """O3: (conv_id, n_keep): how many of the middle messages fit, from the newest back, groups whole."""
    target = int(most * 0.5 * 0.6)
    m = log.withColumn("cost", T.message_tokens(F.col("text"))).withColumn("tail", tail_start()).withColumn("first", F.min("turn").over(_conv(False))).withColumn("grp", group_id())
    fixed = F.sum(F.when((F.col("turn") == F.col("first")) | (F.col("turn") >= F.col("tail")), F.col("cost")).otherwise(0)).over(_conv(False))
    m = m.withColumn("budget", F.lit(target - reserve) - fixed)
    groups = m.where("turn > first and turn < tail").groupBy("conv_id", "budget", "grp").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("size"))
    running = F.sum("cost").over(Window.partitionBy("conv_id").orderBy(F.desc("grp")))
    kept = groups.withColumn("run", running).where("run <= budget").groupBy("conv_id").agg(F.sum("size").alias("n_keep"))
    return log.select("conv_id").distinct().join(kept, "conv_id", "left").select("conv_id", F.coalesce("n_keep", F.lit(0)).cast("long").alias("n_keep"))


def render(log: DataFrame, clip: int) -> DataFrame:
    """(conv_id, rendered): role: text lines in order, each text clipped."""
    line = F.concat("role", F.lit(": "), F.substring("text", 1, clip))
    return log.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x")).select("conv_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("rendered"))


def compress_rounds(log: DataFrame, keep: int = 2, marker: str = "[omitted]") -> DataFrame:
    """Assistant texts before the last ``keep`` user rounds become a marker."""
    done = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(_conv().rowsBetween(Window.unboundedPreceding, 0))
    m = log.withColumn("round", done).withColumn("rounds", F.max("round").over(_conv(False)))
    old = (F.col("role") == "assistant") & (F.col("round") <= F.col("rounds") - keep)
    return m.withColumn("text", F.when(old, F.lit(marker)).otherwise(F.col("text"))).drop("round", "rounds")


def usage_delta(log: DataFrame, sent: int) -> DataFrame:
    """O1: (conv_id, tokens): what the turns after the last sent one add."""
    return log.groupBy("conv_id").agg(F.sum(F.when(F.col("turn") > sent, T.message_tokens(F.col("text"))).otherwise(0)).alias("tokens"))


def reconstruct(steps: DataFrame) -> DataFrame:
    """steps(conv_id, iteration, tool, arguments) to one assistant row an iteration with its calls, and a tool row a call."""
    w = Window.partitionBy("conv_id", "iteration").orderBy("tool", "arguments")
    numbered = steps.withColumn("k", F.row_number().over(w))
    calls = numbered.groupBy("conv_id", "iteration").agg(F.array_sort(F.collect_list(F.struct("k", "tool", "arguments"))).alias("calls"))
    head = calls.select("conv_id", "iteration", F.lit(0).alias("k"), F.lit("assistant").alias("role"), F.to_json("calls").alias("content"))
    return head.unionByName(numbered.select("conv_id", "iteration", "k", F.lit("tool").alias("role"), F.lit("").alias("content")))
