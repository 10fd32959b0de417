"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, with DataFrame functions only.

Targets: sources in code point order (null last) weigh 1, 2, 3 and so on in turn and share the words of all
documents; a target stops at ``most`` times its source's size and the excess is shared again by weight.

Blocks: every source is one line of words, its documents lying in a seeded order within seeded shards, shard after
shard, cut into blocks of ``block_words``. A block belongs to the shard it begins in. Words of all documents over
``block_words`` is the number of blocks to give: they go to sources by the highest quotients target / (2 k + 1), at
most ``most`` times a source's blocks, and each source's blocks go to its shards by the highest quotients of their
block counts. So every shard has an integer quota. A shard whose quota holds its blocks several times takes each
that often, and of the rest a seeded systematic selection: block j of m is taken when (j r + u) / m passes an
integer, for r blocks to take and a seeded start u. Words taken before any place of the line are a closed formula of
the place, so what the mix takes of a document needs the two ends of its span, however long it is.

Scale: texts are read once, for sizes and hashes; only rows without texts move. A hot source is split over its
shards, so no window holds more than one shard's documents, or one source's shards. Ranks over all sources come from
range partitions and their offsets, and only quotients between two divisors that bracket the border are compared,
at most two a source unless bounds on sources bind.

Results: null and empty texts have size 0 and nothing is taken of them; a source without words has target 0; rows
with a null doc_id and repeated rows are documents like any other (equal rows may get different shares, the same as
a bag in every run); extra columns are ignored; an empty table, or one without words, takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.llm.common import Scratch, maybe_broadcast

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
#: Shards of a table of n documents: at least SHARDS, and n / SHARD_DOCS.
SHARDS, SHARD_DOCS = 64, 20_000
#: The largest block; blocks are a thousandth of the smallest source, so that its rounding stays small too.
BLOCK_WORDS, PART = 256, 1000
#: Rows of ten numbers that a size-checked join may broadcast.
CELL_ROWS = 100_000


def _digits(name: Column, at: int) -> Column:
    """An integer below 2 ** 32 from hexadecimal digits."""
    return F.conv(F.substring(name, at, 8), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, key, size, name): word counts and the seeded name that orders documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(text)))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))  # never null, so that it can be a plain join key
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key.alias("key"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), name.alias("name")).select(
        "doc_id", "source", "key", F.coalesce("words", F.lit(0)).cast("long").alias("size"), "name"
    )


def ranked(scratch: Scratch, df: DataFrame, *order: Column) -> DataFrame:
    """df with place, from 0, in an order over all rows: counted within range partitions, which are then added up."""
    dealt = scratch.keep(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy("__part").orderBy(*order)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))  # a row a partition
    return scratch.keep(dealt.join(F.broadcast(first), "__part").withColumn("place", F.row_number().over(own) - 1 + F.col("__first")).drop("__part", "__first"))


def targets(scratch: Scratch, sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources(source, key, source_size) with place, weight and target."""
    placed = ranked(scratch, sources, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = scratch.keep(placed.withColumn("weight", weight.cast("long")))
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * most
    level, full = 0.0, -1
    while True:  # each round finds more sources above their limit, or ends
        over = F.lit(False) if full < 0 else F.col("weight") * F.lit(level) > limit
        got = placed.agg(F.sum(F.when(~over, F.col("weight"))).alias("w"), F.sum(F.when(over, limit)).alias("used"), F.count(F.when(over, 1)).alias("full")).first()
        if got["full"] == full or not got["w"]:
            break
        full, level = got["full"], float(total - (got["used"] or 0)) / float(got["w"])
    return placed.withColumn("target", F.least(F.col("weight") * F.lit(level), limit.cast("double")))


def apportion(scratch: Scratch, parties: DataFrame, seats: int) -> DataFrame:
    """parties(place, votes, most_seats) with seats: Sainte-Lague by highest quotients, ties to the smaller place, over rows of any number."""
    n, votes = parties.agg(F.count(F.lit(1)), F.sum("votes")).first()
    if not n or not votes or not seats:
        return parties.withColumn("seats", F.lit(0).cast("long"))

    def at(per_vote: float) -> Column:
        """Seats of a party whose quotients are at least 1 / (2 per_vote)."""
        return F.least(F.floor(F.col("votes") * F.lit(per_vote) + 0.5), "most_seats").cast("long")

    low, step = max(0.0, (seats - n / 2 - 1) / votes), n / 2 + 1
    while True:  # widened only where bounds on parties bind
        high = (seats + step) / votes
        reached, more = parties.agg(F.sum(at(high)), F.count(F.when((F.col("votes") > 0) & (at(high) < F.col("most_seats")), 1))).first()
        if reached >= seats or not more:
            break
        step *= 2
    base = parties.agg(F.sum(at(low))).first()[0]
    ks = F.explode(F.sequence(at(low), at(high) - 1))
    asked = parties.where(at(high) > at(low)).select("place", "votes", ks.alias("k"))
    asked = asked.select("place", (F.col("votes") / (2 * F.col("k") + 1)).alias("quotient"))
    won = ranked(scratch, asked.withColumnRenamed("place", "party"), F.desc("quotient"), F.col("party")).where(F.col("place") < seats - base)
    won = won.groupBy("party").agg(F.count(F.lit(1)).alias("won"))
    return parties.join(won, F.col("place") == F.col("party"), "left").withColumn("seats", at(low) + F.coalesce("won", F.lit(0))).drop("party", "won")


def shard_quotas(cells: DataFrame, most: int = MOST) -> DataFrame:
    """cells(key, shard, blocks, seats: those of its source) with quota: each source's seats to its shards by highest quotients."""
    own = Window.partitionBy("key")
    cells = cells.withColumn("__all", F.sum("blocks").over(own)).withColumn("__n", F.count(F.lit(1)).over(own))

    def at(seats: Column) -> Column:
        return F.when(F.col("__all") > 0, F.least(F.floor(F.col("blocks") * F.greatest(seats, F.lit(0.0)) / F.col("__all") + 0.5), F.col("blocks") * most)).otherwise(0).cast("long")

    cells = cells.withColumn("__low", at(F.col("seats") - F.col("__n") / 2 - 1)).withColumn("__high", at(F.col("seats") + F.col("__n") / 2 + 1))
    cells = cells.withColumn("__left", F.col("seats") - F.sum("__low").over(own))
    asked = cells.where("__high > __low").select("key", "shard", "blocks", "__left", F.explode(F.sequence("__low", F.col("__high") - 1)).alias("k"))
    order = Window.partitionBy("key").orderBy(F.desc(F.col("blocks") / (2 * F.col("k") + 1)), "shard")
    won = asked.withColumn("at", F.row_number().over(order)).where("at <= __left").groupBy("key", "shard").agg(F.count(F.lit(1)).alias("won"))
    return cells.join(won, ["key", "shard"], "left").withColumn("quota", F.col("__low") + F.coalesce("won", F.lit(0))).drop("__all", "__n", "__low", "__high", "__left", "won")


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of longs."""
    return F.call_function("div", a, b)


def _copies(j: Column) -> Column:
    """Copies that a shard's quota takes of its first j blocks."""
    return F.col("passes") * j + _div(F.col("rest") * j + F.col("start"), F.greatest("blocks", F.lit(1)))


def _taken_before(place: Column) -> Column:
    """Words taken of a shard's blocks before a place of the source's line that isn't before them."""
    j = _div(place, F.col("block_words")) - F.col("first")
    return _copies(j) * F.col("block_words") + (_copies(j + 1) - _copies(j)) * (place % F.col("block_words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int | None = None, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, source_size, target, block_words, at, taken, ...) of every row of docs.

    at is where the document begins in its source's line; with the columns of its shard (first, blocks, passes,
    rest, start, before) ``spans`` tells which of its words are taken how often.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(sized(docs, seed))
    shards = max(SHARDS, -(-rows.count() // SHARD_DOCS))
    rows = rows.withColumn("shard", _digits(F.col("name"), 1) % shards)
    cells = scratch.keep(rows.groupBy("source", "key", "shard").agg(F.sum("size").alias("words")))
    sources = targets(scratch, cells.groupBy("source", "key").agg(F.sum("words").alias("source_size")), weights, most)
    total, least = sources.agg(F.sum("source_size"), F.min(F.when(F.col("source_size") > 0, F.col("source_size")))).first()
    block = block_words or max(1, min(BLOCK_WORDS, (least or 0) // PART))
    blocks_of = F.expr(f"(source_size + {block - 1}) div {block}")
    parties = sources.select("key", "source_size", "target", "place", F.col("target").alias("votes"), (blocks_of * most).alias("most_seats"))
    seats = apportion(scratch, parties, (2 * (total or 0) + block) // (2 * block)).select("key", "source_size", "target", "seats")
    line = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.join(maybe_broadcast(seats, most=CELL_ROWS), "key").withColumn("origin", F.coalesce(F.sum("words").over(line), F.lit(0)).cast("long"))
    cells = cells.withColumn("first", F.expr(f"(origin + {block - 1}) div {block}")).withColumn("blocks", F.expr(f"(origin + words + {block - 1}) div {block}") - F.col("first"))
    cells = shard_quotas(cells, most)
    whole = F.greatest("blocks", F.lit(1))
    cells = cells.withColumn("passes", F.expr("quota div greatest(blocks, 1)")).withColumn("rest", F.col("quota") % whole)
    cells = cells.withColumn("start", _digits(F.md5(F.concat(F.lit(f"{seed}:"), "key", F.lit(":"), F.col("shard").cast("string"))), 1) % whole)
    last = F.when(F.col("blocks") > 0, F.expr("passes + (rest * blocks + start) div blocks - (rest * (blocks - 1) + start) div blocks"))
    cells = cells.withColumn("before", F.coalesce(F.last(last, ignorenulls=True).over(line), F.lit(0)))
    cells = scratch.keep(cells.select("key", "shard", "source_size", "target", "origin", "first", "blocks", "passes", "rest", "start", "before"))
    order = Window.partitionBy("key", "shard").orderBy("name", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__in", F.coalesce(F.sum("size").over(order), F.lit(0)))
    placed = placed.join(maybe_broadcast(cells, most=CELL_ROWS), ["key", "shard"]).withColumn("at", F.col("origin") + F.col("__in")).withColumn("block_words", F.lit(block).cast("long"))
    # words before the shard's first block belong to the last block of the shard before
    head = F.greatest(F.least(F.expr("at + size"), F.expr("first * block_words")) - F.col("at"), F.lit(0))
    own = [F.greatest(F.expr(x), F.expr("first * block_words")) for x in ("at", "at + size")]
    taken = head * F.col("before") + _taken_before(own[1]) - _taken_before(own[0])
    return placed.select("doc_id", "source", "size", "source_size", "target", "block_words", "at", "first", "blocks", "passes", "rest", "start", "before", taken.cast("long").alias("taken"))


def spans(mixed: DataFrame) -> DataFrame:
    """(doc_id, source, start, length, copies): the words of each document that a mix takes, a row for each block they lie in."""
    block = F.explode(F.sequence(F.expr("at div block_words"), F.expr("(at + size - 1) div block_words")))
    each = mixed.where("size > 0").withColumn("__k", block).withColumn("__j", F.col("__k") - F.col("first"))
    begin, end = F.greatest("at", F.expr("__k * block_words")), F.least(F.expr("at + size"), F.expr("(__k + 1) * block_words"))
    copies = F.when(F.col("__j") < 0, F.col("before")).otherwise(_copies(F.col("__j") + 1) - _copies(F.col("__j")))
    return each.select("doc_id", "source", (begin - F.col("at")).alias("start"), (end - begin).alias("length"), copies.alias("copies")).where("copies > 0")
