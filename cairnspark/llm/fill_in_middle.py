"""Fill-in-middle transformation: escaped marker injection, with DataFrame functions only.

A delimiter is escaped in the text, appended to every unit (a run of letters A-Z and a-z, or one other code
point) by regexp_replace and counted; substring_index then cuts the text after any number of units. Cuts and
form come from a hash of the seed and doc_id, so a row's result depends on nothing but the row. The parts are
unescaped and assembled: psm puts the suffix before the middle, spm puts it first. Nothing is exploded or
shuffled.

A transformed text holds none of the marks, and no mark overlaps another, so the first mark of a kind in the
output is the one that was put there: ``restored`` reads the text back from output and form alone.

Results: a null text is an empty one; an empty text, or one that holds a mark, is plain; a null doc_id hashes as
the word null; repeated rows have equal results; extra columns stay, but those named like a result are replaced;
an empty table gives an empty result; control characters in the text, the delimiter among them, come back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.common import text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of a hundred hashes: so many rows are transformed, and of those so many put the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: The delimiter, and what stands before the digit of an escaped character.
MARK, ESCAPE = "\x01", "\x02"
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(MARK), F.lit(ESCAPE + "1"))


def _unescaped(part: Column) -> Column:
    """A part without delimiters, as it stood in the text."""
    return F.replace(F.replace(F.replace(part, F.lit(MARK), F.lit("")), F.lit(ESCAPE + "1"), F.lit(MARK)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def _upto(text: str, mark: Column, count: Column) -> Column:
    return F.call_function("substring_index", F.col(text), mark, count.cast("int"))


def draws(doc_id: str, seed: int = SEED) -> Column:
    """Four integers from 0 to 2 ** 32 - 1 of a row."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 256)
    return F.array(*[F.conv(F.substring(name, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def fill_in_middle(docs: DataFrame, seed: int = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain), and output."""
    own = [c for c in docs.columns if c not in RESULTS]
    text = text_or_empty()
    df = docs.select(*own, text.alias("__text"), draws("doc_id", seed).alias("__h"))
    df = df.withColumn("__units", F.regexp_replace(_escaped(F.col("__text")), f"([A-Za-z]+|{ESCAPE}[01]|[^A-Za-z])", "$1" + MARK))
    df = df.withColumn("n", (F.length("__units") - F.length(F.replace("__units", F.lit(MARK), F.lit("")))).cast("long"))
    a, b = (F.col("__h")[k] % (F.col("n") + 1) for k in (0, 1))
    held = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("__text", F.lit(mark))
    plain = (F.col("__text") == "") | held | (F.col("__h")[2] % 100 >= transformed)
    form = F.when(plain, "plain").when(F.col("__h")[3] % 100 < suffix_first, "spm").otherwise("psm")
    df = df.select(*own, "__text", "__units", "n", F.least(a, b).alias("__a"), F.greatest(a, b).alias("__b"), form.alias("form"))
    mark = F.lit(MARK)
    # the units end in a delimiter, so b units from the left and n - b + 1 delimiters from the right meet
    df = df.withColumn("__head", _upto("__units", mark, F.col("__b")))
    cut = F.col("form") != "plain"
    df = df.select(
        *own,
        "n",
        "form",
        "__text",
        F.when(cut, _unescaped(_upto("__head", mark, F.col("__a")))).alias("__prefix"),
        F.when(cut, F.when(F.col("__a") == F.col("__b"), "").otherwise(_unescaped(_upto("__head", mark, F.col("__a") - F.col("__b"))))).alias("__middle"),
        F.when(cut, _unescaped(_upto("__units", mark, F.col("__b") - F.col("n") - 1))).alias("__suffix"),
    )
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    psm = F.concat(p, F.col("__prefix"), s, F.col("__suffix"), m, F.col("__middle"))
    spm = F.concat(s, F.col("__suffix"), p, F.col("__prefix"), m, F.col("__middle"))
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("__text"))
    return df.select(*own, "n", "form", F.length("__prefix").cast("long").alias("prefix_chars"), F.length("__middle").cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of."""

    def before(c: Column, mark: str) -> Column:
        return F.substring_index(c, mark, 1)

    def after(c: Column, mark: str) -> Column:
        return F.substring_index(c, mark, -1)

    whole = F.col(output)
    psm = F.concat(after(before(whole, SUFFIX), PREFIX), after(whole, MIDDLE), before(after(whole, SUFFIX), MIDDLE))
    spm = F.concat(before(after(whole, PREFIX), MIDDLE), after(whole, MIDDLE), after(before(whole, PREFIX), SUFFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(whole)
