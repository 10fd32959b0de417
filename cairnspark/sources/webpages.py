"""Main text of web pages by the density of words and links, as Markdown with where it came from; DataFrame expressions only.

A page is cut into blocks at its block tags. A block is told by its free words (those outside links): it stays if at
most a third of its words are linked and its free words, smoothed with those of its neighbours, reach a threshold. So
menus go by their links, adverts and notices by standing short among short ones, while a short line between paragraphs
stays. A heading stays if a block of text follows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.sources.loaders import article_markdown, page_title

#: Smoothed free words of a block that stays, free words of the text below a heading, and linked words: one in so many at most.
LEAST, BELOW, LINKED = 8, 8, 3
HIDDEN = (r"(?s)<!--.*?-->", r"(?is)<head\b.*?</head\s*>", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?is)<noscript\b.*?</noscript\s*>", r"(?is)<template\b.*?</template\s*>")
HEADING = r"(?i)<h([1-6])\b[^>]*>"
ITEM = r"(?i)<li\b[^>]*>"
BLOCK = r"(?i)</?(?:p|div|article|section|main|nav|header|footer|aside|ul|ol|li|table|tr|td|th|h[1-6]|blockquote|pre|form|figure|br|hr|body|html)\b[^>]*>"
LINK = r"(?is)<a\b[^>]*>(.*?)</a\s*>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def plain(html: Column) -> Column:
    """Text without tags, the common character references decoded, white space as single spaces."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for name, letter in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(letter))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def word_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def text_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with __blocks, the blocks that have words: level (of a heading, 7 for list items, else 0), text, words, free."""
    body = F.coalesce(F.col(html), F.lit(""))
    for p in HIDDEN:
        body = F.regexp_replace(body, p, " ")
    body = F.regexp_replace(F.regexp_replace(body, HEADING, "\x01\x02$1"), ITEM, "\x01\x027")
    cut = pages.withColumn("__cut", F.split(F.regexp_replace(body, BLOCK, "\x01"), "\x01"))
    split = F.transform("__cut", lambda b: F.struct(F.coalesce(F.regexp_extract(b, "^\x02([1-7])", 1).try_cast("int"), F.lit(0)).alias("level"), plain(F.regexp_replace(b, "^\x02[1-7]", "")).alias("text"), plain(F.array_join(F.regexp_extract_all(b, F.lit(LINK), F.lit(1)), " ")).alias("linked")))
    told = cut.withColumn("__parts", F.filter(split, lambda b: b["text"] != "")).drop("__cut")
    counted = F.transform("__parts", lambda b: F.struct(b["level"].alias("level"), b["text"].alias("text"), word_count(b["text"]).alias("words"), word_count(b["linked"]).alias("linked")))
    return told.withColumn("__counted", counted).drop("__parts").withColumn("__blocks", F.transform("__counted", lambda b: b.withField("free", F.greatest(b["words"] - b["linked"], F.lit(0))))).drop("__counted")


def main_text(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Pages with title, body and markdown: a header with title, site and link, then the main text; a page without any has an empty body."""
    blocks = text_blocks(pages, html)
    free = lambda i: F.coalesce(F.get(F.col("__blocks"), i)["free"], F.lit(0))

    def kept(b: Column, i: Column) -> Column:
        unlinked = b["linked"] * LINKED <= b["words"]
        heading = b["level"].between(1, 6)
        over = F.coalesce(F.get(F.col("__blocks"), i + 1)["level"].between(1, 6), F.lit(False))  # a heading stands for the text below it
        smooth = (free(i - 1) + 2 * b["free"] + F.when(over, F.greatest(free(i + 1), free(i + 2))).otherwise(free(i + 1))) / 4
        return unlinked & F.when(heading, F.greatest(free(i + 1), free(i + 2)) >= BELOW).otherwise(smooth >= LEAST)

    marked = blocks.withColumn("__kept", F.filter("__blocks", kept))
    line = F.transform("__kept", lambda b: F.concat(F.when(b["level"].between(1, 6), F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" "))).when(b["level"] == 7, "- ").otherwise(""), b["text"]))
    out = marked.withColumn("title", plain(page_title(F.coalesce(F.col(html), F.lit(""))))).withColumn("body", F.array_join(line, "\n\n"))
    site = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#]*)", 1)
    return out.withColumn("markdown", article_markdown(F.when(F.col("title") != "", F.col("title")).otherwise(site), F.col("body"), F.coalesce(F.col(url), F.lit("")), site=F.nullif(site, F.lit("")))).drop("__blocks", "__kept")
