"""Queries of the main text of web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnspark.plans.registry import query, table
from cairnspark.sources import webpages as W


def _plain(html: str) -> str:
    out = rf"regexp_replace({html}, '(?s)<[^>]*>', ' ', 'g')"
    for name, letter in W.ENTITIES:
        out = f"replace({out}, '{name}', '{letter if letter != chr(39) else chr(39) * 2}')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def _main_text_sql() -> str:
    body = "html"
    for p in W.HIDDEN:
        body = f"regexp_replace({body}, '{p}', ' ', 'g')"
    marked = rf"regexp_replace(regexp_replace(regexp_replace({body}, '{W.HEADING}', chr(1) || chr(2) || '\1', 'g'), '{W.ITEM}', chr(1) || chr(2) || '7', 'g'), '{W.BLOCK}', chr(1), 'g')"
    linked = f"array_to_string(regexp_extract_all(b, '{W.LINK}', 1), ' ')"
    return rf"""WITH cut AS (SELECT page_id, html, string_split({marked}, chr(1)) AS bs FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)),
 each AS (SELECT page_id, unnest(bs) AS b, generate_subscripts(bs, 1) AS i FROM cut),
 told AS (SELECT page_id, i, coalesce(TRY_CAST(regexp_extract(b, '^\x02([1-7])', 1) AS INTEGER), 0) AS level, {_plain(r"regexp_replace(b, '^\x02[1-7]', '')")} AS text, {_plain(linked)} AS linked FROM each),
 counted AS (SELECT page_id, i, level, text, len(string_split(text, ' ')) AS words, CASE WHEN linked = '' THEN 0 ELSE len(string_split(linked, ' ')) END AS linked FROM told WHERE text <> ''),
 near AS (SELECT *, greatest(words - linked, 0) AS free, lag(greatest(words - linked, 0), 1, 0) OVER w AS p, lead(greatest(words - linked, 0), 1, 0) OVER w AS n, lead(greatest(words - linked, 0), 2, 0) OVER w AS n2, lead(level, 1, 0) OVER w AS nl FROM counted WINDOW w AS (PARTITION BY page_id ORDER BY i)),
 kept AS (SELECT page_id, string_agg(CASE WHEN level BETWEEN 1 AND 6 THEN repeat('#', level) || ' ' WHEN level = 7 THEN '- ' ELSE '' END || text, chr(10) || chr(10) ORDER BY i) AS body FROM near
  WHERE 3 * linked <= words AND CASE WHEN level BETWEEN 1 AND 6 THEN greatest(n, n2) >= 8 ELSE p + 2 * free + CASE WHEN nl BETWEEN 1 AND 6 THEN greatest(n, n2) ELSE n END >= 32 END GROUP BY page_id)
 SELECT page_id, {_plain("trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")} AS title, md5(coalesce(body, '')) AS body FROM cut LEFT JOIN kept USING (page_id)"""


@query("a15_main_text", _main_text_sql())
def a15_main(spark, sf):
    return W.main_text(table(spark, sf, "pages")).select("page_id", "title", F.md5("body").alias("body"))
