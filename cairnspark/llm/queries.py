"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm.common import table
from cairnspark.llm.compression_toxicity import toxicity
from cairnspark.llm.fill_in_middle import fill_in_middle, restored
from cairnspark.llm.importance_resampling import resample
from cairnspark.llm.jaccard_join import jaccard_components
from cairnspark.llm.line_dedup import dedup_lines
from cairnspark.llm.packing import pack_documents
from cairnspark.llm.page_difference import extract
from cairnspark.llm.robust_graph import search
from cairnspark.llm.rule_ledger import MEASURES, apply_policy, ledger, mask
from cairnspark.llm.rule_ledger import RULES as RULE_BITS
from cairnspark.llm.source_mixing import mix
from cairnspark.llm.url_filter import LISTED, RULES, judge
from cairnspark.llm.whitening import whiten
from cairnspark.llm.word_bpe import encode_decode


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents"), n_words=5)
    return found.select("doc_id", "n_shingles", "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = apply_policy(found, "keep-1")
    base = ~apply_policy(found, "base-1")
    return found.select("doc_id", *MEASURES, "failures", base.alias("base_failed"), kept.alias("kept"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op7_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES, LISTED)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), end_id=1)


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"), components=8)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c")
    found = found.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", each)
    return found.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=1)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_line_dedup, op3_ngram_jaccard_join, op4_quality_rules, op5_toxicity, op6_html_extraction, op7_word_bpe, op8_nearest_neighbours, op9_url_filters, op10_packing, op11_source_mixing, op12_embedding_whitening, op13_fill_in_middle)}


def _keys_sql(keys: tuple[tuple[str, str, str], ...]) -> str:
    return ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in keys)


OP9_SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {_keys_sql(RULES)}), listed(verdict, host, path) AS (VALUES {_keys_sql(LISTED)}),
cut AS (SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
urls AS (SELECT DISTINCT host, path FROM parts),
ruled AS (SELECT u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY ALL),
named AS (SELECT u.host, u.path, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM urls u JOIN listed r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, ruled.rule, coalesce(ruled.verdict, named.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN ruled USING (host, path) LEFT JOIN named USING (host, path)"""

OP4_SQL = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base),
grams AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM split WHERE len(words) >= 3),
placed AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM grams),
hit AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS w FROM placed WHERE n >= 2) GROUP BY doc_id),
measured AS (SELECT s.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  length(regexp_replace(text, '[^\p{Lu}]', '', 'g'))::BIGINT AS n_upper, coalesce(hit.n, 0)::BIGINT AS n_repeat_words FROM split s LEFT JOIN hit USING (doc_id)),
bits AS (SELECT *, BITS AS failures FROM measured)
SELECT *, (failures & BASE) <> 0 AS base_failed, (failures & KEPT) = 0 AS kept FROM bits"""
OP4_SQL = OP4_SQL.replace("BITS", "(" + " | ".join(f"CASE WHEN {r.fails} THEN {1 << k} ELSE 0 END" for k, r in enumerate(RULE_BITS)) + ")::BIGINT").replace("BASE", str(mask("base-1"))).replace("KEPT", str(mask("keep-1")))

#: Every block and every quotient is written out here; the operator has closed formulas and brackets instead.
OP11_SQL = r"""
WITH sized AS (SELECT row_number() OVER () AS rn, doc_id, source, coalesce('s' || source, '') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  md5('1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS name FROM documents),
shards AS (SELECT greatest(64, ceil(count(*) / 20000)::BIGINT) AS h FROM sized),
dealt AS (SELECT sized.*, ('0x' || substr(name, 1, 8))::BIGINT % h AS shard FROM sized, shards),
sources AS (SELECT source, key, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
weighed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, 1 + place % 3 AS w FROM sources),
steps AS (SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level, 3 * source_size / w AS turn FROM weighed
  WINDOW before AS (ORDER BY 3 * source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT coalesce(arg_min(level, turn) FILTER (WHERE w * level <= 3 * source_size), 0) AS level FROM steps),
aimed AS (SELECT weighed.*, least(w * level, (3 * source_size)::DOUBLE) AS target FROM weighed, level),
block AS (SELECT greatest(1, least(256, coalesce(min(source_size) FILTER (WHERE source_size > 0), 0) // 1000))::BIGINT AS b, coalesce(sum(source_size), 0)::BIGINT AS total FROM sources),
asked AS (SELECT place, key, target / (2 * k + 1) AS quotient, (2 * total + b) // (2 * b) AS house FROM aimed, block, range(0, 3 * ((source_size + b - 1) // b)) AS r(k)),
won AS (SELECT key, count(*)::BIGINT AS seats FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, place) AS pos FROM asked) WHERE pos <= house GROUP BY key),
cells AS (SELECT key, shard, sum(size)::BIGINT AS words FROM dealt GROUP BY ALL),
lined AS (SELECT *, (sum(words) OVER (PARTITION BY key ORDER BY shard) - words)::BIGINT AS origin FROM cells),
cut AS (SELECT lined.*, (origin + b - 1) // b AS first, (origin + words + b - 1) // b - first AS blocks, b FROM lined, block),
offered AS (SELECT cut.key, shard, coalesce(seats, 0) AS seats, blocks / (2 * k + 1) AS quotient FROM cut LEFT JOIN won USING (key), range(0, 3 * blocks) AS r(k)),
quotas AS (SELECT key, shard, count(*)::BIGINT AS quota FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY quotient DESC, shard) AS pos FROM offered) WHERE pos <= seats GROUP BY ALL),
blocks AS (SELECT cut.key, (first + j) * b AS lo, (first + j + 1) * b AS hi, coalesce(quota, 0) AS q, ('0x' || substr(md5('1:' || cut.key || ':' || shard), 1, 8))::BIGINT % blocks AS u,
  q // blocks + ((j + 1) * (q % blocks) + u) // blocks - (j * (q % blocks) + u) // blocks AS copies FROM cut LEFT JOIN quotas USING (key, shard), range(0, blocks) AS r(j)),
placed AS (SELECT d.*, origin + sum(size) OVER (PARTITION BY d.key, d.shard ORDER BY name, doc_id, size, rn) - size AS pos FROM dealt d JOIN cut USING (key, shard)),
got AS (SELECT rn, sum(copies * (least(pos + size, hi) - greatest(pos, lo)))::BIGINT AS taken FROM placed p JOIN blocks x ON p.key = x.key AND lo < pos + size AND hi > pos WHERE size > 0 GROUP BY rn)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM dealt JOIN aimed USING (key) LEFT JOIN got USING (rn)"""

OP13_SQL = r"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
drawn AS (SELECT doc_id, text, units, len(units)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS d,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
    WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT *, array_to_string(units[1:least(c, d)], '') AS p, array_to_string(units[least(c, d) + 1:greatest(c, d)], '') AS m, array_to_string(units[greatest(c, d) + 1:], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts"""

ORACLES: dict[str, str] = {"op4_quality_rules": OP4_SQL, "op9_url_filters": OP9_SQL, "op11_source_mixing": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
