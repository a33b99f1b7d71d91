"""The registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import bpe, chat_format, conversation_repair, fill_middle, line_dedup, media, mixing, pivot_index, quality_rules, simhash, token_files, toxicity, warc
from panelwright.llm.common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


#: Targets of the registered mixture: 60 % of all tokens, no leaf more than twice.
MIXTURE = mixing.Mixture(
    weights={"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 6, "de": 2, "fr": 2}},
    budget_parts=3,
    budget_whole=5,
    max_epochs=2,
    seed="mix",
)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_rows(table(spark, sf_dir, "documents"), MIXTURE, mixing.domain_of_source(F.col("source")))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip_digests(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    first = F.get("offending", 0)
    return found.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"), first.start.alias("first_start"), first.end.alias("first_end"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotation_digests(table(spark, sf_dir, "conversations"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.store_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return pivot_index.exact_top_k(vectors.filter("vec_id % 50 = 0"), vectors, 5)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.transform_digests(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversations, conversation_repair.damaged(conversations))


def _split_sql(name: str, nodes: str, parents: str, label: str) -> str:
    """CTEs that split `budget` over `nodes` (parents, label, weight, cap, budget) into `given`."""
    over = f"PARTITION BY {parents}" if parents else ""
    return f"""
{name}_a AS (
  SELECT *, (budget - coalesce(sum(cap) OVER ({over} ORDER BY cap / weight, {label} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
    >= cap * sum(weight) OVER ({over} ORDER BY cap / weight, {label} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full
  FROM ({nodes})
), {name}_b AS (
  SELECT *, budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({over}) AS remaining,
    greatest(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({over}), 1) AS open_weight FROM {name}_a
), {name}_c AS (
  SELECT *, CASE WHEN is_full THEN 0 ELSE weight * remaining // open_weight END AS share,
    CASE WHEN is_full THEN -1 ELSE weight * remaining % open_weight END AS rest FROM {name}_b
), {name}_d AS (
  SELECT *, remaining - sum(share) OVER ({over}) AS spare, row_number() OVER ({over} ORDER BY rest DESC, {label}) AS place FROM {name}_c
), {name} AS (
  SELECT *, CASE WHEN is_full THEN cap WHEN place <= spare THEN share + 1 ELSE share END AS given FROM {name}_d
)"""


def mixture_sql(mixture: mixing.Mixture, documents: str = "documents") -> str:
    """The rows of mixture_rows, for DuckDB; documents is a table or query in brackets."""

    def weight(level: str) -> str:
        cases = "".join(f"WHEN {level} = '{k}' THEN {v} " for k, v in mixture.weights.get(level, {}).items())
        return f"CASE {cases}ELSE 1 END" if cases else "1"

    nodes = [
        f"SELECT domain, {weight('domain')} AS weight, sum(cap) AS cap, (SELECT least(sum(cap), sum(tokens) * {mixture.budget_parts} // {mixture.budget_whole}) FROM leaves) AS budget FROM leaves GROUP BY domain",
        f"SELECT domain, lang, {weight('lang')} AS weight, sum(leaves.cap) AS cap, any_value(given) AS budget FROM leaves JOIN by_domain USING (domain) GROUP BY domain, lang",
        f"SELECT domain, lang, source, {weight('source')} AS weight, sum(leaves.cap) AS cap, any_value(given) AS budget FROM leaves JOIN by_lang USING (domain, lang) GROUP BY domain, lang, source",
    ]
    return rf"""
WITH docs AS (
  SELECT doc_id, text, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE TRY_CAST(regexp_extract(source, '(\d{{1,9}})$', 1) AS INT) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'code' ELSE 'other' END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens
  FROM {documents}
), leaves AS (
  SELECT domain, lang, source, sum(tokens) AS tokens, sum(tokens) * {mixture.max_epochs} AS cap FROM docs GROUP BY domain, lang, source
), {_split_sql("by_domain", nodes[0], "", "domain")}, {_split_sql("by_lang", nodes[1], "domain", "lang")}, {_split_sql("by_source", nodes[2], "domain, lang", "source")}, plan AS (
  SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS rest
  FROM leaves JOIN by_source USING (domain, lang, source)
), placed AS (
  SELECT docs.*, epochs, rest, coalesce(sum(tokens) OVER (
      PARTITION BY domain, lang, source ORDER BY md5('{mixture.seed}:' || (epochs + 1)::BIGINT || ':' || coalesce(doc_id::VARCHAR, '')), doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, epoch::INT AS epoch, tokens AS n_tokens, tokens AS n_taken FROM placed, LATERAL (SELECT unnest(range(1, epochs::BIGINT + 1)) AS epoch)
UNION ALL
SELECT doc_id, domain, lang, source, (epochs + 1)::INT, tokens, least(tokens, rest - before)::BIGINT FROM placed WHERE before < rest
"""


OP2_SQL = mixture_sql(MIXTURE)

OP5_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs
), lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs
), line_counts AS (
  SELECT r, line, count(*) AS c FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line
), dup AS (
  SELECT r, sum(c)::BIGINT AS n_lines, sum(c - 1)::BIGINT AS n_dup_lines FROM line_counts GROUP BY r
), wins AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM words WHERE len(w) >= 3
), keyed AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM wins
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM keyed) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), base AS (
  SELECT doc_id, words.r AS r, w, text, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN dup USING (r) LEFT JOIN covered ON covered.r = words.r
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR 100 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) < 70 * n_words
    OR 100 * len(list_distinct(w)) < 10 * least(n_words, 1000)
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)
    OR 10 * n_symbols > n_words) AS kept
FROM judged
"""

OP6_SQL = r"""
WITH messages AS (
  SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id AS who, role AS perspective FROM messages WHERE role IS DISTINCT FROM 'system'
), pieces AS (
  SELECT conv_id, turn, role, text, perspective, role IS NOT DISTINCT FROM perspective AS mine,
    '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role IS NOT DISTINCT FROM perspective THEN 'assistant'
      ELSE 'user name=' || CASE WHEN role IS NULL THEN '_null' WHEN regexp_full_match(role, '[A-Za-z0-9-][A-Za-z0-9_-]*') THEN role
        ELSE '_' || lower(hex(encode(role))) END END || chr(10) || text || '<|im_end|>' || chr(10) AS piece
  FROM messages JOIN speakers ON conv_id IS NOT DISTINCT FROM who
), placed AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, role NULLS FIRST, text ROWS UNBOUNDED PRECEDING) AS upto FROM pieces
), spans AS (
  SELECT *, upto - length(piece) + 22 AS a, upto - 1 AS b FROM placed
)
SELECT conv_id, perspective, count(*)::BIGINT AS n_messages, sum(length(piece))::BIGINT AS n_chars,
  coalesce(sum(b - a) FILTER (WHERE mine), 0)::BIGINT AS masked_chars,
  sha256(string_agg(piece, '' ORDER BY turn NULLS LAST, role NULLS FIRST, text)) AS rendered_sha256,
  coalesce(string_agg(a::BIGINT || '-' || b::BIGINT, ',' ORDER BY turn NULLS LAST, role NULLS FIRST, text, a) FILTER (WHERE mine), '') AS mask
FROM spans GROUP BY conv_id, perspective
"""

OP7_SQL = r"""
WITH bodies AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), marked AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS newest FROM bodies
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM marked
"""

OP10_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), exploded AS (
  SELECT r, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM docs
), keyed AS (
  SELECT r, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM exploded
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT r, i, line, k IN (SELECT k FROM frequent) AS gone FROM keyed
), summed AS (
  SELECT r, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM summed JOIN docs USING (r)
"""

OP11_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents
), drawn AS (
  SELECT *, len(units) AS n, list_transform(range(4), lambda i: ('0x' || substr(hex, (1 + 8 * i)::BIGINT, 8))::BIGINT) AS h FROM docs
), cut AS (
  SELECT *, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 AS plain,
    array_to_string(units[:least(h[1] % (n + 1), h[2] % (n + 1))], '') AS prefix,
    array_to_string(units[least(h[1] % (n + 1), h[2] % (n + 1)) + 1:greatest(h[1] % (n + 1), h[2] % (n + 1))], '') AS middle,
    array_to_string(units[greatest(h[1] % (n + 1), h[2] % (n + 1)) + 1:], '') AS suffix FROM drawn
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN h[4] % 100 < 50 THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_mixing": op2_mixing,
    "op3_media": op3_media,
    "op4_toxicity": op4_toxicity,
    "op5_quality_rules": op5_quality_rules,
    "op6_chat_format": op6_chat_format,
    "op7_warc": op7_warc,
    "op8_simhash": op8_simhash,
    "op9_huffman_ids": op9_huffman_ids,
    "op10_line_dedup": op10_line_dedup,
    "op11_exact_top_k": op11_exact_top_k,
    "op12_fill_middle": op12_fill_middle,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {"op2_mixing": OP2_SQL, "op5_quality_rules": OP5_SQL, "op6_chat_format": OP6_SQL, "op7_warc": OP7_SQL, "op10_line_dedup": OP10_SQL, "op11_exact_top_k": OP11_SQL, "op12_fill_middle": OP12_SQL}
