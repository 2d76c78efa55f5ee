"""The registered queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaselens.llm import class_lm, jaccard_join, language_id, license_scan, line_dedup, near_embeddings, packing, pii, piece_codec, prefix_trie, topk, url_filters, vector_codes


def vocabulary(name: str) -> str:
    """Where a public tokenizer file lies on this machine and on every executor; PHASELENS_TOKENIZERS names another folder."""
    folder = os.environ.get("PHASELENS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), url_filters.SITE_RULES + url_filters.PATTERN_RULES)


def op3_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(table(spark, sf_dir, "documents"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.token_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_near_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify_documents(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "lang", F.round("confidence", 6).alias("confidence"), "text_lang", F.col("accepted").alias("kept"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_digest(table(spark, sf_dir, "embeddings"))


def op12_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.class_scores(table(spark, sf_dir, "documents"), class_lm.held_out())


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of ``op4_pii_spans``: the numbers of base spans."""
    return op4_pii_spans(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of ``op6_license_scan``: exact places of the base phrases, -1 where there is none."""
    places = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("first_word", "last_word")]
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", *places, "base_labels")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
    return found.select("page_id", "lang", F.round("confidence", 6).alias("confidence"), "text_lang", "accepted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_url_filters": op2_url_filters,
        "op3_block_top_k": op3_block_top_k,
        "op4_pii_spans": op4_pii_spans,
        "op5_line_dedup": op5_line_dedup,
        "op6_license_scan": op6_license_scan,
        "op9_near_embeddings": op9_near_embeddings,
        "op10_language_id": op10_language_id,
        "language_of_pages": language_of_pages,
        "pii_base_counts": pii_base_counts,
        "license_base_places": license_base_places,
        "op7_piece_codec": op7_piece_codec,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op11_vector_codes": op11_vector_codes,
        "op12_class_lm": op12_class_lm,
        "op13_prefix_trie": op13_prefix_trie,
    }


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def jaccard_sql(size: int, percent: int, documents: str = "documents") -> str:
    """Components by Jaccard similarity of word n-grams: ``WITH RECURSIVE`` parts that end in jc(doc_id, n_shingles, component_id)."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    return f"""
jw AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM {documents}),
js AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda i: {gram})) END AS s FROM jw
), ju AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM js),
jp AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM ju a JOIN ju b ON a.g = b.g AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY 1, 2
), je AS (SELECT a, b FROM jp WHERE 100 * shared >= {percent} * (na + nb - shared)),
jr(a, b) AS (SELECT a, b FROM je UNION SELECT jr.a, je.b FROM jr JOIN je ON jr.b = je.a),
jc AS (SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) AS component_id FROM js d LEFT JOIN (SELECT a, min(b) AS c FROM jr GROUP BY 1) m ON m.a = d.doc_id)"""


def line_sql(documents: str = "documents") -> str:
    """``WITH`` parts that end in lk(doc_id, n_lines, n_removed, text): texts without the lines that an earlier one matches."""
    return f"""
ll AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS no, unnest(string_split(text, chr(10))) AS line FROM {documents} WHERE text IS NOT NULL AND doc_id IS NOT NULL
), lw AS (
  SELECT *, regexp_extract_all(lower(line), '[^\\x20\\x09-\\x0D]+') AS w FROM ll
), ls AS (
  SELECT doc_id, no, list_distinct(w) AS s FROM lw WHERE len(w) > 0
), lu AS (SELECT doc_id, no, len(s) AS n, unnest(s) AS g FROM ls),
lp AS (
  SELECT b.doc_id, b.no, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb, a.doc_id AS da, a.no AS la
  FROM lu a JOIN lu b ON a.g = b.g AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.no < b.no)
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY b.doc_id, b.no, a.doc_id, a.no
), lg AS (SELECT DISTINCT doc_id, no FROM lp WHERE 100 * shared >= 80 * (na + nb - shared)),
lt AS (
  SELECT ll.doc_id, string_agg(line, chr(10) ORDER BY no) AS text, count(*) AS n FROM ll
  WHERE NOT EXISTS (SELECT 1 FROM lg WHERE lg.doc_id = ll.doc_id AND lg.no = ll.no) GROUP BY 1
), lk AS (
  SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
    (coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(t.n, 0))::BIGINT AS n_removed,
    CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text FROM {documents} d LEFT JOIN lt t ON t.doc_id = d.doc_id
)"""


#: Inner products of all pairs; lists of doubles are exact for such whole numbers.
TOP_K_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, max(list_inner_product(a.x, b.x))::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0 GROUP BY 1, 2
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s
) WHERE rank <= 5
"""

#: All pairs by cosine, then the least reachable vec_id.
NEAR_EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.95
), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, least(d.vec_id, coalesce(m.c, d.vec_id)) AS component_id, d.vec_id <= coalesce(m.c, d.vec_id) AS kept
FROM embeddings d LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY 1) l ON l.a = d.vec_id
LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON m.a = d.vec_id
"""


#: The base patterns as they stand, with their conditions on each match.
PII_BASE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (
  SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS emails,
    regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
    list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS cards,
    list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phones FROM t
)
SELECT doc_id, len(emails)::BIGINT AS n_email,
  len(list_filter(ips, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR right(p, 3)::INTEGER > 255)) = 0))::BIGINT AS n_ip,
  len(list_filter(cards, lambda x: length(x) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(x)), lambda i:
    CASE WHEN i % 2 = 0 THEN substr(x, length(x) - i, 1)::INTEGER ELSE 2 * substr(x, length(x) - i, 1)::INTEGER // 10 + 2 * substr(x, length(x) - i, 1)::INTEGER % 10 END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(phones, lambda x: length(x) BETWEEN 10 AND 15))::BIGINT AS n_phone
FROM m
"""

#: Words and the places where the base phrases' words stand one after the other.
LICENSE_BASE_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents), p AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' AND w[i + 1] = 'by') AS c,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS g,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved') AS r FROM t
)
SELECT doc_id, n_words, (len(c) + len(g) + len(r))::BIGINT AS n_base, coalesce(list_min(list_concat(c, g, r)) - 1, -1)::BIGINT AS first_word, coalesce(list_max(list_concat(c, g, r)) - 1, -1)::BIGINT AS last_word,
  concat_ws(',', CASE WHEN len(c) > 0 THEN 'cc-by' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(r) > 0 THEN 'reserved' END) AS base_labels
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {
        "pii_base_counts": PII_BASE_SQL,
        "license_base_places": LICENSE_BASE_SQL,
        "op1_ngram_jaccard_join": f"WITH RECURSIVE {jaccard_sql(3, 90)} SELECT * FROM jc",
        "op2_url_filters": url_filters.SQL,
        "op3_block_top_k": TOP_K_SQL,
        "op5_line_dedup": f"WITH {line_sql()} SELECT doc_id, n_lines, n_removed, sha256(coalesce(text, '')) AS text_sha256 FROM lk",
        "op9_near_embeddings": NEAR_EMBEDDINGS_SQL,
        "op11_vector_codes": vector_codes.code_sql(),
        "op13_prefix_trie": prefix_trie.SQL,
    }
