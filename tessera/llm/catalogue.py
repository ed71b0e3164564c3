"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decision_list, html_wrappers, image_match, langid, license_scan, mixing, pieces, simhash, substring_dedup, url_filter
from tessera.session import table

#: The public vocabulary that tokenising and language ID use; never copied here.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract_pages(table(spark, sf_dir, "pages"))


def op2_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_match.image_classes(image_match.rendered(table(spark, sf_dir, "embeddings")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup_substrings(docs, cut_text=False).drop("text")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = simhash.near_duplicates(docs, shingle=4, distance=4, similarity=None)
    return found.select(F.col("id").alias("doc_id"), simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = decision_list.learn(docs, table(spark, sf_dir, "labels"))
    return decision_list.judge(docs.select("doc_id", "text"), rules).drop("text")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5's columns of the exact phrases alone, which SQL can express."""
    return op5_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6's statistics and base rules alone, which SQL can express."""
    docs = decision_list.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), [])
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_documents(docs, pieces.PieceModel.load(PIECE_MODEL))


def sentencepiece_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, ids): operator 8's lattices in relations alone, over the distinct units of all documents."""
    return pieces.encode_words(pieces.distinct_units(table(spark, sf_dir, "documents")), pieces.PieceModel.load(PIECE_MODEL))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, langid.fixed_pieces(PIECE_MODEL))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(
        pages,
        url_filter.rules_frame(spark, url_filter.CONTRACT_RULES),
        second=url_filter.rules_frame(spark, url_filter.REPUTATION),
    ).drop("url")


_OP10_RULES = ", ".join(f"('{h}', '{p}', '{v}', 1)" for h, p, v in url_filter.CONTRACT_RULES)
_OP10_SECOND = ", ".join(f"('{h}', '{p}', '{v}', 0)" for h, p, v in url_filter.REPUTATION)
OP10_SQL = f"""
WITH r(h, p, v, rank) AS (VALUES {_OP10_RULES}, {_OP10_SECOND}),
u AS (
  SELECT page_id, url, rowid AS k,
    CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), '{url_filter._UPPER}', '{url_filter._LOWER}') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM (SELECT page_id, url, row_number() OVER () AS rowid FROM pages)
),
m AS (
  SELECT u.k, u.page_id, u.host, u.path, r.h, r.p, r.v, r.rank,
    row_number() OVER (PARTITION BY u.k ORDER BY r.rank DESC NULLS LAST, length(r.h || r.p) DESC, length(r.h) DESC, r.v DESC) AS n
  FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
)
SELECT page_id, host, path, CASE WHEN rank = 1 THEN h || p END AS rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1
"""

OP3_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents
),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS n FROM k) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_phrase = lambda p: "list_filter(range(1, len(ws)), lambda i: " + " AND ".join(f"coalesce(ws[i + {n}] = '{w}', false)" for n, w in enumerate(p.split())) + ")"
_places = [(label, _phrase(p)) for p, label in sorted(license_scan.PHRASES.items(), key=lambda x: x[1])]
LICENSE_BASE_SQL = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter._UPPER}', '{url_filter._LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
),
h AS (SELECT doc_id, ws, {", ".join(f"{x} AS h{n}" for n, (_, x) in enumerate(_places))} FROM w),
a AS (SELECT *, flatten([{", ".join(f"h{n}" for n in range(len(_places)))}]) AS every FROM h)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(every)::BIGINT AS n_base, list_min(every) - 1 AS first_word, list_max(every) - 1 AS last_word,
  concat_ws(',', {", ".join(f"CASE WHEN len(h{n}) > 0 THEN '{label}' END" for n, (label, _) in enumerate(_places))}) AS base_labels
FROM a
"""

QUALITY_BASE_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents
),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS n FROM k) WHERE n > 1),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS j FROM again) GROUP BY doc_id),
l AS (SELECT doc_id, text, ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines FROM w),
s AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM l LEFT JOIN r USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
"""

# A simulation slot by slot, where the operator repeats one period in closed form.
OP7_SQL = f"""
WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (
  SELECT row_number() OVER (ORDER BY source NULLS FIRST) AS i, source, (n + {mixing.BLOCK} - 1) // {mixing.BLOCK} AS b,
    greatest(1, floor({mixing.TOP_WEIGHT} * sqrt(n) / sqrt(max(n) OVER ())))::BIGINT AS w
  FROM c
),
l AS (SELECT list(w ORDER BY i) AS ws, list(b ORDER BY i) AS bs, count(*) AS m FROM w),
s AS (
  SELECT -1::BIGINT AS slot, -1::BIGINT AS phase, 0::BIGINT AS pick, 0::BIGINT AS block, 0::BIGINT AS t,
    list_transform(range(m), lambda x: 0::BIGINT) AS e, list_transform(range(m), lambda x: 0::BIGINT) AS p, ws, bs, m, 0::BIGINT AS next_phase FROM l
  UNION ALL
  SELECT slot + 1, next_phase, pick2, e[pick2], CASE WHEN done THEN 0 ELSE t + 1 END, e2, CASE WHEN done THEN e2 ELSE p END, ws, bs, m, CASE WHEN done THEN next_phase + 1 ELSE next_phase END
  FROM (
    SELECT *, list_transform(e, lambda x, i: CASE WHEN i = pick2 THEN x + 1 ELSE x END) AS e2, e[pick2] + 1 = bs[pick2] AS done
    FROM (
      SELECT *, list_sort(list_filter(list_transform(range(1, m + 1), lambda i: CASE WHEN e[i] < bs[i] AND (e[i] - p[i]) * q // ws[i] <= t
        THEN {{'d': ((e[i] - p[i] + 1) * q + ws[i] - 1) // ws[i], 'w': -ws[i], 'i': i}} END), lambda x: x IS NOT NULL))[1].i AS pick2
      FROM (SELECT *, list_sum(list_transform(range(1, m + 1), lambda i: CASE WHEN e[i] < bs[i] THEN ws[i] ELSE 0 END))::BIGINT AS q FROM s)
      WHERE q > 0
    )
  )
),
d AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('mix' || doc_id::VARCHAR), doc_id) - 1 AS at FROM documents
)
SELECT d.doc_id, d.source, s.block, s.phase, s.slot, s.slot * {mixing.BLOCK} + d.at % {mixing.BLOCK} AS position
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source JOIN s ON s.pick = w.i AND s.block = d.at // {mixing.BLOCK} AND s.slot >= 0
"""


def queries() -> dict[str, Query]:
    return {
        "op1_html_main_text": op1_html_main_text,
        "op2_image_copies": op2_image_copies,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_simhash": op4_simhash,
        "op5_license_scan": op5_license_scan,
        "op6_quality_rules": op6_quality_rules,
        "license_base": license_base,
        "quality_base": quality_base,
        "op7_mix_sources": op7_mix_sources,
        "op8_sentencepiece": op8_sentencepiece,
        "sentencepiece_words": sentencepiece_words,
        "op9_language_id": op9_language_id,
        "op10_url_filter": op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3_SQL, "license_base": LICENSE_BASE_SQL, "quality_base": QUALITY_BASE_SQL, "op7_mix_sources": OP7_SQL, "op10_url_filter": OP10_SQL}
