"""The registered queries of this subpackage and their SQL for DuckDB.

Every query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding_dedup, mixing, packing, quality_classifier, quality_rules, simhash, token_counts, url_filter, warc
from .common import spread, table, written


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and divergence verdict of every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    refs = quality_rules.references(docs, table(spark, sf_dir, "labels"))
    return quality_rules.with_quality(docs.drop("lang"), refs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.simhash_components(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


#: Host and path rules of the URL filter.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: What the URLs of the list are made of: sites, subdomains, sections; and every which page number up to how many.
LISTED = (("adult-x.example.net", "cheap-pills.example.com", "spam-farm.example.org"), ("", "m.", "blog."), ("en", "de", "fr", "es"))
LISTED_STEP, LISTED_NUMBERS = 7, 7_200


def listed_pages(spark: SparkSession) -> DataFrame:
    """A list of blocked URLs that is made by a rule and knows nothing of the pages that are judged."""
    sites, subdomains, sections = LISTED
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i % len(names) + 1).cast("int"))
    i = F.col("id")
    a, b, c = len(sites), len(sites) * len(subdomains), len(sites) * len(subdomains) * len(sections)
    url = F.concat(F.lit("http://"), pick(subdomains, F.floor(i / a)), pick(sites, i), F.lit("/"), pick(sections, F.floor(i / b)), F.lit("/"), (F.floor(i / c) * LISTED_STEP).cast("string"), F.lit("/"))
    return spark.range(c * LISTED_NUMBERS).select(url.alias("url"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: rules first, then the list."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = url_filter.listed_urls(listed_pages(spark))
    return url_filter.judge_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return token_counts.count_tokens(docs, token_counts.vocabulary_path("piece_bpe_32k.model"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and probability in the production mixture, and the draw."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    text = F.col("text")
    # texts are read once: what the mixture needs of them is a few bytes a document
    known = written(docs.select("doc_id", "source", "lang", mixing.text_form(text).alias("topic"), mixing.production_tokens()(text).alias("n_tokens"), mixing.text_digest(text).alias("digest")), "documents")
    dims = {c: F.col(c) for c in ("source", "lang", "topic")}
    mixed = mixing.with_mix(known, dims, F.col("n_tokens"), mixing.PRODUCTION, digest=F.col("digest"))
    return mixed.drop("digest")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score by a model of the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.trained_model(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.with_scores(spread(docs), model).select(
        "doc_id", quality_classifier.held_out().alias("held_out"), "score", (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.pack(docs, token_counts.vocabulary_path("word_bpe_49k.json"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the one of control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_conversations(turns.unionByName(chat.control_conversation(spark))))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_url_filter": op4_url_filter,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_packing": op8_packing,
    "op9_chat_format": op9_chat_format,
    "op10_embedding_dedup": op10_embedding_dedup,
}


def _quality_sql() -> str:
    limits = quality_rules.DivergenceLimits()
    between = r'[\x20\x09-\x0D.,;:!?"()]+'
    classes = ", ".join(quality_rules.CLASSES)
    one_class = "list_sum([CASE WHEN p[i] > 0 THEN p[i] * log2(2 * p[i] / (p[i] + q[i])) ELSE 0.0 END + CASE WHEN q[i] > 0 THEN q[i] * log2(2 * q[i] / (p[i] + q[i])) ELSE 0.0 END FOR i IN range(1, 7)])"
    return rf"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{between}'), lambda w: w <> '') AS folded
  FROM documents
), placed AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM base
), windows AS (
  SELECT doc_id, i, w AS a, lead(w, 1) OVER p AS b, lead(w, 2) OVER p AS c FROM placed WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i, CASE WHEN c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 THEN 1 ELSE 0 END AS hit FROM windows
), covered AS (
  SELECT doc_id, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM twice
), repeats AS (
  SELECT doc_id, sum(hit)::BIGINT AS n FROM covered GROUP BY doc_id
), counted AS (
  SELECT base.doc_id, lang, folded, len(words)::BIGINT AS n_words, length(text) AS n, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
         list_sum([0::BIGINT] || [length(w) FOR w IN words])::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS symbol,
         (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
         length(regexp_replace(text, '[^\p{{Ll}}]', '', 'g')) AS lower,
         length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS upper,
         length(regexp_replace(text, '[^\p{{N}}]', '', 'g')) AS digit
  FROM base LEFT JOIN repeats USING (doc_id)
), shares AS (
  SELECT *, n - word_chars AS space, word_chars - lower - upper - digit - symbol AS other,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM counted
), good AS (
  SELECT * FROM shares WHERE lang IS NOT NULL AND n > 0 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
), class_refs AS (
  SELECT lang, [{", ".join(f"sum({c}) / sum(n)" for c in quality_rules.CLASSES)}] AS q FROM good GROUP BY lang
), word_counts AS (
  SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(folded) AS w FROM good) GROUP BY ALL
), vocabulary AS (
  SELECT DISTINCT w FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS rn FROM word_counts) WHERE rn <= {quality_rules.COMMON}
), word_refs AS (
  SELECT l.lang, v.w, coalesce(c.n, 0) / l.n AS q
  FROM (SELECT lang, sum(n) AS n FROM word_counts GROUP BY lang) l CROSS JOIN vocabulary v LEFT JOIN word_counts c ON c.lang = l.lang AND c.w = v.w
), masses AS (
  SELECT lang, sum(q) AS mass, 1 - sum(q) AS rest FROM word_refs GROUP BY lang
), word_limit AS (
  SELECT min({limits.word_share} * sqrt((log2(2 / (1 + rest)) + CASE WHEN rest > 0 THEN rest * log2(2 * rest / (1 + rest)) ELSE 0 END + mass) / 2)) AS most FROM masses
), by_class AS (
  SELECT doc_id, min(sqrt(greatest({one_class} / 2, 0))) AS class_distance
  FROM (SELECT doc_id, q, list_transform([{classes}], lambda c: c / n) AS p FROM shares, class_refs WHERE n > 0) GROUP BY doc_id
), found AS (
  SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(folded) AS w FROM shares) WHERE w IN (SELECT w FROM vocabulary) GROUP BY ALL
), sums AS (
  SELECT doc_id, lang, sum(p * log2(2 * p / (p + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) AS d, sum(q) AS q, sum(p) AS p
  FROM (SELECT f.doc_id, r.lang, f.c / len(s.folded) AS p, r.q FROM found f JOIN shares s USING (doc_id) JOIN word_refs r USING (w)) GROUP BY ALL
), halves AS (
  SELECT s.doc_id, m.lang, coalesce(d, 0) AS d, coalesce(q, 0) AS q, 1 - coalesce(p, 0) AS pr, m.rest
  FROM shares s CROSS JOIN masses m LEFT JOIN sums ON sums.doc_id = s.doc_id AND sums.lang = m.lang WHERE len(s.folded) > 0
), by_words AS (
  SELECT doc_id, min(sqrt(greatest(CASE WHEN pr > 1e-12 THEN d + pr * log2(2 * pr / (pr + rest)) + CASE WHEN rest > 0 THEN rest * log2(2 * rest / (pr + rest)) ELSE 0 END + 1 - q - rest ELSE d + 1 - q END / 2, 0))) AS word_distance
  FROM halves GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars, symbol AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce((n >= {limits.min_chars} AND class_distance > {limits.class_distance})
                                        OR (n_words >= {limits.min_words} AND word_distance > (SELECT most FROM word_limit)), false) AS kept
FROM shares LEFT JOIN by_class USING (doc_id) LEFT JOIN by_words USING (doc_id)
"""


_WARC_SQL = """
WITH seen AS (
  SELECT page_id, coalesce(html, '') AS payload, sha256(coalesce(html, '')) AS digest FROM pages
), firsts AS (
  SELECT *, CASE WHEN strlen(payload) >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM seen
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM firsts
"""

_URL_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
                     lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)')) AS query
  FROM cut
), keyed AS (
  SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
            || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS key
  FROM parts
), listed AS (
  SELECT u || s || '/' || l || '/' || n * 7 AS key
  FROM (SELECT unnest(['adult-x.example.net', 'cheap-pills.example.com', 'spam-farm.example.org']) AS s), (SELECT unnest(['', 'm.', 'blog.']) AS u), (SELECT unnest(['en', 'de', 'fr', 'es']) AS l), range(7200) t(n)
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM keyed
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

_CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, length(replace(role || text, '\', '\\'))
            + len(regexp_extract_all(role, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>'))
            + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>'))
            + length('[INST] ' || ' [/INST] ' || '</s>' || chr(10)) AS n
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(n))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": _quality_sql(),
    "op2_warc": _WARC_SQL,
    "op4_url_filter": _URL_SQL,
    "op9_chat_format": _CHAT_SQL,
}
