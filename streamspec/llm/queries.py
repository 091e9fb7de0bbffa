"""The queries of the operators, each over its whole table, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamspec.llm import bpe, exact_dedup, html_extract, near_dedup, packing, pii, quality_classifier, quality_rules, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ranks() -> tuple[str, str]:
    """The rank file of the vocabulary and the pattern that splits texts before its merges."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.deduplicate(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.groups(_table(spark, sf_dir, "documents"), k=4, percent=80)
    kept = F.coalesce(F.col("id") == F.col("component.id"), F.lit(False))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component.id").alias("component_id"), kept.alias("kept"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, _table(spark, sf_dir, "labels")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = packing.packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), *_ranks(), digests=True)


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 finds of the kinds that SQL can find as well."""
    return op3_pii(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in pii.BASE_KINDS], "base_sha256")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the default policy adds, from op5's ledger."""
    return quality_rules.ablations(quality_rules.ledger(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_pii": op3_pii,
    "op4_warc": op4_warc,
    "op5_quality_rules": op5_quality_rules,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "pii_base": pii_base,
    "quality_ablations": quality_ablations,
}

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), m AS (
  SELECT doc_id, w, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         length(regexp_replace(t, '[^\p{L}]', '', 'g'))::BIGINT AS n_letters,
         length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g'))::BIGINT AS n_upper
  FROM d
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), r AS (
  SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), range(5) AS q(o)
  WHERE c > 1 GROUP BY doc_id
), x AS (
  SELECT m.* EXCLUDE (w), coalesce(r.n, 0) AS n_repeat_words FROM m LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 16 ELSE 0 END
    + CASE WHEN n_letters >= 20 AND 100 * n_upper > 50 * n_letters THEN 32 ELSE 0 END
    + CASE WHEN word_chars > 0 AND 100 * n_letters < 50 * word_chars THEN 64 ELSE 0 END)::BIGINT AS fail_bits
  FROM x
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 111) = 0 AS kept, fail_bits
FROM b
"""

# Each rule of the default policy: its bit, and the other bits of the policy.
ABLATIONS_SQL = f"""
WITH l AS (SELECT fail_bits & 111 AS bits FROM ({OP5_SQL})),
r(rule, bit) AS (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('duplicate_lines', 8), ('shouting', 32), ('few_letters', 64))
SELECT rule, count(*) FILTER (bits & bit <> 0) AS n_failed, count(*) FILTER (bits & bit <> 0 AND bits & (111 - bit) = 0) AS n_failed_alone,
       count(*) FILTER (bits & (111 - bit) <> 0) AS n_failed_without
FROM l, r GROUP BY rule
"""

# Matches and what lies between them give the places; a match that fails its check is left out.
PII_SQL = r"""
WITH k(kind, n, p) AS (VALUES ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), ('ip', 1, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
  ('card', 2, '[0-9](?:[\x20-]?[0-9])+'), ('phone', 3, '\+[0-9][\x20().0-9-]+[0-9]')),
m AS (SELECT doc_id, kind, n, regexp_extract_all(t, p) AS hits, string_split_regex(t, p) AS gaps FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), k),
s AS (SELECT doc_id, kind, n, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m),
x AS (SELECT doc_id, kind, n, hits[i] AS v, (list_sum(list_transform(gaps[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda y: length(y))), 0))::BIGINT AS a FROM s),
y AS (SELECT *, a + length(v) AS b, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM x),
z AS (
  SELECT * FROM y WHERE CASE kind
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda q: length(ltrim(q, '0')) <= 3 AND coalesce(try_cast(nullif(ltrim(q, '0'), '') AS INT), 0) <= 255))
    WHEN 'phone' THEN length(d) BETWEEN 10 AND 15
    WHEN 'card' THEN length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda j:
      CASE WHEN j % 2 = 1 THEN substr(d, length(d) - j + 1, 1)::INT ELSE 2 * substr(d, length(d) - j + 1, 1)::INT - CASE WHEN substr(d, length(d) - j + 1, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    ELSE true END
)
SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, n), '')) AS base_sha256
FROM documents LEFT JOIN z USING (doc_id) GROUP BY doc_id
"""

# The article of the generated pages, by the markup that they all have.
OP1_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|\z)', 1) AS body, contains(coalesce(html, ''), '</article>') AS whole FROM pages
), b AS (
  SELECT page_id, url, replace(CASE WHEN whole THEN body ELSE regexp_replace(body, '<[^>]*\z', '') END, '<br>', ' ') AS body FROM a
), c AS (
  SELECT page_id, url, list_transform(string_split_regex(body, '</?(p|h1)>'), lambda x:
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts
  FROM b
), d AS (
  SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), ' ') AS text FROM c
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

# Base 32 of a SHA-1: 40 bits at a time as 8 digits of DuckDB's base 32, then in the standard alphabet.
OP4_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT page_id, payload_bytes, translate(array_to_string(list_transform([0, 1, 2, 3], lambda k:
    lpad(to_base(list_sum(list_transform(range(10), lambda i:
      (instr('0123456789abcdef', substr(h, 10 * k + i + 1, 1)) - 1)::BIGINT << (4 * (9 - i))))::BIGINT, 32), 8, '0')), ''),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM p
), m AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM m
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id
), l AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)
), r AS (
  SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, g.component_id, doc_id = g.component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) g LEFT JOIN n USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"pii_base": PII_SQL, "quality_ablations": ABLATIONS_SQL, "op1_html_extract": OP1_SQL, "op6_near_dedup": OP6_SQL, "op2_exact_dedup": OP2_SQL, "op4_warc": OP4_SQL, "op5_quality_rules": OP5_SQL}
