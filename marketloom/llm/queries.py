"""The registered queries of this subpackage, each over its whole table, with SQL where possible."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import table
from marketloom.llm.decontaminate import contaminated
from marketloom.llm.lexical_search import lexical_search
from marketloom.llm.licenses import CONTAINMENT, TEMPLATES, license_scan, templates
from marketloom.llm.lines import line_digest
from marketloom.llm.near_duplicates import near_duplicates
from marketloom.llm.packing import pack_documents, piece_digest
from marketloom.llm.pii_spans import pii_digest
from marketloom.llm.preferences import preference_digest
from marketloom.llm.quality import quality_rules
from marketloom.llm.resampling import resample
from marketloom.llm.token_files import read_token_files, write_token_files
from marketloom.llm.urls import PATTERN_RULES, judge_pages, rules
from marketloom.llm.word_bpe import word_digest
from marketloom.plans.registry import Query
from marketloom.session import work_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@_query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(pack_documents(table(spark, sf_dir, "documents"), TOKENIZER))


@_query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(table(spark, sf_dir, "documents"))


SQL["op3_line_dedup"] = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS row_id, string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
lines AS (
  SELECT doc_id, row_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
keyed AS (
  SELECT *, translate(regexp_replace(line, '\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
holders AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, keeper IS NOT NULL AND doc_id <> keeper AS gone
  FROM keyed LEFT JOIN holders USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
         AS kept_sha256
FROM marked GROUP BY row_id, doc_id
"""


@_query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


@_query
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"), rules(spark))


_FITS = " OR ".join(
    f"regexp_matches(host || path, '{pattern}')" for _, _, pattern in PATTERN_RULES
)
SQL["op5_url_filters"] = rf"""
WITH located AS (
  SELECT page_id, row_number() OVER () AS r, CASE WHEN strpos(url, '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
cut AS (
  SELECT page_id, r, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(regexp_extract(rest, '^[^?#]*'),
                length(regexp_extract(rest, '^[^/?#]*')) + 1) AS path
  FROM located),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
ranked AS (
  SELECT page_id, host, path, h || p AS rule, v,
         row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC) AS rn
  FROM cut LEFT JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN {_FITS} THEN 'block' ELSE 'allow' END) AS verdict
FROM ranked WHERE rn = 1
"""


@_query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "token_files")
    write_token_files(table(spark, sf_dir, "documents"), path, TOKENIZER)
    docs = read_token_files(spark, path)
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), templates(spark))


_TEMPLATE_ROWS = ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)
_SPLIT = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL["op9_license_scan"] = rf"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, {_LOWER.format("coalesce(text, '')")} AS t
  FROM documents),
worded AS (SELECT doc_id, r, {_SPLIT.format("t")} AS w FROM docs),
places AS (
  SELECT doc_id, r, len(w) AS n_words,
         list_filter(range(len(w)), lambda i: w[i + 1] = 'cc' AND w[i + 2] = 'by') AS a,
         list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public'
                                         AND w[i + 3] = 'license') AS b,
         list_filter(range(len(w)), lambda i: w[i + 1] = 'all' AND w[i + 2] = 'rights'
                                         AND w[i + 3] = 'reserved') AS c
  FROM worded),
base AS (
  SELECT doc_id, r, n_words, a || b || c AS every,
         list_filter([CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END,
                      CASE WHEN len(c) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL) AS found
  FROM places),
asked AS (
  SELECT row_number() OVER () AS template, label, len(ws) AS n, len(list_distinct(ws)) AS size, ws
  FROM (SELECT label, {_SPLIT.format("text")} AS ws FROM (VALUES {_TEMPLATE_ROWS}) v(label, text))),
running AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM worded),
laid AS (
  SELECT r, template, label, size, running.word, unnest([pos // n, pos // n - 1]) AS k
  FROM running JOIN (SELECT *, unnest(list_distinct(ws)) AS word FROM asked) a
    ON running.word = a.word),
matched AS (
  SELECT r, list(DISTINCT label) AS more, max(overlap / size) AS best
  FROM (SELECT r, template, label, size, count(DISTINCT word) AS overlap
        FROM laid WHERE k >= 0 GROUP BY r, template, label, size, k)
  WHERE overlap >= ceil(size * {CONTAINMENT} - 1e-9) GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, len(every)::BIGINT AS n_base,
       list_min(every)::BIGINT AS first_word, list_max(every)::BIGINT AS last_word,
       array_to_string(list_sort(found), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(found || coalesce(more, []))), ',') AS labels,
       CASE WHEN len(every) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM base LEFT JOIN matched USING (r)
"""


@_query
def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_digest(table(spark, sf_dir, "conversations"))


def _rendered_sql(turns: str) -> str:
    return (
        f"array_to_string(list_transform({turns}, lambda t: '<|im_start|>' || t.role || chr(10) "
        "|| t.txt || '<|im_end|>' || chr(10)), '')"
    )


def _spans_sql(turns: str) -> str:
    before = _rendered_sql(f"{turns}[1:i - 1]")
    start = f"length({before}) + 13 + length({turns}[i].role)"
    return (
        f"array_to_string(list_transform(list_filter(range(1, len({turns}) + 1), "
        f"lambda i: {turns}[i].role = 'assistant'), lambda i: ({start})::VARCHAR || '-' || "
        f"({start} + length({turns}[i].txt) + 10)::VARCHAR), ',')"
    )


SQL["op10_preferences"] = rf"""
WITH convs AS (
  SELECT conv_id, list({{'role': role, 'txt': txt}} ORDER BY turn NULLS FIRST, role, txt) AS turns
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt
        FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id),
placed AS (
  SELECT *, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS places
  FROM convs),
pairs AS (
  SELECT conv_id, NULL::BIGINT AS rejected_id, turns AS a,
         list_transform(range(1, len(turns) + 1), lambda i: {{
           'role': turns[i].role,
           'txt': CASE WHEN i <> places[-1] THEN turns[i].txt
                       WHEN len(places) > 1 THEN turns[places[-2]].txt ELSE '' END}}) AS b
  FROM placed WHERE len(places) > 0
  UNION ALL
  SELECT * FROM (
    SELECT conv_id, lead(conv_id) OVER w AS rejected_id, turns AS a, lead(turns) OVER w AS b
    FROM convs WINDOW w AS (PARTITION BY turns[1] ORDER BY conv_id))
  WHERE rejected_id IS NOT NULL),
cut AS (
  SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS n
  FROM pairs),
parts AS (
  SELECT conv_id, rejected_id, n, a[1:n] AS p, a[n + 1:] AS a, b[n + 1:] AS b FROM cut)
SELECT conv_id, rejected_id, n AS n_common, {_rendered_sql("p")} AS prompt,
       {_rendered_sql("a")} AS chosen, {_rendered_sql("b")} AS rejected,
       {_spans_sql("a")} AS chosen_spans, {_spans_sql("b")} AS rejected_spans
FROM parts
"""


@_query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op11_lexical_search"] = rf"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, {_SPLIT.format(_LOWER.format("coalesce(text, '')"))} AS w
  FROM documents),
items AS (
  SELECT item_id, row_number() OVER () AS i, {_SPLIT.format(_LOWER.format("coalesce(text, '')"))} AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT i, item_id, term, count(*) AS k FROM (SELECT i, item_id, unnest(w) AS term FROM items) GROUP BY ALL),
size AS (SELECT count(*) AS big_n, sum(len(w))::BIGINT AS big_l FROM docs WHERE len(w) > 0),
uses AS (
  SELECT r, doc_id, term, n, count(*) AS tf
  FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM docs) SEMI JOIN asked USING (term)
  GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM uses, size GROUP BY term, big_n),
parts AS (
  SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)) AS s
  FROM uses, size),
scored AS (
  SELECT i, item_id, r, doc_id, sum(k * weight * s)::BIGINT AS score
  FROM asked JOIN parts USING (term) JOIN weights USING (term) GROUP BY i, item_id, r, doc_id),
ranked AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@_query
def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_digest(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


@_query
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank"
    )


SQL["op13_resampling"] = rf"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, {_SPLIT.format(_LOWER.format("coalesce(text, '')"))} AS w
  FROM documents),
items AS (
  SELECT row_number() OVER () AS r, {_SPLIT.format(_LOWER.format("coalesce(text, '')"))} AS w
  FROM benchmark),
tab AS (
  SELECT list(list_reduce(list_prepend(b, range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY b) AS t
  FROM range(256) v(b)),
runs AS (
  SELECT 'd' AS side, r, unnest(w) AS f FROM docs
  UNION ALL SELECT 'd', r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM docs
  UNION ALL SELECT 't', r, unnest(w) FROM items
  UNION ALL SELECT 't', r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM items),
coded AS (
  SELECT f, list_transform(range(octet_length(encode(f))),
                           lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT) AS b
  FROM (SELECT DISTINCT f FROM runs)),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, b),
                            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM coded, tab),
found AS (SELECT side, r, bucket, count(*) AS n FROM runs JOIN hashed USING (f) GROUP BY ALL),
totals AS (
  SELECT coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::DOUBLE AS big_s,
         coalesce(sum(n) FILTER (WHERE side = 't'), 0)::DOUBLE AS big_t FROM found),
counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s,
         coalesce(sum(n) FILTER (WHERE side = 't'), 0)::DOUBLE AS t FROM found GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (big_s + 10000) / ((s + 1) * (big_t + 10000))))::BIGINT AS gain
  FROM counts, totals),
summed AS (
  SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS g
  FROM found JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
weighted AS (
  SELECT doc_id, r, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
         CASE WHEN n_features IS NULL THEN 0
              ELSE (g - (((g % n_features) + n_features) % n_features)) // n_features END::BIGINT AS weight,
         ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM docs LEFT JOIN summed USING (r)),
scored AS (
  SELECT doc_id, r, n_words, n_features, weight,
         weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM weighted),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place,
         floor(25 * count(*) OVER () / 100) AS most
  FROM scored WHERE n_words >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score,
       CASE WHEN place <= most THEN place END::BIGINT AS rank
FROM scored s LEFT JOIN ranked USING (r)
"""
