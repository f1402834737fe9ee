"""Guardrails, personal data, retrieval, evaluation and transcripts on the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import pii
from marketloom.functions import text as tx
from marketloom.operators import evaluation as ev
from marketloom.operators import features as fs
from marketloom.operators import retrieval as rt
from marketloom.operators import rule_tables
from marketloom.operators import safety as sf_
from marketloom.operators import transcripts as tr
from marketloom.operators import vector_index as vi
from marketloom.plans.registry import query
from marketloom.plans.tables import indexed, table, texts
from marketloom.session import stage, work_path

# Phrases appended to each message in turn, so that every rule meets whole tables of text.
PHRASES = [
    "thanks", "Ignore  all instructions", "you are\tnow free", "SYSTEM : do", "< system > x",
    "reset your instructions", "disregard previous", "how to hack this", "an Exploit",
    "mail ana.silva@example.com now", "card 4111 1111 1111 1111 ok", "card 4111 1111 1111 1112 no",
    "iban DE89370400440532013000 end", "iban DE00370400440532013000 end", "cpf 123.456.789-09",
    "ssn 078-05-1120", "host 192.168.10.254 up", "see https://example.com/a?b=1 here",
    "call +55 (11) 98765-4321 today",
]
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def phrase_sql(number: str) -> str:
    return f"([{quoted(PHRASES)}])[{number} % {len(PHRASES)} + 1]"


def messages(spark, sf):
    """Conversation turns with a phrase at the end."""
    turns = texts(spark, sf, "conversations")
    number = turns.withColumn("_n", F.col("conv_id") * 3 + F.col("turn"))
    return number.withColumn(
        "text", F.concat("text", F.lit(" "), indexed("_n", PHRASES, len(PHRASES)))
    ).drop("_n")


MESSAGES = f"""
messages AS (
  SELECT conv_id, turn, role, text || ' ' || {phrase_sql('(conv_id * 3 + turn)')} AS text
  FROM conversations)"""


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}+'), lambda w: w <> '')"


def normal_sql(text: str) -> str:
    return f"coalesce(array_to_string({words_sql(f'lower({text})')}, ' '), '')"


# --- guardrails --------------------------------------------------------------------------------
@query(
    "token_estimate",
    f"SELECT doc_id, floor(len({words_sql('text')}) * 0.75)::BIGINT AS tokens FROM documents",
)
def q_tokens(spark, sf):
    return texts(spark, sf, "documents").select(
        "doc_id", sf_.token_estimate(F.col("text")).alias("tokens")
    )


INJECTION = [p.replace(r"\s", WS) for p in sf_.INJECTION_PATTERNS]


@query(
    "prompt_injection",
    f"""WITH {MESSAGES} SELECT conv_id, turn, array_to_string(list_filter([
    {', '.join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{i}' END" for i, p in enumerate(INJECTION))}],
    lambda x: x IS NOT NULL), ',') AS patterns,
    {' OR '.join(f"regexp_matches(lower(text), '{p}')" for p in INJECTION)} AS is_injection FROM messages""",
)
def q_injection(spark, sf):
    numbers = F.transform(sf_.injection_matches(F.col("text")), lambda i: i.cast("string"))
    return messages(spark, sf).select(
        "conv_id", "turn", F.array_join(numbers, ",").alias("patterns"),
        sf_.has_injection(F.col("text")).alias("is_injection"),
    )


@query(
    "toxic_keywords",
    f"""WITH {MESSAGES} SELECT conv_id, turn,
    {' OR '.join(f"contains(lower(text), '{w}')" for w in sf_.TOXIC_KEYWORDS)} AS is_toxic FROM messages""",
)
def q_toxic(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", sf_.is_toxic(F.col("text")).alias("is_toxic"))


def luhn_sql(number: str) -> str:
    digits = f"regexp_replace({number}, '[ -]', '', 'g')"
    return f"""(list_sum(list_transform(range(0, len({digits})), lambda i:
      CASE WHEN i % 2 = 0 THEN {digits}[len({digits}) - i]::INT
           WHEN {digits}[len({digits}) - i]::INT >= 5 THEN {digits}[len({digits}) - i]::INT * 2 - 9
           ELSE {digits}[len({digits}) - i]::INT * 2 END)) % 10 = 0)"""


def iban_sql(code: str) -> str:
    moved = f"(replace({code}, ' ', '')[5:] || replace({code}, ' ', '')[1:4])"
    value = "CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END"
    joined = f"array_to_string(list_transform(string_split({moved}, ''), lambda c: {value}), '')"
    return (
        f"(list_reduce(list_prepend(0, list_transform(string_split({joined}, ''), lambda c: c::INT)),"
        " lambda acc, d: (acc * 10 + d) % 97) = 1)"
    )


def found_sql(r: pii.Recognizer, text: str) -> str:
    found = f"regexp_extract_all({text}, '{r.pattern}')"
    if r.kind == "CREDIT_CARD":
        return f"list_filter({found}, lambda m: {luhn_sql('m')})"
    if r.kind == "IBAN_CODE":
        return f"list_filter({found}, lambda m: {iban_sql('m')})"
    return found


FINDINGS = """
findings AS (""" + " UNION ALL ".join(
    f"SELECT conv_id, turn, '{r.kind}' AS type, {r.score}::DOUBLE AS score, unnest({found_sql(r, 'text')}) AS found"
    f" FROM messages" for r in pii.RECOGNIZERS
) + ")"


@query("pii_detect", f"WITH {MESSAGES}, {FINDINGS} SELECT conv_id, turn, type, score, found FROM findings")
def q_detect(spark, sf):
    out = sf_.pii_findings(messages(spark, sf).drop("role"))
    return out.select("conv_id", "turn", "type", F.col("score").cast("double").alias("score"),
                      F.col("text").alias("found"))


@query(
    "pii_spans",
    f"""WITH {MESSAGES}, {FINDINGS}, one AS (
      SELECT conv_id, turn, min(type) AS type, min(found) AS found FROM findings
      GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT conv_id, turn, type, (position(found IN text) - 1)::BIGINT AS start_at,
      (position(found IN text) - 1 + length(found))::BIGINT AS end_at FROM one JOIN messages USING (conv_id, turn)""",
)
def q_spans(spark, sf):
    """Spans of the texts with one finding, where SQL can tell the position."""
    found = messages(spark, sf).withColumn("_f", pii.detect(F.col("text")))
    one = found.filter(F.size("_f") == 1).select("conv_id", "turn", F.inline("_f"))
    return one.select("conv_id", "turn", "type", F.col("start").cast("long").alias("start_at"),
                      F.col("end").cast("long").alias("end_at"))


@query("pii_spans_all")
def q_spans_all(spark, sf):
    """Spans of all texts, whatever their number of findings."""
    found = messages(spark, sf).withColumn("_f", pii.detect(F.col("text")))
    every = found.select("conv_id", "turn", F.inline("_f"))
    return every.select("conv_id", "turn", "type", F.col("start").cast("long").alias("start_at"),
                        F.col("end").cast("long").alias("end_at"))


DOC_FINDINGS = """
found AS (""" + " UNION ALL ".join(
    f"SELECT doc_id, '{r.kind}' AS type, unnest({found_sql(r, 'text')}) AS m FROM documents"
    for r in pii.RECOGNIZERS
) + ")"


@query(
    "pii_counts",
    f"""WITH {DOC_FINDINGS} SELECT type, count(*)::BIGINT AS findings,
    count(DISTINCT doc_id)::BIGINT AS texts FROM found GROUP BY type""",
)
def q_pii_counts(spark, sf):
    return sf_.pii_counts(texts(spark, sf, "documents").select("text"))


# step by step, because each pattern reads the text that the one before it left
REDACT_STEPS = "".join(
    f", r{i + 1} AS (SELECT doc_id, {redact} AS text FROM r{i})"
    for i, redact in enumerate(
        f"list_reduce(list_prepend(text, {found_sql(r, 'text')}), lambda t, m: replace(t, m, '<{r.kind}>'))"
        if r.kind in ("CREDIT_CARD", "IBAN_CODE")
        else f"regexp_replace(text, '{r.pattern}', '<{r.kind}>', 'g')"
        for r in pii.RECOGNIZERS
    )
)


@query(
    "pii_redact",
    f"""WITH r0 AS (SELECT doc_id, text FROM documents){REDACT_STEPS}
    SELECT doc_id, text AS redacted FROM r{len(pii.RECOGNIZERS)}""",
)
def q_redact(spark, sf):
    docs = texts(spark, sf, "documents").withColumn("_f", pii.detect(F.col("text")))
    return docs.select("doc_id", pii.redact(F.col("text"), F.col("_f")).alias("redacted"))


STRONG = " + ".join(
    f"len({found_sql(r, 'text')})" for r in pii.RECOGNIZERS if r.score >= pii.STRICT_THRESHOLD
)
ANY_INJECTION = " OR ".join(f"regexp_matches(lower(text), '{p}')" for p in INJECTION)
ANY_TOXIC = " OR ".join(f"contains(lower(text), '{w}')" for w in sf_.TOXIC_KEYWORDS)


def violation_sql(with_pii: bool) -> str:
    return f"""CASE WHEN floor(len({words_sql('text')}) * 0.75) > 1000 THEN 'token_limit_exceeded'
      WHEN {ANY_INJECTION} THEN 'prompt_injection' WHEN {ANY_TOXIC} THEN 'toxic_content'
      {f"WHEN {STRONG} > 0 THEN 'pii_detected'" if with_pii else ''} END"""


@query(
    "has_pii",
    f"""WITH {MESSAGES} SELECT conv_id, turn, ({STRONG}) > 0 AS strict,
    ({' + '.join(f"len({found_sql(r, 'text')})" for r in pii.RECOGNIZERS if r.score >= 0.5)}) > 0 AS loose
    FROM messages""",
)
def q_has_pii(spark, sf):
    found = messages(spark, sf).withColumn("_f", pii.detect(F.col("text")))
    return found.select(
        "conv_id", "turn", pii.has_pii(F.col("_f"), pii.STRICT_THRESHOLD).alias("strict"),
        pii.has_pii(F.col("_f")).alias("loose"),
    )


@query(
    "validate_input",
    f"""WITH {MESSAGES}, texts AS (SELECT conv_id, turn, text FROM messages
      UNION ALL SELECT doc_id, -1, text FROM documents),
    v AS (SELECT conv_id, turn, text, {violation_sql(True)} AS violation_type FROM texts)
    SELECT conv_id, turn, violation_type, CASE violation_type
      WHEN 'token_limit_exceeded' THEN 'Input exceeds maximum token limit (' ||
        floor(len({words_sql('text')}) * 0.75)::BIGINT || ' > 1000)'
      WHEN 'prompt_injection' THEN 'Input contains potential prompt injection patterns'
      WHEN 'toxic_content' THEN 'Input contains potentially harmful content'
      WHEN 'pii_detected' THEN 'Input contains personally identifiable information' END AS message FROM v""",
)
def q_validate(spark, sf):
    docs = texts(spark, sf, "documents").select(
        F.col("doc_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), "text"
    )
    both = messages(spark, sf).drop("role").unionByName(docs)
    return sf_.validate_input(both).drop("text")


@query(
    "validate_request",
    f"""WITH {MESSAGES}, q AS (SELECT conv_id, turn, {violation_sql(True)} AS v FROM messages),
    c AS (SELECT doc_id, {violation_sql(False)} AS v FROM documents)
    SELECT conv_id, turn, coalesce(q.v, c.v) AS violation_type FROM q LEFT JOIN c ON doc_id = conv_id""",
)
def q_request(spark, sf):
    docs = texts(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("context"))
    rows = messages(spark, sf).withColumnRenamed("text", "query").join(docs, "conv_id", "left")
    return sf_.validate_request(rows).select("conv_id", "turn", "violation_type")


@query(
    "violation_counts",
    f"""WITH {MESSAGES}, v AS (SELECT {violation_sql(True)} AS violation_type FROM messages)
    SELECT violation_type, count(*)::BIGINT AS n FROM v WHERE violation_type IS NOT NULL GROUP BY 1""",
)
def q_violations(spark, sf):
    return sf_.violation_counts(messages(spark, sf))


@query(
    "sanitize_output",
    f"""WITH cut AS (SELECT doc_id, CASE WHEN floor(len({words_sql('text')}) * 0.75) > 2000
      THEN array_to_string({words_sql('text')}[1:2666], ' ') || '...' ELSE text END AS text FROM documents),
    r0 AS (SELECT doc_id, text FROM cut){REDACT_STEPS}
    SELECT c.doc_id, CASE WHEN ({STRONG.replace('text', 'c.text')}) > 0 THEN r.text ELSE c.text END AS safe_text
    FROM cut c JOIN r{len(pii.RECOGNIZERS)} r USING (doc_id)""",
)
def q_sanitize(spark, sf):
    return sf_.sanitize_output(texts(spark, sf, "documents")).select("doc_id", "safe_text")


@query("hash_ip", "SELECT event_id, sha256('10.0.0.' || user_id)[1:16] AS pseudonym FROM events")
def q_hash(spark, sf):
    address = F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"))
    return table(spark, sf, "events").select("event_id", sf_.hash_ip(address).alias("pseudonym"))


CLASS_NAMES = {"view": "access_logs", "click": "llm_queries", "purchase": "market_data", "signup": "models"}


@query(
    "retention",
    """WITH r AS (SELECT *, CASE event_type WHEN 'view' THEN 'access_logs' WHEN 'click' THEN 'llm_queries'
      WHEN 'purchase' THEN 'market_data' WHEN 'signup' THEN 'models' ELSE event_type END AS data_class,
      CASE event_type WHEN 'view' THEN 90 WHEN 'click' THEN 7 WHEN 'signup' THEN 730 END AS limit_days FROM events)
    SELECT data_class, limit_days IS NULL OR ts >= TIMESTAMP '2024-04-10' - INTERVAL 1 DAY * limit_days AS kept,
      count(*)::BIGINT AS n FROM r GROUP BY 1, 2""",
)
def q_retention(spark, sf):
    names = F.create_map(*[F.lit(x) for pair in CLASS_NAMES.items() for x in pair])
    rows = table(spark, sf, "events").withColumn(
        "data_class", F.coalesce(F.try_element_at(names, "event_type"), "event_type")
    )
    out = sf_.retention(rows, F.lit("2024-04-10").cast("timestamp_ntz"))
    return out.groupBy("data_class", "kept").agg(F.count(F.lit(1)).alias("n"))


@query(
    "length_caps",
    "SELECT conv_id, turn, length(text) > 500 AS query_rejected, left(text, 2000) AS capped_response FROM conversations",
)
def q_caps(spark, sf):
    out = sf_.length_caps(texts(spark, sf, "conversations"), "text", "text")
    return out.select("conv_id", "turn", "query_rejected", "capped_response")


# --- retrieval ---------------------------------------------------------------------------------
def centroids(spark, sf):
    """One query vector per label: the mean of its vectors."""
    vectors = table(spark, sf, "embeddings").select("label", F.posexplode("embedding"))
    means = vectors.groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    listed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("l"))
    return listed.select(
        F.col("label").alias("query_id"), F.transform("l", lambda e: e["m"]).alias("embedding")
    )


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding",
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"),
    )


CENTROIDS = """
flat AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
centre AS (SELECT label AS query_id, i, avg(x) AS m FROM flat GROUP BY 1, 2),
pairs AS (SELECT query_id, vec_id AS id, label, sum((x - m) * (x - m)) AS distance
  FROM flat JOIN centre USING (i) GROUP BY 1, 2, 3)"""


@query(
    "vector_topk",
    f"""WITH {CENTROIDS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs)
    SELECT query_id, id, round(distance, 6) AS distance, rank FROM ranked WHERE rank <= 5""",
)
def q_topk(spark, sf):
    out = rt.vector_topk(vectors(spark, sf), centroids(spark, sf))
    return out.withColumn("distance", F.round("distance", 6))


@query(
    "vector_topk_filtered",
    f"""WITH {CENTROIDS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
      FROM pairs WHERE label = 3)
    SELECT query_id, id, round(distance, 6) AS distance, rank FROM ranked WHERE rank <= 5""",
)
def q_topk_filtered(spark, sf):
    out = rt.vector_topk(vectors(spark, sf), centroids(spark, sf), where={"label": "3"})
    return out.withColumn("distance", F.round("distance", 6))


def index_of(spark, sf):
    """An index of all vectors, and every 20th vector as a query."""
    docs = vectors(spark, sf).select("id", "embedding")
    path = work_path(spark, "vector_index")
    vi.build_index(docs, path)
    return docs, docs.filter(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id"), path


@query("vector_index")
def q_vector_index(spark, sf):
    _, queries, path = index_of(spark, sf)
    return vi.search_index(spark, path, queries)


@query(
    "vector_recall",
    """SELECT count(*) AS n_queries, sum(least(n, 5))::BIGINT AS n_exact, true AS reached
    FROM (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0), (SELECT count(*) AS n FROM embeddings)""",
)
def q_vector_recall(spark, sf):
    """Every 20th vector against all: does the index find at least 0.9 of the exact neighbours?"""
    docs, queries, path = index_of(spark, sf)
    measured = vi.recall_at(rt.vector_topk(docs, queries), vi.search_index(spark, path, queries))
    return measured.select("n_queries", "n_exact", (F.col("recall") >= 0.9).alias("reached"))


@query(
    "rag_context",
    f"""WITH {CENTROIDS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
      FROM pairs WHERE id IN (SELECT doc_id FROM documents)),
    asked AS (SELECT query_id FROM (SELECT DISTINCT label AS query_id FROM embeddings) UNION ALL SELECT -1),
    parts AS (SELECT query_id, string_agg('[Source ' || rank || ']' || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS context
      FROM ranked JOIN documents ON doc_id = id WHERE rank <= 3 GROUP BY 1)
    SELECT asked.query_id, coalesce(context, 'No relevant context found.') AS context FROM asked LEFT JOIN parts USING (query_id)""",
)
def q_context(spark, sf):
    queries = centroids(spark, sf)
    docs = texts(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    known = vectors(spark, sf).join(docs.select("id"), "id", "left_semi")
    hits = rt.vector_topk(known, queries, k=3)
    none = spark.range(1).select(F.lit(-1).alias("query_id"))
    return rt.rag_context(queries.select("query_id").unionByName(none), hits, docs, k=3)


@query(
    "insert_if_absent",
    """SELECT 'doc_' || item_id AS id, text FROM benchmark
    UNION ALL SELECT 'doc_' || doc_id, text FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)""",
)
def q_insert(spark, sf):
    old = table(spark, sf, "benchmark").select(F.col("item_id").alias("position"), "text")
    new = texts(spark, sf, "documents").select(F.col("doc_id").alias("position"), "text")
    return fs.insert_if_absent(
        rt.with_document_ids(old).drop("position"), rt.with_document_ids(new)
    ).select("id", "text")


# --- evaluation --------------------------------------------------------------------------------
def golden(spark, sf):
    """Benchmark items as entries: the item is the expected answer."""
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("id"), F.concat(F.lit("q"), "item_id").alias("query"),
        F.col("text").alias("expected_answer"),
        F.concat(F.lit("T"), (F.col("item_id") % 5).cast("string")).alias("ticker"),
    )


def responses(spark, sf):
    """Answers by document number: the expected text in lower case, a longer text, or the document."""
    docs = texts(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("item"))
    both = docs.join(items, "id", "left")
    answer = (
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("  "), F.lower("item"), F.lit("\n")))
        .when(F.col("id") % 3 == 1, F.concat("item", F.lit(" "), "text"))
        .otherwise(F.col("text"))
    )
    return both.select("id", F.coalesce(answer, F.col("text")).alias("answer"))


ANSWERS = """
responses AS (SELECT doc_id AS id, coalesce(CASE WHEN doc_id % 3 = 0 THEN '  ' || lower(b.text) || chr(10)
    WHEN doc_id % 3 = 1 THEN b.text || ' ' || d.text ELSE d.text END, d.text) AS answer
  FROM documents d LEFT JOIN benchmark b ON item_id = doc_id),
pairs AS (SELECT item_id AS id, text AS expected, answer FROM benchmark JOIN responses ON id = item_id)"""


@query(
    "normalize_text",
    f"SELECT doc_id, {normal_sql('text')} AS normal FROM documents",
)
def q_normal(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("normal"))


OVERLAP = f"""coalesce(len(list_intersect(list_distinct({words_sql('lower(expected)')}),
    {words_sql('lower(answer)')})) / nullif(len(list_distinct({words_sql('lower(expected)')})), 0), 0)"""


@query(
    "token_overlap",
    f"""WITH {ANSWERS} SELECT id, {normal_sql('expected')} = {normal_sql('answer')} AS exact_match,
    round({OVERLAP}, 6) AS overlap FROM pairs""",
)
def q_overlap(spark, sf):
    e, a = F.col("expected_answer"), F.col("answer")
    return golden(spark, sf).join(responses(spark, sf), "id").select(
        "id", (tx.normalize_text(e) == tx.normalize_text(a)).alias("exact_match"),
        F.round(tx.token_overlap(e, a), 6).alias("overlap"),
    )


@query("similarity")
def q_similarity(spark, sf):
    pairs = golden(spark, sf).join(responses(spark, sf), "id")
    ratio = tx.similarity(F.col("expected_answer"), F.col("answer"))
    return pairs.select("id", F.round(ratio, 6).alias("similarity"))


def likeness():
    return tx.edit_similarity(F.col("expected_answer"), F.col("answer"))


GOLDEN_SQL = f"""
WITH {ANSWERS},
plain AS (SELECT *, regexp_replace({normal_sql('expected')}, '[^\\x00-\\x7F]', '?', 'g') AS e,
    regexp_replace({normal_sql('answer')}, '[^\\x00-\\x7F]', '?', 'g') AS a FROM pairs),
parts AS (SELECT id, {normal_sql('expected')} = {normal_sql('answer')} AS exact_match, {OVERLAP} AS o,
    CASE WHEN greatest(length(e), length(a)) = 0 THEN 1.0
         ELSE 1 - levenshtein(e, a) / greatest(length(e), length(a)) END AS s FROM plain),
scored AS (SELECT id, 'q' || id AS query, 'T' || (id % 5) AS ticker, exact_match,
    round_even(o, 3) AS token_overlap, round_even(s, 3) AS similarity,
    round_even(CASE WHEN exact_match THEN 0.5::DOUBLE ELSE 0 END + o * 0.3::DOUBLE + s * 0.2::DOUBLE, 3) AS score
  FROM parts)"""


@query("golden_eval", f"{GOLDEN_SQL} SELECT * FROM scored")
def q_golden(spark, sf):
    """Scores with the edit distance, which SQL can compute as well."""
    return ev.golden_eval(golden(spark, sf), responses(spark, sf), likeness()).select(
        "id", "query", "ticker", "exact_match", "token_overlap", "similarity", "score"
    )


@query("golden_eval_ratio")
def q_golden_ratio(spark, sf):
    """Scores with the matching ratio of the texts."""
    return ev.golden_eval(golden(spark, sf), responses(spark, sf)).select(
        "id", "query", "ticker", "exact_match", "token_overlap", "similarity", "score"
    )


@query(
    "golden_eval_join",
    f"WITH {ANSWERS} SELECT id, expected AS expected_answer, answer FROM pairs",
)
def q_golden_join(spark, sf):
    joined = golden(spark, sf).join(responses(spark, sf), "id")
    return joined.select("id", "expected_answer", "answer")


@query(
    "golden_summary",
    f"""{GOLDEN_SQL} SELECT (SELECT count(*) FROM benchmark)::BIGINT AS golden_set_size,
    count(*)::BIGINT AS evaluated, count_if(exact_match)::BIGINT AS exact_matches,
    round_even(coalesce(avg(score), 0), 3) AS average_score FROM scored""",
)
def q_golden_summary(spark, sf):
    entries = golden(spark, sf)
    return ev.golden_summary(entries, ev.golden_eval(entries, responses(spark, sf), likeness()))


def entries(spark, sf):
    """Documents as entries with up to two contexts and sometimes an expected answer."""
    docs = texts(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("question "), "source").alias("query"),
        F.col("lang").alias("ticker"), F.col("text").alias("answer"),
        F.slice(F.array("lang", "source"), 1, (F.col("doc_id") % 3).cast("int")).alias("contexts"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("expected_answer"),
    )


@query(
    "judge_prompt",
    """SELECT doc_id AS id, 'PERGUNTA DO USUÁRIO:' || chr(10) || 'question ' || source || chr(10) || chr(10) ||
      'RESPOSTA DO ASSISTENTE A AVALIAR:' || chr(10) || text ||
      CASE doc_id % 3 WHEN 0 THEN '' ELSE chr(10) || chr(10) || 'CONTEXTOS FORNECIDOS AO ASSISTENTE:' || chr(10) ||
        '- ' || lang || CASE doc_id % 3 WHEN 2 THEN chr(10) || '- ' || source ELSE '' END END ||
      CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'RESPOSTA ESPERADA (gabarito):' || chr(10) || source ELSE '' END
      AS prompt FROM documents""",
)
def q_judge_prompt(spark, sf):
    rows = entries(spark, sf)
    prompt = ev.judge_prompt(*[F.col(c) for c in ("query", "answer", "contexts", "expected_answer")])
    return rows.select("id", prompt.alias("prompt"))


@query(
    "answer_prompt",
    """SELECT doc_id AS id, v AS variant_id, 'Contextos disponíveis sobre ' || lang || ':' || chr(10) ||
      CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '- ' || lang ELSE '- ' || lang || chr(10) || '- ' || source END
      || chr(10) || chr(10) || 'Pergunta: question ' || source AS prompt
    FROM documents, (VALUES ('A'), ('B'), ('C')) t(v)""",
)
def q_answer_prompt(spark, sf):
    grid = ev.variant_grid(entries(spark, sf))
    prompt = ev.answer_prompt(F.col("ticker"), F.col("contexts"), F.col("query"))
    return grid.select("id", "variant_id", prompt.alias("prompt"))


@query(
    "variant_grid",
    """SELECT item_id AS id, variant_id, temperature FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 5),
    (VALUES ('A', 0.2::DOUBLE), ('B', 0.1), ('C', 0.3)) t(variant_id, temperature)""",
)
def q_grid(spark, sf):
    grid = ev.variant_grid(ev.first_entries(golden(spark, sf), 5))
    return grid.select("id", "variant_id", "temperature")


CRITERIA = list(ev.CRITERIA)


def replies(spark, sf):
    """Stored judge replies by (document, variant): scores from the numbers, some broken."""
    grid = ev.variant_grid(texts(spark, sf, "documents").select("doc_id", "lang"))
    n = F.col("doc_id") + F.ascii("variant_id")
    parts = []
    for i, name in enumerate(CRITERIA):
        number = ((n * (i + 3)) % 13 / 2).cast("string")
        written = F.when(n % 4 == 0, F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number)
        body = F.when(n % 17 == i, F.lit('{"justification": "none"}')).otherwise(
            F.concat(F.lit('{"score": '), written, F.lit(', "justification": "'), "lang", F.lit('"}'))
        )
        part = F.concat(F.lit(f'"{name}": '), body)
        parts.append(F.when(n % 5 == i, F.lit(None)).otherwise(part))
    whole = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    reply = (
        F.when(n % 11 == 0, F.lit("sorry, no JSON"))
        .when(n % 13 == 0, F.lit("{}"))
        .when(n % 19 == 0, F.lit('{"relevancia": {"score": "high"}}'))
        .when(n % 3 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .otherwise(whole)
    )
    return stage(grid.select("doc_id", "variant_id", "variant_name", reply.alias("raw_reply")), "replies")


# The scores that the replies carry, worked out from the numbers and not from the text.
def _score_sql(i: int) -> str:
    return (
        f"CASE WHEN n % 5 = {i} THEN NULL WHEN n % 17 = {i} THEN 1.0::DOUBLE"
        f" ELSE greatest(1.0, least(5.0, (n * {i + 3}) % 13 / 2)) END"
    )


JUDGED = f"""
numbers AS (SELECT doc_id, v AS variant_id, doc_id + ascii(v) AS n FROM documents, (VALUES ('A'), ('B'), ('C')) t(v)),
scores AS (SELECT *, {', '.join(f'{_score_sql(i)} AS {c}' for i, c in enumerate(CRITERIA))},
  n % 11 = 0 OR n % 13 = 0 OR n % 19 = 0 AS broken FROM numbers),
judged AS (SELECT doc_id, variant_id, broken,
    {', '.join(f'CASE WHEN NOT broken THEN {c} END AS {c}' for c in CRITERIA)},
    CASE WHEN NOT broken THEN list_avg([{', '.join(CRITERIA)}]) END AS mean FROM scores),
results AS (SELECT *, CASE WHEN broken THEN 0.0 ELSE round_even(mean, 3) END AS overall_score,
    CASE WHEN broken THEN 'ERROR' WHEN mean >= 3 THEN 'PASS' ELSE 'FAIL' END AS verdict,
    CASE WHEN NOT broken THEN mean END AS valid_mean FROM judged)"""


@query(
    "judge_parse",
    f"""WITH {JUDGED}, long AS (SELECT doc_id, variant_id, verdict, overall_score, name, score FROM results
      UNPIVOT (score FOR name IN ({', '.join(CRITERIA)})))
    SELECT doc_id, variant_id, name, score FROM long""",
)
def q_judge_parse(spark, sf):
    out = ev.judge_parse(replies(spark, sf))
    return out.select("doc_id", "variant_id", F.inline("criteria")).select(
        "doc_id", "variant_id", "name", "score"
    )


@query(
    "judge_verdict",
    f"""WITH {JUDGED} SELECT doc_id, variant_id, verdict, overall_score::DOUBLE AS overall_score,
    broken AS is_error FROM results""",
)
def q_verdict(spark, sf):
    out = ev.judge_parse(replies(spark, sf))
    return out.select(
        "doc_id", "variant_id", "verdict", "overall_score", F.col("error").isNotNull().alias("is_error")
    )


TOTALS = """count(*)::BIGINT AS total_evaluated, count_if(NOT broken)::BIGINT AS valid,
    count_if(broken)::BIGINT AS errors,
    round_even(avg(CASE WHEN NOT broken THEN overall_score END), 3) AS overall_average_score,
    round_even(count_if(verdict = 'PASS') / count_if(NOT broken), 3) AS pass_rate"""


@query("judge_summary", f"WITH {JUDGED} SELECT {TOTALS} FROM results")
def q_judge_summary(spark, sf):
    return ev.judge_summary(ev.judge_parse(replies(spark, sf)))


@query("ab_compare", f"WITH {JUDGED} SELECT variant_id, {TOTALS} FROM results GROUP BY variant_id")
def q_ab(spark, sf):
    return ev.judge_summary(ev.judge_parse(replies(spark, sf)), ["variant_id"])


@query(
    "ab_rank",
    f"""WITH {JUDGED}, s AS (SELECT variant_id, {TOTALS} FROM results GROUP BY variant_id)
    SELECT variant_id, row_number() OVER (ORDER BY overall_average_score DESC, variant_id) AS rank FROM s""",
)
def q_ab_rank(spark, sf):
    summary = ev.judge_summary(ev.judge_parse(replies(spark, sf)), ["variant_id"])
    return ev.ab_rank(summary).select("variant_id", "rank")


@query(
    "ab_criteria_pivot",
    f"""WITH {JUDGED}, long AS (SELECT variant_id, name, score FROM results UNPIVOT (score FOR name IN ({', '.join(CRITERIA)})))
    SELECT CASE name {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ev.CRITERIA.items())} END AS criterion,
      {', '.join(f"coalesce(round_even(avg(CASE WHEN variant_id = '{v}' THEN score END), 3), 0) AS {v}" for v in 'ABC')}
    FROM long GROUP BY name""",
)
def q_pivot(spark, sf):
    return ev.ab_criteria_pivot(ev.judge_parse(replies(spark, sf)))


@query(
    "criterion_averages",
    f"""WITH {JUDGED}, long AS (SELECT name, score FROM results UNPIVOT (score FOR name IN ({', '.join(CRITERIA)})))
    SELECT CASE name {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ev.CRITERIA.items())} END AS criterion,
      round_even(avg(score), 3) AS average FROM long GROUP BY name""",
)
def q_criteria(spark, sf):
    return ev.criterion_averages(ev.judge_parse(replies(spark, sf)))


@query("criterion_names", f"SELECT unnest([{quoted(CRITERIA)}]) AS name")
def q_criterion_names(spark, sf):
    """Criteria that occur in any variant."""
    judged = ev.judge_parse(replies(spark, sf))
    return judged.select(F.inline("criteria")).select("name").distinct()


@query(
    "eval_sanity",
    """WITH l AS (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))
    SELECT 'faithfulness' AS metric, round(avg(quality), 6) AS mean, (count(*) - count(quality))::BIGINT AS missing FROM l
    UNION ALL SELECT 'relevancy', round(avg(CASE WHEN doc_id % 9 <> 0 THEN doc_id % 7 / 7 END), 6),
      count_if(doc_id % 9 = 0)::BIGINT FROM l""",
)
def q_sanity(spark, sf):
    rows = texts(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        F.col("quality").cast("double").alias("faithfulness"),
        F.when(F.col("doc_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("doc_id") % 7 / 7).alias("relevancy"),
    )
    out = ev.eval_sanity(rows, ["faithfulness", "relevancy"])
    return out.withColumn("mean", F.round("mean", 6))


@query(
    "tolerant_json",
    """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k FROM events""",
)
def q_tolerant(spark, sf):
    text = (
        F.when(F.col("event_id") % 3 == 0, F.col("props"))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here: "), "props", F.lit(" done")))
        .otherwise(F.lit("no braces"))
    )
    value = F.try_variant_get(ev.tolerant_json(text), "$.k", "long")
    return table(spark, sf, "events").select("event_id", value.alias("k"))


# --- transcripts -------------------------------------------------------------------------------
ASKS = [
    "Quais ações estão na lista?", "comparar PETR4.SA e VALE3.SA", "qual o melhor?",
    "vale3.sa vai subir?", "e o ^bvsp hoje", "analise", "Tickers disponíveis",
]


def questions(spark, sf):
    events = table(spark, sf, "events")
    return events.select(
        "event_id", F.concat(indexed("event_id", ASKS, len(ASKS)), F.lit(" "), "event_type").alias("q"),
        F.when(F.col("user_id") % 2 == 0, F.concat(F.upper("event_type"), F.lit(".SA"))).alias("given"),
    )


QUESTIONS = f"""
questions AS (SELECT event_id, ([{quoted(ASKS)}])[event_id % {len(ASKS)} + 1] || ' ' || event_type AS q,
  CASE WHEN user_id % 2 = 0 THEN upper(event_type) || '.SA' END AS given FROM events)"""


@query(
    "query_intent",
    f"""WITH {QUESTIONS} SELECT event_id, CASE
      WHEN {' OR '.join(f"contains(lower(q), '{w}')" for w in tr.LIST_WORDS)} THEN 'list'
      WHEN {' OR '.join(f"contains(lower(q), '{w}')" for w in tr.COMPARE_WORDS)} THEN 'compare'
      ELSE 'analyse' END AS intent FROM questions""",
)
def q_intent(spark, sf):
    return questions(spark, sf).select("event_id", tr.query_intent(F.col("q")).alias("intent"))


@query(
    "extract_ticker",
    f"""WITH {QUESTIONS} SELECT event_id, coalesce(nullif(regexp_extract(upper(q), '([A-Z]{{4}}\\d{{1,2}}\\.SA|\\^BVSP)', 1), ''),
      given, 'ITUB4.SA') AS ticker FROM questions""",
)
def q_extract(spark, sf):
    return questions(spark, sf).select(
        "event_id", tr.extract_ticker(F.col("q"), F.col("given")).alias("ticker")
    )


STEPS = [
    ' Action: get_stock_price_history(ticker="PETR4.SA", period=\'1mo\')',
    ' action:  calculate_technical_indicators(ticker="VALE3.SA")',
    " Action: compare_stocks()", " thinking", " Answer: first. Answer:  buy and hold  ",
    ' Action: predict_stock_direction(ticker="A", ticker="B")',
]


def transcripts(spark, sf):
    turns = texts(spark, sf, "conversations").withColumn("_n", F.col("conv_id") + F.col("turn"))
    return turns.withColumn("text", F.concat("text", indexed("_n", STEPS, len(STEPS)))).drop("_n")


TRANSCRIPTS = f"""
transcripts AS (SELECT conv_id, turn, text || ([{quoted(STEPS)}])[(conv_id + turn) % {len(STEPS)} + 1] AS text FROM conversations),
actions AS (SELECT conv_id, turn, text, nullif(regexp_extract(text, '(?i)Action:\\s*(\\w+)\\(', 1), '') AS tool,
  regexp_extract(text, '(?i)Action:\\s*\\w+\\(([^)]*)\\)', 1) AS args FROM transcripts)"""
NAMED = "regexp_extract(args, '.*{}=[\"'']([^\"'']*)[\"'']', 1)"


@query(
    "parse_actions",
    f"""WITH {TRANSCRIPTS} SELECT conv_id, turn, tool, nullif({NAMED.format('ticker')}, '') AS ticker,
    nullif({NAMED.format('period')}, '') AS period,
    len(list_distinct(regexp_extract_all(args, '(\\w+)=', 1)))::BIGINT AS n_params FROM actions""",
)
def q_actions(spark, sf):
    out = tr.parse_actions(transcripts(spark, sf))
    return out.select(
        "conv_id", "turn", "tool", F.try_element_at("params", F.lit("ticker")).alias("ticker"),
        F.try_element_at("params", F.lit("period")).alias("period"),
        F.size("params").cast("long").alias("n_params"),
    )


@query(
    "final_answer",
    f"""WITH {TRANSCRIPTS} SELECT conv_id, turn, CASE WHEN contains(text, 'Answer:')
    THEN trim(string_split(text, 'Answer:')[-1]) END AS answer FROM transcripts""",
)
def q_answer(spark, sf):
    return transcripts(spark, sf).select("conv_id", "turn", tr.final_answer(F.col("text")).alias("answer"))


@query(
    "tool_usage",
    f"WITH {TRANSCRIPTS} SELECT tool, count(*)::BIGINT AS n_calls FROM actions WHERE tool IS NOT NULL GROUP BY 1",
)
def q_tools(spark, sf):
    return tr.tool_usage(transcripts(spark, sf))


@query(
    "tool_calls",
    f"""WITH {TRANSCRIPTS} SELECT conv_id, turn, tool, tool || '(ticker=' || coalesce(nullif({NAMED.format('ticker')}, ''), 'N/A') || ')' AS source
    FROM actions WHERE tool IS NOT NULL""",
)
def q_calls(spark, sf):
    return tr.tool_calls(transcripts(spark, sf))


@query(
    "conversation_tools",
    f"""WITH {TRANSCRIPTS} SELECT conv_id, count(tool)::BIGINT AS n_calls, count(tool) = 0 AS no_tools FROM actions GROUP BY 1""",
)
def q_conversation_tools(spark, sf):
    return tr.conversation_tools(transcripts(spark, sf))


@query(
    "ticker_cap",
    """SELECT conv_id, turn, array_to_string(list_slice(string_split(text, ' '), 1, 5), ' ') AS tickers FROM conversations""",
)
def q_cap(spark, sf):
    return texts(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(tr.compared_tickers(F.split("text", " ")), " ").alias("tickers")
    )


# Parts that every match of the injection patterns contains, in the order of the patterns.
INJECTION_PARTS = ["instructions", "now", "system", "system", "instructions", "disregard"]


@query(
    "rule_table_hits",
    f"""WITH {MESSAGES}, w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark)
    SELECT conv_id, turn, word AS rule_id FROM messages JOIN w ON contains(lower(text), word) WHERE length(word) >= 3
    UNION ALL {" UNION ALL ".join(
        f"SELECT conv_id, turn, 'pattern {i}' FROM messages WHERE regexp_matches(lower(text), '{p}')"
        for i, p in enumerate(INJECTION))}""",
)
def q_rule_table(spark, sf):
    """The words of the benchmark as substring rules, and the injection patterns, as one rule table."""
    words = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w"))
    words = words.filter(F.length("w") >= 3).distinct().select(
        F.col("w").alias("rule_id"), F.col("w").alias("literal"), F.lit(None).cast("string").alias("pattern")
    )
    patterns = spark.createDataFrame(
        [
            (f"pattern {i}", part, p.replace(r"\s", tx.SPACE))
            for i, (part, p) in enumerate(zip(INJECTION_PARTS, sf_.INJECTION_PATTERNS))
        ],
        "rule_id string, literal string, pattern string",
    )
    return rule_tables.rule_hits(messages(spark, sf), words.unionByName(patterns), ["conv_id", "turn"])
