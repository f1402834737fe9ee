"""Guardrails on requests and answers, privacy rules for logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.pii import STRICT_THRESHOLD, detect, has_pii, holds_pii, redact
from marketloom.functions.text import SPACE, word_count, words

# Limits, words and patterns of the guardrails. White space is Unicode-aware.
TOKENS_PER_WORD = 0.75
MAX_INPUT_TOKENS = 1000
MAX_OUTPUT_TOKENS = 2000
MAX_QUERY_LENGTH = 500
MAX_RESPONSE_LENGTH = 2000
INJECTION_PATTERNS = [
    r"ignore\s+(previous|all|above)\s+instructions",
    r"you\s+are\s+now\s+",
    r"system\s*:\s*",
    r"<\s*system\s*>",
    r"reset\s+your\s+instructions",
    r"disregard\s+(all|previous)",
]
INJECTION_WORDS = ["instructions", "now", "system", "disregard"]
TOXIC_KEYWORDS = ["attack", "hack", "exploit", "vulnerability", "inject", "malicious"]
# Days that a class of data is kept; None keeps it for ever.
RETENTION_DAYS = {
    "market_data": None, "access_logs": 90, "models": 730, "aggregated_metrics": None,
    "llm_queries": 7,
}


@dataclass(frozen=True)
class GuardrailConfig:
    enabled: bool = True
    max_input_tokens: int = MAX_INPUT_TOKENS
    max_output_tokens: int = MAX_OUTPUT_TOKENS
    pii_threshold: float = STRICT_THRESHOLD


def token_estimate(text: Column) -> Column:
    return F.floor(word_count(text) * TOKENS_PER_WORD)


def injection_matches(text: Column) -> Column:
    """Numbers (from 0) of the injection patterns that the text contains."""
    lowered = F.lower(text)
    marks = [
        F.when(lowered.rlike(p.replace(r"\s", SPACE)), F.lit(i))
        for i, p in enumerate(INJECTION_PATTERNS)
    ]
    return F.array_compact(F.array(*marks))


def _contains_any(text: Column, parts: list[str]) -> Column:
    found = text.contains(parts[0])
    for part in parts[1:]:
        found = found | text.contains(part)
    return found


def has_injection(text: Column) -> Column:
    """One alternation, tried only on texts with a word that every pattern needs."""
    pattern = "|".join(f"(?:{p})" for p in INJECTION_PATTERNS).replace(r"\s", SPACE)
    lowered = F.lower(text)
    return _contains_any(lowered, INJECTION_WORDS) & lowered.rlike(pattern)


def is_toxic(text: Column) -> Column:
    return _contains_any(F.lower(text), TOXIC_KEYWORDS)


def violation(text: Column, check_pii: bool = True, config: GuardrailConfig = GuardrailConfig()) -> Column:
    """The first broken rule as a struct (type, message), null when the text passes."""
    nothing = F.lit(None).cast("struct<type:string,message:string>")
    if not config.enabled:
        return nothing

    def rule(kind: str, message: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), message.alias("message"))

    tokens = token_estimate(text)
    limit = config.max_input_tokens
    too_long = F.concat(
        F.lit("Input exceeds maximum token limit ("), tokens.cast("string"), F.lit(f" > {limit})")
    )
    chain = (
        F.when(tokens > limit, rule("token_limit_exceeded", too_long))
        .when(has_injection(text), rule(
            "prompt_injection", F.lit("Input contains potential prompt injection patterns")))
        .when(is_toxic(text), rule(
            "toxic_content", F.lit("Input contains potentially harmful content")))
    )
    if check_pii:
        chain = chain.when(holds_pii(text, config.pii_threshold), rule(
            "pii_detected", F.lit("Input contains personally identifiable information")))
    return chain.otherwise(nothing)


def validate_input(
    df: DataFrame, text: str = "text", check_pii: bool = True,
    config: GuardrailConfig = GuardrailConfig(),
) -> DataFrame:
    """Add ``violation_type`` and ``message``."""
    checked = df.withColumn("_v", violation(F.col(text), check_pii, config))
    return checked.select(
        *df.columns, F.col("_v.type").alias("violation_type"), F.col("_v.message").alias("message")
    )


def validate_request(
    df: DataFrame, query: str = "query", context: str = "context",
    config: GuardrailConfig = GuardrailConfig(),
) -> DataFrame:
    """The query's violation (with personal data), else that of a given context (without)."""
    in_context = F.when(
        F.coalesce(F.length(context), F.lit(0)) > 0, violation(F.col(context), False, config)
    )
    checked = df.withColumn("_v", F.coalesce(violation(F.col(query), True, config), in_context))
    return checked.select(
        *df.columns, F.col("_v.type").alias("violation_type"), F.col("_v.message").alias("message")
    )


def sanitize_output(
    df: DataFrame, text: str = "text", check_pii: bool = True,
    config: GuardrailConfig = GuardrailConfig(),
) -> DataFrame:
    """Add ``safe_text``: cut to the token limit with ``...``, then redacted if it holds PII."""
    if not config.enabled:
        return df.withColumn("safe_text", F.col(text))
    keep = int(config.max_output_tokens / TOKENS_PER_WORD)
    short = F.concat(F.array_join(F.slice(words(F.col(text)), 1, keep), " "), F.lit("..."))
    long_ = token_estimate(F.col(text)) > config.max_output_tokens
    cut = df.withColumn("safe_text", F.when(long_, short).otherwise(F.col(text)))
    if not check_pii:
        return cut
    found = cut.withColumn("_f", detect(F.col("safe_text")))
    clean = F.when(
        has_pii(F.col("_f"), config.pii_threshold), redact(F.col("safe_text"), F.col("_f"))
    ).otherwise(F.col("safe_text"))
    return found.withColumn("safe_text", clean).drop("_f")


def pii_findings(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per finding, with all columns but the text."""
    rest = [c for c in df.columns if c != text]
    return df.withColumn("_f", detect(F.col(text))).select(*rest, F.inline("_f"))


def pii_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Findings and texts per type."""
    kinds = df.select(F.transform(detect(F.col(text)), lambda f: f["type"]).alias("_kinds"))
    # counted inside the text first, so that each text counts once per type
    each = kinds.select(
        F.explode(F.array_distinct("_kinds")).alias("type"), "_kinds"
    )
    mine = F.size(F.filter("_kinds", lambda k: k == F.col("type")))
    return each.groupBy("type").agg(
        F.sum(mine).alias("findings"), F.count(F.lit(1)).alias("texts")
    )


def violation_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts per violation type."""
    bad = validate_input(df, text).filter("violation_type IS NOT NULL")
    return bad.groupBy("violation_type").agg(F.count(F.lit(1)).alias("n"))


def hash_ip(address: Column) -> Column:
    """Pseudonym of an address: 16 hexadecimal characters of its SHA-256."""
    return F.substring(F.sha2(address, 256), 1, 16)


def length_caps(
    df: DataFrame, query: str, response: str, max_query: int = MAX_QUERY_LENGTH,
    max_response: int = MAX_RESPONSE_LENGTH,
) -> DataFrame:
    """Add ``query_rejected`` and the response cut to its limit, ``capped_response``."""
    return df.withColumns(
        {
            "query_rejected": F.length(query) > max_query,
            "capped_response": F.left(F.col(response), F.lit(max_response)),
        }
    )


def retention(
    df: DataFrame, as_of: Column, data_class: str = "data_class", ts: str = "ts",
    rules: dict[str, int | None] = RETENTION_DAYS,
) -> DataFrame:
    """Add ``kept``: whether the age of the row is within the limit of its class.

    Classes without a rule or without a limit are kept.
    """
    limited = {k: v for k, v in rules.items() if v is not None}
    days = F.create_map(*[F.lit(x) for pair in limited.items() for x in pair])
    limit = F.try_element_at(days, F.col(data_class))
    oldest = as_of - F.make_dt_interval(days=limit)
    return df.withColumn("kept", limit.isNull() | (F.col(ts) >= oldest))
