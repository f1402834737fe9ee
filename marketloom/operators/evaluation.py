"""Scores of answers against expected ones, judge replies, comparison of prompt variants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.text import bind, normalize_text, similarity, strip, token_overlap

# Weights, criteria with their labels, threshold and texts of the prompts.
EXACT_WEIGHT, OVERLAP_WEIGHT, SIMILARITY_WEIGHT = 0.5, 0.3, 0.2
CRITERIA = {
    "relevancia": "Relevância",
    "fidelidade_tecnica": "Fidelidade Técnica",
    "adequacao_investimento": "Adequação para Decisão de Investimento",
    "clareza_e_fundamentacao": "Clareza e Fundamentação",
}
PASS_THRESHOLD = 3.0
QUESTION = "PERGUNTA DO USUÁRIO:\n"
ANSWER = "\nRESPOSTA DO ASSISTENTE A AVALIAR:\n"
CONTEXTS = "\nCONTEXTOS FORNECIDOS AO ASSISTENTE:\n"
EXPECTED = "\nRESPOSTA ESPERADA (gabarito):\n"
AVAILABLE = "Contextos disponíveis sobre "
ASK = "Pergunta: "


@dataclass(frozen=True)
class PromptVariant:
    id: str
    name: str
    temperature: float


# The variants that are compared.
VARIANTS = [
    PromptVariant("A", "Assessor Conservador", 0.2),
    PromptVariant("B", "Analista Técnico", 0.1),
    PromptVariant("C", "Educador Financeiro", 0.3),
]


def score_answers(
    df: DataFrame, expected: str = "expected_answer", actual: str = "answer",
    likeness: Column | None = None,
) -> DataFrame:
    """Add exact_match, token_overlap, similarity and score, each rounded to three digits.

    ``likeness`` is the similarity of the two texts, from 0 to 1; by default the matching ratio of
    their normal forms. ``edit_similarity`` needs no Python.
    """
    e, a = F.col(expected), F.col(actual)
    likeness = similarity(e, a) if likeness is None else likeness
    parts = df.withColumns(
        {
            "exact_match": normalize_text(e) == normalize_text(a),
            "_overlap": token_overlap(e, a),
            "_similarity": likeness,
        }
    )
    total = (
        F.when(F.col("exact_match"), EXACT_WEIGHT).otherwise(0.0)
        + F.col("_overlap") * OVERLAP_WEIGHT
        + F.col("_similarity") * SIMILARITY_WEIGHT
    )
    return parts.withColumns(
        {
            "token_overlap": F.bround("_overlap", 3),
            "similarity": F.bround("_similarity", 3),
            "score": F.bround(total, 3),
        }
    ).drop("_overlap", "_similarity")


def golden_eval(
    entries: DataFrame, responses: DataFrame, likeness: Column | None = None
) -> DataFrame:
    """Scores of the responses (id, answer) to the entries of a golden set with the same id.

    All columns of the entries stay. Entries without a response and responses to unknown ids give no
    row. ``likeness`` as in ``score_answers``.
    """
    joined = entries.join(responses.select("id", "answer"), "id")
    return score_answers(joined, likeness=likeness)


def golden_summary(entries: DataFrame, scored: DataFrame) -> DataFrame:
    """Size of the set, evaluated entries, exact matches and the mean of the rounded scores."""
    size = entries.agg(F.count(F.lit(1)).alias("n")).scalar()
    return scored.agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.count_if("exact_match").alias("exact_matches"),
        F.coalesce(F.bround(F.avg("score"), 3), F.lit(0.0)).alias("average_score"),
    ).select(size.alias("golden_set_size"), "evaluated", "exact_matches", "average_score")


def _bullets(contexts: Column) -> Column:
    return F.array_join(F.transform(contexts, lambda c: F.concat(F.lit("- "), c)), "\n")


def judge_prompt(query: Column, answer: Column, contexts: Column, expected: Column) -> Column:
    """Message to the judge; contexts and expected answer are left out when empty."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit(QUESTION), query),
        F.concat(F.lit(ANSWER), answer),
        F.when(F.size(contexts) > 0, F.concat(F.lit(CONTEXTS), _bullets(contexts))),
        F.when(F.length(expected) > 0, F.concat(F.lit(EXPECTED), expected)),
    )


def answer_prompt(ticker: Column, contexts: Column, query: Column) -> Column:
    return F.concat(
        F.lit(AVAILABLE), ticker, F.lit(":\n"), _bullets(contexts), F.lit("\n\n" + ASK), query
    )


def variant_grid(entries: DataFrame, variants: list[PromptVariant] = VARIANTS) -> DataFrame:
    """Every entry once per prompt variant; the list of variants is a constant of the plan."""
    items = [
        F.struct(
            F.lit(v.id).alias("variant_id"), F.lit(v.name).alias("variant_name"),
            F.lit(v.temperature).alias("temperature"),
        )
        for v in variants
    ]
    return entries.select("*", F.inline(F.array(*items)))


def first_entries(entries: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The first ``n`` entries of a golden set in the stated order."""
    return entries.orderBy(order).limit(n)


def tolerant_json(text: Column) -> Column:
    """The JSON value of a reply: the whole text, else from its first ``{`` to its last ``}``."""
    trimmed = strip(text)
    inner = F.regexp_extract(trimmed, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(trimmed), F.try_parse_json(F.nullif(inner, F.lit(""))))


def judge_parse(df: DataFrame, reply: str = "raw_reply") -> DataFrame:
    """Add ``criteria`` (name, label, score, justification), ``overall_score``, ``verdict``, ``error``.

    Code fences are stripped. Scores may be strings; a missing one counts as 0; all are clamped to
    1..5. Criteria that are absent are skipped. A reply that is no JSON object, has no criterion, or
    has a score that is no number, gets the verdict ERROR.
    """
    judged = df.withColumn("_j", bind(_cleaned(F.col(reply)), _judge_text))
    error, mean = F.col("_j.error"), F.col("_j.mean")
    ok = error.isNull()
    return judged.withColumns(
        {
            "criteria": F.when(ok, F.col("_j.criteria")),
            "error": error,
            "overall_score": F.when(ok, F.bround(mean, 3)).otherwise(F.lit(0.0)),
            "verdict": F.when(~ok, "ERROR").when(mean >= PASS_THRESHOLD, "PASS").otherwise("FAIL"),
        }
    ).drop("_j")


def _cleaned(reply: Column) -> Column:
    fences = F.regexp_replace(reply, r"```(?:json)?\s*", "")
    return strip(F.regexp_replace(strip(fences), "`+$", ""))


def _judge_text(text: Column) -> Column:
    parsed = F.when(text.rlike(r"(?s)^\{.*\}$"), F.from_json(text, "map<string,string>"))
    return bind(parsed, lambda entries: bind(_criteria(entries), lambda c: _outcome(entries, c)))


def _criteria(entries: Column) -> Column:
    """The criteria that a reply has, in their fixed order; a bad score is null."""
    names = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(label).alias("label"))
            for name, label in CRITERIA.items()
        ]
    )
    found = F.transform(
        names, lambda c: F.struct(c.alias("c"), F.try_element_at(entries, c["name"]).alias("entry"))
    )

    def read(f: Column) -> Column:
        number = F.get_json_object(f["entry"], "$.score").try_cast("double")
        given = F.coalesce(F.array_contains(F.json_object_keys(f["entry"]), "score"), F.lit(True))
        score = F.when(given, F.greatest(F.lit(1.0), F.least(F.lit(5.0), number))).otherwise(1.0)
        note = F.coalesce(F.get_json_object(f["entry"], "$.justification"), F.lit(""))
        return F.struct(
            f["c"]["name"].alias("name"),
            f["c"]["label"].alias("label"),
            F.when(~given | number.isNotNull(), score).alias("score"),
            note.alias("justification"),
        )

    return F.transform(F.filter(found, lambda f: f["entry"].isNotNull()), read)


def _outcome(entries: Column, criteria: Column) -> Column:
    error = (
        F.when(entries.isNull(), "invalid JSON")
        .when(F.size(criteria) == 0, "no valid criteria")
        .when(F.exists(criteria, lambda c: c["score"].isNull()), "score is not a number")
    )
    total = F.aggregate(criteria, F.lit(0.0), lambda acc, c: acc + c["score"])
    mean = F.try_divide(total, F.size(criteria))
    return F.struct(criteria.alias("criteria"), error.alias("error"), mean.alias("mean"))


def _summary_columns() -> list[Column]:
    ok = F.col("error").isNull()
    valid = F.count_if(ok)
    return [
        F.count(F.lit(1)).alias("total_evaluated"),
        valid.alias("valid"),
        F.count_if(~ok).alias("errors"),
        F.bround(F.avg(F.when(ok, F.col("overall_score"))), 3).alias("overall_average_score"),
        F.bround(F.try_divide(F.count_if(F.col("verdict") == "PASS"), valid), 3).alias("pass_rate"),
    ]


def judge_summary(judged: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Counts, mean score and pass rate, for all rows or per group; nulls when no row is valid."""
    return judged.groupBy(*(group or [])).agg(*_summary_columns())


def _score_of(name: str) -> Column:
    """Score of one criterion, null when the reply does not have it."""
    of_name = F.filter("criteria", lambda c: c["name"] == name)
    return F.try_element_at(of_name, F.lit(1))["score"]


def criterion_averages(judged: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Mean score per criterion label, 0.0 for a criterion that no valid reply gave."""
    keys = group or []
    scores = judged.filter("error IS NULL").select(*keys, *[_score_of(n).alias(n) for n in CRITERIA])
    means = scores.groupBy(*keys).agg(
        *[F.coalesce(F.bround(F.avg(n), 3), F.lit(0.0)).alias(n) for n in CRITERIA]
    )
    rows = [
        F.struct(F.lit(label).alias("criterion"), F.col(name).alias("average"))
        for name, label in CRITERIA.items()
    ]
    return means.select(*keys, F.inline(F.array(*rows)))


def ab_criteria_pivot(judged: DataFrame, variants: list[PromptVariant] = VARIANTS) -> DataFrame:
    """Criterion by variant, missing = 0.0."""
    means = criterion_averages(judged, ["variant_id"])
    table = means.groupBy("criterion").pivot("variant_id", [v.id for v in variants]).agg(F.max("average"))
    return table.na.fill(0.0)


def ab_rank(summary: DataFrame) -> DataFrame:
    """Variants by mean score, best first, with a flag for the top three; one row per variant."""
    order = Window.orderBy(F.coalesce("overall_average_score", F.lit(0.0)).desc(), "variant_id")
    ranked = summary.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.withColumn("medal", F.col("rank") <= 3)


def eval_sanity(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and number of missing values (null or NaN) per metric of an evaluation result."""
    missing = {m: F.col(m).isNull() | F.isnan(m) for m in metrics}
    sums = results.agg(
        *[F.count_if(missing[m]).alias(f"_n_{m}") for m in metrics],
        *[F.avg(F.when(~missing[m], F.col(m))).alias(f"_m_{m}") for m in metrics],
    )
    rows = [
        F.struct(
            F.lit(m).alias("metric"), F.col(f"_m_{m}").alias("mean"),
            F.col(f"_n_{m}").alias("missing"),
        )
        for m in metrics
    ]
    return sums.select(F.inline(F.array(*rows)))
