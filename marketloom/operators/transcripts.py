"""Agent transcripts: routing of questions, tool calls, final answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.text import strip

# Routing words, ticker pattern, default ticker, markers in a transcript.
LIST_WORDS = ["disponível", "tickers", "lista", "quais ações"]
COMPARE_WORDS = ["comparar", "melhor", "pior desempenho"]
TICKER_PATTERN = r"([A-Z]{4}\d{1,2}\.SA|\^BVSP)"
DEFAULT_TICKER = "ITUB4.SA"
ACTION_PATTERN = r"(?i)Action:\s*(\w+)\(([^\n)]*)\)"
PARAMETER_PATTERN = r"""(\w+)=(?:"([^"\n]*)"|'([^'\n]*)')"""
ANSWER_MARK = "Answer:"
NO_TOOLS = "LLM Agent (no tools used)"
MAX_COMPARED = 5


def query_intent(query: Column) -> Column:
    """list, compare or analyse, by the first group of words that occurs."""
    lowered = F.lower(query)

    def any_of(words: list[str]) -> Column:
        found = lowered.contains(words[0])
        for word in words[1:]:
            found = found | lowered.contains(word)
        return found

    return (
        F.when(any_of(LIST_WORDS), "list").when(any_of(COMPARE_WORDS), "compare").otherwise("analyse")
    )


def extract_ticker(query: Column, given: Column) -> Column:
    """First ticker in the upper-cased query, else the given one, else the default."""
    found = F.regexp_extract(F.upper(query), TICKER_PATTERN, 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.nullif(given, F.lit("")), F.lit(DEFAULT_TICKER))


def compared_tickers(tickers: Column) -> Column:
    """The first five tickers of a list: the size of a comparison."""
    return F.slice(tickers, 1, MAX_COMPARED)


def parse_actions(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``tool`` and ``params`` of the first action of a message; null and empty without one."""
    t = F.col(text)
    arguments = F.regexp_extract(t, ACTION_PATTERN, 2)
    pattern = F.lit(PARAMETER_PATTERN)
    names = F.regexp_extract_all(arguments, pattern, F.lit(1))
    double = F.regexp_extract_all(arguments, pattern, F.lit(2))
    single = F.regexp_extract_all(arguments, pattern, F.lit(3))
    values = F.zip_with(double, single, lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b))
    # a parameter given twice keeps its last value
    entries = F.transform(
        names,
        lambda n, i: F.struct(
            n.alias("k"),
            F.element_at(values, i + 1).alias("v"),
            F.array_contains(F.slice(names, i + 2, F.size(names)), n).alias("again"),
        ),
    )
    last = F.filter(entries, lambda e: ~e["again"])
    params = F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))
    return df.withColumns(
        {"tool": F.nullif(F.regexp_extract(t, ACTION_PATTERN, 1), F.lit("")), "params": params}
    )


def final_answer(text: Column) -> Column:
    """Trimmed text after the last answer mark; null when the agent has not finished."""
    return F.when(text.contains(ANSWER_MARK), strip(F.element_at(F.split(text, ANSWER_MARK), -1)))


def tool_calls(df: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row per call with its source label; ordered by turn they are a conversation's list."""
    calls = parse_actions(df).filter("tool IS NOT NULL")
    ticker = F.coalesce(F.try_element_at("params", F.lit("ticker")), F.lit("N/A"))
    source = F.concat("tool", F.lit("(ticker="), ticker, F.lit(")"))
    return calls.select(conversation, turn, "tool", source.alias("source"))


def conversation_tools(df: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Calls per conversation and the flag that no tool was used; combines on the map side."""
    counts = parse_actions(df).groupBy(conversation).agg(F.count("tool").alias("n_calls"))
    return counts.withColumn("no_tools", F.col("n_calls") == 0)


def tool_usage(df: DataFrame) -> DataFrame:
    """Calls per tool."""
    return parse_actions(df).filter("tool IS NOT NULL").groupBy("tool").agg(
        F.count(F.lit(1)).alias("n_calls")
    )
