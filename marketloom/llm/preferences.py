"""Preference formatting: one shared prompt, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.arrays import running_sums
from marketloom.llm.common import let, whole
from marketloom.operators.ordering import running_totals

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def conversations(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (role, text).

    Null roles and texts are empty, equal rows count once, rows of one turn number are ordered by
    role and text, a null number comes first. Rows without an id form no conversation.
    """
    rows = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), whole(role).alias("role"), whole(text).alias("text")).alias("t"),
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return ordered.select("conv_id", plain.alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that two conversations share."""
    first_other = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(first_other == 0, F.size(a)).otherwise(first_other - 1).cast("int")


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"))


def _rendered(turn: Column) -> Column:
    return F.concat(_header(turn), turn["text"], F.lit(CLOSE + "\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def trained_spans(turns: Column) -> Column:
    """(start, end) in characters of the rendered turns that a model is trained on: what an
    assistant says, with the mark that closes the turn."""

    def spans(ends: Column) -> Column:
        every = F.transform(
            turns,
            lambda t, i: F.struct(
                (ends[i] - F.length(_rendered(t)) + F.length(_header(t))).alias("start"),
                (ends[i] - 1).alias("end"), (t["role"] == TRAINED).alias("trained"),
            ),
        )
        kept = F.filter(every, lambda s: s["trained"])
        return F.transform(kept, lambda s: F.struct(s["start"], s["end"]))

    lengths = F.transform(turns, lambda t: F.length(_rendered(t)).cast("long"))
    return let(running_sums(lengths), spans)


def preference_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Add n_common, prompt, two completions and their trained spans to rows of two turn arrays.

    The longest common prefix of turns is rendered once as ``prompt``; what follows in each
    conversation is its completion, masked by (start, end) spans of the text to train on. Without a
    common turn the prompt is empty. If one conversation is the beginning of the other, its
    completion is empty; equal conversations have two empty completions. A null conversation counts
    as one without turns. The two turn arrays are dropped; other columns stay, but for those that
    have the name of an added one, which is replaced. An empty table gives no rows.
    """
    none = F.array().cast(pairs.schema[chosen].dataType)
    others = [c for c in pairs.columns if c not in (chosen, rejected)]
    both = pairs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("_others") if others
        else F.lit(None).alias("_others"),
        F.coalesce(chosen, none).alias("_a"), F.coalesce(rejected, none).alias("_b"),
    )
    cut = both.withColumn("_n", common_turns(F.col("_a"), F.col("_b")))

    def tail(side: str) -> Column:
        return F.slice(side, F.col("_n") + 1, F.size(side))

    parts = cut.select(
        "_others", "_n", render(F.slice("_a", F.lit(1), F.col("_n"))).alias("_prompt"),
        tail("_a").alias("_a"), tail("_b").alias("_b"),
    )
    made = {
        "n_common": F.col("_n"), "prompt": F.col("_prompt"),
        "chosen": render(F.col("_a")), "rejected": render(F.col("_b")),
        "chosen_spans": trained_spans(F.col("_a")), "rejected_spans": trained_spans(F.col("_b")),
    }
    # Two steps, since a name inside of a lambda may mean an alias of the same step, as of a column _a.
    built = parts.select("_others", F.struct(*[v.alias(n) for n, v in made.items()]).alias("_made"))
    return built.select(
        *[F.col(f"_others.`{c}`").alias(c) for c in others if c not in made],
        *[F.col(f"_made.{name}").alias(name) for name in made],
    )


def pairs_of_table(turns: DataFrame) -> DataFrame:
    """Pairs for a table without judgements: (conv_id, rejected_id, chosen, rejected).

    A conversation with a reply is preferred to itself with the last reply replaced by the reply
    before it (an empty one if there is none); ``rejected_id`` is null there. Conversations with the
    same first turn are also paired, each with the next one by id, however far away that is. Ids are
    range-partitioned by (first turn, id), so a first turn of very many conversations is spread over
    the partitions; turns are joined to the paired ids afterwards.
    """
    convs = conversations(turns)
    is_reply = F.transform("turns", lambda t: t["role"] == TRAINED)
    replies = F.filter(
        F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i)), lambda i: i.isNotNull()
    )
    placed = convs.filter(F.exists(is_reply, lambda x: x)).select("*", replies.alias("at"))
    last = F.element_at("at", -1)
    before = F.when(F.size("at") > 1, F.get("turns", F.get("at", F.size("at") - 2))["text"])
    worse = F.transform(
        "turns",
        lambda t, i: F.struct(
            t["role"].alias("role"),
            F.when(i == last, F.coalesce(before, F.lit(""))).otherwise(t["text"]).alias("text"),
        ),
    )
    own = placed.select(
        "conv_id", F.lit(None).cast("long").alias("rejected_id"), F.col("turns").alias("chosen"),
        worse.alias("rejected"),
    )
    first = F.col("turns")[0]
    by_prompt = convs.select(
        F.sha2(F.concat_ws(":", F.length(first["role"]).cast("string"), first["role"], first["text"]), 256)
        .alias("prompt"),
        "conv_id", F.lit(1).alias("n"),
    )
    following = running_totals(by_prompt, ["prompt"], "conv_id", ["n"]).filter(
        F.col("next_value").isNotNull()
    ).select("conv_id", F.col("next_value").alias("rejected_id"))
    neighbours = (
        following.join(convs.withColumnRenamed("turns", "chosen"), "conv_id")
        .join(convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected")),
              "rejected_id")
        .select("conv_id", "rejected_id", "chosen", "rejected")
    )
    return own.unionByName(neighbours)


def preference_digest(turns: DataFrame) -> DataFrame:
    """Formatted pairs of a table of turns, with spans as text."""
    formatted = preference_pairs(pairs_of_table(turns))

    def text_of(spans: str) -> Column:
        return F.array_join(
            F.transform(
                spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))
            ),
            ",",
        )

    return formatted.select(
        "conv_id", "rejected_id", F.col("n_common").cast("long").alias("n_common"), "prompt",
        "chosen", "rejected", text_of("chosen_spans").alias("chosen_spans"),
        text_of("rejected_spans").alias("rejected_spans"),
    )
