"""Pairs of conversations with one first turn, against direct computation."""

import pytest

from marketloom.llm.preferences import pairs_of_table, preference_digest, preference_pairs

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def turns_of(spark, prompts):
    rows = []
    for i, prompt in prompts:
        rows += [(i, 0, "user", prompt), (i, 1, "assistant", f"reply {i}")]
    return spark.createDataFrame(rows, SCHEMA)


def neighbours(prompts):
    groups = {}
    for i, prompt in sorted(prompts):
        groups.setdefault(prompt, []).append(i)
    return sorted(p for ids in groups.values() for p in zip(ids, ids[1:]))


@pytest.mark.parametrize("prompts", [
    [(5, "a"), (1500, "a"), (9000, "a"), (6, "b"), (-3, "b"), (7, "c")],
    [(999, "a"), (1000, "a"), (2_000_000_007, "a")],
    [(i * i, "hot" if i % 3 else f"p{i % 7}") for i in range(300)],
])
def test_pairs_at_any_distance_of_ids(spark, prompts):
    pairs = pairs_of_table(turns_of(spark, prompts)).filter("rejected_id is not null").collect()
    assert sorted((r.conv_id, r.rejected_id) for r in pairs) == neighbours(prompts)
    for r in pairs:
        assert r.chosen[1].text == f"reply {r.conv_id}" and r.rejected[1].text == f"reply {r.rejected_id}"


def test_digest_of_distant_pairs(spark):
    rows = preference_digest(turns_of(spark, [(5, "a"), (1500, "a"), (9000, "a")])).collect()
    got = {(r.conv_id, r.rejected_id): r.n_common for r in rows}
    assert got == {(5, None): 1, (1500, None): 1, (9000, None): 1, (5, 1500): 1, (1500, 9000): 1}


def test_clashing_columns(spark):
    turn = "array<struct<role: string, text: string>>"
    rows = [(1, "p", "n", "s", "_x", [("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b")])]
    schema = f"id int, prompt string, n_common string, chosen_spans string, _a string, chosen {turn}, rejected {turn}"
    got = preference_pairs(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 1 and (got[0].id, got[0]["_a"], got[0].n_common) == (1, "_x", 1)
    assert "q" in got[0].prompt and got[0].chosen_spans != "s"
