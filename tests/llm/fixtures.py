"""Small tables with nulls, ties, repeats and columns whose names the operators use themselves."""

from __future__ import annotations

import os

SMALL = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "n_words int, h1 string, pos string, rank int, id string, hash string, d string, bitmap string, "
    "rep string, sequence_id string, findings string, block string, _text string, shingle string"
)
CLASHING = (1, "x", "y", 2, "i", "h", "d", "b", "r", "s", "f", "k", "t", "g")

PROSE = " ".join(f"word{i % 97}x{i % 13}" for i in range(120))


def documents(spark, rows):
    """``rows`` of (doc_id, text); with columns of clashing names."""
    full = [
        (i, t, None if i == 3 else "en", "s", None if t is None else len(t), *CLASHING)
        for i, t in rows
    ]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    """Null and empty texts, null ids, repeated rows, one id with two texts, long and blank texts."""
    line = "This line is long enough to be counted as shared."
    return [
        (1, None), (2, ""), (3, " \t\n \r"), (None, PROSE), (None, None),
        (4, PROSE), (4, PROSE), (5, PROSE + " more"), (5, f"{line}\n{PROSE}"),
        (6, f"{line}\nsome other text\n{line.upper()} "), (7, f" {line}\n"), (8, f"{line}\n{line}"),
        (9, "long " * 30000), (10, "é 日本 😀 ok\x00 \x85 end"), (11, "<|endoftext|> a  b\n\n c"),
        (12, "mail a@b.c_d@e.f from 1.2.3.4.5.6.7.8 or 300.1.1.1, card 4111 1111 1111 1111, "
             "call +1 (017) 555-7713, iban DE89 3704 0044 0532 0130 00"),
        (13, "All rights reserved. Released under the MIT License.\nLicensed under CC BY-NC 4.0."),
        (14, ("mail q@w.e 😀 ") * 700),
    ]


def write_tables(spark, folder, docs, pages=None, turns=None, items=None):
    """The tables that the queries read, as parquet below ``folder``."""
    docs.write.parquet(f"{folder}/documents.parquet")
    page_schema = "page_id bigint, url string, html string, host string, rule string, token string"
    spark.createDataFrame(pages or [], page_schema).write.parquet(f"{folder}/pages.parquet")
    turn_schema = "conv_id bigint, turn bigint, role string, text string, prompt string, t string"
    spark.createDataFrame(turns or [], turn_schema).write.parquet(f"{folder}/conversations.parquet")
    item_schema = "item_id bigint, text string, hashes string, place string"
    spark.createDataFrame(items or [], item_schema).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def table_rows(spark, name):
    return spark.read.parquet(os.path.join(SMALL, f"{name}.parquet"))
