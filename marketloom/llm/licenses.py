"""License scans: exact containment join of text windows with license templates, and phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import bounded_parts, constant_rows, let, lower_ascii, whole
from marketloom.session import stage

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

CONTAINMENT = 0.9  # share of a template's words that a window must hold
END = ""  # stands behind the last word of a text; no word is empty

# Short notices, by label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "dedicated to the public domain under the cc0 waiver"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1"),
    ("reserved", "all rights reserved"),
]


def license_words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased: letters, digits and everything beyond ASCII."""
    return F.filter(F.split(lower_ascii(text), NOT_WORD), lambda w: w != "")


def templates(spark: SparkSession) -> DataFrame:
    rows = [(i, label, text) for i, (label, text) in enumerate(TEMPLATES)]
    return constant_rows(spark, rows, "template int, label string, text string")


def word_places(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per (doc_id, text_hash): ``copies``, the number of such rows; ``n_words``; ``places``, sorted.

    ``places`` holds (pos, word) for the words of ``wanted`` alone. The text is read and cut once:
    its words are spread out, each with its position, and only wanted ones pass the broadcast join.
    An end mark behind the last word keeps rows without any wanted word. Equal rows are merged in
    every task before the shuffle.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("_text"))
    spread = rows.select(
        "doc_id", F.xxhash64("_text").alias("text_hash"),
        F.posexplode(F.concat(license_words(F.col("_text")), F.array(F.lit(END)))).alias("pos", "word"),
    )
    out = None
    for part in bounded_parts(wanted.select("word").distinct(), "wanted_words"):
        # the end mark goes with the first part only, so that every row is counted once
        kept = part.filter(F.col("word") != END)
        kept = kept.unionByName(constant_rows(part.sparkSession, [(END,)], "word string")) if out is None else kept
        found = spread.join(F.broadcast(kept), "word").select("doc_id", "text_hash", "pos", "word")
        out = found if out is None else out.unionByName(found)
    end = F.col("word") == END
    return out.groupBy("doc_id", "text_hash").agg(
        F.count_if(end).alias("copies"),
        F.max(F.when(end, F.col("pos"))).cast("long").alias("n_words"),
        F.sort_array(F.collect_set(F.when(~end, F.struct("pos", "word")))).alias("places"),
    )


def _phrase_starts(places: Column, phrase: str) -> Column:
    """Positions at which the words of the phrase stand one after the other."""
    first, *rest = phrase.split(" ")

    def starts_here(x: Column, i: Column) -> Column:
        fits = x["word"] == first
        for k, word in enumerate(rest, 1):
            other = F.get(places, i + k)
            follows = (other["pos"] == x["pos"] + k) & (other["word"] == word)
            fits = fits & F.coalesce(follows, F.lit(False))
        return fits

    return F.transform(F.filter(places, starts_here), lambda x: x["pos"].cast("long"))


def phrase_summary(found: DataFrame) -> DataFrame:
    """Add n_base, first_word, last_word and the sorted labels ``base`` to rows with ``places``."""
    starts = F.array(*[_phrase_starts(F.col("places"), phrase) for phrase, _ in PHRASES])
    each = found.withColumn("_starts", starts)
    every = F.flatten("_starts")
    labels = F.array(*[
        F.when(F.size(F.col("_starts")[i]) > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)
    ])
    return each.withColumns({
        "n_base": F.size(every).cast("long"),
        "first_word": F.array_min(every), "last_word": F.array_max(every),
        "base": F.sort_array(F.array_distinct(F.array_compact(labels))),
    }).drop("_starts")


def template_words(template_table: DataFrame) -> DataFrame:
    """(template, label, length, asked): running and distinct words; templates without words go."""
    cut = template_table.select("template", "label", license_words(F.col("text")).alias("_words"))
    return cut.filter(F.size("_words") > 0).select(
        "template", "label", F.size("_words").alias("length"), F.array_distinct("_words").alias("asked")
    )


def template_matches(
    found: DataFrame, named: DataFrame, threshold: float = CONTAINMENT
) -> DataFrame:
    """All (doc_id, text_hash, block, template, label, containment) with containment >= threshold.

    ``found`` is stored ``word_places`` of at least all template words, ``named`` ``template_words``.
    A block is a window over the running words, whatever the layout: for a template of ``n`` words,
    block ``k`` takes the words ``k * n`` to ``k * n + 2 * n - 1``, so every stretch of ``n + 1``
    words lies in a block, also across line ends. Containment is the share of the template's
    distinct words that the block holds. The words of a template are ordered by the number of texts
    that hold them, rarest first. A block that reaches the threshold holds ``need = ceil(threshold *
    size)`` of them, hence one of the first ``size - need + 1``: these prefixes are the index. So a
    text is met with a template only if it holds a word of the prefix; its number of wanted words
    and the position of that word bound the overlap from above, and only texts that pass are laid
    into windows. No pair of texts is made.

    Null and empty texts match nothing. An empty table of texts or templates gives no rows.
    """
    held = F.array_distinct(F.transform("places", lambda x: x["word"]))
    sets = found.filter(F.size("places") > 0).select("doc_id", "text_hash", held.alias("held"))
    asked = named.select("template", F.explode("asked").alias("word"))
    counts = sets.select(F.explode("held").alias("word")).groupBy("word").count()
    rarity = asked.join(counts, "word", "left").groupBy("template").agg(
        F.sort_array(
            F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "word"))
        ).alias("ordered")
    )
    need = F.ceil(F.size("ordered") * F.lit(threshold) - 1e-9).cast("int")
    ordered = rarity.join(named.select("template", "label", "length"), "template").select(
        "template", "label", "length", F.transform("ordered", lambda x: x["word"]).alias("ordered"),
        need.alias("need"),
    )
    index = ordered.select(
        "*", F.posexplode(F.slice("ordered", F.lit(1), F.size("ordered") - F.col("need") + 1))
        .alias("place", "word"),
    )
    spread = sets.select("*", F.explode("held").alias("word"))
    out = None
    for part in bounded_parts(index, "template_index"):
        met = spread.join(F.broadcast(part), "word")
        reach = F.least(F.size("ordered") - F.col("place"), F.size("held"))
        earlier = F.slice("ordered", F.lit(1), F.col("place"))
        bounded = met.filter(reach >= F.col("need")).filter(~F.arrays_overlap(earlier, "held"))
        whole_text = bounded.filter(
            F.size(F.array_intersect("ordered", "held")) >= F.col("need")
        ).select("doc_id", "text_hash", "template", "label", "length", "ordered", "need")
        out = whole_text if out is None else out.unionByName(whole_text)
    return _windows(out, found)


def _windows(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """The windows of each (text, template) in which enough of the template's words stand."""
    same = F.col("c.doc_id").eqNullSafe(F.col("f.doc_id")) & (
        F.col("c.text_hash") == F.col("f.text_hash")
    )
    both = candidates.alias("c").join(found.alias("f"), same)
    mine = F.filter("f.places", lambda x: F.array_contains(F.col("c.ordered"), x["word"]))
    laid = both.select(
        "c.doc_id", "c.text_hash", "c.template", "c.label", "c.length", "c.need",
        F.size("c.ordered").alias("size"), F.explode(mine).alias("p"),
    )
    last = F.floor(F.col("p.pos") / F.col("length"))
    blocks = F.filter(F.array(last, last - 1), lambda k: k >= 0)
    keys = ["doc_id", "text_hash", "template", "label", "size", "need"]
    return (
        laid.select(*keys, F.explode(blocks).alias("block"), F.col("p.word").alias("word"))
        .groupBy(*keys, "block").agg(F.size(F.collect_set("word")).alias("overlap"))
        .filter(F.col("overlap") >= F.col("need"))
        .select(
            "doc_id", "text_hash", "block", "template", "label",
            (F.col("overlap") / F.col("size")).alias("containment"),
        )
    )


def license_scan(
    docs: DataFrame, template_table: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 where a phrase stands, else the best containment, else 0. The texts are read
    once; what is stored of them are the places of words that a phrase or a template has.

    Null text is empty. Rows that share id and text share their result, each row gets its own. Ties
    of containment give all labels. Extra columns of ``docs`` are not read. Empty tables give no
    rows; without templates the phrases alone give labels.
    """
    named = stage(template_words(template_table), "templates")
    phrase_words = sorted({w for phrase, _ in PHRASES for w in phrase.split(" ")})
    wanted = named.select(F.explode("asked").alias("word")).unionByName(
        constant_rows(docs.sparkSession, [(w,) for w in phrase_words], "word string")
    )
    found = stage(word_places(docs, wanted, doc_id, text), "word_places")
    base = phrase_summary(found).alias("base")
    more = (
        template_matches(found, named)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
        .alias("found")
    )
    same = F.col("base.doc_id").eqNullSafe(F.col("found.doc_id")) & (
        F.col("base.text_hash") == F.col("found.text_hash")
    )
    none = F.array().cast("array<string>")
    labels = F.sort_array(F.array_union("base.base", F.coalesce("found.more", none)))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("found.best", F.lit(0.0)))
    return base.join(more, same, "left").select(
        F.col("base.doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base.base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        score.alias("score"), F.explode(F.sequence(F.lit(1), "base.copies")).alias("_copy"),
    ).drop("_copy")
