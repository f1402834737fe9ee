"""License scan: notices in any layout, odd rows, many templates."""

import random

from pyspark.sql import functions as F

from fixtures import documents, odd_rows
from marketloom.llm.licenses import TEMPLATES, license_scan, templates

MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted"
)


def wrapped(text, width, before="# "):
    lines, line = [], before
    for word in text.split():
        if len(line) + len(word) > width:
            lines.append(line)
            line = before
        line += word + " "
    return "\n".join([*lines, line])


def scan(spark, rows):
    return license_scan(documents(spark, rows), templates(spark)).collect()


def brute(text):
    """(labels, best containment) by looking at every window of every template."""
    words = words_of(text)
    labels, best = set(), 0.0
    for label, template in TEMPLATES:
        asked = template.split()
        need = -(-len(set(asked)) * 9 // 10)
        for low in range(0, max(1, len(words)), len(asked)):
            overlap = len(set(words[low : low + 2 * len(asked)]) & set(asked))
            if overlap >= need:
                labels.add(label)
                best = max(best, overlap / len(set(asked)))
    return labels, best


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c >= "\x80" else " " for c in lowered).split(" ")


def cleaned(text):
    return " ".join(w for w in words_of(text) if w)


def test_wrapped_notices_are_found(spark):
    rows = []
    for i, notice in enumerate([MIT, BSD]):
        for k, width in enumerate([24, 30, 50, 72]):
            rows.append((10 * i + k, "Some words before.\n\n" + wrapped(notice, width) + "\n\nand after"))
    found = {r.doc_id: (r.labels, r.score) for r in scan(spark, rows)}
    assert found == {i: ("mit" if i < 10 else "bsd", 1.0) for i, _ in rows}


def test_scattered_words_are_no_notice(spark):
    words = MIT.split()
    apart = " ".join(f"{w} " + " ".join(f"x{i}y{k}" for k in range(20)) for i, w in enumerate(words))
    assert [(r.labels, r.score) for r in scan(spark, [(1, apart)])] == [("", 0.0)]


def test_against_every_window(spark):
    random.seed(4)
    rows = list(odd_rows())
    for i in range(120):
        words = [f"p{random.randrange(50)}" for _ in range(random.randrange(60))]
        for _, template in random.sample(TEMPLATES, 2):
            part = template.split()
            for _ in range(random.randrange(3)):
                part.insert(random.randrange(len(part)), random.choice(["zz", "the", "\n"]))
            if random.random() < 0.5:
                del part[random.randrange(len(part))]
            at = random.randrange(len(words) + 1)
            words[at:at] = part
        rows.append((100 + i, " ".join(words)))
    got = sorted(
        ((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_base, r.labels, round(r.score, 9)) for r in scan(spark, rows))
    )
    expected = []
    for i, text in rows:
        words = [w for w in words_of(text) if w]
        joined = " " + " ".join(words).replace(" ", "  ") + " "
        counts = {
            label: joined.count(f" {phrase.replace(' ', '  ')} ")
            for phrase, label in [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
        }
        labels, best = brute(cleaned(text))
        labels |= {k for k, n in counts.items() if n}
        n = sum(counts.values())
        expected.append((i is None, i or 0, len(words), n, ",".join(sorted(labels)), 1.0 if n else round(best, 9)))
    assert got == sorted(expected)


def test_many_templates_and_none(spark):
    rows = [(i, f"t{i} a{i} b{i} c{i}") for i in range(3000)]
    many = spark.createDataFrame(rows, "template int, text string").withColumn(
        "label", F.concat(F.lit("l"), "template")
    )
    docs = documents(spark, [(i, f"x\nt{7 * i}\na{7 * i} b{7 * i} c{7 * i} y") for i in range(200)] + [(None, None)])
    found = {r.doc_id: r.labels for r in license_scan(docs, many).collect()}
    assert found == {**{i: f"l{7 * i}" for i in range(200)}, None: ""}
    assert {r.labels for r in license_scan(docs, many.limit(0)).collect()} == {""}
    assert license_scan(docs.limit(0), many).collect() == []
