"""Personal data by patterns: findings with spans, redaction, checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions.arrays import chunks, running, running_sums
from marketloom.functions.text import bind


@dataclass(frozen=True)
class Recognizer:
    """An entity type, its pattern, the constant score of a match, and text that a match contains."""

    kind: str
    pattern: str
    score: float
    hint: str = ""


OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

# Recognisers in order.
RECOGNIZERS = [
    Recognizer("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 1.0, "@"),
    Recognizer("CREDIT_CARD", r"\b[3-6][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,4}\b", 1.0),
    Recognizer("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b", 1.0),
    Recognizer("BR_CPF", r"\b[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}\b", 0.85, "-"),
    Recognizer("US_SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.85, "-"),
    Recognizer("IP_ADDRESS", rf"\b(?:{OCTET}\.){{3}}{OCTET}\b", 0.6, "."),
    Recognizer("URL", r"https?://[A-Za-z0-9./?=&_%#:+~-]+", 0.6, "://"),
    Recognizer("PHONE_NUMBER", r"\+[0-9]{1,3}[ -]?\(?[0-9]{2,3}\)?[ -][0-9]{3,5}-[0-9]{4}\b", 0.4, "+"),
]
DEFAULT_THRESHOLD = 0.5
STRICT_THRESHOLD = 0.7


def _iban_ok(match: Column) -> Column:
    """Check digits: the code moved by four, letters as 10 to 35, is 1 modulo 97."""
    plain = F.regexp_replace(match, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    values = F.transform(
        F.split(moved, ""),
        lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55),
    )
    rest = F.aggregate(
        values, F.lit(0), lambda acc, v: F.when(v > 9, acc * 100 + v).otherwise(acc * 10 + v) % 97
    )
    return rest == 1


def _card_ok(match: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(match, "[ -]", ""))


CHECKED = {"CREDIT_CARD": _card_ok, "IBAN_CODE": _iban_ok}


def no_findings() -> Column:
    kind = "array<struct<type:string,start:int,end:int,score:double,text:string>>"
    return F.array().cast(kind)


def _possible(text: Column, r: Recognizer) -> Column:
    """Most texts have no match; the cheap tests keep the span work away from them."""
    found = F.rlike(text, F.lit(r.pattern))
    return text.contains(r.hint) & found if r.hint else found


def _matches(text: Column, r: Recognizer) -> Column:
    """Findings of one recogniser; start and end count characters from 0, end exclusive.

    The pieces between matches and the matches alternate, so running sums of lengths give the spans.
    """
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)).alias("found"),
        F.split(text, r.pattern, -1).alias("between"),
    )

    def spans(p: Column) -> Column:
        steps = F.zip_with(
            p["found"], F.slice(p["between"], F.lit(1), F.size(p["found"])),
            lambda m, piece: (F.length(piece) + F.length(m)).cast("long"),
        )
        return bind(
            running_sums(steps),
            lambda ends: F.transform(
                p["found"],
                lambda m, i: F.struct(
                    F.lit(r.kind).alias("type"),
                    (ends[i] - F.length(m)).cast("int").alias("start"),
                    ends[i].cast("int").alias("end"),
                    F.lit(r.score).alias("score"),
                    m.alias("text"),
                ),
            ),
        )

    found = bind(parts, spans)
    if r.kind in CHECKED:
        found = F.filter(found, lambda f: CHECKED[r.kind](f["text"]))
    return F.when(_possible(text, r), found).otherwise(no_findings())


def holds_pii(text: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """Whether ``detect`` has a finding of at least ``threshold``; needs no spans.

    The finding of the greatest score is never dropped for another one, so any match will do.
    """
    out = F.lit(False)
    for r in RECOGNIZERS:
        if r.score >= threshold:
            hit = _possible(text, r)
            if r.kind in CHECKED:
                every = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))
                hit = hit & F.exists(every, CHECKED[r.kind])
            out = out | hit
    return out


def detect(text: Column) -> Column:
    """Array of (type, start, end, score, text) ordered by start; empty for blank texts.

    Of overlapping findings the one with the greater score, then the longer one, is kept. Findings
    are compared only inside a run of overlapping ones.
    """
    each = F.concat(*[_matches(text, r) for r in RECOGNIZERS])
    placed = F.sort_array(
        F.transform(each, lambda f: F.struct(f["start"].alias("at"), f["type"].alias("kind"), f.alias("f")))
    )

    def beats(g: Column, f: Column) -> Column:
        overlap = (g["start"] < f["end"]) & (f["start"] < g["end"])
        longer = (g["end"] - g["start"]) > (f["end"] - f["start"])
        return overlap & ((g["score"] > f["score"]) | ((g["score"] == f["score"]) & longer))

    def unbeaten(run: Column) -> Column:
        return F.filter(run, lambda f: ~F.exists(run, lambda g: beats(g, f)))

    def kept(ordered: Column) -> Column:
        ends = running(
            F.transform(ordered, lambda f: f["end"]), lambda a, v: F.greatest(a, v), F.lit(-1)
        )

        def runs(reach: Column) -> Column:
            first = F.filter(
                F.transform(
                    ordered,
                    lambda f, i: F.when((i == 0) | (f["start"] >= F.get(reach, i - 1)), i),
                ),
                lambda i: i.isNotNull(),
            )
            return bind(
                first,
                lambda s: F.flatten(
                    F.transform(
                        s,
                        lambda at, i: bind(
                            F.slice(
                                ordered, at + 1,
                                F.coalesce(F.get(s, i + 1), F.size(ordered)) - at,
                            ),
                            unbeaten,
                        ),
                    )
                ),
            )

        return bind(ends, runs)

    return F.when(F.size(each) < 2, each).otherwise(
        bind(F.transform(placed, lambda x: x["f"]), kept)
    )


def has_pii(findings: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    return F.exists(findings, lambda f: f["score"] >= threshold)


def redact(text: Column, findings: Column) -> Column:
    """The text with each finding replaced by ``<TYPE>``.

    The text is cut once per chunk of findings, and the findings of a chunk inside that piece.
    """

    def piece(parts: Column, part: Column, i: Column) -> Column:
        low = F.when(i == 0, F.lit(0)).otherwise(F.element_at(F.get(parts, i - 1), -1)["end"])
        high = F.element_at(part, -1)["end"]

        def replaced(cut: Column) -> Column:
            before = F.transform(
                part,
                lambda f, k: F.concat(
                    F.substr(
                        cut,
                        F.coalesce(F.get(part, k - 1)["end"], low) - low + 1,
                        f["start"] - F.coalesce(F.get(part, k - 1)["end"], low),
                    ),
                    F.lit("<"), f["type"], F.lit(">"),
                ),
            )
            return F.array_join(before, "")

        return bind(F.substr(text, low + 1, high - low), replaced)

    def whole(parts: Column) -> Column:
        done = F.array_join(F.transform(parts, lambda part, i: piece(parts, part, i)), "")
        rest = F.substr(text, F.element_at(F.element_at(parts, -1), -1)["end"] + 1)
        return F.concat(done, rest)

    return F.when(F.size(findings) == 0, text).otherwise(
        bind(findings, lambda f: bind(chunks(f), whole))
    )
