"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.arrays import running_sums
from marketloom.llm.common import let, whole

THRESHOLD = 0.5
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.35

# A match of a run of characters starts where the run starts, or where the last match ended. This
# is what a leftmost search gives anyway; stated in the pattern, a long run is read only once.
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Characters after country and check digits, by country. A number of a known country ends there if a
# border follows; other countries take all that may belong to them.
IBAN_REST = {
    11: "NO", 12: "BE", 14: "DK FI FO GL NL", 15: "MK SI", 16: "AT BA EE KZ LT LU XK",
    17: "CH CR HR LI LV", 18: "BG BH DE GB GE IE ME RS VA", 19: "AE GI IL IQ TL",
    20: "AD CZ ES MD PK RO SA SE SK TN VG", 21: "LY PT ST", 22: "IS TR", 23: "FR GR IT MC MR SM",
    24: "AL AZ BY CY DO GT HU LB PL SV", 25: "BR EG PS QA UA", 26: "JO KW MU",
    27: "MT SC", 28: "LC",
}
_KNOWN = "|".join(
    rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{rest}}}" for rest, codes in IBAN_REST.items()
)
IBAN = (
    rf"(?<![A-Za-z0-9])(?:(?:{_KNOWN})|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])"
)
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
MAC = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])"
SECRET = r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])"

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """12 to 19 digits with a valid Luhn check digit."""
    digits = _digits(match)
    return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)


def mod97(match: Column) -> Column:
    """The check of account numbers: country and check digits go last, letters count from 10."""
    plain = F.regexp_replace(match, "\x20", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = F.aggregate(
        F.split(moved, "(?!^)(?!$)"),
        F.lit(0),
        lambda r, c: F.when(c <= "9", (r * 10 + F.ascii(c) - 48) % 97).otherwise(
            (r * 100 + F.ascii(c) - 55) % 97
        ),
    )
    return F.length(plain).between(15, 34) & (value == 1)


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``hint`` is a cheap condition that every text with a match meets. ``confirm`` checks a match.
    ``score`` is the score without context; one of ``context`` nearby adds ``CONTEXT_BONUS``.
    """

    name: str
    pattern: str
    hint: Callable[[Column], Column]
    confirm: Callable[[Column], Column]
    score: float
    context: str
    base: bool = False


KINDS = [
    Kind("email", EMAIL, lambda t: t.contains("@"), lambda m: F.lit(True),
         0.8, "mail|contact|write", base=True),
    Kind("ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]"),
         lambda m: m.rlike(rf"\A{OCTET}(?:\.{OCTET}){{3}}\z"), 0.6, "ip|address|host|server",
         base=True),
    Kind("card", CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), luhn,
         0.6, "card|visa|credit|payment", base=True),
    Kind("phone", PHONE, lambda t: t.contains("+"),
         lambda m: F.length(_digits(m)).between(9, 15), 0.6, "phone|tel|call|mobile|fax",
         base=True),
    Kind("iban", IBAN, lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"), mod97, 0.9, "iban|account|bank"),
    Kind("ssn", SSN, lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
         lambda m: ~m.rlike(r"\A(?:000|666|9)|-00-|-0000\z"), 0.3, "ssn|social security|tax id"),
    Kind("mac", MAC, lambda t: t.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]{2}:"), lambda m: F.lit(True),
         0.5, "mac|device|hardware"),
    Kind("secret", SECRET, lambda t: t.rlike("[0-9A-Fa-f]{32}"), lambda m: F.lit(True),
         0.3, "token|key|secret|password"),
]


FINDING = "array<struct<start:bigint,place:int,end:bigint,kind:string,score:double,text:string>>"


def _findings(text: Column, place: int, kind: Kind) -> Column:
    """Confirmed findings of one kind, in order; positions in characters, end exclusive."""

    def built(between: Column, matches: Column) -> Column:
        steps = F.transform(
            matches,
            lambda m, i: (
                F.length(between[i]) + F.when(i > 0, F.length(F.get(matches, i - 1))).otherwise(0)
            ).cast("long"),
        )

        def finding(m: Column, i: Column, starts: Column) -> Column:
            near = F.lower(
                F.concat(
                    F.right(between[i], F.lit(CONTEXT_CHARS)), F.lit(" "),
                    F.left(between[i + 1], F.lit(CONTEXT_CHARS)),
                )
            )
            bonus = F.when(near.rlike(rf"\b(?:{kind.context})\b"), CONTEXT_BONUS).otherwise(0.0)
            return F.struct(
                starts[i].alias("start"), F.lit(place).alias("place"),
                (starts[i] + F.length(m)).alias("end"), F.lit(kind.name).alias("kind"),
                F.least(F.lit(1.0), F.lit(kind.score) + bonus).alias("score"), m.alias("text"),
            )

        def kept(starts: Column) -> Column:
            all_found = F.transform(matches, lambda m, i: finding(m, i, starts))
            return F.filter(
                all_found, lambda f: kind.confirm(f["text"]) & (f["score"] >= THRESHOLD)
            )

        return let(running_sums(steps), kept)

    found = let(
        F.split(text, kind.pattern, -1),
        lambda between: let(
            F.regexp_extract_all(text, F.lit(kind.pattern), 0),
            lambda matches: built(between, matches),
        ),
    )
    return F.when(kind.hint(text), found.cast(FINDING)).otherwise(F.array().cast(FINDING))


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, findings), sorted by start and kind.

    Each kind is searched on its own, leftmost and without overlap, and a match that fails its check
    is dropped without a retry. Kinds may overlap each other. Null text counts as empty; empty text
    gives an empty array. Rows are independent, so repeated rows give repeated results.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("_text"))
    lists = [_findings(F.col("_text"), i, kind) for i, kind in enumerate(KINDS)]
    return rows.select("doc_id", F.sort_array(F.concat(*lists)).alias("findings"))


def pii_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, digest of their spans, and all spans as text."""

    def spans(findings: Column) -> Column:
        return F.array_join(
            F.transform(
                findings,
                lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string")),
            ),
            ",",
        )

    base = [k.name for k in KINDS if k.base]
    found = personal_data(docs, doc_id, text)

    def count(name: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == name)).cast("long")

    counts = [count(name).alias(f"n_{name}") for name in base]
    of_base = F.filter("findings", lambda f: f["kind"].isin(base))
    return found.select(
        "doc_id", *counts, F.sha2(spans(of_base), 256).alias("base_sha256"),
        spans(F.col("findings")).alias("spans"),
        F.array_max(F.transform("findings", lambda f: f["score"])).alias("top_score"),
    )
