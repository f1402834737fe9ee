"""URL filters: pattern rules looked up by their rarest literal token."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import constant_rows, lower_ascii, whole

ALLOW, BLOCK = "allow", "block"

# Rules by host and path.
HOST_RULES = [
    ("org", "/", ALLOW),
    ("example.org", "/es/", BLOCK),
    ("example.org", "/en/1", BLOCK),
    ("com", "/fr/", ALLOW),
    ("com", "/de/", BLOCK),
]

# Further rules of this library: (name, literal tokens every match holds, pattern on host and path).
PATTERN_RULES = [
    ("link farm", ["spam", "farm"], r"(?:^|\.)spam-farm\."),
    ("pills", ["cheap", "pills"], r"(?:^|\.)cheap-pills\."),
    ("casino", ["casino"], r"(?:^|[.-])casino[.-]"),
    ("adult", ["adult"], r"(?:^|[.-])adult[.-]"),
    ("bets", ["free", "bets"], r"(?:^|\.)free-bets\."),
    ("ads", ["ads", "track"], r"(?:^|\.)ads-track\."),
]

RULE_SCHEMA = "rule string, size int, verdict string, by_host boolean, tokens array<string>, pattern string"


def rules(spark: SparkSession) -> DataFrame:
    """The rules as a table: literal tokens and the pattern that decides.

    The last token of a path that does not end with a separator may go on in the url, so it is not
    a literal token.
    """
    rows = []
    for host, path, verdict in HOST_RULES:
        whole_tokens = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", f"{host}{path}".lower())
        pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
        rows.append((f"{host}{path}", len(host) + len(path), verdict, True, whole_tokens, pattern))
    for name, tokens, pattern in PATTERN_RULES:
        rows.append((name, 0, BLOCK, False, tokens, pattern))
    return constant_rows(spark, rows, RULE_SCHEMA)


def with_host_path(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``; null, or a url without ``://``, has both empty."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    return urls.withColumns(
        {
            "host": lower_ascii(F.regexp_extract(whole(url), pattern, 1)),
            "path": F.regexp_extract(whole(url), pattern, 2),
        }
    )


def _tokens(subject: Column) -> Column:
    """Distinct tokens of a url; the empty token, held by every url, fetches rules without tokens."""
    parts = F.split(lower_ascii(subject), "[^a-z0-9]+")
    return F.array_distinct(F.concat(F.array(F.lit("")), parts))


def url_verdicts(pages: DataFrame, rule_table: DataFrame, url: str = "url") -> DataFrame:
    """One row per distinct url: (url, host, path, rule, verdict).

    Each rule is filed under the one of its literal tokens that the fewest urls hold. The tokens of
    a url fetch the rules filed under them, and only those run their pattern. The longest host rule
    that fits decides; without one, a url is blocked if a pattern rule fits, else allowed.

    Work is done once per distinct url, so a url on many pages costs one row. Tokens are counted
    with partial sums before the shuffle. The rules are joined by token: Spark broadcasts them by
    their measured size, or shuffles both sides and splits a frequent token.
    Null and malformed urls fit no rule and are allowed.
    """
    urls = with_host_path(
        pages.select(F.col(url).alias("url")).filter(F.col("url").isNotNull()).distinct()
    )
    asked = urls.select(
        "url", "host", "path", F.concat("host", "path").alias("_subject")
    ).select("*", F.explode(_tokens(F.col("_subject"))).alias("token"))
    wanted = rule_table.select("rule", F.explode_outer("tokens").alias("token")).select(
        "rule", F.coalesce("token", F.lit("")).alias("token")
    )
    seen = (
        asked.join(wanted.select("token").distinct(), "token", "left_semi")
        .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    )
    filed = (
        wanted.join(seen, "token", "left")
        .groupBy("rule")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("token"))
    )
    index = rule_table.select("rule", "size", "verdict", "by_host", "pattern").join(filed, "rule")
    fits = asked.join(index, "token").filter(F.regexp_like("_subject", F.col("pattern")))
    ranked = F.struct("size", "rule", "verdict")
    best = fits.groupBy("url").agg(
        F.max(F.when(F.col("by_host"), ranked)).alias("best"),
        F.max(F.when(~F.col("by_host"), F.lit(True))).alias("pattern_fits"),
    )
    return urls.join(best, "url", "left").select(
        "url", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(
            "best.verdict", F.when(F.col("pattern_fits"), F.lit(BLOCK)), F.lit(ALLOW)
        ).alias("verdict"),
    )


def judge_pages(
    pages: DataFrame, rule_table: DataFrame, page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """One row per row of ``pages``: (page_id, host, path, rule, verdict)."""
    judged = url_verdicts(pages, rule_table, url)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url"))
    return rows.join(judged, rows["_url"] == judged["url"], "left").select(
        "page_id", F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"), "rule",
        F.coalesce("verdict", F.lit(ALLOW)).alias("verdict"),
    )
