"""Rule tables against brute force, limits on streams, refresh of partitions."""

import glob
import os
import random
import re

from pyspark.sql import functions as F

from marketloom.operators.events import limited_requests
from marketloom.operators.rule_tables import rule_hits
from marketloom.sources.refresh import refresh_partitions
from marketloom.streaming.limits import limited_stream

RULES = "rule_id string, literal string, pattern string"


def test_rules_against_brute_force(spark):
    random.seed(8)
    part = lambda n: "".join(random.choice("abcdeé") for _ in range(n))
    rules = [(f"s{i}", part(random.randrange(1, 9)).upper(), None) for i in range(10_000)]
    rules += [(f"p{i}", p, f"{p}[a-c]+{q}") for i, (p, q) in enumerate((part(4), part(2)) for _ in range(300))]
    rules += [("any", None, "a.{3}b$"), ("any2", "", "^[^a]*$"), ("none", None, None), ("s0", rules[0][1], None)]
    rows = [(i, part(random.randrange(0, 60)).title()) for i in range(60)] + [(1, "abc"), (None, "ABC"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "id long, text string").withColumns({"key": F.lit(1), "rule_id": F.lit("x"), "gram": F.lit("y")})
    hits = rule_hits(df, spark.createDataFrame(rules, RULES), ["id"])
    got = sorted(map(str, hits.collect()))
    expected = []
    for i, text in rows:
        for name, literal, pattern in set(rules):
            if text is None or not (literal or pattern):
                continue
            low = text.lower()
            if re.search(pattern, low) if pattern else literal.lower() in low:
                expected.append(f"Row(id={i!r}, rule_id={name!r})")
    assert got == sorted(expected) and len(got) > 1000
    assert rule_hits(df, spark.createDataFrame([], RULES), ["id"]).count() == 0
    assert rule_hits(df.limit(0), spark.createDataFrame(rules, RULES), ["id"]).count() == 0


def test_plan_does_not_grow_with_the_rules(spark):
    df = spark.createDataFrame([(1, "some text")], "id long, text string")
    sizes = []
    for n in (10, 1000):
        rules = spark.range(n).select(
            F.concat(F.lit("r"), "id").alias("rule_id"), F.concat(F.lit("lit"), "id").alias("literal"),
            F.lit(None).cast("string").alias("pattern"),
        )
        plan = rule_hits(df, rules, ["id"])._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(plan.count("\n"))
    assert sizes[0] == sizes[1]


def requests(spark, rows):
    frame = spark.createDataFrame(rows, "request_id long, address string, endpoint string, t string")
    return frame.select("request_id", "address", "endpoint", F.col("t").cast("timestamp_ntz").alias("ts"))


def test_stream_limits_equal_the_batch_also_after_a_restart(spark, tmp_path):
    random.seed(6)
    rows, n = [], 0
    for part in range(3):  # three files; minutes reach over the border of files, order is mixed
        mine = []
        for _ in range(150):
            second = part * 90 + random.randrange(100)
            mine.append((n, random.choice(["a", "b", None]), random.choice(["x", "/api/predict"]),
                         f"2024-01-01 00:{second // 60:02}:{second % 60:02}"))
            n += 1
        random.shuffle(mine)
        rows.append(mine)
    rows.append([(n, "z", "x", "2024-01-01 02:00:00")])  # moves the watermark
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for mine in rows:
        requests(spark, mine).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(requests(spark, mine).schema).parquet(source)
        limited = limited_stream(stream, "address", "endpoint", "request_id", limit=F.lit(7))
        query = limited.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", state).trigger(availableNow=True).start()  # a new start per file
        query.awaitTermination()
    every = requests(spark, [r for mine in rows for r in mine])
    batch = limited_requests(every, "address", "endpoint", ["ts", "request_id"], limit=7)
    # null keys never equal each other in the batch join, so they are compared apart
    expected = {r.request_id: r.rejected for r in batch.filter("address IS NOT NULL AND request_id < 450").collect()}
    got = [(r.request_id, r.rejected) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(dict(got)) == 450
    assert {i: x for i, x in got if i in expected} == expected and any(expected.values())


def files(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/day=*/*.parquet")}


def test_only_changed_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "table")
    table = lambda rows: spark.createDataFrame(rows, "day string, v long")
    first = [("d1", 1), ("d1", 1), ("d2", 2), ("d3", 3), (None, 4)]
    read = lambda: sorted(map(tuple, spark.read.parquet(path).select("day", "v").collect()), key=str)
    assert refresh_partitions(table(first), path, ["day"]).count() == 4
    assert read() == sorted(first, key=str)
    before = files(path)
    assert refresh_partitions(table(first[::-1]), path, ["day"]).count() == 0  # other order, same rows
    assert files(path) == before
    second = [("d1", 1), ("d1", 1), ("d2", 20), ("d3", 3)]  # the null day is not delivered: it stays
    assert [r.day for r in refresh_partitions(table(second), path, ["day"]).collect()] == ["d2"]
    after = files(path)
    assert {f for f in before if "day=d2" not in f} <= {f for f, t in after.items() if before.get(f) == t}
    assert read() == sorted([*second, (None, 4)], key=str)
    third = [("d1", 1), ("d4", 1)]  # a repeated row less; a new day
    assert sorted(r.day for r in refresh_partitions(table(third), path, ["day"]).collect()) == ["d1", "d4"]
    assert refresh_partitions(table(third), path, ["day"]).count() == 0
    assert refresh_partitions(table([]), path, ["day"]).count() == 0
    assert read() == sorted([("d1", 1), ("d4", 1), ("d2", 20), ("d3", 3), (None, 4)], key=str)
