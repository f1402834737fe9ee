"""Limits on a stream with many keys: the state is one row per bucket and day, whatever the keys."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from marketloom.streaming import limits
from marketloom.streaming.limits import limited_stream


def frame(spark, rows):
    made = spark.createDataFrame(rows, "request_id long, address long, endpoint string, t string")
    return made.select("request_id", "address", "endpoint", F.col("t").cast("timestamp_ntz").alias("ts"))


def test_many_keys_are_few_state_rows(spark, tmp_path):
    random.seed(4)
    big = 2**53  # neighbours that a double cannot tell apart
    keys = [(a, e) for a in [None, big, big + 1, *range(1500)] for e in ("x", None)]
    batches, n = [], 0
    for part in range(2):  # the second file brings more of the same minutes, over midnight
        rows = []
        for address, endpoint in keys:
            for _ in range(random.randrange(1, 4) if address and address < big else 9):
                minute, second = random.choice([58, 59, 60]), random.randrange(60)
                day, clock = (1, f"23:{minute}") if minute < 60 else (2, "00:00")
                rows.append((n, address, endpoint, f"2024-01-0{day} {clock}:{second:02}"))
                n += 1
        batches.append(rows)
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    most = []
    for rows in [*batches, [(n, 1, "x", "2024-01-02 02:00:00")]]:  # the last one moves the watermark
        frame(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame(spark, rows).schema).parquet(source)
        query = limited_stream(stream, "address", "endpoint", "request_id", limit=F.lit(2)).writeStream.format(
            "parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        most += [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert 0 < max(most) <= 2 * limits.BUCKETS
    groups = defaultdict(list)
    for request, address, endpoint, t in [r for rows in batches for r in rows]:
        groups[address, endpoint, t[:16]].append((t, request))
    expected = {r: i >= 2 for g in groups.values() for i, (_, r) in enumerate(sorted(g))}
    got = [(r.request_id, r.rejected) for r in spark.read.parquet(out).filter(f"request_id < {n}").collect()]
    assert len(got) == n and dict(got) == expected and any(expected.values())
    minutes = {str(r[0])[:16] for r in spark.read.parquet(out).filter(f"request_id < {n}").select("minute").distinct().collect()}
    assert minutes == {"2024-01-01 23:58", "2024-01-01 23:59", "2024-01-02 00:00"}
