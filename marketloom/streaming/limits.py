"""Limits per request on a stream: state per bucket of keys and day, with timers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketloom.operators.events import limit_of
from marketloom.streaming.metrics import LATENESS, watermarked

OUTPUT = "request_id bigint, minute timestamp, rejected boolean"
JUDGED = "request_id bigint, minute bigint, rejected boolean"
STATE = (
    "minutes array<bigint>, names array<string>, times array<bigint>, ids array<bigint>, "
    "limits array<int>"
)
BUCKETS = 32  # groups of keys that are judged together, per day
MINUTE_MS = 60_000


def limited_stream(
    stream: DataFrame, address: str, endpoint: str, request_id: str, ts: str = "ts",
    limit: Column | None = None, lateness: str = LATENESS,
) -> DataFrame:
    """(request_id, minute, rejected) per request: rejected are all but the first of their minute.

    The order within a minute is (time, id), whatever the order of arrival, so on closed minutes the
    result equals ``limited_requests`` of the stored log. The state of an (address, endpoint, minute)
    holds the least requests seen, at most as many as the limit: a request that is pushed out, or
    that comes behind a full state, is rejected at once; those left when the watermark passes the
    end of the minute are accepted. Rows older than the watermark are dropped by Spark. Rows
    without a time or id are dropped. Null addresses and endpoints are keys like any other.
    ``limit`` may depend on the endpoint; it must be the same for all rows of a key.

    Most keys have few requests in a minute, so a call per key would cost far more than its
    requests. One call judges the keys of a bucket (by a hash of address and endpoint) over a
    day; minutes close one by one, and a bucket forgets a minute when it closes.
    """
    allowed = limit_of(F.col(endpoint)) if limit is None else limit
    rows = watermarked(stream, ts, lateness).filter(
        F.col(ts).isNotNull() & F.col(request_id).isNotNull()
    )
    key = F.struct(F.col(address).alias("a"), F.col(endpoint).alias("e"))
    rows = rows.select(
        F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.unix_date(F.to_date(ts)).alias("day"),
        F.unix_micros(F.date_trunc("minute", ts)).alias("minute"),
        F.to_json(key).alias("name"), F.unix_micros(ts).alias("micros"),
        F.col(request_id).cast("long").alias("request_id"), allowed.cast("int").alias("allowed"),
        F.col(ts),
    )
    judged = rows.groupBy("bucket", "day").applyInPandasWithState(
        _judge, JUDGED, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return judged.select("request_id", F.timestamp_micros("minute").alias("minute"), "rejected")


Request = tuple[int, str, int, int, int]  # minute, name of the key, time, id, limit of the key


def _judge(
    key: tuple, frames: Iterable[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    kept: list[Request] = list(zip(*state.get)) if state.exists else []
    if not state.hasTimedOut:
        for frame in frames:
            columns = [frame[c].tolist() for c in ("minute", "name", "micros", "request_id", "allowed")]
            kept, late = _first(sorted([*kept, *zip(*columns)]))
            if late:
                yield _rows(late, True)
    now = state.getCurrentWatermarkMs()
    ended = [r for r in kept if _end(r) <= now]
    kept = [r for r in kept if _end(r) > now]
    if ended:
        yield _rows(ended, False)
    if kept:
        state.update(tuple(list(c) for c in zip(*kept)))
        state.setTimeoutTimestamp(min(map(_end, kept)))
    elif state.exists:
        state.remove()


def _first(ordered: list[Request]) -> tuple[list[Request], list[Request]]:
    """The first requests of every key and minute, as many as its limit, and the others."""
    first, late = [], []
    for _, same in groupby(ordered, itemgetter(0, 1)):
        mine = list(same)
        most = max(mine[0][4], 0)
        first += mine[:most]
        late += mine[most:]
    return first, late


def _end(request: Request) -> int:
    """When the minute of a request ends, in milliseconds."""
    return request[0] // 1000 + MINUTE_MS


def _rows(requests: list[Request], rejected: bool) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "request_id": pd.Series([r[3] for r in requests], dtype="int64"),
            "minute": pd.Series([r[0] for r in requests], dtype="int64"),
            "rejected": pd.Series([rejected] * len(requests), dtype="bool"),
        }
    )
