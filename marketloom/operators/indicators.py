"""Technical indicators on bar tables (key ``ticker``, order ``date``).

Trailing means and deviations are null until the frame is full. Exponential means start at the
first price: y0 = x0, y = a*x + (1-a)*y(prev), a = 2/(span+1). Prices must not be null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketloom.operators.series import (
    BLOCK,
    BLOCK_ROWS,
    POSITION,
    is_own,
    over_series,
    with_position,
)
from marketloom.session import stage

# Default periods.
SMA_PERIODS = [5, 10, 20, 50]
EMA_SPANS = [12, 26]
RSI_PERIOD = 14
MACD_SPANS = (12, 26, 9)
BOLLINGER = (20, 2.0)
ATR_PERIOD = 14
VOLUME_PERIOD = 20
HORIZON = 5

# The indicator columns in order.
INDICATOR_COLUMNS = [
    "sma_5", "sma_10", "sma_20", "sma_50", "ema_12", "ema_26", "rsi_14", "macd", "macd_signal",
    "macd_histogram", "bb_upper", "bb_middle", "bb_lower", "bb_width", "atr_14", "obv",
    "volume_ma_20", "price_change", "price_change_5d",
]

BAR_COLUMNS = ["date", "open", "high", "low", "close", "volume"]

LARGEST = 650.0  # exponent that a double still holds with room for the prices
VANISHED = 746.0  # a weight below exp(-746) is zero in a double


def _decay(span: float) -> float:
    return -math.log(1 - 2 / (span + 1))


def _block_rows(spans: Sequence[float]) -> int:
    """Rows of a block in which the weights of all spans stay within a double."""
    return min(BLOCK_ROWS, int(LARGEST / max(_decay(s) for s in spans)))


def rolling(agg: Callable[[Column], Column], value: Column, n: int, w: WindowSpec) -> Column:
    """Aggregate over the last ``n`` rows; null while fewer than ``n`` values exist."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) >= n, agg(value).over(frame))


def sma_column(value: Column, n: int, w: WindowSpec) -> Column:
    return rolling(F.avg, value, n, w)


def _place(rows: int) -> Column:
    """0-based place of a row in its block; negative for copies of earlier rows."""
    return (F.col(POSITION) - F.col(BLOCK) * rows).cast("double")


def local_ema(value: Column, span: float, w: WindowSpec, rows: int) -> Column:
    """Exponential mean over the own rows of a block, as if nothing came before it.

    With q = 1-a and j the place in the block it is q^j * sum(u(i) * q^-i), where u is a*x, and x on
    the first row of the series. The mean over all rows is this plus q^(j+1) times the mean at the
    end of the block before.
    """
    alpha = 2 / (span + 1)
    q, j = F.lit(1 - alpha), _place(rows)
    update = F.when(F.col(POSITION) == 0, value).otherwise(value * alpha)
    weighted = F.when(is_own(rows), update * F.pow(q, -j)).otherwise(0.0)
    return F.pow(q, j) * F.sum(weighted).over(w.rowsBetween(Window.unboundedPreceding, 0))


def _carry(end: str, span: float, rows: int) -> Column:
    """Exponential mean before a block, from the local means at the ends of the earlier blocks.

    Every block but the last has ``rows`` rows, so an end counts q^rows less per block. The frame
    reaches back until that weight is zero in a double.
    """
    reach = math.ceil(VANISHED / (rows * _decay(span))) + 1
    fade = (1 - 2 / (span + 1)) ** rows
    blocks = Window.partitionBy("ticker").orderBy(BLOCK).rowsBetween(-reach, -1)
    ends = F.collect_list(end).over(blocks)
    return F.aggregate(ends, F.lit(0.0), lambda mean, x: mean * fade + x)


def _faded(span: float, j: Column) -> Column:
    return F.pow(F.lit(1 - 2 / (span + 1)), j + 1)


def _response(span: float, signal: float, j: Column) -> Column:
    """What a mean that fades with ``span`` from 1 adds to a local mean over ``signal`` rows."""
    q, p, alpha = 1 - 2 / (span + 1), 1 - 2 / (signal + 1), 2 / (signal + 1)
    if q == p:
        return alpha * (j + 1) * F.pow(F.lit(q), j + 1)
    return (F.pow(F.lit(p), j + 1) - F.pow(F.lit(q), j + 1)) * (alpha * q / (p - q))


def _block_ends(built: DataFrame, columns: list[str]) -> DataFrame:
    """(ticker, block) with the values of ``columns`` on the last row; one row per block."""
    return built.groupBy("ticker", BLOCK).agg(*[F.max_by(c, POSITION).alias(c) for c in columns])


def rsi_columns(frame: DataFrame, value: str, n: int, w: WindowSpec, alias: str) -> DataFrame:
    """RSI from simple means of gains and losses; the first difference of a series counts as 0."""
    delta = F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0))
    frame = frame.withColumn("_delta", delta)
    gain = sma_column(F.greatest(F.col("_delta"), F.lit(0.0)), n, w)
    loss = sma_column(F.greatest(-F.col("_delta"), F.lit(0.0)), n, w)
    frame = frame.withColumns({"_gain": gain, "_loss": loss})
    gain, loss = F.col("_gain"), F.col("_loss")
    value_ = (
        F.when((loss == 0) & (gain > 0), F.lit(100.0))
        .when(loss == 0, F.lit(None).cast("double"))
        .otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
    )
    return frame.withColumn(alias, value_).drop("_delta", "_gain", "_loss")


def true_range_column(w: WindowSpec) -> Column:
    """Greatest of high-low and the distances to the previous close; high-low on the first row."""
    previous = F.lag("close").over(w)
    return F.greatest(
        F.col("high") - F.col("low"),
        F.abs(F.col("high") - previous),
        F.abs(F.col("low") - previous),
    )


def change_column(value: str, n: int, w: WindowSpec) -> Column:
    """Relative change over ``n`` rows; a previous value of zero gives signed infinity."""
    now, then = F.col(value), F.lag(value, n).over(w)
    infinite = (
        F.when(now > 0, F.lit(float("inf"))).when(now < 0, F.lit(float("-inf")))
    )
    return F.when(then == 0, infinite).otherwise(F.try_divide(now, then) - 1)


def sma(df: DataFrame, periods: list[int] = SMA_PERIODS, value: str = "close") -> DataFrame:
    """``sma_n`` for each period."""
    return over_series(
        df,
        lambda rows, w: rows.withColumns(
            {f"sma_{n}": sma_column(F.col(value), n, w) for n in periods}
        ),
        before=max(periods),
    )


def ema(df: DataFrame, spans: list[float] = EMA_SPANS, value: str = "close") -> DataFrame:
    """``ema_n`` for each span, over all earlier rows, in one pass whatever the spans."""
    out = df.withColumns({f"ema_{s:g}": F.col(value) for s in spans if s <= 1})
    slow = sorted({s for s in spans if s > 1})
    if not slow:
        return out
    rows = _block_rows(slow)
    local = {s: f"_local_{i}" for i, s in enumerate(slow)}

    def build(frame: DataFrame, w: WindowSpec) -> DataFrame:
        return frame.withColumns({c: local_ema(F.col(value), s, w, rows) for s, c in local.items()})

    built = stage(
        over_series(with_position(out), build, before=0, block_rows=rows, keep_block=True), "blocks"
    )
    carries = _block_ends(built, list(local.values())).select(
        "ticker", BLOCK, *[_carry(c, s, rows).alias(f"_carry{c}") for s, c in local.items()]
    )
    means = {
        f"ema_{s:g}": F.col(c) + _faded(s, _place(rows)) * F.col(f"_carry{c}")
        for s, c in local.items()
    }
    joined = built.join(carries, ["ticker", BLOCK]).withColumns(means)
    return joined.select(*[F.col(f"`{c}`") for c in [*out.columns, *means]])


def rsi(df: DataFrame, period: int = RSI_PERIOD, value: str = "close") -> DataFrame:
    return over_series(
        df, lambda rows, w: rsi_columns(rows, value, period, w, f"rsi_{period}"), before=period + 1
    )


MACD_LOCAL = ("_fast", "_slow", "_signal")


def _local_macd(frame: DataFrame, w: WindowSpec, value: str, spans: tuple, rows: int) -> DataFrame:
    fast, slow, signal = spans
    frame = frame.withColumns(
        {
            "_fast": local_ema(F.col(value), fast, w, rows),
            "_slow": local_ema(F.col(value), slow, w, rows),
        }
    )
    return frame.withColumn("_signal", local_ema(F.col("_fast") - F.col("_slow"), signal, w, rows))


def _macd_carries(ends: DataFrame, spans: tuple, rows: int, keep: list[Column]) -> DataFrame:
    """Means before each block; the signal's ends need the other two first."""
    fast, slow, signal = spans
    last = F.lit(rows - 1.0)
    both = ends.withColumns(
        {"_carry_fast": _carry("_fast", fast, rows), "_carry_slow": _carry("_slow", slow, rows)}
    )
    whole_end = (
        F.col("_signal") + F.col("_carry_fast") * _response(fast, signal, last)
        - F.col("_carry_slow") * _response(slow, signal, last)
    )
    return both.withColumn("_signal_end", whole_end).select(
        "ticker", BLOCK, "_carry_fast", "_carry_slow",
        _carry("_signal_end", signal, rows).alias("_carry_signal"), *keep,
    )


def _whole_macd(joined: DataFrame, spans: tuple, rows: int) -> DataFrame:
    fast, slow, signal = spans
    j = _place(rows)
    line = (
        F.col("_fast") - F.col("_slow") + F.col("_carry_fast") * _faded(fast, j)
        - F.col("_carry_slow") * _faded(slow, j)
    )
    mean = (
        F.col("_signal") + F.col("_carry_fast") * _response(fast, signal, j)
        - F.col("_carry_slow") * _response(slow, signal, j)
        + F.col("_carry_signal") * _faded(signal, j)
    )
    joined = joined.withColumns({"macd": line, "macd_signal": mean})
    return joined.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def macd(df: DataFrame, spans: tuple = MACD_SPANS, value: str = "close") -> DataFrame:
    """``macd``, ``macd_signal`` and ``macd_histogram``, for any spans above 1, in one pass."""
    rows = _block_rows(spans)
    built = stage(
        over_series(
            with_position(df), lambda frame, w: _local_macd(frame, w, value, spans, rows),
            before=0, block_rows=rows, keep_block=True,
        ),
        "blocks",
    )
    carries = _macd_carries(_block_ends(built, list(MACD_LOCAL)), spans, rows, [])
    whole = _whole_macd(built.join(carries, ["ticker", BLOCK]), spans, rows)
    return whole.select(*df.columns, "macd", "macd_signal", "macd_histogram")


def _bollinger_columns(frame, w, value, n, k) -> DataFrame:
    middle = sma_column(F.col(value), n, w)
    width = rolling(F.stddev_samp, F.col(value), n, w) * k
    frame = frame.withColumns({"bb_middle": middle, "_dev": width})
    frame = frame.withColumns(
        {
            "bb_upper": F.col("bb_middle") + F.col("_dev"),
            "bb_lower": F.col("bb_middle") - F.col("_dev"),
        }
    ).drop("_dev")
    span = F.col("bb_upper") - F.col("bb_lower")
    return frame.withColumn("bb_width", F.try_divide(span, F.col("bb_middle")))


def bollinger(
    df: DataFrame, period: int = BOLLINGER[0], num_std: float = BOLLINGER[1], value: str = "close"
) -> DataFrame:
    """``bb_upper``, ``bb_middle``, ``bb_lower`` and ``bb_width`` with the sample deviation."""
    return over_series(
        df, lambda rows, w: _bollinger_columns(rows, w, value, period, num_std), before=period
    )


def true_range(df: DataFrame) -> DataFrame:
    return over_series(
        df, lambda rows, w: rows.withColumn("true_range", true_range_column(w)), before=1
    )


def _atr_columns(frame, w, n) -> DataFrame:
    frame = frame.withColumn("_tr", true_range_column(w))
    return frame.withColumn(f"atr_{n}", sma_column(F.col("_tr"), n, w)).drop("_tr")


def atr(df: DataFrame, period: int = ATR_PERIOD) -> DataFrame:
    """Simple mean of the true range."""
    return over_series(df, lambda rows, w: _atr_columns(rows, w, period), before=period + 1)


def _signed_volume(w: WindowSpec) -> Column:
    step = F.coalesce(F.col("close") - F.lag("close").over(w), F.lit(0.0))
    return F.signum(step).cast("long") * F.col("volume")


def _obv_in_block(w: WindowSpec, rows: int) -> Column:
    """Running sum of ``_sv`` over the own rows of a block; the block's base is added later."""
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.when(is_own(rows), F.col("_sv")).otherwise(F.lit(0))).over(frame)


def _obv_base() -> Column:
    """Volume signed in all earlier blocks, from the running sums at the ends of the blocks."""
    earlier = Window.partitionBy("ticker").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_obv").over(earlier), F.lit(0)).alias("_obv_base")


def _whole_obv() -> Column:
    """The result is a double, as in the contract."""
    return (F.col("_obv") + F.col("_obv_base")).cast("double")


def obv(df: DataFrame) -> DataFrame:
    """On-balance volume: running sum of volume signed by the price move; starts at 0."""

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("_sv", _signed_volume(w))
        return rows.withColumn("_obv", _obv_in_block(w, BLOCK_ROWS))

    built = stage(over_series(with_position(df), build, before=1, keep_block=True), "blocks")
    bases = _block_ends(built, ["_obv"]).select("ticker", BLOCK, _obv_base())
    joined = built.join(bases, ["ticker", BLOCK]).withColumn("obv", _whole_obv())
    return joined.select(*df.columns, "obv")


def volume_ma(df: DataFrame, period: int = VOLUME_PERIOD) -> DataFrame:
    return over_series(
        df,
        lambda rows, w: rows.withColumn(
            f"volume_ma_{period}", sma_column(F.col("volume"), period, w)
        ),
        before=period,
    )


def difference(df: DataFrame, value: str = "close", alias: str = "diff") -> DataFrame:
    """First difference, null on the first row of a series."""
    return over_series(
        df,
        lambda rows, w: rows.withColumn(alias, F.col(value) - F.lag(value).over(w)),
        before=1,
    )


def returns(df: DataFrame) -> DataFrame:
    """``price_change`` over one row and ``price_change_5d`` over five."""
    return over_series(
        df,
        lambda rows, w: rows.withColumns(
            {
                "price_change": change_column("close", 1, w),
                "price_change_5d": change_column("close", 5, w),
            }
        ),
        before=5,
    )


def _target_columns(rows: DataFrame, w: WindowSpec, horizon: int) -> DataFrame:
    future = F.lead("close", horizon).over(w)
    rises = F.coalesce(future > F.col("close"), F.lit(False))
    return rows.withColumns({"close_future": future, "target": rises.cast("long")})


def add_indicators(df: DataFrame, horizon: int | None = None) -> DataFrame:
    """All 19 indicator columns, and with ``horizon`` the target, in one pass over the blocks.

    The rows shuffle twice: once for their positions, once into blocks with the few earlier rows
    that trailing frames reach. The blocks are stored; exponential means and OBV then add what the
    earlier blocks carry, from one row per block.
    """
    built = stage(indicator_blocks(with_position(df), horizon), "blocks")
    whole = with_carries(built, _block_ends(built, END_COLUMNS))
    carried = [c for c in df.columns if c not in INDICATOR_COLUMNS]
    labels = [] if horizon is None else ["close_future", "target"]
    return whole.select(*carried, *INDICATOR_COLUMNS, *labels)


LOCAL = {s: f"_local_{s}" for s in EMA_SPANS}
END_COLUMNS = ["_obv", *LOCAL.values(), *MACD_LOCAL]
SPANS = [*EMA_SPANS, *MACD_SPANS]
REACH = max(SMA_PERIODS) + 1  # earlier rows that trailing frames may need


def indicator_blocks(placed: DataFrame, horizon: int | None = None) -> DataFrame:
    """Positioned bars in blocks with all indicators, exponential means and OBV as yet per block."""
    rows = _block_rows(SPANS)

    def build(frame: DataFrame, w: WindowSpec) -> DataFrame:
        close = F.col("close")
        frame = frame.withColumns(
            {f"sma_{n}": sma_column(close, n, w) for n in SMA_PERIODS}
            | {c: local_ema(close, s, w, rows) for s, c in LOCAL.items()}
            | {
                f"volume_ma_{VOLUME_PERIOD}": sma_column(F.col("volume"), VOLUME_PERIOD, w),
                "price_change": change_column("close", 1, w),
                "price_change_5d": change_column("close", 5, w),
                "_sv": _signed_volume(w),
            }
        )
        frame = frame.withColumn("_obv", _obv_in_block(w, rows))
        frame = rsi_columns(frame, "close", RSI_PERIOD, w, f"rsi_{RSI_PERIOD}")
        frame = _local_macd(frame, w, "close", MACD_SPANS, rows)
        frame = _bollinger_columns(frame, w, "close", *BOLLINGER)
        frame = _atr_columns(frame, w, ATR_PERIOD)
        return frame if horizon is None else _target_columns(frame, w, horizon)

    return over_series(placed, build, REACH, horizon or 0, block_rows=rows, keep_block=True)


def with_carries(built: DataFrame, ends: DataFrame) -> DataFrame:
    """The blocks with what earlier blocks carry on; ``ends`` has one row per (ticker, block)."""
    rows = _block_rows(SPANS)
    carries = _macd_carries(
        ends, MACD_SPANS, rows,
        [_obv_base(), *[_carry(c, s, rows).alias(f"_carry{c}") for s, c in LOCAL.items()]],
    )
    return _whole_macd(built.join(carries, ["ticker", BLOCK]), MACD_SPANS, rows).withColumns(
        {
            f"ema_{s}": F.col(c) + _faded(s, _place(rows)) * F.col(f"_carry{c}")
            for s, c in LOCAL.items()
        }
        | {"obv": _whole_obv()}
    )


def continued_indicators(bars: DataFrame, carry: DataFrame) -> DataFrame:
    """All indicators of ``bars``, which follow the rows that ``carry`` stands for.

    ``carry`` has per ticker the last ``REACH`` bars (``tail``) and the exponential means, the MACD
    signal and the OBV at the last of them. Its tickers get a block before their new bars: the tail
    ends it, so that frames reach back, and the carried values are its end. A ticker without carry
    starts anew. Adds ``_pos``; positions count from the block.
    """
    rows = _block_rows(SPANS)
    columns = bars.columns
    seeds = carry.join(bars.select("ticker").distinct(), "ticker", "left_semi")
    known = seeds.select("ticker", F.lit(rows).alias("_before"))
    placed = with_position(bars).join(known, "ticker", "left").withColumn(
        POSITION, F.col(POSITION) + F.coalesce("_before", F.lit(0))
    ).drop("_before").withColumn("_old", F.lit(False))
    tails = seeds.select("ticker", F.size("tail").alias("_n"), F.posexplode("tail").alias("_i", "_bar"))
    old = tails.select(
        "ticker", *[F.col(f"_bar.{c}").alias(c) for c in BAR_COLUMNS],
        (F.lit(rows) - F.col("_n") + F.col("_i")).cast("long").alias(POSITION),
        F.lit(True).alias("_old"),
    )
    both = placed.unionByName(old, allowMissingColumns=True)
    built = stage(indicator_blocks(both).filter(~F.col("_old")), "blocks")
    fast, slow, _ = MACD_SPANS
    begin = seeds.select(
        "ticker", F.lit(0).cast("long").alias(BLOCK), F.col("obv").alias("_obv"),
        *[F.col(f"ema_{s}").alias(c) for s, c in LOCAL.items()],
        F.col(f"ema_{fast}").alias("_fast"), F.col(f"ema_{slow}").alias("_slow"),
        F.col("macd_signal").alias("_signal"),
    )
    whole = with_carries(built, _block_ends(built, END_COLUMNS).unionByName(begin))
    return whole.select(*columns, *INDICATOR_COLUMNS, POSITION)


def add_target(df: DataFrame, horizon: int = HORIZON, tail: str = "zero") -> DataFrame:
    """``close_future`` and ``target``: 1 when the close ``horizon`` rows ahead is higher, else 0.

    The last ``horizon`` rows of a series have no future close: ``tail="zero"`` labels them 0,
    ``tail="drop"`` removes them.
    """
    labelled = over_series(
        df, lambda rows, w: _target_columns(rows, w, horizon), before=0, after=horizon
    )
    return with_tail(labelled, tail)


def with_tail(labelled: DataFrame, tail: str) -> DataFrame:
    """Keep (``zero``) or drop (``drop``) the rows without a future close."""
    if tail not in ("zero", "drop"):
        raise ValueError(f"tail must be 'zero' or 'drop', not {tail!r}")
    return labelled if tail == "zero" else labelled.filter(F.col("close_future").isNotNull())


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Rows without any null in ``subset`` (all columns by default)."""
    return df.na.drop("any", subset=subset)


def training_table(bars: DataFrame, horizon: int = HORIZON, tail: str = "zero") -> DataFrame:
    """Bars to indicators to target, without warm-up rows."""
    labelled = with_tail(add_indicators(bars, horizon), tail)
    return drop_nulls(labelled.drop("close_future"))


def sequences(df: DataFrame, features: list[str], length: int, target: str = "target") -> DataFrame:
    """One row per label: the ``length`` feature rows before it, oldest first, and the label.

    A series of n rows gives n - length sequences. Each row is copied ``length`` times by nature;
    select only the feature columns that are needed.
    """

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        steps = F.collect_list(F.array(*[F.col(c).cast("double") for c in features]))
        return rows.withColumn("sequence", steps.over(w.rowsBetween(-length, -1)))

    built = over_series(
        df.select("ticker", "date", *features, target), build, before=length,
        block_rows=max(BLOCK_ROWS, 4 * length),
    )
    return built.filter(F.size("sequence") == length).select(
        "ticker", "date", "sequence", F.col(target).alias("label")
    )
