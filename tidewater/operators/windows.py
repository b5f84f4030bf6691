"""Computations over ordered rows (E): trailing sums, runs, rings, shares, buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import scalars as S


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _seconds(ts: str) -> Column:
    return _micros(ts) / 1e6


def trailing_speed(df: DataFrame, keys: Sequence[str], ts: str, value: str, seconds: float, round_to: int = 4) -> DataFrame:
    """Bytes of the last seconds over the time since the first of them; 0 without duration."""
    out = df.withColumn("_at", _micros(ts))
    w = W.partitionBy(*keys).orderBy("_at").rangeBetween(-int(seconds * 1e6), 0)
    span = (F.col("_at") - F.min("_at").over(w)) / 1e6
    return out.withColumn("speed", F.round(F.when(span > 0, F.sum(value).over(w) / span).otherwise(0.0), round_to)).drop("_at")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], change: Column) -> DataFrame:
    """A running gauge and its peak so far."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = df.withColumn("gauge", F.sum(change).over(w))
    return out.withColumn("peak", F.max("gauge").over(w))


def offsets(df: DataFrame, keys: Sequence[str], order: Sequence[str], length: str) -> DataFrame:
    """Start and end of each row in the concatenation of its key's rows."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = df.withColumn("start", F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long"))
    return out.withColumn("end", F.col("start") + F.col(length))


def last_n(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The last n rows of each key; order must begin with the latest."""
    return df.withColumn("age", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("age") <= n)


def mean_of_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int = 100) -> DataFrame:
    """Mean of the last n values up to each row."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
    return df.withColumn("mean", F.round(F.avg(value).over(w), 10))


def strikes(df: DataFrame, keys: Sequence[str], ts: str, strike: Column, seconds: float, most: int) -> DataFrame:
    """E5: strikes within the last seconds and whether they call for a ban."""
    out = df.withColumn("_at", _micros(ts))
    w = W.partitionBy(*keys).orderBy("_at").rangeBetween(-int(seconds * 1e6), 0)
    return out.withColumn("strikes", F.sum(F.when(strike, 1).otherwise(0)).over(w)).withColumn("banned", F.col("strikes") >= most).drop("_at")


def _walked(rows: DataFrame, key: str, order: str, begin, step, end, schema: str) -> DataFrame:
    """Rows in order within each key through step(state, values) -> (state, row or None).

    A step depends on the one before, so a key's rows are one task's; they are
    read batch by batch, and only the state is held.
    """
    import pyarrow as pa

    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        now, state = None, None
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for values in zip(*columns, strict=True):
                if state is None or values[0] != now:
                    now, state = values[0], begin()
                state, row = step(state, values)
                if row is not None:
                    out.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), end(batch.schema), strict=True)], names=names)

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def bans(strikes_: DataFrame, key: str, ts: str, most: int = 3, window_s: float = 600.0, ban_s: float = 1800.0) -> DataFrame:
    """Key, banned_at, until: bans of each key in turn; strikes count within window_s, and from nothing after a ban."""
    import pyarrow as pa

    kind = strikes_.schema[key].dataType.simpleString()

    def step(state, values):
        (held, until), (who, t) = state, values
        if t < until:
            return state, None
        held = [x for x in held if t - x <= window_s] + [t]
        if len(held) < most:
            return (held, until), None
        return ([], t + ban_s), (who, t, t + ban_s)

    rows = strikes_.select(key, _seconds(ts).alias("_at"))
    return _walked(rows, key, "_at", lambda: ([], float("-inf")), step, lambda schema: (schema.types[0], pa.float64(), pa.float64()), f"{key} {kind}, banned_at double, until double")


def failure_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], success: Column) -> DataFrame:
    """Failures in a row up to each row, and WORKING, WARNING (2) or ERROR (5)."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = df.withColumn("_ok", success.cast("int")).withColumn("_island", F.sum("_ok").over(w))
    inner = W.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("failures", F.sum(1 - F.col("_ok")).over(inner))
    state = F.when(F.col("failures") >= 5, "ERROR").when(F.col("failures") >= 2, "WARNING").otherwise("WORKING")
    return out.withColumn("state", state).drop("_ok", "_island")


def token_bucket(requests: DataFrame, key: str, tick: str, wanted: str, rate: float, capacity: float) -> DataFrame:
    """Bytes granted to each request, in order of ticks of 0.1 s: a bucket refilled by rate / 10 a tick, partial grants, first come first served."""
    import pyarrow as pa

    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}

    def step(state, values):
        (tokens, last), (who, t, want) = state, values
        if last is not None:
            tokens = min(capacity, tokens + rate * 0.1 * (t - last))
        got = min(tokens, want)
        return (tokens - got, t), (who, t, want, got)

    rows = requests.select(key, tick, wanted)
    return _walked(rows, key, tick, lambda: (capacity, None), step, lambda schema: (*schema.types[:3], pa.float64()), f"{key} {kinds[key]}, {tick} {kinds[tick]}, {wanted} {kinds[wanted]}, granted double")


def per_second(df: DataFrame, keys: Sequence[str], ts: str, value: str, width: str = "1 second") -> DataFrame:
    """Sums by whole second (or another width)."""
    return df.groupBy(*keys, F.window(ts, width).alias("w")).agg(F.round(F.sum(value), 4).alias("total")).select(*keys, F.col("w.start").alias("at"), "total")


def admitted(df: DataFrame, keys: Sequence[str], most: int, *order: Column) -> DataFrame:
    """Place of each row in its queue (from 0) and whether it is admitted."""
    out = df.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
    return out.withColumn("admitted", F.col("position") < most)


def deltas(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Value less the one before; null for the first."""
    return df.withColumn("delta", F.col(value) - F.lag(value).over(W.partitionBy(*keys).orderBy(*order)))


def shares(df: DataFrame, keys: Sequence[str], share: str, limit: float, own_limit: str) -> DataFrame:
    """Each row's part of a limit by share; its own limit where that is less, 0 meaning none."""
    part = F.col(share) * limit / F.nullif(F.sum(share).over(W.partitionBy(*keys)), F.lit(0))
    part = F.coalesce(part, F.lit(0.0))
    own = S.zero(own_limit)
    limited = F.when((own > 0) & (part > 0), F.least(own, part)).when(own > 0, own).otherwise(part)
    return df.withColumn("allocated", F.round(part, 6)).withColumn("effective", F.round(limited, 6))


def transitions(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, allowed: set[tuple[str, str]]) -> DataFrame:
    """The state before each row and whether that change is allowed (the first one is)."""
    before = F.lag(state).over(W.partitionBy(*keys).orderBy(*order))
    ok = F.lit(False)
    for a, b in sorted(allowed):
        ok = ok | ((F.col("previous") == a) & (F.col(state) == b))
    return df.withColumn("previous", before).withColumn("valid", F.col("previous").isNull() | (F.col("previous") == F.col(state)) | ok)


def first_reached(df: DataFrame, keys: Sequence[str], ts: str, test: Column) -> DataFrame:
    """When a condition first holds, for keys where it does."""
    return df.filter(test).groupBy(*keys).agg(F.min(ts).alias("reached_at"))


def unanswered(requests: DataFrame, responses: DataFrame, key: str, at: str, now: Column, seconds: int) -> DataFrame:
    """Requests without a response that are older than seconds."""
    open_ = requests.join(responses.select(key).distinct(), key, "left_anti")
    return open_.filter(F.unix_timestamp(now) - F.unix_timestamp(F.col(at).cast("timestamp")) > seconds)
