"""Aggregations over transfers, chunks, peers and events (D)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import scalars as S


def hourly(events: DataFrame, ts: str, completed: Column, size: str, speed: str | None = None, round_to: int = 8) -> DataFrame:
    """For each hour with events, completions, their bytes and mean speed; hours without completions give 0."""
    speed = speed or size
    pick = lambda c: F.when(completed, F.col(c))
    return events.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(
        F.count_if(completed).alias("completions"),
        F.round(F.coalesce(F.sum(pick(size)), F.lit(0.0)), round_to).alias("total_bytes"),
        F.round(F.coalesce(F.avg(pick(speed)), F.lit(0.0)), round_to).alias("average_speed"),
    )


def counted_by(df: DataFrame, keys: Sequence[str], tests: dict[str, Column], *more: Column) -> DataFrame:
    """For each key the rows, and those that pass each test."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), *(F.count_if(t).alias(name) for name, t in tests.items()), *more)


def status_histogram(df: DataFrame, key: str, status: str, values: Sequence[str], size: str, progress: str) -> DataFrame:
    """Rows by status with a column for each value, bytes and bytes done. One pass, no pivot job."""
    return counted_by(df, [key], {v: F.col(status) == v for v in values}, F.round(F.sum(size), 2).alias("total_size"), F.round(F.sum(F.col(size) * F.col(progress) / 100), 4).alias("done_size"))


def user_rollup(events: DataFrame, user: str, completed: Column, added: Column, uploaded: Column, value: str) -> DataFrame:
    """Bytes both ways, completions, additions, mean speed, and down / up (0 without uploads)."""
    down = F.coalesce(F.sum(F.when(completed, F.col(value))), F.lit(0.0))
    up = F.coalesce(F.sum(F.when(uploaded, F.col(value))), F.lit(0.0))
    out = events.groupBy(user).agg(down.alias("_down"), up.alias("_up"), F.count_if(completed).alias("completed"), F.count_if(added).alias("added"), F.round(F.coalesce(F.avg(F.when(completed, F.col(value))), F.lit(0.0)), 8).alias("average_speed"))
    return out.select(user, F.round("_down", 2).alias("downloaded"), F.round("_up", 2).alias("uploaded"), "completed", "added", "average_speed", F.round(S.ratio("_down", "_up"), 6).alias("down_per_up"))


def totals(df: DataFrame, sums: dict[str, str], round_to: int = 2) -> DataFrame:
    """One row of sums and the number of rows; 0 of nothing."""
    return df.agg(*(F.round(F.coalesce(F.sum(c), F.lit(0.0)), round_to).alias(name) for name, c in sums.items()), F.count("*").alias("rows"))


def egress(df: DataFrame, key: str, peer: str, fallback: str, cloud: str) -> DataFrame:
    """Bytes from peers (or the fallback where that is 0 or missing) and from the cloud."""
    own = F.coalesce(F.nullif(F.col(peer), F.lit(0)), F.nullif(F.col(fallback), F.lit(0)), F.lit(0))
    return df.groupBy(key).agg(F.round(F.sum(own), 2).alias("peer_bytes"), F.round(F.sum(S.zero(cloud)), 2).alias("cloud_bytes"), F.count("*").alias("swarms"))


def success_rates(df: DataFrame, key: str, success: Column) -> DataFrame:
    """Share of successes of each key, with attempts."""
    return df.groupBy(key).agg(F.count("*").alias("attempts"), F.count_if(success).alias("successes")).withColumn("success_rate", F.round(S.ratio("successes", "attempts"), 6))


def availability(df: DataFrame, piece: str, peer: str, most: int = 255) -> DataFrame:
    """Distinct peers of each piece, `most` at most."""
    return df.groupBy(piece).agg(F.least(F.count_distinct(peer), F.lit(most)).alias("availability"))


def gauge(df: DataFrame, keys: Sequence[str], up: Column, down: Column) -> DataFrame:
    """Ups less downs."""
    return df.groupBy(*keys).agg(F.sum(F.when(up, 1).when(down, -1).otherwise(0)).alias("gauge"))


def lag_seconds(df: DataFrame, added: str, now: Column) -> DataFrame:
    """The largest age in seconds, 0 of nothing and never negative."""
    age = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(F.col(added).cast("timestamp")))
    return df.agg(F.coalesce(F.max(age), F.lit(0)).alias("lag_seconds"))


def resume_state(chunks: DataFrame, transfer: str, index: str, status: Column) -> DataFrame:
    """Sorted verified, pending and failed indices, the first outstanding one, and whether all is done."""
    listed = lambda *s: F.sort_array(F.collect_list(F.when(status.isin(*s), F.col(index))))
    return chunks.groupBy(transfer).agg(
        listed("verified").alias("verified"),
        listed("pending").alias("pending"),
        listed("failed").alias("failed"),
        listed("pending", "failed").alias("outstanding"),
        F.min(F.when(status != "verified", F.col(index))).alias("resume_at"),
        F.bool_and(status == "verified").alias("complete"),
    )


def verification(df: DataFrame, keys: Sequence[str], actual: Column, expected: Column) -> DataFrame:
    """Valid, invalid and missing rows, and the share of valid ones in percent."""
    verdict = F.when(actual.isNull(), "missing").when(actual == expected, "valid").otherwise("invalid")
    out = df.groupBy(*keys).agg(F.count("*").alias("total"), *(F.count_if(verdict == v).alias(v) for v in ("valid", "invalid", "missing")))
    return out.withColumn("percent", F.round(S.ratio("valid", "total") * 100, 4))


def dedup_stats(df: DataFrame, size: str) -> DataFrame:
    """Copies saved, their bytes and MiB."""
    return df.agg(F.count("*").alias("saved"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("saved_bytes"), F.round(F.coalesce(F.sum(size), F.lit(0)) / S.MIB, 2).alias("saved_mib"))


def store_stats(df: DataFrame, hit: Column, size: str) -> DataFrame:
    """Hits, misses, hit rate as text and bytes served."""
    out = df.agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.coalesce(F.sum(F.when(hit, F.col(size))), F.lit(0)).cast("long").alias("bytes"))
    return out.withColumn("hit_rate", S.percent_text(F.col("hits"), F.col("hits") + F.col("misses")))


def complete(df: DataFrame, key: str, done: Column, skipped: Column) -> DataFrame:
    """Whether all pieces that are not skipped are done."""
    need = F.count_if(~skipped)
    return df.groupBy(key).agg(need.alias("needed"), F.count_if(done & ~skipped).alias("done"), (F.count_if(done & ~skipped) == need).alias("complete"))


def histogram(df: DataFrame, keys: Sequence[str], value: str, edges: Sequence[float]) -> DataFrame:
    """Cumulative counts by upper edge, in long form with le (null: all)."""
    counts = df.groupBy(*keys).agg(*(F.count_if(F.col(value) <= e).alias(f"_{i}") for i, e in enumerate(edges)), F.count("*").alias("_all"))
    rows = F.array(*(F.struct(F.lit(float(e)).alias("le"), F.col(f"_{i}").alias("n")) for i, e in enumerate(edges)), F.struct(F.lit(None).cast("double").alias("le"), F.col("_all").alias("n")))
    return counts.select(*keys, F.explode(rows).alias("b")).select(*keys, "b.le", "b.n")


def slow_peers(samples: DataFrame, timeouts: DataFrame, peer: str, rtt: str, limit: float = 5000.0) -> DataFrame:
    """Peers with samples whose mean round trip exceeds limit or that timed out, the slowest first."""
    mean = samples.groupBy(peer).agg(F.avg(rtt).alias("mean_rtt"), F.count("*").alias("samples"))
    out = timeouts.groupBy(peer).agg(F.count("*").alias("timeouts"))
    both = mean.join(out, peer, "left").withColumn("timeouts", F.coalesce("timeouts", F.lit(0)))
    return both.filter((F.col("mean_rtt") > limit) | (F.col("timeouts") > 0))


def outcome(requests: DataFrame, status: str, latency: str, limit_ms: float = 3000.0) -> DataFrame:
    """Requests by outcome, 99th percentile and verdict of a load test: one creation, no server error, in time."""
    s = F.col(status)
    out = requests.agg(F.count_if(s == 201).alias("created"), F.count_if(s == 200).alias("repeated"), F.count_if(s == 409).alias("in_flight"), F.count_if(s >= 500).alias("server_errors"), F.count_if(~s.isin(200, 201, 409) & (s < 500)).alias("other"), F.round(F.percentile(latency, 0.99), 6).alias("p99"))
    return out.withColumn("passed", (F.col("created") == 1) & (F.col("server_errors") == 0) & (F.coalesce("p99", F.lit(0.0)) < limit_ms))


def popcount(bitfield_hex: Column) -> Column:
    """Bits set in a bitfield given as hex."""
    return F.aggregate(F.regexp_extract_all(bitfield_hex, F.lit("([0-9A-Fa-f]{1,8})"), F.lit(1)), F.lit(0), lambda acc, h: acc + F.bit_count(F.conv(h, 16, 10).cast("long")))
