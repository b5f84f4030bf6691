"""Dashboard queries (K, E15) over metrics in long form: name, labels, ts, value and, for histograms, le."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def instant(samples: DataFrame, labels: Sequence[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """K1, K2, K4, K9: the latest sample of each series."""
    return samples.groupBy(*labels).agg(F.max_by(value, ts).alias("value"))


def summed(samples: DataFrame, labels: Sequence[str], by: Sequence[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """K3, K8: sum by some labels of the latest samples."""
    return instant(samples, labels, ts, value).groupBy(*by).agg(F.sum("value").alias("value"))


def increases(samples: DataFrame, labels: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """Growth since the sample before; after a reset of the counter, all of its value."""
    before = F.lag(value).over(W.partitionBy(*labels).orderBy(*order))
    return samples.withColumn("increase", F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before))


def rate(samples: DataFrame, labels: Sequence[str], by: Sequence[str], ts: str, order: Sequence[str], width: str, seconds: float, value: str = "value") -> DataFrame:
    """Growth per second by labels and windows of width."""
    grown = increases(samples, labels, order, value)
    return grown.groupBy(*by, F.window(ts, width).alias("w")).agg(F.round(F.sum("increase") / seconds, 8).alias("rate")).select(*by, F.col("w.start").alias("at"), "rate")


def histogram_quantile(buckets: DataFrame, by: Sequence[str], q: float) -> DataFrame:
    """K6: quantile from cumulative buckets (le, n; le null is all), linear within a bucket.

    The rank falls into the first bucket whose count reaches q of all; in the
    last, open bucket the answer is the largest finite edge, as in dashboards.
    """
    w = W.partitionBy(*by).orderBy(F.col("le").isNull(), "le")
    out = buckets.withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0)))
    out = out.withColumn("rank", F.max("n").over(W.partitionBy(*by)) * q)
    hit = out.filter((F.col("n") >= F.col("rank")) & (F.col("below") < F.col("rank")))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("below")) / (F.col("n") - F.col("below"))
    return hit.select(*by, F.round(F.coalesce(inside, F.col("low")), 6).alias("quantile"))


def gauges(df: DataFrame, labels: Sequence[str], values: dict[str, str]) -> DataFrame:
    """One row a gauge in long form from a row of values with labels."""
    rows = F.array(*(F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("value")) for name, c in values.items()))
    return df.select(*labels, F.explode(rows).alias("m")).select(*labels, "m.name", "m.value")
