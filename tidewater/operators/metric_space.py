"""Nearest neighbours and buckets in the 160-bit XOR metric (F10, F11, J)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import scalars as S

BUCKET = 8


def nearest(nodes: DataFrame, target: str, k: int = 8, node: str = "id") -> DataFrame:
    """the k nodes nearest to a target id; distances are compared word by word."""
    words = S.xor_words(F.col(node), F.lit(target))
    out = nodes.select("*", *(w.alias(f"d{i}") for i, w in enumerate(words)))
    return out.orderBy(*(f"d{i}" for i in range(S.WORDS)), node).limit(k)


def nearest_unasked(nodes: DataFrame, asked: DataFrame, target: str, k: int = 3, node: str = "id") -> DataFrame:
    """F11."""
    return nearest(nodes.join(asked.select(node), node, "left_anti"), target, k, node)


def id_in_bucket(own: Column, bucket: Column, seed: Column) -> Column:
    """An id whose distance to own has its highest bit at bucket, the rest of it by a digest of the seed."""
    noise = S.id_words(F.sha1(seed.cast("string").cast("binary")))
    words = []
    for i, (a, b) in enumerate(zip(S.id_words(own), noise, strict=True)):
        # the bit's place in this word: below 0 if it lies in a later word, from 32 on if in an earlier one
        at = bucket - 32 * (S.WORDS - 1 - i)
        low = F.when(at < 0, 0).when(at >= 32, b).otherwise(b.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int")) - 1) + F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int")))
        words.append(F.lower(F.lpad(F.hex(a.bitwiseXOR(low.cast("long"))), 8, "0")))
    return F.concat(*words)


def bucketed(nodes: DataFrame, own: str, node: str = "id") -> DataFrame:
    """Nodes with the bucket of their distance to own; own itself left out."""
    return nodes.filter(F.col(node) != own).withColumn("bucket", S.bucket_index(F.col(node), F.lit(own)))


def table(seen: DataFrame, own: str, first_seen: str, last_seen: str, node: str = "id", size: int = BUCKET) -> DataFrame:
    """Members of a routing table: of each bucket the size nodes first met; latest contact decides their order (position)."""
    once = bucketed(seen, own, node).groupBy(node, "bucket").agg(F.min(first_seen).alias("first_seen"), F.max(last_seen).alias("last_seen"))
    kept = once.withColumn("_r", F.row_number().over(W.partitionBy("bucket").orderBy("first_seen", node))).filter(F.col("_r") <= size).drop("_r")
    return kept.withColumn("position", F.row_number().over(W.partitionBy("bucket").orderBy("last_seen", node)) - 1)


def table_stats(members: DataFrame, size: int = BUCKET, node: str = "id") -> DataFrame:
    """One row: nodes, buckets in use and full, mean of those in use, oldest and newest node (null in an empty table)."""
    by = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("last_seen", node)).alias("old"), F.max(F.struct("last_seen", node)).alias("new"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.count("*").alias("buckets"), F.count_if(F.col("n") >= size).alias("full"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 4).alias("mean"), F.min("old")[node].alias("oldest"), F.max("new")[node].alias("newest"))


def stale_buckets(members: DataFrame, now: Column, seconds: int = 900) -> DataFrame:
    """Buckets to refresh: in use or among the five farthest, without contact for seconds."""
    used = members.groupBy("bucket").agg(F.max("last_seen").alias("at"))
    far = members.sparkSession.range(155, 160).select(F.col("id").cast("int").alias("bucket"))
    out = far.join(used, "bucket", "full")
    return out.filter(F.col("at").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("at") > seconds)).select("bucket")


def oldest(members: DataFrame, bucket: int) -> DataFrame:
    """The member of a bucket that was silent longest."""
    return members.filter(F.col("bucket") == bucket).orderBy("last_seen", "id").limit(1)


def lookup(knows: DataFrame, start: DataFrame, target: str, k: int = 8, alpha: int = 3, rounds: int = 20) -> DataFrame:
    """Iterative lookup over edges (id, neighbour): each round asks the alpha nearest nodes not asked yet.

    It ends when k nodes are asked and two rounds brought no nearer one. Only the
    asked ids and the k nearest so far, a bounded handful, are on the driver.
    """
    spark = knows.sparkSession
    key = lambda x: int(x, 16) ^ int(target, 16)
    found = {r[0] for r in start.select("id").limit(k * alpha).collect()}
    asked: set[str] = set()
    quiet, best = 0, None
    for _ in range(rounds):
        wave = sorted(found - asked, key=key)[:alpha]
        if not wave:
            break
        asked.update(wave)
        told = knows.filter(F.col("id").isin(wave)).select(F.col("neighbour").alias("id")).distinct()
        found |= {r.id for r in nearest(told, target, k).select("id").collect()}
        found = asked | set(sorted(found, key=key)[: k * alpha])
        now = min(map(key, found))
        quiet = quiet + 1 if best is not None and now >= best else 0
        best = now if best is None else min(best, now)
        if len(asked) >= k and quiet >= 2:
            break
    rows = sorted(found, key=key)[:k]
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(rows)], "id string, rank int")
