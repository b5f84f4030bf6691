"""Connected components and bounded membership filters, as joins and sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.store import drop, keep

#: Bits of a membership filter: its size whatever it is asked to hold. Full, it lets all pass.
FILTER_BITS = 1 << 26


def filter_of(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Words of a Bloom filter of the column key (hashes, long), two places a key; bits / 64 words reach the driver at most.

    The places are the key's own low and high bits: keys are hashes already.
    """
    at = keys.select(F.explode(F.array(F.expr(f"key & {bits - 1}L"), F.expr(f"shiftrightunsigned(key, 32) & {bits - 1}L"))).alias("at"))
    word = F.expr("shiftleft(1L, cast(at % 64 as int))")
    found = at.groupBy(F.expr("cast(at div 64 as int)").alias("i")).agg(F.bit_or(word).alias("w")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("i").to_numpy()] = found.column("w").to_numpy()
    return out.view(np.uint64)


def among(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (uint64) may be in the filter."""
    mask = np.uint64(len(words) * 64 - 1)
    out = np.ones(len(keys), bool)
    for at in (keys & mask, (keys >> np.uint64(32)) & mask):
        out &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def passing(spark: SparkSession, words: np.ndarray):
    """A column function of hashes: whether each may be in the filter. Only the hashes go to Python."""
    sent = spark.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def test(keys: pa.Array) -> pa.Array:
        return pa.array(among(sent.value, keys.to_numpy(zero_copy_only=False).view(np.uint64)))

    return test


def components(links: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """node and component (its least node) of every node of links (x, y), by large and small stars.

    Each round is two sums and joins by node over links alone; the links of a
    round are written to the shared folder, so no round depends on the one before,
    whose links are deleted.
    """
    edges = keep(links.select("x", "y").filter("x <> y").distinct(), name)
    before = None
    for _ in range(rounds):
        last, edges = edges, keep(_small(_large(edges)), name)
        drop(last)
        now = tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 40)))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    stars = edges.select(F.col("x").alias("node"), F.col("y").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component")).groupBy("node").agg(F.min("component").alias("component"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    out = both.filter("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return out.filter("x <> y").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    least = down.groupBy("x").agg(F.min("y").alias("m"))
    near = down.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return near.unionByName(least.select("x", F.col("m").alias("y"))).filter("x <> y").distinct()
