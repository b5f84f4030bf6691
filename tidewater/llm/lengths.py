"""Operator 6: exact histogram of encoded lengths, answering every context limit.

Documents are aggregated by their number of tokens (one row for each length
that occurs: map-side sums, so a length shared by a third of all documents is
one row a task), and suffix sums over lengths give, for every limit L that
occurs, how many documents and tokens lie at or above it; from a row one reads
the number of documents, the total, quantiles and the tokens left when every
document is cut to L. Any other limit is answered by `totals`, from the row next above it.

Suffix sums run in two steps, within blocks of `BLOCK` lengths and over the
blocks' sums, so no task holds all lengths.

Edge cases: null and empty texts have length 0 and are counted; an empty table
gives no rows; ties are summed; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm import bpe
from tidewater.llm.store import keep, table

BLOCK = 256


def histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """length, n_docs, n_tokens (of them), docs_at_least, tokens_at_least, truncated_tokens, quantile.

    truncated_tokens: all tokens left if documents are cut to `length`;
    quantile: share of documents no longer than `length`.
    """
    by = lengths.groupBy(F.coalesce(F.col(length), F.lit(0)).cast("long").alias("length")).agg(F.count("*").alias("n_docs"))
    by = by.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("_block", F.floor(F.col("length") / BLOCK))
    # a row for each length: written once, so that documents are not encoded again for the blocks
    by = keep(by, "length-histogram")
    blocks = by.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("n_tokens").alias("_t"))
    # blocks of blocks: a single ordered window over their sums, length / BLOCK of them
    later = W.orderBy(F.col("_block").desc()).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_dl"), F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_tl"), F.sum("_d").over(W.partitionBy()).alias("_all"), F.sum("_t").over(W.partitionBy()).alias("_sum"))
    own = W.partitionBy("_block").orderBy(F.col("length").desc()).rowsBetween(W.unboundedPreceding, 0)
    out = by.withColumn("_d", F.sum("n_docs").over(own)).withColumn("_t", F.sum("n_tokens").over(own)).join(blocks, "_block")
    out = out.select(
        "length",
        "n_docs",
        "n_tokens",
        (F.col("_d") + F.col("_dl")).alias("docs_at_least"),
        (F.col("_t") + F.col("_tl")).alias("tokens_at_least"),
        "_all",
        "_sum",
    )
    cut = F.col("_sum") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")
    quantile = (F.col("_all") - F.col("docs_at_least") + F.col("n_docs")) / F.col("_all")
    return out.select("length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least", cut.cast("long").alias("truncated_tokens"), quantile.alias("quantile"))


def _at_or_above(hist: DataFrame, edges: list, column: str) -> list:
    """For each of the ascending edges the first row of hist (by length) with column at or above it, None if there is none.

    Each row of the histogram goes to the one edge that it is next above, so it
    is read once, and a row an edge reaches the driver.
    """
    place = F.size(F.filter(F.array(*(F.lit(x) for x in edges)), lambda x: x <= F.col(column)))
    first = hist.groupBy(place.alias("at")).agg(F.min(F.struct("length", "n_docs", "docs_at_least", "tokens_at_least")).alias("r")).collect()
    found, out = {r["at"]: r["r"] for r in first}, []
    last = None
    for at in range(len(edges), 0, -1):
        last = found.get(at, last)
        out.append(last)
    return out[::-1]


def totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents, tokens, documents longer than it, tokens after cutting to it.

    All are read off the suffix sums of the row at or above the limit.
    """
    asked = sorted({0, *map(int, limits)})
    found = dict(zip(asked, _at_or_above(hist, asked, "length"), strict=True))
    rows, whole = [], found[0]
    for x in sorted(set(map(int, limits))) if whole else []:
        r = found[max(x, 0)]
        docs, tokens = (r.docs_at_least, r.tokens_at_least) if r else (0, 0)
        longer = docs - (r.n_docs if r and r.length == x else 0)
        rows.append((x, whole.docs_at_least, whole.tokens_at_least, longer, whole.tokens_at_least - tokens + x * docs))
    return hist.sparkSession.createDataFrame(rows, "context long, n_docs long, n_tokens long, longer long, truncated_tokens long")


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least the given share of documents does not exceed."""
    asked = sorted(set(map(float, shares)))
    found = _at_or_above(hist, asked, "quantile")
    return hist.sparkSession.createDataFrame([(x, r.length) for x, r in zip(asked, found, strict=True) if r], "share double, length long")


def op6_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of the documents' lengths in tokens of the word-level BPE, over all whole texts."""
    docs = bpe.count(table(spark, sf_dir, "documents").select("text")).select("n_tokens")
    return histogram(docs)
