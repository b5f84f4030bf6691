"""Operator 10: mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target of words (`targets`); of it, whole epochs come first
(every document taken once each), and the rest of the target is filled from
the source's documents in the order of exponential keys -ln(u) / weight: u is a
uniform number from a digest of seed and doc_id, weight the document's quality,
so reruns agree and better documents come earlier. The document on which the
budget falls is taken in part, so that a source's words are exactly its target
rounded down.

Order and prefix sums need no source in one task: keys fall into `BINS` equal
parts of (0, 1) by 1 - exp(-key), words are summed by (source, bin), and only
the bin in which a budget runs out is ordered by document. A source with a
third of all rows is many bins.

Edge cases: null and empty texts have size 0 and are taken 0 words; a null
source is a source of its own, last in order; equal keys are ordered by doc_id,
then by size; repeated rows count as documents of their own; an empty table
gives an empty mix; columns of the input with the names added here give way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.store import keep, table, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Parts of the key range; the summed table has at most sources x BINS rows.
BINS = 4096
SEED = "mix-1"
#: Weight of a document by the mean quality label: WORST at 0, BEST at 1, PLAIN without label.
WORST, PLAIN, BEST = 0.5, 1.0, 2.0


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: share of all words by weight, none above most times its size, the excess reshared.

    Sources in order of cap by weight fill up one after the other; those from the
    first on whose share of what is left is no more than its cap get that share.
    """
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # windows over sources, not documents
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    rows = rows.withColumn("_w", F.get(F.lit(list(map(float, weights))), F.pmod(nth - 1, F.lit(len(weights)))))
    cap = F.lit(float(most)) * F.col("source_size")
    order = W.orderBy(cap / F.col("_w"), F.col("source").asc_nulls_last())
    before, on = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(W.partitionBy()) - F.lit(float(most)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rows = rows.select("source", "source_size", "_w", cap.alias("_cap"), left.alias("_left"), F.sum("_w").over(on).alias("_open"), F.row_number().over(order).alias("_k"))
    fits = F.col("_left") * F.col("_w") / F.col("_open") <= F.col("_cap")
    rows = rows.withColumn("_level", F.min(F.when(fits, F.struct("_k", "_left", "_open"))).over(W.partitionBy()))
    filled = F.col("_level").isNull() | (F.col("_k") < F.col("_level._k"))
    return rows.select("source", "source_size", F.when(filled, F.col("_cap")).otherwise(F.col("_level._left") * F.col("_w") / F.col("_level._open")).alias("target"))


def uniform(seed: str, key: Column) -> Column:
    """(0, 1) from the first 52 bits of md5(seed:key)."""
    digest = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def mix(sized: DataFrame, weight: str, seed: str = SEED, bins: int = BINS, shares: DataFrame | None = None) -> DataFrame:
    """sized (doc_id, source, size and more) with source_size, target and taken.

    weight names the column of quality weights (null or not positive: PLAIN).
    """
    shares = shares if shares is not None else keep(targets(sized), "mix-targets")
    added = {"source_size", "target", "taken", "_key", "_bin", "_rest", "_before", "_epochs"}
    rows = sized.select(*[c for c in sized.columns if c not in added])
    usable = F.when(F.col(weight) > 0, F.col(weight).cast("double")).otherwise(F.lit(PLAIN))
    # a row a source: Spark broadcasts them if they are few, and splits a source's rows if not
    rows = rows.alias("d").join(shares.alias("s"), F.expr("d.source <=> s.source")).select("d.*", "s.source_size", "s.target")
    rows = rows.withColumn("_key", -F.log(uniform(seed, F.col("doc_id"))) / usable)
    rows = rows.withColumn("_bin", F.least(F.floor((1 - F.exp(-F.col("_key"))) * bins), F.lit(bins - 1)).cast("int"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("_epochs", whole).withColumn("_rest", F.floor("target").cast("long") - F.col("_epochs") * F.col("source_size"))
    rows = keep(rows, "mix-keys")
    sums = rows.groupBy("source", "_bin").agg(F.sum("size").alias("n"), F.first("_rest").alias("rest"))
    order = W.partitionBy("source").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    # a budget runs out in one bin of each source: that one alone is ordered
    cut = sums.filter((F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("n") >= F.col("rest"))).select("source", F.col("_bin").alias("cut"), "_before")
    rows = rows.alias("d").join(cut.alias("c"), F.expr("d.source <=> c.source"), "left").select("d.*", "c.cut", "c._before")
    split = rows.filter(F.col("_bin") == F.col("cut"))
    inner = W.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ahead = F.col("_before") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - ahead))
    split = split.withColumn("taken", F.col("_epochs") * F.col("size") + part)
    other = rows.filter(F.col("cut").isNull() | (F.col("_bin") != F.col("cut")))
    other = other.withColumn("taken", F.col("_epochs") * F.col("size") + F.when(F.col("_bin") < F.col("cut"), F.col("size")).otherwise(0))
    return other.unionByName(split).drop("_key", "_bin", "_rest", "_before", "_epochs", "cut")


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id and weight: one row for each labelled document, however often it is labelled."""
    mean = F.avg(F.col("quality").cast("double"))
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.lit(WORST) + mean * (BEST - WORST), F.lit(PLAIN)).alias("_weight"))


def weighed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return docs.drop("_weight").join(quality_weights(labels), "doc_id", "left")


def copies(mixed: DataFrame, text: str = "text", size: str = "size", taken: str = "taken") -> DataFrame:
    """The mix itself: a row for each whole repeat of a document, and one for its part, if any.

    mixed has size, taken and text. The text of a part is its first words, joined by one space.
    """
    nth = unused(mixed.columns, "_copy")[0]
    times = F.when(F.col(size) > 0, F.ceil(F.col(taken) / F.col(size))).otherwise(0).cast("int")
    rows = mixed.filter(times > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), times)))
    take = F.least(F.col(size), F.col(taken) - (F.col(nth) - 1) * F.col(size)).cast("int")
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), F.lit(1), take), " ")
    return rows.withColumn(text, F.when(take < F.col(size), head).otherwise(F.col(text))).drop(nth)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", size_of(F.col("text")).alias("size"))
    docs = keep(docs, "mix-sizes")
    mixed = mix(weighed(docs, table(spark, sf_dir, "labels")), "_weight")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: Filling up to a level: sources in order of cap by weight, those before the level stand at their caps.
ORACLE_SQL = {
    "op10_mixing": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, list_value({", ".join(f"{w}::DOUBLE" for w in WEIGHTS)})[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS w FROM d GROUP BY source),
o AS (SELECT *, {MOST} * source_size AS cap,
  {SHARE} * sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER (ORDER BY {MOST} * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER (ORDER BY {MOST} * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
  row_number() OVER (ORDER BY {MOST} * source_size / w, source NULLS LAST) AS k FROM s),
lv AS (SELECT min(k) AS k FROM o WHERE rest * w / open <= cap),
t AS (SELECT o.source, o.source_size, CASE WHEN lv.k IS NULL OR o.k < lv.k THEN o.cap ELSE l.rest * o.w / l.open END AS target FROM o CROSS JOIN lv LEFT JOIN o l ON l.k = lv.k),
q AS (SELECT doc_id, {WORST} + avg(quality::DOUBLE) * ({BEST} - {WORST}) AS weight FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
k AS (SELECT d.*, t.source_size, t.target, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS epochs,
  -ln((('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / coalesce(q.weight, {PLAIN}) AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN q USING (doc_id))
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size
  - coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken FROM k
"""
}
