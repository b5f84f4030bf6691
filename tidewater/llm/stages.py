"""Stages of the corpus pipeline: documents in, documents out, each by one operator.

What holds for all: columns of documents, extra ones included, come out as they
went in, whatever they are called; null and empty texts, null ids, languages and
sources, repeated rows and very long texts are documents like others; an empty
table gives an empty one. Executors return free heap before each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm import bpe, jaccard, mixing, perplexity, substrings
from tidewater.llm.store import aside, give_back, keep, table, unused
from tidewater.session import fresh_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band.

    Null and empty texts go, as they have too few words; a null language is a
    language; repeated rows are judged alike.
    """
    give_back(spark)
    own, back = aside(docs, [*perplexity.BASE, "base_failed", "kept", "log_perplexity", "_model", "_low", "_high"])
    return back(perplexity.judge(own).filter("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles: the one with the least doc_id.

    A null id is the last; of repeated rows (id and text) one stays; texts without
    words link with nothing, and all of their rows stay.
    """
    give_back(spark)
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that start earlier elsewhere; n_chars follows the text.

    Null texts stay null, with 0 characters; of rows with one id and text none is
    the earlier one; no document goes, even if none of its words is left.
    """
    give_back(spark)
    own, back = aside(docs, substrings.ADDED)
    return _counted(back(substrings.strip(own)))


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: rows of documents as often as they are taken, a part for the last of a source.

    Shares are dealt over doc_id, source and size alone; texts are joined once, to
    their rows' shares. Rows alike in doc_id, text and source are numbered, so
    each gets its own. Texts without words are taken no times; a null source is a
    source; a null or repeated id is a document's own.
    """
    give_back(spark)
    ident, print_, nth, size, taken = unused(docs.columns, "_id", "_print", "_nth", "_size", "_taken")
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), mixing.size_of(F.col("text")).alias("size"), F.xxhash64("text", "source").alias("print"))
    mixed = keep(mixing.mix(mixing.weighed(keep(narrow, "mix-sizes"), table(spark, sf_dir, "labels")), "_weight").filter("taken > 0"), "mix-shares")
    shares = mixed.select(known.alias(ident), F.col("print").alias(print_), F.col("size").alias(size), F.col("taken").alias(taken))
    own = docs.withColumn(ident, known).withColumn(print_, F.xxhash64("text", "source"))
    on = [ident, print_]
    # numbering needs a sort of texts by row; without rows alike it is left out
    if not shares.groupBy(on).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        # copies share the row that is taken in part: which one gets it is settled by the rest of the row
        rest = [F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])]
        shares = shares.withColumn(nth, F.row_number().over(W.partitionBy(on).orderBy(F.desc(taken))))
        own = own.withColumn(nth, F.row_number().over(W.partitionBy(on).orderBy(rest)))
        on = [*on, nth]
    out = mixing.copies(own.join(shares, on), size=size, taken=taken)
    return _counted(out.select(*[F.col(f"`{c}`") for c in docs.columns]))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every document of the mix; a null or empty text has no ids."""
    give_back(spark)
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


def run_stages(spark: SparkSession, docs: DataFrame, sf_dir: str, stages) -> DataFrame:
    """Each stage written as Parquet to the shared folder and read again as the next one's documents."""
    for name, stage in stages:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
