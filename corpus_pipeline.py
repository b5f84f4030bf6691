"""Raw documents to mixed, encoded training data, in five stages.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and gives
a DataFrame with the columns of documents, the last one the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import stages

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("near_duplicates", stages.near_duplicates),
    ("repeated_passages", stages.repeated_passages),
    ("mixture", stages.mixture),
    ("encoded", stages.encoded),
]

#: Kneser-Ney bands and BPE have no SQL form; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents of sf_dir."""
    return stages.run_stages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir, STAGES)
