"""Content-addressed store and readers of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.functions.codecs import read_artifact


def addressed(rows: DataFrame, data: str) -> DataFrame:
    """Content with its hash and shard (first two digits), each content once."""
    out = rows.filter(F.col(data).isNotNull()).select(F.col(data).cast("binary").alias("data")).withColumn("sha256", F.sha2("data", 256))
    return out.dropDuplicates(["sha256"]).withColumn("shard", F.substring("sha256", 1, 2))


def put(rows: DataFrame, path: str, data: str = "data") -> None:
    """Add content that the store lacks; putting it again changes nothing."""
    new = addressed(rows, data)
    try:
        known = rows.sparkSession.read.parquet(path).select("sha256")
        new = new.join(known, "sha256", "left_anti")
    except Exception as e:  # a store that is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").partitionBy("shard").parquet(path)


def get(spark: SparkSession, path: str, hashes: DataFrame | None = None) -> DataFrame:
    """sha256, data and whether the data still has that hash; shards prune the scan where hashes are given as literals."""
    out = spark.read.parquet(path)
    if hashes is not None:
        out = out.join(hashes.select("sha256").distinct(), "sha256", "left_semi")
    return out.select("sha256", "data", (F.sha2("data", 256) == F.col("sha256")).alias("intact"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as rows: path and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def artifacts(spark: SparkSession, path: str, pattern: str = "*.torrent") -> DataFrame:
    """The record of each metadata file of a folder."""
    return files(spark, path, pattern).select("path", read_artifact("content").alias("a")).select("path", "a.*")


def put_artifacts(rows: DataFrame, path: str, data: str = "data") -> None:
    """L4: each metadata file of a column as a file of its own; the writer's line end is the `e` that ends the dictionary."""
    own = rows.select(F.expr(f"cast(substring(`{data}`, 1, octet_length(`{data}`) - 1) AS string)").alias("value"))
    own.write.option("lineSep", "e").option("maxRecordsPerFile", 1).text(path)


def pieces(rows: DataFrame, data: str, length: int) -> DataFrame:
    """Rows cut to pieces: piece number, its bytes and their SHA-1; the last one is what remains."""
    count = F.ceil(F.octet_length(data) / length).cast("int")
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1))
    out = rows.select("*", F.explode(at).alias("piece"))
    return out.withColumn("bytes", F.substring(F.col(data), F.col("piece") * length + 1, F.lit(length))).withColumn("sha1", F.sha1("bytes")).drop(data)


def byte_range(parts: DataFrame, data: str, start: int, end: int) -> DataFrame:
    """Bytes [start, end) of files laid end to end (columns start, end and data), one row."""
    hit = parts.filter((F.col("start") < end) & (F.col("end") > start))
    a = F.greatest(F.lit(start), F.col("start"))
    cut = F.substring(F.col(data), (a - F.col("start") + 1).cast("int"), (F.least(F.lit(end), F.col("end")) - a).cast("int"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("start", F.hex(cut).alias("hex")))), lambda r: r["hex"])
    return hit.agg(F.unhex(F.array_join(rows, "")).alias("data"))


def assembled(blocks: DataFrame, key: str) -> DataFrame:
    """Pieces put together from blocks (offset, data, seq): the first block at each offset counts; with SHA-1."""
    once = blocks.groupBy(key, "offset").agg(F.min_by("data", "seq").alias("data"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("offset", F.hex("data").alias("hex")))), lambda r: r["hex"])
    whole = once.groupBy(key).agg(F.unhex(F.array_join(rows, "")).alias("data"))
    return whole.withColumn("sha1", S.sha1_hex("data"))
