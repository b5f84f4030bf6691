"""Event and directive sources: decoding, validation, quarantine, facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.schemas import DIRECTIVE, DIRECTIVE_TYPES, ENVELOPE, PAYLOADS


def tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """A1: Parquet tables of a folder, with the schema the files have; filters and columns reach the scan."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def kafka(spark: SparkSession, servers: str, topics: str, *, headers: bool = False, start: str = "latest") -> DataFrame:
    """A stream of messages. The connector is a package of its own; without it Spark says which one is missing."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", start).option("includeHeaders", str(headers).lower()).load()


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*", files_a_trigger: int = 100) -> DataFrame:
    """A3 over files: Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def decoded(messages: DataFrame, value: str = "value") -> DataFrame:
    """A4, A5: envelopes of JSON messages, with `problem`: what a message lacks, null for good ones."""
    e = F.from_json(F.col(value).cast("string"), ENVELOPE, {"mode": "PERMISSIVE"}).alias("e")
    out = messages.select(F.col(value).cast("string").alias("raw"), e).select("raw", "e.*")
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    problem = F.when(~filled("type"), "no type").when(~filled("infoHash"), "no infoHash").when(F.coalesce("timestamp", F.lit(0)) == 0, "no timestamp").when(~F.col("type").isin(*PAYLOADS), "unknown type")
    return out.withColumn("problem", problem)


def accepted(events: DataFrame) -> DataFrame:
    return events.filter("problem is null").drop("problem", "raw")


def quarantined(events: DataFrame) -> DataFrame:
    """Messages that were not accepted, as they came, with the reason."""
    return events.filter("problem is not null").select("raw", "problem")


def payload(events: DataFrame, kind: str) -> DataFrame:
    """Events of one type with their payload's fields; absent numbers stay null."""
    body = F.from_json("data", PAYLOADS[kind])
    rows = events.filter(F.col("type") == kind)
    return rows.select(F.col("infoHash").alias("info_hash"), F.col("userId").alias("user_id"), F.timestamp_millis("timestamp").alias("ts"), body.alias("p")).select("info_hash", "user_id", "ts", "p.*")


def facts(events: DataFrame) -> dict[str, DataFrame]:
    """A fact table for each kind of event that has one; counts that are absent are 0."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).alias
    added = payload(events, "torrent:added").select("info_hash", "user_id", "name", number("size")("size"), number("fileCount")("file_count"), "state", "ts")
    done = payload(events, "torrent:completed").select("info_hash", "user_id", "name", number("size")("size"), number("downloadTime")("download_time"), number("averageSpeed")("average_speed"), number("totalPieces")("total_pieces"), F.coalesce(F.timestamp_millis("completedAt"), "ts").alias("completed_at"))
    progress = payload(events, "torrent:progress").select("info_hash", "user_id", number("progress")("progress"), number("downloadSpeed")("download_speed"), number("uploadSpeed")("upload_speed"), number("peers")("peers"), number("downloaded")("downloaded"), number("uploaded")("uploaded"), "ts")
    joined = payload(events, "peer:connected").select("info_hash", "user_id", "ip", "port", F.lit("connected").alias("action"), "ts")
    left = payload(events, "peer:disconnected").select("info_hash", "user_id", "ip", "port", F.lit("disconnected").alias("action"), "ts")
    pieces = payload(events, "piece:completed").select("info_hash", "user_id", F.col("pieceIndex").alias("piece_index"), number("totalPieces")("total_pieces"), number("completedPieces")("completed_pieces"), "ts")
    every = events.select("type", F.col("infoHash").alias("info_hash"), F.col("userId").alias("user_id"), "data", F.timestamp_millis("timestamp").alias("ts"))
    return {"torrents": added, "torrent_completions": done, "torrent_progress_snapshots": progress, "peer_connections": joined.unionByName(left), "piece_completions": pieces, "torrent_events": every}


def header(name: str, headers: str = "headers"):
    """The text of the last header of a name, null without one."""
    found = F.filter(F.col(headers), lambda h: h["key"] == name)
    return F.element_at(F.when(F.size(found) > 0, found), -1)["value"].cast("string")


def directives(messages: DataFrame, value: str = "value") -> DataFrame:
    """Directives of JSON messages, their type being the header's if there is one; problem says why one is refused."""
    d = F.from_json(F.col(value).cast("string"), DIRECTIVE).alias("d")
    said = header("type") if "headers" in messages.columns else F.lit(None).cast("string")
    out = messages.select(d, said.alias("said")).select("d.*", "said")
    out = out.withColumn("type", F.coalesce("said", "type")).drop("said")
    problem = F.when(~F.coalesce(F.col("type").isin(*DIRECTIVE_TYPES), F.lit(False)), "unknown type").when(~F.coalesce(F.startswith(F.trim("payload"), F.lit("{")), F.lit(False)), "payload is no object").when(F.col("timestamp").isNull(), "no timestamp")
    return out.withColumn("problem", problem)


def messages(events: DataFrame, key: str, topic: str | None = None, headers: tuple[str, ...] = (), raw: str | None = None) -> DataFrame:
    """Key, value (JSON of each row, or a column's bytes as they are), topic and headers, as a Kafka sink takes them; a topic column goes by itself."""
    rest = [c for c in events.columns if c != "topic"]
    name = F.lit(topic) if topic else F.col("topic")
    value = F.col(raw).cast("binary") if raw else F.to_json(F.struct(*rest))
    more = [F.array(*(F.struct(F.lit(h).alias("key"), F.col(h).cast("string").cast("binary").alias("value")) for h in headers)).alias("headers")] if headers else []
    return events.select(F.col(key).cast("string").alias("key"), value.alias("value"), name.alias("topic"), *more)


def fact_sink(path: str):
    """A writer of batches of messages: each fact table of a batch under the batch's number, so that one that comes again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        good = accepted(decoded(batch)).persist()
        try:
            for name, rows in facts(good).items():
                rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            good.unpersist()

    return write


def saved(rows: DataFrame, folder: str, number: int) -> None:
    """A snapshot: the rows as documents, and how many there are."""
    n = rows.count()
    exported(rows).unionByName(rows.sparkSession.createDataFrame([(f'{{"version":1,"rows":{n}}}',)], "value string")).write.mode("overwrite").text(f"{folder}/snapshot={number}")


def restored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of the newest snapshot of which no document is malformed, of another version or missing; older ones are its backups."""
    rows = spark.read.schema("value string, snapshot int").text(folder)
    d = F.from_json("value", f"version int, rows long, row struct<{schema}>", {"mode": "PERMISSIVE"})
    parsed = rows.select("snapshot", d.alias("d"))
    whole = parsed.groupBy("snapshot").agg(F.min(F.coalesce(F.col("d.version") == 1, F.lit(False))).alias("good"), F.max("d.rows").alias("rows"), F.count("d.row").alias("n"))
    best = whole.filter("good and rows = n").agg(F.max("snapshot").alias("snapshot"))
    return parsed.join(best, "snapshot").filter("d.row is not null").select("d.row.*")


def exported(rows: DataFrame) -> DataFrame:
    """Each row as a versioned JSON document."""
    return rows.select(F.to_json(F.struct(F.lit(1).alias("version"), F.struct(*rows.columns).alias("row"))).alias("value"))


def imported(documents: DataFrame, schema: str) -> DataFrame:
    """Rows of exported documents; one that is malformed or of another version fails the read."""
    parsed = documents.select(F.from_json("value", f"version int, row struct<{schema}>", {"mode": "FAILFAST"}).alias("d"))
    wrong = F.raise_error(F.lit("document of another version"))
    return parsed.select(F.when(F.col("d.version") == 1, F.col("d.row")).otherwise(wrong).alias("row")).select("row.*")
