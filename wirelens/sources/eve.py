"""Sensor (EVE) and host (HIDS) event logs: JSON lines, read with fixed schemas."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.types import StringType, StructType

from wirelens import schemas
from wirelens.functions.time import parse_event_ts

CORRUPT = "_corrupt_record"


def read_json_lines(spark: SparkSession, path, schema: StructType) -> DataFrame:
    """All lines; an unreadable line keeps its text in ``_corrupt_record`` and nulls elsewhere."""
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def good_lines(df: DataFrame) -> DataFrame:
    """Readable lines.  Spark refuses to read the corrupt column alone (a plain count would), so
    the filter also looks at the first text column."""
    text = next(f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name != CORRUPT)
    parsed = F.length(F.coalesce(F.col(text), F.lit(""))) >= 0
    return df.where(F.col(CORRUPT).isNull() & parsed).drop(CORRUPT)


def src_eve_batch(spark: SparkSession, path) -> DataFrame:
    return read_json_lines(spark, path, schemas.EVE)


def flow_records(events: DataFrame) -> DataFrame:
    """Flow events in the flat form of ``operators.flow_records``; an event without flow data
    has zero packets and is dropped by the feature step."""
    return events.where(F.col("event_type") == "flow").select(
        "flow_id", "src_ip", F.col("dest_ip").alias("dst_ip"), "src_port", F.col("dest_port").alias("dst_port"),
        "proto", F.try_to_timestamp(F.col("timestamp")).alias("ts"),
        "flow.pkts_toserver", "flow.pkts_toclient", "flow.bytes_toserver", "flow.bytes_toclient",
        parse_event_ts(F.col("flow.start")).alias("start_us"), parse_event_ts(F.col("flow.end")).alias("end_us"),
        "flow.age")


def alert_records(events: DataFrame) -> DataFrame:
    """Alert events in the flat form of ``operators.ids_alerts``; lines that miss the time, the
    signature id, the signature or the severity are dropped."""
    flat = events.where(F.col("event_type") == "alert").select(
        F.xxhash64("timestamp", "flow_id", "src_ip", "dest_ip", "alert").alias("event_id"),
        F.try_to_timestamp(F.col("timestamp")).alias("ts"), F.col("alert.signature_id").alias("sid"),
        "alert.severity", "alert.signature", "alert.category", "src_ip", "src_port", "dest_ip", "dest_port", "proto")
    return flat.dropna(subset=["ts", "sid", "severity", "signature"])


def src_eve_alerts(spark: SparkSession, path) -> DataFrame:
    return alert_records(good_lines(src_eve_batch(spark, path)))


def _stream(spark: SparkSession, schema: StructType, max_files) -> DataStreamReader:
    reader = spark.readStream.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.option("maxFilesPerTrigger", max_files) if max_files else reader


def src_eve_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """New event files of a folder as they land; the checkpoint remembers what was read, so
    rotation needs no special care."""
    return _stream(spark, schemas.EVE, max_files).json(folder)


def src_eve_kafka(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """The same events from a Kafka topic (needs the Kafka connector on the class path)."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).options(**options).load())
    return raw.select(F.from_json(F.col("value").cast("string"), schemas.EVE).alias("e")).select("e.*")


def src_hids_alerts(spark: SparkSession, path, last: int | None = None) -> DataFrame:
    """Readable host alerts; ``last`` keeps the newest alerts only, by id."""
    alerts = good_lines(read_json_lines(spark, path, schemas.HIDS_ALERT))
    return alerts if last is None else alerts.orderBy(F.col("id").desc()).limit(last)


def src_queue(spark: SparkSession, path) -> DataFrame:
    return good_lines(read_json_lines(spark, path, schemas.QUEUE))


def hids_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    return _stream(spark, schemas.HIDS_ALERT, max_files).json(folder)
