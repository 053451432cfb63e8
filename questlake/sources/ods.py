"""Raw event readers: parquet tables, JSON lines, and their streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from questlake.functions.scalars import iso_timestamp, payload_fields
from questlake.schema import ENVELOPE, ODS_COLUMNS, PROMOTED


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parse_envelope(lines: DataFrame, text: str = "value", on_error: str = "drop") -> DataFrame:
    """JSON lines to ODS columns.

    on_error: `drop` leaves unreadable lines out, `keep` keeps them as rows of nulls
    with `_corrupt_record`, `fail` stops at the first. A field of the wrong type is null.
    Blank lines are skipped.
    """
    fields = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in ENVELOPE) + ",_corrupt_record:string>"
    mode = "FAILFAST" if on_error == "fail" else "PERMISSIVE"
    options = {"mode": mode} | ({"columnNameOfCorruptRecord": "_corrupt_record"} if mode == "PERMISSIVE" else {})
    schema = T._parse_datatype_string(fields) if mode == "PERMISSIVE" else ENVELOPE
    rows = lines.where(F.length(F.trim(text)) > 0).select(F.from_json(text, schema, options).alias("j")).select("j.*")
    if mode == "PERMISSIVE":
        # a record counts as unreadable if nothing of the envelope could be read
        broken = F.col("event_id").isNull() & F.col("event_type").isNull() & F.col("event_time").isNull() & F.col("_corrupt_record").isNotNull()
        if on_error == "drop":
            rows = rows.where(~broken).drop("_corrupt_record")
    return flatten(rows.withColumn("event_time", iso_timestamp(F.col("event_time"))))


def flatten(rows: DataFrame) -> DataFrame:
    """Promote dungeon_id, amount_fen and online_sec from the payload (one JSON parse a row)."""
    rest = [c for c in rows.columns if c not in ODS_COLUMNS]
    base = [c for c in ODS_COLUMNS if c not in PROMOTED]
    return rows.withColumn("_p", payload_fields(F.col("payload"), **PROMOTED)).select(*base, *(F.col(f"_p.{c}").alias(c) for c in PROMOTED), *rest)


def read_ndjson(spark: SparkSession, path: str, on_error: str = "drop") -> DataFrame:
    """Batch scan of JSON-lines files."""
    return parse_envelope(spark.read.text(path), on_error=on_error)


def stream_ndjson(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None, **options: str) -> DataFrame:
    """Streaming scan of a folder of JSON-lines segments; rows that can't be parsed are dropped."""
    reader = spark.readStream.schema(schema).options(mode="DROPMALFORMED", timestampFormat="yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", **options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, start: str = "latest", max_per_trigger: int | None = None) -> DataFrame:
    """Kafka topic as a stream of key, value text, partition, offset (needs the Kafka package on the class path).

    start: `latest`, `earliest` or a JSON of offsets.
    """
    reader = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start, "failOnDataLoss": "false"})
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load().selectExpr("cast(key AS string) key", "cast(value AS string) value", "partition", "offset", "timestamp")


def bounded_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Kafka topic from the earliest offset to the end as it is at the start of the run."""
    reader = spark.read.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "endingOffsets": "latest"})
    return reader.load().selectExpr("cast(key AS string) key", "cast(value AS string) value", "partition", "offset", "timestamp")


def write_kafka(df: DataFrame, servers: str, topic: str, key: str) -> None:
    """Publish rows as JSON values with the given key column."""
    df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
