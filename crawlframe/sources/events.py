"""Event topics: typed decoding with defaults, keyed publishing, dead-letter envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.schemas import DEFAULTS, DLQ_TOPIC, EVENTS, REQUIRED

RECORD = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("headers", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType()),
    ]))),
])


def kafka_topic(spark: SparkSession, servers: str, topics: list[str], max_per_trigger: int = 100_000) -> DataFrame:
    """Streaming read of topics from the earliest offset, with bounded intake."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics)).option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", max_per_trigger).option("includeHeaders", "true").load()
        .withColumns({"key": F.col("key").cast("string"), "value": F.col("value").cast("string")})
    )


def file_topic(spark: SparkSession, folder: str, max_files: int = 16) -> DataFrame:
    """Streaming read of topic records kept as Parquet files."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", max_files).parquet(folder)


def _header(name: str):
    hit = F.filter(F.col("headers"), lambda h: h["key"] == name)
    return F.nullif(F.decode(F.get(hit, F.lit(0))["value"], "UTF-8"), F.lit(""))


def decode(records: DataFrame, topic: str) -> tuple[DataFrame, DataFrame]:
    """Split topic records into typed events with defaults and quarantined records.

    A record is quarantined if it is no JSON object of the schema or lacks a required field.
    """
    schema = EVENTS[topic]
    wire = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
    parsed = records.withColumn(
        "e", F.from_json("value", wire, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )
    missing = F.coalesce(
        *[F.when(F.col(f"e.{n}").isNull(), F.lit(f"missing {n}")) for n in REQUIRED[topic]]
    )
    problem = F.when(F.col("e").isNull() | F.col("e._corrupt").isNotNull(), F.lit("unreadable")).otherwise(missing)
    checked = parsed.withColumn("problem", problem)

    columns = []
    for field in schema.fields:
        value = F.col(f"e.{field.name}")
        if field.name == "event_id":
            value = F.coalesce(value, F.sha2(F.col("value"), 256))
        elif field.name == "trace_id":
            value = F.coalesce(F.nullif(value, F.lit("")), _header("trace_id"), F.lit(""))
        elif field.name == "timestamp":
            value = F.coalesce(value, F.current_timestamp())
        elif field.name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[field.name]).cast(field.dataType))
        elif isinstance(field.dataType, T.ArrayType):
            value = F.coalesce(value, F.lit([]).cast(field.dataType))
        elif isinstance(field.dataType, T.MapType):
            value = F.coalesce(value, F.create_map().cast(field.dataType))
        columns.append(value.alias(field.name))

    events = checked.filter(F.col("problem").isNull()).select(*columns)
    quarantine = checked.filter(F.col("problem").isNotNull()).select("topic", "key", "value", "problem")
    return events, quarantine


def encode(events: DataFrame, topic: str) -> DataFrame:
    """Events -> topic records keyed by canonical URL, with the trace id as a header."""
    names = [f.name for f in EVENTS[topic].fields if f.name in events.columns]
    body = F.struct(*[F.col(n) for n in names])
    header = F.struct(F.lit("trace_id").alias("key"), F.encode(F.col("trace_id"), "UTF-8").alias("value"))
    none = F.array().cast(RECORD["headers"].dataType)
    return events.select(
        F.lit(topic).alias("topic"),
        F.col("normalized_url").alias("key"),
        F.to_json(body).alias("value"),
        F.when(F.coalesce(F.col("trace_id"), F.lit("")) != "", F.array(header)).otherwise(none).alias("headers"),
    )


def dead_letters(failed: DataFrame, error: str = "error", payload: str = "payload") -> DataFrame:
    """(error, payload JSON text) rows -> dead-letter records."""
    envelope = F.concat(
        F.lit('{"error":'), F.to_json(F.col(error).cast("variant")),
        F.lit(',"payload":'), F.col(payload), F.lit("}"),
    )
    return failed.select(
        F.lit(DLQ_TOPIC).alias("topic"),
        F.lit(None).cast("string").alias("key"),
        envelope.alias("value"),
        F.array().cast(RECORD["headers"].dataType).alias("headers"),
    )


def write_records(records: DataFrame, folder: str, checkpoint: str):
    """Append streaming records to a Parquet topic folder."""
    return (
        records.writeStream.format("parquet").option("path", folder)
        .option("checkpointLocation", checkpoint).partitionBy("topic")
    )


def write_kafka(records: DataFrame, servers: str, checkpoint: str):
    """Append streaming records to Kafka topics."""
    return (
        records.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("includeHeaders", "true").option("checkpointLocation", checkpoint)
    )
