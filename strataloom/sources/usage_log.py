"""Usage events as lines of JSON: appended in batches, read leniently or strictly, or streamed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "ts double, event string, repo string, session string, symbol_id string, symbol_bytes long, file_bytes long, language string, kind string, query string, search_id string, search_rank int, results array<string>, languages array<string>, miss_type string"


def append(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Events; an event without a name is a get. Broken lines are left out, or an error if ``strict``."""
    schema = SCHEMA if strict else SCHEMA + ", _broken string"
    found = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    rows = found if strict else found.where("_broken IS NULL").drop("_broken")
    return rows.withColumn("event", F.coalesce("event", F.lit("get")))


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of files, with time as event time."""
    found = spark.readStream.schema(SCHEMA).json(path)
    return found.withColumn("event", F.coalesce("event", F.lit("get"))).withColumn("time", F.timestamp_seconds("ts"))
