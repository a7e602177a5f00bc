"""The tables of the index with redeliveries taken out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strataloom.functions.languages import language_of
from strataloom.runtime import table


def files(spark: SparkSession, d: str, *columns: str, where: Column | None = None) -> DataFrame:
    """One row for each file_id. Only columns that all deliveries share should be asked for.

    ``where`` holds before redeliveries are taken out, so that nothing else is read or shuffled.
    """
    rows = table(spark, d, "files")
    return (rows if where is None else rows.where(where)).select("file_id", *columns).dropDuplicates(["file_id"])


def symbols(spark: SparkSession, d: str, *columns: str, where: Column | None = None) -> DataFrame:
    """One row for each symbol; kind in lower case without blanks, language by one name.

    ``where`` is as for :func:`files`, over the columns as they are stored.
    """
    rows = table(spark, d, "symbols")
    found = (rows if where is None else rows.where(where)).select("ord", *dict.fromkeys(["kind", "language", "file_path", *columns])).dropDuplicates(["ord"])
    named = found.withColumn("language", F.coalesce(language_of(F.col("language"), F.col("file_path")), F.lit("")))
    return named.withColumn("kind", F.lower(F.trim(F.coalesce("kind", F.lit("")))))


def edges(spark: SparkSession, d: str, *columns: str, where: Column | None = None) -> DataFrame:
    """One row for each edge_id; ``where`` is as for :func:`files`."""
    rows = table(spark, d, "edges")
    return (rows if where is None else rows.where(where)).select("edge_id", *columns).dropDuplicates(["edge_id"])


def references(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row for each ref_id."""
    return table(spark, d, "symbol_references").select("ref_id", *columns).dropDuplicates(["ref_id"])
