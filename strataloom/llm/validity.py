"""Source files that don't parse in their language, and their rates.

Every file's whole text is lexed and parsed by the table of its language's bundled grammar; the
first token at which no alternative is left is reported. Files are independent of each other, so
this is one pass over the table without a shuffle of contents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strataloom.functions.languages import PROGRAMMING, language_of
from strataloom.llm.syntax.languages import first_error

_SCHEMA = "file_id long, cache_key string, language string, rel_path string, valid boolean, error_line int, error_column int, message string"
_ARROW = pa.schema([("file_id", pa.int64()), ("cache_key", pa.string()), ("language", pa.string()), ("rel_path", pa.string()), ("valid", pa.bool_()), ("error_line", pa.int32()), ("error_column", pa.int32()), ("message", pa.string())])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        languages, paths = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        found = [first_error(language, path or "", batch.column(4)[i].as_py() or b"") for i, (language, path) in enumerate(zip(languages, paths))]
        lines, columns, messages = zip(*(x or (None, None, None) for x in found)) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array([x is None for x in found], pa.bool_()), pa.array(lines, pa.int32()), pa.array(columns, pa.int32()), pa.array(messages, pa.string())], schema=_ARROW
        )


def checked_files(files: DataFrame) -> DataFrame:
    """Each file of a programming language, once: whether it is valid, else where it first fails.

    The language is that of ``language`` in any spelling, else of the path's ending; files of no
    or another language are left out. Null or empty content is valid. Of several deliveries of
    a file_id an arbitrary one counts. An empty table gives an empty result.
    """
    rows = files.select(F.col("file_id").cast("long"), F.col("cache_key").cast("string"), language_of(F.col("language"), F.col("rel_path")).alias("language"), F.col("rel_path").cast("string"), F.col("content").cast("binary"))
    return rows.where(F.col("language").isin(*PROGRAMMING)).mapInArrow(_checked, _SCHEMA).dropDuplicates(["file_id"])


def invalid_files(files: DataFrame) -> DataFrame:
    """file_id of the files that aren't valid."""
    return checked_files(files).where(~F.col("valid")).select("file_id")


def validity_rates(files: DataFrame) -> DataFrame:
    """Files, invalid files and their rate per cache_key and language."""
    seen = checked_files(files).groupBy("cache_key", "language").agg(F.count("*").alias("files"), F.sum((~F.col("valid")).cast("long")).alias("invalid"))
    return seen.withColumn("rate", F.col("invalid") / F.col("files"))
