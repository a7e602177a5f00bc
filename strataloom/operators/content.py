"""Reading text: lines that match, slices, outlines and byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataloom.functions.text import lines


def exploded_lines(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """A row for each line: the key, line_no from 1, and line."""
    return rows.select(key, F.posexplode(lines(text)).alias("at", "line")).select(key, (F.col("at") + 1).alias("line_no"), "line")


def grep(rows: DataFrame, key: str, text: Column, pattern: str) -> DataFrame:
    """Lines that a regular expression finds something in. Null texts have none."""
    F.lit("").rlike(pattern)
    return exploded_lines(rows, key, text).where(F.col("line").rlike(pattern))


def grep_context(rows: DataFrame, key: str, text: Column, pattern: str, around: int = 2) -> DataFrame:
    """Matching lines with the lines just before and after them as lists.

    The lists are slices of the text's own array of lines, so that no line is shuffled.
    """
    listed = rows.select(key, lines(text).alias("all_lines")).select(key, "all_lines", F.posexplode("all_lines").alias("at", "line")).where(F.col("line").rlike(pattern))
    first = F.greatest(F.col("at") - around, F.lit(0))
    return listed.select(key, (F.col("at") + 1).alias("line_no"), "line", F.slice("all_lines", first + 1, F.col("at") - first).alias("before"), F.slice("all_lines", F.col("at") + 2, F.lit(around)).alias("after"))


def file_slice(rows: DataFrame, key: str, text: Column, start: int, end: int) -> DataFrame:
    """Lines start..end (from 1, both included), clamped into the text."""
    all_lines = lines(text)
    total = F.coalesce(F.size(all_lines), F.lit(0))
    a = F.least(F.greatest(F.lit(start), F.lit(1)), total + 1)
    b = F.least(F.lit(end), total)
    body = F.when(b >= a, F.slice(all_lines, a, b - a + 1)).otherwise(F.array().cast("array<string>"))
    return rows.select(key, total.alias("total_lines"), F.array_join(body, "\n").alias("body"))


def byte_ranges(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """The bytes of each symbol out of its file's content, null where there is no such file.

    Offsets count from 0; what lies behind the content's end is cut off.
    """
    at = (symbols.cache_key == files.cache_key) & (symbols.file_path == files.rel_path)
    part = F.substring(files.content, (F.col("byte_offset") + 1).cast("int"), F.col("byte_length").cast("int"))
    return symbols.join(files, at, "left").select(symbols["*"], part.alias("body"))


def outline(symbols: DataFrame) -> DataFrame:
    """A row for each file: its symbols in order of line and offset, as kind, name and line."""
    entry = F.struct("line", "byte_offset", "ord", "kind", "name")
    listed = symbols.where("kind <> 'file'").groupBy("cache_key", "file_path").agg(F.sort_array(F.collect_list(entry)).alias("entries"), F.count("*").alias("symbols"))
    text = F.transform("entries", lambda e: F.concat_ws(" ", e["line"].cast("string"), e["kind"], e["name"]))
    return listed.select("cache_key", "file_path", "symbols", F.array_join(text, "\n").alias("outline"))


def symbol_context(symbols: DataFrame, files: DataFrame, around: int) -> DataFrame:
    """The lines of each symbol with ``around`` more on both sides, and which lines they are."""
    lined = files.select("cache_key", "rel_path", lines(F.make_valid_utf8(F.col("content").cast("string"))).alias("all_lines"))
    counted = symbols.join(lined, (symbols.cache_key == lined.cache_key) & (symbols.file_path == lined.rel_path)).select("ord", "line", "end_line", "all_lines")
    first = F.greatest(F.col("line") - around, F.lit(1))
    last = F.least(F.greatest(F.col("end_line"), F.col("line")) + around, F.size("all_lines"))
    body = F.when(last >= first, F.array_join(F.slice("all_lines", first, last - first + 1), "\n")).otherwise(F.lit(""))
    return counted.select("ord", first.alias("from_line"), last.alias("to_line"), body.alias("body"))


def numbered(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """One page of ordered rows with next_offset, null on the last page.

    One row more than the page is looked at to know whether another page follows.
    """
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit is 1..500 and offset at least 0")
    ahead = rows.orderBy(*order).offset(offset).limit(limit + 1)
    ranked = ahead.withColumn("__n", F.row_number().over(Window.orderBy(*order)))
    more = F.max(F.col("__n")).over(Window.partitionBy()) > limit
    return ranked.withColumn("next_offset", F.when(more, F.lit(offset + limit))).where(F.col("__n") <= limit).drop("__n")
