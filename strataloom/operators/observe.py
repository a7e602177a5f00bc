"""What files declare, import, export, bind and call: one pass of the readers over contents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strataloom.functions.languages import PROGRAMMING, language_of
from strataloom.functions.text import name_words

OBSERVED = (
    "cache_key string, file_path string, language string, source_hash string, what string, n int, name string, kind string, start long, end long, line int, end_line int, qualified_name string, inner_start long, inner_end long, active_start long, "
    "text string, path array<string>, form string, imported_name string, exported_name string, specifier string, type_only boolean, module_level boolean, doc string, decorators array<string>, metadata string, content_hash string, local_state string, local_start long, local_end long, local_kind string"
)


def _rows(key: str | None, path: str | None, language: str, content: bytes) -> list[tuple]:
    """All observations of one file, in the order of their offsets, or one row with the problem."""
    import hashlib

    from strataloom.parsing import braced, python
    from strataloom.parsing.observed import Offsets, local_state

    digest = hashlib.sha256(content).hexdigest()
    head = (key, path, language, digest)
    blank = (None,) * 27
    if language == "python":
        try:
            seen = python.read_python(language, content)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            # As the whole file can't be trusted, nothing of it is told.
            return [(*head, "problem", 0, "parse_error", *blank[1:-1])]
        byte = lambda at: at
        lines = [0, *(i + 1 for i, c in enumerate(content) if c == 10)]
        from bisect import bisect_right

        line = lambda at: bisect_right(lines, at)
    else:
        text = content.decode("utf-8", "surrogateescape")
        seen = braced.READERS[language](language, text)
        offsets = Offsets(text)
        byte, line = offsets.byte, offsets.line
    bindings: dict[str, list] = {}
    for s in seen:
        if s.what == "binding":
            bindings.setdefault(s.name, []).append(s)
    out = []
    counts: dict[str, int] = {}
    clean = lambda t: t.encode("utf-8", "replace").decode() if t else t
    for s in sorted(seen, key=lambda s: (s.what, s.start, s.end)):
        n = counts[s.what] = counts.get(s.what, -1) + 1
        state, local = (None, [])
        if s.what == "call":
            state, local = local_state(bindings.get(s.path[0], []) if s.path else [], s.path, s.form, s.inner[0])
        start, end = byte(s.start), byte(s.end)
        only = local[0] if state == "definite" else None
        body = hashlib.sha256(content[start:end]).hexdigest() if s.what == "symbol" else None
        out.append((
            *head, s.what, n, clean(s.name), s.kind, start, end, line(s.start), line(s.end), clean(s.qualified), byte(s.inner[0]) if s.inner else None, byte(s.inner[1]) if s.inner else None, byte(s.active) if s.active is not None else None,
            clean(s.text), [clean(x) for x in s.path], s.form, clean(s.imported), clean(s.exported), clean(s.specifier), s.type_only, s.module_level, clean(s.doc), list(s.decorators), json.dumps(s.metadata, sort_keys=True), body,
            state, byte(only.start) if only else None, byte(only.end) if only else None, only.kind if only else None,
        ))
    return out


def observed(files: DataFrame) -> DataFrame:
    """Everything seen in files of the programming languages, a row for each observation.

    ``what`` is symbol, import, export, binding, owner, call, reference or problem (parse_error: a
    Python file that doesn't parse tells nothing else). Null or empty contents and other languages
    give no rows; a file delivered again gives its rows again.
    """
    arrow = to_arrow_schema(StructType.fromDDL(OBSERVED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, paths, languages = (batch.column(i).to_pylist() for i in range(3))
            rows: list[tuple] = []
            for i, (key, path, language) in enumerate(zip(keys, paths, languages)):
                content = batch.column(3)[i].as_py()
                if content:
                    rows += _rows(key, path, language, content)
                if len(rows) > 20_000 or i == len(keys) - 1:
                    columns = list(zip(*rows)) if rows else [()] * len(arrow)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
                    rows = []

    rows = files.select(F.col("cache_key").cast("string"), F.col("rel_path").cast("string"), language_of(F.col("language"), F.col("rel_path")).alias("language"), F.col("content").cast("binary"))
    return rows.where(F.col("language").isin(*PROGRAMMING)).mapInArrow(run, OBSERVED)


def file_nodes(files: DataFrame) -> DataFrame:
    """A symbol of the kind file for each file of a known language, with words of its path as keywords."""
    path = F.col("rel_path")
    parts = F.regexp_extract_all(F.lower(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")), F.lit("([a-z0-9]+)"), F.lit(1))
    rows = files.withColumn("language", language_of(F.col("language"), path)).where("language IS NOT NULL AND rel_path IS NOT NULL")
    return rows.select(
        "cache_key", F.concat(path, F.lit("::__file__#file")).alias("id"), F.element_at(F.split(path, "/"), -1).alias("name"), F.lit("__file__").alias("qualified_name"), F.lit("file").alias("kind"), "language", path.alias("file_path"),
        F.lit(0).cast("long").alias("byte_offset"), F.lit(0).cast("long").alias("byte_length"), path.alias("signature"), F.lit("").alias("docstring"), F.sha2("content", 256).alias("content_hash"), F.array().cast("array<string>").alias("decorators"),
        F.array_sort(F.array_distinct(F.filter(parts, lambda w: w != "src"))).alias("keywords"), F.lit("{}").alias("metadata"), F.lit(1).alias("line"), F.lit(1).alias("end_line"),
    )


def symbols_of(seen: DataFrame) -> DataFrame:
    """Symbols with ids: ``path::qualified#kind``, the second of one id with ~1, the third with ~2."""
    rows = seen.where("what = 'symbol'")
    plain = F.concat(F.col("file_path"), F.lit("::"), F.col("qualified_name"), F.lit("#"), F.col("kind"))
    again = F.row_number().over(Window.partitionBy("cache_key", "file_path", plain).orderBy("start", "n")) - 1
    return rows.withColumn("again", again).select(
        "cache_key", F.when(F.col("again") == 0, plain).otherwise(F.concat(plain, F.lit("~"), F.col("again").cast("string"))).alias("id"), "name", "qualified_name", "kind", "language", "file_path",
        F.col("start").alias("byte_offset"), (F.col("end") - F.col("start")).alias("byte_length"), F.coalesce("text", F.lit("")).alias("signature"), F.coalesce("doc", F.lit("")).alias("docstring"), "content_hash", "decorators",
        F.array_sort(name_words(F.col("name"))).alias("keywords"), "metadata", "line", "end_line",
    )
