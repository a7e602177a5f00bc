"""Scanning a repository: its files with their hashes, less what policy and ignore rules leave out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strataloom.functions.policy import EXCLUDED_DIRECTORIES, exclusion_reason, exclusion_root
from strataloom.functions.text import ancestors


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(regular expression over a relative path, whether it ignores) of each line of an ignore file."""
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if not line or line.startswith("#"):
            continue
        keeps = line.startswith("!")
        line = line[1:] if keeps else line.removeprefix("\\")
        folder = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        line = line.lstrip("/")
        out, i = [], 0
        while i < len(line):
            if line.startswith("**/", i):
                out.append("(?:.*/)?")
                i += 3
            elif line.startswith("/**", i) and i + 3 == len(line):
                out.append("/.*")
                i += 3
            elif line[i] == "*":
                out.append("[^/]*")
                i += 1
            elif line[i] == "?":
                out.append("[^/]")
                i += 1
            elif line[i] == "[" and "]" in line[i + 2 :]:
                end = line.index("]", i + 2)
                out.append("[" + line[i + 1 : end].replace("!", "^", 1) + "]")
                i = end + 1
            else:
                out.append(re.escape(line[i]))
                i += 1
        rules.append(("^" + ("" if anchored else "(?:.*/)?") + "".join(out) + ("/" if folder else "$"), not keeps))
    return rules


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether a path or a directory above it is ignored; the last rule that fits decides."""
    if not rules:
        return F.lit(False)

    def decided(p: Column, is_folder: bool) -> Column:
        text = F.concat(p, F.lit("/"))
        fits = lambda r: (text.rlike(r) if is_folder else F.lit(False)) if r.endswith("/") else p.rlike(r)
        return F.coalesce(*(F.when(fits(r), F.lit(x)) for r, x in reversed(rules)), F.lit(False))

    above = F.filter(ancestors(path), lambda a: a != "")
    return F.exists(above, lambda a: decided(a, True)) | decided(path, False)


LISTED = "rel_path string, modified timestamp, bytes long, content binary"
#: Bytes of contents that one batch of a listing holds before it is handed on.
_BATCH_BYTES = 32 << 20


def listing(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """rel_path, modified, bytes and content of every file below ``root``, hidden and empty ones too.

    The driver lists the first level only; what is below is walked and read by the tasks. Larger
    files than ``max_bytes`` aren't read nor told of, and contents in excluded directories are null.
    ``root`` is a path or URI of a file system that all executors reach.
    """
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root)
    base = base.rstrip("/")
    first = [(x.path, x.type == fs.FileType.Directory) for x in system.get_file_info(fs.FileSelector(base, recursive=False))]
    excluded = frozenset(EXCLUDED_DIRECTORIES)

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(root)
        rows, held = [], 0
        for batch in batches:
            for top, is_folder in zip(batch.path, batch.folder):
                todo = [system.get_file_info(top)] if not is_folder else list(system.get_file_info(fs.FileSelector(top, recursive=False)))
                while todo:
                    x = todo.pop()
                    if x.type == fs.FileType.Directory:
                        todo += system.get_file_info(fs.FileSelector(x.path, recursive=False))
                        continue
                    if x.type != fs.FileType.File or max_bytes is not None and x.size > max_bytes:
                        continue
                    relative = x.path[len(base) + 1 :]
                    content = None
                    if not excluded & set(relative.split("/")[:-1]):
                        with system.open_input_stream(x.path) as f:
                            content = f.read()
                    rows.append((relative, x.mtime, x.size, content))
                    held += len(content or b"")
                    if held > _BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=["rel_path", "modified", "bytes", "content"])
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["rel_path", "modified", "bytes", "content"])

    tops = spark.createDataFrame(first, "path string, folder boolean")
    return tops.repartition(max(1, min(len(first), 1_000)), "path").mapInPandas(run, LISTED)


def scan(spark: SparkSession, root: str, cache_key: str, ignore_text: str = "", max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Files to be indexed, and the paths left out with their reasons.

    Ignored paths are left out silently; those below an excluded directory are one path.
    """
    rows = listing(spark, root, max_bytes).where(~ignored(F.col("rel_path"), ignore_rules(ignore_text))).withColumn("reason", exclusion_reason(F.col("rel_path")))
    kept = rows.where("reason IS NULL").select(F.lit(cache_key).alias("cache_key"), "rel_path", "bytes", "content", F.sha2("content", 256).alias("sha256"), "modified")
    path = F.col("rel_path")
    out = rows.where("reason IS NOT NULL").select("reason", F.coalesce(exclusion_root(path), path).alias("path")).distinct()
    return kept, out


def changed(now: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of ``now`` whose hash isn't that of ``before`` at the same path, and those that are kept."""
    same = before.select("cache_key", "rel_path", "sha256").distinct()
    keys = ["cache_key", "rel_path", "sha256"]
    return now.join(same, keys, "left_anti"), now.join(same, keys, "left_semi")


def reused(kept_files: DataFrame, old_rows: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Rows of an incremental index: the old ones of unchanged files and the new ones of the others."""
    old = old_rows.join(kept_files.select("cache_key", F.col("rel_path").alias("file_path")).distinct(), ["cache_key", "file_path"], "left_semi")
    return old.unionByName(new_rows, allowMissingColumns=True)
