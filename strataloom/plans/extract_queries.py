"""Queries that extract from file contents and resolve what was extracted."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions.languages import language_of
from strataloom.operators import extract, resolve, tables
from strataloom.runtime import cut

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _of(spark, d, *languages):
    rows = tables.files(spark, d, "cache_key", "rel_path", "language", "content")
    return rows.where(language_of(F.col("language"), F.col("rel_path")).isin(*languages))


def _paths(spark, d):
    return tables.files(spark, d, "cache_key", "rel_path").select("cache_key", "rel_path").distinct()


def _numbered(rows, *parts):
    """import_id from what an import is: its place, path and name."""
    return rows.withColumn("import_id", F.xxhash64("cache_key", "file_path", *parts)).dropDuplicates(["import_id"])


@query
def markdown_sections(spark, d):
    return extract.over_files(_of(spark, d, "markdown"), extract.markdown_sections, extract.SECTION)


@query
def python_symbols(spark, d):
    return extract.over_files(_of(spark, d, "python"), extract.python_symbols, extract.SYMBOL)


@query
def python_calls(spark, d):
    return extract.over_files(_of(spark, d, "python"), extract.python_calls, extract.CALL)


@query
def python_imports_resolved(spark, d):
    """Python imports with their target file or the reason why there is none."""
    rows = extract.over_files(_of(spark, d, "python"), extract.python_imports, extract.IMPORT).where("problem IS NULL")
    asked = _numbered(rows, "line", "level", "module", "name").select("import_id", "cache_key", "file_path", "level", "module", "name")
    return asked.join(resolve.python_imports(asked, _paths(spark, d)), "import_id")


def _specified(spark, d, read, *languages):
    rows = extract.over_files(_of(spark, d, *languages), read, extract.SPECIFIER)
    return _numbered(rows, "line", "specifier").select("import_id", "cache_key", "file_path", "specifier", "kind")


@query
def script_imports_resolved(spark, d):
    asked = _specified(spark, d, extract.script_specifiers, "javascript", "typescript")
    return asked.join(resolve.script_imports(asked, _paths(spark, d)), "import_id")


@query
def go_imports_resolved(spark, d):
    """Go imports; the module of a repository is mod.invalid/ and its key, at the root."""
    asked = _specified(spark, d, extract.go_specifiers, "go")
    modules = _paths(spark, d).select("cache_key").distinct().select("cache_key", F.concat(F.lit("mod.invalid/"), "cache_key").alias("module"), F.lit("").alias("directory"))
    return asked.join(resolve.go_imports(asked, _paths(spark, d), modules), "import_id")


@query
def rust_imports_resolved(spark, d):
    asked = _specified(spark, d, extract.rust_specifiers, "rust")
    return asked.join(resolve.rust_imports(asked, _paths(spark, d)), "import_id")


@query
def reexport_fixpoint(spark, d):
    """Definitions that names offered by Python modules reach over re-exports."""
    offered = extract.over_files(_of(spark, d, "python"), extract.python_exports, extract.EXPORT)
    offered = cut(offered.dropDuplicates(["cache_key", "file_path", "name", "target_name", "target_module", "target_level"]))
    key = lambda path, name: F.concat_ws("::", "cache_key", path, name)
    own = offered.where("kind <> 'import'").select(key("file_path", "name").alias("source"), F.lit(None).cast("string").alias("target"))
    asked = _numbered(offered.where("kind = 'import'"), "line", "target_level", "target_module", "target_name", "name").select("import_id", "cache_key", "file_path", F.col("target_level").alias("level"), F.col("target_module").alias("module"), F.col("target_name").alias("name"), F.col("name").alias("bound"))
    found = asked.join(resolve.python_imports(asked, _paths(spark, d)).where("status = 'resolved'"), "import_id")
    found = cut(found.select("cache_key", "file_path", "target", "name", "bound"))
    links = found.where("name <> '*'").select(key("file_path", "bound").alias("source"), key("target", "name").alias("target"))
    brought = resolve.star_names(offered.where("name <> '*'"), found.where("name = '*'").select("cache_key", "file_path", "target"))
    links = links.unionByName(brought.select(key("file_path", "name").alias("source"), key("target", "name").alias("target")))
    return resolve.surface_fixpoint(own.unionByName(links))
