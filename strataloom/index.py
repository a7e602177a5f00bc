"""Building a repository's index: scan, read, resolve and store, all or only what changed.

Tables of the store: files, symbols, observed, imports, references, calls, edges and coverage. An
incremental run reads the contents of changed files only; what was observed in the others is
taken from the store, and everything that depends on several files is resolved anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataloom.functions.languages import language_of
from strataloom.operators import extract, graph, integrity, link, observe
from strataloom.runtime import cut
from strataloom.sources import manifests, scan
from strataloom.sources.store import Store


@dataclass
class Indexed:
    """What a run did: the version, how many files it has, and how many of them it read."""

    version: str
    files: int
    read: int
    symbols: int
    edges: int
    excluded: int
    fresh: bool = False


def control_rows(spark: SparkSession, listed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Go modules, TypeScript configs and packages out of the control files among ``listed``.

    Control files are few and at most 1 MiB each; they are parsed where they are read.
    """
    found = listed.where(F.col("rel_path").rlike(r"(^|/)(go\.(mod|work)|package\.json|[tj]sconfig\.json)$") & (F.length("content") <= manifests.MAX_BYTES))
    schema = "cache_key string, directory string, what string, name string, value string"

    def run(batches):
        import json

        import pandas as pd

        for rows in batches:
            out = []
            for key, path, content in zip(rows.cache_key, rows.rel_path, rows.content):
                folder, _, name = path.rpartition("/")
                try:
                    read = manifests.go_mod if name.startswith("go.") else manifests.package_json if name == "package.json" else manifests.tsconfig
                    value = read(bytes(content))
                except ValueError:
                    continue
                out.append((key, folder, name, value.get("module") if name.startswith("go.") else value.get("name"), json.dumps(value)))
            yield pd.DataFrame(out, columns=["cache_key", "directory", "what", "name", "value"])

    rows = cut(found.select("cache_key", "rel_path", "content").mapInPandas(run, schema))
    get = lambda p, t: F.from_json(F.get_json_object("value", p), t)
    go = rows.where("what LIKE 'go.%'").select("cache_key", "directory", F.col("name").alias("module"), get("$.replace", "map<string,string>").alias("replaces"), F.when(F.col("what") == "go.work", get("$.use", "array<string>")).alias("uses"))
    configs = rows.where("what LIKE '%sconfig.json'").select("cache_key", "directory", F.get_json_object("value", "$.baseUrl").alias("base_url"), F.coalesce(get("$.paths", "map<string,array<string>>"), F.create_map().cast("map<string,array<string>>")).alias("paths"), F.get_json_object("value", "$.plugins").isNotNull().alias("unsupported"))
    packages = rows.where("what = 'package.json' AND name IS NOT NULL").select("cache_key", "directory", "name", F.get_json_object("value", "$.exports").alias("exports"), F.get_json_object("value", "$.imports").alias("imports"), F.get_json_object("value", "$.main").alias("main"))
    return link.go_modules(go, listed), configs.dropDuplicates(["cache_key", "directory"]), packages.dropDuplicates(["cache_key", "directory"])


def sections_of(files: DataFrame) -> DataFrame:
    """Markdown sections of ``files``, as :mod:`strataloom.operators.extract` has them."""
    rows = files.where(language_of(F.lit(None).cast("string"), F.col("rel_path")) == "markdown").withColumn("language", F.lit("markdown"))
    return extract.over_files(rows.withColumn("file_id", F.xxhash64("cache_key", "rel_path")), extract.markdown_sections, extract.SECTION)


def derived(seen: DataFrame, files: DataFrame, controls: tuple[DataFrame, DataFrame, DataFrame]) -> dict[str, DataFrame]:
    """Symbols, imports, references, calls and edges out of observations of all files."""
    plain = files.withColumn("language", F.lit(None).cast("string"))
    symbols = cut(observe.symbols_of(seen).unionByName(observe.file_nodes(plain)))
    imports = cut(link.resolved_imports(seen, files, *controls))
    surface = cut(link.export_surface(*link.export_rules(seen, imports)))
    references = cut(link.resolved_references(seen, imports, surface, symbols))
    calls = cut(link.resolved_calls(seen, references, symbols))
    edges = link.import_edges(imports).unionByName(link.reference_edges(references, seen, symbols)).unionByName(link.call_edges(calls))
    return {"symbols": symbols, "imports": imports, "references": references, "calls": calls, "edges": edges.dropDuplicates(["cache_key", *graph.EDGE_KEY])}


def build(spark: SparkSession, root: str, store: Store, ignore_text: str = "", incremental: bool = True) -> Indexed:
    """Index the repository at ``root`` into ``store``; with ``incremental`` only changed files are read.

    If nothing changed, the stored version stays. Overlapping roots of other repositories are refused.
    """
    key = Store.key(root)
    listed = scan.listing(spark, root).withColumn("cache_key", F.lit(key))
    kept, out = scan.scan(spark, root, key, ignore_text)
    others = [(k, v["path"]) for k, v in store.catalog().items() if k != key and v.get("path")]
    both = integrity.root_overlaps(spark.createDataFrame([(key, root), *others], "cache_key string, path string"))
    if both.where((F.col("cache_key") == key) | (F.col("outer_key") == key)).count():
        raise ValueError(f"{root} overlaps an indexed repository")
    now = cut(kept.select("cache_key", "rel_path", "bytes", "sha256"))
    before, old = (store.load(root, "files"), store.load(root, "observed")) if incremental else (None, None)
    if before is None or old is None:
        changed, seen = kept, None
    else:
        fresh, same = scan.changed(now, before)
        gone = before.join(now.select("cache_key", "rel_path"), ["cache_key", "rel_path"], "left_anti")
        inputs = controls_of(listed)
        held = store.load(root, "controls")
        same_inputs = held is not None and integrity.snapshot_diff(held, inputs).count() == 0
        if not fresh.count() and not gone.count() and same_inputs:
            catalog = store.catalog()[key]
            return Indexed(catalog["version"], now.count(), 0, store.load(root, "symbols").count(), store.load(root, "edges").count(), out.count(), True)
        changed = kept.join(fresh.select("cache_key", "rel_path"), ["cache_key", "rel_path"], "left_semi")
        seen = old.join(same.select("cache_key", F.col("rel_path").alias("file_path")), ["cache_key", "file_path"], "left_semi")
    read = cut(observe.observed(changed.withColumn("language", F.lit(None).cast("string"))))
    every = cut(read if seen is None else seen.unionByName(read))
    tables = derived(every, kept.select("cache_key", "rel_path", "content", "sha256"), control_rows(spark, listed))
    coverage = integrity.coverage(listed)
    version = store.write(root, {"files": now, "observed": every, "sections": sections_of(kept), "coverage": coverage, "controls": controls_of(listed), **tables})
    return Indexed(version, now.count(), changed.count(), tables["symbols"].count(), tables["edges"].count(), out.count())


def controls_of(listed: DataFrame) -> DataFrame:
    """cache_key, path and hash of all control files."""
    found = listed.where(F.col("rel_path").rlike(r"(^|/)(go\.(mod|work)|package\.json|[tj]sconfig\.json|Cargo\.toml|pnpm-workspace\.yaml)$"))
    return found.select("cache_key", F.col("rel_path").alias("path"), F.sha2("content", 256).alias("hash"))


def ensure_fresh(spark: SparkSession, root: str, store: Store, ignore_text: str = "") -> Indexed:
    """The index of ``root``, built or brought up to date if its files aren't those of the store.

    A run that another one has begun and not ended is seen by its pending marker, and refused.
    """
    if Store.key(root) in store.pending():
        raise RuntimeError(f"{root} is being indexed")
    return build(spark, root, store, ignore_text)
