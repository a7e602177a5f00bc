"""Whether the index still says what the files say: hashes, drift, coverage, overlaps, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strataloom.functions.policy import exclusion_reason, exclusion_root
from strataloom.functions.text import ancestors


def content_hashes(files: DataFrame) -> DataFrame:
    """Each file with whether its stored hash and size are those of its content."""
    size = F.length("content")
    return files.select("file_id", (F.sha2("content", 256) == F.col("sha256")).alias("hash_matches"), (F.col("bytes").isNull() | (F.col("bytes") == size)).alias("size_matches"), size.cast("long").alias("size"))


def verify_symbols(symbols: DataFrame, files: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """The first thing wrong with each symbol, null if nothing is.

    In this order: source_file_missing, name_not_in_bytes (files, nodes of packages and crates and
    pages with a made-up name needn't hold theirs), signature_not_in_bytes (headings of markdown
    only) and content_drift, where the bytes in ``live`` (the same files if not given) don't have
    the symbol's content_hash any more; of a file or such a node, the whole file counts. A
    symbol without a hash or without a live file hasn't drifted. Offsets past the end give empty
    bytes.
    """
    at = (symbols.cache_key == files.cache_key) & (symbols.file_path == files.rel_path)
    part = lambda content: F.substring(content, (F.col("byte_offset") + 1).cast("int"), F.col("byte_length").cast("int"))
    whole = F.col("kind").isin("file", "package", "crate")
    if live is None:
        found = symbols.join(files, at, "left").select(symbols["*"], part(files.content).alias("body"), files.content.isNotNull().alias("has"), F.sha2(F.when(whole, files.content).otherwise(part(files.content)), 256).alias("now"))
    else:
        now = live.select(F.col("cache_key").alias("l_key"), F.col("rel_path").alias("l_path"), F.col("content").alias("l_content"))
        there = symbols.join(files, at, "left").select(symbols["*"], part(files.content).alias("body"), files.content.isNotNull().alias("has"))
        found = there.join(now, (there.cache_key == now.l_key) & (there.file_path == now.l_path), "left").withColumn("now", F.sha2(F.when(whole, F.col("l_content")).otherwise(part(F.col("l_content"))), 256))
    text = F.decode("body", "UTF-8")
    made_up = F.coalesce(F.col("metadata.markdown.synthetic_name"), F.lit(False)) if "metadata" in symbols.columns else F.lit(False)
    heading = (F.col("language") == "markdown") & F.ltrim(F.coalesce("signature", F.lit(""))).startswith("#")
    problem = (
        F.when(~F.coalesce("has", F.lit(False)), "source_file_missing").when(~whole & ~made_up & (F.coalesce("name", F.lit("")) != "") & ~text.contains(F.col("name")), "name_not_in_bytes")
        .when(heading & ~text.contains(F.col("signature")), "signature_not_in_bytes").when((F.coalesce("content_hash", F.lit("")) != "") & (F.col("now") != F.col("content_hash")), "content_drift")
    )
    return found.select("ord", problem.alias("problem"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that were added, removed or changed between two sets of (cache_key, path, hash)."""
    a, b = before.withColumnRenamed("hash", "old_hash"), after.withColumnRenamed("hash", "new_hash")
    both = a.join(b, ["cache_key", "path"], "full_outer")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed")
    return both.withColumn("change", change).where(F.col("change").isNotNull()).select("cache_key", "path", "change")


def diff_samples(diff: DataFrame, most: int = 20) -> DataFrame:
    """Per repository and change the count and the first paths.

    Candidates for the first paths are taken in each hash bucket before they come together.
    """
    salted = diff.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(32)))
    near = salted.withColumn("n", F.row_number().over(Window.partitionBy("cache_key", "change", "salt").orderBy("path"))).where(F.col("n") <= most)
    listed = near.groupBy("cache_key", "change").agg(F.slice(F.sort_array(F.collect_list("path")), 1, most).alias("first"))
    counted = diff.groupBy("cache_key", "change").agg(F.count("*").alias("paths"))
    return counted.join(listed, ["cache_key", "change"]).select("cache_key", "change", "paths", F.array_join("first", "\n").alias("sample"), F.greatest(F.col("paths") - most, F.lit(0)).alias("omitted"))


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Endpoints of edges that are no node, and how many edges end there."""
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).where("id IS NOT NULL AND id <> ''").groupBy("id").agg(F.count("*").alias("edges"))
    return ends.join(nodes.select("id").distinct(), "id", "left_anti")


def root_overlaps(repositories: DataFrame) -> DataFrame:
    """Repository roots that lie inside another's: each path is joined by its ancestors."""
    roots = repositories.select("cache_key", F.regexp_replace("path", "/+$", "").alias("path")).where("path <> ''")
    up = roots.select("cache_key", "path", F.explode(ancestors(F.col("path"))).alias("above"))
    inner = up.join(roots.select(F.col("cache_key").alias("outer_key"), F.col("path").alias("above")), "above")
    return inner.select("cache_key", "path", "outer_key", F.col("above").alias("outer_path"))


def coverage(files: DataFrame, most: int = 20) -> DataFrame:
    """Per repository and reason how many paths aren't read, with the first of them.

    Paths below an excluded directory are counted as that directory, once.
    """
    path = F.col("rel_path")
    rows = files.select("cache_key", exclusion_reason(path).alias("reason"), F.coalesce(exclusion_root(path), path).alias("path")).where("reason IS NOT NULL").distinct()
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(32)))
    near = salted.withColumn("n", F.row_number().over(Window.partitionBy("cache_key", "reason", "salt").orderBy("path"))).where(F.col("n") <= most)
    listed = near.groupBy("cache_key", "reason").agg(F.slice(F.sort_array(F.collect_list("path")), 1, most).alias("first"))
    counted = rows.groupBy("cache_key", "reason").agg(F.count("*").alias("paths"))
    return counted.join(listed, ["cache_key", "reason"]).select("cache_key", "reason", "paths", F.array_join("first", "\n").alias("sample"))


def overlay_merge(overlays: DataFrame) -> DataFrame:
    """Attributes of nodes merged over their overlays: the first value (by namespace) wins.

    Columns: id, attribute, value, conflict (whether another overlay says otherwise).
    """
    pairs = overlays.select("id", "namespace", F.explode(F.from_json("attributes", "map<string,string>")).alias("attribute", "value"))
    first = F.min(F.struct("namespace", "value"))
    return pairs.groupBy("id", "attribute").agg(first.alias("first"), F.min("value").alias("low"), F.max("value").alias("high")).select("id", "attribute", F.col("first.value").alias("value"), (F.col("low") != F.col("high")).alias("conflict"))


def index_summary(symbols: DataFrame) -> DataFrame:
    """Symbols per repository by language and kind, with subtotals."""
    return symbols.rollup("cache_key", "language", "kind").agg(F.count("*").alias("symbols"), F.countDistinct("file_path").alias("files"))


def graph_health(edges: DataFrame, references: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row of counters; the status is degraded if any reference is unresolved or edge invalid."""
    from strataloom.operators.graph import validated

    checked = validated(edges, nodes).agg(F.count("*").alias("edges"), F.count("problem").alias("invalid_edges"))
    seen = references.agg(F.count("*").alias("references"), F.count_if(F.col("status") == "unresolved").alias("unresolved"))
    status = F.when((F.col("invalid_edges") > 0) | (F.col("unresolved") > 0), "degraded").otherwise("ok")
    return checked.select("edges", "invalid_edges", F.lit(1).alias("k")).join(seen.withColumn("k", F.lit(1)), "k").select("edges", "invalid_edges", "references", "unresolved", status.alias("status"))
