"""Declared extensions of the graph: rules that take attributes and edges out of pages' front matter,
and contributed nodes and edges. Rules are data; what they say is joined to symbols.

Nothing that is wrong with an extension stops the index: the record is left out, and a diagnostic
(code, namespace, subject, detail) says why.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strataloom.functions.text import is_plain_path

RESERVED = "core"
MAX_PROFILES, MAX_CONTRIBUTIONS, MAX_BYTES = 32, 256, 256 * 1024
ATTRIBUTES = "namespace string, attribute string, field string, value_type string, allowed array<string>"
EDGE_TYPES = "namespace string, edge_type string, directed boolean, allowed array<string>"
EDGE_RULES = "namespace string, edge_type string, field string, direction string"
NODES = "source string, namespace string, id string, kind string, attribute string, value string"
EDGES = "source string, namespace string, edge_index int, from_id string, to_id string, edge_type string, directed boolean, resolution string, file string, line int, content_hash string"
DIAGNOSTIC = "code string, namespace string, subject string, detail string"


def loaded(spark: SparkSession, texts: dict[str, str], most: int) -> tuple[dict[str, dict], DataFrame]:
    """The objects in control texts by source, and diagnostics of those that can't be used.

    A text has 256 KiB at most and JSON within bounds; more than ``most`` texts are an error.
    """
    from strataloom.sources.manifests import ManifestError, bounded_json

    if len(texts) > most:
        raise ValueError(f"at most {most} extension files")
    good, bad = {}, []
    for source, text in sorted(texts.items()):
        try:
            if len(text.encode()) > MAX_BYTES:
                raise ManifestError("TOO_LARGE", source)
            value = bounded_json(text)
            if not isinstance(value, dict):
                raise ManifestError("NOT_AN_OBJECT", source)
            good[source] = value
        except ValueError as e:
            bad.append(("INVALID_EXTENSION", None, source, getattr(e, "code", "INVALID_JSON")))
    return good, spark.createDataFrame(bad, DIAGNOSTIC)


def profiles(spark: SparkSession, texts: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """attribute rules, edge types, edge rules and diagnostics of profile texts.

    A namespace that two profiles have is left out altogether, and so is the reserved one and a
    profile with an edge rule of a type that it doesn't register.
    """
    good, problems = loaded(spark, texts, MAX_PROFILES)
    names = [p.get("namespace") for p in good.values()]
    attributes, types, rules, bad = [], [], [], []
    for source, p in good.items():
        space = p.get("namespace")
        registered = {t.get("type") for t in p.get("edge_types", [])}
        if not isinstance(space, str) or not space.isidentifier() or space == RESERVED:
            bad.append(("INVALID_PROFILE", space if isinstance(space, str) else None, source, "namespace"))
        elif names.count(space) > 1:
            bad.append(("DUPLICATE_NAMESPACE", space, source, None))
        elif any(r.get("type") not in registered for r in p.get("edge_rules", [])):
            bad.append(("INVALID_PROFILE", space, source, "type"))
        else:
            attributes += [(space, a["name"], a["source"].removeprefix("frontmatter."), a.get("value_type", "string"), a.get("allowed_values") or []) for n in p.get("node_rules", []) for a in n.get("attributes", [])]
            types += [(space, t["type"], t.get("directed", True), t.get("allowed_resolutions") or ["declared"]) for t in p.get("edge_types", [])]
            rules += [(space, r["type"], r["source"].removeprefix("frontmatter."), r.get("direction", "source_to_reference")) for r in p.get("edge_rules", [])]
    made = [spark.createDataFrame(x, s) for x, s in ((attributes, ATTRIBUTES), (types, EDGE_TYPES), (rules, EDGE_RULES))]
    return (*made, problems.unionByName(spark.createDataFrame(bad, DIAGNOSTIC)))


def page_roots(symbols: DataFrame) -> DataFrame:
    """Symbols that stand for their whole page."""
    return symbols.where((F.col("language") == "markdown") & F.coalesce(F.col("metadata.markdown.page_root"), F.lit(False)))


def canonical_roots(symbols: DataFrame) -> DataFrame:
    """The one root of each page: of least line, then offset, then id."""
    first = F.min(F.struct(F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("byte_offset", F.lit(0)).alias("offset"), "id")).alias("first")
    return page_roots(symbols).groupBy("cache_key", "file_path").agg(first).select("cache_key", "file_path", F.col("first.id").alias("id"))


def _values(text: Column) -> Column:
    """The texts that a front matter's value holds: of a JSON list its elements, else itself."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))


def profile_attributes(symbols: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overlay values that rules take from page roots (id, namespace, attribute, value), and diagnostics.

    A value has to be of the rule's type, not empty and, if the rule names any, one of the allowed.
    The rules are a few short rows (at most 32 files of 256 KiB), so they are broadcast.
    """
    fields = page_roots(symbols).select("id", "file_path", F.explode("metadata.frontmatter").alias("field", "value"))
    held = fields.join(F.broadcast(rules), "field").where("value IS NOT NULL")
    values = _values(F.col("value"))
    listed = F.ltrim(F.col("value")).startswith("[")
    shape = F.when(F.col("value_type") == "string", ~listed).otherwise(F.lit(True))
    allowed = (F.size("allowed") == 0) | F.forall(values, lambda v: F.array_contains("allowed", v))
    valid = F.coalesce(shape & (F.size(values) > 0) & F.forall(values, lambda v: v.isNotNull() & (v != "")) & allowed, F.lit(False))
    marked = held.withColumn("valid", valid)
    bad = marked.where("NOT valid").select(F.lit("NODE_ATTRIBUTE_INVALID").alias("code"), "namespace", F.col("id").alias("subject"), F.col("attribute").alias("detail"))
    return marked.where("valid").select("id", "namespace", "attribute", "value"), bad


def profile_edges(symbols: DataFrame, rules: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that rules draw from page roots to the pages that their front matter names, and diagnostics.

    A name is a canonical relative path of exactly one page root; the evidence is the page's own
    file at line 1. A page doesn't refer to itself.
    """
    fields = page_roots(symbols).select("cache_key", "id", "file_path", F.explode("metadata.frontmatter").alias("field", "value"))
    asked = fields.join(F.broadcast(rules), "field").select("cache_key", "id", "file_path", "namespace", "edge_type", "direction", F.explode(_values(F.col("value"))).alias("reference")).where("reference IS NOT NULL AND reference <> ''")
    roots = page_roots(symbols).groupBy("cache_key", F.col("file_path").alias("reference")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("target"))
    hashes = files.groupBy("cache_key", F.col("rel_path").alias("file_path")).agg(F.min("sha256").alias("content_hash"))
    joined = asked.join(roots, ["cache_key", "reference"], "left").join(hashes, ["cache_key", "file_path"], "left")
    code = (
        F.when(F.col("content_hash").isNull(), "EVIDENCE_SOURCE_NOT_FOUND").when(~is_plain_path(F.col("reference")) | F.col("n").isNull(), "REFERENCE_UNRESOLVED")
        .when(F.col("n") > 1, "REFERENCE_AMBIGUOUS").when(F.col("target") == F.col("id"), "SELF_EDGE")
    )
    marked = joined.withColumn("code", code)
    forward = F.col("direction") == "source_to_reference"
    edges = marked.where("code IS NULL").select(
        "cache_key", F.when(forward, F.col("id")).otherwise(F.col("target")).alias("from_id"), F.when(forward, F.col("target")).otherwise(F.col("id")).alias("to_id"), "edge_type", F.lit(True).alias("directed"), "namespace", F.lit("declared").alias("resolution"),
        F.struct(F.col("file_path").alias("file"), F.lit(1).alias("line"), "content_hash").alias("evidence"),
    )
    return edges.distinct(), marked.where("code IS NOT NULL").select("code", "namespace", F.col("id").alias("subject"), F.col("reference").alias("detail"))


def merged_overlays(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One value for each (id, namespace, attribute), the first by ``source``; others that differ are diagnostics."""
    first = Window.partitionBy("id", "namespace", "attribute").orderBy("source", "value")
    ranked = values.withColumn("kept", F.first("value").over(first)).withColumn("n", F.row_number().over(first))
    bad = ranked.where("n > 1 AND value <> kept").select(F.lit("NODE_ATTRIBUTE_CONFLICT").alias("code"), "namespace", F.col("id").alias("subject"), "attribute").distinct().withColumnRenamed("attribute", "detail")
    return ranked.where("n = 1").select("id", "namespace", "attribute", "value"), bad


def contributed_nodes(nodes: DataFrame, symbols: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contributed attributes that hold, and diagnostics of the rest, in this order: no profile of the
    namespace, no such symbol, another kind, an attribute that no rule has or allows."""
    known = symbols.groupBy("id").agg(F.min("kind").alias("indexed_kind"))
    spaces = rules.select("namespace").distinct().withColumn("active", F.lit(True))
    policy = rules.select("namespace", "attribute", "allowed").withColumn("named", F.lit(True))
    joined = nodes.join(known, "id", "left").join(F.broadcast(spaces), "namespace", "left").join(F.broadcast(policy), ["namespace", "attribute"], "left")
    values = _values(F.col("value"))
    bad_value = F.col("named").isNull() | (F.coalesce("value", F.lit("")) == "") | ((F.size("allowed") > 0) & ~F.forall(values, lambda v: F.array_contains("allowed", v)))
    code = (
        F.when(F.col("active").isNull(), "PROFILE_NOT_FOUND").when(F.col("indexed_kind").isNull(), "ENDPOINT_NOT_FOUND").when(F.col("indexed_kind") != F.col("kind"), "NODE_ATTRIBUTE_INVALID").when(bad_value, "NODE_ATTRIBUTE_INVALID")
    )
    marked = joined.withColumn("code", code)
    return marked.where("code IS NULL").select("id", "namespace", "attribute", "value", "source"), marked.where("code IS NOT NULL").select("code", "namespace", F.col("id").alias("subject"), F.col("attribute").alias("detail"))


def contributed_edges(edges: DataFrame, symbols: DataFrame, types: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contributed edges that hold, and diagnostics of the rest, in this order: no profile, unregistered
    type, resolution that isn't allowed, wrong direction, missing endpoint, evidence whose file is
    missing, stale or shorter than the line."""
    ids = symbols.select("id").distinct()
    spaces = types.select("namespace").distinct().withColumn("active", F.lit(True))
    policy = types.select("namespace", "edge_type", F.col("directed").alias("as_directed"), "allowed")
    lines = F.size(F.split(F.col("content").cast("string"), "\n"))
    seen = files.groupBy(F.col("rel_path").alias("file")).agg(F.min("sha256").alias("now"), F.max(lines).alias("lines"))
    joined = (
        edges.join(F.broadcast(spaces), "namespace", "left").join(F.broadcast(policy), ["namespace", "edge_type"], "left").join(ids.select(F.col("id").alias("from_id"), F.lit(True).alias("has_from")), "from_id", "left")
        .join(ids.select(F.col("id").alias("to_id"), F.lit(True).alias("has_to")), "to_id", "left").join(seen, "file", "left")
    )
    code = (
        F.when(F.col("active").isNull(), "PROFILE_NOT_FOUND").when(F.col("allowed").isNull(), "EDGE_TYPE_UNSUPPORTED").when(~F.array_contains("allowed", F.col("resolution")), "RESOLUTION_UNSUPPORTED").when(F.col("directed") != F.col("as_directed"), "INVALID_EDGE")
        .when(F.col("has_from").isNull() | F.col("has_to").isNull(), "ENDPOINT_NOT_FOUND").when(F.col("now").isNull(), "EVIDENCE_SOURCE_NOT_FOUND").when(F.col("now") != F.col("content_hash"), "EVIDENCE_STALE").when((F.col("line") < 1) | (F.col("line") > F.col("lines")), "EVIDENCE_LINE_INVALID")
    )
    marked = joined.withColumn("code", code)
    good = marked.where("code IS NULL").select("from_id", "to_id", "edge_type", "directed", "namespace", "resolution", F.struct("file", "line", "content_hash").alias("evidence"))
    return good, marked.where("code IS NOT NULL").select("code", "namespace", F.concat_ws("#", "source", F.col("edge_index").cast("string")).alias("subject"), F.col("edge_type").alias("detail"))


def contributions(spark: SparkSession, texts: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Node attributes, edges and diagnostics of contribution texts."""
    good, problems = loaded(spark, texts, MAX_CONTRIBUTIONS)
    nodes, edges = [], []
    text = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    for source, c in good.items():
        space = c.get("namespace")
        nodes += [(source, space, n.get("id"), n.get("kind"), k, text(v)) for n in c.get("nodes", []) for k, v in sorted((n.get("attributes") or {}).items())]
        for i, e in enumerate(c.get("edges", [])):
            at = e.get("evidence") or {}
            edges.append((source, space, i, e.get("from"), e.get("to"), e.get("type"), e.get("directed", True), e.get("resolution"), at.get("file"), at.get("line"), at.get("content_hash")))
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), problems
