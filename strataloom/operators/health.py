"""Whether an index is whole and fresh: coverage, staleness, record validation and the store's states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataloom.functions.text import RELATION_WORDS, words_array
from strataloom.operators import integrity

#: States of a repository in the order in which they are reported.
STATES = ("overlap", "corrupt", "missing", "stale", "healthy")
# Stems of questions about measurements, and of those about relations.
MEASUREMENT_WORDS = ("exact", "measured", "result", "when")
ROUTING_WORDS = ("become", "bridge", "connect", "define", "evidence", "improved", "link", "propose", "related", "relation", "relationship", "shows", "support")


def coverage_envelope(coverage: DataFrame, files: DataFrame) -> DataFrame:
    """One row for each repository: state, indexed_files, excluded_paths and whether the stored
    exclusions agree with themselves.

    coverage: cache_key, reason, paths, samples (array), omitted. Complete without exclusions, else
    partial; unknown where the counts of a reason aren't those of its samples and what they omit, a
    reason is repeated, or nothing is stored.
    """
    counted = files.groupBy("cache_key").agg(F.count_distinct("rel_path").alias("indexed_files"))
    wrong = (F.col("paths") <= 0) | (F.col("paths") != F.size("samples") + F.col("omitted")) | (F.size("samples") > 20) | F.col("reason").isNull()
    seen = coverage.groupBy("cache_key").agg(F.sum("paths").alias("excluded_paths"), F.bool_or(F.coalesce(wrong, F.lit(True))).alias("wrong"), F.count("*").alias("n"), F.count_distinct("reason").alias("reasons"))
    joined = counted.join(seen, "cache_key", "full_outer")
    broken = F.coalesce(F.col("wrong") | (F.col("n") != F.col("reasons")), F.lit(False))
    state = F.when(broken | F.col("indexed_files").isNull(), "unknown").when(F.coalesce("excluded_paths", F.lit(0)) == 0, "complete").otherwise("partial")
    return joined.select("cache_key", state.alias("state"), F.coalesce("indexed_files", F.lit(0)).alias("indexed_files"), F.when(state != "unknown", F.coalesce("excluded_paths", F.lit(0))).alias("excluded_paths"))


def staleness(before: DataFrame, now: DataFrame, inputs_before: DataFrame, inputs_now: DataFrame, coverage_before: DataFrame, coverage_now: DataFrame) -> DataFrame:
    """Why each repository's index is stale: cache_key and reason, none if it is fresh.

    before/now: cache_key, path, hash of sources; inputs_*: the same of control files and
    extensions; coverage_*: cache_key, reason, paths. A repository without stored coverage has
    INDEX_COVERAGE_MISSING; others may have INDEX_COVERAGE_CHANGED, SOURCE_CONTENT_CHANGED and
    GRAPH_INPUTS_CHANGED, one row each.
    """
    keys = now.select("cache_key").unionByName(before.select("cache_key")).distinct()
    missing = keys.join(coverage_before.select("cache_key").distinct(), "cache_key", "left_anti").select("cache_key", F.lit("INDEX_COVERAGE_MISSING").alias("reason"))
    a = coverage_before.select("cache_key", F.col("reason").alias("path"), F.col("paths").cast("string").alias("hash"))
    b = coverage_now.select("cache_key", F.col("reason").alias("path"), F.col("paths").cast("string").alias("hash"))
    stored = coverage_before.select("cache_key").distinct()
    parts = [missing]
    for name, x, y in (("INDEX_COVERAGE_CHANGED", a, b), ("SOURCE_CONTENT_CHANGED", before, now), ("GRAPH_INPUTS_CHANGED", inputs_before, inputs_now)):
        diff = integrity.snapshot_diff(x.select("cache_key", "path", "hash"), y.select("cache_key", "path", "hash")).select("cache_key").distinct()
        parts.append((diff.join(stored, "cache_key", "left_semi") if name == "INDEX_COVERAGE_CHANGED" else diff).select("cache_key", F.lit(name).alias("reason")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bounded_probe(files: DataFrame, max_paths: int, max_bytes: int) -> DataFrame:
    """Per repository whether a probe of its files stays within bounds: complete, or unavailable with the
    bound that it breaks, the limit and what was seen."""
    seen = files.groupBy("cache_key").agg(F.count("*").alias("paths"), F.sum(F.coalesce("bytes", F.length("content"))).alias("bytes"))
    code = F.when(F.col("paths") > max_paths, "PATH_LIMIT_EXCEEDED").when(F.col("bytes") > max_bytes, "BYTE_LIMIT_EXCEEDED")
    limit = F.when(F.col("paths") > max_paths, F.lit(max_paths)).when(F.col("bytes") > max_bytes, F.lit(max_bytes)).cast("long")
    return seen.select("cache_key", F.when(code.isNull(), "complete").otherwise("unavailable").alias("probe"), code.alias("code"), limit.alias("limit"), F.when(code == "PATH_LIMIT_EXCEEDED", F.col("paths")).when(code.isNotNull(), F.col("bytes")).alias("observed"))


def store_states(repositories: DataFrame, indexed: DataFrame, stale: DataFrame, probes: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """States of each repository of the catalog, in the order of STATES, and its probe.

    repositories: cache_key, path, symbols; indexed: cache_key, symbols that are really stored;
    stale: cache_key, reason; probes: as :func:`bounded_probe`; roots: cache_key, root_state
    (missing or corrupt, of roots that aren't directories). Without any reason and with a complete
    probe it is healthy; without a stored index it is corrupt, and with another count as well.
    """
    overlap = integrity.root_overlaps(repositories)
    both = overlap.select("cache_key").unionByName(overlap.select(F.col("outer_key").alias("cache_key"))).distinct().withColumn("overlaps", F.lit(True))
    held = repositories.join(indexed.select("cache_key", F.col("symbols").alias("held")), "cache_key", "left").join(both, "cache_key", "left")
    held = held.join(stale.groupBy("cache_key").agg(F.sort_array(F.collect_set("reason")).alias("reasons")), "cache_key", "left").join(probes.select("cache_key", "probe"), "cache_key", "left")
    root_state = F.lit(None).cast("string")
    if roots is not None:
        held, root_state = held.join(roots, "cache_key", "left"), F.col("root_state")
    corrupt = F.col("held").isNull() | (F.col("symbols") != F.col("held")) | F.coalesce(root_state == "corrupt", F.lit(False))
    found = F.array_compact(F.array(F.when(F.col("overlaps"), F.lit("overlap")), F.when(F.coalesce(corrupt, F.lit(False)), F.lit("corrupt")), F.when(F.coalesce(root_state == "missing", F.lit(False)), F.lit("missing")), F.when(F.size("reasons") > 0, F.lit("stale"))))
    probe = F.coalesce("probe", F.lit("unavailable"))
    states = F.when(F.size(found) > 0, found).when(probe == "complete", F.array(F.lit("healthy"))).otherwise(found)
    return held.select("cache_key", "path", states.alias("states"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"), probe.alias("probe"))


def store_page(states: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """One page of repositories by cache_key with next_offset, null at the end; limit is 1..500."""
    from strataloom.operators.content import numbered

    return numbered(states, ["cache_key"], offset, limit)


def store_summary(states: DataFrame, whole: bool = True) -> DataFrame:
    """Counts of states and the store's status: unhealthy if anything is wrong, else healthy if all
    probes were complete and the page is the ``whole`` store, else incomplete."""
    counts = states.agg(F.count("*").alias("repositories"), *(F.count_if(F.array_contains("states", s)).alias(s) for s in STATES), F.count_if(F.col("probe") != "complete").alias("incomplete"))
    bad = sum((F.col(s) for s in STATES[1:-1]), F.col(STATES[0])) > 0
    return counts.withColumn("status", F.when(bad, "unhealthy").when((F.col("incomplete") == 0) & F.lit(whole), "healthy").otherwise("incomplete"))


def missing_roots(repositories: DataFrame, listed: DataFrame) -> DataFrame:
    """Repositories to be taken out at start: those whose root isn't among the ``listed`` paths any more."""
    return repositories.join(listed.select("path").distinct(), "path", "left_anti")


def validated_records(references: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Each reference record with what is wrong with it first, or null.

    In order: observation_missing, source_missing (no hash of its file), source_stale (another
    hash), range_invalid, resolved_without_target, target_missing (no such node),
    unresolved_without_reason, unresolved_with_target, support_invalid (an item without file or
    with a line below 1).
    """
    known = files.groupBy("cache_key", F.col("rel_path").alias("source_file")).agg(F.min("sha256").alias("now"))
    ids = nodes.select(F.col("id").alias("target_id")).distinct().withColumn("has_target", F.lit(True))
    rows = references.withColumn("source_file", F.col("raw.source_file"))
    joined = rows.join(known, ["cache_key", "source_file"], "left").join(ids, "target_id", "left")
    support = F.coalesce(F.exists("support", lambda s: s.isNotNull() & (s["file"].isNull() | (F.coalesce(s["line"], F.lit(0)) < 1))), F.lit(False))
    code = (
        F.when(F.col("raw").isNull(), "observation_missing").when(F.col("now").isNull(), "source_missing").when(F.col("raw.source_hash") != F.col("now"), "source_stale").when((F.col("raw.start_byte") < 0) | (F.col("raw.end_byte") < F.col("raw.start_byte")), "range_invalid")
        .when((F.col("status") == "resolved") & F.col("target_id").isNull(), "resolved_without_target").when((F.col("status") == "resolved") & F.col("has_target").isNull(), "target_missing").when((F.col("status") == "unresolved") & F.col("unresolved_reason").isNull(), "unresolved_without_reason")
        .when((F.col("status") == "unresolved") & F.col("target_id").isNotNull(), "unresolved_with_target").when(support, "support_invalid")
    )
    return joined.select("ref_id", code.alias("problem"))


def node_refs(symbols: DataFrame) -> DataFrame:
    """What answers say of a node: id, namespace, kind and its attributes as a map.

    Nodes of Go packages and Rust crates also tell import path, package name, directory or crate.
    """
    extra = F.from_json(F.col("metadata_json"), "map<string,string>") if "metadata_json" in symbols.columns else F.create_map().cast("map<string,string>")
    plain = F.create_map(F.lit("language"), F.col("language"), F.lit("file"), F.col("file_path"), F.lit("line"), F.coalesce("line", F.lit(0)).cast("string"), F.lit("end_line"), F.coalesce("end_line", F.lit(0)).cast("string"))
    named = F.map_filter(F.coalesce(extra, F.create_map().cast("map<string,string>")), lambda k, v: k.isin("import_path", "package_name", "directory", "crate_name", "target_kind", "edition") & v.isNotNull())
    attributes = F.when(F.col("kind").isin("package", "crate"), F.map_concat(plain, named)).otherwise(plain)
    return symbols.select("id", F.lit("core").alias("namespace"), "kind", attributes.alias("attributes"))


def question_routing(terms: set[str], explicit: bool = False) -> tuple[str, str]:
    """Whether a question (its stems) is one about relations: kind and reason. Named seeds always are."""
    stemmed = lambda words: {_stem(w) for w in words}
    if not explicit and terms & stemmed(MEASUREMENT_WORDS):
        return "suppressed", "attribute_or_measurement_question"
    if explicit or terms & stemmed(ROUTING_WORDS):
        return "relationship", "relationship_intent"
    return "suppressed", "non_relationship_question"


def routed(questions: DataFrame, text: Column) -> DataFrame:
    """``questions`` with kind and reason of :func:`question_routing`, as columns."""
    from strataloom.functions.text import stems

    asked = stems(text)
    measures = F.size(F.array_intersect(asked, words_array(sorted({_stem(w) for w in MEASUREMENT_WORDS})))) > 0
    relates = F.size(F.array_intersect(asked, words_array(sorted({_stem(w) for w in ROUTING_WORDS})))) > 0
    reason = F.when(measures, "attribute_or_measurement_question").when(relates, "relationship_intent").otherwise("non_relationship_question")
    return questions.withColumn("kind", F.when(~measures & relates, "relationship").otherwise("suppressed")).withColumn("reason", reason)


def _stem(word: str) -> str:
    """A word's stem, as :func:`strataloom.functions.text.stem` has it."""
    for ending, least, instead in (("ness", 7, ""), ("ing", 5, ""), ("ed", 4, ""), ("ies", 4, "y"), ("es", 4, "")):
        if len(word) > least and word.endswith(ending):
            return word[: -len(ending)] + instead
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith(("ss", "us", "is")) else word


def relation_vocabulary() -> set[str]:
    """Stems of the words that ask for a relation."""
    return {_stem(w) for w in RELATION_WORDS}


def ranked_states(states: DataFrame) -> DataFrame:
    """Repositories with the place of their worst state, worst first."""
    order = F.array_position(words_array(list(STATES)), F.get("states", F.lit(0)))
    return states.withColumn("rank", F.row_number().over(Window.orderBy(order, "cache_key")))
