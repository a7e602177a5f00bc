"""The tools of the index as functions that give DataFrames.

Each takes the session and the folder of the tables; results are lazy. What a question asks for
is in the arguments; limits are checked and wrong ones raise ValueError.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strataloom.functions.text import bridge_terms, decoded, relation_terms, stems
from strataloom.operators import anchors, content, graph, health, integrity, link, observe, resolve, search as searching, tables, telemetry
from strataloom.runtime import cut, table

_SEARCHED = ("cache_key", "id", "name", "qualified_name", "signature", "summary", "docstring", "keywords", "metadata")


def _symbols(spark: SparkSession, d: str, repo: str | None, *columns: str) -> DataFrame:
    return tables.symbols(spark, d, "cache_key", *columns, where=None if repo is None else F.col("cache_key") == repo)


def _edges(spark: SparkSession, d: str, repo: str | None) -> DataFrame:
    held = None if repo is None else F.col("cache_key") == repo
    return tables.edges(spark, d, "cache_key", "from_id", "to_id", "edge_type", "directed", "namespace", "resolution", "evidence", where=held)


def search(spark, d, query: str, repo: str | None = None, kind: str | None = None, lang: str | None = None, limit: int = 20, file_paths: list[str] | None = None) -> DataFrame:
    """Symbols by weighted score."""
    if not 1 <= limit <= 500:
        raise ValueError("limit is 1..500")
    return searching.top(_symbols(spark, d, repo, *_SEARCHED), query, limit, allowed=file_paths, kind=kind, language=lang).select("ord", "cache_key", "id", "kind", "file_path", "score")


def outline(spark, d, repo: str, file: str | None = None) -> DataFrame:
    rows = content.outline(_symbols(spark, d, repo, "name", "line", "byte_offset"))
    return rows if file is None else rows.where(F.col("file_path") == file)


def get(spark, d, repo: str, symbol_ids: list[str], context: int = 0) -> DataFrame:
    """Bodies of symbols, or their lines with ``context`` more on both sides."""
    asked = (F.col("cache_key") == repo) & F.col("id").isin(*symbol_ids)
    rows = tables.symbols(spark, d, "cache_key", "id", "byte_offset", "byte_length", "line", "end_line", where=asked)
    files = tables.files(spark, d, "cache_key", "rel_path", "content", where=F.col("cache_key") == repo)
    if context:
        return content.symbol_context(rows, files, context)
    return content.byte_ranges(rows, files).select("ord", "id", F.decode("body", "UTF-8").alias("body"))


def file(spark, d, repo: str, path: str, start_line: int = 1, end_line: int = 2**31 - 1) -> DataFrame:
    rows = tables.files(spark, d, "cache_key", "rel_path", "content", where=(F.col("cache_key") == repo) & (F.col("rel_path") == path))
    return content.file_slice(rows, "rel_path", decoded(F.col("content")), start_line, end_line)


def grep(spark, d, repo: str, pattern: str) -> DataFrame:
    rows = tables.files(spark, d, "cache_key", "rel_path", "content", where=F.col("cache_key") == repo)
    return content.grep_context(rows, "rel_path", decoded(F.col("content")), pattern)


def graph_anchors(spark, d, question: str, repo: str | None = None, max_anchors: int = 10) -> DataFrame:
    if not 1 <= max_anchors <= 32:
        raise ValueError("max_anchors is 1..32")
    return anchors.inferred(_symbols(spark, d, repo, *_SEARCHED), question, max_anchors)


def graph_neighbors(spark, d, seed_ids: list[str], repo: str | None = None) -> DataFrame:
    """Children and parents by exact containment."""
    held = _edges(spark, d, repo).where("edge_type = 'contains' AND directed AND resolution = 'exact'")
    return graph.neighbours(_seeds(spark, seed_ids), held, "either")


def graph_traverse_neighbors(spark, d, seed_ids: list[str], repo: str | None = None, direction: str = "outgoing", max_neighbors: int = 64, namespaces=None, edge_types=None, resolutions=None) -> DataFrame:
    if not 1 <= max_neighbors <= 512:
        raise ValueError("max_neighbors is 1..512")
    return graph.neighbours(_seeds(spark, seed_ids), graph.filtered(_edges(spark, d, repo), namespaces, edge_types, resolutions), direction, max_neighbors)


def _seeds(spark: SparkSession, ids: list[str]) -> DataFrame:
    if not 1 <= len(set(ids)) <= 512:
        raise ValueError("1..512 seeds")
    return spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "node_id string")


def graph_paths(spark, d, source_ids: list[str], target_ids: list[str], repo: str | None = None, limits: graph.Limits = graph.Limits(), direction: str = "outgoing", namespaces=None, edge_types=None, resolutions=None) -> DataFrame:
    """Bounded paths with the lines that prove their steps; reason says why one's evidence isn't given."""
    for ids in (source_ids, target_ids):
        if not 1 <= len(set(ids)) <= 512:
            raise ValueError("1..512 endpoints")
    edges = graph.filtered(_edges(spark, d, repo), namespaces, edge_types, resolutions)
    asked = spark.createDataFrame([("q", list(dict.fromkeys(source_ids)), list(dict.fromkeys(target_ids)))], "question_id string, sources array<string>, targets array<string>")
    return graph.with_evidence(graph.paths_between(asked, edges, limits, direction), edges, _contents(spark, d, repo), limits)


def _contents(spark: SparkSession, d: str, repo: str | None) -> DataFrame:
    return tables.files(spark, d, "cache_key", "rel_path", "content", where=None if repo is None else F.col("cache_key") == repo)


_RETRIEVED = "path_no int, node_ids array<string>, score double, reason string"


def graph_retrieve(spark, d, question: str, repo: str | None = None, limits: graph.Limits = graph.Limits(), direction: str = "either", seed_ids: list[str] | None = None) -> DataFrame:
    """Paths between a question's anchors, each accepted with a score or rejected with a reason.

    Questions that aren't about relations give nothing unless seeds are named. The search goes over
    the ``nodes`` nodes of highest priority (terms of the question that they have, and a tenth of an
    anchor's score); hubs are told by all edges. A path over several steps needs a relation term of
    the question in its evidence. Accepted paths come by falling score and keep their evidence as
    far as its bytes have room; rejected ones are one for each pair of ends.
    """
    limits.checked()
    kind, _ = health.question_routing(set(_stemmed(question)), bool(seed_ids))
    if kind == "suppressed":
        return spark.createDataFrame([], _RETRIEVED)
    symbols = _symbols(spark, d, repo, *_SEARCHED)
    most = max(2, min(8, limits.nodes // 2))
    chosen = [(i, 0.0) for i in dict.fromkeys(seed_ids)] if seed_ids else [(r.id, r.score) for r in anchors.inferred(symbols, question, most).collect()]
    if len(chosen) < 2:
        return spark.createDataFrame([], _RETRIEVED)
    ask = F.lit(question)
    anchor_rows = spark.createDataFrame(chosen, "node_id string, score double")
    front = lambda k: F.coalesce(F.col("metadata.frontmatter")[k], F.lit(""))
    text = F.concat_ws(" ", "name", "qualified_name", "file_path", "summary", F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " "), front("title"), front("description"), front("source"), front("tags"))
    overlays = table(spark, d, "node_overlays").select(F.col("id").alias("node_id"), F.coalesce("kind", F.lit("")).alias("text"))
    nodes = symbols.select(F.col("id").alias("node_id"), text.alias("text")).unionByName(overlays).unionByName(anchor_rows.select("node_id", F.lit("").alias("text"))).groupBy("node_id").agg(F.max("text").alias("text"))
    priorities = graph.node_priority(graph.node_relevance(nodes, ask), anchor_rows).join(anchor_rows.select("node_id", F.lit(1).alias("anchor")), "node_id", "left")
    # At most ``nodes`` (512) short rows.
    universe = priorities.orderBy(F.desc_nulls_last("anchor"), F.desc("priority"), "node_id").limit(limits.nodes).select("node_id", "priority").collect()
    edges = graph.filtered(_edges(spark, d, repo))
    inside = F.broadcast(spark.createDataFrame([(r.node_id,) for r in universe], "node_id string"))
    near = edges.join(inside.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi").join(inside.withColumnRenamed("node_id", "to_id"), "to_id", "left_semi")
    ids = [i for i, _ in chosen]
    asked = spark.createDataFrame([("q", ids, ids, {r.node_id: float(r.priority) for r in universe})], "question_id string, sources array<string>, targets array<string>, priorities map<string,double>")
    wide = graph.Limits(hops=limits.hops, nodes=limits.nodes, paths=32)
    found = graph.distinct_undirected(graph.paths_between(asked, near, wide, direction))
    free = graph.Limits(evidence_bytes=262_144, tokens=65_536)
    read = graph.with_evidence(found, near, _contents(spark, d, repo), free).withColumnRenamed("reason", "unread")
    threshold = edges.agg(F.greatest(F.lit(4), F.ceil(F.sqrt(F.count("*")))).alias("t")).scalar()
    steps = read.select("path_no", F.posexplode("node_ids").alias("at", "node_id")).join(nodes, "node_id", "left").join(graph.degrees(edges), "node_id", "left").join(priorities.select("node_id", "relevance"), "node_id", "left").join(anchor_rows, "node_id", "left")
    at = F.struct("at", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("relevance", F.lit(0)).alias("relevance"), F.coalesce("score", F.lit(0.0)).alias("score"))
    told = read.join(steps.groupBy("path_no").agg(F.sort_array(F.collect_list(at)).alias("n")), "path_no").withColumn("threshold", threshold)
    first, last, hops = F.element_at("n", 1), F.element_at("n", -1), F.size("n") - 1
    evidence = stems(F.array_join(F.transform("steps", lambda s: F.coalesce(s["content"], F.lit(""))), " "))
    inner = F.slice("n", F.lit(2), F.greatest(F.size("n") - 2, F.lit(0)))
    gate = graph.semantic_gate(hops, bridge_terms(ask, first["text"], last["text"]), relation_terms(ask), evidence, F.exists(inner, lambda x: x["degree"] > F.col("threshold")))
    hub = F.aggregate(inner, F.lit(0.0), lambda a, x: a + F.greatest(x["degree"] - F.col("threshold"), F.lit(0)) / F.col("threshold"))
    terms = F.array_distinct(stems(ask))
    shared = F.size(F.array_intersect(evidence, terms)) / F.greatest(F.lit(1), F.size(terms))
    score = F.round(graph.path_score(first["score"] + last["score"], first["relevance"] + last["relevance"], shared, hops, hub), 6)
    judged = told.select("question_id", "node_ids", "evidence_bytes", F.coalesce("unread", gate).alias("reason"), score.alias("score"), (first["score"] + last["score"]).alias("anchor_signal"), (first["relevance"] + last["relevance"]).alias("relevance"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "node_ids")
    accepted = judged.where("reason IS NULL").withColumn("path_no", F.row_number().over(order) - 1).where((F.col("path_no") >= limits.offset) & (F.col("path_no") < limits.offset + limits.paths))
    kept = graph.budgeted(accepted, limits).select("path_no", "node_ids", F.when(F.col("fits"), F.col("score")).alias("score"), F.when(~F.col("fits"), "EVIDENCE_BUDGET_EXCEEDED").alias("reason"))
    rejected = graph.best_rejections(judged.where("reason IS NOT NULL"), limits.paths)
    return kept.unionByName(rejected.select(F.lit(None).cast("int").alias("path_no"), "node_ids", F.lit(None).cast("double").alias("score"), "reason"))


def _stemmed(text: str) -> list[str]:
    return [health._stem(w) for w in re.findall("[a-z0-9]+", text.casefold())]


def graph_health(spark, d, repo: str | None = None) -> DataFrame:
    nodes = tables.symbols(spark, d, "id").select("id").unionByName(table(spark, d, "node_overlays").select("id"))
    refs = tables.references(spark, d, "cache_key", "status")
    return integrity.graph_health(_edges(spark, d, repo), refs if repo is None else refs.where(F.col("cache_key") == repo), nodes)


def graph_references(spark, d, repo: str | None = None, file: str | None = None, status: str | None = None, offset: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Counts (before the status is asked for) and one page of records."""
    rows = tables.references(spark, d, "cache_key", "raw", "status", "source_id", "target_id", "unresolved_reason")
    counts, kept = resolve.record_counts(rows if repo is None else rows.where(F.col("cache_key") == repo), file, status)
    return counts, content.numbered(kept, ["ref_id"], offset, limit)


def _linked(spark: SparkSession, d: str, repo: str | None):
    from strataloom.plans.link_queries import _modules

    files = tables.files(spark, d, "cache_key", "rel_path", "language", "content", "sha256", where=None if repo is None else F.col("cache_key") == repo)
    seen = cut(observe.observed(files))
    return files, seen, link.resolved_imports(seen, files, _modules(spark, d))


def _paged(rows: DataFrame, file: str | None, status: str | None, order: list[str], offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Counts of the rows of ``file`` before the status is asked for, and one page of those of ``status``."""
    rows = rows if file is None else rows.where(F.col("file_path") == file)
    counts = rows.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "resolved").alias("resolved"), F.count_if(F.col("status") == "unresolved").alias("unresolved"))
    return counts, content.numbered(rows if status is None else rows.where(F.col("status") == status), order, offset, limit)


def graph_imports(spark, d, repo: str | None = None, file: str | None = None, status: str | None = None, offset: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Counts and one page of imports of all languages with their outcome."""
    return _paged(_linked(spark, d, repo)[2], file, status, ["cache_key", "file_path", "start", "import_id"], offset, limit)


def graph_calls(spark, d, repo: str | None = None, file: str | None = None, status: str | None = None, offset: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Counts and one page of call sites of all languages with caller, callee or the reason why none."""
    _, seen, imports = _linked(spark, d, repo)
    symbols, imports = cut(observe.symbols_of(seen)), cut(imports)
    references = link.resolved_references(seen, imports, link.export_surface(*link.export_rules(seen, imports)), symbols)
    return _paged(link.resolved_calls(seen, references, symbols), file, status, ["cache_key", "file_path", "start", "end", "call_id"], offset, limit)


def verify(spark, d, repo: str | None = None) -> DataFrame:
    s = _symbols(spark, d, repo, "name", "signature", "byte_offset", "byte_length", "content_hash", "metadata")
    return integrity.verify_symbols(s, tables.files(spark, d, "cache_key", "rel_path", "content")).where("problem IS NOT NULL")


def list_repositories(spark, d) -> DataFrame:
    return table(spark, d, "repositories").select("cache_key", "path", "symbols").orderBy("cache_key")


def store_health(spark, d, offset: int = 0, limit: int = 100, max_probe_paths: int = 1_000_000, max_probe_bytes: int = 1 << 50) -> tuple[DataFrame, DataFrame]:
    """The store's counts and status, and one page of repositories with their states."""
    counted = tables.symbols(spark, d, "cache_key").groupBy("cache_key").agg(F.count("*").alias("symbols"))
    probes = health.bounded_probe(tables.files(spark, d, "cache_key", "bytes", "content"), max_probe_paths, max_probe_bytes)
    none = spark.createDataFrame([], "cache_key string, reason string")
    states = cut(health.store_states(table(spark, d, "repositories"), counted, none, probes))
    return health.store_summary(states), health.store_page(states, offset, limit)


def index(spark, root: str, store_root: str | None = None, ignore_text: str = "", incremental: bool = True):
    """Indexes a directory into the store, reading only what changed."""
    from strataloom import index as building
    from strataloom.sources.store import Store, resolved_root

    return building.build(spark, root, Store(spark, resolved_root(spark, store_root)), ignore_text, incremental)


def _log(spark: SparkSession, d: str, repo: str | None, days: int | None, now) -> DataFrame:
    rows = telemetry.since(telemetry.from_events(table(spark, d, "events")), days, now)
    return rows if repo is None else rows.where(F.col("repo") == repo)


def stats(spark, d, repo: str | None = None, since_days: int | None = 7, all_time: bool = False, now=None) -> DataFrame:
    """Savings per repo and lane with subtotals, of the last days before ``now``."""
    return telemetry.stats_by_group(_log(spark, d, repo, None if all_time else since_days, now))


def analyze(spark, d, repo: str | None = None, since_days: int = 30, now=None) -> tuple[DataFrame, DataFrame]:
    """The summary of the last days and all findings."""
    log = _log(spark, d, repo, since_days, now)
    return telemetry.summary(log), telemetry.findings(log, tables.symbols(spark, d))
