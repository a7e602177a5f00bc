"""Queries of observations and what they link to, of health and of extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strataloom.operators import extensions, health, link, observe, tables
from strataloom.plans.index_queries import _FIL, _REF, _STEM, _SYM, _list, query
from strataloom.runtime import cut, table


def _files(spark, d) -> DataFrame:
    return tables.files(spark, d, "cache_key", "rel_path", "language", "content", "sha256")


def _seen(spark, d) -> DataFrame:
    return cut(observe.observed(_files(spark, d)))


def _modules(spark, d) -> DataFrame:
    """The module of each repository is mod.invalid/ and its key, at the root."""
    return table(spark, d, "files").select("cache_key").distinct().select("cache_key", F.concat(F.lit("mod.invalid/"), "cache_key").alias("module"), F.lit("").alias("directory"))


def _linked(spark, d) -> tuple[DataFrame, ...]:
    seen, files = _seen(spark, d), _files(spark, d)
    symbols = cut(observe.symbols_of(seen))
    imports = cut(link.resolved_imports(seen, files, _modules(spark, d)))
    surface = cut(link.export_surface(*link.export_rules(seen, imports)))
    references = cut(link.resolved_references(seen, imports, surface, symbols))
    return seen, symbols, imports, surface, references


_KNOWN = ("function", "class", "interface")


@query(f"WITH {_SYM} SELECT ord FROM sym WHERE kind IN ({_list(_KNOWN)}) AND language IN ('go', 'javascript', 'typescript')")
def symbols_extracted_known(spark, d):
    """Functions, classes and interfaces of the symbol table that the readers of three languages find,
    by name and end; the SQL has all of the table's."""
    found = observe.symbols_of(observe.observed(_files(spark, d)))
    ends = found.select("cache_key", "file_path", "name", (F.col("byte_offset") + F.col("byte_length")).alias("at")).distinct()
    known = tables.symbols(spark, d, "cache_key", "name", "byte_offset", "byte_length").where(F.col("kind").isin(*_KNOWN) & F.col("language").isin("go", "javascript", "typescript"))
    return known.withColumn("at", F.col("byte_offset") + F.col("byte_length")).join(ends, ["cache_key", "file_path", "name", "at"], "left_semi").select("ord")


@query()
def symbols_extracted(spark, d):
    """Symbols of all five languages with their ids; tested on fixtures."""
    return observe.symbols_of(_seen(spark, d)).select("cache_key", "id", "kind", "byte_offset", "byte_length", "content_hash")


@query()
def imports_resolved(spark, d):
    """Imports of all five languages with their file or the reason why there is none; tested on fixtures."""
    rows = link.resolved_imports(_seen(spark, d), _files(spark, d), _modules(spark, d))
    return rows.select("import_id", "cache_key", "file_path", "language", "specifier", "local_name", "kind", "status", "target_file", "reason")


@query()
def export_surfaces(spark, d):
    """The definition that each offered name leads to; tested on fixtures."""
    return _linked(spark, d)[3]


@query()
def references_resolved(spark, d):
    """References that begin with an import and what they lead to; tested on fixtures."""
    return _linked(spark, d)[4].select("ref_id", "cache_key", "file_path", "text", "status", "reason", "target_id", "target_kind")


@query()
def calls_resolved(spark, d):
    """Call sites with caller and callee, or the first reason why not; tested on fixtures."""
    seen, symbols, _, _, references = _linked(spark, d)
    return link.resolved_calls(seen, references, symbols).select("call_id", "cache_key", "file_path", "text", "source_id", "status", "reason", "target_id", "resolution")


@query()
def linked_edges(spark, d):
    """Import, reference and call edges out of the files alone; tested on fixtures."""
    seen, symbols, imports, _, references = _linked(spark, d)
    edges = link.import_edges(imports).unionByName(link.reference_edges(references, seen, symbols)).unionByName(link.call_edges(link.resolved_calls(seen, references, symbols)))
    return edges.select("cache_key", "from_id", "to_id", "edge_type", "resolution", "evidence.file", "evidence.line")


@query(f"""WITH {_FIL}, f AS (SELECT cache_key, rel_path, CASE WHEN rel_path LIKE '%/%' THEN regexp_replace(rel_path, '\\.[^./]+$', '') ELSE regexp_replace(rel_path, '\\.[^./]+$', '') END AS stem, language FROM fil)
  SELECT DISTINCT cache_key, rel_path || '::__file__#file' AS id, string_split(rel_path, '/')[-1] AS name, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(stem), '[a-z0-9]+'), lambda x: x <> 'src'))), ' ') AS keywords FROM f""")
def file_nodes(spark, d):
    """The file node of each file with its keywords."""
    return observe.file_nodes(_files(spark, d)).select("cache_key", "id", "name", F.array_join("keywords", " ").alias("keywords")).distinct()


@query(f"""WITH {_SYM}, r AS (SELECT cache_key, file_path, id, row_number() OVER (PARTITION BY cache_key, file_path ORDER BY coalesce(line, 0), coalesce(byte_offset, 0), id) AS n FROM sym WHERE language = 'markdown' AND metadata.markdown.page_root)
  SELECT cache_key, file_path, id FROM r WHERE n = 1""")
def canonical_roots(spark, d):
    return extensions.canonical_roots(tables.symbols(spark, d, "cache_key", "id", "line", "byte_offset", "metadata"))


@query(f"WITH {_SYM} SELECT id, kind, language || '|' || file_path || '|' || coalesce(line, 0) || '|' || coalesce(end_line, 0) AS attributes FROM sym")
def node_refs(spark, d):
    refs = health.node_refs(tables.symbols(spark, d, "id", "line", "end_line"))
    return refs.select("id", "kind", F.concat_ws("|", *(F.col("attributes")[k] for k in ("language", "file", "line", "end_line"))).alias("attributes"))


def _stemmed(words) -> str:
    return _list(sorted({health._stem(w) for w in words}))


@query(f"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(replace(lower(coalesce(title, '')), 'ß', 'ss'), '[a-z0-9]+'), lambda x: {_STEM}) AS w FROM documents)
  SELECT doc_id, CASE WHEN list_has_any(w, [{_stemmed(health.MEASUREMENT_WORDS)}]) THEN 'attribute_or_measurement_question' WHEN list_has_any(w, [{_stemmed(health.ROUTING_WORDS)}]) THEN 'relationship_intent' ELSE 'non_relationship_question' END AS reason FROM t""")
def question_routes(spark, d):
    """How documents' titles would be routed if they were questions."""
    return health.routed(table(spark, d, "documents"), F.col("title")).select("doc_id", "reason")


_RULES = [("team", "state", "status", "string", ["draft", "done"]), ("team", "heading", "title", "string", []), ("team", "areas", "tags", "string_list", ["storage", "export", "core"])]


def _fronts() -> str:
    cases = " UNION ALL ".join(f"SELECT id, '{a}' AS attribute, value, {'true' if not allowed else f'value IN ({_list(allowed)})'} AS ok FROM fr WHERE field = '{field}'" for _, a, field, _, allowed in _RULES)
    return f"fr AS (SELECT id, unnest(map_keys(metadata.frontmatter)) AS field, unnest(map_values(metadata.frontmatter)) AS value FROM sym WHERE language = 'markdown' AND metadata.markdown.page_root), v AS ({cases})"


@query(f"WITH {_SYM}, {_fronts()} SELECT id, attribute, value, CASE WHEN NOT ok OR value = '' THEN 'NODE_ATTRIBUTE_INVALID' END AS code FROM v WHERE value IS NOT NULL")
def profile_attributes(spark, d):
    """What three rules make of pages' front matter, valid or not."""
    rules = spark.createDataFrame(_RULES, extensions.ATTRIBUTES)
    symbols = tables.symbols(spark, d, "id", "metadata")
    good, bad = extensions.profile_attributes(symbols, rules)
    fields = extensions.page_roots(symbols).select("id", F.explode("metadata.frontmatter").alias("field", "value"))
    wrong = bad.join(rules.select(F.col("attribute").alias("detail"), "field"), "detail").withColumnRenamed("subject", "id").join(fields, ["id", "field"])
    return good.select("id", "attribute", "value", F.lit(None).cast("string").alias("code")).unionByName(wrong.select("id", F.col("detail").alias("attribute"), "value", "code"))


@query(f"""WITH {_REF}, {_FIL}, k AS (SELECT cache_key, rel_path AS source_file, min(sha256) AS now FROM fil GROUP BY ALL), nd AS (SELECT DISTINCT id FROM (SELECT id FROM symbols UNION ALL SELECT id FROM node_overlays))
  SELECT ref_id, CASE WHEN raw IS NULL THEN 'observation_missing' WHEN now IS NULL THEN 'source_missing' WHEN raw.source_hash <> now THEN 'source_stale' WHEN raw.start_byte < 0 OR raw.end_byte < raw.start_byte THEN 'range_invalid'
  WHEN status = 'resolved' AND target_id IS NULL THEN 'resolved_without_target' WHEN status = 'resolved' AND nd.id IS NULL THEN 'target_missing' WHEN status = 'unresolved' AND unresolved_reason IS NULL THEN 'unresolved_without_reason'
  WHEN status = 'unresolved' AND target_id IS NOT NULL THEN 'unresolved_with_target' WHEN len(list_filter(support, lambda s: s IS NOT NULL AND (s.file IS NULL OR coalesce(s.line, 0) < 1))) > 0 THEN 'support_invalid' END AS problem
  FROM ref LEFT JOIN k ON ref.cache_key = k.cache_key AND raw.source_file = k.source_file LEFT JOIN nd ON nd.id = target_id""")
def records_validated(spark, d):
    nodes = tables.symbols(spark, d, "id").select("id").unionByName(table(spark, d, "node_overlays").select("id"))
    return health.validated_records(tables.references(spark, d, "cache_key", "raw", "status", "target_id", "unresolved_reason", "support"), nodes, tables.files(spark, d, "cache_key", "rel_path", "sha256"))


_PROBE = "p AS (SELECT cache_key, count(*) AS paths, sum(coalesce(bytes, octet_length(content)))::BIGINT AS bytes FROM fil GROUP BY cache_key)"


@query(f"""WITH {_FIL}, {_PROBE} SELECT cache_key, CASE WHEN paths > 30 OR bytes > 60000 THEN 'unavailable' ELSE 'complete' END AS probe, CASE WHEN paths > 30 THEN 'PATH_LIMIT_EXCEEDED' WHEN bytes > 60000 THEN 'BYTE_LIMIT_EXCEEDED' END AS code,
  CASE WHEN paths > 30 THEN 30 WHEN bytes > 60000 THEN 60000 END::BIGINT AS "limit", CASE WHEN paths > 30 THEN paths WHEN bytes > 60000 THEN bytes END AS observed FROM p""")
def bounded_probes(spark, d):
    return health.bounded_probe(tables.files(spark, d, "cache_key", "bytes", "content"), 30, 60_000)


@query(f"""WITH {_FIL}, {_SYM}, {_PROBE}, i AS (SELECT cache_key, count(*) AS held FROM sym GROUP BY 1), s AS (SELECT cache_key, path, CASE WHEN held IS NULL OR symbols <> held THEN 'corrupt' WHEN paths <= 30 AND bytes <= 60000 THEN 'healthy' ELSE '' END AS states,
  CASE WHEN paths <= 30 AND bytes <= 60000 THEN 'complete' ELSE 'unavailable' END AS probe FROM repositories LEFT JOIN i USING (cache_key) LEFT JOIN p USING (cache_key)) SELECT *, CASE WHEN (SELECT count(*) FROM s) > 20 THEN 20 END AS next_offset FROM s ORDER BY cache_key LIMIT 20""")
def store_health_page(spark, d):
    """The first page of the repositories' states; none is stale here, as nothing else is stored."""
    indexed = tables.symbols(spark, d, "cache_key").groupBy("cache_key").agg(F.count("*").alias("symbols"))
    none = spark.createDataFrame([], "cache_key string, reason string")
    probes = health.bounded_probe(tables.files(spark, d, "cache_key", "bytes", "content"), 30, 60_000)
    states = health.store_states(table(spark, d, "repositories"), indexed, none, probes)
    return health.store_page(states.select("cache_key", "path", F.array_join("states", " ").alias("states"), "probe"), 0, 20)


@query(f"""WITH {_FIL}, c AS (SELECT cache_key, count(DISTINCT rel_path) AS indexed_files FROM fil GROUP BY 1) SELECT cache_key, CASE WHEN x.paths IS NULL THEN 'complete' ELSE 'partial' END AS state, indexed_files, coalesce(x.paths, 0)::BIGINT AS excluded_paths
  FROM c LEFT JOIN (SELECT cache_key, sum(paths) AS paths FROM (SELECT cache_key, count(DISTINCT rel_path) AS paths FROM fil WHERE rel_path LIKE '%.json' OR rel_path LIKE '%.cjs' GROUP BY 1) GROUP BY 1) x USING (cache_key)""")
def coverage_envelopes(spark, d):
    """Coverage of each repository if files of two endings were left out."""
    files = tables.files(spark, d, "cache_key", "rel_path")
    left_out = files.where("rel_path LIKE '%.json' OR rel_path LIKE '%.cjs'").groupBy("cache_key").agg(F.count_distinct("rel_path").alias("paths"), F.slice(F.sort_array(F.collect_set("rel_path")), 1, 20).alias("samples"))
    stored = left_out.select("cache_key", F.lit("unsupported_file_type").alias("reason"), "paths", "samples", (F.col("paths") - F.size("samples")).alias("omitted"))
    return health.coverage_envelope(stored, files)
