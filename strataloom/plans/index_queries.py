"""Queries over the index tables for the operators of the survey, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from strataloom.functions import policy, text as X, times
from strataloom.functions.languages import ENDINGS, SPELLINGS
from strataloom.operators import anchors, content, graph, integrity, resolve, search, tables, telemetry
from strataloom.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_SPELLED = "regexp_replace(lower(trim(language)), '[\\s.]+', '', 'g')"
_ENDING = "lower(regexp_extract({path}, '\\.([^./\\\\]+)\\s*$', 1))"


def _language(path: str) -> str:
    cases = [f"WHEN {_SPELLED} IN ({_list(w)}) THEN '{n}'" for n, w in SPELLINGS.items()] + [f"WHEN {_ENDING.format(path=path)} IN ({_list(w)}) THEN '{n}'" for n, w in ENDINGS.items()]
    return "CASE " + " ".join(cases) + " END"


_SYM = f"sym AS (SELECT DISTINCT ON (ord) * REPLACE (lower(trim(coalesce(kind, ''))) AS kind, coalesce({_language('file_path')}, '') AS language) FROM symbols)"
_FIL = "fil AS (SELECT DISTINCT ON (file_id) * FROM files)"
_EDG = "edg AS (SELECT DISTINCT ON (edge_id) * FROM edges)"
_REF = "ref AS (SELECT DISTINCT ON (ref_id) * FROM symbol_references)"
_LINES = r"regexp_split_to_array({t}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"


def _lines(t: str) -> str:
    parts = _LINES.format(t=t)
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"


_DOC_LINES = f"l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS line_no FROM (SELECT doc_id, {_lines('text')} AS ls FROM documents WHERE text IS NOT NULL))"
PATTERN = "[Ee]vidence|import"
_TERMS = "list_filter(list_transform(regexp_extract_all(replace(lower(coalesce({t}, '')), 'ß', 'ss'), '[a-z0-9]+'), lambda x: CASE WHEN length(x) > 4 AND x LIKE '%ies' THEN x[:-4] || 'y' WHEN length(x) > 4 AND x LIKE '%s' AND NOT (x LIKE '%ss' OR x LIKE '%us' OR x LIKE '%is') THEN x[:-2] ELSE x END), lambda x: length(x) >= 2)"


# Content


@query(f"WITH {_DOC_LINES} SELECT doc_id, line_no, ls[line_no] AS line FROM l WHERE regexp_matches(ls[line_no], '{PATTERN}')")
def grep_lines(spark, d):
    return content.grep(table(spark, d, "documents"), "doc_id", F.col("text"), PATTERN)


@query(f"""WITH {_DOC_LINES} SELECT doc_id, line_no, ls[line_no] AS line, array_to_string(ls[greatest(line_no - 2, 1):line_no - 1], chr(10)) AS before,
  array_to_string(ls[line_no + 1:line_no + 2], chr(10)) AS after FROM l WHERE regexp_matches(ls[line_no], '{PATTERN}')""")
def grep_context(spark, d):
    found = content.grep_context(table(spark, d, "documents"), "doc_id", F.col("text"), PATTERN)
    return found.withColumns({c: F.array_join(c, "\n") for c in ("before", "after")})


@query(f"""SELECT doc_id, coalesce(len(ls), 0)::INT AS total_lines, coalesce(array_to_string(ls[3:7], chr(10)), '') AS body
  FROM (SELECT doc_id, CASE WHEN text IS NOT NULL THEN {_lines('text')} END AS ls FROM documents)""")
def file_slice(spark, d):
    return content.file_slice(table(spark, d, "documents"), "doc_id", F.col("text"), 3, 7)


@query(f"SELECT doc_id, len({_lines('text')})::INT AS lines FROM documents WHERE text IS NOT NULL")
def line_counts(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(X.lines(F.col("text"))).alias("lines"))


@query(f"""WITH {_SYM}, {_FIL} SELECT s.ord, CASE WHEN f.content IS NOT NULL THEN sha256(substring(hex(f.content), (s.byte_offset * 2 + 1)::BIGINT, (s.byte_length * 2)::BIGINT)) END AS digest
  FROM sym s LEFT JOIN fil f ON s.cache_key = f.cache_key AND s.file_path = f.rel_path""")
def symbol_content(spark, d):
    rows = content.byte_ranges(tables.symbols(spark, d, "cache_key", "file_path", "byte_offset", "byte_length"), tables.files(spark, d, "cache_key", "rel_path", "content"))
    return rows.select("ord", F.sha2(F.hex("body").cast("binary"), 256).alias("digest"))


@query(f"""WITH {_SYM}, {_FIL}, c AS (SELECT s.ord, s.line, s.end_line, {_lines("decode(f.content)")} AS ls FROM sym s JOIN fil f ON s.cache_key = f.cache_key AND s.file_path = f.rel_path)
  SELECT ord, greatest(line - 2, 1) AS from_line, least(greatest(end_line, line) + 2, len(ls)) AS to_line, sha256(coalesce(array_to_string(ls[greatest(line - 2, 1):least(greatest(end_line, line) + 2, len(ls))], chr(10)), '')) AS digest FROM c""")
def symbol_context(spark, d):
    """Line ranges of all symbols in all files with two lines of context, and a hash of these lines."""
    rows = content.symbol_context(tables.symbols(spark, d, "cache_key", "file_path", "line", "end_line"), tables.files(spark, d, "cache_key", "rel_path", "content"), 2)
    return rows.select("ord", "from_line", "to_line", F.sha2(F.col("body").cast("binary"), 256).alias("digest"))


@query(f"""WITH {_SYM} SELECT cache_key, file_path, count(*) AS symbols, string_agg(concat_ws(' ', line, kind, name), chr(10) ORDER BY line NULLS FIRST, byte_offset NULLS FIRST, ord) AS outline
  FROM sym WHERE kind <> 'file' GROUP BY cache_key, file_path""")
def outline_by_file(spark, d):
    return content.outline(tables.symbols(spark, d, "cache_key", "name", "line", "byte_offset"))


@query(f"""WITH {_SYM}, {_FIL} SELECT ord, (len(list_filter(regexp_extract_all(substring(hex(f.content), 1, (s.byte_offset * 2)::BIGINT), '..'), lambda x: x = '0A')) + 1)::INT AS line
  FROM sym s JOIN fil f ON s.cache_key = f.cache_key AND s.file_path = f.rel_path""")
def symbol_lines(spark, d):
    """The line that each symbol's byte offset lies in."""
    s, f = tables.symbols(spark, d, "cache_key", "file_path", "byte_offset"), tables.files(spark, d, "cache_key", "rel_path", "content")
    return s.join(f, (s.cache_key == f.cache_key) & (s.file_path == f.rel_path)).select("ord", X.line_at(f.content, s.byte_offset).alias("line"))


# Text kernel


@query(f"""WITH {_SYM} SELECT ord, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(name, ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_\\s]+'), lambda x: lower(x)), lambda x: length(x) > 1))), ' ') AS words FROM sym""")
def name_words(spark, d):
    return tables.symbols(spark, d, "name").select("ord", F.array_join(F.array_sort(X.name_words(F.col("name"))), " ").alias("words"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^a-z0-9]+'), lambda x: length(x) > 1))), ' ') AS words FROM documents")
def query_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(X.query_words(F.col("title"))), " ").alias("words"))


_STEM = """CASE WHEN length(x) > 7 AND x LIKE '%ness' THEN x[:-5] WHEN length(x) > 5 AND x LIKE '%ing' THEN x[:-4] WHEN length(x) > 4 AND x LIKE '%ed' THEN x[:-3] WHEN length(x) > 4 AND x LIKE '%ies' THEN x[:-4] || 'y'
  WHEN length(x) > 4 AND x LIKE '%es' THEN x[:-3] WHEN length(x) > 3 AND x LIKE '%s' AND NOT (x LIKE '%ss' OR x LIKE '%us' OR x LIKE '%is') THEN x[:-2] ELSE x END"""


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(replace(lower(coalesce(title, '')), 'ß', 'ss'), '[a-z0-9]+'), lambda x: {_STEM}), lambda x: length(x) >= 2), ' ') AS terms FROM documents")
def text_stems(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.stems(F.col("title")), " ").alias("terms"))


@query(f"""WITH t AS (SELECT DISTINCT doc_id, unnest({_TERMS.format(t='text')}) AS term FROM documents) SELECT term, count(*) AS document_frequency FROM t GROUP BY term""")
def term_document_frequency(spark, d):
    return anchors.document_frequency(table(spark, d, "documents"), "doc_id", F.col("text"))


@query(f"""WITH t AS (SELECT DISTINCT doc_id, unnest({_TERMS.format(t='text')}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
  SELECT term, 1 + ln((n + 1) / (count(*) + 1)) AS specificity FROM t, n GROUP BY term, n""")
def idf_specificity(spark, d):
    docs = table(spark, d, "documents")
    corpus = docs.agg(F.count("*")).scalar()
    return anchors.document_frequency(docs, "doc_id", F.col("text")).select("term", anchors.specificity(F.col("document_frequency"), corpus).alias("specificity"))


# Search

SEARCH = "resolve import"
_Q, _WORDS = SEARCH.lower(), sorted(SEARCH.lower().split())


def _low(c: str) -> str:
    return f"lower(coalesce({c}, ''))"


def _search_sql(where: str, tail: str) -> str:
    words = f"[{_list(_WORDS)}]"
    each = lambda c, n: " + ".join(f"(CASE WHEN contains({_low(c)}, '{w}') THEN {n} ELSE 0 END)" for w in _WORDS)
    name_w = "list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(name, ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_\\s]+'), lambda x: lower(x)), lambda x: length(x) > 1)"
    has = lambda x: f"len(list_intersect(list_distinct({x}), {words}))"
    split = lambda v: f"list_filter(regexp_split_to_array({v}, '[^a-z0-9]+'), lambda x: length(x) > 1)"
    key = lambda k: f"lower(coalesce(metadata.frontmatter['{k}'], ''))"
    field = lambda k, e, w: f"(CASE WHEN {key(k)} <> '' AND contains({key(k)}, '{_Q}') THEN {e} ELSE 0 END + {has(split(key(k)))} * {w})"
    tags = f"list_filter(list_transform(string_split(regexp_replace({key('tags')}, '[\\[\\]\"'']', '', 'g'), ','), lambda x: trim(x)), lambda x: x <> '')"
    tag_sum = f"coalesce(list_sum(list_transform({tags}, lambda t: CASE WHEN t = '{_Q}' THEN 16 WHEN contains(t, '{_Q}') THEN 10 ELSE 0 END + len(list_intersect(list_distinct({split('t')}), {words})) * 4)), 0)"
    front = f"(CASE WHEN metadata.frontmatter IS NULL THEN 0 ELSE {tag_sum} + " + " + ".join(field(k, e, w) for k, e, w in (("title", 8, 2), ("category", 7, 2), ("type", 7, 2), ("source", 7, 2), ("status", 7, 2), ("description", 5, 1))) + " END)"
    local = (
        f"CASE WHEN {_low('qualified_name')} = '{_Q}' THEN 25 WHEN contains({_low('qualified_name')}, '{_Q}') THEN 12 ELSE 0 END + CASE WHEN {_low('name')} = '{_Q}' THEN 20 WHEN contains({_low('name')}, '{_Q}') THEN 10 ELSE 0 END + {has(name_w)} * 5"
        f" + CASE WHEN contains({_low('signature')}, '{_Q}') THEN 8 ELSE {each('signature', 2)} END + CASE WHEN {_low('summary')} = '' THEN 0 WHEN contains({_low('summary')}, '{_Q}') THEN 5 ELSE {each('summary', 1)} END"
        f" + {each('docstring', 1)} + {has('list_transform(coalesce(keywords, []), lambda x: lower(x))')} * 3"
    )
    known = [n for n in search.KIND_WEIGHTS if n]
    weights = " ".join(f"WHEN {'language = ' + repr(n) if n else 'language NOT IN (' + _list(known) + ')'} AND kind = '{k}' THEN {w}" for n, t in search.KIND_WEIGHTS.items() for k, w in t.items())
    return f"""WITH {_SYM}, a AS (SELECT *, ({local}) AS own, {front} AS front_score FROM sym), p AS (SELECT cache_key AS pk, id AS pid, max(front_score) AS page_score FROM a WHERE metadata.frontmatter IS NOT NULL GROUP BY ALL),
      b AS (SELECT a.*, CASE WHEN own + front_score <= 0 THEN 0 ELSE own + front_score + CASE {weights} ELSE 0 END END AS base, CASE WHEN own > 0 AND coalesce(page_score, 0) > 0 THEN page_score * 0.55 ELSE 0 END AS inherited
        FROM a LEFT JOIN p ON cache_key = pk AND metadata.markdown.root_id = pid AND metadata.markdown.root_id <> id {where}),
      c AS (SELECT *, CASE WHEN metadata.markdown.page_root AND coalesce(metadata.markdown.saved_pct, 0) < 25 AND {key('title')} <> '{_Q}' THEN (base + inherited) * 0.5 ELSE base + inherited END AS s1 FROM b),
      e AS (SELECT ord, id, CASE WHEN metadata.markdown.span_kind = 'section' AND NOT coalesce(metadata.markdown.page_root, false) AND coalesce(metadata.markdown.saved_pct, 0) >= 50 AND inherited > 0 AND own > 0 THEN s1 + 8 ELSE s1 END
        * CASE WHEN list_contains(string_split(file_path, '/'), '_templates') THEN 0.5 ELSE 1 END AS score FROM c)
      SELECT ord, id, score::DOUBLE AS score FROM e WHERE score > 0 {tail}"""


_SEARCHED = ("cache_key", "id", "name", "qualified_name", "signature", "summary", "docstring", "keywords", "metadata")


@query(_search_sql("", ""))
def search_scores(spark, d):
    return search.scored(tables.symbols(spark, d, *_SEARCHED), SEARCH).select("ord", "id", "score")


@query(_search_sql("", "ORDER BY score DESC, ord LIMIT 20"))
def search_top(spark, d):
    return search.top(tables.symbols(spark, d, *_SEARCHED), SEARCH).select("ord", "id", "score")


@query(_search_sql("WHERE a.kind = 'function' AND a.language = 'python'", ""))
def search_of_kind(spark, d):
    return search.scored(tables.symbols(spark, d, *_SEARCHED), SEARCH, kind="function", language="python").select("ord", "id", "score")


@query(f"WITH {_SYM} SELECT ord FROM sym SEMI JOIN documents USING (cache_key) WHERE kind = 'function'")
def search_allowlist_semijoin(spark, d):
    allowed = table(spark, d, "documents").select("cache_key").where("cache_key IS NOT NULL").distinct()
    return tables.symbols(spark, d, "cache_key").where("kind = 'function'").join(allowed, "cache_key", "left_semi").select("ord")


QUESTION = "How does the resolver prune stale evidence of an import?"


_FIELDS = ", ".join(f"{{'scope': '{scope}', 'weight': {anchors.FIELD_WEIGHTS[scope]}, 'text': coalesce({text}, '')}}" for scope, text in (
    ("file_basename", r"regexp_replace(string_split(file_path, '/')[-1], '(.)\.[^.]*$', '\1')"), ("file_path", "file_path"), ("symbol_name", "name"), ("qualified_name", "qualified_name"), ("signature", "signature"), ("summary", "summary"), ("docstring", "docstring"), ("keywords", "array_to_string(keywords, ' ')"),
))
_FRONT = "list_transform(map_entries(coalesce(metadata.frontmatter, MAP {}::MAP(VARCHAR, VARCHAR))), lambda e: {'scope': 'page_frontmatter.' || e.key, 'weight': CASE e.key " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in anchors.FRONT_WEIGHTS.items()) + " ELSE 3.0 END, 'text': coalesce(e.value, '')})"
_ASKED = anchors.question_terms(QUESTION)
_PAIRS = [f"{a} {b}" for a, b in zip(_ASKED, _ASKED[1:])]


@query(f"""WITH {_SYM}, u AS (SELECT *, CASE WHEN language = 'markdown' THEN cache_key || '::' || file_path ELSE cache_key || '::' || id END AS unit FROM sym WHERE NOT coalesce(list_contains(string_split(file_path, '/'), '_templates'), false)),
  n AS (SELECT count(DISTINCT unit) AS corpus FROM u), f AS (SELECT ord, id, unit, unnest(list_concat([{_FIELDS}], {_FRONT})) AS f FROM u), t AS (SELECT ord, id, unit, f.scope AS scope, f.weight AS weight, {_TERMS.format(t='f.text')} AS tokens FROM f),
  h AS (SELECT *, list_filter([{_list(_ASKED)}], lambda x: list_contains(tokens, x)) AS hits FROM t), k AS (SELECT * FROM h WHERE len(hits) > 0), e AS (SELECT *, unnest(hits) AS term FROM k), d AS (SELECT term, count(DISTINCT unit) AS df FROM e GROUP BY term),
  w AS (SELECT unit, ord, id, term, max(weight * (1 + ln((corpus + 1) / (df + 1))) * (0.35 + 0.65 * (len(hits) / greatest(1, len(list_distinct(tokens)))) ** 2)) AS part FROM e JOIN d USING (term), n GROUP BY ALL),
  b AS (SELECT ord, max(CASE WHEN high AND follows THEN weight * 2 ELSE 0.0 END) AS bonus, bool_or(high) AS high FROM (SELECT ord, weight, scope IN ({_list([*anchors.HIGH_SIGNAL, "page_frontmatter.title", "page_frontmatter.tags"])}) AS high,
    len(list_filter(list_zip(tokens[:-2], tokens[2:]), lambda z: list_contains([{_list(_PAIRS)}], z[1] || ' ' || z[2]))) > 0 AS follows FROM k) GROUP BY ord),
  s AS (SELECT unit, ord, id, list_reduce(list_prepend(0.0, list_sort(list(part), 'DESC')[1:4]), lambda a, c: a + c) AS strongest, count(*) AS matched, array_to_string(list_sort(list(term)), ' ') AS matched_terms FROM w GROUP BY ALL),
  r AS (SELECT *, (strongest + bonus) * (1 + 0.25 * (least(matched, 4) / {len(_ASKED)})) AS score FROM s JOIN b USING (ord) WHERE high OR matched >= 2), o AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, id) AS k FROM r)
  SELECT (row_number() OVER (ORDER BY score DESC, id))::INT AS rank, unit, id, round(score, 6) AS score, matched_terms FROM o, n WHERE k = 1 QUALIFY rank <= least(10, CASE WHEN corpus < 11 THEN 1 ELSE greatest(1, (corpus - 1) // 10) END)""")
def anchors_inferred(spark, d):
    """Anchors of one question."""
    return anchors.inferred(tables.symbols(spark, d, "cache_key", "id", "name", "qualified_name", "signature", "summary", "docstring", "keywords", "metadata"), QUESTION)


# Graph


@query(f"""WITH {_SYM} SELECT cache_key, metadata.markdown.parent_id AS from_id, id AS to_id, file_path AS file, line FROM sym
  WHERE metadata.markdown.parent_id IS NOT NULL AND metadata.markdown.parent_id <> '' AND metadata.markdown.parent_id <> id""")
def contains_edges(spark, d):
    rows = graph.containment_edges(tables.symbols(spark, d, "cache_key", "id", "metadata", "line", "content_hash"))
    return rows.select("cache_key", "from_id", "to_id", F.col("evidence.file").alias("file"), F.col("evidence.line").alias("line"))


_REF_EDGES = """SELECT cache_key, source_id AS from_id, target_id AS to_id, CASE WHEN coalesce(binding.type_only, false) THEN 'references_type' ELSE 'references' END AS edge_type, true AS directed, 'core' AS namespace,
  coalesce(resolution_basis, 'import-resolved') AS resolution, raw.source_file AS file, raw.line AS line, raw.source_hash AS content_hash FROM ref WHERE status = 'resolved' AND source_id IS NOT NULL AND target_id IS NOT NULL AND source_id <> target_id"""


@query(f"WITH {_REF} SELECT ref_id, from_id, to_id, edge_type FROM (SELECT ref_id, {_REF_EDGES[7:]})")
def reference_edges(spark, d):
    rows = tables.references(spark, d, "cache_key", "source_id", "target_id", "status", "binding", "resolution_basis", "raw")
    made = graph.reference_edges(rows.withColumn("cache_key", F.col("ref_id")))
    return made.select(F.col("cache_key").alias("ref_id"), "from_id", "to_id", "edge_type")


_ALL_EDGES = f"""al AS (SELECT DISTINCT * FROM (SELECT cache_key, from_id, to_id, edge_type, directed, namespace, resolution, evidence.file AS file, evidence.line AS line, evidence.content_hash AS content_hash FROM edges
  UNION ALL SELECT cache_key, metadata.markdown.parent_id, id, 'contains', true, 'core', 'exact', file_path, line, content_hash FROM sym WHERE metadata.markdown.parent_id IS NOT NULL AND metadata.markdown.parent_id <> '' AND metadata.markdown.parent_id <> id
  UNION ALL {_REF_EDGES}))"""


def _all_edges(spark, d):
    listed = table(spark, d, "edges")
    held = graph.containment_edges(tables.symbols(spark, d, "cache_key", "id", "metadata", "line", "content_hash"))
    referred = graph.reference_edges(tables.references(spark, d, "cache_key", "source_id", "target_id", "status", "binding", "resolution_basis", "raw"))
    return graph.union_of(listed, held, referred)


@query(f"WITH {_SYM}, {_REF}, {_ALL_EDGES} SELECT cache_key, from_id, to_id, edge_type, directed, namespace, resolution, file, line, content_hash FROM al")
def edges_union_dedup(spark, d):
    return _all_edges(spark, d).select("cache_key", *graph.EDGE_KEY, "evidence.file", "evidence.line", "evidence.content_hash")


@query(f"""WITH {_SYM}, {_REF}, {_ALL_EDGES} SELECT cache_key, from_id, to_id, edge_type, directed, namespace, resolution, file, line, content_hash, count(*) OVER w AS evidence_count FROM al
  WINDOW w AS (PARTITION BY cache_key, from_id, to_id, edge_type, directed, namespace, resolution)
  QUALIFY row_number() OVER (PARTITION BY cache_key, from_id, to_id, edge_type, directed, namespace, resolution ORDER BY file NULLS LAST, line NULLS LAST, content_hash NULLS LAST) = 1""")
def best_evidence_per_edge(spark, d):
    return graph.best_evidence(_all_edges(spark, d))


@query(f"WITH {_EDG} SELECT edge_id FROM edg WHERE edge_type IN ('calls', 'imports') AND resolution IN ({_list(graph.SAFE_RESOLUTIONS)})")
def edges_filtered(spark, d):
    return graph.filtered(tables.edges(spark, d, "namespace", "edge_type", "resolution"), types=["calls", "imports"]).select("edge_id")


_USABLE = "us AS (SELECT * FROM edg WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND from_id <> '' AND to_id <> '')"
_EITHER = "st AS (SELECT from_id AS node_id, to_id AS neighbor_id, 'forward' AS traversed, edge_type, edge_id FROM us UNION ALL SELECT to_id, from_id, 'reverse', edge_type, edge_id FROM us WHERE from_id <> to_id)"


@query(f"WITH {_EDG}, {_USABLE}, {_EITHER} SELECT node_id, neighbor_id, traversed, edge_type, edge_id FROM st")
def adjacency_either(spark, d):
    return graph.adjacency(tables.edges(spark, d, "from_id", "to_id", "edge_type", "directed"), "either", "edge_type", "edge_id")


@query(f"""WITH {_EDG}, {_USABLE}, {_EITHER}, {_SYM}, se AS (SELECT DISTINCT id AS node_id FROM sym WHERE ord % 20 = 0),
  r AS (SELECT st.*, row_number() OVER w AS rank, count(*) OVER (PARTITION BY node_id) AS total FROM st SEMI JOIN se USING (node_id) WINDOW w AS (PARTITION BY node_id ORDER BY neighbor_id, traversed, edge_type, edge_id))
  SELECT node_id, rank::INT AS rank, neighbor_id, traversed, edge_type, edge_id, greatest(total - 64, 0) AS omitted FROM r WHERE rank <= 64""")
def neighbors_topk_omitted(spark, d):
    seeds = tables.symbols(spark, d, "id").where("ord % 20 = 0").select(F.col("id").alias("node_id"))
    return graph.neighbours(seeds, tables.edges(spark, d, "from_id", "to_id", "edge_type", "directed"), "either")


_DEGREE = "dg AS (SELECT node_id, count(*) AS degree FROM (SELECT from_id AS node_id FROM edg UNION ALL SELECT to_id FROM edg) WHERE node_id IS NOT NULL AND node_id <> '' GROUP BY node_id)"


@query(f"WITH {_EDG}, {_DEGREE} SELECT node_id, degree FROM dg")
def node_degrees(spark, d):
    return graph.degrees(tables.edges(spark, d, "from_id", "to_id"))


@query(f"WITH {_EDG}, {_DEGREE}, t AS (SELECT greatest(4, ceil(sqrt(count(*))))::BIGINT AS threshold FROM edg) SELECT node_id, degree, threshold FROM dg, t WHERE degree > threshold")
def degree_and_hubs(spark, d):
    return graph.hubs(tables.edges(spark, d, "from_id", "to_id"))


@query(f"""WITH RECURSIVE {_EDG}, {_SYM}, st AS (SELECT DISTINCT from_id, to_id FROM edg WHERE from_id <> '' AND to_id <> '' AND from_id <> to_id AND from_id IS NOT NULL AND to_id IS NOT NULL),
  p(path, last, n) AS (SELECT [id], id, 0 FROM (SELECT DISTINCT id FROM sym WHERE ord % 20 = 0) UNION ALL SELECT list_append(path, to_id), to_id, n + 1 FROM p JOIN st ON last = from_id WHERE n < 3 AND NOT list_contains(path, to_id))
  SELECT array_to_string(path, ' > ') AS path, last AS end_id, n::INT AS hops FROM p WHERE n > 0""")
def khop_simple_paths(spark, d):
    seeds = tables.symbols(spark, d, "id").where("ord % 20 = 0").select(F.col("id").alias("node_id")).distinct()
    found = graph.simple_paths(seeds, tables.edges(spark, d, "from_id", "to_id", "directed").withColumn("directed", F.lit(True)), 3)
    return found.select(F.array_join("path", " > ").alias("path"), F.col("end").alias("end_id"), (F.size("path") - 1).alias("hops"))


#: Targets of one path question; a source with more has several questions.
TARGETS_ASKED = 4


@query()
def paths_budgeted(spark, d):
    """Bounded paths from every twentieth symbol to all nodes that its edges lead to, in questions
    (id#block) of TARGETS_ASKED targets each; tested against plain searches."""
    e = tables.edges(spark, d, "from_id", "to_id", "edge_type", "directed")
    seeds = tables.symbols(spark, d, "id").where("ord % 20 = 0").select(F.col("id").alias("from_id"))
    led = e.where("to_id <> '' AND from_id <> to_id").join(seeds, "from_id", "left_semi").select("from_id", "to_id").distinct()
    block = F.floor((F.row_number().over(Window.partitionBy("from_id").orderBy("to_id")) - 1) / TARGETS_ASKED)
    asked = led.withColumn("block", block).groupBy("from_id", "block").agg(F.sort_array(F.collect_list("to_id")).alias("targets"))
    asked = asked.select(F.concat_ws("#", "from_id", F.col("block").cast("string")).alias("question_id"), F.array("from_id").alias("sources"), "targets")
    return graph.paths_between(asked, e, graph.Limits())


@query(f"""WITH RECURSIVE {_EDG}, e AS (SELECT DISTINCT from_id AS a, to_id AS b FROM edg WHERE from_id <> '' AND to_id <> ''), f AS (SELECT * FROM e SEMI JOIN (SELECT b AS x FROM e) y ON e.a = y.x SEMI JOIN (SELECT a AS z FROM e) w ON e.b = w.z),
  r(a, b) AS (SELECT a, b FROM f UNION SELECT r.a, f.b FROM r JOIN f ON r.b = f.a), c AS (SELECT DISTINCT a FROM r WHERE a = b) SELECT DISTINCT a AS node_id FROM (SELECT a FROM c UNION ALL SELECT e.a FROM e JOIN c ON e.b = c.a UNION ALL SELECT e.a FROM e JOIN r ON e.b = r.a JOIN c ON r.b = c.a)""")
def cycle_reachable(spark, d):
    """Nodes from which a cycle of edges of any type, each taken in its direction, can be reached."""
    return graph.reaching_cycles(tables.edges(spark, d, "from_id", "to_id", "edge_type", "directed").withColumn("directed", F.lit(True)))


@query(f"""WITH {_EDG}, {_SYM}, nd AS (SELECT DISTINCT id FROM (SELECT id FROM sym UNION ALL SELECT id FROM node_overlays))
  SELECT edge_id, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'MISSING_ENDPOINT' WHEN from_id = to_id AND edge_type <> 'calls' THEN 'SELF_EDGE' WHEN coalesce(resolution, '') NOT IN ({_list([*graph.SAFE_RESOLUTIONS, "heuristic"])}) THEN 'UNKNOWN_RESOLUTION'
  WHEN evidence.file IS NULL OR evidence.line IS NULL THEN 'MISSING_EVIDENCE' END AS problem FROM edg LEFT JOIN nd a ON from_id = a.id LEFT JOIN nd b ON to_id = b.id""")
def edges_validated(spark, d):
    return graph.validated(tables.edges(spark, d, "from_id", "to_id", "edge_type", "resolution", "evidence"), _nodes(spark, d)).select("edge_id", "problem")


def _nodes(spark, d):
    return tables.symbols(spark, d, "id").select("id").unionByName(table(spark, d, "node_overlays").select("id"))


@query(f"""WITH {_EDG}, {_SYM}, nd AS (SELECT id FROM sym UNION ALL SELECT id FROM node_overlays)
  SELECT id, count(*) AS edges FROM (SELECT from_id AS id FROM edg UNION ALL SELECT to_id FROM edg) e WHERE id IS NOT NULL AND id <> '' AND NOT EXISTS (SELECT 1 FROM nd WHERE nd.id = e.id) GROUP BY id""")
def missing_endpoints_anti(spark, d):
    return integrity.missing_endpoints(tables.edges(spark, d, "from_id", "to_id"), _nodes(spark, d))


# Resolution


def _observations(spark, d):
    raw = F.col("raw")
    return tables.references(spark, d, "cache_key", "raw").where(raw.isNotNull()).select(F.col("ref_id").alias("obs_id"), "cache_key", raw["source_file"].alias("file_path"), raw["start_byte"].alias("start"), raw["end_byte"].alias("end"), raw["owner"].alias("owner"))


def _spans(spark, d):
    rows = tables.symbols(spark, d, "cache_key", "id", "byte_offset", "byte_length").where("kind IN ('function', 'method', 'class')")
    return rows.select("cache_key", "file_path", F.col("id").alias("span_id"), F.col("byte_offset").alias("s_start"), (F.col("byte_offset") + F.col("byte_length")).alias("s_end"))


_SPANS = "sp AS (SELECT cache_key, file_path, id AS span_id, byte_offset AS s_start, byte_offset + byte_length AS s_end FROM sym WHERE kind IN ('function', 'method', 'class'))"


@query(f"""WITH {_REF}, {_SYM}, {_SPANS} SELECT ref_id AS obs_id, (SELECT span_id FROM sp WHERE sp.cache_key = ref.cache_key AND sp.file_path = ref.raw.source_file AND s_start <= ref.raw.start_byte AND ref.raw.end_byte <= s_end
  ORDER BY s_end - s_start, s_start DESC, span_id LIMIT 1) AS span_id FROM ref WHERE raw IS NOT NULL""")
def nearest_enclosing_interval(spark, d):
    return resolve.nearest_owner(_observations(spark, d), _spans(spark, d))


@query(f"""WITH {_REF}, {_SYM}, {_SPANS}, j AS (SELECT ref_id, count(DISTINCT span_id) AS n, min(span_id) AS s FROM ref LEFT JOIN sp ON sp.cache_key = ref.cache_key AND sp.file_path = ref.raw.source_file AND s_start = ref.raw.owner.definition_start_byte
  AND s_end = ref.raw.owner.definition_end_byte WHERE raw IS NOT NULL AND raw.owner.kind = 'callable' GROUP BY ref_id) SELECT ref_id AS obs_id, CASE WHEN n = 1 THEN s END AS span_id, CASE WHEN n = 1 THEN 'definite' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS outcome FROM j""")
def exact_span_join(spark, d):
    rows = _observations(spark, d).where("owner.kind = 'callable'").withColumn("start", F.col("owner.definition_start_byte")).withColumn("end", F.col("owner.definition_end_byte"))
    return resolve.exact_span(rows, _spans(spark, d))


@query(f"""WITH {_FIL}, ow AS (SELECT DISTINCT cache_key, regexp_replace(rel_path, '/?__init__\\.py$', '') AS dir FROM fil WHERE rel_path LIKE '%/\\_\\_init\\_\\_.py' ESCAPE '\\' OR rel_path = '__init__.py')
  SELECT cache_key, rel_path AS path, (SELECT dir FROM ow WHERE ow.cache_key = f.cache_key AND (dir = '' OR starts_with(f.rel_path, dir || '/')) ORDER BY length(dir) DESC LIMIT 1) AS owner FROM (SELECT DISTINCT cache_key, rel_path FROM fil) f""")
def longest_prefix_owner(spark, d):
    f = tables.files(spark, d, "cache_key", "rel_path")
    owners = f.where("rel_path LIKE '%/\\\\_\\\\_init\\\\_\\\\_.py' OR rel_path = '__init__.py'").select("cache_key", F.regexp_replace("rel_path", r"/?__init__\.py$", "").alias("directory"))
    return resolve.deepest_owner(f.select("cache_key", F.col("rel_path").alias("path")), owners)


@query(f"""WITH {_REF} SELECT ref_id, CASE WHEN raw IS NULL THEN 'observation_missing' WHEN raw.binding_state = 'unsupported' THEN 'unsupported_reference' WHEN raw.binding_state = 'shadowed' THEN 'binding_shadowed' WHEN raw.binding_state = 'ambiguous' THEN 'ambiguous_binding'
  WHEN import_unresolved_reason IS NOT NULL THEN 'import_unresolved' WHEN binding IS NULL THEN 'binding_missing' WHEN source_id IS NULL THEN 'ambiguous_source' WHEN target_id IS NULL THEN 'target_not_indexed' END AS reason FROM ref""")
def reference_reasons(spark, d):
    return resolve.reference_reasons(tables.references(spark, d, "raw", "binding", "source_id", "target_id", "import_unresolved_reason"))


@query(f"WITH {_REF} SELECT raw.source_file AS file, count(*) AS total, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'unresolved') AS unresolved FROM ref GROUP BY 1")
def record_counts(spark, d):
    rows = tables.references(spark, d, "raw", "status")
    return rows.groupBy(F.col("raw.source_file").alias("file")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "resolved").alias("resolved"), F.count_if(F.col("status") == "unresolved").alias("unresolved"))


@query(f"WITH {_REF} SELECT ref_id, status, CASE WHEN (SELECT count(*) FROM ref WHERE status = 'resolved') > 150 THEN 150 END AS next_offset FROM ref WHERE status = 'resolved' ORDER BY ref_id LIMIT 100 OFFSET 50")
def record_page(spark, d):
    _, rows = resolve.record_counts(tables.references(spark, d, "raw", "status"), status="resolved")
    return content.numbered(rows.select("ref_id", "status"), ["ref_id"], 50, 100)


# Integrity


@query(f"WITH {_FIL} SELECT file_id, sha256(content) = sha256 AS hash_matches, (bytes IS NULL OR bytes = octet_length(content)) AS size_matches, octet_length(content) AS size FROM fil")
def content_hash_verify(spark, d):
    return integrity.content_hashes(tables.files(spark, d, "content", "sha256", "bytes"))


_BYTES = "unhex(substring(hex(f.content), (s.byte_offset * 2 + 1)::BIGINT, (s.byte_length * 2)::BIGINT))"


@query(f"""WITH {_SYM}, {_FIL}, j AS (SELECT s.*, f.content, TRY(decode({_BYTES})) AS body, {_BYTES} AS part FROM sym s LEFT JOIN fil f ON s.cache_key = f.cache_key AND s.file_path = f.rel_path)
  SELECT ord, CASE WHEN content IS NULL THEN 'source_file_missing' WHEN kind NOT IN ('file', 'package', 'crate') AND NOT coalesce(metadata.markdown.synthetic_name, false) AND coalesce(name, '') <> '' AND NOT contains(body, name) THEN 'name_not_in_bytes'
  WHEN language = 'markdown' AND ltrim(coalesce(signature, '')) LIKE '#%' AND NOT contains(body, signature) THEN 'signature_not_in_bytes'
  WHEN coalesce(content_hash, '') <> '' AND sha256(CASE WHEN kind IN ('file', 'package', 'crate') THEN content ELSE part END) <> content_hash THEN 'content_drift' END AS problem FROM j""")
def symbols_verified(spark, d):
    """What is wrong with each symbol's place in its file."""
    s = tables.symbols(spark, d, "cache_key", "name", "signature", "byte_offset", "byte_length", "content_hash", "metadata")
    return integrity.verify_symbols(s, tables.files(spark, d, "cache_key", "rel_path", "content"))


_PARTS = "string_split(rel_path, '/')"
_EXCLUDED = f"[{_list(policy.EXCLUDED_DIRECTORIES)}]"
_NAME = f"{_PARTS}[-1]"
_SUFFIX = f"CASE WHEN {_NAME} LIKE '_%.%' AND {_NAME} NOT LIKE '%.' AND strpos(substring({_NAME}, 2), '.') > 0 THEN '.' || lower(string_split({_NAME}, '.')[-1]) ELSE '' END"
_REASON = f"""CASE WHEN len(list_intersect({_PARTS}, {_EXCLUDED})) > 0 THEN 'policy_excluded' WHEN {_NAME} IN ({_list(policy.EXCLUDED_NAMES)}) OR {_SUFFIX} IN ({_list(policy.EXCLUDED_ENDINGS)}) THEN 'sensitive_or_binary'
  WHEN {_SUFFIX} NOT IN ({_list(policy.SUPPORTED_ENDINGS)}) THEN 'unsupported_file_type' END"""
_ROOT = f"array_to_string({_PARTS}[1:list_position(list_transform({_PARTS}, lambda x: list_contains({_EXCLUDED}, x)), true)], '/')"


_AFTER = f"SELECT cache_key, rel_path AS path, max(sha256) AS hash FROM fil WHERE {_REASON} IS NULL GROUP BY ALL"
_BEFORE = "SELECT DISTINCT cache_key, file_path AS path, content_hash AS hash FROM sym WHERE kind = 'file'"


@query(f"""WITH {_SYM}, {_FIL}, a AS (SELECT cache_key, path, max(hash) AS old_hash FROM ({_BEFORE}) GROUP BY ALL), b AS (SELECT cache_key, path, hash AS new_hash FROM ({_AFTER}))
  SELECT cache_key, path, CASE WHEN old_hash IS NULL THEN 'added' WHEN new_hash IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (cache_key, path) WHERE old_hash IS DISTINCT FROM new_hash""")
def snapshot_diff(spark, d):
    return integrity.snapshot_diff(*_snapshots(spark, d))


def _snapshots(spark, d):
    before = tables.symbols(spark, d, "cache_key", "content_hash").where("kind = 'file'").groupBy("cache_key", F.col("file_path").alias("path")).agg(F.max("content_hash").alias("hash"))
    now = tables.files(spark, d, "cache_key", "rel_path", "sha256").where(policy.exclusion_reason(F.col("rel_path")).isNull())
    return before, now.groupBy("cache_key", F.col("rel_path").alias("path")).agg(F.max("sha256").alias("hash"))


@query(f"""WITH {_SYM}, {_FIL}, a AS (SELECT cache_key, path, max(hash) AS old_hash FROM ({_BEFORE}) GROUP BY ALL), b AS (SELECT cache_key, path, hash AS new_hash FROM ({_AFTER})), df AS (
  SELECT cache_key, path, CASE WHEN old_hash IS NULL THEN 'added' WHEN new_hash IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (cache_key, path) WHERE old_hash IS DISTINCT FROM new_hash)
  SELECT cache_key, change, count(*) AS paths, array_to_string(list(path ORDER BY path)[1:20], chr(10)) AS sample, greatest(count(*) - 20, 0) AS omitted FROM df GROUP BY cache_key, change""")
def snapshot_diff_samples(spark, d):
    return integrity.diff_samples(integrity.snapshot_diff(*_snapshots(spark, d)))


@query(f"""WITH {_EDG}, {_SYM}, nd AS (SELECT id FROM sym)
  SELECT id, count(*) AS edges FROM (SELECT from_id AS id FROM edg UNION ALL SELECT to_id FROM edg) e WHERE id IS NOT NULL AND id <> '' AND NOT EXISTS (SELECT 1 FROM nd WHERE nd.id = e.id) GROUP BY id""")
def endpoints_outside_symbols(spark, d):
    """Endpoints that no symbol is: those that node overlays have to stand for."""
    return integrity.missing_endpoints(tables.edges(spark, d, "from_id", "to_id"), tables.symbols(spark, d, "id"))


_TREE = "r AS (SELECT cache_key, regexp_replace(path, '/+$', '') AS path FROM repositories WHERE path <> '' UNION SELECT cache_key || '#' || split_part(rel_path, '/', 1), regexp_replace(path, '/+$', '') || '/' || split_part(rel_path, '/', 1) FROM files JOIN repositories USING (cache_key) WHERE rel_path LIKE '%/%' AND path <> '')"


@query(f"""WITH {_TREE} SELECT a.cache_key, a.path, b.cache_key AS outer_key, b.path AS outer_path FROM r a JOIN r b ON starts_with(a.path, b.path || '/') WHERE b.path <> ''""")
def nested_root_overlap(spark, d):
    """Overlaps if every top directory of a repository were a root of its own."""
    roots = table(spark, d, "repositories").select("cache_key", "path")
    top = F.split_part("rel_path", F.lit("/"), F.lit(1))
    inner = table(spark, d, "files").where("rel_path LIKE '%/%'").select("cache_key", top.alias("top")).distinct().join(roots.where("path <> ''"), "cache_key")
    return integrity.root_overlaps(roots.unionByName(inner.select(F.concat_ws("#", "cache_key", "top").alias("cache_key"), F.concat_ws("/", F.regexp_replace("path", "/+$", ""), "top").alias("path"))))


@query("""WITH r AS (SELECT cache_key, regexp_replace(path, '/+$', '') AS path FROM repositories WHERE path <> '')
  SELECT a.cache_key, a.path, b.cache_key AS outer_key, b.path AS outer_path FROM r a JOIN r b ON starts_with(a.path, b.path || '/') WHERE b.path <> ''""")
def root_overlap(spark, d):
    return integrity.root_overlaps(table(spark, d, "repositories"))


@query(f"""WITH {_FIL}, r AS (SELECT DISTINCT cache_key, {_REASON} AS reason, CASE WHEN len(list_intersect({_PARTS}, {_EXCLUDED})) > 0 THEN {_ROOT} ELSE rel_path END AS path FROM fil)
  SELECT cache_key, reason, count(*) AS paths, array_to_string(list(path ORDER BY path)[1:20], chr(10)) AS sample FROM r WHERE reason IS NOT NULL GROUP BY cache_key, reason""")
def coverage_samples(spark, d):
    return integrity.coverage(tables.files(spark, d, "cache_key", "rel_path"))


@query("""WITH p AS (SELECT id, namespace, k AS attribute, json_extract_string(attributes, '$."' || k || '"') AS value FROM (SELECT *, unnest(json_keys(attributes)) AS k FROM node_overlays))
  SELECT id, attribute, arg_min(value, namespace) AS value, min(value) <> max(value) AS conflict FROM p GROUP BY id, attribute""")
def overlay_conflicts(spark, d):
    return integrity.overlay_merge(table(spark, d, "node_overlays"))


@query(f"WITH {_SYM} SELECT cache_key, language, kind, count(*) AS symbols, count(DISTINCT file_path) AS files FROM sym GROUP BY ROLLUP (cache_key, language, kind)")
def index_summary(spark, d):
    return integrity.index_summary(tables.symbols(spark, d, "cache_key"))


@query(f"""WITH {_EDG}, {_SYM}, {_REF}, nd AS (SELECT DISTINCT id FROM (SELECT id FROM sym UNION ALL SELECT id FROM node_overlays)), v AS (SELECT count(*) AS edges, count(*) FILTER (a.id IS NULL OR b.id IS NULL OR (from_id = to_id AND edge_type <> 'calls')
  OR coalesce(resolution, '') NOT IN ({_list([*graph.SAFE_RESOLUTIONS, "heuristic"])}) OR evidence.file IS NULL OR evidence.line IS NULL) AS invalid_edges FROM edg LEFT JOIN nd a ON from_id = a.id LEFT JOIN nd b ON to_id = b.id),
  r AS (SELECT count(*) AS "references", count(*) FILTER (status = 'unresolved') AS unresolved FROM ref) SELECT edges, invalid_edges, "references", unresolved, CASE WHEN invalid_edges > 0 OR unresolved > 0 THEN 'degraded' ELSE 'ok' END AS status FROM v, r""")
def graph_health(spark, d):
    return integrity.graph_health(tables.edges(spark, d, "from_id", "to_id", "edge_type", "resolution", "evidence"), tables.references(spark, d, "status"), _nodes(spark, d))


# Telemetry

_LOG = """lg AS (SELECT event_id, ts, user_id AS session, 'repo' || (user_id % 7) AS repo, CASE WHEN event_type IN ('view', 'purchase') THEN 'get' WHEN event_type = 'click' THEN 'search' WHEN event_type = 'error' THEN 'miss' ELSE 'outline' END AS event,
  CASE WHEN event_type = 'purchase' THEN 'markdown' WHEN event_type = 'view' THEN CASE WHEN k % 2 = 0 THEN 'python' ELSE 'go' END END AS language, CASE WHEN event_type IN ('view', 'purchase') THEN 'f' || (k % 20) || '.x::s' || k END AS symbol_id,
  CASE WHEN event_type IN ('view', 'purchase') THEN CASE WHEN k % 3 = 0 THEN 'function' ELSE 'method' END END AS kind, CASE WHEN event_type IN ('view', 'purchase') THEN floor(value * 10)::BIGINT END AS symbol_bytes,
  CASE WHEN event_type IN ('view', 'purchase') THEN floor(value * 10)::BIGINT + k * 7 END AS file_bytes, CASE WHEN event_type IN ('view', 'purchase') AND k % 5 <> 0 THEN k % 10 END AS search_rank, CASE WHEN event_type IN ('view', 'purchase') AND k % 4 <> 0 THEN k END AS search_id,
  CASE WHEN event_type IN ('error', 'click') THEN 'q' || k END AS query, CASE WHEN event_type = 'click' THEN value > 5.0 END AS has_results FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)),
  gt AS (SELECT *, CASE WHEN language = 'markdown' THEN 'docs' ELSE 'code' END AS lane FROM lg WHERE event = 'get')"""
_SAVED = """count(*) AS gets, sum(symbol_bytes)::BIGINT AS symbol_bytes, greatest(sum(file_bytes) - sum(symbol_bytes), 0)::BIGINT AS saved_bytes, floor(greatest(sum(file_bytes) - sum(symbol_bytes), 0) / 4)::BIGINT AS saved_tokens,
  CASE WHEN sum(file_bytes) > 0 THEN floor(greatest(sum(file_bytes) - sum(symbol_bytes), 0) / sum(file_bytes) * 100) ELSE 0 END::BIGINT AS saved_pct, max(ts) AS last_ts"""
_CORRELATED = "co AS (SELECT g.* FROM gt g LEFT JOIN (SELECT event_id AS s_id, max(repo) AS s_repo FROM lg WHERE event = 'search' GROUP BY 1) ON search_id = s_id WHERE search_id IS NOT NULL AND (s_repo IS NULL OR s_repo = repo))"


def _log(spark, d):
    return telemetry.from_events(table(spark, d, "events"))


@query(f"WITH {_LOG} SELECT lane, {_SAVED} FROM gt GROUP BY CUBE (lane)")
def stats_lanes(spark, d):
    return telemetry.stats_lanes(_log(spark, d))


@query(f"WITH {_LOG} SELECT repo, lane, {_SAVED} FROM gt GROUP BY CUBE (repo, lane)")
def stats_by_group(spark, d):
    return telemetry.stats_by_group(_log(spark, d))


@query(f"WITH {_LOG} SELECT repo || '/' || split_part(symbol_id, '::', 1) AS file, {_SAVED} FROM gt GROUP BY 1")
def stats_by_file(spark, d):
    return telemetry.stats_by_file(_log(spark, d))


@query(f"WITH {_LOG} SELECT query, count(*) AS misses FROM lg WHERE event = 'miss' AND query IS NOT NULL AND query <> '' GROUP BY query")
def finding_search_miss(spark, d):
    return telemetry.search_misses(_log(spark, d))


@query(f"WITH {_LOG}, {_CORRELATED}, x AS (SELECT count(*) AS correlated_gets, count(*) FILTER (search_rank IS NULL) AS blind_spots FROM co) SELECT * FROM x WHERE correlated_gets > 0 AND blind_spots >= 0.15 * correlated_gets")
def finding_search_blind_spot(spark, d):
    return telemetry.blind_spots(_log(spark, d))


@query(f"WITH {_LOG}, {_CORRELATED}, x AS (SELECT count(*) AS ranked_gets, count(*) FILTER (search_rank >= 3) AS poor_ranked, sum(search_rank)::BIGINT AS rank_sum FROM co WHERE search_rank IS NOT NULL) SELECT * FROM x WHERE ranked_gets > 0 AND poor_ranked >= 0.2 * ranked_gets")
def finding_search_ranking_poor(spark, d):
    return telemetry.poor_ranking(_log(spark, d))


@query(f"WITH {_LOG}, {_SYM} SELECT kind, count(*) AS indexed_count FROM sym WHERE kind <> '' AND kind NOT IN (SELECT kind FROM gt WHERE kind IS NOT NULL) GROUP BY kind HAVING count(*) > 50")
def finding_kind_dead_weight(spark, d):
    return telemetry.dead_kinds(_log(spark, d), tables.symbols(spark, d))


@query(f"WITH {_LOG} SELECT language, sum(symbol_bytes)::BIGINT AS symbol_bytes, sum(file_bytes)::BIGINT AS file_bytes FROM gt WHERE language IS NOT NULL GROUP BY language HAVING sum(file_bytes) > 0 AND 2 * (sum(file_bytes) - sum(symbol_bytes)) < sum(file_bytes)")
def finding_poor_extraction(spark, d):
    return telemetry.poor_extraction(_log(spark, d))


@query(f"WITH {_LOG} SELECT symbol_id, count(*) AS fetch_count FROM gt GROUP BY symbol_id HAVING count(*) >= 3 ORDER BY fetch_count DESC, symbol_id LIMIT 10")
def finding_refetch_hotspot(spark, d):
    return telemetry.hotspots(_log(spark, d))


@query(f"""WITH {_LOG}, {_CORRELATED}, x AS (SELECT count(*) FILTER (event = 'get') AS gets, count(*) FILTER (event = 'search') AS searches, count(*) FILTER (event = 'miss') AS misses, min(ts) AS first_ts, max(ts) AS last_ts FROM lg)
  SELECT *, strftime(first_ts, '%Y-%m-%dT%H:%M:%SZ') AS period_from, strftime(last_ts, '%Y-%m-%dT%H:%M:%SZ') AS period_to, round(misses / (gets + misses), 3) AS miss_rate, round((SELECT count(*) FROM co) / gets, 3) AS correlated_pct FROM x""")
def usage_summary(spark, d):
    return telemetry.summary(_log(spark, d))


@query(f"""WITH {_LOG}, s AS (SELECT event_id, ts, session, repo FROM lg WHERE event = 'search' AND has_results), j AS (SELECT g.event_id, g.repo, g.ts, arg_max(s.event_id, (s.ts, s.event_id)) AS sid, arg_max(s.repo, (s.ts, s.event_id)) AS srepo, max(s.ts) AS sts
  FROM gt g LEFT JOIN s ON s.session = g.session AND s.ts <= g.ts GROUP BY ALL) SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(sts) <= 300000000 AND srepo = repo THEN sid END AS search_event_id FROM j""")
def asof_last_search(spark, d):
    return telemetry.last_search(_log(spark, d))



@query("""WITH o AS (SELECT json_extract_string(props, '$.k')::INT % 3 AS m FROM events WHERE event_type NOT IN ('view', 'purchase', 'click', 'error')), l AS (SELECT 'code' AS lane FROM o WHERE m <> 0 UNION ALL SELECT 'docs' FROM o WHERE m <> 2) SELECT lane, count(*) AS outlines FROM l GROUP BY lane""")
def stats_outline_lanes(spark, d):
    return telemetry.outline_lanes(_log(spark, d))


_NOW = "2024-01-20 00:00:00"


@query(f"WITH {_LOG}, r AS (SELECT * FROM gt WHERE ts >= TIMESTAMP '{_NOW}' - INTERVAL 7 DAY) SELECT repo, lane, {_SAVED} FROM r GROUP BY CUBE (repo, lane)")
def stats_since(spark, d):
    """Savings of the seven days before a fixed time."""
    return telemetry.stats_by_group(telemetry.since(_log(spark, d), 7, F.lit(_NOW).cast("timestamp_ntz")))


@query(f"""WITH {_LOG}, {_SYM}, {_CORRELATED}, b AS (SELECT count(*) AS n, count(*) FILTER (search_rank IS NULL) AS blind, count(search_rank) AS ranked, count(*) FILTER (search_rank >= 3) AS poor FROM co)
  SELECT 'search_miss' AS finding, query AS subject, count(*) AS count FROM lg WHERE event = 'miss' AND query IS NOT NULL AND query <> '' GROUP BY query
  UNION ALL SELECT 'search_blind_spot', NULL, blind FROM b WHERE n > 0 AND blind >= 0.15 * n UNION ALL SELECT 'search_ranking_poor', NULL, poor FROM b WHERE ranked > 0 AND poor >= 0.2 * ranked
  UNION ALL SELECT 'kind_dead_weight', kind, count(*) FROM sym WHERE kind <> '' AND kind NOT IN (SELECT kind FROM gt WHERE kind IS NOT NULL) GROUP BY kind HAVING count(*) > 50
  UNION ALL SELECT 'poor_extraction', language, sum(symbol_bytes)::BIGINT FROM gt WHERE language IS NOT NULL GROUP BY language HAVING sum(file_bytes) > 0 AND 2 * (sum(file_bytes) - sum(symbol_bytes)) < sum(file_bytes)
  UNION ALL SELECT 'refetch_hotspot', symbol_id, n FROM (SELECT symbol_id, count(*) AS n FROM gt GROUP BY symbol_id HAVING count(*) >= 3 ORDER BY n DESC, symbol_id LIMIT 10)""")
def usage_findings(spark, d):
    return telemetry.findings(_log(spark, d), tables.symbols(spark, d))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CASE WHEN age < 3600 THEN (age // 60) || 'm ago' WHEN age < 86400 THEN (age // 3600) || 'h ago' WHEN age < 604800 THEN (age // 86400) || 'd ago' ELSE strftime(ts, '%b %-d') END AS ago
  FROM (SELECT *, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) // 1000000 AS age FROM events)""")
def event_times(spark, d):
    """Times of events in ISO form and relative to a fixed time."""
    return table(spark, d, "events").select("event_id", times.iso(F.col("ts")).alias("iso"), times.relative(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).alias("ago"))
