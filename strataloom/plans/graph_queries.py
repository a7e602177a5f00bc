"""Queries of paths, their evidence, gate and score, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataloom.functions import text as X
from strataloom.operators import graph, tables
from strataloom.plans.index_queries import _EDG, _FIL, _STEM, _SYM, _list, query

QUESTION = "Why does the budget link a profile import and support each pruned snapshot?"


def _stems_sql(t: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(replace(lower({t}), 'ß', 'ss'), '[a-z0-9]+'), lambda x: {_STEM}), lambda x: length(x) >= 2)"


_Q = f"SELECT list_distinct({_stems_sql(repr(QUESTION))}) AS q, {_stems_sql(repr(' '.join(X.RELATION_WORDS)))} AS rel, list_transform([{_list(X.QUESTION_STOP_WORDS)}], lambda x: {_STEM}) AS stop"
_ND = "nd AS (SELECT id, min(concat_ws(' ', name, qualified_name, file_path, summary)) AS text FROM sym WHERE id IS NOT NULL GROUP BY id)"
_REL = "rl AS (SELECT id, text, len(list_intersect(list_filter(q, lambda x: NOT list_contains(stop, x)), " + _stems_sql("text") + ")) AS relevance FROM nd, ask)"


def _texts(spark, d) -> DataFrame:
    text = F.concat_ws(" ", "name", "qualified_name", "file_path", "summary")
    return tables.symbols(spark, d, "id", "name", "qualified_name", "summary").where("id IS NOT NULL").groupBy(F.col("id").alias("node_id")).agg(F.min(text).alias("text"))


@query(f"WITH {_SYM}, ask AS ({_Q}), {_ND}, {_REL} SELECT id AS node_id, relevance, relevance + CASE WHEN relevance >= 3 THEN least(10.0, relevance * 20 / 10) ELSE 0.0 END AS priority FROM rl")
def node_priority(spark, d):
    """Question terms of each node, and its priority if nodes with three and more were anchors."""
    found = graph.node_relevance(_texts(spark, d), F.lit(QUESTION))
    anchors = found.where("relevance >= 3").select("node_id", (F.col("relevance") * 20).alias("score"))
    return graph.node_priority(found, anchors)


_STEPS = "st AS (SELECT from_id, to_id, min(edge_id) AS edge_id FROM edg WHERE from_id <> '' AND to_id <> '' AND from_id <> to_id GROUP BY from_id, to_id)"
_WALKS = """w AS (SELECT [from_id, to_id] AS nodes, [edge_id] AS edges FROM st SEMI JOIN (SELECT id FROM sym WHERE ord % 20 = 0) s ON st.from_id = s.id
  UNION ALL SELECT [a.from_id, a.to_id, b.to_id], [a.edge_id, b.edge_id] FROM st a SEMI JOIN (SELECT id FROM sym WHERE ord % 20 = 0) s ON a.from_id = s.id JOIN st b ON a.to_id = b.from_id WHERE a.from_id <> b.to_id)"""


def _steps(spark, d) -> DataFrame:
    e = tables.edges(spark, d, "from_id", "to_id")
    return e.where("from_id <> '' AND to_id <> '' AND from_id <> to_id").groupBy("from_id", "to_id").agg(F.min("edge_id").alias("edge_id"))


def _walks(spark, d) -> DataFrame:
    """Walks of one and two steps from every twentieth symbol, with the first edge of each step."""
    steps = _steps(spark, d)
    seeds = tables.symbols(spark, d, "id").where("ord % 20 = 0").select(F.col("id").alias("from_id")).distinct()
    one = steps.join(seeds, "from_id", "left_semi")
    two = one.alias("a").join(steps.alias("b"), F.col("a.to_id") == F.col("b.from_id")).where("a.from_id <> b.to_id")
    return one.select(F.array("from_id", "to_id").alias("nodes"), F.array("edge_id").alias("edges")).unionByName(two.select(F.array("a.from_id", "a.to_id", "b.to_id").alias("nodes"), F.array("a.edge_id", "b.edge_id").alias("edges")))


def _judged(spark, d) -> DataFrame:
    """The walks with their ends' texts and relevance, inner degree and evidence text.

    The evidence of a step is where its edge was seen (type and file of the edge)."""
    e = tables.edges(spark, d, "from_id", "to_id", "edge_type", "evidence").where("from_id <> '' AND to_id <> ''")
    seen = e.select("edge_id", F.concat_ws(" ", "edge_type", F.col("evidence.file")).alias("seen"))
    nodes = graph.node_relevance(_texts(spark, d), F.lit(QUESTION)).join(_texts(spark, d), "node_id")
    walks = _walks(spark, d).withColumn("first", F.element_at("nodes", 1)).withColumn("last", F.element_at("nodes", -1)).withColumn("inner", F.get("nodes", F.when(F.size("nodes") == 3, F.lit(1)).otherwise(F.lit(99))))
    a = nodes.select(F.col("node_id").alias("first"), F.col("text").alias("first_text"), F.col("relevance").alias("r0"))
    b = nodes.select(F.col("node_id").alias("last"), F.col("text").alias("last_text"), F.col("relevance").alias("r1"))
    inner = graph.degrees(tables.edges(spark, d, "from_id", "to_id")).select(F.col("node_id").alias("inner"), "degree")
    text = walks.select("nodes", F.posexplode("edges").alias("at", "edge_id")).join(seen, "edge_id").groupBy("nodes").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("at", "seen"))), lambda x: x["seen"])).alias("evidence"))
    joined = walks.join(a, "first", "left").join(b, "last", "left").join(inner, "inner", "left").join(text, "nodes")
    # The threshold is one number, out of a count.
    threshold = tables.edges(spark, d).agg(F.greatest(F.lit(4), F.ceil(F.sqrt(F.count("*")))).alias("t")).scalar()
    return joined.withColumn("threshold", threshold)


_JUDGED = f"""{_EDG}, {_SYM}, ask AS ({_Q}), {_ND}, {_REL}, {_STEPS}, {_WALKS},
  dg AS (SELECT node_id, count(*) AS degree FROM (SELECT from_id AS node_id FROM edg UNION ALL SELECT to_id FROM edg) WHERE node_id IS NOT NULL AND node_id <> '' GROUP BY node_id),
  th AS (SELECT greatest(4, ceil(sqrt(count(*))))::BIGINT AS threshold FROM edg),
  sn AS (SELECT edge_id, concat_ws(' ', edge_type, evidence.file) AS seen FROM edg),
  j AS (SELECT nodes, len(nodes) - 1 AS hops, a.text AS first_text, b.text AS last_text, coalesce(a.relevance, 0) + coalesce(b.relevance, 0) AS ends, coalesce(degree, 0) AS degree, threshold, q, rel, stop,
    {_stems_sql("concat_ws(' ', s1.seen, s2.seen)")} AS ev
    FROM w CROSS JOIN th CROSS JOIN ask LEFT JOIN rl a ON a.id = nodes[1] LEFT JOIN rl b ON b.id = nodes[-1] LEFT JOIN dg ON len(nodes) = 3 AND node_id = nodes[2] LEFT JOIN sn s1 ON s1.edge_id = edges[1] LEFT JOIN sn s2 ON s2.edge_id = edges[2])"""


def _asked() -> Column:
    stop = F.transform(X.words_array(X.QUESTION_STOP_WORDS), X.stem)
    return F.array_distinct(F.filter(X.stems(F.lit(QUESTION)), lambda w: ~F.array_contains(stop, w)))


@query(f"""WITH {_JUDGED} SELECT array_to_string(nodes, ' > ') AS path, hops::INT AS hops, least(4.0, ends / 4) AS endpoint, len(list_intersect(ev, list_filter(q, lambda x: NOT list_contains(stop, x)))) AS evidence_hits,
  greatest(degree - threshold, 0) / threshold AS hub, round(least(4.0, ends / 4) + len(list_intersect(ev, list_filter(q, lambda x: NOT list_contains(stop, x)))) / greatest(1, len(list_filter(q, lambda x: NOT list_contains(stop, x)))) + 1 / hops + CASE WHEN hops = 1 THEN 0.5 ELSE 0.0 END
  - 0.25 * (greatest(degree - threshold, 0) / threshold), 6) AS score FROM j""")
def path_score_components(spark, d):
    """Score of each walk for a question, with its parts; no node is an anchor."""
    hops, relevance = F.size("nodes") - 1, F.coalesce("r0", F.lit(0)) + F.coalesce("r1", F.lit(0))
    hits = F.size(F.array_intersect(X.stems(F.col("evidence")), _asked()))
    hub = F.greatest(F.coalesce("degree", F.lit(0)) - F.col("threshold"), F.lit(0)) / F.col("threshold")
    score = graph.path_score(F.lit(0.0), relevance, hits / F.greatest(F.lit(1), F.size(_asked())), hops, hub)
    return _judged(spark, d).select(F.array_join("nodes", " > ").alias("path"), hops.alias("hops"), F.least(F.lit(4.0), relevance / 4).alias("endpoint"), hits.cast("long").alias("evidence_hits"), hub.alias("hub"), F.round(score, 6).alias("score"))


_REASON = f"""CASE WHEN hops <= 1 OR len(list_intersect(list_filter(list_intersect(q, rel), lambda x: NOT list_contains(stop, x) AND NOT list_contains({_stems_sql("concat_ws(' ', first_text, last_text)")}, x)), ev)) > 0 THEN NULL
  WHEN degree > threshold THEN 'HUB_SHORTCUT' ELSE 'SEMANTIC_BRIDGE_MISSING' END"""


def _reasons(spark, d) -> DataFrame:
    ask = F.lit(QUESTION)
    over = F.coalesce(F.col("degree") > F.col("threshold"), F.lit(False))
    reason = graph.semantic_gate(F.size("nodes") - 1, X.bridge_terms(ask, F.col("first_text"), F.col("last_text")), X.relation_terms(ask), X.stems(F.col("evidence")), over)
    return _judged(spark, d).withColumn("reason", reason)


@query(f"WITH {_JUDGED} SELECT array_to_string(nodes, ' > ') AS path, {_REASON} AS reason FROM j")
def semantic_gate(spark, d):
    return _reasons(spark, d).select(F.array_join("nodes", " > ").alias("path"), "reason")


@query(f"""WITH {_JUDGED}, r AS (SELECT nodes, ends, {_REASON} AS reason FROM j), k AS (SELECT nodes[1] AS question_id, nodes, ends, reason, row_number() OVER (PARTITION BY nodes[1], list_sort([nodes[1], nodes[-1]]) ORDER BY ends DESC, len(nodes), reason, nodes) AS n FROM r WHERE reason IS NOT NULL),
  f AS (SELECT question_id, nodes, reason, row_number() OVER (PARTITION BY question_id ORDER BY ends DESC, len(nodes), reason, nodes) AS rank FROM k WHERE n = 1), t AS (SELECT question_id, count(*) AS total FROM k GROUP BY question_id)
  SELECT question_id, array_to_string(nodes, ' > ') AS path, reason, rank::INT AS rank, total - count(*) OVER (PARTITION BY question_id) AS omitted_rejected_paths FROM f JOIN t USING (question_id) WHERE rank <= 8""")
def best_rejections(spark, d):
    """The best rejected walks of each start, one for each pair of ends."""
    rows = _reasons(spark, d).where("reason IS NOT NULL").select(F.element_at("nodes", 1).alias("question_id"), F.col("nodes").alias("node_ids"), "reason", F.lit(0).alias("anchor_signal"), (F.coalesce("r0", F.lit(0)) + F.coalesce("r1", F.lit(0))).alias("relevance"))
    return graph.best_rejections(rows, 8).select("question_id", F.array_join("node_ids", " > ").alias("path"), "reason", "rank", "omitted_rejected_paths")


_BOTH = "e2 AS (SELECT from_id AS a, to_id AS b FROM st UNION SELECT to_id, from_id FROM st)"


@query(f"""WITH {_EDG}, {_SYM}, {_STEPS}, {_BOTH}, p AS (SELECT [x.a, x.b, y.b] AS n FROM e2 x SEMI JOIN (SELECT id FROM sym WHERE ord % 20 = 0) s ON x.a = s.id JOIN e2 y ON x.b = y.a WHERE x.a <> y.b AND y.b IN (SELECT id FROM sym WHERE ord % 20 = 0))
  SELECT DISTINCT array_to_string(least(n, list_reverse(n)), ' > ') AS path FROM p""")
def undirected_paths(spark, d):
    """Walks of two steps in any direction between every twentieth symbols, each once whichever end it begins at."""
    seeds = tables.symbols(spark, d, "id").where("ord % 20 = 0").select(F.col("id").alias("a")).distinct()
    st = _steps(spark, d)
    both = st.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).union(st.select("to_id", "from_id")).distinct()
    # Each end is a seed, so both halves of a walk are short before they meet.
    half = both.join(seeds, "a", "left_semi")
    found = half.alias("x").join(half.alias("y"), F.col("x.b") == F.col("y.b")).where("x.a <> y.a").select(F.lit("q").alias("question_id"), F.array("x.a", "x.b", "y.a").alias("node_ids"))
    return found.select(F.array_join(graph.undirected(F.col("node_ids")), " > ").alias("path")).distinct()


_TEXT_LINES = r"regexp_extract_all(decode(content), '(?s)(.*?(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])|.+$)', 1)"


@query(f"""WITH {_EDG}, {_FIL}, a AS (SELECT edge_id, cache_key, evidence.file AS file, evidence.line AS line FROM edg), f AS (SELECT cache_key, rel_path AS file, {_TEXT_LINES} AS ls FROM fil WHERE content IS NOT NULL)
  SELECT edge_id, a.file, line, CASE WHEN line >= 1 THEN sha256(ls[line]) END AS digest FROM a LEFT JOIN f USING (cache_key, file)""")
def evidence_lines(spark, d):
    """The line that each edge names as its evidence, as a hash."""
    found = graph.evidence_lines(tables.edges(spark, d, "cache_key", "evidence"), tables.files(spark, d, "cache_key", "rel_path", "content"))
    return found.select("edge_id", "file", "line", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


_MOST = 2_000


@query(f"""WITH RECURSIVE {_EDG}, {_FIL}, {_SYM}, {_STEPS}, {_WALKS}, a AS (SELECT edge_id, cache_key, evidence.file AS file, evidence.line AS line FROM edg), f AS (SELECT cache_key, rel_path AS file, {_TEXT_LINES} AS ls FROM fil WHERE content IS NOT NULL),
  sz AS (SELECT edge_id, CASE WHEN line >= 1 AND ls[line] <> '' THEN octet_length(encode(ls[line])) END AS bytes FROM a LEFT JOIN f USING (cache_key, file)),
  p AS (SELECT nodes[1] AS qid, nodes, CASE WHEN x.bytes IS NOT NULL AND (edges[2] IS NULL OR y.bytes IS NOT NULL) THEN x.bytes + coalesce(y.bytes, 0) END AS bytes FROM w LEFT JOIN sz x ON x.edge_id = edges[1] LEFT JOIN sz y ON y.edge_id = edges[2]),
  o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY len(nodes), nodes) AS n FROM p),
  g AS (SELECT qid, nodes, n, bytes, coalesce(bytes <= {_MOST}, false) AS fits, {_MOST} - CASE WHEN bytes <= {_MOST} THEN bytes ELSE 0 END AS room FROM o WHERE n = 1
    UNION ALL SELECT o.qid, o.nodes, o.n, o.bytes, coalesce(o.bytes <= g.room, false), g.room - CASE WHEN o.bytes <= g.room THEN o.bytes ELSE 0 END FROM g JOIN o ON o.qid = g.qid AND o.n = g.n + 1)
  SELECT qid AS question_id, (n - 1)::INT AS path_no, array_to_string(nodes, ' > ') AS path, bytes AS evidence_bytes, CASE WHEN bytes IS NULL THEN 'EVIDENCE_UNAVAILABLE' WHEN NOT fits THEN 'EVIDENCE_BUDGET_EXCEEDED' END AS reason FROM g""")
def paths_with_evidence(spark, d):
    """All walks of each start with their evidence, as far as the lines' bytes have room."""
    ordered = Window.partitionBy("question_id").orderBy(F.size("node_ids"), "node_ids")
    paths = _walks(spark, d).select(F.element_at("nodes", 1).alias("question_id"), F.col("nodes").alias("node_ids"), F.col("edges").alias("edge_ids")).withColumn("path_no", F.row_number().over(ordered) - 1)
    found = graph.with_evidence(paths, tables.edges(spark, d, "cache_key", "evidence"), tables.files(spark, d, "cache_key", "rel_path", "content"), graph.Limits(evidence_bytes=_MOST))
    return found.select("question_id", "path_no", F.array_join("node_ids", " > ").alias("path"), "evidence_bytes", "reason")
