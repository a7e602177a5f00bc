"""The API functions give rows of the expected columns on the smallest tables."""

import pytest

from strataloom import api
from strataloom.operators import graph, tables


def test_tools(spark, small):
    repo = api.list_repositories(spark, small).first().cache_key
    assert "score" in api.search(spark, small, "resolve").columns
    first = api.search(spark, small, "", limit=1).first()
    assert api.get(spark, small, first.cache_key, [first.id]).count() == 1
    assert api.get(spark, small, first.cache_key, [first.id], 2).count() <= 1
    assert api.outline(spark, small, first.cache_key).count() >= 1
    assert api.file(spark, small, first.cache_key, first.file_path, 1, 3).count() >= 1
    assert api.grep(spark, small, first.cache_key, "def|fn").count() >= 0
    assert api.graph_anchors(spark, small, "stale import evidence").count() >= 1
    assert api.graph_neighbors(spark, small, [first.id]).count() >= 0
    assert api.graph_traverse_neighbors(spark, small, [first.id], direction="either").count() >= 0
    assert api.graph_health(spark, small).count() == 1
    counts, page = api.graph_references(spark, small, status="resolved", limit=5)
    assert counts.first().total >= page.count()
    counts, page = api.graph_imports(spark, small, repo, limit=3)
    assert page.count() <= 3 and counts.first().total >= page.count()
    counts, page = api.graph_calls(spark, small, repo, status="unresolved", limit=3)
    assert page.count() <= 3 and counts.first().total == counts.first().resolved + counts.first().unresolved
    assert api.verify(spark, small, repo).count() >= 0
    summary, page = api.store_health(spark, small, limit=10)
    assert summary.first().repositories == 48 and page.count() == 10
    assert api.stats(spark, small, all_time=True).count() >= 1
    summary, findings = api.analyze(spark, small, since_days=10_000)
    assert summary.count() == 1 and "finding" in findings.columns and findings.count() >= 1


def test_retrieve(spark, small):
    assert api.graph_retrieve(spark, small, "What is it?").count() == 0
    edge = graph.filtered(tables.edges(spark, small, "from_id", "to_id", "namespace", "edge_type", "resolution")).where("from_id <> to_id AND to_id <> ''").first()
    rows = api.graph_retrieve(spark, small, "Which pages support it?", seed_ids=[edge.from_id, edge.to_id])
    assert set(rows.columns) == {"path_no", "node_ids", "score", "reason"}
    found = rows.collect()
    assert all((r.score is None) != (r.reason is None) for r in found)
    assert any(sorted((r.node_ids[0], r.node_ids[-1])) == sorted((edge.from_id, edge.to_id)) for r in found)
    paths = api.graph_paths(spark, small, [edge.from_id], [edge.to_id]).collect()
    assert paths and all((r.reason is None) == (r.evidence_bytes is not None) or r.reason == "EVIDENCE_BUDGET_EXCEEDED" for r in paths)


def test_limits(spark, small):
    with pytest.raises(ValueError):
        api.search(spark, small, "x", limit=0)
    with pytest.raises(ValueError):
        api.graph_traverse_neighbors(spark, small, [])
