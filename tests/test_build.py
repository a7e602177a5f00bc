"""The index of a directory, built twice, and the health and extensions of an index."""

import json

import pytest
from pyspark.sql import functions as F

from strataloom import index
from strataloom.operators import extensions, health
from strataloom.sources.store import Store


def test_index_twice(spark, tmp_path):
    root = tmp_path / "repo"
    texts = {"pkg/__init__.py": "", "pkg/a.py": "def one():\n    return 1\n", "main.py": "from pkg.a import one\n\ndef main():\n    return one()\n", "web/x.ts": 'import { y } from "@lib/y";\nexport function go() { return y(); }\n', "lib/y.ts": "export function y() {}\n", "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["lib/*"]}}}', "README.md": "# Head\n\ntext\n", "notes.txt": "x"}
    for p, t in texts.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    store = Store(spark, str(tmp_path / "store"))
    first = index.build(spark, str(root), store)
    assert (first.files, first.read, first.fresh) == (6, 6, False) and first.edges >= 4
    edges = {(r.from_id, r.to_id, r.edge_type) for r in store.load(str(root), "edges").collect()}
    assert ("main.py::main#function", "pkg/a.py::one#function", "calls") in edges
    assert ("web/x.ts::go#function", "lib/y.ts::y#function", "calls") in edges
    assert ("web/x.ts::__file__#file", "lib/y.ts::__file__#file", "imports") in edges
    again = index.ensure_fresh(spark, str(root), store)
    assert (again.read, again.fresh, again.version) == (0, True, first.version)
    (root / "pkg/a.py").write_text("def one():\n    return 2\n\ndef two():\n    return one()\n")
    (root / "README.md").unlink()
    third = index.build(spark, str(root), store)
    assert (third.files, third.read, third.fresh) == (5, 1, False)
    assert ("pkg/a.py::two#function", "pkg/a.py::one#function", "calls") in {(r.from_id, r.to_id, r.edge_type) for r in store.load(str(root), "edges").collect()}
    assert store.load(str(root), "coverage").where("reason = 'unsupported_file_type'").count() == 1
    with pytest.raises(ValueError):
        index.build(spark, str(root / "pkg"), store)


def test_coverage_probe_and_states(spark):
    files = spark.createDataFrame([("a", "x.py", 5, "h"), ("a", "y.py", 7, "h"), ("b", "z.py", 3, "h")], "cache_key string, rel_path string, bytes long, content string")
    coverage = spark.createDataFrame([("a", "policy_excluded", 2, ["v", "w"], 0), ("c", "policy_excluded", 2, ["v"], 0)], "cache_key string, reason string, paths int, samples array<string>, omitted int")
    assert {r.cache_key: (r.state, r.indexed_files, r.excluded_paths) for r in health.coverage_envelope(coverage, files).collect()} == {"a": ("partial", 2, 2), "b": ("complete", 1, 0), "c": ("unknown", 0, None)}
    probes = health.bounded_probe(files, 1, 100)
    assert {r.cache_key: (r.probe, r.code, r.observed) for r in probes.collect()} == {"a": ("unavailable", "PATH_LIMIT_EXCEEDED", 2), "b": ("complete", None, None)}
    hashes = lambda *x: spark.createDataFrame([(k, p, h) for k, p, h in x], "cache_key string, path string, hash string")
    counts = lambda *x: spark.createDataFrame(list(x), "cache_key string, reason string, paths int")
    stale = health.staleness(hashes(("a", "x", "1"), ("b", "z", "1")), hashes(("a", "x", "2"), ("b", "z", "1")), hashes(), hashes(("b", "go.mod", "1")), counts(("a", "p", 1)), counts(("a", "p", 2)))
    assert {(r.cache_key, r.reason) for r in stale.collect()} == {("a", "INDEX_COVERAGE_CHANGED"), ("a", "SOURCE_CONTENT_CHANGED"), ("b", "INDEX_COVERAGE_MISSING"), ("b", "GRAPH_INPUTS_CHANGED")}
    repos = spark.createDataFrame([("a", "/r/a", 2), ("b", "/r/b", 1), ("c", "/r/b/in", 1), ("d", "/q", 4)], "cache_key string, path string, symbols long")
    indexed = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1), ("d", 4)], "cache_key string, symbols long")
    complete = spark.createDataFrame([(k, "complete") for k in "abcd"], "cache_key string, probe string")
    states = health.store_states(repos, indexed, stale.where("cache_key = 'a'"), complete)
    assert {r.cache_key: r.states for r in states.collect()} == {"a": ["stale"], "b": ["overlap"], "c": ["overlap"], "d": ["healthy"]}
    assert health.store_summary(states).first().status == "unhealthy" and health.store_summary(states.where("cache_key = 'd'")).first().status == "healthy"
    assert [r.next_offset for r in health.store_page(states, 0, 3).collect()] == [3, 3, 3]
    assert [r.cache_key for r in health.missing_roots(repos, repos.where("cache_key <> 'd'").select("path")).collect()] == ["d"]


def test_questions_are_routed(spark):
    assert health.question_routing({"when"}) == ("suppressed", "attribute_or_measurement_question")
    assert health.question_routing({"when"}, True)[0] == "relationship" and health.question_routing({"relat"})[0] == "relationship" and health.question_routing({"x"})[1] == "non_relationship_question"
    asked = spark.createDataFrame([("Which pages support this?",), ("When was it linked?",), ("What is it?",)], "q string")
    assert [r.reason for r in health.routed(asked.coalesce(1), F.col("q")).collect()] == ["relationship_intent", "attribute_or_measurement_question", "non_relationship_question"]


SYMBOLS = "cache_key string, id string, kind string, language string, file_path string, line int, byte_offset long, metadata struct<frontmatter:map<string,string>,markdown:struct<page_root:boolean>>"


def test_profiles_and_contributions(spark):
    page = lambda i, front: ("k", f"{i}.md::r#section", "section", "markdown", f"{i}.md", 1, 0, (front, (True,)))
    symbols = spark.createDataFrame([page("a", {"status": "draft", "rel": '["b.md", "none.md", "a.md"]'}), page("b", {"status": "odd"}), ("k", "x.py::f#function", "function", "python", "x.py", 1, 0, (None, None))], SYMBOLS)
    files = spark.createDataFrame([("k", p, "h", "1\n2\n") for p in ("a.md", "b.md", "x.py")], "cache_key string, rel_path string, sha256 string, content string")
    profile = {"namespace": "team", "node_rules": [{"attributes": [{"name": "state", "source": "frontmatter.status", "value_type": "string", "allowed_values": ["draft", "done"]}]}], "edge_types": [{"type": "relates", "directed": True, "allowed_resolutions": ["declared"]}], "edge_rules": [{"type": "relates", "source": "frontmatter.rel"}]}
    texts = {"p.json": json.dumps(profile), "bad.json": "{", "d1.json": json.dumps({"namespace": "twice"}), "d2.json": json.dumps({"namespace": "twice"}), "core.json": json.dumps({"namespace": "core"})}
    rules, types, edge_rules, problems = extensions.profiles(spark, texts)
    assert sorted((r.code, r.subject) for r in problems.collect()) == [("DUPLICATE_NAMESPACE", "d1.json"), ("DUPLICATE_NAMESPACE", "d2.json"), ("INVALID_EXTENSION", "bad.json"), ("INVALID_PROFILE", "core.json")]
    values, bad = extensions.profile_attributes(symbols, rules)
    assert [(r.id, r.value) for r in values.collect()] == [("a.md::r#section", "draft")] and [r.subject for r in bad.collect()] == ["b.md::r#section"]
    edges, bad = extensions.profile_edges(symbols, edge_rules, files)
    assert [(r.from_id, r.to_id, r.evidence.line) for r in edges.collect()] == [("a.md::r#section", "b.md::r#section", 1)]
    assert {(r.code, r.detail) for r in bad.collect()} == {("REFERENCE_UNRESOLVED", "none.md"), ("SELF_EDGE", "a.md")}
    at = lambda **x: {"from": "a.md::r#section", "to": "x.py::f#function", "type": "relates", "directed": True, "resolution": "declared", "evidence": {"file": "a.md", "line": 1, "content_hash": "h"}, **x}
    given = {"namespace": "team", "nodes": [{"id": "a.md::r#section", "kind": "section", "attributes": {"state": "done"}}, {"id": "none", "kind": "section", "attributes": {"state": "done"}}, {"id": "b.md::r#section", "kind": "file", "attributes": {"state": "done"}}], "edges": [at(), at(type="odd"), at(resolution="exact"), at(to="none"), at(evidence={"file": "a.md", "line": 9, "content_hash": "h"}), at(evidence={"file": "a.md", "line": 1, "content_hash": "old"}), at(directed=False)]}
    nodes, made, problems = extensions.contributions(spark, {"c.json": json.dumps(given), "o.json": json.dumps({"namespace": "other", "nodes": [{"id": "a.md::r#section", "kind": "section", "attributes": {"q": "1"}}]})})
    good, bad = extensions.contributed_nodes(nodes, symbols, rules)
    assert [r.id for r in good.collect()] == ["a.md::r#section"]
    assert sorted(r.code for r in bad.collect()) == ["ENDPOINT_NOT_FOUND", "NODE_ATTRIBUTE_INVALID", "PROFILE_NOT_FOUND"] and problems.count() == 0
    kept, bad = extensions.contributed_edges(made, symbols, types, files)
    assert kept.count() == 1 and [r.code for r in bad.orderBy("subject").collect()] == ["EDGE_TYPE_UNSUPPORTED", "RESOLUTION_UNSUPPORTED", "ENDPOINT_NOT_FOUND", "EVIDENCE_LINE_INVALID", "EVIDENCE_STALE", "INVALID_EDGE"]
    merged, bad = extensions.merged_overlays(values.withColumn("source", F.lit("0")).unionByName(good))
    assert [(r.attribute, r.value) for r in merged.collect()] == [("state", "draft")] and [r.code for r in bad.collect()] == ["NODE_ATTRIBUTE_CONFLICT"]
