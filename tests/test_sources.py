"""Scans, control files, the store, logs and streams."""

import json

import pytest
from pyspark.sql import functions as F

from strataloom.sources import manifests, scan, usage_log
from strataloom.sources.store import Store
from strataloom.streaming import usage


def test_scan_with_ignore_rules(spark, tmp_path):
    for name in ("a.py", "b.txt", "out/c.py", "keep/out.py", "node_modules/x/y.js", "node_modules/z.js", "logs/d.py", "logs/keep.py", "conf/credentials.json"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(name)
    kept, out = scan.scan(spark, str(tmp_path), "k", "# x\n/out/\nlogs/*\n!logs/keep.py\n")
    assert {r.rel_path for r in kept.collect()} == {"a.py", "keep/out.py", "logs/keep.py"}
    assert {(r.reason, r.path) for r in out.collect()} == {("policy_excluded", "node_modules"), ("sensitive_or_binary", "conf/credentials.json"), ("unsupported_file_type", "b.txt")}
    assert scan.listing(spark, str(tmp_path), 5).count() == 2
    new, same = scan.changed(kept.withColumn("sha256", F.when(F.col("rel_path") == "a.py", "x").otherwise(F.col("sha256"))), kept)
    assert ([r.rel_path for r in new.collect()], same.count()) == (["a.py"], 2)


@pytest.mark.parametrize(("rule", "path", "hit"), [("*.pyc", "a/b.pyc", True), ("/a", "b/a", False), ("a/", "x/a/y", True), ("**/t", "x/y/t", True), ("a/**", "a/b/c", True), ("x[0-9].py", "x3.py", True), ("?.py", "ab.py", False)])
def test_ignore_rules(spark, rule, path, hit):
    assert spark.range(1).select(scan.ignored(F.lit(path), scan.ignore_rules(rule)).alias("x")).first().x is hit


def test_go_mod():
    found = manifests.go_mod(b"module ex.org/m // x\ngo 1.22\nrequire (\n a/b v1\n)\nreplace a/b => ../b\nreplace c => d v1\n")
    assert found == {"module": "ex.org/m", "require": ["a/b"], "replace": {"a/b": "../b"}, "use": []}
    with pytest.raises(manifests.ManifestError):
        manifests.go_mod(b"x" * (2 << 20))


def test_json_bounds():
    for text, code in (('{"a":1,"a":2}', "DUPLICATE_KEY"), ("[NaN]", "NON_FINITE_NUMBER"), ("[" * 20 + "]" * 20, "TOO_DEEP"), (json.dumps("x" * 5000), "STRING_TOO_LONG")):
        with pytest.raises(manifests.ManifestError) as e:
            manifests.bounded_json(text)
        assert e.value.code == code
    assert manifests.strip_jsonc('{"a": "//x", /* c */ "b": [1, 2,],} // d') .replace(" ", "") == '{"a":"//x","b":[1,2]}'


def test_packages():
    exports = {".": {"import": "./a.mjs", "default": "./a.cjs"}, "./x/*": "./src/*.js", "./x/y": "./y.js", "./bad": "../z.js"}
    pick = lambda k, *c: manifests.package_target(exports, k, set(c))
    assert [pick(".", "import"), pick("."), pick("./x/q"), pick("./x/y"), pick("./bad"), pick("./none")] == ["./a.mjs", "./a.cjs", "./src/q.js", "./y.js", None, None]
    configs = {"a": {"extends": "b", "paths": 1}, "b": {"extends": None, "baseUrl": ".", "paths": 2}, "c": {"extends": "c"}}
    assert manifests.inherited(configs, "a") == {"baseUrl": ".", "paths": 1}
    with pytest.raises(manifests.ManifestError):
        manifests.inherited(configs, "c")


def test_cargo():
    found = manifests.cargo(b'[package]\nname = "my-c"\nedition = "2021"\n[[bin]]\nname = "t"\n[dependencies]\nx-y = {path = "../x"}\n')
    assert found["dependencies"] == {"x_y": {"package": "x-y", "path": "../x"}}
    paths = {"c/src/lib.rs", "c/src/bin/t.rs", "c/src/bin/u/main.rs"}
    assert manifests.cargo_targets(found, "c", paths) == [("bin", "t", "c/src/bin/t.rs"), ("lib", "my_c", "c/src/lib.rs"), ("bin", "u", "c/src/bin/u/main.rs")]
    assert manifests.workspace_members(["a/*", "!a/x"], {"a/x", "a/y", "b"}) == ["a/y"]


def test_store_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.load("/r", "files") is None
    store.write("/r", {"files": spark.range(3)})
    old = store.load("/r", "files")
    store.write("/r", {"files": spark.range(5)})
    assert (old.count(), store.load("/r", "files").count()) == (3, 5)
    assert store.catalog()[store.key("/r")]["path"] == "/r" and store.pending() == []
    (tmp_path / "s" / store.key("/r") / "_entry").unlink()
    (tmp_path / "s" / "dead._pending").write_text("{}")
    assert store.pending() == ["dead"]
    assert store.repair()[store.key("/r")]["tables"] == ["files"] and store.pending() == []
    assert store.invalidate("/r") and not store.invalidate("/r") and store.load("/r", "files") is None


def test_store_identity_and_cleaning(spark, tmp_path):
    from strataloom.sources.store import legacy_counts, resolved_root

    store = Store(spark, str(tmp_path / "s"))
    own = store.identity()
    assert own == store.identity() == Store(spark, str(tmp_path / "s")).identity()
    (tmp_path / "here").mkdir()
    for path in (str(tmp_path / "here"), str(tmp_path / "gone")):
        store.write(path, {"files": spark.range(1)})
    assert store.clean() == [str(tmp_path / "gone")] and [v["path"] for v in store.catalog().values()] == [str(tmp_path / "here")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x").write_text("x")
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "t")).identity()
    assert Store(spark, str(tmp_path / "t")).identity(adopt=True)
    assert resolved_root(spark, "/b") == "/b" and resolved_root(spark) == ".strataloom"
    (tmp_path / "old.json").write_text(json.dumps({"repo_path": "/r", "symbols": [{"id": "a", "x": 1}, {"id": "b"}], "graph": {}}, indent=1))
    assert [tuple(r) for r in legacy_counts(spark, str(tmp_path / "old.json")).collect()] == [("/r", 2)]


def test_log_reads(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text('{"ts": 1, "symbol_id": "a"}\n{broken\n{"ts": 2, "event": "search"}\n')
    assert [r.event for r in usage_log.read(spark, str(path)).orderBy("ts").collect()] == ["get", "search"]
    with pytest.raises(Exception):
        usage_log.read(spark, str(path), strict=True).collect()


EVENTS = [
    {"ts": 1000.0, "event": "search", "session": "s", "repo": "r", "search_id": "q1", "results": ["a", "b"]},
    {"ts": 1010.0, "session": "s", "repo": "r", "symbol_id": "b", "symbol_bytes": 1, "file_bytes": 10, "language": "python"},
    {"ts": 1011.0, "session": "s", "repo": "other", "symbol_id": "b", "symbol_bytes": 1, "file_bytes": 10, "language": "markdown"},
    {"ts": 1400.0, "session": "s", "repo": "r", "symbol_id": "a", "symbol_bytes": 1, "file_bytes": 10, "language": "python"},
]


def _streamed(spark, tmp_path, make, name, mode):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, EVENTS)))
    q = make(usage_log.stream(spark, str(tmp_path / "in"))).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_streamed_gets_find_their_search(spark, tmp_path):
    rows = _streamed(spark, tmp_path, usage.related_gets, "related", "append")
    assert {(r.ts, r.search_id, r.search_rank) for r in rows} == {(1010.0, "q1", 1), (1011.0, None, None), (1400.0, None, None)}


def test_streamed_savings(spark, tmp_path):
    rows = _streamed(spark, tmp_path, usage.windowed_savings, "savings", "complete")
    assert sorted((r.lane, r.gets, r.file_bytes) for r in rows) == [("code", 1, 10), ("code", 1, 10), ("docs", 1, 10)]
