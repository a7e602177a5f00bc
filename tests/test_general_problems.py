"""Nested records and heavy keys against plain Python."""

import datetime as dt
import json
import random

import pytest
from hypothesis import given, settings, strategies as st

from strataloom.operators import heavy_keys, nested

EDGE = "edge_id long, cache_key string, from_id string, to_id string, edge_type string, observed_at timestamp_ntz"


def plain_states(rows):
    out = {}
    for edge, _, source, to, kind, at in rows:
        if to:
            s = out.setdefault((to, kind), [set(), set(), None])
            s[0].add((edge, source))
            s[1].add(source)
            s[2] = max(x for x in (s[2], at) if x is not None) if (s[2] or at) else None
    return {k: (len(a), len(b), c) for k, (a, b, c) in out.items()}


def states_of(spark, rows, schema=EDGE):
    found = heavy_keys.key_states(spark.createDataFrame(rows, schema)).collect()
    return {(r.to_id, r.edge_type): (r.n_edges, r.n_from, r.last_observed) for r in found}


def test_heavy_keys_equal_plain_counts(spark):
    rng = random.Random(3)
    day = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(6000):
        to = "hot" if rng.random() < 0.4 else rng.choice(["", None, "a", "b", f"n{rng.randrange(300)}"])
        row = (i, "k", rng.choice([None, f"f{rng.randrange(50)}", f"g{i}"]), to, rng.choice(["calls", "imports", None]), rng.choice([None, day + dt.timedelta(minutes=rng.randrange(9999))]))
        rows += [row] * rng.choice([1, 1, 1, 3])
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        assert states_of(spark, rows) == plain_states(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_heavy_keys_of_nothing_and_of_one_key(spark):
    assert states_of(spark, []) == {}
    assert states_of(spark, [(1, None, None, "x", None, None)] * 3) == {("x", None): (1, 1, None)}
    wider = spark.createDataFrame([(1, "k", "f", "t", "calls", None, 7, 8)], EDGE + ", part int, us long")
    assert heavy_keys.key_states(wider).count() == 1
    assert heavy_keys.heavy_pairs(wider).count() == 1


def test_half_of_all_rows_on_one_key_is_split(spark):
    rows = [(i, "k", f"f{i}", "hot" if i % 2 else f"t{i}", "calls", None) for i in range(20_000)]
    edges = spark.createDataFrame(rows, EDGE).select("to_id", "edge_type", "from_id", "edge_id")
    sizes = [r["count"] for r in edges.repartitionByRange(8, "to_id", "edge_type", "from_id", "edge_id").selectExpr("spark_partition_id() p").groupBy("p").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8


def shred(spark, text):
    rows = nested.shred(spark.createDataFrame([(1, text)], "k long, t string"), "state", "k", "t", nested.STATE).where("child_path <> ''").collect()
    return {r.child_path: r for r in rows}


@pytest.mark.parametrize(
    ("text", "paths"),
    [
        ('{"edges": [{"from": "a"}, null, 3, {"from": "b"}]}', {"edges[0]", "edges[3]"}),
        ('{"edges": {"from": "a", "to": "b"}}', {"edges[0]"}),
        ('{"Edges": {"count": 1, "items": [{"from": "a"}]}}', {"edges[0]"}),
        ('{"edges": "[{\\"from\\": 1}]"}', {"edges[0]"}),
        ('{"symbolReferences": [{"raw": "{\\"candidateBindings\\": [{}, {}]}", "supports": [{}]}]}', {"symbol_references[0]", "symbol_references[0].raw.candidate_bindings[0]", "symbol_references[0].raw.candidate_bindings[1]", "symbol_references[0].support[0]"}),
        (json.dumps(json.dumps({"edges": [{}]})), {"edges[0]"}),
        ('{"edges": [{}]', set()),
        ('{"edges": [{}]} trailing', set()),
        ("[1]", set()),
        ("", set()),
        ("not available", set()),
        ('{"edges": null, "symbol_references": "n/a"}', set()),
    ],
)
def test_child_objects_of_states(spark, text, paths):
    assert set(shred(spark, text)) == paths


def test_parents_positions_and_fields(spark):
    found = shred(spark, '{"symbol_references": [null, {"status": "x", "raw": {"owner": {"kind": "file"}, "candidate_bindings": [{"local_name": "n", "type_only": true}]}}]}')
    child = found["symbol_references[1].raw.candidate_bindings[0]"]
    assert (child.parent_path, child.position, child.fields) == ("symbol_references[1]", 0, {"local_name": "n", "type_only": "true"})
    assert found["symbol_references[1]"].fields == {"status": "x", "raw.owner.kind": "file"}


def test_null_records_and_deliveries(spark):
    rows = [(1, None), (2, '{"edges": [{}]}'), (2, '{"edges": [{}]}')]
    states = spark.createDataFrame([(*r, "x") for r in rows], "state_id long, state_json string, record_kind string")
    refs = spark.createDataFrame([], "ref_id long, raw struct<candidate_bindings:array<struct<local_name:string>>>, support array<struct<kind:string>>")
    assert [tuple(r) for r in nested.child_objects(refs, states).collect()] == [("state", 2, "edges[0]")]


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["edges", "raw", "support", "symbol_references", "candidate_bindings", "from", "items", "a"]), x, max_size=4), max_leaves=25)


@given(st.dictionaries(st.sampled_from(["edges", "symbol_references", "x"]), JSON, max_size=3))
@settings(max_examples=150, deadline=None)
def test_every_row_has_its_parent(record):
    root = nested.rooted(nested.STATE)
    rows = nested.shredded(nested.triples(json.dumps(record), root), root)
    paths = {p for _, p, *_ in rows}
    assert len(paths) == len(rows)
    assert all(parent is None or parent in paths for _, _, parent, *_ in rows)


def rows_of(text, shape=nested.STATE, **how):
    root = nested.rooted(shape)
    found = nested.triples(text, root)
    return None if found is None else {r[1]: r for r in nested.shredded(found, root, **how)}


def test_lists_that_nobody_declared_are_tables_too():
    rows = rows_of('{"nodes": [{"id": "n", "tags": [{"t": 1}, "x"]}], "edges": [], "deep": [[{"a": 2}], 3]}')
    assert rows["nodes[0]"] == ("nodes", "nodes[0]", "", 0, {"id": "n"})
    assert rows["nodes[0].tags[0]"] == ("tags", "nodes[0].tags[0]", "nodes[0]", 0, {"t": "1"})
    assert rows["nodes[0].tags[1]"][4] == {"value": "x"} and rows["deep[0][0]"][4] == {"a": "2"} and rows["deep[1]"][4] == {"value": "3"}
    assert set(rows_of('{"nodes": [{"support": [{}]}], "edges": [{"support": [{}]}]}', declared=True)) == {"", "edges[0]"}


@pytest.mark.parametrize("levels", [1, 9, 14])
def test_lists_encoded_any_number_of_times(levels):
    text = json.dumps([{"from": "a"}])
    for _ in range(levels):
        text = json.dumps(text)
    assert set(rows_of('{"edges": %s}' % text)) == {"", "edges[0]"}
    wrapped = [{"from": "a"}]
    for _ in range(levels):
        wrapped = {"items": wrapped}
    assert set(rows_of(json.dumps({"edges": wrapped}))) == {"", "edges[0]"}


def test_odd_shapes_of_lists():
    assert set(rows_of('{"edges": {"10": {"from": "b"}, "2": {"from": "a"}, "11": 3}}')) == {"", "edges[0]", "edges[1]"}
    assert rows_of('{"edges": {"10": {"from": "b"}, "2": {"from": "a"}}}')["edges[0]"][4] == {"from": "a"}
    assert rows_of('{"Edges": [{"from": 1}], "edges": [{"from": 2}, {"from": 3}]}')["edges[0]"][4] == {"from": "2"}
    assert set(rows_of('{"edges": {"items": {"from": 1}}}')) == {"", "edges[0]"}
    assert rows_of('{"edges": [{"a": 1}, {"a": "\\u00e9\\n"}]}')["edges[1]"][4] == {"a": "é\n"}
    deep = '{"x": ' + '{"y": ' * 50_000 + "1" + "}" * 50_001
    assert len(rows_of(deep)) == 1


@given(st.text(alphabet='{}[]",:\\ 1eE.-tru\n', max_size=30) | JSON.map(json.dumps))
@settings(max_examples=400, deadline=None)
def test_whole_documents_are_those_that_a_json_reader_takes(text):
    try:
        whole = isinstance(json.loads(text), dict)
    except ValueError:
        whole = False
    if text.lstrip()[:1] != '"':
        assert (rows_of(text) is not None) == whole
