"""Every query with SQL gives the same rows as the SQL does."""

import math
import os

import duckdb
import pytest

from strataloom.plans import catalog


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value) or str(value) in ("NaT", "<NA>"):
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}"
    if hasattr(value, "__index__") and not isinstance(value, bool):
        return str(int(value))
    return str(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, small, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, small).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    ours, theirs = rows_of(ours), rows_of(theirs)
    if name in ("search_scores", "search_top", "search_of_kind", "usage_summary"):
        ours, theirs = [tuple(x.removesuffix(".0") for x in r) for r in ours], [tuple(x.removesuffix(".0") for x in r) for r in theirs]
    assert ours == theirs


#: What each row of the queries without SQL has to be, in SQL over their results.
SOUND = {
    "p2_found": "record_kind IN ('reference', 'state') AND record_id IS NOT NULL AND child_path RLIKE '[]]$'",
    "p2_support": "child_path LIKE concat('%support[', position, ']')",
    "p2_bindings": "child_path LIKE concat('%candidate_bindings[', position, ']')",
    "p2_edges": "child_path = concat('edges[', position, ']') AND parent_path = ''",
    "p2_records": "record_id IS NOT NULL",
    "markdown_sections": "file_path LIKE '%.m%'",
    "python_symbols": "byte_length > 0",
    "python_calls": "problem IS NOT NULL OR end_byte > start_byte",
    "python_imports_resolved": "(status = 'resolved') = (target IS NOT NULL)",
    "script_imports_resolved": "(status = 'resolved') = (target IS NOT NULL)",
    "go_imports_resolved": "status <> 'resolved' OR target IS NOT NULL",
    "rust_imports_resolved": "(status = 'resolved') = (target IS NOT NULL)",
    "reexport_fixpoint": "(status = 'resolved') = (definition IS NOT NULL)",
    "paths_budgeted": "size(node_ids) = size(edge_keys) + 1 AND size(array_distinct(node_ids)) = size(node_ids)",
    "symbols_extracted": "byte_length > 0 AND id LIKE '%::%#%' AND length(content_hash) = 64",
    "imports_resolved": "(status = 'resolved') = (target_file IS NOT NULL) AND (status = 'resolved') = (reason IS NULL)",
    "export_surfaces": "(status = 'resolved') = (def_file IS NOT NULL)",
    "references_resolved": "(status = 'resolved') = (target_id IS NOT NULL) AND (status = 'resolved') = (reason IS NULL)",
    "calls_resolved": "(status = 'resolved') = (target_id IS NOT NULL) AND (status = 'resolved') = (reason IS NULL)",
    "linked_edges": "from_id IS NOT NULL AND to_id IS NOT NULL AND line >= 1",
}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_rows_are_sound(spark, small, name):
    rows = catalog.QUERIES[name](spark, small).selectExpr(f"coalesce({SOUND[name]}, false) AS sound").groupBy("sound").count().collect()
    assert [r.sound for r in rows] == [True]


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert catalog.FLAGSHIP in e.queries()
