"""Queries of the general training-data problems."""

from __future__ import annotations

from strataloom.operators import heavy_keys, nested
from strataloom.runtime import table

_HASHED = {"file": "string", "line": "int", "content_hash": "string"}
SUPPORT = {"kind": "string", **_HASHED, "endpoint_id": "string"}
BINDING = {"local_name": "string", "imported_name": "string", "exported_name": "string", "kind": "string", "type_only": "boolean", "module_level": "boolean", "import_line": "int", "import_text": "string", "import_specifier": "string"}
EDGE = {"from": "string", "to": "string", "type": "string", "directed": "boolean", "namespace": "string", "resolution": "string", "evidence.file": "string", "evidence.line": "int", "evidence.content_hash": "string"}
RECORD = {"source_id": "string", "source_kind": "string", "target_id": "string", "target_kind": "string", "target_file": "string", "status": "string", "unresolved_reason": "string", "raw.source_file": "string", "raw.language": "string", "raw.line": "int", "raw.text": "string", "raw.owner.kind": "string"}


def _both(spark, d):
    return table(spark, d, "symbol_references"), table(spark, d, "graph_states")


def p2_found(spark, d):
    return nested.child_objects(*_both(spark, d))


def p2_support(spark, d):
    return nested.flat_table(*_both(spark, d), ("support",), SUPPORT)


def p2_bindings(spark, d):
    return nested.flat_table(*_both(spark, d), ("candidate_bindings",), BINDING)


def p2_edges(spark, d):
    return nested.flat_table(*_both(spark, d), ("edges",), EDGE)


def p2_records(spark, d):
    """Reference records, those of the table and those in states alike."""
    return nested.flat_table(*_both(spark, d), ("symbol_reference", "symbol_references"), RECORD)


def p2_reference_support(spark, d):
    """Support items of the table symbol_references alone."""
    return nested.flat_table(table(spark, d, "symbol_references"), None, ("support",), SUPPORT)


def p2_reference_bindings(spark, d):
    """Bindings of the table symbol_references alone."""
    return nested.flat_table(table(spark, d, "symbol_references"), None, ("candidate_bindings",), BINDING)


def p3_found(spark, d):
    return heavy_keys.heavy_pairs(table(spark, d, "edges")).select("to_id", "edge_type")


def p3_states(spark, d):
    return heavy_keys.key_states(table(spark, d, "edges"))


QUERIES = {"p2_found": p2_found, "p2_support": p2_support, "p2_bindings": p2_bindings, "p2_edges": p2_edges, "p2_records": p2_records, "p2_reference_support": p2_reference_support, "p2_reference_bindings": p2_reference_bindings, "p3_found": p3_found, "p3_states": p3_states}

_PAIRS = """SELECT to_id, edge_type, count(DISTINCT edge_id) AS n_edges, count(DISTINCT from_id) AS n_from,
  max(observed_at) AS last_observed FROM edges WHERE to_id IS NOT NULL AND to_id <> '' GROUP BY to_id, edge_type"""


def _children(values: str, path: str, columns: dict[str, str]) -> str:
    """The SQL of one child list of symbol_references."""
    members = ", ".join(f"TRY_CAST(x.{c} AS {t}) AS {c}" for c, t in columns.items())
    return f"""WITH once AS (SELECT ref_id, any_value({values}) AS items FROM symbol_references GROUP BY ref_id),
  placed AS (SELECT ref_id, unnest(items) AS x, generate_subscripts(items, 1) - 1 AS i FROM once WHERE items IS NOT NULL)
  SELECT 'reference' AS record_kind, ref_id AS record_id, '{path}[' || i || ']' AS child_path, '' AS parent_path, CAST(i AS INT) AS position, {members}
  FROM placed WHERE x IS NOT NULL"""


SQL = {
    "p2_reference_support": _children("support", "support", SUPPORT),
    "p2_reference_bindings": _children("raw.candidate_bindings", "raw.candidate_bindings", BINDING),
    "p3_states": _PAIRS,
    "p3_found": f"WITH p AS ({_PAIRS}) SELECT to_id, edge_type FROM p WHERE n_edges >= 0.01 * (SELECT sum(n_edges) FROM p)",
}
