"""All queries of the core, with the SQL of those that have one."""

from strataloom.plans import core_problems, extract_queries, graph_queries, index_queries, link_queries  # noqa: F401 (its queries register themselves)

QUERIES = {**core_problems.QUERIES, **index_queries.QUERIES, **extract_queries.QUERIES}
SQL = {**core_problems.SQL, **index_queries.SQL}
FLAGSHIP = "anchors_inferred"
