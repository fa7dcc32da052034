"""All queries of the engine with their SQL oracles."""

from . import frame_queries, page_queries, scenarios, state_queries

_PARTS = (frame_queries, page_queries, state_queries)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL = {k: v for p in _PARTS for k, v in p.ORACLE_SQL.items()}

# The scenarios stand on scenes of their own, so each must pass at every scale.
QUERIES["quality_scenarios"] = lambda spark, sf_dir: scenarios.report(spark).select("name", "passed")
ORACLE_SQL["quality_scenarios"] = "SELECT * FROM (VALUES " + ", ".join(f"('{n}', true)" for n in scenarios.SCENARIOS) + ") AS t(name, passed)"
