"""All queries of the toolkit and their SQL."""

from __future__ import annotations

from . import crop_queries, flow_queries, link_queries, map_queries, sample_queries, table_queries

QUERIES = crop_queries.QUERIES | link_queries.QUERIES | map_queries.QUERIES | sample_queries.QUERIES | table_queries.QUERIES | flow_queries.QUERIES
ORACLES = crop_queries.ORACLES | link_queries.ORACLES | map_queries.ORACLES | sample_queries.ORACLES | table_queries.ORACLES | flow_queries.ORACLES
