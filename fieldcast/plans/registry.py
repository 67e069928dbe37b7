"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from fieldcast.plans import archive_queries, dynamics_queries, model_queries, scoring_queries, stream_queries, weather_queries

_PARTS = (archive_queries, weather_queries, scoring_queries, model_queries, dynamics_queries, stream_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: s for part in _PARTS for name, s in part.SQL.items()}
