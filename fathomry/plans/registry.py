"""All queries of the engine's own operators by name, and the SQL that states the same result."""

from . import model_queries, probe_queries, text_queries

QUERIES: dict = probe_queries.QUERIES | text_queries.QUERIES | model_queries.QUERIES
SQL: dict[str, str] = probe_queries.SQL | text_queries.SQL
