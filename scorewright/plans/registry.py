"""All queries of the library with the SQL that gives the same rows."""

from __future__ import annotations

from scorewright.plans import crafted, registries, relations, reliability, scores, services, statements, storage, texts

QUERIES = scores.QUERIES | reliability.QUERIES | texts.QUERIES | relations.QUERIES | registries.QUERIES | statements.QUERIES | storage.QUERIES | services.QUERIES | crafted.QUERIES
SQL = scores.SQL | reliability.SQL | texts.SQL | relations.SQL | registries.SQL | statements.SQL | storage.SQL | services.SQL | crafted.SQL
