"""Queries over the tables, with SQL that says the same."""

from tessera.plans import careers, features, inference, links, panels, records, relations, statistics
from tessera.plans.tables import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "careers", "features", "inference", "links", "panels", "records", "relations", "statistics"]
