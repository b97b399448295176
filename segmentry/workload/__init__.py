"""Registered queries over the given tables, each with the SQL it must agree with."""

from segmentry.workload import catalog, collection, evidence, models, reviews, scoring, text

_PARTS = (catalog, scoring, text, reviews, evidence, models, collection)


def queries():
    """Name -> (spark, folder) -> DataFrame."""
    return {name: run for part in _PARTS for name, run in part.QUERIES.items()}


def oracle_sql():
    """Name -> equivalent SQL over the same tables."""
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
