"""Registered queries over the given tables, each with its SQL check where SQL can say it."""

from gleanery.queries import accounting, pages, records, similarity

_GROUPS = (pages, records, accounting, similarity)


def all_queries():
    return {name: query for group in _GROUPS for name, query in group.QUERIES.items()}


def all_oracles():
    return {name: sql for group in _GROUPS for name, sql in group.ORACLES.items()}
