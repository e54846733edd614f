"""Queries that apply the operators to the test tables, by name."""

from plaza.probes import extraction, measures, pages, relations, scalars, snapshots, verdicts  # noqa: F401
from plaza.probes.base import QUERIES, SQL
from plaza.probes.pages import entry  # noqa: F401


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
