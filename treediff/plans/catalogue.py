"""All queries of the file-tree engine by name, and their SQL."""

from __future__ import annotations

from treediff.plans import control, jobs, stores, trees


def queries() -> dict:
    return trees.QUERIES | jobs.QUERIES | control.QUERIES | stores.QUERIES


def oracle_sql() -> dict:
    return trees.SQL | jobs.SQL | control.SQL | stores.SQL
