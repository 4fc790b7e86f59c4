"""Every registered query of the scoring engine, with its oracle SQL."""

from importlib import import_module

MODULES = ["score_queries", "operator_queries", "portfolio_queries", "check_queries", "indicator_queries", "linking_queries", "service", "more_queries", "filing_queries", "final_queries"]


def _parts():
    return [import_module(f"cinderflow.plans.{m}") for m in MODULES]


def queries():
    return {k: f for m in _parts() for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in _parts() for k, s in m.ORACLE.items()}
