"""Queries of the training-data operators and their oracle SQL."""

from functools import wraps
from importlib import import_module

from cinderflow.storage import ship_package

MODULES = ["url_filters", "mixing", "token_ids", "quality_classifier", "quality_rules", "license_scans", "jaccard_join", "class_lm", "decontamination", "warc", "sequence_packing", "hard_negatives", "whitening"]


def _parts():
    return [import_module(f"cinderflow.llm.{m}") for m in MODULES]


def _shipped(f):
    @wraps(f)
    def run(spark, sf_dir):
        ship_package(spark)
        return f(spark, sf_dir)

    return run


def queries():
    return {k: _shipped(f) for m in _parts() for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in _parts() for k, s in m.ORACLE_SQL.items()}
