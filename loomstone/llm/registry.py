"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: name of the query -> module; each has query(spark, sf_dir) and, where SQL can express it, SQL.
MODULES = {
    "op1_line_dedup": "line_dedup",
    "op2_quality_nbsvm": "quality_nbsvm",
    "op3_zip_warc": "zip_warc",
    "op4_language_ecoc": "language_ecoc",
    "op5_exact_fit_packing": "packing",
    "op6_window_dedup": "window_dedup",
    "op7_decontaminate": "decontaminate",
    "op8_repetition_rules": "repetition",
    "op9_secret_scan": "secrets_scan",
    "op10_near_dedup": "near_dedup",
}


def _run(module: str):
    def run(spark, sf_dir):
        from .common import shared_dir, ship

        shared_dir(spark)
        ship(spark)
        return import_module(f"{__package__}.{module}").query(spark, sf_dir)

    run.__name__ = module
    return run


def queries() -> dict:
    return {name: _run(module) for name, module in MODULES.items()}


def oracle_sql() -> dict:
    found = ((name, getattr(import_module(f"{__package__}.{module}"), "SQL", None)) for name, module in MODULES.items())
    return {name: sql for name, sql in found if sql}
