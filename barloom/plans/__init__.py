"""Registered queries of the panel library, by family, with their DuckDB twins."""

from importlib import import_module

FAMILIES = ["q_features", "q_panel", "q_data", "q_eval", "q_portfolio", "q_text"]


def collect() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in FAMILIES:
        family = import_module(f"{__name__}.{name}")
        queries |= family.QUERIES
        sql |= family.SQL
    return queries, sql
