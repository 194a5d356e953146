"""All registered queries with their oracle SQL."""

from __future__ import annotations

from importlib import import_module

_AREAS = ("text_queries", "filter_queries", "dedup_queries", "field_queries", "rule_queries", "report_queries",
          "source_queries")


def _entries() -> dict:
    out: dict = {}
    for area in _AREAS:
        try:
            module = import_module(f"noticemill.plans.{area}")
        except ModuleNotFoundError as exc:
            if exc.name != f"noticemill.plans.{area}":
                raise
            continue
        out.update(module.ENTRIES)
    return out


def queries() -> dict:
    return {name: fn for name, (fn, _sql) in _entries().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_fn, sql) in _entries().items() if sql}
