"""Registry of named queries and their independent DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import with_fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

# Python-equivalent whitespace for RE2 (DuckDB) patterns.
DWS = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
DWORD = r"[^\s\x0b\x1c-\x1f\x{85}\pZ]+"


def oracle(fixtures: tuple[str, ...] | list[str], body: str) -> str:
    """Prefix ``body`` with the fixture CTEs it reads (merging a leading WITH or WITH RECURSIVE)."""
    pre = with_fixtures(*fixtures)
    body = body.strip()
    if not pre:
        return body
    if body[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE" + pre.rstrip()[4:] + ",\n" + body[14:].lstrip()
    if body[:4].upper() == "WITH":
        return pre.rstrip() + ",\n" + body[4:].lstrip()
    return pre + body


def register(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


MODULES = ["q_web", "q_pages", "q_domains", "q_repos", "q_files", "q_chat", "q_judge", "q_io", "q_stream", "q_udf"]


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib

    for m in MODULES:
        try:
            importlib.import_module(f"{__package__}.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{m}":
                raise
