"""The list of queries, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetlens.plans.bindings import CTES, Tables
from fleetlens.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_ctes(sql: str) -> str:
    """Puts the definitions of the bound tables a statement names before it."""
    used: list[str] = []

    def need(text: str) -> None:
        words = set("".join(ch if ch.isalnum() or ch == "_" else " " for ch in text).split())
        for name, body in CTES.items():
            if name in words and name not in used:
                need(body)
                if name not in used:
                    used.append(name)

    need(sql)
    if not used:
        return sql
    heads = ", ".join(f"{n} AS ({CTES[n]})" for n in used)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {heads}, {body[5:]}"
    return f"WITH {heads} {body}"


def query(name: str, sql: str | None = None):
    """Registers `fn(tables) -> DataFrame` under `name`."""
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(configure(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return register
