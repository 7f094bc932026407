"""Registry of demonstration queries: a Spark callable and its SQL twin per key."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inplay.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROLE_SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register fn(tables) under `key`; `sql` may name any role of ROLE_SQL as a table."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from inplay.plans.roles import Tables

            return fn(Tables(configure(spark), sf_dir))

        run.__name__, run.__doc__ = key, fn.__doc__
        assert key not in QUERIES, key
        QUERIES[key] = run
        if sql:
            ORACLES[key] = with_roles(sql)
        return fn

    return deco


def with_roles(sql: str) -> str:
    """Prefix the CTEs of every role that `sql` names, dependencies first."""
    order: list[str] = []

    def need(text: str):
        for name in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text):
            if name in ROLE_SQL and name not in order and name not in active:
                active.add(name)
                need(ROLE_SQL[name])
                active.discard(name)
                order.append(name)

    active: set[str] = set()
    body = sql.strip().rstrip(";")
    need(body)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({ROLE_SQL[n].strip()})" for n in order)
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {ctes},\n{re.sub(r'(?i)^with\s+recursive', '', body).lstrip()}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
