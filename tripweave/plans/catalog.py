"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from tripweave.sources.driver_tables import Tables, oracle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Registers f(tables) as a query; ``sql`` stands over the derived views."""

    def keep(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = oracle(sql, recursive)
        return f

    return keep
