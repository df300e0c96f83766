"""A module's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, rounds: dict[str, int] | None = None) -> Callable:
        """Registers a function (spark, sf_dir) under its name. Columns in rounds are rounded in both, as sums of doubles depend on their order."""

        def add(f: Callable) -> Callable:
            def run(spark, sf_dir):
                df = f(spark, sf_dir)
                return df.withColumns({c: F.round(c, n) for c, n in (rounds or {}).items()})

            self.queries[f.__name__] = run
            if sql:
                replaced = ", ".join(f"round({c}, {n}) AS {c}" for c, n in (rounds or {}).items())
                self.oracles[f.__name__] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if rounds else sql
            return f

        return add
