"""Where queries and their SQL are registered."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function of (spark, sf_dir) under its name; sql is None where SQL can't express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df, *names: str, digits: int = 6):
    return df.select(*(F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns))
