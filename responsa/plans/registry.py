"""Queries by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from responsa.sources.adapter import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The rows of the operator inventory that a query answers.
ROWS: dict[str, str] = {}


def query(rows: str, sql: str | None = None, doubles: str = "", digits: int = 9, log: bool = True):
    """Registers the function under its name. sql: what the oracle selects, over the response log's tables if log. doubles: columns that both sides round, as sums come in any order."""
    names = doubles.split()

    def register(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            # + 0.0 turns -0.0 into 0.0
            return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in names}) if names else df

        QUERIES[f.__name__], ROWS[f.__name__] = run, rows
        if sql is not None:
            # sql that begins with a comma adds common tables of its own
            body = oracle(sql, more=sql.lstrip().startswith(",")) if log else sql
            ORACLES[f.__name__] = f"SELECT * REPLACE ({', '.join(f'round({c}::double, {digits}) + 0.0 AS {c}' for c in names)}) FROM ({body})" if names else body
        return f

    return register
