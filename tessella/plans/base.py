"""The register of queries, and SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query under its function's name, with the DuckDB SQL that gives the same rows."""

    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLE_SQL[query.__name__] = sql
        return query

    return add


def over(spark: SparkSession, sf_dir: str, sql: str, *names: str, spread: bool = False) -> DataFrame:
    """Rows of a statement that both engines read, on the given tables. ``spread``: deal the tables' rows to all cores first, for statements that
    make large texts of narrow rows, whose file alone would be a task or two."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name in names:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names}
    if spread:
        tables = {name: rows.repartition(4 * spark.sparkContext.defaultParallelism) for name, rows in tables.items()}
    return spark.sql(sql, **tables)
