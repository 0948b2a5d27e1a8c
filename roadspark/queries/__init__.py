"""One query for each operator over the fixture network, and the DuckDB SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    from . import files, flow, more, network

    return network.QUERIES | flow.QUERIES | more.QUERIES | files.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import files, flow, more, network

    return network.SQL | flow.SQL | more.SQL | files.SQL
