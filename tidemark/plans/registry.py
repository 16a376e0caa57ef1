"""All registered queries of the engine's own operators, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import flow_queries, inventory_queries, market_queries, position_queries, relational  # noqa: F401  the others register themselves beside the market's

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {**relational.QUERIES, **market_queries.QUERIES, **flow_queries.QUERIES}
_ORACLES: dict[str, str] = {**relational.ORACLES, **market_queries.ORACLES, **flow_queries.ORACLES}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barrier states conditional on regime and hypothesis, estimated from raw events."""
    return _QUERIES["c01_conditional_cpt"](spark, sf_dir)
