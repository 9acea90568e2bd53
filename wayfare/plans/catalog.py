"""Every query of the library by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfare.plans import chains, files, maps, networks, parameters, stations, surfaces

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = surfaces.multimodal_grid


def queries() -> dict[str, Query]:
    return surfaces.Q | networks.Q | chains.Q | stations.Q | maps.Q | files.Q | parameters.Q


def oracle_sql() -> dict[str, str]:
    return surfaces.SQL | networks.SQL | chains.SQL | stations.SQL | maps.SQL | files.SQL | parameters.SQL
