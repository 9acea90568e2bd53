"""Queries by SQL table functions over the given tables, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import constants as K
from wayfare.functions.fares import modes
from wayfare.functions.tables import register
from wayfare.plans import chains as C
from wayfare.plans import surfaces as S
from wayfare.plans.dialect import SQL_MODES, sql_fare
from wayfare.session import materialise, table

Q, SQL = {}, {}


def query(sql: str):
    def keep(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


_COLOR = "list_extract([" + ", ".join(f"'{c}'" for c in K.COLORS) + "], band + 1)"


def _band(value: str, bands: list[int]) -> str:
    return "CASE " + " ".join(f"WHEN {value} <= {b} THEN {i}" for i, b in enumerate(bands)) + " END"


@query(f"""SELECT km, mode, type, fare, CAST(floor(km / speed * 60 + 0.5e0) AS BIGINT) AS minutes, n FROM (SELECT m.*, km, n, {sql_fare('km')} AS fare
    FROM (SELECT (o_orderkey * 37 % 1200) / 10.0e0 AS km, count(*) AS n FROM orders GROUP BY 1), {SQL_MODES} m WHERE type = 'rail')""")
def mode_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fare and minutes of the rail modes at every distance that an order has, with how many orders have it."""
    km = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") * 37 % 1200 / F.lit(10.0)).alias("km")).agg(F.count("*").alias("n"))
    km.createOrReplaceTempView("wayfare_distances")
    register({"modes": modes(spark)})
    return spark.sql("SELECT km, mode, type, fare, minutes, n FROM wayfare_distances d, LATERAL mode_cards(mode_type => 'rail', distance_km => d.km)")


def _isolines(spark: SparkSession, sf_dir: str, call: str) -> DataFrame:
    register({"modes": modes(spark), "surfaces": S._surfaces(spark, sf_dir), "stops": S._stops(spark, sf_dir)})
    return spark.sql(f"SELECT kind, id, value, band, color FROM isolines({call})")


@query(f"""SELECT kind, id, value, band, {_COLOR} AS color FROM (SELECT kind, id, value, {_band('value', K.TIME_BANDS)} AS band FROM (
        SELECT 'cell' AS kind, CAST(r * 60 + c AS BIGINT) AS id, round(time, 5) AS value FROM {S._ALL} WHERE mode = 'bus_ac' UNION ALL SELECT 'stop', stop, ride_min FROM {S._STOPS})) WHERE band IS NOT NULL""")
def isolines_by_bus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and stops within the outermost time band by one mode."""
    return _isolines(spark, sf_dir, "mode_id => 'bus_ac', view => 'time', include_stops => true")


@query(f"""SELECT kind, id, value, band, {_COLOR} AS color FROM (SELECT kind, id, value, {_band('value', K.COST_BANDS)} AS band FROM (
        SELECT 'cell' AS kind, CAST(r * 60 + c AS BIGINT) AS id, cost AS value FROM {S._BEST} UNION ALL SELECT 'stop', stop, 3 * ride_km FROM {S._STOPS})) WHERE band IS NOT NULL""")
def isolines_by_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and stops within the outermost cost band by the best of all modes."""
    return _isolines(spark, sf_dir, "include_stops => true")


@query(f"SELECT * FROM ({C.SQL['line_repair']}) WHERE line = 'Brand#12'")
def repaired_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired stations of one line."""
    register({"repaired": materialise(C.line_repair(spark, sf_dir))})
    return spark.sql("SELECT * FROM repaired_stations(line_id => 'Brand#12')")
