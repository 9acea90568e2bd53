"""SQL table functions with named arguments: what a user sets on the page is an argument of a query.

`register` makes them from views of the session; they are expanded where they are called, so arguments reach the scans
as filters, and a column of another table may be an argument (LATERAL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from wayfare.functions import constants as K

_TIERS = "ARRAY<STRUCT<up: DOUBLE, value: DOUBLE>>"
_METERED = "aggregate(tiers, struct(base AS total, 0D AS low), (s, t) -> struct(s.total + greatest(least(km, t.up) - s.low, 0D) * t.value AS total, t.up AS low), s -> s.total)"


def _band(value: str, view: str) -> str:
    arms = lambda bands: "CASE " + " ".join(f"WHEN {value} <= {b} THEN {i}" for i, b in enumerate(bands)) + " END"
    return f"CASE {view} WHEN 'cost' THEN {arms(K.COST_BANDS)} ELSE {arms(K.TIME_BANDS)} END"


_COLORS = "array(" + ", ".join(f"'{c}'" for c in K.COLORS) + ")"
_LABELS = {view: "array(" + ", ".join(f"'{b} {unit}'" for b in bands) + ")" for view, bands, unit in (("cost", K.COST_BANDS, "THB"), ("time", K.TIME_BANDS, "min"))}

FUNCTIONS = {
    # the fare of a mode, as functions.fares.fare says
    "mode_fare": f"""(km DOUBLE, formula STRING, base DOUBLE, tiers {_TIERS}) RETURNS DOUBLE RETURN CASE formula WHEN 'flat' THEN element_at(tiers, 1).value
        WHEN 'distance-based' THEN coalesce(try_element_at(filter(tiers, t -> km <= t.up), 1).value, element_at(tiers, -1).value)
        WHEN 'metered' THEN CAST(floor({_METERED} + 0.5D) AS DOUBLE) WHEN 'per-km' THEN CAST(floor({_METERED} + 0.5D) AS DOUBLE) ELSE base END""",
    # fare and rounded minutes of each mode of a type at a distance
    "mode_cards": """(distance_km DOUBLE DEFAULT 10, mode_type STRING DEFAULT 'all') RETURNS TABLE(pos INT, mode STRING, type STRING, color STRING, fare DOUBLE, minutes BIGINT)
        RETURN SELECT pos, mode, type, color, mode_fare(distance_km, formula, base, tiers), CAST(floor(distance_km / speed * 60 + 0.5D) AS BIGINT) FROM wayfare_modes WHERE mode_type = 'all' OR type = mode_type""",
    # what a mode (or the best of all) costs or takes in each cell up to the outermost band, and at the stops if asked for
    "isolines": f"""(mode_id STRING DEFAULT 'multimodal', view STRING DEFAULT 'cost', include_stops BOOLEAN DEFAULT false) RETURNS TABLE(kind STRING, id BIGINT, value DOUBLE, band INT, color STRING)
        RETURN SELECT kind, id, value, band, element_at({_COLORS}, band + 1) FROM (SELECT kind, id, value, {_band("value", "view")} AS band FROM (
            SELECT 'cell' AS kind, CAST(r * {K.GRID} + c AS BIGINT) AS id, CASE view WHEN 'cost' THEN cost ELSE round(time, 5) END AS value FROM wayfare_surfaces WHERE mode = mode_id
            UNION ALL SELECT 'cell', CAST(r * {K.GRID} + c AS BIGINT), CASE view WHEN 'cost' THEN min(cost) ELSE round(min(time), 5) END FROM wayfare_surfaces WHERE mode_id = 'multimodal' GROUP BY r, c
            UNION ALL SELECT 'stop', stop, CASE view WHEN 'time' THEN ride_min ELSE CASE mode_id WHEN 'multimodal' THEN 3 * ride_km ELSE mode_fare(ride_km, formula, base, tiers) END END
                FROM wayfare_stops LEFT JOIN wayfare_modes ON mode = mode_id WHERE include_stops)) WHERE band IS NOT NULL""",
    # swatches of a view's bands
    "legend": f"""(view STRING DEFAULT 'cost') RETURNS TABLE(band INT, color STRING, label STRING)
        RETURN SELECT pos, element_at({_COLORS}, pos + 1), label FROM (SELECT posexplode(CASE view WHEN 'cost' THEN {_LABELS['cost']} ELSE {_LABELS['time']} END) AS (pos, label))""",
    # repaired stations of one line, or of all
    "repaired_stations": """(line_id STRING DEFAULT 'all') RETURNS TABLE(line STRING, node BIGINT, lat DOUBLE, lng DOUBLE)
        RETURN SELECT line, node, lat, lng FROM wayfare_repaired WHERE line_id = 'all' OR line = line_id""",
}
#: The views that each function reads, with the other functions that it calls.
NEEDS = {"mode_fare": (), "mode_cards": ("modes",), "isolines": ("modes", "surfaces", "stops"), "legend": (), "repaired_stations": ("repaired",)}


def register(views: dict[str, DataFrame]) -> None:
    """Makes the functions whose views are given: modes (functions.fares.modes), surfaces (r, c, mode, cost, time), stops
    (stop, ride_km, ride_min), repaired (line, node, lat, lng). A name that exists in the session is made anew."""
    (spark,) = {df.sparkSession for df in views.values()}
    for name, df in views.items():
        df.createOrReplaceTempView(f"wayfare_{name}")
    for name, body in FUNCTIONS.items():
        if all(v in views for v in NEEDS[name]):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
