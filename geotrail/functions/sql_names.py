"""SQL names for the scalar functions, inlined by the optimizer."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (parameters, body) of temporary SQL functions.
DEFINITIONS = {
    "haversine_m": (
        "lon0 DOUBLE, lat0 DOUBLE, lon1 DOUBLE, lat1 DOUBLE",
        "2 * 6371000.0D * asin(least(1.0D, sqrt(power(sin(radians(lat1 - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat1)) * power(sin(radians(lon1 - lon0) / 2), 2))))",
    ),
    "mercator_x": ("lon DOUBLE", "(lon + 180.0D) / 360.0D * 1048576.0D"),
    "mercator_y": ("lat DOUBLE", "(ln(tan(radians(lat) / 2 + pi() / 4)) / (2 * pi()) + 0.5D) * 1048576.0D"),
    "mercator_lon": ("x DOUBLE", "x / 1048576.0D * 360.0D - 180.0D"),
    "mercator_lat": ("y DOUBLE", "degrees(2 * atan(exp((y / 1048576.0D - 0.5D) * 2 * pi())) - pi() / 2)"),
    "relation_x": ("x DOUBLE", "x - 219 * 4096.0D"),
    "relation_y": ("y DOUBLE", "y - 155 * 4096.0D"),
    "tile_column": ("lon DOUBLE, level INT", "CAST(floor((lon + 180.0D) / 360.0D * power(2.0D, level)) AS BIGINT)"),
    "tile_row": ("lat DOUBLE, level INT", "CAST(floor((ln(tan(radians(lat) / 2 + pi() / 4)) / (2 * pi()) + 0.5D) * power(2.0D, level)) AS BIGINT)"),
    "enclosing_level": (
        "x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT",
        "20 - greatest(CASE WHEN (x0 ^ x1) = 0 THEN 0 ELSE length(bin(x0 ^ x1)) END, CASE WHEN (y0 ^ y1) = 0 THEN 0 ELSE length(bin(y0 ^ y1)) END)",
    ),
    "enclosing_tile": (
        "x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE",
        "transform(array(named_struct('x0', CAST(floor(x0) AS BIGINT), 'y0', CAST(floor(y0) AS BIGINT), 'x1', CAST(floor(x1) AS BIGINT), 'y1', CAST(floor(y1) AS BIGINT))), r ->"
        " CASE WHEN least(r.x0, r.y0, r.x1, r.y1) < 0 OR greatest(r.x0, r.y0, r.x1, r.y1) >= 1048576 THEN named_struct('level', -1, 'x', -1L, 'y', -1L) ELSE"
        " transform(array(greatest(length(ltrim('0', bin(r.x0 ^ r.x1))), length(ltrim('0', bin(r.y0 ^ r.y1))))), up ->"
        " named_struct('level', 20 - up, 'x', shiftright(r.x0, up), 'y', shiftright(r.y1, up)))[0] END)[0]",
    ),
    "tile_unkey": ("key BIGINT", "named_struct('level', CAST(shiftright(key, 48) AS INT), 'x', key & 16777215L, 'y', shiftright(key, 24) & 16777215L)"),
    "tile_rect": (
        "level INT, x BIGINT, y BIGINT",
        "named_struct('left', x * power(2.0D, 20 - level), 'bottom', y * power(2.0D, 20 - level), 'right', (x + 1) * power(2.0D, 20 - level), 'top', (y + 1) * power(2.0D, 20 - level))",
    ),
    "tile_left": ("level INT, x BIGINT", "x * power(2.0D, 20 - level)"),
    "tile_key": ("level INT, x BIGINT, y BIGINT", "shiftleft(CAST(level AS BIGINT), 48) + shiftleft(y, 24) + x"),
    "flip_y": ("level INT, y BIGINT", "CAST(power(2.0D, level) AS BIGINT) - y - 1"),
}


_TILE = "STRUCT<level: INT, x: BIGINT, y: BIGINT>"
#: Types of results that aren't doubles.
RETURNS = {
    "enclosing_level": "INT", "tile_column": "BIGINT", "tile_row": "BIGINT", "tile_key": "BIGINT", "flip_y": "BIGINT",
    "enclosing_tile": _TILE, "tile_unkey": _TILE, "tile_rect": "STRUCT<left: DOUBLE, bottom: DOUBLE, right: DOUBLE, top: DOUBLE>",
}


def register_sql(spark: SparkSession) -> list[str]:
    """Makes the functions known to ``spark.sql`` of this session; returns their names."""
    for name, (parameters, body) in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {RETURNS.get(name, 'DOUBLE')} RETURN {body}")
    return list(DEFINITIONS)
