"""Quadtree tiles (level, x, y) as column expressions: keys, families, rectangles, names, uv."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geotrail.functions.geo import ORIGIN, UNIT_LEVEL, UNITS, col, mercator_x, mercator_y

#: Layers whose servers and files count rows from the north; id, and extension of files.
LAYERS = {"image": (0, "jpg", True), "height": (1, "dem", True), "lerc": (2, "lerc", True), "poi": (3, "poi", False), "model": (4, "dat", False)}


def _struct(level, x, y) -> Column:
    return F.struct(col(level).cast("int").alias("level"), x.cast("long").alias("x"), y.cast("long").alias("y"))


def tile_at(x, y, level) -> Column:
    """The tile of a level that holds a point in units."""
    size = F.pow(F.lit(2.0), UNIT_LEVEL - col(level))
    return _struct(level, F.floor(col(x) / size), F.floor(col(y) / size))


def lonlat_tile(lon, lat, level) -> Column:
    return tile_at(mercator_x(lon), mercator_y(lat), level)


def _bits(c: Column) -> Column:
    return F.when(c == 0, 0).otherwise(F.length(F.bin(c)))


def _enclosing_level(left, top, right, bottom) -> Column:
    whole = [F.floor(col(c)).cast("long") for c in (left, top, right, bottom)]
    inside = F.lit(True)
    for c in whole:
        inside = inside & (c >= 0) & (c < int(UNITS))
    x, y = whole[0].bitwiseXOR(whole[2]), whole[1].bitwiseXOR(whole[3])
    return F.when(inside, UNIT_LEVEL - F.greatest(_bits(x), _bits(y)))


def enclosing_tile(left, top, right, bottom) -> Column:
    """The smallest tile that holds a rectangle in units; level, x and y are -1 when it is outside the map."""
    level = _enclosing_level(left, top, right, bottom)
    size = F.pow(F.lit(2.0), UNIT_LEVEL - level)
    or_none = lambda c: F.coalesce(c.cast("long"), F.lit(-1))
    return _struct(or_none(level), or_none(F.floor(col(left) / size)), or_none(F.floor(col(bottom) / size)))


def tile_location(left, top, right, bottom, level) -> Column:
    """x and y of the rectangle's tile at a level, or -1 when that level is too deep."""
    own = _enclosing_level(left, top, right, bottom)
    size = F.pow(F.lit(2.0), UNIT_LEVEL - col(level))
    fits = own.isNotNull() & (col(level) <= own)
    at = lambda c: F.when(fits, F.floor(col(c) / size).cast("long")).otherwise(-1)
    return F.struct(at(left).alias("x"), at(bottom).alias("y"))


def tile_rect(level, x, y, space: str = "global") -> Column:
    """struct<left, bottom, right, top> in units, global or relative to the origin tile."""
    size = F.pow(F.lit(2.0), UNIT_LEVEL - col(level))
    off = [0.0, 0.0] if space == "global" else [float(v << (UNIT_LEVEL - ORIGIN[0])) for v in ORIGIN[1:]]
    left, bottom = col(x) * size - off[0], col(y) * size - off[1]
    return F.struct(left.alias("left"), bottom.alias("bottom"), (left + size).alias("right"), (bottom + size).alias("top"))


def tile_key(level, x, y) -> Column:
    return F.shiftleft(col(level).cast("long"), 48) + F.shiftleft(col(y).cast("long"), 24) + col(x).cast("long")


def tile_unkey(key) -> Column:
    k, low = col(key), (1 << 24) - 1
    return _struct(F.shiftright(k, 48), k.bitwiseAND(low), F.shiftright(k, 24).bitwiseAND(low))


def parent_tile(level, x, y) -> Column:
    """The tile above; null above the root."""
    return F.when(col(level) > 0, _struct(col(level) - 1, F.shiftright(col(x), 1), F.shiftright(col(y), 1)))


def child_tiles(level, x, y) -> Column:
    """The four tiles below, in the order (0,0), (1,0), (0,1), (1,1)."""
    return F.array(*(_struct(col(level) + 1, col(x) * 2 + i, col(y) * 2 + j) for j in (0, 1) for i in (0, 1)))


def ancestor_tiles(level, x, y) -> Column:
    """The tile and all tiles above it, the nearest first."""
    at = lambda c, d: F.floor(col(c) / F.pow(F.lit(2.0), d))
    return F.transform(F.sequence(F.lit(0), col(level).cast("int")), lambda d: _struct(col(level) - d, at(x, d), at(y, d)))


def flip_y(level, y) -> Column:
    return F.pow(F.lit(2.0), col(level)).cast("long") - col(y) - 1


def tile_path(layer: str, level, x, y) -> Column:
    """level/row/row_column.ext, rows counted from the north where the layer does so."""
    _, ext, flipped = LAYERS[layer]
    row = flip_y(level, y) if flipped else col(y)
    return F.format_string(f"%d/%04d/%04d_%04d.{ext}", col(level), row.cast("long"), row.cast("long"), col(x))


def tile_url(template: str, level, x, y) -> Column:
    """A request's address: ``template`` has %d for level, row from the north, and column, in this order."""
    return F.format_string(template, col(level), flip_y(level, y), col(x))


def request_key(layer, idx, data_file, level, x, y) -> Column:
    """Identity of a tile request: hash of its file name (0 without one), layer and index, tile key."""
    name = F.when(F.coalesce(F.length(col(data_file)), F.lit(0)) > 0, F.xxhash64(col(data_file))).otherwise(0)
    return F.struct(name.cast("long").alias("name"), (col(layer) * 100 + col(idx)).cast("long").alias("kind"), tile_key(level, x, y).alias("tile"))


def qgid_pack(level, x, y, idx) -> Column:
    """A graph vertex's id: index, 4 bits of level, 20 bits each of y and x."""
    long = lambda c: col(c).cast("long")
    return F.shiftleft(long(idx), 44).bitwiseOR(F.shiftleft(long(level), 40)).bitwiseOR(F.shiftleft(long(y), 20)).bitwiseOR(long(x))


def qgid_unpack(qgid) -> Column:
    q, low = col(qgid), (1 << 20) - 1
    part = lambda n, mask: F.shiftright(q, n).bitwiseAND(mask)
    return F.struct(part(40, 15).cast("int").alias("level"), part(0, low).alias("x"), part(20, low).alias("y"), F.shiftrightunsigned(q, 44).alias("idx"))


def same_cell(a, b) -> Column:
    return col(a).bitwiseXOR(col(b)).bitwiseAND((1 << 44) - 1) == 0


def child_uv(parent_level, parent_x, parent_y, level, x, y) -> Column:
    """struct<u1, v1, u2, v2>: a tile's rectangle in an ancestor's texture, v from the north edge."""
    n = F.pow(F.lit(2.0), col(level) - col(parent_level))
    u, v = (col(x) - col(parent_x) * n) / n, (col(y) - col(parent_y) * n) / n
    return F.struct(u.alias("u1"), (1 - v - 1 / n).alias("v1"), (u + 1 / n).alias("u2"), (1 - v).alias("v2"))


def uv_in_ancestor(level, x, y, u, v, ancestor_level, ancestor_x, ancestor_y) -> Column:
    """struct<u, v>: a point of a tile as a point of its ancestor; v counts from the north edge."""
    n = F.pow(F.lit(2.0), col(level) - col(ancestor_level))
    south = (col(y) + 1 - col(v)) / n - col(ancestor_y)
    return F.struct(((col(x) + col(u)) / n - col(ancestor_x)).alias("u"), (1 - south).alias("v"))


def sample_dem(z, width, height, u, v, factor: float = 0.05) -> Column:
    """The height of the cell that holds (u, v), clamped to the map; null without data."""
    at = lambda c, n: F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(c))) * (col(n) - 1)), col(n) - 1).cast("int")
    return F.get(col(z), col(width) * at(v, height) + at(u, width)) * factor
