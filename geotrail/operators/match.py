"""Points against segments of tracks, in Mercator units.

Pairs of points and segments are never rows.  Space is cut into cells of a quadtree, as coarse as they may be for at most ``PAIRS``
pairs and ``ROWS`` rows each; a task gets a cell's points and segments and keeps the nearest.  A finest cell with more pairs, a car park or a
crossing, is dealt over tasks in blocks of points and of segments; a track with many rows there has blocks of its own, which
are never paired with each other.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotrail.functions.geo import EQUATOR_M, UNITS, mercator_lat
from geotrail.functions.plan import fixed
from geotrail.sources.scratch import written

#: Units of a finest cell; a segment is written to the cells that its band touches, column by column.
CELL = 12.0
#: Levels of cells above the finest, each 4 x 4 cells of the last; pairs and rows of a cell at most, points or segments of a dealt cell's block.
LEVELS, PAIRS, ROWS, BLOCK = 3, 1 << 26, 1 << 19, 1 << 13
#: Segments that the kernel boxes together; pairs that it may have in memory at a time; neighbouring points that it takes at a time, from strips of so many reaches.
_BOX, _AT_ONCE, _POINTS, _STRIP = 8, 1 << 20, 128, 4


def _grow(limit_m: float) -> Column:
    """Units of ``limit_m`` at the segment's end that is farther from the equator."""
    lat = F.greatest(F.abs(mercator_lat("y0")), F.abs(mercator_lat("y1")))
    return F.lit(limit_m * 1.001) / (2 * math.pi * EQUATOR_M / UNITS * F.cos(F.radians(F.least(lat + 0.1, F.lit(89.0)))))


def _celled(s: DataFrame) -> DataFrame:
    """Segments (x0, y0, x1, y1, grow) once for each cell (cx, cy) within ``grow`` units, column by column."""
    x0, y0, x1, y1, grow, cx = (F.col(c) for c in ("x0", "y0", "x1", "y1", "grow", "cx"))
    cell = lambda c: F.floor(c / CELL)
    dx = x1 - x0
    at = lambda x: F.when(dx == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - x0) / F.when(dx != 0, dx))))
    s = s.withColumn("cx", F.explode(F.sequence(cell(F.least(x0, x1) - grow), cell(F.greatest(x0, x1) + grow))))
    ya = F.when(dx == 0, y0).otherwise(y0 + at(cx * CELL - grow) * (y1 - y0))
    yb = F.when(dx == 0, y1).otherwise(y0 + at(cx * CELL + CELL + grow) * (y1 - y0))
    return s.withColumn("cy", F.explode(F.sequence(cell(F.least(ya, yb) - grow), cell(F.greatest(ya, yb) + grow))))


def compared(points: tuple, segments: tuple, group: np.ndarray, limit_m: float, apart: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Parts of (point, segment, distance, foot_x, foot_y): all pairs within the limit, a point's together, by segment.

    points: arrays x, y and metres a unit; segments: x0, y0, x1, y1, sorted by group.  ``apart`` tells which pairs of a point
    and a segment count.  A group's segments are boxed by ``_BOX``, and only those of boxes near enough are compared, some
    points at a time: neighbours, for which most boxes are ruled out at once.
    """
    px, py, unit = points
    x0, y0, x1, y1 = segments
    if not len(group) or not len(px):
        return
    reach = limit_m * (1 + 1e-9) / unit
    place = np.arange(len(group))
    begins = np.concatenate([[True], group[1:] != group[:-1]])
    opens = np.flatnonzero(begins | ((place - np.maximum.accumulate(np.where(begins, place, 0))) % _BOX == 0))
    size = np.diff(opens, append=len(group))
    low_x, low_y = (np.minimum.reduceat(np.minimum(a, b), opens) for a, b in ((x0, x1), (y0, y1)))
    high_x, high_y = (np.maximum.reduceat(np.maximum(a, b), opens) for a, b in ((x0, x1), (y0, y1)))
    step = max(1, min(_POINTS, _AT_ONCE // len(group)))
    order = np.lexsort((px, np.floor(py / max(_STRIP * np.fmax.reduce(reach), 1e-9))))
    for at in range(0, len(px), step):
        some = order[at : at + step]
        x, y, r = (c[some, None] for c in (px, py, reach))
        (right, top, far), (left, foot) = (np.fmax.reduce(c)[0] for c in (x, y, r)), (np.fmin.reduce(c)[0] for c in (x, y))  # a place that isn't a number is near nothing
        close = np.flatnonzero((low_x <= right + far) & (high_x >= left - far) & (low_y <= top + far) & (high_y >= foot - far))
        p, box = np.nonzero((x >= low_x[close] - r) & (x <= high_x[close] + r) & (y >= low_y[close] - r) & (y <= high_y[close] + r))
        box = close[box]
        n = size[box]
        s = np.arange(n.sum()) + np.repeat(opens[box] - np.cumsum(n) + n, n)
        p = np.repeat(some[p], n)
        mine = apart(p, s)
        p, s = p[mine], s[mine]
        dx, dy = x1[s] - x0[s], y1[s] - y0[s]
        share = np.clip(((px[p] - x0[s]) * dx + (py[p] - y0[s]) * dy) / np.maximum(dx * dx + dy * dy, 1e-300), 0.0, 1.0)
        fx, fy = x0[s] + share * dx, y0[s] + share * dy
        away = np.sqrt((px[p] - fx) ** 2 + (py[p] - fy) ** 2) * unit[p]
        near = np.flatnonzero(away <= limit_m)
        if len(near):
            yield tuple(c[near] for c in (p, s, away, fx, fy))


def _joined(parts: Iterator[tuple[np.ndarray, ...]], kinds: tuple) -> tuple[np.ndarray, ...]:
    columns = list(zip(*parts, strict=True))
    return tuple(np.concatenate(c) for c in columns) if columns else tuple(np.zeros(0, k) for k in kinds)


def nearest(pairs: Iterator[tuple[np.ndarray, ...]], group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of parts of ``compared`` the nearest of each point and group; of equally near ones (to a micrometre) the first."""

    def best(part: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        p, s, away, *_ = part
        rounded, g = np.round(away, 6), group[s]
        runs = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (g[1:] != g[:-1])]))
        least = np.flatnonzero(rounded == np.repeat(np.minimum.reduceat(rounded, runs), np.diff(runs, append=len(p))))
        first = least[np.searchsorted(least, runs)]
        return tuple(c[first] for c in part)

    return _joined(map(best, pairs), (np.int64, np.int64, float, float, float))


def ranges(pairs: Iterator[tuple[np.ndarray, ...]], group: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
    """(point, first segment, last segment) of parts of ``compared``: a point's segments of a group whose numbers follow one another."""

    def run(part: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        p, s, *_ = part
        begins = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (group[s[1:]] != group[s[:-1]]) | (number[s[1:]] != number[s[:-1]] + 1)]))
        ends = np.append(begins[1:], len(p)) - 1
        return p[begins], s[begins], s[ends]

    return _joined(map(run, pairs), (np.int64,) * 3)


def _leaves(p: DataFrame, s: DataFrame) -> DataFrame:
    """(cx, cy, level): for each finest cell with points and segments the coarsest cell above that has few enough pairs; level -1 for none.

    Points and segments are counted by finest cell before they are shuffled; a coarsest cell has at most 4 ** (2 * LEVELS)
    of these, so its counts are summed up level by level in one task.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = p.select("cx", "cy", one.alias("p"), none.alias("s")).union(s.select("cx", "cy", none, one))
    fine = both.groupBy("cx", "cy").agg(F.sum("p").alias("p"), F.sum("s").alias("s")).filter("p > 0 and s > 0")
    up = lambda k: [F.shiftright(c, 2 * k) for c in ("cx", "cy")]
    total = lambda c, k: F.sum(F.col(c).cast("double")).over(Window.partitionBy(*up(LEVELS), *up(k)))
    fits = lambda k: (total("p", k) * total("s", k) <= PAIRS) & (total("p", k) + total("s", k) <= ROWS)
    return fine.select("cx", "cy", F.greatest(*(F.when(fits(k), k).otherwise(-1) for k in range(LEVELS + 1))).alias("level"))


def _blocks(rows: DataFrame, owner: str) -> tuple[DataFrame, DataFrame]:
    """Rows of dealt cells with their block (track, part), and the blocks (cx, cy, track, part): a track with many rows in a cell has blocks of its own."""
    each = rows.groupBy("cx", "cy", owner).agg(F.count("*").alias("n"))
    many = F.col("n") > BLOCK
    each = each.withColumn("rest", F.sum(F.when(~many, F.col("n"))).over(Window.partitionBy("cx", "cy")))
    each = each.select("cx", "cy", owner, many.alias("many"), F.ceil(F.when(many, F.col("n")).otherwise(F.col("rest")) / BLOCK).cast("int").alias("parts"))
    track = F.when(F.col("many"), F.xxhash64(owner))
    part = F.pmod(F.when(F.col("many"), F.xxhash64(owner, "line")).otherwise(F.xxhash64(owner)), F.col("parts")).cast("int")
    dealt = rows.join(each, ["cx", "cy", owner]).withColumn("track", F.coalesce(track, F.lit(0).cast("long"))).withColumn("part", part).drop("many", "parts")
    kinds = each.select("cx", "cy", F.coalesce(track, F.lit(0).cast("long")).alias("track"), "parts").distinct()
    return dealt, kinds.select("cx", "cy", "track", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


#: Columns of the nearest segments and of ranges of segments; a track's name may be of any type.
NEAR = "file {file}, line long, x double, y double, seg_file {seg_file}, seg_line long, distance double, foot_x double, foot_y double"
COVER = "file {file}, line long, seg_file {seg_file}, first long, last long"
#: What is kept of the pairs: the nearest segment of each other track; one segment, neither end of which is ``own``; all of earlier tracks, as ranges.
TRACKS, EDGE, EARLIER = "tracks", "edge", "earlier"


def _codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the values of two arrays, in the order of the values."""
    told = pa.concat_arrays([a, b]).dictionary_encode()
    rank = np.empty(len(told.dictionary), np.int64)
    rank[pc.array_sort_indices(told.dictionary).to_numpy()] = np.arange(len(rank))
    code = np.append(rank, -1)[told.indices.fill_null(-1).to_numpy()]
    return code[: len(a)], code[len(a) :]


def _near(points: DataFrame, segments: DataFrame, limit_m: float, keep: str) -> DataFrame:
    """``NEAR``, or for EARLIER ``COVER``, of points (file, line, x, y, own) and segments (file, line, x0, y0, x1, y1); lines are numbers."""
    types = {"file": dict(points.dtypes)["file"], "seg_file": dict(segments.dtypes)["file"]}
    schema = (COVER if keep == EARLIER else NEAR).format(**types)
    s = segments.select(F.col("file").alias("seg_file"), F.col("line").cast("long").alias("line"), "x0", "y0", "x1", "y1")
    s = _celled(written(fixed(s, grow=_grow(limit_m)))).drop("grow")  # both sides are read twice, and may be long in the making
    p = points.select("file", F.col("line").cast("long").alias("line"), "x", "y", F.col("own").cast("long").alias("own"))
    p = written(p).withColumn("cx", F.floor(F.col("x") / CELL)).withColumn("cy", F.floor(F.col("y") / CELL))
    leaves = written(_leaves(p, s))
    key = ["level", "cx", "cy", "a", "b"]
    zero = F.lit(0).cast("long")

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        names, seg_names = (t[c].combine_chunks() for t, c in ((left, "file"), (right, "seg_file")))
        line, x, y, own = (left[c].fill_null(0).to_numpy() for c in ("line", "x", "y", "own"))
        has_own = left["own"].is_valid().to_numpy()
        file, sf = (names, seg_names) if keep == EDGE else _codes(names, seg_names)
        sl, *ends = (right[c].to_numpy() for c in ("line", "x0", "y0", "x1", "y1"))
        sf = sf.to_numpy() if keep == EDGE else sf
        order = np.lexsort((sl, sf))
        order = order[np.concatenate([[True], (np.diff(sf[order]) != 0) | (np.diff(sl[order]) != 0)])] if len(order) else order  # a segment comes once for each finest cell
        sf, sl, *ends = (c[order] for c in (sf, sl, *ends))
        seg_names = seg_names.take(pa.array(order))
        unit = 2 * math.pi * EQUATOR_M / UNITS * np.cos(2 * np.arctan(np.exp((y / UNITS - 0.5) * (2 * math.pi))) - math.pi / 2)
        alone = np.zeros(len(sf), np.int64)
        group, apart = {
            TRACKS: (sf, lambda p, s: file[p] != sf[s]),
            EDGE: (alone, lambda p, s: ~has_own[p] | ((own[p] != sf[s]) & (own[p] != sl[s]))),
            EARLIER: (sf, lambda p, s: sf[s] < file[p]),
        }[keep]
        pairs = compared((x, y, unit), tuple(ends), group, limit_m, apart)
        if keep == EARLIER:
            i, a, b = ranges(pairs, sf, sl)
            return pa.table({"file": names.take(pa.array(i)), "line": line[i], "seg_file": seg_names.take(pa.array(a)), "first": sl[a], "last": sl[b]})
        i, k, away, fx, fy = nearest(pairs, group)
        return pa.table({"file": names.take(pa.array(i)), "line": line[i], "x": x[i], "y": y[i], "seg_file": seg_names.take(pa.array(k)), "seg_line": sl[k], "distance": away, "foot_x": fx, "foot_y": fy})

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        own = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns)).groupBy(*key)  # noqa: E731  both sides read the same table
        return own(left).cogroup(own(right)).applyInArrow(kernel, schema)

    def placed(rows: DataFrame) -> DataFrame:
        up = lambda c: F.expr(f"shiftright({c}, 2 * level)")
        return rows.join(leaves.filter("level >= 0"), ["cx", "cy"]).withColumn("cx", up("cx")).withColumn("cy", up("cy")).withColumn("a", zero).withColumn("b", zero)

    found = met(placed(p), placed(s))
    hot = leaves.filter("level < 0")
    if hot.isEmpty():
        return found
    left, lefts = _blocks(p.join(hot, ["cx", "cy"]), "file")
    right, rights = _blocks(s.join(hot, ["cx", "cy"]), "seg_file")
    name = lambda df, n: df.withColumn(n, F.xxhash64("track", "part")).drop("part").withColumnRenamed("track", f"track_{n}")
    pairs = name(lefts, "a").join(name(rights, "b"), ["cx", "cy"])
    if keep != EDGE:
        pairs = pairs.filter("track_a = 0 or track_a <> track_b")
    pairs = pairs.select("cx", "cy", "a", "b")
    dealt = met(name(left, "a").join(pairs, ["cx", "cy", "a"]), name(right, "b").join(pairs, ["cx", "cy", "b"]))
    if keep == EARLIER:
        return found.unionByName(dealt)
    least = F.min_by(F.struct("x", "y", "seg_file", "seg_line", "distance", "foot_x", "foot_y"), F.struct(F.round("distance", 6), "seg_file", "seg_line"))
    best = dealt.groupBy("file", "line", *(["seg_file"] if keep == TRACKS else [])).agg(least.alias("n"))
    return found.unionByName(best.select("file", "line", "n.*"))


def nearest_segments(points: DataFrame, segments: DataFrame, limit_m: float = 30.0) -> DataFrame:
    """For each point and each other track its nearest segment within the limit; of equally near ones (to a micrometre) the first.

    (file, line, x, y, seg_file, seg_line, distance, foot_x, foot_y) of points (file, line, x, y) and segments (file, line, x0, y0, x1, y1).
    """
    return _near(points.withColumn("own", F.lit(None).cast("long")), segments, limit_m, TRACKS)


def near_edge(points: DataFrame, edges: DataFrame, distance_m: float) -> DataFrame:
    """The nearest edge (src, dst, x0, y0, x1, y1) of each point (file, line, x, y, except_id) that doesn't touch ``except_id``."""
    ends = edges.select(F.col("src").alias("file"), F.col("dst").alias("line"), "x0", "y0", "x1", "y1")
    near = _near(points.select("file", "line", "x", "y", F.col("except_id").alias("own")), ends, distance_m, EDGE)
    return near.select("file", "line", F.col("seg_file").alias("src"), F.col("seg_line").alias("dst"), "distance")


def consensus_points(points: DataFrame, near: DataFrame) -> DataFrame:
    """Each point averaged with its feet on near tracks (rows of ``nearest_segments``); ``n`` is their number, ``covered`` whether one is of an earlier track."""
    feet = near.groupBy("file", "line").agg(F.sum("foot_x").alias("sx"), F.sum("foot_y").alias("sy"), F.count("*").alias("n"), F.bool_or(F.col("seg_file") < F.col("file")).alias("covered"))
    told = points.select("file", "line", "x", "y").join(feet, ["file", "line"], "left")
    n = F.coalesce("n", F.lit(0))
    mean = lambda c, s: (F.col(c) + F.coalesce(s, F.lit(0.0))) / (n + 1)
    return told.select("file", "line", mean("x", "sx").alias("x"), mean("y", "sy").alias("y"), n.cast("long").alias("n"), F.coalesce("covered", F.lit(False)).alias("covered"))


def integrate_paths(points: DataFrame, segments: DataFrame, limit_m: float = 30.0) -> DataFrame:
    """Points that no earlier track (lesser file) covers within the limit, at their consensus place; unbroken runs are new tracks.

    (file, line, run, x, y): runs are numbered from 1 within a file.
    """
    w = Window.partitionBy("file").orderBy("line")
    told = consensus_points(points, nearest_segments(points, segments, limit_m)).withColumn("free", ~F.col("covered"))
    begins = (F.col("free") & ~F.coalesce(F.lag("free").over(w), F.lit(False))).cast("int")
    told = told.withColumn("begins", begins).withColumn("run", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return told.filter("free").select("file", "line", "run", "x", "y")


def integrate_in_order(points: DataFrame, segments: DataFrame, limit_m: float = 30.0) -> DataFrame:
    """``integrate_paths`` by the tracks integrated so far, one after the other (lesser file first): exact, in rounds.

    A point is dropped if a segment of an earlier track is near whose ends are both kept.  A round decides the points
    whose answer no longer depends on open ones: dropped, when such a segment is kept; kept, when all are gone.
    So tracks that aren't near each other are decided at once, and there are at most as many rounds as tracks.  A
    point's near segments are ranges of its neighbours' tracks, asked by running counts.  After the first round only open points, those
    beside a point that the last round found open, and ranges with open segments are read and written again: a segment that is
    kept drops all points near it in the round after its last end was decided, and one that is gone doesn't matter any more.
    """
    w = Window.partitionBy("file").orderBy("line")
    numbered = points.select("file", F.col("line").cast("long").alias("line"), "x", "y").withColumn("k", F.row_number().over(w).cast("long"))
    ordered = segments.withColumn("line", F.row_number().over(w).cast("long"))  # a segment has the number of its first point
    cover = written(_near(numbered.withColumn("own", F.lit(None).cast("long")).withColumn("line", F.col("k")), ordered, limit_m, EARLIER).withColumnRenamed("line", "k"))
    begun = cover.select("file", "k").distinct().withColumn("open", F.lit(True))
    state = written(numbered.select("file", "k").join(begun, ["file", "k"], "left").select("file", "k", F.when(F.col("open"), F.lit(None)).otherwise(F.lit(True)).cast("boolean").alias("kept")))
    by, key = Window.partitionBy("file").orderBy("k"), ["file", "k", "seg_file", "first", "last"]
    running = Window.partitionBy("seg_file").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_now, settled = F.col("kept").isNull(), [state.filter("kept is not null")]
    act, asked = state, cover
    while not act.filter(open_now).isEmpty():
        follows = F.coalesce(F.lead("k").over(by) == F.col("k") + 1, F.lit(False))
        after = F.when(follows, F.lead("kept").over(by))
        gone = F.coalesce(~follows | (F.col("kept") == F.lit(False)) | (after == F.lit(False)), F.lit(False))
        steps = act.select(F.col("file").alias("seg_file"), F.col("k").alias("at"), F.lit(1).alias("turn"), F.coalesce(F.col("kept") & after, F.lit(False)).cast("long").alias("whole"), (~gone).cast("long").alias("left"))
        end = lambda at, turn: asked.select("seg_file", F.col(at).alias("at"), F.lit(turn).alias("turn"), "file", "k", "first", "last")  # noqa: B023, E731
        marked = steps.unionByName(end("first", 0), allowMissingColumns=True).unionByName(end("last", 2), allowMissingColumns=True)
        marked = marked.select(*key, "turn", *(F.sum(F.coalesce(c, F.lit(0))).over(running).alias(c) for c in ("whole", "left"))).filter("turn <> 1")
        told = written(marked.groupBy(*key).agg(*((F.max(c) > F.min(c)).alias(c) for c in ("whole", "left"))))
        decided = told.groupBy("file", "k").agg(F.max("whole").alias("drop"), F.max("left").alias("wait"))
        verdict = F.when(F.col("drop"), False).when(~F.col("wait"), True)
        now = act.join(decided, ["file", "k"], "left").select("file", "k", F.coalesce("kept", verdict).alias("kept"), open_now.alias("was"))
        beside = [F.coalesce((f("k").over(by) == F.col("k") + d) & f("was").over(by), F.lit(False)) for f, d in ((F.lag, -1), (F.lead, 1))]
        now = written(now.withColumn("beside", beside[0] | beside[1]).filter("was or beside"))
        settled.append(now.filter("was and kept is not null").select("file", "k", "kept"))
        if len(settled) > 16:
            settled = [written(functools.reduce(DataFrame.unionByName, settled))]
        act = now.select("file", "k", "kept")
        asked = told.filter("left").join(act.filter(open_now), ["file", "k"], "left_semi").select(*key)
    state = functools.reduce(DataFrame.unionByName, settled)
    near = nearest_segments(points, segments, limit_m)
    told = consensus_points(points, near).join(numbered.select("file", "line", "k"), ["file", "line"]).join(state, ["file", "k"])
    begins = (F.col("kept") & ~F.coalesce(F.lag("kept").over(w), F.lit(False))).cast("int")
    told = told.withColumn("begins", begins).withColumn("run", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return told.filter("kept").select("file", "line", "run", "x", "y")
