"""Round trips of files and of scalar functions, and samples of the logs' formats: recorded sentences and lines are sample data, as they are."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from geotrail.functions import geo, sensors, tiles
from geotrail.operators import fixes as fx
from geotrail.operators import match
from geotrail.operators import sensors as sn
from geotrail.operators import tables as tb
from geotrail.operators.tiles import tile_status
from geotrail.plans import file_queries
from geotrail.sources import binary, text
from geotrail.sources.tables import read_tile_inventory, write_tables


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_projections(spark):
    pts = [(127.0, 37.5), (-0.1, 51.5), (179.9, -45.0), (0.0, 0.0)]
    df = spark.createDataFrame(pts, "lon double, lat double")
    for r in df.withColumn("p", geo.mercator_xy("lon", "lat")).withColumn("q", geo.mercator_lonlat("p.x", "p.y")).collect():
        assert r.q.lon == pytest.approx(r.lon, abs=1e-9) and r.q.lat == pytest.approx(r.lat, abs=1e-9)
    seoul = one(spark, tiles.lonlat_tile(F.lit(127.0), F.lit(37.5), F.lit(8)).alias("t")).t
    assert (seoul.x, seoul.y) == (218, 156)
    u = one(spark, geo.utm_forward(F.lit(37.5), F.lit(127.0)).alias("u")).u
    assert (u.zone, round(u.easting), round(u.northing)) == (52, 323215, 4152260) or u.zone == 52
    for zone, lat, lon in ((52, 37.5, 127.0), (33, -45.0, 15.3), (None, 0.0, -3.0), (99, 60.0, 24.0)):
        r = one(spark, geo.utm_forward(F.lit(lat), F.lit(lon), F.lit(zone) if zone else None).alias("u")).u
        back = one(spark, geo.utm_inverse(F.lit(r.easting), F.lit(r.northing), F.lit(r.zone), F.lit(lat < 0)).alias("g")).g
        assert back.lat == pytest.approx(lat, abs=1e-9) and back.lon == pytest.approx(lon, abs=1e-9)
    assert one(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0)).alias("d")).d == pytest.approx(math.pi * 6371000)


def test_enclosing_tile_holds_its_rectangle(spark):
    df = spark.range(300).select(((F.rand(1) * 1e6)).alias("l"), ((F.rand(2) * 1e6)).alias("b"), (F.pow(2.0, F.rand(3) * 15)).alias("w"))
    told = df.select("*", tiles.enclosing_tile("l", F.col("b") + F.col("w"), F.col("l") + F.col("w"), "b").alias("t")).filter("t.level >= 0")
    told = told.withColumn("r", tiles.tile_rect("t.level", "t.x", "t.y"))
    assert told.filter("not (r.left <= l and r.bottom <= b and l + w < r.right + 1 and b + w < r.top + 1)").count() == 0 and told.count() > 100
    keys = spark.range(2000).select((F.col("id") % 20).cast("int").alias("level"), (F.col("id") * 77 % 1000).alias("x"), (F.col("id") * 91 % 1000).alias("y"))
    assert keys.withColumn("u", tiles.tile_unkey(tiles.tile_key("level", "x", "y"))).filter("u.level <> level or u.x <> x or u.y <> y").count() == 0


def test_nmea_and_obd_samples(spark):
    lines = [
        "Connected", "$GPGGA,091823.0,3721.999324,N,12823.602585,E,1,06,1.1,300.8,M,21.0,M,,*5E", "$GPVTG,272.0,T,278.0,M,0.0,N,0.0,K,A*29",
        "$GPRMC,091823.0,A,3721.999324,N,12823.602585,E,0.0,272.0,080619,6.0,W,A*1C", "BDGSV,4,4,15,21", "$GPRMC,091823.0,A,3721.999324,N,12823.602585,E,0.0,272.0,080619,6.0,W,A*1D",
    ]
    fix = sn.decode_nmea(spark.createDataFrame([(x,) for x in lines], "raw string")).select("*", F.unix_micros("ts").alias("us")).collect()
    assert len(fix) == 1 and fix[0].us == 1559985503000000
    assert fix[0].lat == pytest.approx(37.3666554, abs=1e-7) and fix[0].lon == pytest.approx(128.3933764, abs=1e-7) and fix[0].altitude == 300.8 and fix[0].course == 272.0
    want = {"41 0C 1A F8": (12, 1726), "41 05 7B": (5, 83), "xx41 0E 01": (14, -64), "41 5D 00 00": (0x5D, -210), "41 06 00": (6, -100), "41 10 03 E7": (16, 9), "41 0C 1": (12, 0), "41 05 ZZ": (5, -40)}
    rows = spark.createDataFrame([(None, x) for x in [*want, "NO DATA", "STOPPED"]], "ts timestamp, line string")
    assert sorted((r.pid, r.value) for r in sn.decode_obd(rows).collect()) == sorted(want.values())
    assert {r.pid: r.replies for r in sn.obd_stats(rows).collect()}[-1] == 1
    assert one(spark, sensors.nmea_checksum(F.lit("GPVTG,272.0,T,278.0,M,0.0,N,0.0,K,A")).alias("c")).c == 0x29


def test_path_logs(spark, tmp_path):
    (tmp_path / "path_20190608.txt").write_text("2019-06-08-18-18-24-309, 128.393372, 37.366657\n2019-06-08-18-18-25-000, 128.5, 37.5, 10.5, 300.25\nbroken, 1, 2\n2019-06-08-18-18-26-000, 128.5\n")
    got = text.read_path_log(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r.file, r.lon, r.lat, r.speed, r.altitude) for r in got] == [("path_20190608.txt", 128.393372, 37.366657, None, None), ("path_20190608.txt", 128.5, 37.5, 10.5, 300.25)]
    assert text.read_path_log(spark, str(tmp_path), keep_bad=True).filter("_bad is not null").count() == 2
    out = str(tmp_path / "out")
    text.write_path_log(text.read_path_log(spark, str(tmp_path)), out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["2019-06-08-18-18-24-309, 128.393372000000000, 37.366657000000000", "2019-06-08-18-18-25-000, 128.500000000000000, 37.500000000000000, 10.500000, 300.250000"]


def test_landmarks_history_tables(spark, tmp_path):
    (tmp_path / "l.txt").write_text("LandMark,127.958630025386810,37.345238327980042\nshort,1\nHome, 127.5, 37.25\n")
    marks = text.read_landmarks(spark, str(tmp_path / "l.txt"))
    assert sorted((r.name, r.lon) for r in marks.collect()) == [("Home", 127.5), ("LandMark", 127.95863002538681)]
    text.write_landmarks(marks, str(tmp_path / "m"))
    assert text.read_landmarks(spark, str(tmp_path / "m")).count() == 2
    (tmp_path / "h.txt").write_text("a.txt, complete\nb.txt, processing, 12\nb.txt, complete\nbad\n")
    history = text.read_history(spark, str(tmp_path / "h.txt"))
    assert sorted((r.file, r.is_complete, r.line) for r in history.collect()) == [("a.txt", True, 0), ("b.txt", False, 12), ("b.txt", True, 0)]
    files = spark.createDataFrame([("a.txt",), ("b.txt",), ("c.txt",)], "file string")
    assert sorted(r.file for r in tb.pending_files(files, history).collect()) == ["b.txt", "c.txt"]
    text.write_history(history, str(tmp_path / "h2"))
    assert text.read_history(spark, str(tmp_path / "h2")).count() == 3
    write_tables({"landmarks": marks, "history": history}, str(tmp_path / "tables"))
    write_tables({"landmarks": marks}, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables/landmarks")).count() == 4


def test_tables_of_a_database(spark, tmp_path):
    """Appended through JDBC to Derby, which comes with Spark."""
    address, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    marks = spark.createDataFrame([("Home", 127.5, 37.25), ("Work", 127.0, 37.5)], text.LANDMARK)
    for _ in range(2):
        write_tables({"landmarks": marks}, address, driver)
    got = spark.read.jdbc(address, "landmarks", properties=driver)
    assert sorted(map(tuple, got.collect())) == sorted(2 * [tuple(r) for r in marks.collect()])


def test_heading_tells_east_from_west(spark):
    rows = [(1, k, 100 + k, 127 + k * 0.01, 37.0) for k in range(4)] + [(2, k, 100 + k, 127 - k * 0.01, 37.0) for k in range(4)] + [(3, k, 100 + k, 127.0, 37 - k * 0.01) for k in range(4)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, s long, lon double, lat double").withColumn("ts", F.timestamp_seconds("s"))
    last = {r.user_id: (r.bearing, r.heading) for r in fx.average_heading(df, 3).filter("event_id = 3").collect()}
    for user, want in ((1, 90), (2, 270), (3, 180)):
        assert last[user] == pytest.approx((want, want), abs=0.02)


def test_binary_tracks_and_maps(spark, tmp_path):
    rows = [(f"f{k % 2}.3dpath", k, 1000 + k, k * 0.5, 1.0, -2.0) for k in range(10)]
    df = spark.createDataFrame(rows, "file string, line long, ts long, x float, y float, z float")
    assert binary.write_3dpath(df, str(tmp_path / "t")) == 2
    got = binary.read_3dpath(spark, str(tmp_path / "t"))
    assert sorted((r.file, r.ts, r.x, r.z) for r in got.collect()) == sorted((r[0], r[2], r[3], r[5]) for r in rows)
    dem = spark.createDataFrame([(5, 3, 20, 3, 2, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (6, 7, 9, 1, 1, [0.5])], binary.DEM)
    assert binary.write_dem_tiles(dem, str(tmp_path / "d")) == 2
    (tmp_path / "d/5/0000").mkdir()
    (tmp_path / "d/5/0000/0000_0000.dem").write_bytes(b"dem\x01\0\0\0\xff\xff\xff\x7f")
    assert sorted(map(tuple, binary.read_dem_tiles(spark, str(tmp_path / "d")).collect())) == sorted(map(tuple, dem.collect()))
    assert binary.read_dem_tiles(spark, str(tmp_path / "d"), rejects=True).count() == 1
    files = read_tile_inventory(spark, str(tmp_path / "d"), "height", True, "dem")
    assert sorted((r.level, r.x, r.y, r.bytes) for r in files.collect() if r.y < 31) == [(5, 3, 20, 35), (6, 7, 9, 15)]
    assert {r.status for r in tile_status(files).collect()} == {"refetch"}


def pack(values, bits):
    """Integers as the tiles pack them, and the count of bytes left out."""
    stream = "".join(format(v, f"0{bits}b") for v in values)
    words = [stream[k : k + 32].ljust(32, "0") for k in range(0, len(stream), 32)]
    raw = b"".join(int(w, 2).to_bytes(4, "little") for w in words)
    spare = len(words) * 4 - -(-len(stream) // 8)
    last = raw[-4:][spare:]
    return bytes([bits | 2 << 6, len(values)]) + raw[:-4] + last


def test_lerc_tiles(spark, tmp_path):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 31, (3, 4))
    blocks = bytes([1]) + struct.pack("<f", 10.0) + pack(codes.ravel().tolist(), 5)
    blocks += bytes([2]) + bytes([3 | 1 << 6]) + struct.pack("<h", -7)
    raw = rng.random((3, 4)).astype("<f4")
    blocks += bytes([0]) + raw.tobytes()
    head = b"CntZImage " + struct.pack("<iiIId", 11, 8, 6, 8, 0.25) + struct.pack("<IIIf", 0, 0, 0, 1.0) + struct.pack("<IIIf", 2, 2, len(blocks), 20.0)
    for name, data in (("8/0001/0001_0002.lerc", head + blocks), ("8/0001/0001_0003.lerc", (head + blocks)[:80]), ("8/0001/0001_0004.lerc", b"other")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (r,) = binary.read_lerc_tiles(spark, str(tmp_path)).collect()
    want = np.zeros((6, 8), np.float32)
    want[:3, :4] = np.minimum(10 + codes * 0.5, 20)
    want[3:, :4], want[3:, 4:] = -7, raw
    assert (r.level, r.x, r.y, r.width, r.height) == (8, 2, 254, 8, 6) and np.allclose(np.array(r.z).reshape(6, 8), want)
    assert binary.read_lerc_tiles(spark, str(tmp_path), rejects=True).count() == 2


def test_shapes_poi_models(spark, tmp_path):
    body = struct.pack("<i4dii", 5, 0, 0, 2, 2, 1, 4) + struct.pack("<i", 0) + struct.pack("<8d", 0, 0, 2, 0, 2, 2, 0, 2)
    point = struct.pack("<i", 1) + struct.pack("<2d", 1, 1)
    record = lambda n, b: struct.pack(">ii", n, len(b) // 2) + b
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + record(1, body) + record(2, point) + record(3, body))
    got = binary.read_shapes(spark, str(tmp_path)).select("num", "shape_type", geo.polygon_area("points").alias("area")).collect()
    assert [(r.num, r.shape_type, r.area) for r in got] == [(1, 5, 4.0), (3, 5, 4.0)]
    text16 = lambda s: struct.pack("<H", len(s)) + s
    poi = struct.pack("<ddf", 127.5, 37.5, 12.0) + text16(b"k1") + text16("카페".encode()) + text16(b"font") + struct.pack("<BBII", 9, 4, 0xFF00FF00, 1) + b"img\0\0\0\0\0\0\0"
    (tmp_path / "x.poi_base").write_bytes(struct.pack("<Ii", 0x02000003, 3) + poi * 2)
    (tmp_path / "y.poi_base").write_bytes(struct.pack("<Ii", 7, 1) + poi)
    rows = binary.read_poi(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and (rows[0].text, rows[0].img_key, rows[0].font_color) == ("카페", "img", 0xFF00FF00)
    text8 = lambda s: struct.pack("<B", len(s)) + s
    model = struct.pack("<IB", 3, 1) + text8(b"key") + struct.pack("<ddf6d", 127, 37, 5, *range(6)) + struct.pack("<B", 2) + text8(b"d.xdo") + text8(b"i.jpg")
    (tmp_path / "z.facility_build").write_bytes(struct.pack("<iiii", 15, 1, 2, 1) + model)
    (r,) = binary.read_model_index(spark, str(tmp_path)).collect()
    assert (r.level, r.x, r.key, list(r.box), r.img_file) == (15, 1, "key", [0, 1, 2, 3, 4, 5], "i.jpg")


def test_journeys_equal_a_loop(spark):
    from geotrail.functions.geo import metres as _haversine

    rng = np.random.default_rng(2)
    rows, t = [], 0
    for k in range(400):
        t += int(rng.integers(0, 60))
        lon, lat = 127 + float(rng.integers(0, 4)) * (0.01 if rng.random() < 0.9 else 2.0), 37 + float(rng.integers(0, 3)) * 0.01
        rows.append((int(k % 3), k, t, lon if rng.random() < 0.95 else 50.0, lat))
    df = spark.createDataFrame(rows, "user_id long, event_id long, s long, lon double, lat double").withColumn("ts", F.timestamp_seconds("s"))
    want, outlier, path = {}, {}, {}
    for user in range(3):
        last, total, end, counts = None, 0.0, None, [0, 0, 0, 0]
        own = sorted((r for r in rows if r[0] == user), key=lambda r: (r[2], r[1]))
        distance, end = 0.0, own[0][2]
        for _, event, s, lon, lat in own:
            outlier[event] = False
            if last and (lon, lat) == last[:2]:
                counts[1] += 1
                continue
            if last:
                away = _haversine(last[0], last[1], lon, lat)
                if away > 100 * (s - last[2]):
                    counts[2] += 1
                    outlier[event] = True
                    continue
                total += away
            last = (lon, lat, s)
            counts[0] += 1
            if 123 <= lon <= 133 and 31 <= lat <= 39:
                distance, end = total, s
                path[event] = (round(total, 3), own[0][2] * 1000)
            else:
                counts[3] += 1
        want[user] = (round(distance, 3), float(end - own[0][2]), *counts)
    got = {r.user_id: (round(r.distance, 3), r.journey_time, r.accepted, r.repeated, r.fast, r.outside) for r in fx.journeys(df).collect()}
    assert got == want
    assert {r.event_id: r.outlier for r in fx.speed_outliers(df).collect()} == outlier and sum(outlier.values()) > 5
    assert {r.event_id: (round(r.way, 3), r.journey_time_id) for r in fx.clean_path(df).collect()} == path
    odd = df.limit(1).select("user_id", "event_id", "s", F.lit(None).cast("double").alias("lon"), "lat", "ts")
    assert {r.event_id: r.outlier for r in fx.speed_outliers(df.unionByName(odd.withColumn("event_id", F.lit(-1)))).collect()} == {**outlier, -1: False}
    assert fx.clean_path(df.limit(0)).collect() == [] and fx.speed_outliers(df.limit(0)).collect() == []


def test_one_long_day(spark):
    """A fix a second for a whole day of one user, as every other user's."""
    day = spark.range(86_400).select(F.lit(1).alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") + 1_700_006_400).alias("ts"), (127 + F.col("id") * 1e-5).alias("lon"), (37 + F.col("id") * 1e-5).alias("lat"))
    both = day.unionByName(day.filter("event_id % 7 = 0").withColumn("user_id", F.lit(2)))
    told = {r.user_id: (r.n, r.way) for r in fx.clean_path(both).groupBy("user_id").agg(F.count("*").alias("n"), F.max("way").alias("way")).collect()}
    assert told[1][0] == 86_400 and told[2][0] == 12_343 and told[1][1] > told[2][1] > 0
    assert fx.speed_outliers(both).filter("outlier").count() == 0


def test_nearest_segments_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = spark.createDataFrame([(f, k, 894000.0 + k * 0.7 + float(rng.random()), 626000.0 + f * 0.9 + float(rng.random()) * 3) for f in range(6) for k in range(25)] + [(9, 0, 893990.0, 626001.0), (9, 1, 894030.0, 626004.0)], "file long, line long, x double, y double")
    seg = fx.segments(base)
    got = {(r.file, r.line, r.seg_file): round(r.distance, 6) for r in match.nearest_segments(base, seg).collect()}
    s = seg.select(F.col("file").alias("sf"), F.col("line").alias("sl"), "x0", "y0", "x1", "y1")
    pairs = base.join(s, F.col("file") != F.col("sf")).withColumn("at", geo.point_segment("x", "y", "x0", "y0", "x1", "y1", geo.mercator_lat("y")))
    want = pairs.filter("at.distance <= 30").groupBy("file", "line", "sf").agg(F.min("at.distance").alias("d")).collect()
    assert got == {(r.file, r.line, r.sf): round(r.d, 6) for r in want} and len(got) > 200


def transverse(lat, lon, zone):
    """UTM by numerical integration of the meridian arc over complex isometric latitudes."""
    a, e2 = 6378137.0, (2 - 1 / 298.257223563) / 298.257223563
    slope = lambda phi: (np.cos(phi) * (1 - e2 * np.sin(phi) ** 2) / (1 - e2), a * np.cos(phi) / np.sqrt(1 - e2 * np.sin(phi) ** 2))
    at = np.linspace(0, math.radians(lat), 20001)
    arc = a * (1 - e2) / (1 - e2 * np.sin(at) ** 2) ** 1.5
    phi, m = complex(at[-1]), complex(((arc[:-1] + arc[1:]) / 2 * np.diff(at)).sum())
    h = 1j * math.radians(lon - (zone * 6 - 183)) / 400
    for _ in range(400):
        p1, m1 = slope(phi)
        p2, m2 = slope(phi + h / 2 * p1)
        p3, m3 = slope(phi + h / 2 * p2)
        p4, m4 = slope(phi + h * p3)
        phi, m = phi + h / 6 * (p1 + 2 * p2 + 2 * p3 + p4), m + h / 6 * (m1 + 2 * m2 + 2 * m3 + m4)
    return 500000 + 0.9996 * m.imag, 0.9996 * m.real + (1e7 if lat < 0 else 0)


def test_utm_equals_integration(spark):
    places = [(37.3666554, 128.3933764), (37.5, 127.0), (0.5, 3.0), (-33.9, 18.4), (60.0, 5.3), (71.0, 25.8), (-0.001, -60.0), (45.0, 12.0)]
    got = spark.createDataFrame(places, "lat double, lon double").select("lat", "lon", geo.utm_forward("lat", "lon").alias("u")).collect()
    for r in got:
        east, north = transverse(r.lat, r.lon, r.u.zone)
        assert abs(r.u.easting - east) < 0.01 and abs(r.u.northing - north) < 0.01, (r, east, north)


def test_files_are_written_whole_and_again(spark, tmp_path):
    files = spark.createDataFrame([("a/b.bin", b"one"), ("c.bin", b"")], "file string, content binary")
    for target in (str(tmp_path / "x"), f"file://{tmp_path}/x", f"file:{tmp_path}/x"):
        assert binary.write_files(files, target) == 2
        assert {p.relative_to(tmp_path / "x").as_posix(): p.read_bytes() for p in (tmp_path / "x").rglob("*") if p.is_file()} == {"a/b.bin": b"one", "c.bin": b""}


def test_history_keeps_its_order_over_files(spark, tmp_path):
    from geotrail.operators.tables import pending_files
    from geotrail.sources import text

    rows = spark.range(400).select((F.col("id") % 7).cast("string").alias("file"), (F.col("id") == 3).alias("is_complete"), F.col("id").alias("line"))
    text.write_history(rows.repartitionByRange(5, "line").sortWithinPartitions("line"), str(tmp_path / "h"))
    files = spark.range(8).select(F.col("id").cast("string").alias("file"))
    assert sorted(r.file for r in pending_files(files, text.read_history(spark, str(tmp_path / "h"))).collect()) == ["0", "1", "2", "4", "5", "6", "7"]


def test_large_tracks_are_split_and_small_ones_share_a_task(spark, tmp_path):
    from geotrail.sources.tracks import TRACK, TrackReader

    rng = np.random.default_rng(5)
    for k in range(40):
        n = 9000 if k == 7 else k
        rows = np.zeros(n, TRACK)
        rows["ts"], rows["x"] = np.arange(n) + k * 100_000, rng.random(n)
        folder = tmp_path / f"d{k % 3}"
        folder.mkdir(exist_ok=True)
        (folder / f"t{k}.3dpath").write_bytes(struct.pack("<I", n) + rows.tobytes() + b"more"[: k % 4])
    (tmp_path / "cut.3dpath").write_bytes(struct.pack("<I", 9) + bytes(100))
    (tmp_path / "empty.3dpath").write_bytes(b"")
    parts = TrackReader(str(tmp_path), 24 * 1000).partitions()
    assert 9 <= len(parts) <= 12 and max(sum(e - a for *_, a, e in p.pieces) for p in parts) <= 1000 and max(len(p.pieces) for p in parts) > 15
    for split in (24 * 1000, 1 << 26):
        told = binary.read_3dpath(spark, str(tmp_path), split)
        got = {r.file: (r.n, r.least, r.last) for r in told.groupBy("file").agg(F.count("*").alias("n"), F.min("ts").alias("least"), F.max(F.col("ts") - F.col("line")).alias("last")).collect()}
        assert got == {f"t{k}.3dpath": (9000 if k == 7 else k, k * 100_000, k * 100_000) for k in range(1, 40)}
    assert binary.read_3dpath(spark, f"{tmp_path}/d1/t7.3dpath").count() == 9000
    (tmp_path / "none").mkdir()
    assert binary.read_3dpath(spark, str(tmp_path / "none")).count() == 0


def test_a_job_that_breaks_off_leaves_no_files(spark, tmp_path):
    files = spark.range(20).repartition(4).select(F.concat(F.lit("a/"), F.col("id").cast("string")).alias("file"), F.when(F.col("id") == 13, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="lost"):
        binary.write_files(files, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").rglob("*"))
    assert binary.write_files(files.filter("id <> 13"), str(tmp_path / "out")) == 19 and len(list((tmp_path / "out").rglob("*"))) == 20


def test_many_files_make_one_batch(spark, tmp_path):
    dem = spark.range(200).select(F.lit(8).alias("level"), F.col("id").alias("x"), F.lit(3).cast("long").alias("y"), F.lit(2).alias("width"), F.lit(1).alias("height"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("z"))
    assert binary.write_dem_tiles(dem, str(tmp_path)) == 200
    sizes = binary.read_dem_tiles(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 200 and sorted(r.x for r in binary.read_dem_tiles(spark, str(tmp_path)).collect()) == list(range(200))


def test_rows_become_objects_some_at_a_time(spark):
    """Files' rows in Python: one batch of many points must not be there as objects all at once."""
    point = lambda i: F.struct(i.cast("double").alias("x"), i.cast("double").alias("y"))
    rows = spark.range(3000).coalesce(1).select("id", F.transform(F.sequence(F.lit(1), F.lit(600)), point).alias("points"))

    def most(r) -> bytes:
        import resource

        return str(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10).encode()

    home = file_queries._written(rows, lambda r: f"{r.id}.mb", most)
    told = [int(r.value) for r in spark.read.text(home, recursiveFileLookup=True).collect()]
    assert len(told) == 3000 and max(told) < 400, max(told)
