"""NMEA logs in their order: epochs of many days and devices, damaged lines, cut logs."""

import functools

import pytest
from pyspark.sql import functions as F

from geotrail.operators import sensors as sn
from geotrail.sources import text


def line(body):
    return f"${body}*{functools.reduce(lambda a, c: a ^ ord(c), body, 0):02X}"


def gga(clock, altitude, talker="GP"):
    return line(f"{talker}GGA,{clock},3721.9,N,12823.6,E,1,06,1.1,{altitude},M,21.0,M,,")


def rmc(clock, day, talker="GP"):
    return line(f"{talker}RMC,{clock},A,3721.9,N,12823.6,E,10.0,272.0,{day},6.0,W,A")


def decoded(spark, logs, keys=(), chunk=None):
    """logs: (keys..., file, line, raw) rows; sorted (day of month, clock, altitude), after the keys."""
    names = [*(f"{k} string" for k in keys), "file string, line long, raw string"]
    rows = spark.createDataFrame(logs, ", ".join(names)).repartition(3)
    told = sn.rmc_with_altitude(sn.sentences(rows, damaged=True), keys, *([chunk] if chunk else []))
    return sorted((tuple(r[k] for k in keys or ("file",)), r.ts.day, r.utc, r.altitude) for r in told.collect())


def numbered(raws, *head):
    return [(*head, k * 10, raw) for k, raw in enumerate(raws)]


@pytest.mark.parametrize("chunk", [None, 20, 50])
@pytest.mark.parametrize("first", ["gga", "rmc"])
def test_same_clock_on_two_days_and_two_devices(spark, chunk, first):
    def log(base):
        out = []
        for day in ("080619", "090619"):
            for s in range(20, 24):
                pair = [gga(f"0918{s}.0", base + s + (100 if day[0:2] == "09" else 0)), rmc(f"0918{s}.0", day)]
                out += pair if first == "gga" else pair[::-1]
        return out

    want = sorted(((f,), d, f"0918{s}.0", base + s + (100 if d == 9 else 0.0)) for f, base in (("a", 200.0), ("b", 500.0)) for d in (8, 9) for s in range(20, 24))
    rows = numbered(log(200.0), "a") + numbered(log(500.0), "b")
    assert decoded(spark, rows, (), chunk) == want
    assert decoded(spark, [(r[0], "one", *r[1:]) for r in rows if r[0] == "a"] + [(r[0], "x/two", *r[1:]) for r in rows if r[0] == "b"], ("device",), chunk) == want


def test_one_second_on_two_days_in_a_row(spark):
    """A receiver that stops and starts at the same second of another day; places decide, not times."""
    raws = [gga("091823.0", 300.8), rmc("091823.0", "080619"), gga("091823.0", 12.0), rmc("091823.0", "090619")]
    lead = [gga("091822.0", 7.0), rmc("091822.0", "080619")]
    assert decoded(spark, numbered(lead + raws, "f")) == [(("f",), 8, "091822.0", 7.0), (("f",), 8, "091823.0", 300.8), (("f",), 9, "091823.0", 12.0)]


@pytest.mark.parametrize("chunk", [None, 10, 30])
def test_damaged_lost_and_lone_sentences(spark, chunk):
    raws = [
        gga("000001.0", 1.0), rmc("000001.0", "010119"), gga("000002.0", 2.0), rmc("000002.0", "010119")[:-1] + "x", gga("000002.0", 3.0)[:-2] + "00", rmc("000002.0", "020119"),
        gga("000003.0", 4.0), gga("000003.0", 5.0), rmc("000003.0", "030119"), "Connected", gga("000004.0", 6.0, "GP"), gga("000004.0", 8.0, "GN"), gga("000004.0", 7.0, "BD"), rmc("000004.0", "030119"),
        rmc("000005.0", "030119"), gga("235959.0", 9.0), rmc("235959.0", "030119"), gga("000000.0", 10.0), rmc("000000.0", "040119"), gga("000001.0", 11.0), "GPRMC cut", "",
    ]
    want = [(1, "000001.0", 1.0), (2, "000002.0", None), (3, "000003.0", 5.0), (3, "000004.0", 8.0), (3, "000005.0", None), (3, "235959.0", 9.0), (4, "000000.0", 10.0)]
    assert decoded(spark, numbered(raws, "f"), (), chunk) == [(("f",), *w) for w in want]


def test_fixes_carry_speed_and_course_and_null_devices(spark):
    rows = spark.createDataFrame([(None, 0, gga("091823.0", 300.8)), (None, 1, rmc("091823.0", "080619")), ("d", 0, rmc("091823.0", "080619"))], "device string, line long, raw string")
    told = sn.decode_nmea(rows, ("device",)).orderBy("device").collect()
    assert [(r.device, r.altitude) for r in told] == [(None, 300.8), ("d", None)]
    assert told[0].speed == pytest.approx(10 * 1852 / 3600) and told[0].course == 272.0 and told[0].lat == pytest.approx(37 + 21.9 / 60)
    assert sn.decode_nmea(rows.limit(0), ("device",)).count() == 0


def test_read_nmea_orders_lines_over_splits(spark, tmp_path):
    raws = [x for k in range(400) for x in (gga(f"{k // 60:02d}{k % 60:02d}07.0", float(k)), rmc(f"{k // 60:02d}{k % 60:02d}07.0", "080619"))]
    (tmp_path / "device=7").mkdir()
    (tmp_path / "device=7/a.log").write_text("\n".join(["Connected", *raws]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        told = text.read_nmea(spark, str(tmp_path))
        assert told.columns == ["device", "file", "line", "raw"] and told.rdd.getNumPartitions() > 5
        assert [r.raw for r in told.orderBy("line").collect()] == ["Connected", *raws]
        got = sn.decode_nmea(told, ("device",)).select(F.minute("ts") + 60 * F.hour("ts"), "altitude").collect()
        assert sorted(map(tuple, got)) == [(k, float(k)) for k in range(400)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_checksums_are_of_bytes_and_lines_are_taken_apart_once(spark):
    from functools import reduce

    from geotrail.functions.sensors import nmea_checksum

    texts = ["GPRMC,1", "", None, "ünï,☃", "a" * 2000, "GPGGA,é"]
    told = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(2).filter("k <> 4").withColumn("c", nmea_checksum("t"))
    assert {r.k: r.c for r in told.collect()} == {k: None if t is None else reduce(lambda a, b: a ^ b, t.encode(), 0) for k, t in enumerate(texts) if k != 4}
    body = lambda t: f"${t}*{reduce(lambda a, b: a ^ b, t.encode(), 0):02X}"
    lines = [(1, k, body(f"GPRMC,09{k:02d}23,A,3721.9993,N,12823.6026,E,0.5,272.0,080619,6.0,W,A")) for k in range(5)]
    fixes = sn.decode_nmea(spark.createDataFrame(lines, "device long, line long, raw string"), ("device",))
    assert "regexp" not in fixes._jdf.queryExecution().analyzed().toString() and fixes.count() == 5
