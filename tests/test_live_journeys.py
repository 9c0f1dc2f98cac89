"""Live journeys in any order of arrival, and their stored tables."""

import pytest
from pyspark.sql import functions as F

from geotrail.operators import fixes as fx
from geotrail.plans.adapters import fixes
from geotrail.streaming import fixes as live

FIX = "user_id long, event_id long, s long, lon double, lat double"
DAY = 86_400


def arrived(spark, home, batches, build):
    """Runs each batch of fixes (user, event, second, lon, lat) through a stream; its rows, and how many were dropped as late."""
    dropped = 0
    for rows in batches:
        if rows:
            spark.createDataFrame(rows, FIX).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(f"{home}/in")
        source = live.fix_stream(spark, f"{home}/in", FIX + ", ts timestamp", max_files=100)
        query = live.start(build(source), spark)
        query.awaitTermination()
        dropped += sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    return dropped


def written(home):
    def build(source):
        rows = live.stream_journeys(source)
        return rows.writeStream.format("parquet").option("checkpointLocation", f"{home}/check").option("path", f"{home}/out").trigger(availableNow=True)

    return build


def fix(user, event, s, lon=None, lat=37.0):
    return user, event, s, 127 + s % 100_000 * 1e-5 if lon is None else lon, lat


def test_fixes_that_come_a_batch_late_are_kept(spark, tmp_path):
    home, t = str(tmp_path), 10 * DAY
    batches = [[fix(1, 1, t + 1), fix(1, 3, t + 3)], [fix(1, 2, t + 2)], [fix(1, 4, t + 4)], [fix(2, 9, t + 2 * DAY)]]
    assert arrived(spark, home, batches, written(home)) == 0
    told = spark.read.parquet(f"{home}/out")
    assert [r.event_id for r in told.filter("kind = 'path' and user_id = 1").orderBy("distance", "t").collect()] == [1, 2, 3, 4]
    assert told.filter("kind = 'journey'").count() == 1  # the other user's is still waiting


def test_late_fixes_are_counted(spark, tmp_path):
    home, t = str(tmp_path), 10 * DAY
    batches = [[fix(1, 1, t), fix(1, 2, t + 20_000)], [fix(1, 3, t + 5), fix(1, 4, t + 16_399), fix(1, 5, t + 19_000)], [fix(2, 9, t + 2 * DAY)]]
    assert arrived(spark, home, batches, written(home)) == 2
    assert sorted(r.event_id for r in spark.read.parquet(f"{home}/out").filter("kind = 'path'").collect()) == [1, 2, 5]


@pytest.mark.parametrize("parts", [5])
def test_shuffled_arrival_gives_the_batch_rows(spark, tmp_path, parts):
    import geotrail.plans.catalog  # noqa: F401
    from geotrail.plans.fix_queries import closed, spans

    home, rows = str(tmp_path), fixes(spark, "/root/testdata/sf0.001")
    for part in spans(closed(rows), parts, 3000):
        part.coalesce(1).write.mode("append").parquet(f"{home}/in")
        live.start(written(home)(spark.readStream.schema(rows.schema).parquet(f"{home}/in")), spark).awaitTermination()
    got = spark.read.parquet(f"{home}/out")
    want = fx.clean_path(rows).select("user_id", "event_id", F.round("way", 3).alias("way"), F.col("journey_time_id").alias("time_id"))
    assert sorted(map(tuple, got.filter("kind = 'path'").select("user_id", "event_id", F.round("distance", 3), "time_id").collect())) == sorted(map(tuple, want.collect()))
    assert {(r.user_id, r.time_id): (round(r.distance, 3), r.journey_time) for r in live.journey_updates(got).collect()} == {(r.user_id, r.time_id): (round(r.distance, 3), r.journey_time) for r in fx.journeys(rows).collect()}


def test_incomplete_fixes_do_no_harm(spark, tmp_path):
    home, t = str(tmp_path), 10 * DAY
    batches = [[fix(1, 1, t, 127.0), (1, 2, t + 1, None, 37.0), (None, 3, t + 2, 127.0, 37.0), (1, 4, None, 127.0, 37.0), (1, None, t + 3, 127.001, 37.0)], [fix(2, 9, t + 2 * DAY)]]
    arrived(spark, home, batches, written(home))
    assert sorted(r.event_id for r in spark.read.parquet(f"{home}/out").filter("kind = 'path'").collect()) == [0, 1]


def test_sink_commits_whole_batches(spark, tmp_path):
    home, t = str(tmp_path), 10 * DAY
    build = lambda source: live.stream_sink(live.stream_journeys(source), f"{home}/out", f"{home}/check")
    days = [[fix(u, d * 10 + u, t + d * DAY + u) for u in range(3)] for d in range(5)]
    arrived(spark, home, [*days, [fix(1, 60, t + 4 * DAY + 900)], [fix(9, 99, t + 9 * DAY)]], build)
    got = {(r.user_id, r.time_id): round(r.distance, 3) for r in live.read_journeys(spark, f"{home}/out").collect()}
    rows = spark.createDataFrame([f for b in days for f in b] + [fix(1, 60, t + 4 * DAY + 900)], FIX).withColumn("ts", F.timestamp_seconds("s"))
    assert got == {(r.user_id, r.time_id): round(r.distance, 3) for r in fx.journeys(rows).collect()} and len(got) == 15
    assert live.read_paths(spark, f"{home}/out").count() == fx.clean_path(rows).count() == 16
    log = live.CommitLog(spark, f"{home}/out/journeys/_log")
    last = log.last()
    assert len(log.numbers()) == log.KEPT and len(log.read()) == 5
    stored = {d.name: {v.name for v in d.iterdir() if v.is_dir()} for d in (tmp_path / "out/journeys").iterdir() if d.name.startswith("date=")}
    assert all(f"version={v}" in stored[f"date={day}"] for day, v in log.read().items())
    assert len(set(log.read().values())) > 2  # a batch writes the dates that it touches

    # what isn't committed isn't seen, a repeated batch does nothing, and one that broke off is done again
    build_once = build(spark.readStream.schema(FIX + ", ts timestamp").parquet(f"{home}/in"))
    more = live.journey_updates(spark.createDataFrame([("path", 1, "1970-01-11", t * 1000 + 1000, 7, (t + 5) * 1_000_000, 127.0, 37.0, 5e5, 4.0)], live.JOURNEY))
    more.withColumn("version", F.lit(last + 1)).write.mode("append").partitionBy("date", "version").parquet(f"{home}/out/journeys")
    assert {(r.user_id, r.time_id): round(r.distance, 3) for r in live.read_journeys(spark, f"{home}/out").collect()} == got
    assert build_once is not None
    log.write(last + 1, log.read() | {"1970-01-11": last + 1})
    changed = {(r.user_id, r.time_id): r.distance for r in live.read_journeys(spark, f"{home}/out").filter("date = '1970-01-11'").collect()}
    assert changed == {(1, t * 1000 + 1000): 5e5}
    assert {(r.user_id, r.time_id): round(r.distance, 3) for r in live.read_journeys(spark, f"{home}/out", before=last + 1).collect()} == got


def test_sink_opens_touched_dates_only(spark, tmp_path, monkeypatch):
    home, t, opened = str(tmp_path), 10 * DAY, []
    monkeypatch.setattr(live, "_stored", lambda s, target, dates, f=live._stored: opened.append(set(dates)) or f(s, target, dates))
    build = lambda source: live.stream_sink(live.stream_journeys(source), f"{home}/out", f"{home}/check")
    arrived(spark, home, [[fix(1, d, t + d * DAY) for d in range(4)], [fix(1, 7, t + 3 * DAY + 14_400)], [fix(2, 9, t + 9 * DAY)]], build)
    assert all(len(o) <= 1 for o in opened) and {"1970-01-14"} in opened


def test_calls_dont_grow_with_users(spark, tmp_path, monkeypatch):
    """Users are dealt into groups: a day goes on over batches for each, at 0, 0 and in any group, with as many states as groups."""
    home, t, states = str(tmp_path), 10 * DAY, []
    monkeypatch.setattr(live, "GROUPS", 4)
    place = lambda u, k: (0.0, 0.0) if u % 3 == 0 and k in (0, 2) else (0.0001 * k + (60.0 if k == 3 and u % 5 == 0 else 0.0), 0.0)
    batches = [[fix(u, k, t + k * 4000 + u, *place(u, k)) for u in range(40)] for k in range(6)] + [[fix(99, 99, t + 9 * DAY)]]
    box = (-180.0, 180.0, -90.0, 90.0)

    def build(source):
        return live.stream_journeys(source, box=box).writeStream.format("parquet").option("checkpointLocation", f"{home}/check").option("path", f"{home}/out").trigger(availableNow=True)

    for rows in batches:
        spark.createDataFrame(rows, FIX).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(f"{home}/in")
        query = live.start(build(live.fix_stream(spark, f"{home}/in", FIX + ", ts timestamp", max_files=100)), spark)
        query.awaitTermination()
        states += [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert 0 < max(states) <= 4
    rows = spark.createDataFrame([f for b in batches[:-1] for f in b], FIX).withColumn("ts", F.timestamp_seconds("s"))
    got = spark.read.parquet(f"{home}/out")
    want = fx.clean_path(rows, box=box).select("user_id", "event_id", F.round("way", 3).alias("way"), F.col("journey_time_id").alias("time_id"))
    assert sorted(map(tuple, got.filter("kind = 'path'").select("user_id", "event_id", F.round("distance", 3), "time_id").collect())) == sorted(map(tuple, want.collect()))
    assert got.filter("kind = 'journey'").count() == 40


def test_sink_files_dont_grow_with_tasks(spark, tmp_path, monkeypatch):
    """A date's version has ``FILES`` files at most, however many tasks write."""
    monkeypatch.setattr(live, "FILES", 2)
    home, t, before = str(tmp_path), 10 * DAY, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        build = lambda source: live.stream_sink(live.stream_journeys(source), f"{home}/out", f"{home}/check")
        arrived(spark, home, [[fix(u, d * 100 + u, t + d * DAY + u) for u in range(40) for d in range(3)], [fix(99, 999, t + 9 * DAY)]], build)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found = [len(list(v.glob("*.parquet"))) for v in (tmp_path / "out/journeys").glob("date=*/version=*")]
    assert len(found) == 3 and max(found) <= 2
    assert live.read_journeys(spark, f"{home}/out").count() == 120
