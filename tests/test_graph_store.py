"""A graph that grows file by file against one built at once."""

from pyspark.sql import functions as F

from geotrail.operators import graph, graph_store
from geotrail.operators.graph_store import GraphStore


def tracks(spark, files):
    rows = [(f, k, 500_000.0 + f % 3 * 40 + k * 0.4 + (0.05 * f), 600_000.0 + f % 2 * 0.3) for f in files for k in range(60)]
    return spark.createDataFrame(rows, "file long, line long, x double, y double")


def told(vertices, edges):
    v = sorted((r.qgid, round(r.px, 6), round(r.pz, 6), r.acc_cnt, r.tr_cnt) for r in vertices.collect())
    return v, sorted((r.src, r.dst, r.cnt) for r in edges.collect())


def folders(path):
    return {p.relative_to(path).as_posix(): sorted((f.name, f.stat().st_mtime_ns) for f in p.iterdir() if f.name.startswith("part")) for p in path.rglob("version=*")}


def test_grows_as_built_at_once(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    assert store.read() is None and store.graph() is None
    assert [store.add(tracks(spark, files)) for files in ([0, 1, 2, 3], [2, 3, 4, 5], [5], [6, 7, 8])] == [4, 2, 0, 3]
    vertices, edges = told(*store.graph(cap=20))
    assert (vertices, edges) == told(*graph.build_road_graph(tracks(spark, range(9)), cap=20))
    assert any(n > 1 for *_, n, _ in vertices) and any(n > 1 for *_, n in edges)  # they really merge
    assert sorted(r.file for r in store.history().collect()) == [str(k) for k in range(9)]
    assert store.log.last() == 3


def test_untouched_cells_keep_their_files(spark, tmp_path):
    store, far = GraphStore(spark, str(tmp_path)), 40_000.0
    store.add(tracks(spark, [0, 1]))
    before = folders(tmp_path)
    moved = tracks(spark, [2, 3]).withColumn("x", F.col("x") + far)
    store.add(moved)
    after = folders(tmp_path)
    assert all(after[k] == v for k, v in before.items()) and len(after) > len(before)
    store.add(tracks(spark, [4]))  # in the first files' cells: new versions there only
    last = store.log.read()
    assert {v for part, v in last.items() if part.startswith("vertices")} == {2, 3}
    assert told(*store.graph()) == told(*graph.build_road_graph(tracks(spark, [0, 1, 4]).unionByName(moved)))


def test_what_isnt_committed_isnt_seen(spark, tmp_path, monkeypatch):
    store = GraphStore(spark, str(tmp_path))
    store.add(tracks(spark, [0, 1]))
    before = told(*store.graph())

    def broken(number, live):
        raise OSError("lost")

    monkeypatch.setattr(store.log, "write", broken)
    try:
        store.add(tracks(spark, [2, 3]))
    except OSError:
        pass
    again = GraphStore(spark, str(tmp_path))
    assert told(*again.graph()) == before and again.add(tracks(spark, [1, 2, 3])) == 2
    assert told(*again.graph()) == told(*graph.build_road_graph(tracks(spark, range(4))))


def test_files_dont_grow_with_tasks(spark, tmp_path, monkeypatch):
    """A cell has ``FILES`` files at most, however many tasks write."""
    monkeypatch.setattr(graph_store, "FILES", 2)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(before, ("16", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        store, far = GraphStore(spark, str(tmp_path)), tracks(spark, [0, 1, 2, 3]).withColumn("x", F.col("x") + 40_000.0)
        store.add(tracks(spark, [4, 5, 6]).unionByName(far))
        store.add(tracks(spark, [7, 8]))
        found = {k: len([name for name, _ in files if name.endswith(".parquet")]) for k, files in folders(tmp_path).items()}
        assert len(found) > 4 and max(found.values()) <= 2
        assert not list(tmp_path.glob("_changes/*"))
        assert told(*store.graph()) == told(*graph.build_road_graph(tracks(spark, range(4, 9)).unionByName(far)))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
