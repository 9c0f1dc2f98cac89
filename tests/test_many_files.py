"""Many small files: their work is dealt over tasks, whatever bytes they have, and the driver doesn't list them."""

import pytest
from pyspark.sql import functions as F

from geotrail.plans.catalog import QUERIES
from geotrail.sources import binary
from geotrail.sources.tables import list_files

SF = "/root/testdata/sf0.001"


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def maps(spark):
    return spark.range(100).groupBy("id").count().select(F.lit(8).alias("level"), F.col("id").alias("x"), F.lit(3).cast("long").alias("y"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.array(F.lit(1.0).cast("float")).alias("z"))


def test_height_maps_are_made_by_many_tasks(spark):
    assert tasks(binary.encode_dem_tiles(maps(spark))) > 2 * spark.sparkContext.defaultParallelism


def test_rows_of_files_are_made_by_many_tasks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(binary, "write_files", lambda files, home, f=binary.write_files: seen.append(tasks(files)) or f(files, home))
    assert QUERIES["s9_lerc_tiles"](spark, SF).count() > 100
    assert len(seen) == 1 and seen[0] > 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["s13_model_index", "s12_poi"])
def test_files_are_not_listed_by_the_driver(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "BinaryFile" not in plan and "Format: Parquet" in plan, plan


def test_patterns_and_single_files_are_read(spark, tmp_path):
    assert binary.write_dem_tiles(maps(spark), str(tmp_path)) == 100
    one = next(str(p) for p in tmp_path.rglob("*.dem"))
    assert list_files(spark, one).count() == 1 == binary.read_dem_tiles(spark, one).count()
    assert binary.read_dem_tiles(spark, f"{tmp_path}/8/*").count() == 100 == binary.read_dem_tiles(spark, f"file://{tmp_path}").count()
    assert binary._files(spark, str(tmp_path), ".de").count() == 0 and binary._files(spark, str(tmp_path), ".d*").count() == 100
