"""ASCII grids, rasters and streams."""

import pytest
from pyspark.sql import functions as F

from landweave.operators import raster
from landweave.sources import ascgrid
from landweave.streaming.rasters import run_on_rasters, windowed_raster

TEXT = "ncols 3\nnrows 2\nxllcorner 10.5\nyllcorner 20\ncellsize 100\nNODATA_value -9999\n1 2.5 -9999\n4 -9999 6e-3\n"


def test_read_and_write(spark, tmp_path):
    path = tmp_path / "a.asc"
    path.write_text(TEXT)
    r, meta = ascgrid.read_ascgrid(spark, str(path))
    rows = {tuple(x) for x in r.collect()}
    assert rows == {(1, 1, 1.0), (1, 2, 2.5), (2, 1, 4.0), (2, 3, 0.006)}
    assert meta == ascgrid.RasterMeta(3, 2, 10.5, 20.0, 100.0, -9999)
    ascgrid.write_ascgrid(r, str(tmp_path / "out"), meta)
    back, again = ascgrid.read_ascgrid(spark, str(tmp_path / "out"))
    assert {tuple(x) for x in back.collect()} == rows and again == meta
    ascgrid.register(spark)
    assert {tuple(x) for x in spark.read.format("ascgrid").load(str(path)).collect()} == rows
    with pytest.raises(ValueError, match="cellsize"):
        ascgrid.ascgrid_lines(r, ascgrid.RasterMeta(3, 2))
    (tmp_path / "b.asc").write_text(TEXT.replace("nrows 2", "nrows 3"))
    with pytest.raises(ValueError, match="rows"):
        ascgrid.read_ascgrid(spark, str(tmp_path / "b.asc"))
    (tmp_path / "c.asc").write_text(TEXT.replace("ncols 3", "ncols 4"))
    with pytest.raises(ValueError, match="columns"):
        ascgrid.read_ascgrid(spark, str(tmp_path / "c.asc"))


def test_wall_geometry():
    columns, rows = raster.wall_cells(30, 60, corridor_widths=(3, 2))
    assert list(columns) == [30, 31, 32] and [(r.start, r.stop - 1) for r in rows] == [(1, 8), (12, 20), (23, 30)]


def test_coarse_graining(spark):
    q = raster.cells(spark, 30, 60).select("row", "col", (1800 - ((F.col("row") - 1) * 60 + (F.col("col") - 1))).cast("double").alias("value"))
    found = {(r.row, r.col): r.value for r in raster.coarse_graining(q, 30, 60, 3).collect()}
    assert found[2, 2] == 15651 and found[2, 5] == 15624 and found[5, 2] == 14031 and found[5, 5] == 14004 and len(found) == 200
    assert raster.neighborhood_sum(q, 2, 2, 3).first()[0] == 15651
    assert raster.coarse_graining(q, 30, 60, 1).count() == 1800


def test_reconcile(spark):
    a = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4)], "row int, col int, value double")
    b = spark.createDataFrame([(1, 2, 3.0), (2, 2, 4.0)], "row int, col int, value double")
    assert {tuple(x) for x in raster.reconcile(a, b).collect()} == {(1, 1, 0.5, 1e-20), (1, 2, 0.4, 3.0), (2, 2, 1e-20, 4.0)}
    assert {tuple(x) for x in raster.reconcile(a, b, both=False).collect()} == {(1, 1, 0.5, 1e-20), (1, 2, 0.4, 3.0), (2, 2, None, 4.0)}


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", 1, 2), ("2024-01-01 00:00:20", 1, 2), ("2024-01-01 00:01:10", 2, 2), ("2024-01-01 00:30:00", 1, 1)]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "ts string, r int, c int").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("ts timestamp, r int, c int").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counted = windowed_raster(stream, "ts", F.col("r"), F.col("c"), "1 minute", "1 minute")
    q = run_on_rasters(counted, lambda b: b.withColumn("value", F.col("value") * 2), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert {(r.row, r.col, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 2, 4.0), (2, 2, 2.0)}
