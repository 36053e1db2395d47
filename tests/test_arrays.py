"""Grids in array files: hyperslabs by filters, and frames that are whole or not there."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import evolve, grid, kernels
from gridloom.sources import arrays


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    arrays.register(spark)
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_hyperslabs(spark, tmp_path):
    rng = np.random.default_rng(1)
    made = {"a": rng.random((3, 2, 20, 7)), "b": rng.integers(0, 9, (1, 9, 4)).astype(np.int32)}
    for name, u in made.items():
        np.save(tmp_path / f"{name}.npy", u)
    cells = spark.read.format("grid_arrays").option("path", str(tmp_path)).option("slab_bytes", 7 * 8 * 6).load()
    want = sorted([("a", t, v, i, j, float(made["a"][t, v, i, j])) for t, v, i, j in np.ndindex(3, 2, 20, 7)] + [("b", 0, v, i, j, float(made["b"][v, i, j])) for v, i, j in np.ndindex(1, 9, 4)], key=str)
    assert rows(cells) == want
    for condition, keep in (
        ("t = 2 AND i < 5", lambda r: r[1] == 2 and r[3] < 5), ("i >= 3 AND i <= 12 AND v = 1 AND j = 2", lambda r: 3 <= r[3] <= 12 and r[2] == 1 and r[4] == 2),
        ("run_id = 'b' AND i > 6", lambda r: r[0] == "b" and r[3] > 6), ("i IN (1, 2, 9, 77) AND t IN (0, 2)", lambda r: r[3] in (1, 2, 9) and r[1] in (0, 2)), ("t > 7", lambda r: False),
        ("run_id > 'a'", lambda r: r[0] > "a"), ("value > 0.5 OR t = 1", lambda r: r[5] > 0.5 or r[1] == 1),
    ):
        assert rows(cells.filter(condition)) == [r for r in want if keep(r)]
    reader = arrays.ArrayReader({"path": str(tmp_path), "slab_bytes": str(7 * 8 * 6)})
    assert len(reader.partitions()) == 3 * 2 * 4 + 1
    list(reader.pushFilters([arrays.ds.EqualTo(("t",), 1), arrays.ds.LessThan(("i",), 6), arrays.ds.EqualTo(("run_id",), "a")]))
    assert [(p.t, p.v, p.begin, p.end) for p in reader.partitions()] == [(1, 0, 0, 6), (1, 1, 0, 6)]
    np.save(tmp_path / "c.npy", np.asfortranarray(np.ones((2, 3, 4))))
    with pytest.raises(Exception, match="C-ordered"):
        spark.read.format("grid_arrays").option("path", str(tmp_path)).load().collect()


def tiles_of(spark, u, run="r"):
    n = u.shape[1]
    return grid.to_tiles(spark.createDataFrame([(run, 0, 0, i, j, float(u[0, i, j])) for i in range(n) for j in range(n)], "run_id string, t int, v int, i int, j int, value double"), n, n, 4)


def test_frames_are_written_whole_and_once(spark, tmp_path):
    path = str(tmp_path / "out")
    tiles = tiles_of(spark, np.arange(100.0).reshape(1, 10, 10)).unionByName(tiles_of(spark, np.ones((1, 10, 10)), "a/b é"))
    frames = evolve.evolve(tiles, 10, 10, 4, kernels.ADD, 4, 1, save_every_round=True).select("run_id", "t", "bi", "bj", "ni", "nj", "data")
    save = lambda df, mode="append": df.write.format("grid_frames").option("path", path).mode(mode).save()
    load = lambda: spark.read.format("grid_frames").option("path", path).load()
    files = lambda: set(glob.glob(f"{path}/data/*"))
    save(frames)
    assert rows(load()) == rows(frames) and rows(load().filter("t = 2 AND run_id = 'r'")) == rows(frames.filter("t = 2 AND run_id = 'r'"))
    reader = arrays.FrameReader({"path": path})
    list(reader.pushFilters([arrays.ds.EqualTo(("t",), 2), arrays.ds.EqualTo(("run_id",), "a/b é")]))
    assert reader.partitions() and {(p.run_id, p.t) for p in reader.partitions()} == {("a/b é", 2)}
    # a job that fails changes nothing and leaves no file
    before = files()
    bad = frames.filter("t = 3").withColumn("ni", F.when(F.col("bi") == 2, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("ni")))
    with pytest.raises(Exception, match="lost"):
        save(bad.repartition(6))
    assert rows(load()) == rows(frames) and files() == before
    # a frame that is written again replaces itself, others stay
    save(frames.filter("t = 3"))
    assert rows(load()) == rows(frames) and len(files() & before) < len(before)
    changed = frames.filter("t = 3 AND run_id = 'r'").withColumn("data", F.transform("data", lambda x: -x))
    save(changed)
    assert rows(load()) == rows(frames.filter("t <> 3 OR run_id <> 'r'").unionByName(changed))
    listed = {n for _, _, p in arrays._lists(*arrays._opened(path)) for n in eval(open(p).read())}
    assert {os.path.basename(f) for f in files()} == listed
    save(frames.filter("t = 0"), "overwrite")
    assert rows(load()) == rows(frames.filter("t = 0")) and rows(load().filter("t = 1")) == []


def test_half_written_frames_are_not_seen(spark, tmp_path):
    """A job that died between its files and its lists."""
    path, tiles = str(tmp_path / "out"), tiles_of(spark, np.ones((1, 8, 8)))
    tiles.write.format("grid_frames").option("path", path).mode("append").save()
    writer = arrays.FrameWriter({"path": path}, False)
    batch = tiles.withColumn("t", F.lit(1)).toArrow().to_batches()
    written = writer.write(iter(batch))
    assert written.files and spark.read.format("grid_frames").option("path", path).load().filter("t = 1").count() == 0
    writer.commit([written, None])
    assert spark.read.format("grid_frames").option("path", path).load().filter("t = 1").count() == 4
    with pytest.raises(ValueError):
        writer.write(iter(tiles.withColumn("run_id", F.lit(None).cast("string")).toArrow().to_batches()))


def test_no_frames(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert spark.read.format("grid_frames").option("path", str(tmp_path / "none")).load().count() == 0
    assert spark.read.format("grid_arrays").option("path", str(tmp_path / "none")).load().count() == 0
