"""Ragged and sparse tiles, evolution in place, composed stencils, digests, refinement, intervals, and stored files."""

import glob
import json
import os
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.operators import compare, evolve, grid, intervals, kernels, runs, stencil
from gridloom.sources import io

CELLS = "run_id string, t int, v int, i int, j int, value double"


def cells_of(spark, u, run="r"):
    return spark.createDataFrame([(run, 0, v, i, j, float(u[v, i, j])) for v, i, j in np.argwhere(~np.isnan(u)).tolist()], CELLS)


def array_of(cells, shape):
    u = np.full(shape, np.nan)
    for r in cells.collect():
        u[r["v"], r["i"], r["j"]] = r["value"]
    return u


def diffused(u, steps):
    for _ in range(steps):
        u = u * 0.5 + (((np.roll(u, 1, 1) * 0.125 + np.roll(u, -1, 1) * 0.125) + np.roll(u, 1, 2) * 0.125) + np.roll(u, -1, 2) * 0.125)
    return u


@pytest.mark.parametrize("nx, ny, bs, k, variables, holes", [(12, 12, 4, 2, 1, 0), (13, 9, 4, 4, 2, 0), (7, 10, 16, 2, 1, 2), (13, 10, 5, 2, 1, 1)])
def test_ragged_and_sparse_tiles(spark, nx, ny, bs, k, variables, holes):
    rng = np.random.default_rng(nx)
    u = rng.integers(0, 64, (variables, nx, ny)).astype(float)
    for _ in range(holes):
        u[0, rng.integers(nx), rng.integers(ny)] = np.nan
    tiles = grid.to_tiles(cells_of(spark, u), nx, ny, bs, variables)
    assert np.array_equal(array_of(grid.to_cells(tiles, bs), u.shape), u, equal_nan=True)
    assert all(r["ni"] == min(bs, nx - r["bi"] * bs) and len(r["data"]) == variables * r["ni"] * r["nj"] for r in tiles.collect())
    want = diffused(u, 5)
    for out in (evolve.evolve(tiles, nx, ny, bs, kernels.DIFFUSE, 5, k), evolve.evolve_in_place(tiles, nx, ny, bs, kernels.DIFFUSE, 5, k, buckets=3)):
        assert np.array_equal(array_of(grid.to_cells(out, bs), u.shape), want, equal_nan=True)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gridloom_state")]


def test_exchanged_parts_are_the_halo(spark):
    u = np.arange(13 * 9.0).reshape(1, 13, 9)
    wide = np.pad(u, ((0, 0), (4, 4), (4, 4)), mode="wrap")
    for bi in range(4):
        for bj in range(3):
            got = np.full((1, min(4, 13 - 4 * bi) + 8, min(4, 9 - 4 * bj) + 8), np.nan)
            for r in evolve.exchange(grid.to_tiles(cells_of(spark, u), 13, 9, 4), 13, 9, 4, 4).filter(f"bi = {bi} AND bj = {bj}").collect() if (bi, bj) in ((0, 0), (3, 2), (2, 1)) else ():
                place = got[:, r["x"] : r["x"] + r["dx"], r["y"] : r["y"] + r["dy"]]
                assert np.isnan(place).all()  # each cell comes once
                place[:] = np.reshape(r["data"], place.shape)
            if (bi, bj) in ((0, 0), (3, 2), (2, 1)):
                assert (got == wide[:, 4 * bi : 4 * bi + got.shape[1], 4 * bj : 4 * bj + got.shape[2]]).all()


def test_cells_that_are_wrong(spark):
    twice = spark.createDataFrame([("r", 0, 0, 1, 1, 2.0), ("r", 0, 0, 1, 1, 2.0), ("r", 0, 0, 0, 0, 1.0)], CELLS)
    outside = spark.createDataFrame([("r", 0, 0, 7, 1, 2.0)], CELLS)
    for cells in (twice, outside, outside.withColumn("i", F.lit(0)).withColumn("v", F.lit(1))):
        with pytest.raises(Exception, match="stands twice|no such cell"):
            grid.to_tiles(cells, 6, 6, 4).collect()
    alone = spark.createDataFrame([("r", 0, 0, 0, 1, 5.0), ("r", 0, 0, 2, 2, None)], CELLS)
    tile = grid.to_tiles(alone, 6, 6, 4).collect()
    assert len(tile) == 1 and tile[0]["data"] == [None, 5.0] + [None] * 14
    assert [tuple(r) for r in grid.to_cells(grid.to_tiles(alone, 6, 6, 4), 4).collect()] == [("r", 0, 0, 0, 1, 5.0)]


def test_bodies_stay_in_place(spark):
    """A round in place exchanges strips alone."""
    u = np.random.default_rng(1).random((1, 64, 64))
    packed = grid.to_tiles(cells_of(spark, u), 64, 64, 16).mapInArrow(evolve._packed(1), evolve.STATE)
    packed.repartition(4, *evolve.KEY).write.format("parquet").bucketBy(4, *evolve.KEY).saveAsTable("bodies_stay")
    try:
        out = evolve.advance_in_place(spark.table("bodies_stay"), 64, 64, 16, kernels.DIFFUSE, 1, 1)
        plan = out._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange" in line]
        assert len(exchanges) == 1 and "body" not in exchanges[0] and "Bucketed: true" in plan
        strips = evolve.strips(spark.table("bodies_stay"), 64, 64, 16, 1, 1)
        assert strips.agg(F.sum(F.length("data"))).first()[0] == 16 * (4 * 16 + 4) * 8  # of 16 * 256 * 8
        assert "body" not in strips._jdf.queryExecution().executedPlan().toString()
        got = array_of(grid.to_cells(evolve._unpack(out.drop("edges")), 16), u.shape)
        assert np.allclose(got, diffused(u, 1), rtol=0, atol=1e-15)
    finally:
        spark.sql("DROP TABLE bodies_stay")


@pytest.mark.parametrize("spec, steps", [(stencil.diffuse(0.125), 4), (stencil.mean4(), 3), (stencil.StencilSpec([(2, 1, 0.5), (-1, 0, -0.25)], 0.5), 2)])
def test_composed_stencils(spark, spec, steps):
    u = np.random.default_rng(2).integers(0, 64, (1, 7, 9)).astype(float)
    cells = cells_of(spark, u)
    one = stencil.iterate(cells, steps, lambda c: stencil.stencil_linear(c, spec, 7, 9))
    made = stencil.stencil_steps(cells, spec, 7, 9, steps)
    assert (array_of(made, u.shape) == array_of(one, u.shape)).all() and made.first()["t"] == steps
    fresh = stencil.stencil_steps(cells, spec, 7, 9, steps)
    assert fresh._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    lacking = cells.filter("i <> 3 OR j <> 4")
    holes = lambda df: {(r["i"], r["j"]) for r in df.filter("value IS NULL").collect()}
    assert holes(stencil.stencil_steps(lacking, spec, 7, 9, steps)) == holes(stencil.iterate(lacking, steps, lambda c: stencil.stencil_linear(c, spec, 7, 9)))
    assert spec.power(1) is spec and len(stencil.mean4().power(2).table) == 9


def test_lacking_cells_differ(spark):
    cells = cells_of(spark, np.ones((1, 4, 4)))
    fewer = cells.filter("i > 0")
    r = compare.frame_diff(cells, fewer).first()
    assert r["differs"] and r["lacking"] == 4 and r["max_error"] == 0.0
    r = compare.frame_diff(cells, fewer.filter("i > 9")).first()
    assert r["differs"] and r["lacking"] == 16 and r["max_error"] is None
    assert not compare.frame_diff(cells, cells).first()["differs"]
    assert compare.frame_diff(cells, cells.withColumn("value", F.lit(float("nan")))).first()["differs"]
    assert compare.error_summary(compare.compare_fields(cells, fewer)).first()["lacking"] == 4


def test_digests_find_what_the_join_finds(spark):
    rng = np.random.default_rng(4)
    u = rng.random((2, 40, 40))
    a = cells_of(spark, u)
    w = u.copy()
    w[0, 3, 5], w[1, 39, 39], w[0, 20, 20] = 7.0, -1.0, np.nan
    b = cells_of(spark, w)
    want = {(r["v"], r["i"], r["j"]) for r in compare.compare_fields(a, b).filter("NOT a <=> b").collect()}
    assert {(r["v"], r["i"], r["j"]) for r in compare.differing_cells(a, b, 8).collect()} == want == {(0, 3, 5), (1, 39, 39), (0, 20, 20)}
    assert compare.differing_tiles(a, b, 8).count() == 3
    # the order of rows, and of sums, doesn't matter
    assert compare.differing_tiles(a, a.orderBy(F.rand(3)).repartition(7), 8).count() == 0
    assert compare.frame_digests(a).collect() == compare.frame_digests(a.repartition(5)).collect() != compare.frame_digests(b).collect()
    swapped = a.withColumn("value", F.when(F.col("i") == 1, 0.0).otherwise(F.col("value")))
    assert compare.differing_tiles(swapped, swapped.withColumn("value", F.when(F.col("i") == 1, -0.0).otherwise(F.col("value"))), 8).count() == 0


def test_heat_orders_with_and_without_a_closed_form(spark):
    grids, errors = [], []
    for n in (16, 32, 64):
        x = np.arange(n) / n
        u = (np.sin(2 * np.pi * x)[:, None] * np.sin(2 * np.pi * x)[None])[None]
        steps, dt = n * n // 64, 0.125 / n**2
        out = grid.to_cells(evolve.evolve(grid.to_tiles(cells_of(spark, u), n, n, 16), n, n, 16, kernels.DIFFUSE, steps, min(steps, 8)), 16).withColumn("t", F.lit(1))
        got = array_of(out, u.shape)
        grids.append(spark.createDataFrame([("r", 1, 0, i, j, float(got[0, i, j])) for i in range(n) for j in range(n)], CELLS))
        errors.append(("heat", dt, float(np.abs(got - u * np.exp(-8 * np.pi**2 * dt * steps)).max())))
    closed = compare.convergence_order(spark.createDataFrame(errors, "series string, dt double, max_error double")).first()["order"]
    assert 0.9 < closed < 1.1  # in dt, and so two in the width of a cell
    assert 1.8 < compare.observed_order(*grids).first()["order"] < 2.2
    assert compare.observed_order(grids[0], compare.restrict(grids[1], 1), grids[1].limit(0)).first()["order"] is None


def test_restriction(spark):
    u = np.arange(36.0).reshape(1, 6, 6)
    cells = cells_of(spark, u)
    assert (array_of(compare.restrict(cells, 3), (1, 2, 2)) == u.reshape(1, 2, 3, 2, 3).mean((2, 4))).all()
    assert (array_of(compare.restrict(cells, 2, "inject"), (1, 3, 3)) == u[:, ::2, ::2]).all()
    assert compare.restrict(cells.filter("i <> 1 OR j <> 1"), 3).count() == 3


@pytest.mark.parametrize("closed", ["neither", "left", "right", "both"])
@pytest.mark.parametrize("salt", [20, 10**6])
def test_intervals_by_brute_force(spark, closed, salt):
    rng = random.Random(6)
    ends = [None, None, float("inf"), -5.0, 0.0, 1.0, 2.0, 2.5, 7.0, 50.0]
    bounds = [(k, rng.choice(["a", "b", None]), rng.choice(ends), rng.choice(ends)) for k in range(30)]
    points = [(k, rng.choice(["a", "a", "a", "b", None, "c"]), rng.choice([*ends, float("nan"), -float("inf"), rng.uniform(-9, 60), 2.0, 2.0])) for k in range(400)]
    out = intervals.classify_intervals(spark.createDataFrame(points, "p int, run_id string, x double"), spark.createDataFrame(bounds, "region int, run_id string, low double, high double"), keys=("run_id",), closed=closed, bins=16, rows_a_salt=salt)
    got = sorted((r["p"], -1 if r["region"] is None else r["region"]) for r in out.collect())
    want = []
    for p, key, x in points:
        inside = []
        for region, other, low, high in bounds:
            lower = low is None or (x is not None and (x >= low if closed in ("left", "both") else x > low))
            upper = high is None or (x is not None and (x <= high if closed in ("right", "both") else x < high))
            if key == other and x is not None and x == x and lower and upper and (low is None or high is None or low <= high):
                inside.append(region)
        want += [(p, r) for r in inside or [-1]]
    assert got == sorted(want)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_box_reads_few_row_groups(spark, tmp_path):
    n = 512
    cells = spark.range(n * n).selectExpr("'r' AS run_id", "0 AS t", "0 AS v", f"CAST(id div {n} AS int) AS i", f"CAST(id % {n} AS int) AS j", "CAST(id AS double) AS value")
    io.write_frames(cells, spark.createDataFrame([("r", 8)], "run_id string, blocksize int"), str(tmp_path / "o"), files=64)
    groups = []
    for f in glob.glob(str(tmp_path / "o/frames/run_id=r/*.parquet")):
        meta = pq.ParquetFile(f).metadata
        at = {meta.row_group(0).column(c).path_in_schema: c for c in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            groups.append([(meta.row_group(g).column(at[c]).statistics.min, meta.row_group(g).column(at[c]).statistics.max) for c in ("i", "j")])
    low, high = 130, 180  # a box of 1 % of the cells, within neither half
    read = [g for g in groups if all(a <= high and b >= low for a, b in g)]
    assert len(groups) >= 60 and len(read) <= 0.05 * len(groups) + 1
    frames, _ = io.read_frames(spark, str(tmp_path / "o"))
    box = grid.slice_cells(frames, i=(low, high), j=(low, high))
    assert box.count() == 51 * 51 and "PushedFilters: [IsNotNull(i), IsNotNull(j), GreaterThanOrEqual(i,130)" in box._jdf.queryExecution().executedPlan().toString()


def test_a_large_yaml_file_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    records, text = {}, ["# a log", "---"]
    for k in range(3000):
        key = f"01/02/2020-03:04:05.{k}"
        records[key] = (k / 4, rng.choice([None, [k, 1, 2]]), rng.choice(["a: b", "plain", "- x"]))
        runtime, shape, cpu = records[key]
        text.append(rng.choice([f"{key}:", f"'{key}':", f'"{key}":']))
        text += rng.sample([f"  runtime: {runtime}", f"  cpu: '{cpu}'"] + (["  array_shape:\n  - %d\n  - %d\n  - %d" % tuple(shape)] if shape else []), 3 if shape else 2)
        if rng.random() < 0.1:
            text += rng.choice([["# note"], [""], ["  # indented"], ["  verbose: true"]])
    (tmp_path / "large.yaml").write_text("\n".join(text) + "\n")
    (tmp_path / "braces.yaml").write_text('{"x": {runtime: 1.0},\n "y": {runtime: 2.0}}\n')
    (tmp_path / "empty.yaml").write_text("")
    paths = [str(tmp_path / f) for f in ("large.yaml", "braces.yaml", "empty.yaml")]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("3000", "200", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            log = io.read_run_logs(spark, paths, "yaml")
            if size == "3000":
                assert spark.read.text(paths[0]).rdd.getNumPartitions() > 30
            got = {r["key"]: (r["runtime"], r["array_shape"], r["cpu"]) for r in log.collect()}
            assert len(got) == 3002 and got.pop("x")[0] == 1.0 and got.pop("y")[0] == 2.0
            assert got == records
            if size == "3000":
                assert log.filter("file LIKE '%large.yaml'").count() == 3000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_merge_touches_few_files(spark, tmp_path):
    path = str(tmp_path / "log")
    io.write_log(spark.createDataFrame([(f"k{k}", float(k)) for k in range(200)], "key string, runtime double"), path, 16)
    state = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(path + "/part=*/*.parquet")}
    before, new = state(), spark.createDataFrame([("k7", -1.0), ("new", 5.0)], "key string, runtime double")
    assert io.merge_log(spark, path, new, 16) <= 2
    after = state()
    same = {f for f in before if after.get(f) == before[f]}
    assert len(same) >= len(before) - 2 and len(after) - len(same) <= 2
    want = sorted([(f"k{k}", -1.0 if k == 7 else float(k)) for k in range(200)] + [("new", 5.0)])
    rows = lambda: sorted((r["key"], r["runtime"]) for r in io.read_log(spark, path).collect())
    assert rows() == want
    io.merge_log(spark, path, new, 16)
    assert rows() == want and io.merge_log(spark, path, new.limit(0), 16) == 0


def test_null_keys_of_hardware_meet(spark):
    a = spark.createDataFrame([(1, None, 4.0), (None, 2, 6.0), (3, 3, 1.0)], "x int, y int, m double")
    got = runs.pair_hardware(a, a.withColumn("m", F.col("m") / 2).filter("m > 1"), ["x", "y"], "m").collect()
    assert sorted((str(r["x"]), str(r["y"]), r["ratio"]) for r in got) == [("1", "None", 2.0), ("None", "2", 2.0)]


def test_splits_use_few_tasks_for_few_rows(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(100)], "g int, k int")
    out = runs.split_balanced(df, 4, ["g"], ["k"])
    assert sorted(r["count"] for r in out.groupBy("g", "chunk").count().collect()) == [8] * 8 + [9] * 4
    many = runs.split_balanced(df, 4, ["g"], ["k"], parts=9)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, many.collect()))


def test_json_log_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"key": str(k), "runtime": k * 1.0}) for k in range(5)))
    assert io.read_run_logs(spark, [str(tmp_path / "a.json")]).count() == 5
