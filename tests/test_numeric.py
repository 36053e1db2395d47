"""Stencils, evolution and comparison against plain NumPy, and their invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import fields
from gridloom.operators import compare, evolve, grid, kernels, stencil

N = 12


def cells_of(spark, u, run="r"):
    rows = [(run, 0, v, i, j, float(u[v, i, j])) for v in range(u.shape[0]) for i in range(u.shape[1]) for j in range(u.shape[2])]
    return spark.createDataFrame(rows, "run_id string, t int, v int, i int, j int, value double")


def array_of(cells, shape):
    u = np.full(shape, np.nan)
    for r in cells.collect():
        u[r["v"], r["i"], r["j"]] = r["value"]
    return u


def roll_diffuse(u, c):
    return u * (1 - 4 * c) + c * (np.roll(u, 1, 1) + np.roll(u, -1, 1) + np.roll(u, 1, 2) + np.roll(u, -1, 2))


@pytest.fixture(scope="module")
def field():
    return np.random.default_rng(3).integers(0, 64, (1, N, N)).astype(float)


def test_stencil_is_roll(spark, field):
    got = array_of(stencil.stencil_linear(cells_of(spark, field), stencil.diffuse(0.125), N, N), field.shape)
    assert np.allclose(got, roll_diffuse(field, 0.125), rtol=0, atol=1e-12)


def test_mean4_swaps_a_checkerboard(spark):
    board = np.indices((N, N)).sum(0)[None] % 2.0
    once = stencil.stencil_linear(cells_of(spark, board), stencil.mean4(), N, N)
    assert (array_of(once, board.shape) == 1 - board).all()
    assert (array_of(stencil.stencil_linear(once, stencil.mean4(), N, N), board.shape) == board).all()


@pytest.mark.parametrize("kernel", [kernels.DIFFUSE, kernels.DIFFUSE2, kernels.DIFFUSE100, kernels.ADD2])
@pytest.mark.parametrize("bs", [4, 6, 12])
def test_k_does_not_matter(spark, field, kernel, bs):
    tiles = grid.to_tiles(cells_of(spark, field), N, N, bs)
    want = None
    for k in (1, 2, 3, 4):
        if k * kernel.radius * kernel.stages > bs:
            with pytest.raises(ValueError):
                evolve.evolve(tiles, N, N, bs, kernel, 3 if k <= 3 else 4, k).count()
            continue
        got = array_of(grid.to_cells(evolve.evolve(tiles, N, N, bs, kernel, 3, k), bs), field.shape)
        assert want is None or (got == want).all()
        want = got


def test_two_stage_is_plain_loop(spark, field):
    u, c = field.copy(), 0.125
    for _ in range(2):
        half = u + 0.5 * (roll_diffuse(u, c) - u)
        u = u + roll_diffuse(half, c) - half
    got = stencil.iterate(cells_of(spark, field), 2, lambda x: stencil.two_stage_step(x, stencil.diffuse_rate(c), N, N), cut_every=1)
    assert np.allclose(array_of(got, u.shape), u, rtol=9e-15, atol=9e-15 * 64)
    assert math.isclose(array_of(got, u.shape).sum(), field.sum(), rel_tol=1e-12)


def gas(seed=5, n=8):
    r = np.random.default_rng(seed)
    return np.stack([1 + r.random((n, n)), 0.3 * r.random((n, n)), 0.3 * r.random((n, n)), 4 + r.random((n, n))])


def test_euler_helper_is_the_column_form(spark):
    u = gas()
    rows = [("r", 0, i, j, *map(float, u[:, i, j])) for i in range(8) for j in range(8)]
    wide = spark.createDataFrame(rows, "run_id string, t int, i int, j int, q0 double, q1 double, q2 double, q3 double")
    padded = np.pad(u, ((0, 0), (2, 2), (2, 2)), mode="wrap")
    x, y = kernels.euler_divergence(padded, 1, 1.4), kernels.euler_divergence(padded, 2, 1.4)
    for r in stencil.flux_residual(wide, 8, 8).collect():
        assert np.allclose([r[f"x{k}"] for k in range(4)], x[:, r["i"], r["j"]], rtol=1e-12, atol=1e-13)
        assert np.allclose([r[f"y{k}"] for k in range(4)], y[:, r["i"], r["j"]], rtol=1e-12, atol=1e-13)


def test_uniform_gas_stays(spark):
    u = np.broadcast_to(np.array([1.0, 0.2, 0.1, 2.5])[:, None, None], (4, 8, 8)).copy()
    out = evolve.evolve(grid.to_tiles(cells_of(spark, u), 8, 8, 8, 4), 8, 8, 8, kernels.EULER2D, 2, 2, {"dtdx": 0.01})
    assert np.allclose(array_of(grid.to_cells(out, 8), u.shape), u, atol=1e-14)


def test_close_and_infinities(spark):
    inf, nan = float("inf"), float("nan")
    cases = [(1.0, 1.0, True), (nan, nan, False), (1.0, inf, False), (inf, inf, True), (inf, -inf, False), (1.0, 1.0 + 1e-6, True), (1.0, 1.1, False)]
    df = spark.createDataFrame([(a, b, w) for a, b, w in cases], "a double, b double, want boolean")
    assert df.filter(compare.close(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_heat_converges_with_order_one(spark):
    rows = []
    for n in (16, 32, 64):
        x = np.arange(n) / n
        u = np.sin(2 * np.pi * x)[:, None] * np.sin(2 * np.pi * x)[None]
        steps, dt = n * n // 64, 0.1 / n**2
        v = u[None]
        for _ in range(steps):
            v = roll_diffuse(v, 0.1)
        rows.append(("heat", dt, float(np.abs(v[0] - u * np.exp(-8 * np.pi**2 * dt * steps)).max())))
    order = compare.convergence_order(spark.createDataFrame(rows, "series string, dt double, max_error double")).first()["order"]
    assert 0.9 < order < 1.1


def test_shock_states():
    s = fields.shock_states()
    assert abs(s["p2"] - 0.30313) < 1e-4 and abs(s["u2"] - 0.92745) < 1e-4 and abs(s["shock"] - 1.75216) < 1e-4


def test_empty_grid(spark):
    none = cells_of(spark, np.zeros((0, 0, 0)))
    assert stencil.stencil_linear(none, stencil.mean4(), N, N).count() == 0
    assert evolve.evolve(grid.to_tiles(none, N, N, 4), N, N, 4, kernels.DIFFUSE, 2, 2).count() == 0
