"""Queries on the lineitem grid: layouts, borders, stencils, evolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import wrapped
from ..functions.session import table
from ..operators import evolve, grid, kernels, stencil

NX = NY = 20
BS = 5


def base(spark, sf_dir):
    """Cells of the lineitem grid: quantities by part and supplier, a run for each return flag."""
    c = F.col
    made = grid.rasterize(table(spark, sf_dir, "lineitem"), NX, NY, c("l_returnflag"), c("l_partkey"), c("l_suppkey"), {"value": c("l_quantity")})
    return grid.to_cell_layout(made, "value")


def gas(spark, sf_dir):
    """Four variables on the same grid, positive and with a moderate range."""
    c = F.col
    made = grid.rasterize(table(spark, sf_dir, "lineitem"), NX, NY, c("l_returnflag"), c("l_partkey"), c("l_suppkey"), {"a": c("l_quantity"), "b": c("l_linenumber").cast("double"), "c": F.lit(1.0)})
    rho = 1 + F.pmod("a", F.lit(64.0)) / 64
    return made.select("run_id", F.lit(0).alias("t"), "i", "j", rho.alias("q0"), (F.pmod("b", F.lit(32.0)) / 64).alias("q1"), (F.pmod("c", F.lit(16.0)) / 64).alias("q2"), (4 + F.pmod("a", F.lit(32.0)) / 16).alias("q3"))


RASTER = f"""
sums AS (SELECT l_returnflag AS run_id, (l_partkey % {NX})::INT AS i, (l_suppkey % {NY})::INT AS j, sum(l_quantity) AS value FROM lineitem GROUP BY ALL),
cells0 AS (
  SELECT r.run_id, a.i::INT AS i, b.j::INT AS j, coalesce(s.value, 0.0) AS value
  FROM (SELECT DISTINCT run_id FROM sums) r, range({NX}) a(i), range({NY}) b(j) LEFT JOIN sums s ON s.run_id = r.run_id AND s.i = a.i AND s.j = b.j)"""
TAGS = "run_id, {t}::INT AS t, 0::INT AS v, i, j, value"


def _step_sql(source: str, target: str, expression: str, extra: str = "") -> str:
    """A CTE with the four periodic neighbours as w, e, s, n and the cell as c."""
    near = lambda name, di, dj: f"JOIN {source} {name} ON {name}.run_id = c.run_id AND {name}.i = (c.i + {di} + {NX}) % {NX} AND {name}.j = (c.j + {dj} + {NY}) % {NY}"
    return f"""{target} AS (SELECT c.run_id, c.i, c.j, {expression} AS value{extra} FROM {source} c
  {near("w", -1, 0)} {near("e", 1, 0)} {near("s", 0, -1)} {near("n", 0, 1)})"""


MEAN = "w.value * 0.25 + e.value * 0.25 + s.value * 0.25 + n.value * 0.25"
DIFF = "c.value * 0.5 + (w.value * 0.125 + e.value * 0.125 + s.value * 0.125 + n.value * 0.125)"
RATE = "c.value * -0.5 + (w.value * 0.125 + e.value * 0.125 + s.value * 0.125 + n.value * 0.125)"


def steps_sql(expression: str, n: int) -> str:
    ctes = [RASTER, *(_step_sql(f"cells{k}", f"cells{k + 1}", expression) for k in range(n))]
    return f"WITH {', '.join(ctes)} SELECT {TAGS.format(t=n)} FROM cells{n}"


def two_stage_sql(n: int) -> str:
    ctes = [RASTER]
    for k in range(n):
        ctes += [_step_sql(f"cells{k}", f"half{k}", f"c.value + 0.5 * ({RATE})", ", c.value AS u"), _step_sql(f"half{k}", f"cells{k + 1}", f"c.u + ({RATE})")]
    return f"WITH {', '.join(ctes)} SELECT {TAGS.format(t=n)} FROM cells{n}"


def _tiles(spark, sf_dir):
    return grid.to_tiles(base(spark, sf_dir), NX, NY, BS)


def _evolved(kernel, n, k):
    return lambda spark, sf_dir: grid.to_cells(evolve.evolve(_tiles(spark, sf_dir), NX, NY, BS, kernel, n, k), BS)


def _tile_table(spark, sf_dir):
    d = F.col("data")
    return _tiles(spark, sf_dir).select("run_id", "bi", "bj", F.size(d).alias("n"), F.aggregate(d, F.lit(0.0), lambda a, x: a + x).alias("total"), F.element_at(d, 1).alias("first"), F.element_at(d, -1).alias("last"))


def _evolve_frames(spark, sf_dir):
    """Frames after every round of 2 steps; 5 steps, so that the last round is shorter."""
    frames = evolve.evolve(_tiles(spark, sf_dir), NX, NY, BS, kernels.ADD, 5, 2, save_every_round=True)
    return grid.to_cells(frames, BS).groupBy("run_id", "t").agg(F.sum("value").alias("total"), F.max("value").alias("highest"))


def _euler_tiles(spark, sf_dir):
    long = gas(spark, sf_dir).select("run_id", "t", "i", "j", F.posexplode(F.array("q0", "q1", "q2", "q3")).alias("v", "value"))
    return grid.to_tiles(long, NX, NY, 10, 4)


def _euler_step(spark, sf_dir):
    out = grid.to_cells(evolve.evolve(_euler_tiles(spark, sf_dir), NX, NY, 10, kernels.EULER2D, 1, 1, {"dtdx": 0.01}), 10)
    return out.withColumn("value", F.round(F.col("value"), 6) + 0.0)


def _residual(spark, sf_dir):
    out = stencil.flux_residual(gas(spark, sf_dir), NX, NY)
    return out.select("run_id", "i", "j", *(F.round(c, 6).alias(c) for c in ("x0", "x1", "x2", "x3", "y0", "y1", "y2", "y3")))


def _gas_sql() -> str:
    return f"""
sums AS (SELECT l_returnflag AS run_id, (l_partkey % {NX})::INT AS i, (l_suppkey % {NY})::INT AS j, sum(l_quantity) AS a, sum(l_linenumber)::DOUBLE AS b, count(*)::DOUBLE AS c FROM lineitem GROUP BY ALL),
gas0 AS (
  SELECT r.run_id, p.i::INT AS i, q.j::INT AS j, 1 + (coalesce(a, 0.0) % 64.0) / 64 AS q0, (coalesce(b, 0.0) % 32.0) / 64 AS q1, (coalesce(c, 0.0) % 16.0) / 64 AS q2, 4 + (coalesce(a, 0.0) % 32.0) / 16 AS q3
  FROM (SELECT DISTINCT run_id FROM sums) r, range({NX}) p(i), range({NY}) q(j) LEFT JOIN sums s ON s.run_id = r.run_id AND s.i = p.i AND s.j = q.j)"""


def _divergence_sql(source: str, name: str, axis: int) -> list[str]:
    """CTEs that end in <name>(run_id, i, j, f0 .. f3): half of west minus east flux along an axis."""
    di, dj = (1, 0) if axis == 1 else (0, 1)
    p = "(0.4 * (q3 - (q1 * q1 + q2 * q2) / (2 * q0)))"
    joins = " ".join(f"JOIN {name}_p c{d + 2} ON c{d + 2}.run_id = c.run_id AND c{d + 2}.i = (c.i + {d * di} + {NX}) % {NX} AND c{d + 2}.j = (c.j + {d * dj} + {NY}) % {NY}" for d in (-2, -1, 0, 1, 2))
    lim = lambda num, den: f"(CASE WHEN {den} = 0 OR {num} / nullif({den}, 0) > 1e6 OR {num} / nullif({den}, 0) < 0 THEN 0.0 ELSE least({num} / nullif({den}, 0), 1.0) END / 2)"
    pr = lambda a, b: f"(c{a}.p - c{b}.p)"
    face = lambda out, a, b, num, den: ", ".join(f"c{a}.q{k} + {lim(num, den)} * (c{b}.q{k} - c{a}.q{k}) AS {out}{k}" for k in range(4))
    faces = ", ".join([face("wl", 1, 2, pr(2, 1), pr(1, 0)), face("wr", 2, 1, pr(2, 1), pr(3, 2)), face("el", 2, 3, pr(3, 2), pr(2, 1)), face("er", 3, 2, pr(3, 2), pr(4, 3))])
    press = lambda s: f"(0.4 * ({s}3 - ({s}1 * {s}1 + {s}2 * {s}2) / (2 * {s}0)))"
    other = 3 - axis

    def flux(side):
        l, r, m = f"{side}l", f"{side}r", axis
        pl, p_r = press(l), press(r)
        f = {0: f"{l}{m} + {r}{m}", m: f"{l}{m} * {l}{m} / {l}0 + {pl} + {r}{m} * {r}{m} / {r}0 + {p_r}", other: f"{l}1 * {l}2 / {l}0 + {r}1 * {r}2 / {r}0", 3: f"({l}3 + {pl}) * {l}{m} / {l}0 + ({r}3 + {p_r}) * {r}{m} / {r}0"}
        return ", ".join(f"{f[k]} AS {side}f{k}" for k in range(4))

    mean = lambda side, k: f"((sqrt({side}l0) * {side}l{k} / {side}l0 + sqrt({side}r0) * {side}r{k} / {side}r0) * (1 / (sqrt({side}l0) + sqrt({side}r0))))"
    means = ", ".join(f"{mean(s, k)} AS {s}m{k}" for s in "we" for k in (1, 2, 3))
    rho = lambda s: f"(sqrt({s}l0) * sqrt({s}r0))"
    inner = lambda s: f"(1.4 * (0.4 * ({rho(s)} * {s}m3 - ({rho(s)} * {s}m1 * {rho(s)} * {s}m1 + {rho(s)} * {s}m2 * {rho(s)} * {s}m2) / (2 * {rho(s)}))) / {rho(s)})"
    speed = lambda s: f"(CASE WHEN {inner(s)} < 0 THEN 0.0 ELSE sqrt({inner(s)}) + abs({s}m{axis}) END)"
    total = ", ".join(f"0.5 * (((wf{k} + {speed('w')} * (wl{k} - wr{k})) - ef{k}) - {speed('e')} * (el{k} - er{k})) AS f{k}" for k in range(4))
    return [
        f"{name}_p AS (SELECT *, {p} AS p FROM {source})",
        f"{name}_f AS (SELECT c.run_id, c.i, c.j, {faces} FROM {name}_p c {joins})",
        f"{name}_m AS (SELECT *, {flux('w')}, {flux('e')}, {means} FROM {name}_f)",
        f"{name} AS (SELECT run_id, i, j, {total} FROM {name}_m)",
    ]


def _residual_sql() -> str:
    ctes = [_gas_sql(), *_divergence_sql("gas0", "x", 1), *_divergence_sql("gas0", "y", 2)]
    return f"WITH {', '.join(ctes)} SELECT x.run_id, x.i, x.j, {', '.join(f'round(x.f{k}, 6) AS x{k}, round(y.f{k}, 6) AS y{k}' for k in range(4))} FROM x JOIN y USING (run_id, i, j)"


def _euler_sql() -> str:
    ctes = [_gas_sql(), *_divergence_sql("gas0", "x", 1), *_divergence_sql("gas0", "y", 2)]
    ctes.append(f"half AS (SELECT g.run_id, g.i, g.j, {', '.join(f'g.q{k} + 0.5 * (x.f{k} * 0.01 + y.f{k} * 0.01) AS q{k}' for k in range(4))} FROM gas0 g JOIN x USING (run_id, i, j) JOIN y USING (run_id, i, j))")
    ctes += [*_divergence_sql("half", "hx", 1), *_divergence_sql("half", "hy", 2)]
    parts = " UNION ALL ".join(f"SELECT g.run_id, 1::INT AS t, {k}::INT AS v, g.i, g.j, round(g.q{k} + (hx.f{k} * 0.01 + hy.f{k} * 0.01), 6) + 0.0 AS value FROM gas0 g JOIN hx USING (run_id, i, j) JOIN hy USING (run_id, i, j)" for k in range(4))
    return f"WITH {', '.join(ctes)} {parts}"


def _line(spark, sf_dir):
    """Events by day and type: the daily counts' second difference."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").cast("double").alias("value"))
    plain = stencil.line_stencil(days, [1.0, -2.0, 1.0], ["event_type"], "day").withColumnRenamed("result", "open")
    return stencil.line_stencil(plain, [1.0, -2.0, 1.0], ["event_type"], "day", wrap=True).withColumnRenamed("result", "wrapped")


def _array_tile(spark, sf_dir):
    """Embeddings as 8 x 8 tiles: the mean of the four periodic neighbours, as 1/4 weights."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    k = F.sequence(F.lit(0), F.lit(63))
    df = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))
    row, col = lambda x: F.floor(x / 8), lambda x: x % 8
    at = lambda x, a, b: wrapped(F.col("e"), (F.pmod(row(x) + a, F.lit(8)) * 8 + F.pmod(col(x) + b, F.lit(8))))
    out = df.withColumn("m", F.transform(k, lambda x: at(x, -1, 0) * 0.25 + at(x, 1, 0) * 0.25 + at(x, 0, -1) * 0.25 + at(x, 0, 1) * 0.25))
    return out.select("vec_id", F.posexplode("m").alias("k", "value"))


def _gas_line(spark, sf_dir):
    """One-dimensional gas lines: column j of the grid is a line along i."""
    lines = gas(spark, sf_dir).select("run_id", "j", "i", "q0", "q1", F.col("q3").alias("q2"))
    out = stencil.line_flux_step(lines, 0.001, ["run_id", "j"])
    return out.select("run_id", "j", "i", *(F.round(c, 8).alias(c) for c in ("q0", "q1", "q2")))


def _gas_line_sql() -> str:
    w = "WINDOW w AS (PARTITION BY run_id, j ORDER BY i)"
    shift = ", ".join(f"{'lag' if d < 2 else 'lead'}(q{k}, {abs(2 - d)}) OVER w AS s{d}_{k}" for d in (0, 1, 3, 4) for k in range(3))
    q = lambda d, k: f"s{d}_{k}" if d != 2 else f"q{k}"
    pressures = ", ".join(f"0.4 * ({q(d, 2)} - {q(d, 1)} * {q(d, 1)} / (2 * {q(d, 0)})) AS p{d}" for d in range(5))
    lim = lambda num, den: f"(CASE WHEN ({num} > 0 AND {den} > 0) OR ({num} < 0 AND {den} < 0) THEN least({num} / {den}, 1.0) / 2 ELSE 0.0 END)"
    face = lambda out, a, b, num, den: ", ".join(f"{q(a, k)} + {lim(num, den)} * ({q(b, k)} - {q(a, k)}) AS {out}{k}" for k in range(3))
    faces = ", ".join([face("wl", 1, 2, "(p2 - p1)", "(p1 - p0)"), face("wr", 2, 1, "(p2 - p1)", "(p3 - p2)"), face("el", 2, 3, "(p3 - p2)", "(p2 - p1)"), face("er", 3, 2, "(p3 - p2)", "(p4 - p3)")])
    pr = lambda s: f"(0.4 * ({s}2 - {s}1 * {s}1 / (2 * {s}0)))"
    flux = lambda s, k: [f"{s}l1 + {s}r1", f"{s}l1 * {s}l1 / {s}l0 + {pr(s + 'l')} + {s}r1 * {s}r1 / {s}r0 + {pr(s + 'r')}", f"({s}l2 + {pr(s + 'l')}) * {s}l1 / {s}l0 + ({s}r2 + {pr(s + 'r')}) * {s}r1 / {s}r0"][k]
    mean = lambda s, k: f"((sqrt({s}l0) * {s}l{k} / {s}l0 + sqrt({s}r0) * {s}r{k} / {s}r0) / (sqrt({s}l0) + sqrt({s}r0)))"
    inner = lambda s: f"(1.4 * 0.4 * ({mean(s, 2)} - {mean(s, 1)} * {mean(s, 1)} / 2))"
    speed = lambda s: f"(CASE WHEN {inner(s)} < 0 THEN 0.0 ELSE sqrt({inner(s)}) + abs({mean(s, 1)}) END)"
    total = ", ".join(f"round(coalesce(q{k} + 0.001 / dx * 0.5 * (0.5 * ((({flux('w', k)}) + {speed('w')} * (wl{k} - wr{k})) - ({flux('e', k)}) - {speed('e')} * (el{k} - er{k}))), q{k}), 8) AS q{k}" for k in range(3))
    return f"""WITH {_gas_sql()}, l0 AS (SELECT run_id, j, i, q0, q1, q3 AS q2 FROM gas0), l1 AS (SELECT *, {shift}, 1 / (count(*) OVER (PARTITION BY run_id, j) - 5)::DOUBLE AS dx FROM l0 {w}),
l2 AS (SELECT *, {pressures} FROM l1), l3 AS (SELECT *, {faces} FROM l2) SELECT run_id, j, i, {total} FROM l3"""


def _cells(select: str, rest: str = "") -> str:
    return f"WITH {RASTER}, c AS (SELECT {TAGS.format(t=0)} FROM cells0) SELECT {select} FROM c {rest}"


ALL = "run_id, t, v, i, j, value"
QUERIES = {
    "grid_raster": base,
    "grid_tiles": _tile_table,
    "grid_tiles_roundtrip": lambda s, d: grid.to_cells(_tiles(s, d), BS),
    "grid_slice": lambda s, d: grid.slice_cells(base(s, d), i=(3, 7), j=4),
    "grid_interior": lambda s, d: grid.interior(base(s, d), NX, NY, 2),
    "grid_border": lambda s, d: grid.border(base(s, d), NX, NY, 2, "east"),
    "grid_ghosts": lambda s, d: grid.with_ghosts(base(s, d), NX, NY, 2),
    "grid_mirror": lambda s, d: grid.mirror_concat(base(s, d), NX),
    "grid_repeat_line": lambda s, d: grid.repeat_line(base(s, d).filter("j = 0").drop("j"), 6),
    "grid_neighbors": lambda s, d: grid.with_neighbors(base(s, d), [(0, 0), (-1, 0), (2, 1)], NX, NY),
    "grid_exchange": lambda s, d: evolve.exchange(_tiles(s, d), NX, NY, BS, 2).select("run_id", "bi", "bj", "side", F.size("data").alias("n"), F.aggregate("data", F.lit(0.0), lambda a, x: a + x).alias("total")),
    "fixed_border": lambda s, d: stencil.apply_border(base(s, d), NX, NY, 2, 1.0, 0.125),
    "stencil_mean4": lambda s, d: stencil.stencil_linear(base(s, d), stencil.mean4(), NX, NY),
    "stencil_diffuse_1": lambda s, d: stencil.stencil_linear(base(s, d), stencil.diffuse(0.125), NX, NY),
    "stencil_diffuse_3": lambda s, d: stencil.iterate(base(s, d), 3, lambda c: stencil.stencil_linear(c, stencil.diffuse(0.125), NX, NY)),
    "stencil_frames": lambda s, d: stencil.iterate(base(s, d), 4, lambda c: stencil.stencil_linear(c, stencil.mean4(), NX, NY), save_every=2).groupBy("run_id", "t").agg(F.max("value").alias("highest"), F.min("value").alias("lowest")),
    "two_stage_diffuse": lambda s, d: stencil.two_stage_step(base(s, d), stencil.diffuse_rate(0.125), NX, NY),
    "evolve_k1": _evolved(kernels.DIFFUSE, 3, 1),
    "evolve_k2": _evolved(kernels.DIFFUSE, 3, 2),
    "evolve_k4": _evolved(kernels.DIFFUSE, 4, 4),
    "evolve_two_stage_k2": _evolved(kernels.DIFFUSE2, 2, 2),
    "evolve_mean4_two_stage": _evolved(kernels.MEAN4_2, 1, 1),
    "evolve_add_two_stage": _evolved(kernels.ADD2, 2, 1),
    "evolve_frames": _evolve_frames,
    "euler_residual": _residual,
    "euler_step": _euler_step,
    "gas_line_step": _gas_line,
    "line_stencil": _line,
    "array_tile_stencil": _array_tile,
}
_EXCHANGE = " UNION ALL ".join(
    f"SELECT run_id, ((i // {BS} - {a} + 4) % 4)::INT AS bi, ((j // {BS} - {b} + 4) % 4)::INT AS bj, {3 * (a + 1) + b + 1}::INT AS side, value FROM cells0 WHERE i % {BS} {'>= 3' if a < 0 else '< 2' if a > 0 else '>= 0'} AND j % {BS} {'>= 3' if b < 0 else '< 2' if b > 0 else '>= 0'}"
    for a, b in evolve.SIDES
)
ORACLES = {
    "grid_raster": _cells(ALL),
    "grid_tiles": f"WITH {RASTER} SELECT run_id, (i // {BS})::INT AS bi, (j // {BS})::INT AS bj, count(*)::INT AS n, sum(value) AS total, arg_min(value, i * 100 + j) AS first, arg_max(value, i * 100 + j) AS last FROM cells0 GROUP BY run_id, i // {BS}, j // {BS}",
    "grid_tiles_roundtrip": _cells(ALL),
    "grid_slice": _cells(ALL, "WHERE i BETWEEN 3 AND 7 AND j = 4"),
    "grid_interior": _cells(ALL, f"WHERE i BETWEEN 2 AND {NX - 3} AND j BETWEEN 2 AND {NY - 3}"),
    "grid_border": _cells(ALL, f"WHERE i >= {NX - 2}"),
    "grid_ghosts": f"WITH {RASTER} SELECT c.run_id, 0::INT AS t, 0::INT AS v, a.x::INT AS i, b.y::INT AS j, c.value FROM range(-2, {NX + 2}) a(x), range(-2, {NY + 2}) b(y), cells0 c WHERE c.i = (a.x + {NX}) % {NX} AND c.j = (b.y + {NY}) % {NY}",
    "grid_mirror": _cells(f"run_id, t, v, ({NX} + i)::INT AS i, j, value") + f" UNION ALL SELECT run_id, t, v, ({NX} - 1 - i)::INT, j, value FROM c",
    "grid_repeat_line": _cells("run_id, t, v, i, r.j::INT AS j, value", ", range(6) r(j) WHERE c.j = 0"),
    "grid_neighbors": _cells(f"c.run_id, c.t, c.v, c.i, c.j, c.value AS n0, a.value AS n1, b.value AS n2", f"JOIN c a ON a.run_id = c.run_id AND a.i = (c.i + {NX - 1}) % {NX} AND a.j = c.j JOIN c b ON b.run_id = c.run_id AND b.i = (c.i + 2) % {NX} AND b.j = (c.j + 1) % {NY}"),
    "grid_exchange": f"WITH {RASTER}, sent AS ({_EXCHANGE}) SELECT run_id, bi, bj, side, count(*)::INT AS n, sum(value) AS total FROM sent GROUP BY ALL",
    "fixed_border": _cells(f"run_id, t, v, i, y.j::INT AS j, CASE WHEN i < 2 THEN 1.0 WHEN i >= {NX - 2} THEN 0.125 ELSE value END AS value", f", range({NY}) y(j) WHERE c.j = CASE WHEN y.j < 2 THEN y.j + {NY - 4} WHEN y.j >= {NY - 2} THEN y.j - {NY - 4} ELSE y.j END"),
    "stencil_mean4": steps_sql(MEAN, 1),
    "stencil_diffuse_1": steps_sql(DIFF, 1),
    "stencil_diffuse_3": steps_sql(DIFF, 3),
    "stencil_frames": f"WITH {', '.join([RASTER, *(_step_sql(f'cells{k}', f'cells{k + 1}', MEAN) for k in range(4))])} " + " UNION ALL ".join(f"SELECT run_id, {t}::INT AS t, max(value) AS highest, min(value) AS lowest FROM cells{t} GROUP BY run_id" for t in (0, 2, 4)),
    "two_stage_diffuse": two_stage_sql(1),
    "evolve_k1": steps_sql(DIFF, 3),
    "evolve_k2": steps_sql(DIFF, 3),
    "evolve_k4": steps_sql(DIFF, 4),
    "evolve_two_stage_k2": two_stage_sql(2),
    "evolve_mean4_two_stage": steps_sql(MEAN, 2).replace("2::INT AS t", "1::INT AS t"),
    "evolve_add_two_stage": f"WITH {RASTER} SELECT run_id, 2::INT AS t, 0::INT AS v, i, j, value + 4 AS value FROM cells0",
    "evolve_frames": f"WITH {RASTER} SELECT run_id, k.t::INT AS t, sum(value + k.t) AS total, max(value + k.t) AS highest FROM cells0, (VALUES (0), (2), (4), (5)) k(t) GROUP BY run_id, k.t",
    "euler_residual": _residual_sql(),
    "euler_step": _euler_sql(),
    "gas_line_step": _gas_line_sql(),
    "line_stencil": """WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*)::DOUBLE AS value FROM events GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS k, count(*) OVER (PARTITION BY event_type) AS m FROM d)
SELECT a.event_type, a.day, a.value, CASE WHEN a.k = 1 OR a.k = a.m THEN a.value ELSE b.value - 2 * a.value + c.value END AS open, b.value - 2 * a.value + c.value AS wrapped
FROM n a JOIN n b ON b.event_type = a.event_type AND b.k = CASE WHEN a.k = 1 THEN a.m ELSE a.k - 1 END JOIN n c ON c.event_type = a.event_type AND c.k = CASE WHEN a.k = a.m THEN 1 ELSE a.k + 1 END""",
    "array_tile_stencil": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(64))::INT AS k FROM embeddings)
SELECT vec_id, k, e[((k // 8 + 7) % 8) * 8 + k % 8 + 1] * 0.25 + e[((k // 8 + 1) % 8) * 8 + k % 8 + 1] * 0.25 + e[(k // 8) * 8 + (k + 7) % 8 + 1] * 0.25 + e[(k // 8) * 8 + (k + 1) % 8 + 1] * 0.25 AS value FROM e""",
}
