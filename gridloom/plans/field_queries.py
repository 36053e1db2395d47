"""Queries that evaluate closed-form fields and compare fields, on grids made from the tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import fields
from ..functions.scalars import coordinate, mirrored, repeated
from ..functions.session import table
from ..operators import compare, grid, stencil
from .grid_queries import DIFF, NX, NY, RASTER, _step_sql, base

NE = 24
SHOCK = fields.shock_states()


def series(spark, sf_dir):
    """Frames by day: events counted on a user x hour grid, a variable for each type."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    kinds = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return e.groupBy(F.lit("events").alias("run_id"), day.cast("int").alias("t"), kinds.alias("v"), F.pmod("user_id", F.lit(NE)).cast("int").alias("i"), F.hour("ts").alias("j")).agg(F.count("*").cast("double").alias("value"))


SERIES = f"""c AS (SELECT 'events' AS run_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS t, CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END::INT AS v,
  (user_id % {NE})::INT AS i, hour(ts)::INT AS j, count(*)::DOUBLE AS value FROM events GROUP BY ALL)"""


def _field_heat(spark, sf_dir):
    c = series(spark, sf_dir)
    x, y = coordinate(F.col("i"), 0, 1, NE), coordinate(F.col("j"), 0, 1, NE)
    return c.select("t", "v", "i", "j", F.round(fields.heat_field(x, y, F.col("t") / 100, F.lit(0.01)), 9).alias("field"))


def _field_vortex(spark, sf_dir):
    c = series(spark, sf_dir)
    x, y = coordinate(F.col("i"), -5, 5, NE), coordinate(F.col("j"), -5, 5, NE)
    q = fields.vortex_field(x, y, F.col("t") / 50)
    return c.select("t", "v", "i", "j", *(F.round(a, 9).alias(f"q{k}") for k, a in enumerate(q)), F.round(fields.pressure(q), 9).alias("pressure"))


def _field_patterns(spark, sf_dir):
    c = series(spark, sf_dir)
    return c.select("t", "v", "i", "j", fields.checkerboard(F.col("i"), F.col("j")).alias("checker"), fields.ramp(F.col("i"), F.col("j"), NE).alias("ramp"))


def _compared(spark, sf_dir):
    """One diffusion step of the grid against a smoothed copy that is off by a part in 2^20."""
    cells = base(spark, sf_dir)
    moved = stencil.stencil_linear(cells, stencil.diffuse(0.125), NX, NY)
    other = moved.withColumn("value", F.when((F.col("i") + F.col("j")) % 7 == 0, F.col("value") * (1 + 2.0**-20)).otherwise(F.col("value")))
    return compare.compare_fields(moved, other)


COMPARED = f"{RASTER}, {_step_sql('cells0', 'm', DIFF)}, k AS (SELECT run_id, 1::INT AS t, i, j, value AS a, CASE WHEN (i + j) % 7 = 0 THEN value * (1 + power(2.0, -20)) ELSE value END AS b FROM m)"


def _frames_against_heat(spark, sf_dir):
    x, y = coordinate(F.col("i"), 0, 1, NE), coordinate(F.col("j"), 0, 1, NE)
    return compare.compare_fields(series(spark, sf_dir), fields.heat_field(x, y, F.col("t") / 100, F.lit(0.01)))


def _frame_error(spark, sf_dir):
    return compare.error_by_frame(_frames_against_heat(spark, sf_dir)).select("run_id", "t", F.round("max_error", 9).alias("max_error"))


def _error_summary(spark, sf_dir):
    out = compare.error_summary(_frames_against_heat(spark, sf_dir))
    return out.select("run_id", F.round("max_error", 9).alias("max_error"), F.round("mean_error", 9).alias("mean_error"))


def _signed(spark, sf_dir):
    return compare.signed_difference(_frames_against_heat(spark, sf_dir), 3).select("run_id", F.round("max_difference", 9).alias("max_difference"))


def _exact(spark, sf_dir):
    cells = grid.with_ghosts(base(spark, sf_dir), NX, NY, 0)
    return compare.exact_verdict(compare.compare_fields(cells, F.when(F.col("run_id") == "A", F.col("value")).otherwise(F.floor(F.col("value") / 2) * 2.0)))


def _order(spark, sf_dir):
    """Errors of second differences of sine on grids as fine as each supplier count allows."""
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    dt = 1.0 / (F.col("n") * 8 + 16)
    error = F.abs((F.sin(1 + dt) - 2 * F.sin(F.lit(1.0)) + F.sin(1 - dt)) / (dt * dt) + F.sin(F.lit(1.0)))
    e = s.select(F.lit("sine").alias("series"), dt.alias("dt"), error.alias("max_error"))
    return compare.convergence_order(e).select("series", F.round("order", 3).alias("order"))


def _shock(spark, sf_dir):
    """Shock-tube states at places and times given by orders."""
    o = table(spark, sf_dir, "orders")
    x, t = coordinate(F.col("o_orderkey") % 200, -0.5, 0.5, 200), (F.col("o_custkey") % 4 + 1) / 16.0
    f = fields.shock_field(x, t, SHOCK)
    return o.select("o_orderkey", f["region"].alias("region"), *(F.round(f[c], 9).alias(c) for c in ("p", "rho", "u", "energy")))


def _shock_sql() -> str:
    s = SHOCK
    x, t = "(-0.5 + 1.0 * (o_orderkey % 200) / 200.0)", "((o_custkey % 4 + 1) / 16.0)"
    fan_u = f"({2 / 2.4} * ({s['c_left']} + x / t))"
    fan = f"(1 - 0.4 * {fan_u} / (2 * {s['c_left']}))"
    pick = lambda *v: f"CASE region WHEN 'left' THEN {v[0]} WHEN 'fan' THEN {v[1]} WHEN 'contact' THEN {v[2]} WHEN 'shock' THEN {v[3]} WHEN 'right' THEN {v[4]} ELSE 0.0 END"
    p = pick(1.0, f"power({fan}, {2.8 / 0.4})", s["p2"], s["p2"], 0.1)
    rho = pick(1.0, f"power({fan}, {2 / 0.4})", s["rho3"], s["rho2"], 0.125)
    u = pick(0.0, fan_u, s["u2"], s["u2"], 0.0)
    return f"""WITH xt AS (SELECT o_orderkey, ({x})::DOUBLE AS x, ({t})::DOUBLE AS t FROM orders),
r AS (SELECT *, CASE WHEN x < {s['fan_left']} * t THEN 'left' WHEN x > {s['fan_left']} * t AND x < {s['fan_right']} * t THEN 'fan' WHEN x > {s['fan_right']} * t AND x < {s['contact']} * t THEN 'contact'
  WHEN x > {s['contact']} * t AND x < {s['shock']} * t THEN 'shock' WHEN x > {s['shock']} * t THEN 'right' END AS region FROM xt),
f AS (SELECT o_orderkey, region, ({p})::DOUBLE AS p, ({rho})::DOUBLE AS rho, ({u})::DOUBLE AS u FROM r)
SELECT o_orderkey, region, round(p, 9) AS p, round(rho, 9) AS rho, round(u, 9) AS u, round(p / 0.4 + rho * u * u / 2, 9) AS energy FROM f"""


def _array_functions(spark, sf_dir):
    """Embeddings, whole: mirrored, then all but their ends twice."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    inner = F.slice("e", F.lit(2), F.size("e") - 2)
    return df.select("vec_id", F.posexplode(F.concat(mirrored(F.col("e")), repeated(inner, 2))).alias("k", "value"))


_X = lambda a, b, n, k: f"({float(a)} + {float(b - a)} * {k} / {float(n)})"
_HEAT = f"sin({2 * math.pi} * {_X(0, 1, NE, 'i')}) * sin({2 * math.pi} * {_X(0, 1, NE, 'j')}) * exp({-8.0 * math.pi**2} * 0.01 * (t / 100))"


def _vortex_sql() -> str:
    g = 1.4
    mach = math.sqrt(2 / g)
    beta, speed = mach * 5 * math.sqrt(2) / 4 / math.pi * math.exp(0.5), mach * math.sqrt(g)
    u0 = speed * math.cos(math.pi / 4)
    v0 = speed * math.sin(math.pi / 4)
    return f"""WITH {SERIES}, a AS (SELECT t, v, i, j, {_X(-5, 5, NE, 'i')} - {u0} * (t / 50) AS dx, {_X(-5, 5, NE, 'j')} - {v0} * (t / 50) AS dy FROM c),
o AS (SELECT *, {beta} * exp(-0.5 * (dx * dx + dy * dy)) AS om FROM a), r AS (SELECT *, 1 - 0.4 * om * om / 2 AS r0 FROM o),
q AS (SELECT t, v, i, j, power(r0, {1 / (g - 1)}) AS rho, {u0} - dy * om AS u, {v0} + dx * om AS w, power(r0, {g / (g - 1)}) / 1.4 AS p FROM r)
SELECT t, v, i, j, round(rho, 9) AS q0, round(rho * u, 9) AS q1, round(rho * w, 9) AS q2, round(p / 0.4 + 0.5 * rho * (u * u + w * w), 9) AS q3, round(p, 9) AS pressure FROM q"""


QUERIES = {
    "event_series": series,
    "field_heat": _field_heat,
    "field_vortex": _field_vortex,
    "field_patterns": _field_patterns,
    "frame_error": _frame_error,
    "error_summary": _error_summary,
    "signed_difference": _signed,
    "allclose_strict": lambda s, d: compare.allclose_verdict(_compared(s, d), 9e-15, 9e-15),
    "allclose_default": lambda s, d: compare.allclose_verdict(_compared(s, d)),
    "exact_verdict": _exact,
    "run_verdict": lambda s, d: compare.run_verdict(_exact(s, d)),
    "frame_diff": lambda s, d: compare.frame_diff(base(s, d), base(s, d).withColumn("value", F.col("value") + F.when(F.col("run_id") == "N", 0.5).otherwise(0.0))).drop("lacking"),
    "convergence_order": _order,
    "frame_pick": lambda s, d: compare.pick_frames(series(s, d), "ends"),
    "frame_pick_late": lambda s, d: compare.pick_frames(series(s, d), "late"),
    "frame_sample": lambda s, d: compare.sample_frames(series(s, d), 4),
    "shock_regions": _shock,
    "array_functions": _array_functions,
}
ORACLES = {
    "event_series": f"WITH {SERIES} SELECT * FROM c",
    "field_heat": f"WITH {SERIES} SELECT t, v, i, j, round({_HEAT}, 9) AS field FROM c",
    "field_vortex": _vortex_sql(),
    "field_patterns": f"WITH {SERIES} SELECT t, v, i, j, CASE WHEN (i + j) % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS checker, ((i * {NE} + j) / 100.0)::DOUBLE AS ramp FROM c",
    "frame_error": f"WITH {SERIES} SELECT run_id, t, round(max(abs(value - {_HEAT})), 9) AS max_error FROM c GROUP BY run_id, t",
    "error_summary": f"WITH {SERIES}, f AS (SELECT run_id, t, max(abs(value - {_HEAT})) AS e FROM c GROUP BY run_id, t) SELECT run_id, round(max(e), 9) AS max_error, round(avg(e), 9) AS mean_error FROM f GROUP BY run_id",
    "signed_difference": f"WITH {SERIES} SELECT run_id, round(max(value - {_HEAT}), 9) AS max_difference FROM c WHERE t = 3 GROUP BY run_id",
    "allclose_strict": f"WITH {COMPARED} SELECT run_id, t, bool_and(abs(a - b) <= 9e-15 + 9e-15 * abs(b)) AS ok FROM k GROUP BY run_id, t",
    "allclose_default": f"WITH {COMPARED} SELECT run_id, t, bool_and(abs(a - b) <= 1e-8 + 1e-5 * abs(b)) AS ok FROM k GROUP BY run_id, t",
    "exact_verdict": f"WITH {RASTER} SELECT run_id, 0::INT AS t, bool_and(run_id = 'A' OR value % 2 = 0) AS ok FROM cells0 GROUP BY run_id",
    "run_verdict": f"WITH {RASTER} SELECT run_id, NOT bool_and(run_id = 'A' OR value % 2 = 0) AS failed FROM cells0 GROUP BY run_id",
    "frame_diff": f"WITH {RASTER} SELECT run_id, 0::INT AS t, CASE WHEN run_id = 'N' THEN 0.5 ELSE 0.0 END::DOUBLE AS max_error, run_id = 'N' AS differs FROM cells0 GROUP BY run_id",
    "convergence_order": """WITH s AS (SELECT count(*) AS n FROM supplier GROUP BY s_nationkey), d AS (SELECT 1.0::DOUBLE / (n * 8 + 16) AS dt FROM s),
e AS (SELECT dt, abs((sin(1 + dt) - 2 * sin(1.0) + sin(1 - dt)) / (dt * dt) + sin(1.0)) AS err FROM d) SELECT 'sine' AS series, round(regr_slope(ln(err), ln(dt)), 3) AS "order" FROM e""",
    "frame_pick": f"WITH {SERIES}, n AS (SELECT run_id, max(t) + 1 AS n FROM c GROUP BY run_id) SELECT c.* FROM c JOIN n USING (run_id) WHERE t IN (0, n // 2, n - 1)",
    "frame_pick_late": f"WITH {SERIES}, n AS (SELECT run_id, max(t) + 1 AS n FROM c GROUP BY run_id) SELECT c.* FROM c JOIN n USING (run_id) WHERE t IN (n // 10, n // 2, n - 1)",
    "frame_sample": f"WITH {SERIES} SELECT * FROM c WHERE t % 4 = 0",
    "shock_regions": _shock_sql(),
    "array_functions": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, len(embedding) AS n, unnest(range(4 * len(embedding) - 4))::INT AS k FROM embeddings) SELECT vec_id, k, e[CASE WHEN k < n THEN n - k WHEN k < 2 * n THEN k - n + 1 ELSE 2 + (k - 2 * n) % (n - 2) END] AS value FROM e",
}
