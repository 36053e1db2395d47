"""Queries on ragged and sparse tiles, evolution in place, composed stencils, refinement, digests, intervals, and files that are written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.session import shared_folder, table
from ..operators import compare, evolve, grid, intervals, kernels, runs, stencil
from ..sources import arrays, io
from .field_queries import _exact
from .grid_queries import DIFF, MEAN, NX, NY, RASTER, TAGS, _step_sql, base, steps_sql
from .run_queries import KEY, LOG, log

SMALL = 6  # does not divide 20
FINE = 16


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _some(cells):
    """Without one cell in eleven."""
    return cells.filter((F.col("i") * 7 + F.col("j")) % 11 != 0)


def _tiles_of(cells):
    return grid.to_tiles(cells, NX, NY, SMALL)


def _in_place(spark, sf_dir):
    return grid.to_cells(evolve.evolve_in_place(_tiles_of(base(spark, sf_dir)), NX, NY, SMALL, kernels.DIFFUSE, 5, 2), SMALL)


def _ragged(spark, sf_dir):
    """Halos of 3, where the last tiles are 2 wide."""
    return grid.to_cells(evolve.evolve(_tiles_of(base(spark, sf_dir)), NX, NY, SMALL, kernels.DIFFUSE, 4, 3), SMALL)


def _lacking_tiles(spark, sf_dir):
    d = F.col("data")
    known = F.filter(d, lambda x: x.isNotNull())
    return _tiles_of(_some(base(spark, sf_dir))).select("run_id", "bi", "bj", "ni", "nj", F.size(d).alias("n"), F.size(known).alias("known"), F.aggregate(known, F.lit(0.0), lambda a, x: a + x).alias("total"))


def _evolve_lacking(spark, sf_dir):
    return grid.to_cells(evolve.evolve(_tiles_of(_some(base(spark, sf_dir))), NX, NY, SMALL, kernels.MEAN4, 1), SMALL)


def _diffuse100(spark, sf_dir):
    cells = grid.to_cells(evolve.evolve(_tiles_of(base(spark, sf_dir)), NX, NY, SMALL, kernels.DIFFUSE100, 2, 1), SMALL)
    return cells.withColumn("value", F.round("value", 7))


def _ten_steps(spark, sf_dir):
    return stencil.iterate(base(spark, sf_dir), 10, lambda c: stencil.stencil_linear(c, stencil.diffuse(0.125), NX, NY), cut_every=4)


def _ten_rounds(spark, sf_dir):
    return grid.to_cells(evolve.evolve(_tiles_of(base(spark, sf_dir)), NX, NY, SMALL, kernels.DIFFUSE, 10, 1), SMALL)


def _composed(spark, sf_dir):
    return stencil.stencil_steps(base(spark, sf_dir), stencil.diffuse(0.125), NX, NY, 4)


def _damaged(cells):
    """Another value in some cells of run N, and a row of cells of run R lacking."""
    other = F.when((F.col("run_id") == "N") & ((F.col("i") + F.col("j")) % 13 == 0), F.col("value") + 0.5).otherwise(F.col("value"))
    return cells.withColumn("value", other).filter((F.col("run_id") != "R") | (F.col("i") != 3))


def _frame_diff_lacking(spark, sf_dir):
    return compare.frame_diff(base(spark, sf_dir), _damaged(base(spark, sf_dir)))


def _differing_tiles(spark, sf_dir):
    return compare.differing_tiles(base(spark, sf_dir), _damaged(base(spark, sf_dir)), SMALL)


def _differing_cells(spark, sf_dir):
    return compare.differing_cells(base(spark, sf_dir), _damaged(base(spark, sf_dir)), SMALL)


def _refinement(spark, sf_dir):
    """Diffusion of one field on 16, 8 and 4 cells a side up to the same time: the order that the three show."""
    c = F.col
    made = grid.rasterize(table(spark, sf_dir, "lineitem"), FINE, FINE, c("l_returnflag"), c("l_partkey"), c("l_suppkey"), {"value": c("l_quantity")})
    fine = grid.to_cell_layout(made, "value")

    def evolved(cells, n, steps):
        return grid.to_cells(evolve.evolve(grid.to_tiles(cells, n, n, n), n, n, n, kernels.DIFFUSE, steps, min(steps, 4)), n).withColumn("t", F.lit(1))

    grids = [evolved(fine if n == FINE else compare.restrict(fine, FINE // n), n, n * n // FINE) for n in (4, 8, 16)]
    out = compare.observed_order(*grids, how="mean")
    return out.select("run_id", "t", *(F.round(x, 6).alias(x) for x in ("outer", "inner", "order")))


def _refinement_sql() -> str:
    def near(n, name, di, dj, source):
        return f"JOIN {source} {name} ON {name}.run_id = c.run_id AND {name}.i = (c.i + {di} + {n}) % {n} AND {name}.j = (c.j + {dj} + {n}) % {n}"

    ctes = [
        f"s AS (SELECT l_returnflag AS run_id, (l_partkey % {FINE})::INT AS i, (l_suppkey % {FINE})::INT AS j, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)",
        f"g16_0 AS MATERIALIZED (SELECT r.run_id, a.i::INT AS i, b.j::INT AS j, coalesce(s.value, 0.0) AS value FROM (SELECT DISTINCT run_id FROM s) r, range({FINE}) a(i), range({FINE}) b(j) LEFT JOIN s ON s.run_id = r.run_id AND s.i = a.i AND s.j = b.j)",
    ]
    ctes += [f"g{n}_0 AS MATERIALIZED (SELECT run_id, (i // {FINE // n})::INT AS i, (j // {FINE // n})::INT AS j, avg(value) AS value FROM g16_0 GROUP BY ALL)" for n in (8, 4)]
    for n in (16, 8, 4):
        for k in range(n * n // FINE):
            src = f"g{n}_{k}"
            joins = " ".join(near(n, x, di, dj, src) for x, di, dj in (("w", -1, 0), ("e", 1, 0), ("s", 0, -1), ("n", 0, 1)))
            ctes.append(f"g{n}_{k + 1} AS MATERIALIZED (SELECT c.run_id, c.i, c.j, {DIFF} AS value FROM {src} c {joins})")
    small = lambda name, f: f"(SELECT run_id, i // {f} AS i, j // {f} AS j, avg(value) AS value FROM {name} GROUP BY ALL)"
    ctes.append(f"o AS (SELECT a.run_id, max(abs(a.value - b.value)) AS d FROM g4_1 a JOIN {small('g8_4', 2)} b USING (run_id, i, j) GROUP BY 1)")
    ctes.append(f"q AS (SELECT a.run_id, max(abs(a.value - b.value)) AS d FROM {small('g8_4', 2)} a JOIN {small('g16_16', 4)} b USING (run_id, i, j) GROUP BY 1)")
    return f"WITH {', '.join(ctes)} SELECT o.run_id, 1::INT AS t, round(o.d, 6) AS \"outer\", round(q.d, 6) AS \"inner\", round(ln(o.d / q.d) / ln(2.0), 6) AS \"order\" FROM o JOIN q USING (run_id)"


def _intervals(spark, sf_dir):
    """Customers by the two suppliers of their nation between whose balances theirs lies; the first and last interval are open."""
    s = table(spark, sf_dir, "supplier")
    ranked = s.groupBy("s_nationkey", "s_acctbal").agg(F.min("s_suppkey").alias("supplier"))
    w = F.expr("lead(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal)")
    bounds = ranked.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("low"), w.alias("high"), "supplier")
    points = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("x"))
    return intervals.classify_intervals(points, bounds, "x", ("nation",), closed="left", bins=64, rows_a_salt=20)


def _written(spark, sf_dir):
    """Frames written and a box of them read back."""
    path, cells = _folder(spark), base(spark, sf_dir)
    io.write_frames(cells, cells.select("run_id").distinct().withColumn("blocksize", F.lit(SMALL)), path)
    frames, meta = io.read_frames(spark, path)
    return grid.slice_cells(frames.join(meta, "run_id"), i=(5, 12), j=(3, 9)).select("run_id", "t", "v", "i", "j", "value", "blocksize")


def _arrays(spark, sf_dir):
    """Grids as one array a run, written and read."""
    path = _folder(spark)
    grid.to_tiles(base(spark, sf_dir), NX, NY, NX).select("run_id", "data").write.parquet(path)
    return io.read_grid(spark, path, "array", NX, NY)


def _sink(spark, sf_dir):
    """Tiles of two frames written by the array sink, the second one twice; it alone is read."""
    arrays.register(spark)
    path = _folder(spark)
    tiles = _tiles_of(base(spark, sf_dir))
    later = evolve.evolve(tiles, NX, NY, SMALL, kernels.ADD, 1).select("run_id", "t", "bi", "bj", "ni", "nj", "data")
    for frames in (tiles, later, later):
        frames.write.format("grid_frames").option("path", path).mode("append").save()
    return grid.to_cells(spark.read.format("grid_frames").option("path", path).load().filter("t = 1"), SMALL)


def _orders_log(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.date_format("o_orderdate", "MM/dd/yyyy-HH:mm:ss"), F.lit("."), F.col("o_orderkey")).alias("key"), F.col("o_totalprice").alias("runtime"), (F.col("o_custkey") % 32 + 8).cast("int").alias("blocksize"), (F.col("o_custkey") % 2 == 0).alias("swept"), F.col("o_orderkey").alias("n"))


def _yaml(spark, sf_dir):
    """Orders as YAML records, some long and some short, written as text and read by many tasks."""
    path, c = _folder(spark), F.col
    lines = _orders_log(spark, sf_dir)
    short = F.concat_ws("\n", F.concat(F.lit("'"), c("key"), F.lit("':")), F.concat(F.lit("  runtime: "), c("runtime").cast("decimal(20,2)").cast("string")), F.concat(F.lit("  swept: "), c("swept").cast("string")))
    long = F.concat_ws("\n", short, F.concat(F.lit("  blocksize: "), c("blocksize").cast("string")), F.concat(F.lit("  array_shape:\n  - 11\n  - 1\n  - "), c("blocksize").cast("string")))
    lines.select(F.when(c("n") % 3 == 0, short).otherwise(long).alias("value")).write.text(path)
    return io.read_run_logs(spark, [path], "yaml").select("key", "runtime", "swept", "blocksize", F.element_at("array_shape", 3).alias("size"))


def _json(spark, sf_dir):
    path = _folder(spark)
    _orders_log(spark, sf_dir).drop("n").write.json(path)
    return io.read_run_logs(spark, [path]).select("key", "runtime", "swept", "blocksize", F.col("file").contains(path.rpartition("/")[2]).alias("named"))


def _merged(spark, sf_dir):
    """A stored log of even orders; those of few customers come again with another runtime, and some new ones."""
    path, every = _folder(spark), _orders_log(spark, sf_dir)
    io.write_log(every.filter("n % 2 = 0"), path, 16)
    io.merge_log(spark, path, every.filter("blocksize = 9").withColumn("runtime", -F.col("runtime")), 16)
    return io.read_log(spark, path).select("key", "runtime", "blocksize", "n")


def _hardware_nulls(spark, sf_dir):
    """Runs of two kinds of hardware whose block is null for some: nulls meet."""
    def first(flag):
        own = log(spark, sf_dir).filter(F.col("l_returnflag") == flag).withColumn("block", F.nullif("block", F.lit(3.0)))
        return own.groupBy(*KEY).agg(F.min("runtime").alias("runtime"))

    return runs.pair_hardware(first("A"), first("N"), KEY, "runtime")


_SOME = "f AS (SELECT * FROM cells0 WHERE (i * 7 + j) % 11 <> 0)"
_OTHER = "b AS (SELECT run_id, i, j, CASE WHEN run_id = 'N' AND (i + j) % 13 = 0 THEN value + 0.5 ELSE value END AS value FROM cells0 WHERE run_id <> 'R' OR i <> 3)"
_MET = f"WITH {RASTER}, {_OTHER}, k AS (SELECT c.run_id, 0::INT AS t, 0::INT AS v, c.i, c.j, c.value AS a, b.value AS b FROM cells0 c LEFT JOIN b ON b.run_id = c.run_id AND b.i = c.i AND b.j = c.j)"
_LOGGED = "o AS (SELECT strftime(o_orderdate, '%m/%d/%Y-%H:%M:%S') || '.' || o_orderkey AS key, o_totalprice AS runtime, (o_custkey % 32 + 8)::INT AS blocksize, o_custkey % 2 = 0 AS swept, o_orderkey AS n FROM orders)"


def _many_steps(n: int) -> str:
    ctes = [RASTER, *(_step_sql(f"cells{k}", f"cells{k + 1}", DIFF).replace(" AS (", " AS MATERIALIZED (", 1) for k in range(n))]
    return f"WITH {', '.join(ctes)} SELECT {TAGS.format(t=n)} FROM cells{n}"


def _diffuse100_sql() -> str:
    rate = "c.value * -0.04 + (w.value * 0.01 + e.value * 0.01 + s.value * 0.01 + n.value * 0.01)"
    ctes = [RASTER]
    for k in range(2):
        ctes += [_step_sql(f"cells{k}", f"half{k}", f"c.value + 0.5 * ({rate})", ", c.value AS u"), _step_sql(f"half{k}", f"cells{k + 1}", f"c.u + ({rate})")]
    return f"WITH {', '.join(ctes)} SELECT {TAGS.format(t=2).replace('value', 'round(value, 7) AS value')} FROM cells2"


QUERIES = {
    "evolve_in_place": _in_place,
    "evolve_ragged": _ragged,
    "evolve_lacking": _evolve_lacking,
    "evolve_diffuse100": _diffuse100,
    "evolve_10_rounds": _ten_rounds,
    "grid_lacking_tiles": _lacking_tiles,
    "stencil_diffuse_10": _ten_steps,
    "stencil_composed_4": _composed,
    "frame_diff_lacking": _frame_diff_lacking,
    "differing_tiles": _differing_tiles,
    "differing_cells": _differing_cells,
    "run_verdict_all": lambda s, d: compare.run_verdict(_exact(s, d), "all"),
    "refinement_order": _refinement,
    "interval_classes": _intervals,
    "frames_written": _written,
    "grid_arrays_read": _arrays,
    "frames_sink": _sink,
    "logs_yaml": _yaml,
    "logs_json": _json,
    "log_merged": _merged,
    "hardware_pairs_nulls": _hardware_nulls,
}
ORACLES = {
    "evolve_in_place": steps_sql(DIFF, 5),
    "evolve_ragged": steps_sql(DIFF, 4),
    "evolve_lacking": f"WITH {RASTER}, {_SOME}, {_step_sql('f', 'm', MEAN).replace('FROM f c', 'FROM cells0 c')} SELECT {TAGS.format(t=1)} FROM m",
    "evolve_diffuse100": _diffuse100_sql(),
    "evolve_10_rounds": _many_steps(10),
    "grid_lacking_tiles": f"WITH {RASTER}, {_SOME} SELECT run_id, (i // {SMALL})::INT AS bi, (j // {SMALL})::INT AS bj, least({SMALL}, {NX} - i // {SMALL} * {SMALL})::INT AS ni, least({SMALL}, {NY} - j // {SMALL} * {SMALL})::INT AS nj, (any_value(least({SMALL}, {NX} - i // {SMALL} * {SMALL})) * any_value(least({SMALL}, {NY} - j // {SMALL} * {SMALL})))::INT AS n, count(*)::INT AS known, sum(value) AS total FROM f GROUP BY run_id, i // {SMALL}, j // {SMALL}",
    "stencil_diffuse_10": _many_steps(10),
    "stencil_composed_4": steps_sql(DIFF, 4),
    "frame_diff_lacking": f"{_MET} SELECT run_id, t, max(abs(a - b)) AS max_error, count(*) FILTER (b IS NULL) AS lacking, count(*) FILTER (b IS NULL) > 0 OR max(abs(a - b)) >= 1e-16 AS differs FROM k GROUP BY run_id, t",
    "differing_tiles": f"{_MET} SELECT DISTINCT run_id, t, (i // {SMALL})::INT AS bi, (j // {SMALL})::INT AS bj FROM k WHERE a IS DISTINCT FROM b",
    "differing_cells": f"{_MET} SELECT * FROM k WHERE a IS DISTINCT FROM b",
    "run_verdict_all": f"WITH {RASTER} SELECT run_id, NOT bool_and(run_id = 'A' OR value % 2 = 0) AS failed FROM cells0 GROUP BY run_id",
    "refinement_order": _refinement_sql(),
    "interval_classes": """WITH s AS (SELECT s_nationkey AS nation, s_acctbal AS low, min(s_suppkey) AS supplier FROM supplier GROUP BY ALL), b AS (SELECT *, lead(low) OVER (PARTITION BY nation ORDER BY low) AS high FROM s)
SELECT c_custkey, c_nationkey AS nation, c_acctbal AS x, b.low, b.high, b.supplier FROM customer LEFT JOIN b ON b.nation = c_nationkey AND c_acctbal >= b.low AND (b.high IS NULL OR c_acctbal < b.high)""",
    "frames_written": f"WITH {RASTER}, c AS (SELECT {TAGS.format(t=0)} FROM cells0) SELECT *, {SMALL}::INT AS blocksize FROM c WHERE i BETWEEN 5 AND 12 AND j BETWEEN 3 AND 9",
    "grid_arrays_read": f"WITH {RASTER} SELECT {TAGS.format(t=0)} FROM cells0",
    "frames_sink": f"WITH {RASTER} SELECT run_id, 1::INT AS t, 0::INT AS v, i, j, value + 1 AS value FROM cells0",
    "logs_yaml": f"WITH {_LOGGED} SELECT key, round(runtime, 2) AS runtime, swept, CASE WHEN n % 3 <> 0 THEN blocksize END AS blocksize, CASE WHEN n % 3 <> 0 THEN blocksize END AS size FROM o",
    "logs_json": f"WITH {_LOGGED} SELECT key, runtime, swept, blocksize, true AS named FROM o",
    "log_merged": f"WITH {_LOGGED} SELECT key, CASE WHEN blocksize = 9 THEN -runtime ELSE runtime END AS runtime, blocksize, n FROM o WHERE n % 2 = 0 OR blocksize = 9",
    "hardware_pairs_nulls": f"WITH {LOG}, f AS (SELECT l_returnflag, mode, size, nullif(block, 3.0) AS block, share, min(runtime) AS runtime FROM log GROUP BY ALL) SELECT a.mode, a.size, a.block, a.share, a.runtime / b.runtime AS ratio FROM f a JOIN f b ON a.mode = b.mode AND a.size = b.size AND a.block IS NOT DISTINCT FROM b.block AND a.share = b.share AND a.l_returnflag = 'A' AND b.l_returnflag = 'N'",
}
