"""Comparison of fields, frame by frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage

CELL = ("run_id", "t", "v", "i", "j")


def compare_fields(numeric: DataFrame, reference: DataFrame | Column) -> DataFrame:
    """Cells with a (numeric) and b (reference), null where one side lacks the cell: such cells are never near or
    equal, so that a lacking frame fails. Nulls in keys equal nulls. A reference that is an expression of the
    cell's columns needs no join."""
    if isinstance(reference, DataFrame):
        left, right = numeric.select(*CELL, F.col("value").alias("a")), reference.select(*(F.col(c).alias(f"__{c}") for c in CELL), F.col("value").alias("b"))
        same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in CELL))
        return left.join(right, same, "full").select(*(F.coalesce(c, f"__{c}").alias(c) for c in CELL), "a", "b")
    return numeric.select(*CELL, F.col("value").alias("a"), reference.alias("b"))


def _lacking() -> Column:
    return F.col("a").isNull() | F.col("b").isNull()


def error_by_frame(compared: DataFrame) -> DataFrame:
    """A1: largest absolute error of each frame, over the cells that both sides have, and how many cells one side lacks."""
    return compared.groupBy("run_id", "t").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("max_error"), F.count_if(_lacking()).alias("lacking"))


def error_summary(compared: DataFrame) -> DataFrame:
    """A1: largest error and mean of the frames' largest errors of each run, and how many cells one side lacks."""
    return error_by_frame(compared).groupBy("run_id").agg(F.max("max_error").alias("max_error"), F.avg("max_error").alias("mean_error"), F.sum("lacking").alias("lacking"))


def signed_difference(compared: DataFrame, t: int) -> DataFrame:
    """A1: largest signed difference at one frame, and how many of its cells one side lacks."""
    return compared.filter(F.col("t") == t).groupBy("run_id").agg(F.max(F.col("a") - F.col("b")).alias("max_difference"), F.count_if(_lacking()).alias("lacking"))


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """A2: near b, or equal infinities; nothing is near a value that is not a number."""
    infinite = (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))
    near = F.when(infinite, a == b).otherwise(F.abs(a - b) <= atol + rtol * F.abs(b))
    return F.when(F.isnan(a) | F.isnan(b), F.lit(False)).otherwise(F.coalesce(near, F.lit(False)))


def allclose_verdict(compared: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """A2, per frame."""
    return compared.groupBy("run_id", "t").agg(F.bool_and(close(F.col("a"), F.col("b"), rtol, atol)).alias("ok"))


def exact_verdict(compared: DataFrame) -> DataFrame:
    """A3, per frame."""
    return compared.groupBy("run_id", "t").agg(F.bool_and(F.coalesce((F.col("a") == F.col("b")) & ~F.isnan("a"), F.lit(False))).alias("ok"))


def run_verdict(frames: DataFrame, rule: str = "any") -> DataFrame:
    """A4: a run failed if any frame failed, or only if all did."""
    failed = F.bool_or(~F.col("ok")) if rule == "any" else F.bool_and(~F.col("ok"))
    return frames.groupBy("run_id").agg(failed.alias("failed"))


def convergence_order(errors: DataFrame) -> DataFrame:
    """A10: errors (series, dt, max_error) to the slope of log error on log dt."""
    return errors.groupBy("series").agg(F.regr_slope(F.log("max_error"), F.log("dt")).alias("order"))


def pick_frames(cells: DataFrame, spec: str = "ends") -> DataFrame:
    """P4: "ends": first, middle and last frame; "late": the tenth, middle and last."""
    last = cells.groupBy(F.col("run_id").alias("__run")).agg((F.max("t") + 1).alias("__n"))
    first = F.lit(0) if spec == "ends" else F.expr("__n div 10")
    wanted = F.array_contains(F.array(first.cast("int"), F.expr("__n div 2").cast("int"), (F.col("__n") - 1).cast("int")), F.col("t").cast("int"))
    return cells.join(last, cells["run_id"].eqNullSafe(last["__run"])).filter(wanted).drop("__run", "__n")


def sample_frames(cells: DataFrame, every: int) -> DataFrame:
    """IO6: every m-th frame, for export."""
    return cells.filter(F.col("t") % every == 0)


def frame_diff(a: DataFrame, b: DataFrame, limit: float = 1e-16) -> DataFrame:
    """Largest absolute difference of two computations per frame, how many cells one side lacks, and whether the frames differ: if the difference
    reaches limit, is no number, or any cell is lacking."""
    worst = error_by_frame(compare_fields(a, b))
    return worst.withColumn("differs", (F.col("lacking") > 0) | F.coalesce(F.col("max_error") >= limit, F.lit(True)))


def tile_digests(cells: DataFrame, bs: int) -> DataFrame:
    """A digest for each tile of cells (run_id, t, bi, bj): sums of two hashes of its cells' keys and values, whatever their order, and their
    number. One partial aggregation: a row a tile is shuffled. Equal values have equal digests (-0.0 is 0.0, a NaN any other)."""
    value = F.when(F.col("value") == 0, F.lit(0.0)).otherwise(F.col("value"))
    parts = ["v", "i", "j", value.isNull(), value]
    number = lambda salt: F.sum(F.shiftright(F.xxhash64(F.lit(salt), *parts), 24))  # noqa: E731  40 bits: sums of 2^23 cells are exact
    tile = [F.expr(f"CAST(floor({c} / {bs}) AS int)").alias(f"b{c}") for c in "ij"]
    return cells.groupBy("run_id", "t", *tile).agg(number(1).alias("d1"), number(2).alias("d2"), F.count("*").alias("cells"))


def differing_tiles(a: DataFrame, b: DataFrame, bs: int) -> DataFrame:
    """run_id, t, bi, bj of the tiles whose digests differ or which one side lacks: both sides' digests meet in one grouping."""
    both = tile_digests(a, bs).withColumn("side", F.lit(1)).unionByName(tile_digests(b, bs).withColumn("side", F.lit(-1)))
    met = both.groupBy("run_id", "t", "bi", "bj").agg(*(F.sum(F.col(c) * F.col("side")).alias(c) for c in ("d1", "d2", "cells")), F.sum("side").alias("side"))
    return met.filter("d1 <> 0 OR d2 <> 0 OR cells <> 0 OR side <> 0").select("run_id", "t", "bi", "bj")


FEW_TILES = 100_000  # keys of some dozen bytes that are broadcast


def differing_cells(a: DataFrame, b: DataFrame, bs: int = 64) -> DataFrame:
    """A3, G11 without a join of all cells: those (run_id, t, v, i, j, a, b) that differ or that one side lacks. Equal frames exchange
    digests of tiles alone; only the cells of differing tiles are compared."""
    tiles = cut_lineage(differing_tiles(a, b, bs).withColumnsRenamed({c: f"__{c}" for c in ("run_id", "t", "bi", "bj")}))
    few = tiles.limit(FEW_TILES + 1).count() <= FEW_TILES

    def inside(cells):
        tile = lambda c: F.expr(f"CAST(floor({c} / {bs}) AS int)")
        same = F.col("run_id").eqNullSafe(F.col("__run_id")) & F.col("t").eqNullSafe(F.col("__t")) & tile("i").eqNullSafe(F.col("__bi")) & tile("j").eqNullSafe(F.col("__bj"))
        return cells.join(F.broadcast(tiles) if few else tiles, same, "left_semi")

    compared = compare_fields(inside(a), inside(b))
    return compared.filter(~F.col("a").eqNullSafe(F.col("b")) | _lacking())


def frame_digests(cells: DataFrame, bs: int = 64) -> DataFrame:
    """The tree's next level: run_id, t, digest (hexadecimal) of each frame, from its tiles' digests."""
    one = F.shiftright(F.xxhash64("bi", "bj", "d1", "d2", "cells"), 24)
    return tile_digests(cells, bs).groupBy("run_id", "t").agg(F.hex(F.sum(one)).alias("digest"), F.sum("cells").alias("cells"))


def restrict(cells: DataFrame, factor: int, how: str = "mean") -> DataFrame:
    """Coarsens a grid by a factor: means of blocks of factor x factor cells ("mean"), or the first cell of each block ("inject"), which is the one at the same
    place if grids begin at the same point. A block that lacks a cell, or the cell, is lacking. One partial aggregation, or none."""
    small = [F.expr(f"CAST({c} div {factor} AS int)").alias(c) for c in "ij"]
    if how == "inject":
        return cells.filter((F.col("i") % factor == 0) & (F.col("j") % factor == 0)).select("run_id", "t", "v", *small, "value")
    whole = cells.select("run_id", "t", "v", *small, "value").groupBy("run_id", "t", "v", "i", "j").agg(F.count("value").alias("__n"), F.avg("value").alias("value"))
    return whole.filter(F.col("__n") == factor * factor).drop("__n")


def observed_order(coarse: DataFrame, middle: DataFrame, fine: DataFrame, factor: int = 2, how: str = "inject") -> DataFrame:
    """A10 without a closed form, from three grids, each finer by a factor than the one before: run_id, t, order = log(|coarse - middle| / |middle - fine|) /
    log(factor), with the largest differences over the coarse grid's cells. A run whose differences vanish has no order."""
    worst = lambda a, b, name: compare_fields(a, b).groupBy(F.col("run_id").alias(f"{name}_run"), F.col("t").alias(f"{name}_t")).agg(F.max(F.abs(F.col("a") - F.col("b"))).alias(name))
    first = worst(coarse, restrict(middle, factor, how), "outer")
    second = worst(restrict(middle, factor, how), restrict(fine, factor * factor, how), "inner")
    met = first.join(second, F.col("outer_run").eqNullSafe(F.col("inner_run")) & F.col("outer_t").eqNullSafe(F.col("inner_t")))
    ratio = F.when((F.col("outer") > 0) & (F.col("inner") > 0), F.log(F.col("outer") / F.col("inner")) / F.log(F.lit(float(factor))))
    return met.select(F.col("outer_run").alias("run_id"), F.col("outer_t").alias("t"), "outer", "inner", ratio.alias("order"))
