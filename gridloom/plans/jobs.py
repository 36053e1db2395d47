"""Whole jobs: evolve a grid, validate its frames, study run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators import compare, evolve, grid, runs
from ..operators.kernels import TileKernel
from ..sources import io


def evolve_grid(cells: DataFrame, meta: DataFrame, out: str, nx: int, ny: int, bs: int, kernel: TileKernel, steps: int, k: int = 1, params: dict | None = None, variables: int = 1, rounds_a_write: int = 4) -> None:
    """Tiles, steps, frames: writes the frame after every round of k steps, rounds_a_write rounds at
    a time; each batch starts from frames that are already written, so that a failure repeats one
    batch and plans stay short."""
    spark = cells.sparkSession
    tiles, done, part = grid.to_tiles(cells, nx, ny, bs, variables), 0, 0
    tiles.write.mode("overwrite").parquet(f"{out}/tiles/part=0")
    while done < steps:
        now = min(k * rounds_a_write, steps - done)
        frames = evolve.evolve(spark.read.parquet(f"{out}/tiles/part={part}").filter(f"t = {done}"), nx, ny, bs, kernel, now, k, params, save_every_round=True)
        done, part = done + now, part + 1
        frames.filter(f"t > {done - now}").write.mode("overwrite").parquet(f"{out}/tiles/part={part}")
    io.write_frames(grid.to_cells(spark.read.parquet(f"{out}/tiles").drop("part"), bs), meta, out)


def validate_frames(spark: SparkSession, path: str, reference: DataFrame | Column, rtol: float = 1e-5, atol: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """Errors of each run and its verdict, against a closed form or other frames."""
    compared = compare.compare_fields(io.read_frames(spark, path)[0], reference)
    verdict = compare.run_verdict(compare.allclose_verdict(compared, rtol, atol))
    return compare.error_summary(compared), verdict


def study_logs(log: DataFrame, order: list[str], by: tuple[str, ...] = ("hardware", "equation")) -> dict[str, DataFrame]:
    """Pairs, best and worst configurations, summaries and slopes of features (mode, size, block,
    share, runtime, time_per_step and the columns of by). Pairs take one exchange."""
    config = [*by, "size", "block", "share"]
    first = runs.dedupe_runs(log, [*config, "mode"], order)
    pairs = runs.pair_first_runs(log, config, ["runtime", "time_per_step"], order)
    return {
        "pairs": pairs,
        "best_worst": runs.best_worst(pairs, [*by, "size"], "speedup_time_per_step"),
        "summary": runs.speedup_summary(pairs, [*by, "size"], "speedup_time_per_step"),
        "slopes": runs.linreg(first, "time_per_step", "size", [*by, "mode"]),
    }
