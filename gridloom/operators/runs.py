"""Run-log analytics: records of timed runs to clean, paired and summarised tables.

Records: run_ts, hardware, cpu, swept, array_shape, blocksize, share, runtime, time_per_step ...
Features: hardware, equation, mode, size, block, share, runtime, time_per_step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import effective_share, lookup, multi_step_frames, standard_frames
from ..functions.session import cut_lineage

CONFIG = ("size", "block", "share")
# What a run's configuration has where a field is missing.
DEFAULTS = {"swept": True, "filename": "output.hdf5", "verbose": False, "blocksize": 32, "share": 0.9, "dtype": "float64", "intermediate_steps": 1, "operating_points": 1, "cpu": "", "gpu": ""}


def union_logs(**by_hardware: DataFrame) -> DataFrame:
    """Logs with the hardware they come from; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("hardware", F.lit(name)) for name, df in by_hardware.items()])


def upsert_log(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """IO4: all entries; of those with equal keys a new one replaces the old one. Of several new ones, or several
    old ones, the one whose fields have the least hash stays."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    plain = [c for c, kind in both.dtypes if not kind.startswith("map")]
    kept = Window.partitionBy(*key).orderBy(F.col("__new").desc(), F.xxhash64(*plain), *(F.col(c).isNull() for c in plain))
    return both.withColumn("__n", F.row_number().over(kept)).filter("__n = 1").drop("__n", "__new")


def with_config_defaults(df: DataFrame) -> DataFrame:
    """IO5: null or missing fields get their defaults."""
    for name, value in DEFAULTS.items():
        df = df.withColumn(name, F.coalesce(name, F.lit(value)) if name in df.columns else F.lit(value))
    for name, kind in (("globals", "array<double>"), ("exid", "array<int>")):
        df = df.withColumn(name, F.coalesce(name, F.array().cast(kind)) if name in df.columns else F.array().cast(kind))
    return df


def config_field(config_map: Column, key: str, kind: str) -> Column:
    """A field of a text map, cast, or its default."""
    return lookup(config_map, key, str(DEFAULTS[key]).lower()).cast(kind)


def log_features(df: DataFrame) -> DataFrame:
    """P1."""
    return df.withColumn("mode", F.col("swept").cast("int")).withColumn("size", F.try_element_at("array_shape", F.lit(3)).cast("double")).withColumn("block", F.col("blocksize").cast("double")).withColumn("share", F.col("share").cast("double"))


def filter_equation(df: DataFrame, name: str) -> DataFrame:
    """P2."""
    return df.filter(F.col("cpu").contains(name))


def with_time_per_step(df: DataFrame) -> DataFrame:
    """P3."""
    return df.withColumn("time_per_step", F.try_divide(F.col("runtime"), (F.try_element_at("array_shape", F.lit(1)) - 1).cast("double")))


def validate_config(df: DataFrame) -> DataFrame:
    """Ok and the reasons if not (blocksize, operating_points, variables, nx, ny)."""
    block_bad = F.when(F.col("blocksize") % (2 * F.col("operating_points")) != 0, "block is no multiple of the stencil")
    grid_bad = F.when((F.col("variables") * F.col("nx") * F.col("ny")) % (F.col("blocksize") * F.col("blocksize")) != 0, "grid has no whole blocks")
    return df.withColumn("reasons", F.array_compact(F.array(block_bad, grid_bad))).withColumn("ok", F.size("reasons") == 0)


def check_frame_counts(df: DataFrame) -> DataFrame:
    """Expected frames (mode, t0, tf, dt, steps, block, ops, stages) against the logged ones."""
    several = multi_step_frames(F.col("steps"), F.col("block"), F.col("ops"), F.col("stages"))
    expected = F.when(F.col("mode") == 1, several).otherwise(standard_frames(F.col("t0"), F.col("tf"), F.col("dt")))
    return df.withColumn("expected", expected).withColumn("agrees", F.col("expected") == F.col("frames"))


def dedupe_runs(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first run of each configuration; order should leave no ties."""
    first = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def pair_runs(df: DataFrame, key: list[str], metrics: list[str], mode: str = "mode", first: int = 0, second: int = 1) -> DataFrame:
    """Configurations run in both modes, with speedup_<metric> = first / second. Both are
    met by one grouping instead of a self-join; df has one run for each key and mode."""
    of = lambda m, which: F.max(F.when(F.col(mode) == which, F.col(m)))
    met = df.groupBy(*key).agg(*(of(m, first).alias(f"__a_{m}") for m in metrics), *(of(m, second).alias(f"__b_{m}") for m in metrics), F.bool_or(F.col(mode) == first).alias("__first"), F.bool_or(F.col(mode) == second).alias("__second"))
    return met.filter("__first AND __second").select(*key, *(F.try_divide(f"__a_{m}", f"__b_{m}").alias(f"speedup_{m}") for m in metrics))


def pair_first_runs(df: DataFrame, key: list[str], metrics: list[str], order: list[str], mode: str = "mode", first: int = 0, second: int = 1) -> DataFrame:
    """W1 and J1 in one grouping: the first run of each mode and configuration, and their
    speedups. Partial minima on the map side, one shuffle, no sort."""
    early = lambda m, which: F.min_by(F.when(F.col(mode) == which, F.col(m)), F.when(F.col(mode) == which, F.struct(*order)))
    met = df.groupBy(*key).agg(*(early(m, first).alias(f"__a_{m}") for m in metrics), *(early(m, second).alias(f"__b_{m}") for m in metrics), F.bool_or(F.col(mode) == first).alias("__first"), F.bool_or(F.col(mode) == second).alias("__second"))
    return met.filter("__first AND __second").select(*key, *(F.try_divide(f"__a_{m}", f"__b_{m}").alias(f"speedup_{m}") for m in metrics))


def pair_hardware(a: DataFrame, b: DataFrame, key: list[str], metric: str) -> DataFrame:
    """Ratio of the metric on two kinds of hardware; nulls in keys equal nulls."""
    left = a.select(*key, F.col(metric).alias("__a"))
    right, same = _same(left, b.select(*key, F.col(metric).alias("__b")), key)
    return left.join(right, same).select(*key, F.try_divide("__a", "__b").alias("ratio"))


def missing_configs(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Size, block, share of expected ones that were not run (missing) and runs that were not
    expected (unexpected). One grouping of both sides; nulls are values like others."""
    tagged = lambda df, e: df.select("size", "block", F.round("share", 5).alias("share"), F.lit(e).alias("__e"))
    met = tagged(expected, True).unionByName(tagged(actual, False)).groupBy(*CONFIG).agg(F.bool_or("__e").alias("__some"), F.bool_and("__e").alias("__all"))
    return met.filter("__some = __all").select(*CONFIG, F.when(F.col("__all"), "missing").otherwise("unexpected").alias("state"))


MOST = 10_000_000  # configurations
FEW = 100_000  # groups or targets that are broadcast


def config_matrix(sizes: DataFrame, modes: DataFrame, blocks: DataFrame, shares: DataFrame, most: int = MOST) -> DataFrame:
    """All combinations, with the effective share, each once. The inputs are short lists: more than ``most`` combinations are an error."""
    lists = [cut_lineage(df) for df in (sizes, modes, blocks, shares)]
    number = reduce(lambda n, df: n * df.count(), lists, 1)
    if number > most:
        raise ValueError(f"{number} configurations are more than {most}")
    every = reduce(DataFrame.crossJoin, lists)
    return every.withColumn("share", effective_share(F.col("share"), F.col("size"), F.col("block"))).distinct()


def config_counts(matrix: DataFrame) -> DataFrame:
    """Distinct shares of each size and block, and the rows of a size's blocks up to it."""
    per = matrix.groupBy("size", "block").agg(F.count_distinct("share").alias("shares"))
    up_to = Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("rows_to", F.sum("shares").over(up_to))


def speedup_summary(pairs: DataFrame, by: list[str], metric: str) -> DataFrame:
    """A5."""
    return pairs.groupBy(*by).agg(F.min(metric).alias("lowest"), F.max(metric).alias("highest"), F.avg(metric).alias("mean"))


def _same(left: DataFrame, right: DataFrame, columns) -> tuple[DataFrame, Column]:
    """right with its key columns renamed, and the condition that they equal left's; nulls equal nulls."""
    renamed = right.withColumnsRenamed({c: f"__right_{c}" for c in columns})
    return renamed, reduce(lambda a, b: a & b, (left[c].eqNullSafe(renamed[f"__right_{c}"]) for c in columns), F.lit(True))


def best_worst(df: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Rows with the greatest (best) and the least (worst) metric of each group, ties
    included; a null in ``by`` is a group. Extremes by partial aggregation, then a join, not a window."""
    df = cut_lineage(df.select("*"))  # read twice
    ends = cut_lineage(df.groupBy(*by).agg(F.max(metric).alias("__best"), F.min(metric).alias("__worst")))
    ends, same = _same(df, F.broadcast(ends) if ends.limit(FEW + 1).count() <= FEW else ends, by)
    which = F.array_compact(F.array(F.when(F.col(metric) == F.col("__best"), "best"), F.when(F.col(metric) == F.col("__worst"), "worst")))
    return df.join(ends, same).withColumn("which", F.explode(which)).select(*df.columns, "which")


def occurrence_share(df: DataFrame, col: str, targets: DataFrame, by: list[str] = ()) -> DataFrame:
    """Percent of rows at each target value, 0 for absent ones. targets has the column col; a null in ``by`` is a
    group, a null target counts rows without a value. There is a row for each group and target: targets are a list of FEW at most, else that is an error."""
    targets = cut_lineage(targets.select(col))
    if targets.limit(FEW + 1).count() > FEW:
        raise ValueError(f"more than {FEW} targets")
    counts = df.groupBy(*by, col).agg(F.count("*").alias("__n"))
    totals = counts.groupBy(*by).agg(F.sum("__n").alias("__total")) if by else counts.agg(F.sum("__n").alias("__total"))
    asked = totals.crossJoin(F.broadcast(targets))
    counts, same = _same(asked, counts, [*by, col])
    return asked.join(counts, same, "left").select(*by, col, (F.lit(100.0) * F.coalesce("__n", F.lit(0)) / F.col("__total")).alias("percent"))


def data_limits(df: DataFrame, col: str, n: int) -> DataFrame:
    """N even points between the limits, which are rounded outward to 0.1."""
    ends = df.agg((F.floor(F.min(col) * 10) / 10).alias("low"), (F.ceil(F.max(col) * 10) / 10).alias("high"))
    return ends.select("low", "high", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).withColumn("point", F.col("low") + (F.col("high") - F.col("low")) * F.col("k") / (n - 1))


def linreg(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """A9."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"), F.regr_r2(y, x).alias("r2"))


ROWS = 200_000  # of a range, numbered by a task


def _numbered(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df with __k, a row's place in its group from 0, and __total, the group's rows. Rows are dealt into ranges (by their number) by keys and
    all of order and numbered within each range; counts of ranges give the offsets, so that no task sees a whole group.
    ``order`` should leave no ties."""
    parts = parts or -(-df.count() // ROWS) or 1
    ranged = cut_lineage(df.repartitionByRange(parts, *keys, *order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))  # as many rows as groups and ranges
    group = Window.partitionBy(*keys)
    before = counts.withColumn("__before", F.sum("__n").over(group.orderBy("__part")) - F.col("__n")).withColumn("__total", F.sum("__n").over(group)).drop("__n")
    placed = ranged.withColumn("__k", F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order)) - 1)
    before, same = _same(placed, before, [*keys, "__part"])
    return placed.join(before, same).withColumn("__k", F.col("__k") + F.col("__before")).select(*df.columns, "__k", "__total")


def _chunk(k: Column, total: Column, n: int) -> Column:
    """Chunk of place k, where the first chunks are the larger ones."""
    small, large = F.floor(total / n), total % n
    first = large * (small + 1)
    return (F.when(k < first, F.floor(k / (small + 1))).otherwise(large + F.floor((k - first) / F.greatest(small, F.lit(1)))) + 1).cast("int")


def split_balanced(df: DataFrame, n: int, keys: list[str], order: list[str], larger: str = "first", parts: int | None = None) -> DataFrame:
    """N contiguous chunks of each group's ordered rows; sizes differ by one at most."""
    k, total = F.col("__k"), F.col("__total")
    chunk = _chunk(k, total, n) if larger == "first" else n + 1 - _chunk(total - 1 - k, total, n)
    return _numbered(df, keys, order, parts).withColumn("chunk", chunk).drop("__k", "__total")


def split_balanced_globally(df: DataFrame, n: int, order: list[str], parts: int | None = None) -> DataFrame:
    """W4 without groups."""
    return split_balanced(df, n, [], order, parts=parts)


def share_split(df: DataFrame, share: float, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """The first ceil(rows * share) rows of each group go to part A, the rest to B."""
    cut = F.ceil(F.col("__total") * share)
    return _numbered(df, keys, order, parts).withColumn("part", F.when(F.col("__k") < cut, "A").otherwise("B")).withColumn("effective", cut / F.col("__total")).drop("__k", "__total")


def sort_runs(df: DataFrame) -> DataFrame:
    """T1."""
    return df.orderBy("mode", "size", "block", "share")
