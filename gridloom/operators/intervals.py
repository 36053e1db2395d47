"""Range joins: values to the intervals that hold them, by bins of equal numbers of values."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage

BINS, ROWS_A_SALT, FEW = 1024, 200_000, 100_000
CLOSED = {"neither": (">", "<"), "left": (">=", "<"), "right": (">", "<="), "both": (">=", "<=")}


def _inside(x: Column, low: Column, high: Column, closed: str) -> Column:
    """An end that is null is open to all values."""
    above, below = CLOSED[closed]
    lower = x > low if above == ">" else x >= low
    upper = x < high if below == "<" else x <= high
    return (low.isNull() | lower) & (high.isNull() | upper)


def classify_intervals(df: DataFrame, bounds: DataFrame, value: str = "x", keys: tuple[str, ...] = ("run_id", "t"), closed: str = "neither", bins: int = BINS, rows_a_salt: int = ROWS_A_SALT) -> DataFrame:
    """Rows of df with the columns of the intervals (bounds: keys, low, high, others) that hold ``value``, a row for each; nulls where
    there is none. Keys are equal, nulls among them; a null end is open; ``closed`` says which ends belong to an interval (neither: a value on a
    bound is in no interval). A value that is null or no number is in none, an interval whose low is above its high holds none.

    Both sides are cut into bins of about equal numbers of values (approximate quantiles: ``bins`` numbers on the driver) and meet
    on keys and bin, so that there is no nested loop over all intervals: an interval stands in the bins that it overlaps, ``bins`` at most.
    A bin with many rows of one key is dealt over salts, at which its intervals are repeated; other rows and intervals have one."""
    ends = df.select(F.percentile_approx(F.when(~F.isnan(value), F.col(value)), [k / bins for k in range(1, bins)], 10 * bins)).first()[0] or []
    cuts = sorted({float(e) for e in ends if abs(e) != float("inf")}) or [0.0]
    splits = [-float("inf"), *cuts, float("inf")]

    def binned(rows, column, name):
        return Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="keep").transform(rows)

    taken = {c: f"__bound_{c}" for c in bounds.columns}
    others = [c for c in bounds.columns if c not in (*keys, "low", "high")]
    if set(others) & set(df.columns):
        raise ValueError(f"both sides have {sorted(set(others) & set(df.columns))}")
    points = binned(df.withColumn("__x", F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))), "__x", "__bin").withColumn("__bin", F.col("__bin").cast("int"))
    ranges = bounds.withColumn("__from", F.coalesce(F.col("low").cast("double"), F.lit(-float("inf")))).withColumn("__to", F.coalesce(F.col("high").cast("double"), F.lit(float("inf"))))
    ranges = binned(binned(ranges.filter("NOT isnan(__from) AND NOT isnan(__to) AND __from <= __to"), "__from", "__b0"), "__to", "__b1").withColumnsRenamed(taken)
    ranges = ranges.withColumn("__bin", F.explode(F.sequence(F.col("__b0").cast("int"), F.col("__b1").cast("int")))).drop("__b0", "__b1", "__from", "__to")
    # hot bins of a key
    counted = points.groupBy(*(F.col(k).alias(f"__hot_{k}") for k in keys), F.col("__bin").alias("__hot_bin")).agg(F.count("*").alias("__rows"))
    hot = cut_lineage(counted.filter(F.col("__rows") > rows_a_salt).withColumn("__salts", F.ceil(F.col("__rows") / rows_a_salt).cast("int")).drop("__rows"))
    number = hot.limit(FEW + 1).count()

    def salted(rows, names, place):
        if not number:
            return rows.withColumn("__salt", F.lit(0))
        same = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"__hot_{k}")) for n, k in zip(names, keys)), F.col("__bin") == F.col("__hot_bin"))
        out = rows.join(F.broadcast(hot) if number <= FEW else hot, same, "left")
        return out.withColumn("__salt", place(F.coalesce("__salts", F.lit(1)))).drop("__salts", "__hot_bin", *(f"__hot_{k}" for k in keys))

    plain = [c for c, kind in df.dtypes if not kind.startswith("map")]
    points = salted(points, keys, lambda n: F.pmod(F.xxhash64(*plain), n).cast("int"))
    ranges = salted(ranges, [taken[k] for k in keys], lambda n: F.explode(F.sequence(F.lit(0), n - 1)))
    points = points.withColumnsRenamed({"__bin": "__p_bin", "__salt": "__p_salt"})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(taken[k])) for k in keys), (F.col("__p_bin") == F.col("__bin")) & (F.col("__p_salt") == F.col("__salt")))
    holds = ~F.isnan("__x") & _inside(F.col("__x"), F.col(taken["low"]), F.col(taken["high"]), closed)
    joined = points.join(ranges, same & holds, "left")
    return joined.select(*df.columns, F.col(taken["low"]).alias("low"), F.col(taken["high"]).alias("high"), *(F.col(taken[c]).alias(c) for c in others))
