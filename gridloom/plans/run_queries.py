"""Run-log queries, on lineitem read as a log of runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.session import table
from ..operators import runs

KEY = ["mode", "size", "block", "share"]
CONFIG = ["size", "block", "share"]
ORDER = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "runtime"]


def log(spark, sf_dir):
    """A record for each line: mode by its status, configuration from its keys."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        (c("l_linestatus") == "O").cast("int").alias("mode"), c("l_linenumber").cast("double").alias("size"), (c("l_suppkey") % 6).cast("double").alias("block"), c("l_discount").alias("share"),
        c("l_extendedprice").alias("runtime"), c("l_quantity").alias("frames"), "l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag",
    )


LOG = """log AS (SELECT (l_linestatus = 'O')::INT AS mode, l_linenumber::DOUBLE AS size, (l_suppkey % 6)::DOUBLE AS block, l_discount AS share, l_extendedprice AS runtime, l_quantity AS frames,
  l_shipdate, l_orderkey, l_partkey, l_suppkey, l_returnflag FROM lineitem)"""
FIRST = """, firsts AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY mode, size, block, share ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, runtime) AS rn FROM log) WHERE rn = 1)"""
PAIRS = """, pairs AS (SELECT a.size, a.block, a.share, a.runtime / b.runtime AS speedup_runtime, a.frames / b.frames AS speedup_frames FROM firsts a JOIN firsts b
  ON a.size = b.size AND a.block = b.block AND a.share = b.share AND a.mode = 0 AND b.mode = 1)"""


def firsts(spark, sf_dir):
    return runs.dedupe_runs(log(spark, sf_dir), KEY, ORDER)


def pairs(spark, sf_dir):
    """First runs and pairs in one exchange."""
    return runs.pair_first_runs(log(spark, sf_dir), CONFIG, ["runtime", "frames"], ORDER)


def _dedupe(spark, sf_dir):
    return firsts(spark, sf_dir).select(*KEY, "runtime", "l_orderkey")


def _features(spark, sf_dir):
    """Records as the log has them, with arrays; features and time per step follow."""
    c = F.col
    raw = table(spark, sf_dir, "lineitem").select(
        (c("l_linestatus") == "O").alias("swept"), F.array(c("l_quantity").cast("int"), F.lit(1), c("l_linenumber") * 160, c("l_linenumber") * 160).alias("array_shape"),
        (c("l_suppkey") % 6).alias("blocksize"), c("l_discount").alias("share"), c("l_extendedprice").alias("runtime"), F.concat(F.lit("kernels/"), c("l_returnflag"), F.lit(".py")).alias("cpu"), "l_orderkey",
    )
    out = runs.with_time_per_step(runs.log_features(runs.filter_equation(raw, "kernels/R")))
    return out.select("l_orderkey", "mode", "size", "block", "share", "runtime", "time_per_step")


def _upsert(spark, sf_dir):
    """The last runs of 1998 and later replace the earlier ones of an order's part."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", (F.col("l_shipdate") >= "1998-01-01").alias("new")).agg(F.max("l_extendedprice").alias("runtime"))
    return runs.upsert_log(lines.filter(~F.col("new")).drop("new"), lines.filter("new").drop("new"), ["l_orderkey", "l_linenumber"])


def _hardware(spark, sf_dir):
    by = lambda flag: firsts_of(spark, sf_dir, flag)
    return runs.pair_hardware(by("A"), by("R"), KEY, "runtime")


def firsts_of(spark, sf_dir, flag):
    return runs.dedupe_runs(log(spark, sf_dir).filter(F.col("l_returnflag") == flag), KEY, ORDER)


def _union(spark, sf_dir):
    logs = runs.union_logs(old=log(spark, sf_dir).filter("l_returnflag = 'A'"), new=log(spark, sf_dir).filter("l_returnflag = 'R'").drop("frames"))
    return logs.groupBy("hardware").agg(F.count("*").alias("n"), F.count("frames").alias("with_frames"))


def _matrix(spark, sf_dir):
    base = log(spark, sf_dir)
    sizes, blocks = base.select((F.col("size") * 160).alias("size")).distinct(), base.select((F.col("block") * 4 + 8).alias("block")).distinct()
    return runs.config_matrix(sizes, base.select("mode").distinct(), blocks, base.select((F.col("share") * 10).alias("share")).distinct())


MATRIX = """m AS (SELECT DISTINCT a.size, b.mode, c.block, ceil(round(d.share * ceil(a.size / c.block), 5)) / ceil(a.size / c.block) AS share FROM (SELECT DISTINCT size * 160 AS size FROM log) a,
  (SELECT DISTINCT mode FROM log) b, (SELECT DISTINCT block * 4 + 8 AS block FROM log) c, (SELECT DISTINCT share * 10 AS share FROM log) d)"""


def _missing(spark, sf_dir):
    """Expected: all combinations; actual: what lines of large quantity show, with a stray block."""
    base = log(spark, sf_dir)
    every = base.select("size").distinct().crossJoin(base.select("block").distinct()).crossJoin(base.select("share").distinct())
    actual = base.filter("frames > 45 AND runtime > 60000").withColumn("block", F.when(F.col("runtime") > 90000, 77.0).otherwise(F.col("block")))
    return runs.missing_configs(every, actual)


def _occurrence(spark, sf_dir):
    targets = spark.range(0, 12).select((F.col("id") / 100).alias("share"))
    return runs.occurrence_share(log(spark, sf_dir).withColumn("share", F.round("share", 2)), "share", targets, ["mode"]).withColumn("percent", F.round("percent", 9))


def _split(larger):
    def query(spark, sf_dir):
        out = runs.split_balanced(log(spark, sf_dir), 7, ["mode"], ORDER, larger)
        return out.groupBy("mode", "chunk").agg(F.count("*").alias("n"), F.min("l_shipdate").cast("string").alias("begin"))

    return query


def _split_globally(spark, sf_dir):
    out = runs.split_balanced_globally(table(spark, sf_dir, "orders"), 7, ["o_orderkey"])
    return out.groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


def _share_split(spark, sf_dir):
    out = runs.share_split(log(spark, sf_dir), 0.3, ["mode", "size"], ORDER)
    return out.groupBy("mode", "size", "part").agg(F.count("*").alias("n"), F.round(F.max("effective"), 9).alias("effective"))


def _validate(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 9 + 4).alias("blocksize"), (F.col("p_partkey") % 2 + 1).alias("operating_points"), F.lit(1).alias("variables"), (F.col("p_size") * 8).alias("nx"), F.lit(64).alias("ny"))
    out = runs.validate_config(p)
    return out.select("p_partkey", "ok", F.array_join("reasons", "; ").alias("reasons"), scalars.pad_size(F.col("nx"), F.col("blocksize")).cast("long").alias("padded"))


def _frame_counts(spark, sf_dir):
    """Frames that runs of each size and block should have; blocks and steps from parts."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 2).alias("mode"), F.lit(0.0).alias("t0"), (F.col("p_size") * 1.0).alias("tf"), F.lit(0.125).alias("dt"), (F.col("p_size") * 10 + 100).alias("steps"), (F.col("p_partkey") % 4 * 4 + 8).alias("block"), F.lit(1).alias("ops"), F.lit(2).alias("stages"), (F.col("p_size") * 8 + 1).alias("frames"))
    return runs.check_frame_counts(p).select("p_partkey", "mode", "expected", "agrees")


def _scalars(spark, sf_dir):
    """Texts, time stamps, shares and step sizes of orders."""
    o = table(spark, sf_dir, "orders")
    text = F.element_at(F.array(*map(F.lit, ("Yes", "NO", "t", "0", "maybe"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    stamp = scalars.format_stamp(F.col("o_orderdate"))
    share = (F.col("o_custkey") % 100) / 100
    config = F.create_map(F.lit("blocksize"), F.when(F.col("o_custkey") % 3 == 0, F.lit("16")))
    return o.select(
        "o_orderkey",
        scalars.text_to_boolean(text).cast("int").alias("flag"),
        stamp.alias("stamp"),
        (scalars.parse_stamp(stamp) == F.col("o_orderdate")).alias("parsed"),
        scalars.rounded_share((F.col("o_custkey") % 8) / 8).alias("tenths"),
        F.round(scalars.effective_share(share, F.lit(160), F.lit(12)), 9).alias("share"),
        F.round(scalars.heat_step(F.col("o_custkey") % 50 + 2, F.lit(2.0), True), 12).alias("heat_dt"),
        F.round(scalars.euler_step_size(F.col("o_custkey") % 50 + 2), 12).alias("euler_dt"),
        runs.config_field(config, "blocksize", "int").alias("block"),
        scalars.run_summary(F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 32, share, F.round("o_totalprice")).alias("summary"),
    )


def _defaults(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", False).alias("swept"), F.when(F.col("o_custkey") % 2 == 0, (F.col("o_custkey") % 64).cast("int")).alias("blocksize"))
    return runs.with_config_defaults(o).select("o_orderkey", "swept", "blocksize", "share", "operating_points", "filename", F.size("globals").alias("n_globals"))


def _linreg(spark, sf_dir):
    return runs.linreg(log(spark, sf_dir), "runtime", "frames", ["mode", "size"]).select("mode", "size", *(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r", "r2")))


def _sorted(spark, sf_dir):
    out = runs.sort_runs(firsts(spark, sf_dir)).select(*KEY, "runtime")
    return out.withColumn("before", F.lag("runtime").over(Window.partitionBy("mode", "size").orderBy("block", "share")))


QUERIES = {
    "run_features": _features,
    "run_dedupe": _dedupe,
    "run_sorted": _sorted,
    "run_pairs": pairs,
    "run_pairs_of_firsts": lambda s, d: runs.pair_runs(firsts(s, d), CONFIG, ["runtime", "frames"]),
    "run_hardware_pairs": _hardware,
    "run_union": _union,
    "run_upsert": _upsert,
    "run_defaults": _defaults,
    "speedup_summary": lambda s, d: runs.speedup_summary(pairs(s, d), ["size"], "speedup_runtime").withColumn("mean", F.round("mean", 9)),
    "best_worst": lambda s, d: runs.best_worst(pairs(s, d), ["size"], "speedup_frames"),
    "occurrence_share": _occurrence,
    "data_limits": lambda s, d: runs.data_limits(pairs(s, d), "speedup_frames", 11).withColumn("point", F.round("point", 9)),
    "linreg": _linreg,
    "config_matrix": _matrix,
    "config_counts": lambda s, d: runs.config_counts(_matrix(s, d)),
    "missing_configs": _missing,
    "split_balanced": _split("first"),
    "split_balanced_last": _split("last"),
    "split_globally": _split_globally,
    "share_split": _share_split,
    "config_validate": _validate,
    "frame_counts": _frame_counts,
    "scalar_functions": _scalars,
}


def _ntile_sql(larger: str) -> str:
    order = "l_shipdate {0}, l_orderkey {0}, l_partkey {0}, l_suppkey {0}, runtime {0}".format("" if larger == "first" else "DESC")
    tile = f"ntile(7) OVER (PARTITION BY mode ORDER BY {order})"
    return f"WITH {LOG}, s AS (SELECT mode, l_shipdate, ({tile if larger == 'first' else f'8 - {tile}'})::INT AS chunk FROM log) SELECT mode, chunk, count(*) AS n, strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') AS \"begin\" FROM s GROUP BY ALL"


ORACLES = {
    "run_features": "SELECT l_orderkey, (l_linestatus = 'O')::INT AS mode, (l_linenumber * 160)::DOUBLE AS size, (l_suppkey % 6)::DOUBLE AS block, l_discount AS share, l_extendedprice AS runtime, CASE WHEN l_quantity::INT > 1 THEN l_extendedprice / (l_quantity::INT - 1) END AS time_per_step FROM lineitem WHERE l_returnflag = 'R'",
    "run_dedupe": f"WITH {LOG}{FIRST} SELECT mode, size, block, share, runtime, l_orderkey FROM firsts",
    "run_sorted": f"WITH {LOG}{FIRST} SELECT mode, size, block, share, runtime, lag(runtime) OVER (PARTITION BY mode, size ORDER BY block, share) AS before FROM firsts",
    "run_pairs": f"WITH {LOG}{FIRST}{PAIRS} SELECT * FROM pairs",
    "run_pairs_of_firsts": f"WITH {LOG}{FIRST}{PAIRS} SELECT * FROM pairs",
    "run_hardware_pairs": f"WITH {LOG}, f AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY l_returnflag, mode, size, block, share ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, runtime) = 1) SELECT a.mode, a.size, a.block, a.share, a.runtime / b.runtime AS ratio FROM f a JOIN f b ON a.mode = b.mode AND a.size = b.size AND a.block = b.block AND a.share = b.share AND a.l_returnflag = 'A' AND b.l_returnflag = 'R'",
    "run_union": f"WITH {LOG} SELECT CASE l_returnflag WHEN 'A' THEN 'old' ELSE 'new' END AS hardware, count(*) AS n, count(CASE WHEN l_returnflag = 'A' THEN frames END) AS with_frames FROM log WHERE l_returnflag IN ('A', 'R') GROUP BY 1",
    "run_upsert": "SELECT l_orderkey, l_linenumber, coalesce(max(CASE WHEN l_shipdate >= '1998-01-01' THEN l_extendedprice END), max(l_extendedprice)) AS runtime FROM lineitem GROUP BY ALL",
    "run_defaults": "SELECT o_orderkey, o_orderstatus <> 'F' AS swept, CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 64 ELSE 32 END::INT AS blocksize, 0.9::DOUBLE AS share, 1::INT AS operating_points, 'output.hdf5' AS filename, 0::INT AS n_globals FROM orders",
    "speedup_summary": f"WITH {LOG}{FIRST}{PAIRS} SELECT size, min(speedup_runtime) AS lowest, max(speedup_runtime) AS highest, round(avg(speedup_runtime), 9) AS mean FROM pairs GROUP BY size",
    "best_worst": f"WITH {LOG}{FIRST}{PAIRS}, r AS (SELECT *, rank() OVER (PARTITION BY size ORDER BY speedup_frames DESC) AS hi, rank() OVER (PARTITION BY size ORDER BY speedup_frames) AS lo FROM pairs) SELECT size, block, share, speedup_runtime, speedup_frames, 'best' AS which FROM r WHERE hi = 1 UNION ALL SELECT size, block, share, speedup_runtime, speedup_frames, 'worst' FROM r WHERE lo = 1",
    "occurrence_share": f"WITH {LOG}, t AS (SELECT mode, count(*) AS n FROM log GROUP BY mode), k AS (SELECT range / 100 AS share FROM range(12)) SELECT t.mode, k.share, round(100.0 * (SELECT count(*) FROM log WHERE log.mode = t.mode AND round(log.share, 2) = k.share) / t.n, 9) AS percent FROM t, k",
    "data_limits": f"WITH {LOG}{FIRST}{PAIRS}, e AS (SELECT floor(min(speedup_frames) * 10) / 10 AS low, ceil(max(speedup_frames) * 10) / 10 AS high FROM pairs) SELECT low, high, range::INT AS k, round(low + (high - low) * range / 10, 9) AS point FROM e, range(11)",
    "linreg": f"WITH {LOG} SELECT mode, size, round(regr_slope(runtime, frames), 6) AS slope, round(regr_intercept(runtime, frames), 6) AS intercept, round(corr(runtime, frames), 6) AS r, round(regr_r2(runtime, frames), 6) AS r2 FROM log GROUP BY mode, size",
    "config_matrix": f"WITH {LOG}, {MATRIX} SELECT * FROM m",
    "config_counts": f"WITH {LOG}, {MATRIX}, p AS (SELECT size, block, count(DISTINCT share) AS shares FROM m GROUP BY size, block) SELECT size, block, shares, (sum(shares) OVER (PARTITION BY size ORDER BY block))::BIGINT AS rows_to FROM p",
    "missing_configs": f"""WITH {LOG}, e AS (SELECT DISTINCT a.size, b.block, round(c.share, 5) AS share FROM (SELECT DISTINCT size FROM log) a, (SELECT DISTINCT block FROM log) b, (SELECT DISTINCT share FROM log) c),
a AS (SELECT DISTINCT size, CASE WHEN runtime > 90000 THEN 77.0 ELSE block END::DOUBLE AS block, round(share, 5) AS share FROM log WHERE frames > 45 AND runtime > 60000)
(SELECT *, 'missing' AS state FROM (SELECT * FROM e EXCEPT SELECT * FROM a)) UNION ALL (SELECT *, 'unexpected' FROM (SELECT * FROM a EXCEPT SELECT * FROM e))""",
    "split_balanced": _ntile_sql("first"),
    "split_balanced_last": _ntile_sql("last"),
    "split_globally": "WITH s AS (SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey)::INT AS chunk FROM orders) SELECT chunk, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM s GROUP BY chunk",
    "share_split": f"WITH {LOG}, s AS (SELECT mode, size, row_number() OVER (PARTITION BY mode, size ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, runtime) AS k, ceil(count(*) OVER (PARTITION BY mode, size) * 0.3) AS c, count(*) OVER (PARTITION BY mode, size) AS m FROM log) SELECT mode, size, CASE WHEN k <= c THEN 'A' ELSE 'B' END AS part, count(*) AS n, round(max(c / m), 9) AS effective FROM s GROUP BY 1, 2, 3",
    "config_validate": """WITH p AS (SELECT p_partkey, p_size % 9 + 4 AS b, p_partkey % 2 + 1 AS o, p_size * 8 AS nx FROM part)
SELECT p_partkey, b % (2 * o) = 0 AND (nx * 64) % (b * b) = 0 AS ok, array_to_string(list_filter([CASE WHEN b % (2 * o) <> 0 THEN 'block is no multiple of the stencil' END, CASE WHEN (nx * 64) % (b * b) <> 0 THEN 'grid has no whole blocks' END], lambda x: x IS NOT NULL), '; ') AS reasons, (ceil(nx / b) * b)::BIGINT AS padded FROM p""",
    "frame_counts": """WITH p AS (SELECT p_partkey, p_partkey % 2 AS mode, p_size, p_size * 10 + 100 AS steps, (p_partkey % 4 * 4 + 8) // 2 - 1 AS h FROM part),
e AS (SELECT *, CASE WHEN mode = 1 THEN trunc(h * (trunc(2 * steps / h - 1) + 1) / 2 + 1) ELSE trunc(p_size / 0.125) + 1 END::INT AS expected FROM p) SELECT p_partkey, mode, expected, expected = p_size * 8 + 1 AS agrees FROM e""",
    "scalar_functions": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 END::INT AS flag, strftime(o_orderdate, '%m/%d/%Y-%H:%M:%S') AS stamp, true AS parsed,
  CASE o_custkey % 8 WHEN 0 THEN 0.0 WHEN 1 THEN 0.1 WHEN 2 THEN 0.2 WHEN 3 THEN 0.4 WHEN 4 THEN 0.5 WHEN 5 THEN 0.6 WHEN 6 THEN 0.8 ELSE 0.9 END::DOUBLE AS tenths,
  round(ceil(round(((o_custkey % 100) / 100) * 14, 5)) / 14, 9) AS share, round(0.1 * (1.0 / (o_custkey % 50 + 1)) * (1.0 / (o_custkey % 50 + 1)) / 2.0, 12)::DOUBLE AS heat_dt, round(0.1 * (10.0 / (o_custkey % 50 + 2)), 12)::DOUBLE AS euler_dt,
  CASE WHEN o_custkey % 3 = 0 THEN 16 ELSE 32 END::INT AS block,
  CASE WHEN o_custkey % 2 = 0 THEN 'several steps' ELSE 'one step' END || ', block ' || (o_custkey % 32) || ', share ' || printf('%.2f', (o_custkey % 100) / 100) || ', ' || printf('%.3f', round(o_totalprice)) || ' s' AS summary FROM orders""",
}
