import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import kernels
from gridloom.plans import jobs
from gridloom.sources import io


def test_evolve_and_validate(spark, tmp_path):
    cells = spark.createDataFrame([(r, 0, 0, i, j, float(i * 8 + j)) for r in ("a", "b") for i in range(8) for j in range(8)], io.CELLS)
    meta = spark.createDataFrame([("a", 4), ("b", 4)], "run_id string, blocksize int")
    out = str(tmp_path / "job")
    jobs.evolve_grid(cells, meta, out, 8, 8, 4, kernels.ADD, 7, k=2, rounds_a_write=2)
    frames, _ = io.read_frames(spark, out)
    assert sorted(r[0] for r in frames.select("t").distinct().collect()) == [0, 2, 4, 6, 7]
    errors, verdict = jobs.validate_frames(spark, out, F.col("i") * 8.0 + F.col("j") + F.col("t"))
    assert {r["max_error"] for r in errors.collect()} == {0.0} and not any(r["failed"] for r in verdict.collect())
    assert all(r["failed"] for r in jobs.validate_frames(spark, out, F.lit(0.0))[1].collect())


def test_study_needs_one_exchange_for_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [("old", "heat", m, float(s), 8.0, 0.5, float(rng.random() + 1), float(s * (2 - m)), t) for m in (0, 1) for s in (160, 320, 480) for t in (1, 2)]
    log = spark.createDataFrame(rows, "hardware string, equation string, mode int, size double, block double, share double, runtime double, time_per_step double, ts int")
    study = jobs.study_logs(log, ["ts"])
    assert {r["speedup_time_per_step"] for r in study["pairs"].collect()} == {2.0}
    assert jobs.study_logs(log, ["ts"])["pairs"]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {round(r["slope"], 9) for r in study["slopes"].collect()} == {1.0, 2.0} and study["best_worst"].count() == 6
