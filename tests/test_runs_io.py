"""Planted run logs, and reading and writing."""

import json

from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import runs
from gridloom.sources import io


def test_logs_json_and_yaml(spark, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.yaml"
    a.write_text(json.dumps({"key": "01/02/2020-03:04:05", "runtime": 2.0, "array_shape": [11, 1, 160, 160], "swept": True, "blocksize": 8, "share": 0.5, "cpu": "x/heat.py"}) + "\n")
    b.write_text('"01/03/2020-03:04:05": {runtime: 4, array_shape: [11, 1, 160, 160], swept: false, blocksize: 8, share: 1, cpu: x/heat.py, verbose: true}\n"bad": {}\n')
    both = io.read_run_logs(spark, [str(a)]).unionByName(io.read_run_logs(spark, [str(b)], "yaml"))
    rows = {r["key"]: r for r in runs.with_time_per_step(runs.log_features(both)).collect()}
    assert rows["01/02/2020-03:04:05"]["time_per_step"] == 0.2 and rows["01/03/2020-03:04:05"]["mode"] == 0
    assert rows["bad"]["runtime"] is None and rows["bad"]["time_per_step"] is None
    stamp = both.filter("key <> 'bad'").select(scalars.format_stamp(scalars.parse_stamp(F.col("key"))).alias("k"), "key")
    assert stamp.filter("k <> key").count() == 0


def test_planted_best_and_duplicates(spark):
    rows = []
    for size in (160.0, 320.0):
        for block in (8.0, 16.0):
            for share in (0.0, 0.5, 1.0):
                for mode in (0, 1):
                    t = 10.0 if mode == 0 else 5.0
                    if mode == 1 and (block, share) == (8.0, 0.5):
                        t = 1.0
                    rows.append((mode, size, block, share, t, 1))
                    rows.append((mode, size, block, share, t * 100, 2))
    log = spark.createDataFrame(rows, "mode int, size double, block double, share double, runtime double, ts int")
    pairs = runs.pair_runs(runs.dedupe_runs(log, ["mode", "size", "block", "share"], ["ts"]), ["size", "block", "share"], ["runtime"])
    found = runs.best_worst(pairs, ["size"], "speedup_runtime").collect()
    assert {(r["block"], r["share"]) for r in found if r["which"] == "best"} == {(8.0, 0.5)}
    assert len([r for r in found if r["which"] == "worst"]) == 10  # ties stay


def test_upsert_new_wins(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "key string, x int")
    new = spark.createDataFrame([("b", 3, "n"), ("c", 4, "n")], "key string, x int, y string")
    assert {(r["key"], r["x"]) for r in runs.upsert_log(old, new, ["key"]).collect()} == {("a", 1), ("b", 3), ("c", 4)}


def test_frames_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([("r", t, 0, i, 0, float(t * i)) for t in range(3) for i in range(4)], io.CELLS)
    io.write_frames(cells, spark.createDataFrame([("r", 8)], "run_id string, blocksize int"), str(tmp_path / "o"))
    frames, meta = io.read_frames(spark, str(tmp_path / "o"))
    assert sorted(map(tuple, frames.select(*cells.columns).collect())) == sorted(map(tuple, cells.collect())) and meta.count() == 1


def test_array_layout(spark, tmp_path):
    spark.createDataFrame([("r", [float(k) for k in range(2 * 2 * 3)])], "run_id string, data array<double>").write.parquet(str(tmp_path / "g"))
    cells = io.read_grid(spark, str(tmp_path / "g"), "array", 2, 3)
    assert all(r["value"] == r["v"] * 6 + r["i"] * 3 + r["j"] for r in cells.collect()) and cells.count() == 12


def test_frames_of_known_runs(spark):
    df = spark.createDataFrame([(8,), (12,), (16,), (24,), (32,)], "b int")
    got = [r[0] for r in df.select(scalars.multi_step_frames(F.lit(500), F.col("b"), F.lit(1), F.lit(1))).collect()]
    assert got == [499, 501, 498, 496, 496]


def test_texts_to_booleans(spark):
    df = spark.createDataFrame([("YES",), ("f",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(scalars.text_to_boolean(F.col("s"))).collect()] == [True, False, None, None]


def test_null_groups_are_groups(spark):
    rows = [("a", 1.0, 3.0), ("a", 2.0, 5.0), (None, 1.0, 7.0), (None, 1.0, 9.0), (None, None, 8.0)]
    df = spark.createDataFrame(rows, "g string, x double, m double")
    found = {(r["g"], r["which"], r["m"]) for r in runs.best_worst(df, ["g"], "m").collect()}
    assert found == {("a", "best", 5.0), ("a", "worst", 3.0), (None, "best", 9.0), (None, "worst", 7.0)}
    share = {(r["g"], r["x"]): r["percent"] for r in runs.occurrence_share(df, "x", spark.createDataFrame([(1.0,), (4.0,)], "x double"), ["g"]).collect()}
    assert share[None, 1.0] == 100 * 2 / 3 and share["a", 1.0] == 50.0 and share[None, 4.0] == 0.0
    configs = lambda rows: spark.createDataFrame(rows, "size double, block double, share double")
    states = {tuple(r) for r in runs.missing_configs(configs([(1.0, None, 0.5), (1.0, 2.0, 0.5), (3.0, None, None)]), configs([(1.0, None, 0.5), (4.0, None, 0.5)])).collect()}
    assert states == {(1.0, 2.0, 0.5, "missing"), (3.0, None, None, "missing"), (4.0, None, 0.5, "unexpected")}


def test_splits_of_groups_and_constant_orders(spark):
    rows = [(None if k % 3 == 0 else "g", 1, k) for k in range(100)]
    df = spark.createDataFrame(rows, "g string, c int, k int").repartition(5)
    for keys, groups in ((["g"], [[k for k in range(100) if k % 3 == 0], [k for k in range(100) if k % 3]]), ([], [list(range(100))])):
        for larger in ("first", "last"):
            got = {r["k"]: r["chunk"] for r in runs.split_balanced(df, 7, keys, ["c", "k"], larger, parts=6).collect()}
            for group in groups:
                sizes = [sum(got[k] == c for k in group) for c in range(1, 8)]
                assert [got[k] for k in group] == sorted(got[k] for k in group) and sizes == sorted(sizes, reverse=larger == "first") and max(sizes) - min(sizes) <= 1
    parts = {r["k"]: r["part"] for r in runs.share_split(df, 0.25, ["g"], ["c", "k"], parts=6).collect()}
    assert [k for k in range(0, 100, 3) if parts[k] == "A"] == list(range(0, 27, 3))


def test_upsert_of_files_keeps_all_fields(spark, tmp_path):
    (tmp_path / "old.json").write_text('{"key": "a", "runtime": 1.5, "note": "kept"}\n{"key": "b", "runtime": 2.5, "blocksize": 8}\n')
    io.upsert_log_files(spark, str(tmp_path / "old.json"), spark.createDataFrame([("b", 3.5, True), ("c", 4.5, False)], "key string, runtime double, extra boolean"), str(tmp_path / "out"))
    got = {r["key"]: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got["a"]["note"] == "kept" and got["a"]["runtime"] == 1.5 and got["b"]["runtime"] == 3.5 and got["b"]["extra"] is True and set(got) == {"a", "b", "c"}


def test_line_stencils_plainly(spark):
    from gridloom.operators import stencil

    weights = [1.0, 10.0, 100.0, 1000.0, 10000.0]
    lines = {f"n{n}": [float(k + 1) for k in range(n)] for n in (1, 2, 3, 4, 5, 9)} | {"null": [1.0, None, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]}
    df = spark.createDataFrame([(name, k, x) for name, line in lines.items() for k, x in enumerate(line)], "line string, k int, value double")
    for wrap in (True, False):
        for r in stencil.line_stencil(df, weights, ["line"], "k", wrap=wrap).collect():
            line, places = lines[r["line"]], [r["k"] + d for d in range(-2, 3)]
            if wrap or all(0 <= p < len(line) for p in places):
                near = [line[p % len(line)] for p in places]
                want = None if None in near else sum(x * w for x, w in zip(near, weights))
            else:
                want = line[r["k"]]
            assert r["result"] == want


def test_lacking_cells_fail(spark):
    from gridloom.operators import compare

    cells = [("r", t, 0, i, 0, float(i)) for t in range(2) for i in range(3)]
    whole, lacking = spark.createDataFrame(cells, io.CELLS), spark.createDataFrame(cells[:-1], io.CELLS)
    for a, b in ((whole, lacking), (lacking, whole)):
        compared = compare.compare_fields(a, b)
        for verdict in (compare.allclose_verdict, compare.exact_verdict):
            assert {(r["t"], r["ok"]) for r in verdict(compared).collect()} == {(0, True), (1, False)}
        frames = compare.exact_verdict(compared)
        assert [r["failed"] for r in compare.run_verdict(frames).collect()] == [True] and [r["failed"] for r in compare.run_verdict(frames, "all").collect()] == [False]
