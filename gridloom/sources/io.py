"""Reading and writing grids, frames and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = T.StructType([T.StructField("run_id", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("t", "v", "i", "j")), T.StructField("value", T.DoubleType())])
LOG = T.StructType(
    [
        T.StructField("array_shape", T.ArrayType(T.IntegerType())),
        T.StructField("blocksize", T.IntegerType()),
        T.StructField("cpu", T.StringType()),
        T.StructField("gpu", T.StringType()),
        T.StructField("runtime", T.DoubleType()),
        T.StructField("share", T.DoubleType()),
        T.StructField("swept", T.BooleanType()),
        T.StructField("time_per_step", T.DoubleType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("exid", T.ArrayType(T.IntegerType())),
        T.StructField("filename", T.StringType()),
        T.StructField("globals", T.ArrayType(T.DoubleType())),
        T.StructField("intermediate_steps", T.IntegerType()),
        T.StructField("operating_points", T.IntegerType()),
        T.StructField("verbose", T.BooleanType()),
    ]
)


def read_grid(spark: SparkSession, path: str, layout: str = "cells", nx: int | None = None, ny: int | None = None) -> DataFrame:
    """IO1: cells from Parquet. Layout "array": rows of run_id and data, values by variable, then by
    rows of an nx x ny grid; they become the cells of frame 0."""
    if layout == "cells":
        return spark.read.schema(CELLS).parquet(path)
    out = spark.read.parquet(path).select("run_id", F.posexplode("data").alias("k", "value"))
    place = {"v": f"k div {nx * ny}", "i": f"(k div {ny}) % {nx}", "j": f"k % {ny}"}
    return out.select("run_id", F.lit(0).alias("t"), *(F.expr(e).cast("int").alias(n) for n, e in place.items()), F.col("value").cast("double").alias("value"))


def _spread(x: Column, bits: int = 31) -> Column:
    """The bits of a number, a zero between any two."""
    out = x.cast("long").bitwiseAND(F.lit((1 << bits) - 1))
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
    return out


def curve(i: Column, j: Column) -> Column:
    """A place on a space-filling curve: the bits of i and j interleaved, so that near places are near on both axes."""
    return F.shiftleft(_spread(i), 1).bitwiseOR(_spread(j))


def write_frames(cells: DataFrame, meta: DataFrame, path: str, files: int | None = None, group_bytes: int = 16 << 20) -> None:
    """IO2: frames partitioned by run; run metadata beside them. Rows are dealt into files and sorted by frame and by a space-filling curve of i and
    j, so that large runs and frames spread over tasks, and the statistics of files and row groups (``group_bytes``) cut both axes: a
    box of cells reads the few that it meets."""
    keys = ("run_id", "t", "__at")
    dealt = cells.withColumn("__at", curve(F.col("i"), F.col("j")))
    dealt = dealt.repartitionByRange(files, *keys) if files else dealt.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).drop("__at").write.mode("overwrite").option("parquet.block.size", group_bytes).partitionBy("run_id").parquet(f"{path}/frames")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def read_frames(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/frames"), spark.read.parquet(f"{path}/meta")


KEYED = T.StructType([T.StructField("key", T.StringType()), *LOG.fields, T.StructField("file", T.StringType())])
PIECES = "file string, begin long, place int, text string"


def _starts_record(line: str) -> bool:
    """Whether a line of a YAML map begins an entry of the map itself: it isn't indented, no comment, list item or document mark, and names a key."""
    return bool(line) and line[0] not in " \t#-.%}]" and ":" in line and line[0] not in "{["


def _pieces(batches):
    """Lines (file, begin of their split, text), in order within a split, to records (place 1) and the two pieces at a split's
    ends that may go on in its neighbours: what comes before the first record (place 0), and the last record (place 2)."""
    import pandas as pd

    split, records, head = None, [], []

    def ended():
        if split is None:
            return []
        rows = [(*split, 0, "\n".join(head))] if head else []
        return rows + [(*split, 1 if k + 1 < len(records) else 2, "\n".join(r)) for k, r in enumerate(records)]

    for frame in batches:
        rows = []
        for file, begin, line in zip(frame["file"], frame["begin"], frame["value"]):
            if (file, begin) != split:
                rows += ended()
                split, records, head = (file, begin), [], []
            if line.startswith(("---", "...")):
                continue
            if _starts_record(line):
                if len(records) > 1:
                    rows.append((*split, 1, "\n".join(records.pop(0))))
                records.append([line])
            else:
                (records[-1] if records else head).append(line)
        yield pd.DataFrame(rows, columns=["file", "begin", "place", "text"])
    yield pd.DataFrame(ended(), columns=["file", "begin", "place", "text"])


def _parsed(frames):
    """Texts (file, text) of some records each to rows."""
    import pandas as pd
    import yaml

    for frame in frames:
        rows = []
        for file, text in zip(frame["file"], frame["text"]):
            for key, record in (yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or {}).items():
                rows.append([str(key), *((record or {}).get(f.name) for f in LOG.fields), file])
        out = pd.DataFrame(rows, columns=KEYED.names, dtype=object)
        for f in LOG.fields:
            if isinstance(f.dataType, T.DoubleType):
                out[f.name] = pd.to_numeric(out[f.name]).astype("Float64")
        yield out


def read_run_logs(spark: SparkSession, paths: list[str], layout: str = "json") -> DataFrame:
    """IO3: short and long records of many files, with the file each comes from; fields that a
    record lacks are null. "json": a record a line, with its key as ``key``. "yaml": a map from keys to records in each file.

    A large YAML file is read by many tasks, as Spark splits it at lines: each finds where records begin (a line that names a key
    and isn't indented) and parses those that lie wholly in its split. The pieces at a split's ends, two a split, are put together by file, in the order of
    splits, and parsed then. A record can't refer to an anchor in another one; a map in braces is one record's worth of work."""
    if layout == "json":
        return spark.read.schema(T.StructType([T.StructField("key", T.StringType()), *LOG.fields])).json(paths).withColumn("file", F.input_file_name())
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value")
    pieces = lines.mapInPandas(_pieces, PIECES)
    whole = pieces.filter("place = 1").select("file", "text")
    ends = pieces.filter("place <> 1").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("begin", "place", "text"))).alias("ends"))
    joined = ends.select("file", F.array_join(F.transform("ends", lambda e: e["text"]), "\n").alias("text"))
    return whole.unionByName(joined).mapInPandas(_parsed, KEYED)


def upsert_log_files(spark: SparkSession, old: str, new: DataFrame, out: str) -> None:
    """IO4 on files: the log at ``old`` with new entries, written to ``out``. All fields of both stay; a field has its type
    in ``new``, else in LOG, else the one that the file shows."""
    from ..operators.runs import upsert_log

    known = {f.name: f for f in [*spark.read.json(old).schema.fields, *LOG.fields, *new.schema.fields]}
    upsert_log(spark.read.schema(T.StructType(list(known.values()))).json(old), new, ["key"]).write.json(out)


def write_log(log: DataFrame, path: str, parts: int = 64) -> None:
    """A stored run log: Parquet, in ``parts`` partitions by the hash of ``key``."""
    placed = log.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    placed.repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def merge_log(spark: SparkSession, path: str, new: DataFrame, parts: int = 64) -> int:
    """IO4 on a stored log (of ``write_log``, with as many parts): new entries are added, or replace those with their key. Only
    the partitions that new keys fall into are read and written again, all at once at the end; other files stay as they are, and a rerun gives the same
    log. Of several new entries of a key one stays. Returns how many partitions were written."""
    from ..functions.session import cut_lineage
    from ..operators.runs import upsert_log

    placed = cut_lineage(new.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")))
    touched = sorted(r["part"] for r in placed.select("part").distinct().collect())  # parts at most
    if touched:
        old = spark.read.parquet(path).filter(F.col("part").isin(touched))
        merged = cut_lineage(upsert_log(old, placed, ["part", "key"]))  # read before it is overwritten
        merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return len(touched)
