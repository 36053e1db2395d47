"""Grids in ``.npy`` files as a Spark data source: read by hyperslabs, written by frames that are visible whole or not at all.

    arrays.register(spark)
    cells = spark.read.format("grid_arrays").option("path", folder_or_file).load().filter("t = 3 AND i < 100")
    tiles.write.format("grid_frames").option("path", folder).mode("append").save()
    frames = spark.read.format("grid_frames").option("path", folder).load()

``grid_arrays`` gives the cells of arrays (v, x, y) or (t, v, x, y), a run for each file. A partition is a stretch of rows of one frame and
variable (``slab_bytes``), of which only those that filters on run_id, t, v and i leave are planned, read at their place in the file.

``grid_frames`` keeps tiles (run_id, t, bi, bj, ni, nj, data). Each task writes files of its own, one for each frame it has tiles of, under new names; at
the end the job writes a list of a frame's files, by one rename each. A frame is what its list says: a job that fails leaves no trace in it, a frame
that is written again replaces itself, and files that no list names any more are deleted afterwards. The driver sees a line for
each task and frame. Filters on run_id and t choose the lists. A run's name may have any characters, but null is no name.

Files are opened by Arrow's file systems: paths are local to all machines (a shared mount) or addresses that these know.
"""

from __future__ import annotations

import itertools
import json
import posixpath
import urllib.parse
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

CELLS = "run_id string, t int, v int, i int, j int, value double"
TILES = "run_id string, t int, bi int, bj int, ni int, nj int, data array<double>"
SLAB_BYTES = 8 << 20


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):  # with one slash, too
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _header(file) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and place of the values of an open ``.npy`` file."""
    version = np.lib.format.read_magic(file)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
    if fortran or len(shape) not in (3, 4) or dtype.hasobject:
        raise ValueError(f"a grid is a C-ordered array (v, x, y) or (t, v, x, y), not {dtype}{shape}")
    return shape if len(shape) == 4 else (1, *shape), dtype, file.tell()


class Range:
    """What a column's filters leave: numbers from low to high, or the values of a set."""

    def __init__(self):
        self.low, self.high, self.only = None, None, None

    def add(self, f: ds.Filter) -> bool:
        """Takes a filter in, if it is of a kind that can be; says whether."""
        if isinstance(f, (ds.EqualTo, ds.In)):
            values = {f.value} if isinstance(f, ds.EqualTo) else set(f.value)
            self.only = values if self.only is None else self.only & values
        elif isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual)):
            low = f.value + isinstance(f, ds.GreaterThan)
            self.low = low if self.low is None else max(self.low, low)
        elif isinstance(f, (ds.LessThan, ds.LessThanOrEqual)):
            high = f.value - isinstance(f, ds.LessThan)
            self.high = high if self.high is None else min(self.high, high)
        else:
            return False
        return True

    def has(self, x) -> bool:
        return (self.only is None or x in self.only) and (self.low is None or x >= self.low) and (self.high is None or x <= self.high)

    def within(self, n: int) -> list[tuple[int, int]]:
        """Stretches (begin, end) of the numbers 0 .. n - 1 that are left."""
        if self.only is None:
            low, high = max(0, self.low or 0), n - 1 if self.high is None else min(n - 1, self.high)
            return [(low, high + 1)] if low <= high else []
        left, found = sorted(x for x in self.only if isinstance(x, int) and 0 <= x < n and self.has(x)), []
        for x in left:
            if found and found[-1][1] == x:
                found[-1] = (found[-1][0], x + 1)
            else:
                found.append((x, x + 1))
        return found


class Filtered(ds.DataSourceReader):
    """Takes filters on some columns in; Spark checks all of them again."""

    columns: dict[str, type] = {}

    def pushFilters(self, filters):
        self.ranges = {c: Range() for c in self.columns}
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            text = name in self.columns and self.columns[name] is str
            if name in self.columns and not (text and not isinstance(f, (ds.EqualTo, ds.In))):
                self.ranges[name].add(f)
            yield f

    def range_of(self, column: str) -> Range:
        return getattr(self, "ranges", {}).get(column) or Range()


class Slab(ds.InputPartition):
    def __init__(self, file: str, run_id: str, t: int, v: int, begin: int, end: int, columns: int, kind: str, place: int):
        self.file, self.run_id, self.t, self.v, self.begin, self.end, self.columns, self.kind, self.place = file, run_id, t, v, begin, end, columns, kind, place


class ArrayReader(Filtered):
    columns = {"run_id": str, "t": int, "v": int, "i": int}

    def __init__(self, options):
        self.path, self.slab = options["path"], int(options.get("slab_bytes", SLAB_BYTES))

    def partitions(self):
        fs, path = _opened(self.path)
        info = fs.get_file_info(path)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path))
        found = []
        for f in sorted((f for f in files if f.path.endswith(".npy")), key=lambda f: f.path):
            run_id = posixpath.basename(f.path)[:-4]
            if not self.range_of("run_id").has(run_id):
                continue
            with fs.open_input_file(f.path) as file:
                (nt, nv, nx, ny), dtype, place = _header(file)
            rows = max(1, self.slab // max(1, ny * dtype.itemsize))
            axes = [itertools.chain.from_iterable(range(*s) for s in self.range_of(c).within(n)) for c, n in (("t", nt), ("v", nv))]
            for t, v in itertools.product(*map(list, axes)):
                for low, high in self.range_of("i").within(nx):
                    for begin in range(low, high, rows):
                        at = place + (((t * nv + v) * nx) + begin) * ny * dtype.itemsize
                        found.append(Slab(f.path, run_id, t, v, begin, min(high, begin + rows), ny, dtype.str, at))
        return found

    def read(self, slab):
        if slab is None:
            return
        fs, _ = _opened(self.path)
        dtype, rows = np.dtype(slab.kind), max(1, 65536 // max(1, slab.columns))
        with fs.open_input_file(slab.file) as file:
            for begin in range(slab.begin, slab.end, rows):
                end = min(slab.end, begin + rows)
                n = (end - begin) * slab.columns
                file.seek(slab.place + (begin - slab.begin) * slab.columns * dtype.itemsize)
                values = np.frombuffer(file.read(n * dtype.itemsize), dtype).astype(np.float64)
                same = [pa.array([slab.run_id] * n, pa.string()), pa.array(np.full(n, slab.t, np.int32)), pa.array(np.full(n, slab.v, np.int32))]
                at = np.arange(n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*same, pa.array(begin + at // slab.columns, pa.int32()), pa.array(at % slab.columns, pa.int32()), pa.array(values)], ["run_id", "t", "v", "i", "j", "value"])


class GridArrays(ds.DataSource):
    @classmethod
    def name(cls):
        return "grid_arrays"

    def schema(self):
        return CELLS

    def reader(self, schema):
        return ArrayReader(self.options)


def _lists(fs: pafs.FileSystem, root: str) -> list[tuple[str, int, str]]:
    """run_id, t and place of each frame's list."""
    found = fs.get_file_info(pafs.FileSelector(f"{root}/frames", recursive=True, allow_not_found=True))
    out = []
    for f in found:
        if f.path.endswith(".json"):
            run, name = f.path.split("/")[-2:]
            out.append((urllib.parse.unquote(run[4:]), int(name[:-5]), f.path))
    return sorted(out)


class Frame(ds.InputPartition):
    def __init__(self, run_id: str, t: int, file: str):
        self.run_id, self.t, self.file = run_id, t, file


class FrameReader(Filtered):
    columns = {"run_id": str, "t": int}

    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        fs, root = _opened(self.path)
        found = []
        for run_id, t, path in _lists(fs, root):
            if self.range_of("run_id").has(run_id) and self.range_of("t").has(t):
                with fs.open_input_file(path) as file:
                    found += [Frame(run_id, t, f"{root}/data/{name}") for name in json.loads(file.read())]
        return found

    def read(self, frame):
        if frame is None:
            return
        fs, _ = _opened(self.path)
        with fs.open_input_file(frame.file) as file, pa.ipc.open_file(file) as tiles:
            for k in range(tiles.num_record_batches):
                batch = tiles.get_batch(k)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([frame.run_id] * n, pa.string()), pa.array([frame.t] * n, pa.int32()), *batch.columns], ["run_id", "t", *batch.schema.names])


class Written(ds.WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int, str]]):
        self.files = files


class FrameWriter(ds.DataSourceArrowWriter):
    """overwrite: all frames that were there go, after the new ones are visible."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator):
        fs, root = _opened(self.path)
        fs.create_dir(f"{root}/data", recursive=True)
        schema = pa.schema([*((c, pa.int32()) for c in ("bi", "bj", "ni", "nj")), ("data", pa.list_(pa.float64()))])
        sinks, token = {}, uuid.uuid4().hex  # another attempt at a task has other names
        try:
            for batch in iterator:
                table = pa.Table.from_batches([batch])
                frames = list(zip(table.column("run_id").to_pylist(), table.column("t").to_pylist()))
                for frame in sorted(set(frames), key=str):
                    if None in frame:
                        raise ValueError("a frame needs a run and a number")
                    if frame not in sinks:
                        name = f"{self.job}-{token}-{len(sinks)}.arrow"
                        sinks[frame] = name, pa.ipc.new_file(fs.open_output_stream(f"{root}/data/{name}"), schema)
                    rows = pa.array([k for k, f in enumerate(frames) if f == frame])
                    sinks[frame][1].write_table(table.take(rows).select(schema.names).cast(schema))
        finally:
            for _, sink in sinks.values():
                sink.close()
        return Written([(*frame, name) for frame, (name, _) in sinks.items()])

    def commit(self, messages):
        fs, root = _opened(self.path)
        new: dict[tuple[str, int], list[str]] = {}
        for run_id, t, name in (f for m in messages if m for f in m.files):
            new.setdefault((run_id, t), []).append(name)
        old, gone = {(r, t): path for r, t, path in _lists(fs, root)}, []
        for frame in {f for f in old if f in new or self.overwrite}:
            with fs.open_input_file(old[frame]) as file:
                gone += json.loads(file.read())
        for (run_id, t), names in new.items():
            folder = f"{root}/frames/run={urllib.parse.quote(run_id, safe='')}"
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/{t}.{self.job}") as file:
                file.write(json.dumps(sorted(names)).encode())
            fs.move(f"{folder}/{t}.{self.job}", f"{folder}/{t}.json")  # now the frame is another one
        for frame in {f for f in old if f not in new and self.overwrite}:
            fs.delete_file(old[frame])
        self._delete(fs, [f"{root}/data/{name}" for name in gone])

    def abort(self, messages):
        fs, root = _opened(self.path)
        found = fs.get_file_info(pafs.FileSelector(f"{root}/data", allow_not_found=True))
        self._delete(fs, [f.path for f in found if posixpath.basename(f.path).startswith(self.job)])

    @staticmethod
    def _delete(fs, files):
        for f in files:
            if fs.get_file_info(f).type == pafs.FileType.File:
                fs.delete_file(f)


class GridFrames(ds.DataSource):
    @classmethod
    def name(cls):
        return "grid_frames"

    def schema(self):
        return TILES

    def reader(self, schema):
        return FrameReader(self.options)

    def writer(self, schema, overwrite):
        if sorted(schema.names) != sorted(c.split()[0] for c in TILES.split(", ")):
            raise ValueError(f"tiles have the columns {TILES}")
        return FrameWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session, and has it hand filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridArrays)
    spark.dataSource.register(GridFrames)
