"""Evolution of tiles with one or several steps per exchange.

A round gives each tile the cells around it (periodic), as wide as k steps need, and advances k steps inside the
tile, where the halo shrinks by the radius at each stage; results do not depend on k. Grids may end within a tile, and tiles may lack
cells: a lacking cell, or one whose value is no number, enters kernels as NaN, and a result that is NaN is lacking.

``evolve`` is one lazy plan: a round shuffles each tile and its strips. ``evolve_in_place`` keeps the tiles where they are: a
round's state is a table bucketed by tile, whose edges are a column of their own. Only edges are read, cut into strips and shuffled; the
bodies meet them in a cogroup without an exchange. It materialises each round, which suits many rounds of large grids.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut_lineage
from .grid import check_tiling
from .kernels import TileKernel

SIDES = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
AT_ONCE = 32  # tiles whose parts are handed over together
TILES = "run_id string, t int, bi int, bj int, ni int, nj int, data array<double>"
BODIES = "run_id string, t int, bi int, bj int, ni int, nj int, body binary"
PARTS = "run_id string, t int, bi int, bj int, side int, x int, y int, dx int, dy int, data array<double>"


def _grids(column: pa.ListArray) -> list[np.ndarray]:
    """Each row's values, not copied; nulls are no numbers."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def _lists(grids: list[np.ndarray]) -> pa.ListArray:
    sizes = np.cumsum([0, *(g.size for g in grids)])
    flat = np.concatenate([g.reshape(-1) for g in grids]) if grids else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, from_pandas=True))


def _packed(width: int | None = None):
    """Tiles with their body as bytes, and their edges if a width is given."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(first, AT_ONCE)
                shapes = zip(part.column(4).to_pylist(), part.column(5).to_pylist())
                grids = [g.reshape(-1, ni, nj) for g, (ni, nj) in zip(_grids(part.column(6)), shapes)]
                made = {"body": pa.array([np.ascontiguousarray(g).tobytes() for g in grids], pa.binary())}
                if width:
                    made["edges"] = pa.array([_bands(g, width) for g in grids], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:6], *made.values()], ["run_id", "t", "bi", "bj", "ni", "nj", *made])

    return run


def _pack(tiles: DataFrame) -> DataFrame:
    return tiles.select("run_id", "t", "bi", "bj", "ni", "nj", "data").mapInArrow(_packed(), BODIES)


def _listed(batches):
    """The last column's bytes as values."""
    for batch in batches:
        for first in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(first, AT_ONCE)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], _lists([np.frombuffer(b.as_py()) for b in part.columns[-1]])], [*part.schema.names[:-1], "data"])


def _unpack(state: DataFrame) -> DataFrame:
    return state.mapInArrow(_listed, TILES)


def reach(tile: int, n: int, bs: int, h: int) -> list[tuple[int, int, int, int, bool]]:
    """Along an axis of n cells: which tiles need cells of this one, themselves or within h of them, around the ends too: the
    target, where the cells lie from the beginning of its halo, where in this tile, how many, and whether they are the tile itself."""
    a, b, last, found = tile * bs, min(n, (tile + 1) * bs), -(-n // bs) - 1, []
    for shift in (-n, 0, n):
        for target in range(max(0, (a + shift - h) // bs), min(last, (b + shift - 1 + h) // bs) + 1):
            c, d = target * bs, min(n, (target + 1) * bs)
            low, high = max(a + shift, c - h), min(b + shift, d + h)
            if low < high:
                found.append((target, low - c + h, low - shift - a, high - low, target == tile and shift == 0))
    return found


def check_halo(nx: int, ny: int, bs: int, h: int) -> None:
    check_tiling(nx, ny, bs)
    if not 0 < h <= bs:
        raise ValueError(f"a halo of {h} needs more than the nearest tiles of {bs}")
    if h > min(nx, ny):
        raise ValueError(f"a halo of {h} goes more than once around a {nx} x {ny} grid")


def _side(at: int, length: int, extent: int, h: int) -> int:
    return -1 if at + length <= h else 1 if at >= h + extent else 0


def _exchanged(tiles: DataFrame, nx: int, ny: int, bs: int, h: int) -> DataFrame:
    """Tiles with their body as bytes to parts as ``exchange`` gives them, with data as bytes."""
    check_halo(nx, ny, bs, h)
    extent = lambda tile, n: min(bs, n - tile * bs)
    names = ["run_id", "t", "bi", "bj", "side", "x", "y", "dx", "dy", "data"]

    def parts(batch):
        rows = [[] for _ in names]
        for run_id, t, bi, bj, ni, nj, body in zip(*(c.to_pylist() for c in batch.columns)):
            u = np.frombuffer(body).reshape(-1, ni, nj)
            for ti, x, sx, dx, _ in reach(bi, nx, bs, h):
                for tj, y, sy, dy, _ in reach(bj, ny, bs, h):
                    side = 3 * (_side(x, dx, extent(ti, nx), h) + 1) + _side(y, dy, extent(tj, ny), h) + 1
                    for column, value in zip(rows, (run_id, t, ti, tj, side, x, y, dx, dy, np.ascontiguousarray(u[:, sx : sx + dx, sy : sy + dy]).tobytes())):
                        column.append(value)
        kinds = (pa.string(), *[pa.int32()] * 8, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                yield parts(batch.slice(first, AT_ONCE))

    return tiles.select("run_id", "t", "bi", "bj", "ni", "nj", "body").mapInArrow(run, PARTS.replace("array<double>", "binary"))


def exchange(tiles: DataFrame, nx: int, ny: int, bs: int, h: int) -> DataFrame:
    """For each tile the parts that it and its neighbours send: run_id, t, bi, bj, side (where the part lies, 0 .. 8 with 4 the
    tile itself), x, y (its place from the beginning of the halo), dx, dy (its extents), data. In small grids one neighbour sends several parts;
    where the last tiles are narrower than h, several neighbours send parts to one side."""
    return _exchanged(_pack(tiles), nx, ny, bs, h).mapInArrow(_listed, PARTS)


def _stepped(u: np.ndarray, kernel: TileKernel, steps: int, params: dict | None) -> np.ndarray:
    """A tile with its halo after ``steps`` full steps: the tile."""
    r = kernel.radius
    for _ in range(steps):
        start, current = u, u
        for stage in range(kernel.stages):
            edge = (stage + 1) * r
            before = start[:, edge : start.shape[1] - edge, edge : start.shape[2] - edge]
            current = kernel.fn(stage, current, before, params or {})
        u = current
    return np.asarray(u, float)


def _around(body: np.ndarray, h: int, parts) -> np.ndarray:
    """The tile with its halo; parts are (x, y, dx, dy, values). What no tile sent is NaN."""
    v, ni, nj = body.shape
    u = np.full((v, ni + 2 * h, nj + 2 * h), np.nan)
    u[:, h : h + ni, h : h + nj] = body
    for x, y, dx, dy, data in parts:
        u[:, x : x + dx, y : y + dy] = data.reshape(v, dx, dy)
    return u


def _advanced(tiles: DataFrame, nx: int, ny: int, bs: int, kernel: TileKernel, steps: int, params: dict | None) -> DataFrame:
    """``advance`` of tiles with their body as bytes."""
    h = steps * kernel.radius * kernel.stages
    names, kinds = ["run_id", "t", "bi", "bj", "ni", "nj", "body"], (pa.string(), *[pa.int32()] * 5, pa.binary())

    def run(key, table):
        at = dict(zip(table.column("side").to_pylist(), range(table.num_rows)))
        run_id, t, bi, bj = (k.as_py() for k in key)
        ni, nj = min(bs, nx - bi * bs), min(bs, ny - bj * bs)
        if 4 not in at:  # only strips: there is no such tile
            return pa.table([pa.array([], k) for k in kinds], names)
        data = [np.frombuffer(d.as_py()) for d in table.column("data")]
        around = zip(*(table.column(c).to_pylist() for c in ("x", "y", "dx", "dy")), data)
        u = _stepped(_around(data[at[4]].reshape(-1, ni, nj), h, around), kernel, steps, params)
        return pa.table([pa.array([x], k) for x, k in zip((run_id, t + steps, bi, bj, ni, nj, np.ascontiguousarray(u).tobytes()), kinds)], names)

    return _exchanged(tiles, nx, ny, bs, h).groupBy("run_id", "t", "bi", "bj").applyInArrow(run, BODIES)


def advance(tiles: DataFrame, nx: int, ny: int, bs: int, kernel: TileKernel, steps: int, params: dict | None = None) -> DataFrame:
    """One round of ``steps`` full steps, one shuffle. Tiles that don't exist stay away."""
    return _unpack(_advanced(_pack(tiles), nx, ny, bs, kernel, steps, params))


def evolve(tiles: DataFrame, nx: int, ny: int, bs: int, kernel: TileKernel, n: int, k: int = 1, params: dict | None = None, cut_every: int = 4, save_every_round: bool = False) -> DataFrame:
    """n steps, k per shuffle; the last round may be shorter. Returns the last frame, or the
    frames after every round. Lineage is cut every cut_every rounds. Between rounds a tile's body is bytes."""
    done, rounds, state = 0, 0, _pack(tiles)
    frames = [state]
    while done < n:
        state = _advanced(state, nx, ny, bs, kernel, min(k, n - done), params)
        done, rounds = done + min(k, n - done), rounds + 1
        if rounds % cut_every == 0 and done < n:
            state = cut_lineage(state)
        frames.append(state)
    return _unpack(reduce(DataFrame.unionByName, frames) if save_every_round else state)


KEY = ("run_id", "bi", "bj")
STATE = "run_id string, t int, bi int, bj int, ni int, nj int, body binary, edges binary"


def _bands(u: np.ndarray, h: int) -> bytes:
    """The edges of a tile: its first and last h rows, then columns (all of them where it is narrower)."""
    v, ni, nj = u.shape
    wi, wj = min(h, ni), min(h, nj)
    return b"".join(np.ascontiguousarray(a).tobytes() for a in (u[:, :wi], u[:, ni - wi :], u[:, :, :wj], u[:, :, nj - wj :]))


def _from_bands(edges: bytes, ni: int, nj: int, h: int) -> list[np.ndarray]:
    wi, wj = min(h, ni), min(h, nj)
    flat = np.frombuffer(edges)
    v = len(flat) // (2 * wi * nj + 2 * ni * wj)
    shapes, at, out = ((v, wi, nj), (v, wi, nj), (v, ni, wj), (v, ni, wj)), 0, []
    for shape in shapes:
        out.append(flat[at : at + np.prod(shape)].reshape(shape))
        at += out[-1].size
    return out


def strips(state: DataFrame, nx: int, ny: int, bs: int, h: int, width: int) -> DataFrame:
    """What tiles send to others for a halo of h, cut from their edges (of ``width``): run_id, bi, bj, x, y, dx, dy, data as bytes."""
    names = ["run_id", "bi", "bj", "x", "y", "dx", "dy", "data"]

    def parts(batch):
        rows = [[] for _ in names]
        for run_id, bi, bj, ni, nj, edges in zip(*(c.to_pylist() for c in batch.columns)):
            low_i, high_i, low_j, high_j = _from_bands(edges, ni, nj, width)
            for ti, x, sx, dx, same_i in reach(bi, nx, bs, h):
                for tj, y, sy, dy, same_j in reach(bj, ny, bs, h):
                    if same_i and same_j:
                        continue
                    if not same_i:
                        band, a = (low_i, sx) if sx + dx <= low_i.shape[1] else (high_i, sx - ni + high_i.shape[1])
                        cells = band[:, a : a + dx, sy : sy + dy]
                    else:
                        band, a = (low_j, sy) if sy + dy <= low_j.shape[2] else (high_j, sy - nj + high_j.shape[2])
                        cells = band[:, sx : sx + dx, a : a + dy]
                    for column, value in zip(rows, (run_id, ti, tj, x, y, dx, dy, np.ascontiguousarray(cells).tobytes())):
                        column.append(value)
        kinds = (pa.string(), *[pa.int32()] * 6, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                yield parts(batch.slice(first, AT_ONCE))

    return state.select(*KEY, "ni", "nj", "edges").mapInArrow(run, "run_id string, bi int, bj int, x int, y int, dx int, dy int, data binary")


def advance_in_place(state: DataFrame, nx: int, ny: int, bs: int, kernel: TileKernel, steps: int, width: int, params: dict | None = None) -> DataFrame:
    """G6 on a bucketed state: only strips are shuffled; they meet the bodies in a cogroup."""
    h = steps * kernel.radius * kernel.stages
    check_halo(nx, ny, bs, h)
    names = ["run_id", "t", "bi", "bj", "ni", "nj", "body", "edges"]
    kinds = (pa.string(), *[pa.int32()] * 5, pa.binary(), pa.binary())

    def run(key, left, right):
        if not left.num_rows:  # strips to a tile that doesn't exist
            return pa.table([pa.array([], k) for k in kinds], names)
        run_id, t, bi, bj, ni, nj, body = (left.column(c)[0].as_py() for c in names[:7])
        around = zip(*(right.column(c).to_pylist() for c in ("x", "y", "dx", "dy")), (np.frombuffer(d.as_py()) for d in right.column("data")))
        u = np.ascontiguousarray(_stepped(_around(np.frombuffer(body).reshape(-1, ni, nj), h, around), kernel, steps, params))
        return pa.table([pa.array([x], k) for x, k in zip((run_id, t + steps, bi, bj, ni, nj, u.tobytes(), _bands(u, width)), kinds)], names)

    bodies = state.select(*names[:7]).groupBy(*KEY)
    return bodies.cogroup(strips(state, nx, ny, bs, h, width).groupBy(*KEY)).applyInArrow(run, STATE)


def evolve_in_place(tiles: DataFrame, nx: int, ny: int, bs: int, kernel: TileKernel, n: int, k: int = 1, params: dict | None = None, buckets: int | None = None) -> DataFrame:
    """n steps, k per round, as ``evolve`` does them: the last frame. ``buckets`` (one task each; by default for about 64 MB of tiles, or as many as there are cores) hold the state
    in tables of the session's warehouse, of which there are two at any time, and none in the end."""
    spark, width = tiles.sparkSession, k * kernel.radius * kernel.stages
    check_halo(nx, ny, bs, width)
    packed = cut_lineage(tiles.select("run_id", "t", "bi", "bj", "ni", "nj", "data").mapInArrow(_packed(width), STATE))
    if not buckets:
        size, number = packed.agg(F.sum(F.length("body")), F.count("*")).first()
        buckets = max(-(-(size or 0) // (64 << 20)), min(number, spark.sparkContext.defaultParallelism), 1)
    name = lambda r: f"gridloom_state_{token}_{r}"
    token = uuid.uuid4().hex

    def keep(state, r):
        plain = state.write.format("parquet").option("compression", "uncompressed").option("parquet.enable.dictionary", "false")
        plain.bucketBy(buckets, *KEY).saveAsTable(name(r))
        return spark.table(name(r))

    done, rounds, state = 0, 0, keep(packed.repartition(buckets, *KEY), 0)
    while done < n:
        steps = min(k, n - done)
        done, rounds = done + steps, rounds + 1
        state = keep(advance_in_place(state, nx, ny, bs, kernel, steps, width, params), rounds)
        spark.sql(f"DROP TABLE {name(rounds - 1)}")
    out = cut_lineage(_unpack(state.drop("edges")))
    spark.sql(f"DROP TABLE {name(rounds)}")
    return out


def frame_of(tiles: DataFrame, t: int) -> DataFrame:
    return tiles.filter(F.col("t") == t)
