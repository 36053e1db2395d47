"""Near copies: keeps one document of each group linked by a likeness (Jaccard) of LIKENESS = 0.8
or more between sets of five-word shingles.

Candidates come from SimHash balls as in ``simhash``, with a radius that fits the likeness: fingerprints of sets of
likeness 0.8 differ in about 9.7 of 64 bits, give or take 2.9. Of PARTS = 6 parts of 16 bits, four of one fingerprint and two of another, one
holds at most 2 of the differing bits with a probability of 0.99 at that likeness and more above it; sets
that emit each part with at most one bit changed then meet there. What meets is compared by size (sets of likeness 0.8 differ by a
factor of 0.8 at most), on one fingerprint (RADIUS = 20 of 64 bits) and on WORDS fingerprints together, where up to WIDE bits may
differ (0.998 of the pairs at the limit). README has what was measured. Candidates are then verified by the exact likeness of their sets.

Equal sets are one from the start. A pair counts at one place only, the first where it meets. A group isn't
expanded into pairs. In the first round a set takes, at each of its places, the nearest candidate (by bits of all fingerprints); before texts are
read, a pair's likeness is estimated from SIGNATURE least hashes, one for each range of hashes, and it goes on unless that lies SURE standard deviations below
the limit. What is alike joins components. In the second round the sets that had a candidate take all of theirs that are in another component and
haven't been tried, and these are decided where they meet: first each place tells which of its sets have one, then these come with all their shingles' hashes
(32 bits, which can only make sets look more alike), and a place gives out just the pairs that join two of its components. So unlike pairs, of which a
large group of half-alike texts has many, never become rows. Rounds of the second kind end when all pairs given out are alike, as nearly always
after one: each candidate is then either found unlike or within a component. Tried pairs stand beside the sets at their place.

There are 65536 places a part, 102 rows a set. A task holds one place, in the second round with the hashes of its sets that have a candidate left there (4 bytes a
shingle); comparisons in places grow with the square
of the number of distinct sets (less than one in a hundred pairs is compared), rows with their number.

A group's keeper is one row, found by a hash of all its columns; only rows that stand more than once
are shuffled to keep one of them.

Defined results: repeated rows, rows of one id and rows without ids are copies like others; null, empty and blank texts are equal; texts with fewer words than a shingle are
one shingle; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back
from .components import components, tasks
from .simhash import ALL, SEED, _signed, spread

WIDTH, LIKENESS, RADIUS = 5, 0.8, 20
SIZE, PARTS = 16, 6  # bits of a part; parts of all fingerprints, 64 // SIZE of each
WORDS, WIDE = 4, 56  # fingerprints of 64 bits in all, and how many of their bits may differ
FEW = 1_000_000  # numbers of rows, 8 bytes each, that are broadcast
COMPARED = 1 << 18  # at once
SIGNATURE, SURE = 128, 4.5
PRINTS = ["fp", *(f"fp{k}" for k in range(2, WORDS + 1))]


def shingles_of(text: str | None, width: int = WIDTH) -> set[bytes]:
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a: str | None, b: str | None, width: int = WIDTH) -> float:
    x, y = shingles_of(a, width), shingles_of(b, width)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


def _majority(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 200):  # sums of up to 200 ones stay within a byte
        ones += np.unpackbits(h[a : a + 200].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(h)).view(">i8")[0])


def signature_of(h: np.ndarray) -> bytes:
    """Of sorted hashes the least one of each of SIGNATURE ranges, 16 of its bits (not 0, which stands for none)."""
    out = np.zeros(SIGNATURE, np.uint16)
    part, first = np.unique(h >> np.uint64(64 - SIGNATURE.bit_length() + 1), return_index=True)
    out[part.astype(np.int64)] = np.maximum((h[first] >> np.uint64(20)).astype(np.uint16), 1)
    return out.tobytes()


def likely(a: np.ndarray, b: np.ndarray, likeness: float) -> np.ndarray:
    """Which rows of two arrays of signatures may be alike."""
    some = (a != 0) | (b != 0)
    n, same = some.sum(1), ((a == b) & some).sum(1)
    return same >= likeness * n - SURE * np.sqrt(n * likeness * (1 - likeness))


def set_of(text: str | None, width: int = WIDTH) -> tuple:
    """sid, a number of the shingle set; its size; WORDS fingerprints; its signature."""
    found = shingles_of(text, width)
    if not found:
        return (0,) * (2 + WORDS) + (bytes(2 * SIGNATURE),)
    h = np.sort(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found)))
    signature = signature_of(h)
    prints, sid = [_majority(h)], _signed(xxhash.xxh64_intdigest(h.tobytes(), SEED))
    for _ in range(WORDS - 1):  # each from other hashes
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(32))
        prints.append(_majority(h))
    return sid, len(h), *prints, signature


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs (row, id, text) to row, id, sid, n, fp, and fp2, fp3 ..., signature"""
    kind = docs.schema["id"].dataType.simpleString()
    names = ["sid", "n", *PRINTS]

    def run(batches):
        for batch in batches:
            made = [set_of(t.as_py(), width) for t in batch.column(2)]
            found = np.array([m[:-1] for m in made], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(found[:, k]) for k in range(len(names))), pa.array([m[-1] for m in made], pa.binary())], ["row", "id", *names, "signature"])
        give_back()

    return docs.select("row", "id", "text").mapInArrow(run, f"row long, id {kind}, " + ", ".join(f"{c} long" for c in names) + ", signature binary")


def places(sets: DataFrame) -> DataFrame:
    """sets (n, fingerprints and others) with key: each part with at most one bit changed, the part's number above it, and below it n + 1."""
    own, each = sets.columns, 64 // SIZE
    part = F.element_at(F.array(*PRINTS[: -(-PARTS // each)]), F.col("c.print"))
    changes = [(p // each + 1, SIZE * (p % each), p << SIZE | (1 << b if b >= 0 else 0)) for p in range(PARTS) for b in (-1, *range(SIZE))]
    listed = F.array(*(F.struct(F.lit(k).alias("print"), F.lit(shift).alias("shift"), F.lit(flip).cast("long").alias("flip")) for k, shift, flip in changes))
    found = sets.select(*own, F.explode(listed).alias("c")).withColumn("part", part)
    return found.selectExpr(f"shiftleft(shiftrightunsigned(part, c.shift) & {(1 << SIZE) - 1}L ^ c.flip, 32) | (n + 1) AS key", *own)


def _first_place(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Of the places where sets with fingerprints x and y both are, the one that stands for the pair; -1 if there is none."""
    found, mask, each = np.full(len(x[0]), -1), np.uint64((1 << SIZE) - 1), 64 // SIZE
    for p in range(PARTS):
        a, b = (c[p // each] >> np.uint64(SIZE * (p % each)) & mask for c in (x, y))
        low = (a ^ b) & ~(a ^ b) + np.uint64(1)  # the lowest differing bit, if any
        here = np.minimum(a ^ low, b ^ low).astype(np.int64) | p << SIZE
        found = np.where((found < 0) & (np.bitwise_count(a ^ b) <= 2), here, found)
    return found


def _nearest(i: np.ndarray, j: np.ndarray, bits: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the ``most`` nearest of i or of j."""
    source, other, pair = np.r_[i, j], np.r_[j, i], np.r_[np.arange(len(i)), np.arange(len(i))]
    order = np.lexsort((other, np.r_[bits, bits], source))
    first = np.r_[True, source[order][1:] != source[order][:-1]][: len(order)]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    keep = np.zeros(len(i), bool)
    keep[pair[order[rank < most]]] = True
    return keep


def _met(place: int, n: np.ndarray, sid: np.ndarray, root: np.ndarray, prints: list[np.ndarray], old: tuple, likeness: float):
    """Pairs i > j of one place's sets (by size) that may be alike, have other roots and no earlier place and aren't among old ones (sids, the greater first), with their differing bits; some at a time."""
    m, at = len(n), 1
    order = np.argsort(sid)
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    if len(old[0]):
        here = np.isin(old[0], sid) & np.isin(old[1], sid)
        old = np.searchsorted(sid[order], old[0][here]) * m + np.searchsorted(sid[order], old[1][here])
    else:
        old = None
    while at < m:
        low = int(np.searchsorted(n, likeness * n[at] - 1e-6))
        to = min(m, at + max(1, COMPARED // (m - low)))
        i, j = np.nonzero(np.bitwise_count(prints[0][at:to, None] ^ prints[0][None, low:to]) <= RADIUS)
        i, j = i + at, j + low
        good = (j < i) & (n[j] >= likeness * n[i] - 1e-6) & (root[i] != root[j])
        i, j = i[good], j[good]
        good = _first_place([p[i] for p in prints], [p[j] for p in prints]) == place
        i, j = i[good], j[good]
        bits = sum(np.bitwise_count(p[i] ^ p[j]).astype(np.int64) for p in prints)
        good = bits <= WIDE
        if old is not None:
            good &= ~np.isin(np.maximum(rank[i], rank[j]) * m + np.minimum(rank[i], rank[j]), old)
        yield i[good], j[good], bits[good]
        at = to


def _joining(met, root: np.ndarray, hashes: list[np.ndarray], likeness: float) -> list[tuple[int, int]]:
    """Of a place's pairs those that are alike by their sets' hashes and join two of its components."""
    lengths = np.array([len(h) for h in hashes], np.int64)
    ends, component, out = np.cumsum(lengths), np.unique(root, return_inverse=True)[1], []
    names, flat = np.unique(np.concatenate(hashes), return_inverse=True)
    own = np.zeros(len(names), bool)
    for i, j, _ in met:
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
        for s, e in zip(starts.tolist(), np.r_[starts[1:], len(i)].tolist()):
            k, others = i[s], j[s:e]
            own[flat[ends[k] - lengths[k] : ends[k]]] = True
            while len(others := others[component[others] != component[k]]):
                part, others = np.split(others, [max(1, COMPARED // int(lengths[k]))])
                upto = np.cumsum(lengths[part])
                found = own[flat[np.repeat(ends[part] - upto, lengths[part]) + np.arange(upto[-1])]]
                both = np.add.reduceat(found, upto - lengths[part], dtype=np.int64)
                for o in part[both >= (likeness - 1e-9) * (lengths[k] + lengths[part] - both)].tolist():
                    if component[o] != component[k]:
                        out.append((k, o))
                        component[component == component[o]] = component[k]
            own[flat[ends[k] - lengths[k] : ends[k]]] = False
    return out


def _by_place(listed: DataFrame, tried: DataFrame | None, each, schema: str) -> DataFrame:
    """listed (key, sid, fingerprints, perhaps root and hashes) and tried pairs (meet, a, b; a > b), brought together by place;
    ``each(meet, n, sid, root, prints, hashes, old)`` gives a place's rows, as columns."""

    columns = listed.columns
    if tried is not None:
        none = [F.lit(None if c == "hashes" else 0).cast(dict(listed.dtypes)[c]).alias(c) for c in columns[2:] if c != "root"]
        listed = listed.unionByName(tried.select(F.shiftleft("meet", 32).alias("key"), F.col("a").alias("sid"), F.col("b").alias("root"), *none))

    def done_with(key, sid, *more):
        prints, root = [p.view(np.uint64) for p in more[:WORDS]], more[WORDS] if len(more) > WORDS else sid
        meet, n = key >> 32, (key & ((1 << 32) - 1)) - 1
        starts, made = np.flatnonzero(np.r_[True, meet[1:] != meet[:-1]]), []
        for s, e in zip(starts.tolist(), np.r_[starts[1:], len(meet)].tolist()):
            t = s + int(np.searchsorted(n[s:e], 0))  # first come the tried pairs
            if e - t > 1:
                made.append(each(meet[s], n[t:e], sid[t:e], root[t:e], [p[t:e] for p in prints], more[-1][t:e], (sid[s:t], root[s:t])))
        names = [c.split()[0] for c in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (zip(*made) if made else [[]] * len(names))], names)

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            meet = new[0] >> 32
            done = int(np.searchsorted(meet, meet[-1]))  # the last place may go on
            if held and (done or held[-1][0][-1] >> 32 != meet[0]):
                yield done_with(*(np.concatenate(c) for c in zip(*held, [c[:done] for c in new])))
                held = []
            elif done:
                yield done_with(*(c[:done] for c in new))
            held.append([c[done:] for c in new])
        if held:
            yield done_with(*(np.concatenate(c) for c in zip(*held)))
        held.clear()
        give_back()

    return listed.repartition(F.shiftright("key", 32)).sortWithinPartitions("key", "sid").select(*columns).mapInArrow(run, schema)


def _listed(sets: DataFrame) -> DataFrame:
    columns = ["key", "sid", *PRINTS] + ["root"] * ("root" in sets.columns)
    return places(spread(sets.select("n", *columns[1:]), "sid")).select(*columns)


def _candidates(sets: DataFrame, tried: DataFrame | None, most: int, likeness: float) -> DataFrame:
    """sets (sid, n, fingerprints, root) to pairs meet, a, b that may be alike: for each set and place (meet) the ``most`` nearest
    others with another root, of the pairs that have no earlier place and aren't in tried (meet, a, b; a > b). Without tried each set is its own root."""

    def nearest(meet, n, sid, root, prints, hashes, old):
        found = [np.zeros(0, np.int64)] * 3
        for new in _met(meet, n, sid, root, prints, old, likeness):
            found = [np.concatenate(c) for c in zip(found, new)]
            if len(found[0]) > 4 * COMPARED:
                keep = _nearest(*found, most)
                found = [f[keep] for f in found]
        keep = _nearest(*found, most)
        a, b = sid[found[0][keep]], sid[found[1][keep]]
        return np.full(len(a), meet), np.maximum(a, b), np.minimum(a, b)

    listed = _listed(sets if tried is not None else sets.select("sid", "n", *PRINTS))
    return _by_place(listed, tried, nearest, "meet long, a long, b long")


def _joined(sets: DataFrame, hashes: DataFrame, tried: DataFrame, likeness: float) -> DataFrame:
    """Of all pairs of sets (sid, n, fingerprints, root) that ``_candidates`` may give, those meet, a, b that are alike by their hashes
    (sid, hashes) and join two components of their place."""

    def some(meet, n, sid, root, prints, hashes, old):
        mine = np.zeros(len(sid), bool)
        for i, j, _ in _met(meet, n, sid, root, prints, old, likeness):
            mine[i] = mine[j] = True
        return np.full(int(mine.sum()), meet), sid[mine]

    def joining(meet, n, sid, root, prints, hashes, old):
        pairs = _joining(_met(meet, n, sid, root, prints, old, likeness), root, [np.frombuffer(h, "<u4") for h in hashes], likeness)
        a, b = (sid[np.array([p[k] for p in pairs], np.int64)] for k in (0, 1))
        return np.full(len(a), meet), np.maximum(a, b), np.minimum(a, b)

    found = _by_place(_listed(sets), tried, some, "meet long, sid long")
    listed = found.join(sets.select("sid", "n", *PRINTS, "root").join(hashes, "sid"), "sid").selectExpr("shiftleft(meet, 32) | (n + 1) AS key", "sid", *PRINTS, "root", "hashes")
    return _by_place(listed, tried, joining, "meet long, a long, b long")


def _hashed(texts: DataFrame, width: int) -> DataFrame:
    """texts (sid, text) to sid, hashes: 32 bits of each shingle's hash."""

    def run(batches):
        for batch in batches:
            made = [np.fromiter((xxhash.xxh64_intdigest(s, SEED) & 0xFFFFFFFF for s in shingles_of(t.as_py(), width)), "<u4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["sid", "hashes"])
        give_back()

    return texts.select("sid", "text").mapInArrow(run, "sid long, hashes binary")


def _likely(pairs: DataFrame, signatures: DataFrame, likeness: float) -> DataFrame:
    """The pairs (a, b) whose signatures (sid, signature) don't tell them apart."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, SIGNATURE) for c in batch.columns[2:])
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(likely(a, b, likeness), pa.bool_()))

    named = lambda c: signatures.select(F.col("sid").alias(c), F.col("signature").alias(f"s_{c}"))
    return pairs.select("a", "b").join(named("a"), "a").join(named("b"), "b").select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, likeness: float) -> DataFrame:
    """The pairs (a, b) whose texts (sid, text) are alike."""
    named = lambda c: texts.select(F.col("sid").alias(c), F.col("text").alias(f"text_{c}"))

    def run(batches):
        for batch in batches:
            good = pa.array([jaccard(s.as_py(), t.as_py(), width) >= likeness for s, t in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(good)
        give_back()

    joined = pairs.join(named("a"), "a").join(named("b"), "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def set_roots(sets: DataFrame, docs: DataFrame, width: int = WIDTH, likeness: float = LIKENESS) -> DataFrame:
    """sets (sid, n, fp, fp2 ..., signature, row: of one text) of docs (row, text) to node, root: the least sid
    reachable, for sets that are alike to others."""

    def asked(pairs):
        return cut(sets.join(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sid", "left_semi").coalesce(tasks(pairs.count())))

    def texts(some):
        rows = some.select("sid", "row")
        return docs.join(F.broadcast(rows) if rows.count() <= FEW else rows, "row").groupBy("sid").agg(F.first("text").alias("text"))

    pairs = cut(_candidates(sets, None, 1, likeness))
    number = pairs.count()
    if not number:
        return sets.limit(0).select(F.col("sid").alias("node"), F.col("sid").alias("root"))
    near = asked(pairs)  # all sets that ever have a candidate have one in the first round
    tried = pairs.coalesce(tasks(number))
    maybe = cut(_likely(tried, near, likeness).coalesce(tasks(number)))
    edges = cut(_verified(maybe, texts(near), width, likeness))
    hashes = cut(_hashed(texts(near), width))
    while True:
        roots = cut(components(edges))
        left = cut(near.join(roots, F.col("sid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sid")).drop("node"))
        pairs = cut(_joined(left, hashes, tried, likeness))
        number = pairs.count()
        if not number:
            return roots
        pairs = pairs.coalesce(tasks(number))
        alike = cut(_verified(pairs, texts(asked(pairs)), width, likeness))
        edges, tried = edges.unionByName(alike), tried.unionByName(pairs)
        if alike.count() == number:
            return cut(components(edges))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, likeness: float = LIKENESS) -> DataFrame:
    """One row of docs for each group: that of the least id, nulls last; of equal rows one."""
    plain = [c for c, kind in docs.dtypes if not kind.startswith("map")]
    row = F.xxhash64(*plain, *(F.col(c).isNull() for c in plain))  # the hash alone passes over nulls
    texts = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = cut(shingle_sets(texts, width))
    # nulls last; a row stands for its set and its set's group
    least = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "row")).alias("least")
    sets = cut(prints.groupBy("sid", "n", *PRINTS).agg(least, F.first("signature").alias("signature")).select("sid", "n", *PRINTS, "signature", "least.row", "least"))
    roots = set_roots(sets.drop("least"), texts.select("row", "text"), width, likeness)
    grouped = sets.join(roots, sets["sid"] == roots["node"], "left").groupBy(F.coalesce("root", "sid").alias("root"))
    kept = grouped.agg(F.min("least").alias("least")).select(F.col("least.row").alias("__kept"))
    kept = cut(kept.join(prints.groupBy(F.col("row").alias("__kept")).agg((F.count("*") > 1).alias("__again")), "__kept"))
    of = lambda again: docs.withColumn("__row", row).join(kept.filter(F.col("__again") == again), F.col("__row") == F.col("__kept"), "left_semi")
    return of(False).unionByName(of(True).dropDuplicates(["__row"])).drop("__row")
