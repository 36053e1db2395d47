"""Periodic runs of words: where a document repeats a stretch of words at least REPEATS times in a row.

A run is a stretch of consecutive words with least period q, at least LEAST words and REPEATS * q long, that no neighbouring word
extends. Along the diagonal of lag q, the words that equal the one q before them form match lengths: a word adds one to the
lag's length, another word ends it, and a diagonal that ends with 2 * q or more (LEAST - q for short lags) is a run, given out at once.

Only few diagonals are followed. Lags up to DENSE all are, for many documents together. A longer lag, of G + 1 to 2 * G for G = 16, 32 ...,
becomes active at a word that, with the G - 1 before it, occurred that far before: at most three earlier occurrences are
looked at, which loses no run. (If all stretches of G words in one period of a run were repeated within G / 2 words, they would have one
common period, and so would the run, against q being its least one; so the run has a stretch whose occurrences are more than G / 2
apart, of which the one at lag q is the first, second or third.) From there a diagonal is followed both ways, and it isn't activated again before
it has ended. A stretch that is no repeat is none of twice the length either, so that longer lags look at what is left of shorter ones: a
text without repeats costs one sort, and time grows as n log n, not with the square of a word's occurrences.

One Arrow pass, no shuffle; a task holds a batch of documents (``AT_ONCE`` words, or one document) beside Spark's own batch.

Defined results: null, empty and blank texts have no words, no runs and an empty collapsed text; words are split at ASCII white
space; repeated rows and rows without ids are documents like others; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAST, REPEATS, DENSE, AT_ONCE = 24, 3, 16, 1 << 17
Run = tuple[int, int, int]  # start, length, period


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of true begin and end."""
    edges = np.flatnonzero(same[1:] != same[:-1]) + 1
    if len(same) and same[0]:
        edges = np.r_[0, edges]
    if len(edges) % 2:
        edges = np.r_[edges, len(same)]
    return edges[::2], edges[1::2]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _matched(w: np.ndarray, lag: int, at: int, step: int) -> int:
    """How many words from ``at`` on, forward or (step -1) backward, equal the one ``lag`` before them."""
    done, width = 0, 64
    while True:
        if step > 0:
            a, b = w[at + done : at + done + width], w[at + done - lag : at + done + width - lag]
            b = b[: len(a)]
        else:
            low = max(lag, at - done - width + 1)
            a, b = w[low : at - done + 1][::-1], w[low - lag : at - done + 1 - lag][::-1]
        differ = a != b
        if differ.any():
            return done + int(differ.argmax())
        done += len(a)
        if len(a) < width:
            return done
        width *= 4


def _active(w: np.ndarray, longest: int):
    """(word, lag) pairs at which long lags become active, lag by lag class, each with the width G of the class."""
    h, width, at = _mixed(w.astype(np.uint64) + np.uint64(1)), 1, None
    while width < DENSE:  # the hash of the width words that end at a place
        h = np.r_[h[:width], _mixed(h[width:] + _mixed(h[:-width] ^ np.uint64(width)))]
        width *= 2
    at = np.arange(width - 1, len(w))
    known = h[at]
    while len(at) and REPEATS * (width + 1) <= longest:
        order = np.argsort(known, kind="stable")
        place, value = at[order], known[order]
        twin = value[1:] == value[:-1]
        events = []
        for k in (1, 2, 3):
            chain = twin[k - 1 :].copy()
            for back in range(1, k):
                chain &= twin[k - 1 - back : len(twin) - back]
            later = place[k:][chain]
            lag = later - place[:-k][chain]
            good = (lag > width) & (lag <= 2 * width)
            events.append((later[good], lag[good]))
        word, lag = (np.concatenate(c) for c in zip(*events))
        # of 2 * lag matches that hold this word, lag lie on one side of it
        ahead, behind = word + lag - 1, word - lag + 1
        w_ahead = (ahead < len(w)) & (w[np.minimum(ahead, len(w) - 1)] == w[np.minimum(ahead, len(w) - 1) - lag])
        w_behind = (behind >= lag) & (w[np.maximum(behind, 0)] == w[np.maximum(behind - lag, 0)])
        word, lag = word[w_ahead | w_behind], lag[w_ahead | w_behind]
        order = np.lexsort((word, lag))
        word, lag = word[order], lag[order]
        first = np.r_[True, (word[1:] != word[:-1] + 1) | (lag[1:] != lag[:-1])][: len(word)]
        yield width, word[first], lag[first]
        # only repeated stretches can be part of longer ones
        again = np.zeros(len(w), bool)
        again[place[np.r_[False, twin] | np.r_[twin, False]]] = True
        value_at = np.zeros(len(w), np.uint64)
        value_at[at] = known
        at = np.flatnonzero(again[width:] & again[:-width]) + width
        known = _mixed(value_at[at] + _mixed(value_at[at - width] ^ np.uint64(width)))
        width *= 2


def find(w: np.ndarray, longest: int | None = None) -> list[Run]:
    """All runs of an array of word numbers. Several documents may stand in it, with a number of its own between
    any two; ``longest`` is the length of the longest one."""
    longest = len(w) if longest is None else longest
    found: dict[tuple[int, int], int] = {}  # start and end to the least period: multiples of it match as far
    for lag in range(1, min(DENSE, longest // REPEATS) + 1):
        start, end = _stretches(w[lag:] == w[:-lag])
        for s, e in zip(start.tolist(), end.tolist()) if len(start) < 64 else _long(start, end, lag):
            if e - s + lag >= max(LEAST, REPEATS * lag):
                found.setdefault((s, e + lag), lag)
    for width, words, lags in _active(w, longest) if longest >= REPEATS * (DENSE + 1) else ():
        ended: dict[int, int] = {}
        for word, lag in zip(words.tolist(), lags.tolist()):
            if ended.get(lag, -1) < word:
                last = word + _matched(w, lag, word + 1, 1)
                first = word - width + 1 - _matched(w, lag, word - width, -1)
                ended[lag] = last
                if last - first + 1 >= (REPEATS - 1) * lag:
                    key = first - lag, last + 1
                    found[key] = min(lag, found.get(key, lag))
    return sorted((s, e - s, lag) for (s, e), lag in found.items())


def _long(start: np.ndarray, end: np.ndarray, lag: int):
    good = end - start + lag >= max(LEAST, REPEATS * lag)
    return zip(start[good].tolist(), end[good].tolist())


def runs_of(documents: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each document's words, many short documents at a time."""
    out: list[list[Run]] = [[] for _ in documents]
    sizes = np.array([len(d) for d in documents], np.int64)
    long = [k for k, n in enumerate(sizes.tolist()) if n >= LEAST]
    a = 0
    while a < len(long):
        b, held = a, 0
        while b < len(long) and (b == a or held + sizes[long[b]] <= AT_ONCE):
            held += sizes[long[b]] + 1
            b += 1
        part = long[a:b]
        number: dict[bytes, int] = {}
        w = np.empty(held, np.int32)
        starts, at = [], 0
        for k in part:
            n = int(sizes[k])
            starts.append(at)
            w[at : at + n] = [number.setdefault(x, len(number)) for x in documents[k]]
            w[at + n] = -1 - k
            at += n + 1
        for s, length, period in find(w, int(sizes[part].max())):
            i = int(np.searchsorted(starts, s, side="right")) - 1
            out[part[i]].append((s - starts[i], length, period))
        a = b
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that are not a repetition: of each run the first period stays."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[k] for k in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """id, n_words, runs (array of start, length, period, by start and period), collapsed (text without repetitions): a row for
    each row of docs. ``change`` (id, words), if given, replaces a document's words first."""
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def part(ids, texts):
        documents = [(t or "").encode().split() for t in texts.to_pylist()]
        if change:
            documents = [change(name, words) for name, words in zip(ids.to_pylist(), documents)]
        runs = runs_of(documents)
        rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
        return pa.RecordBatch.from_arrays([ids, pa.array([len(d) for d in documents], pa.int64()), pa.array(rows, run_type), pa.array([collapsed(d, r).decode() for d, r in zip(documents, runs)], pa.string())], [id_col, "n_words", "runs", "collapsed"])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                yield part(batch.column(0).slice(a, 500), batch.column(1).slice(a, 500))

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(name: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's change: a tenth of the documents repeat from some word on."""
    h, n = zlib.crc32(str(name).encode()), len(words)
    if name is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents"), change=planted)
    # the greatest exponent as a fraction, without rounding: a before b if a.length * b.period > b.length * a.period
    better = "(a, b) -> CASE WHEN a.length * b.period > b.length * a.period THEN -1 WHEN a.length * b.period < b.length * a.period THEN 1 WHEN a.start <> b.start THEN CASE WHEN a.start < b.start THEN -1 ELSE 1 END WHEN a.period < b.period THEN -1 WHEN a.period > b.period THEN 1 ELSE 0 END"
    best = found.withColumn("best", F.expr(f"CASE WHEN size(runs) > 0 THEN element_at(array_sort(runs, {better}), 1) END"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
