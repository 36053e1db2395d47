"""Language identification by a byte convolutional network.

The network, trained in numpy on the driver: bytes become vectors, filters of widths 2, 3 and 4
run over windows of ``WINDOW`` bytes, each filter keeps its greatest response in a window, and a
softmax over these gives the window's language probabilities. A text's probabilities are its
windows' averages, weighted by the bytes that a window really has (the last one is filled up with
byte 0, whose vector is zero). Every byte of a text is in a window, whatever the text's length.

Training takes about ``SAMPLE`` documents in all, the same number of each language (a hash of the
id decides), with all windows of their whole texts: the only data that reaches the driver. A language's
sampled documents are taken in the order of that hash up to ``SAMPLE_BYTES`` together, divided by the number of languages, so
that long texts can't exceed the driver: those with more than an eighth of that share come after all others, and the last
one is cut where the share ends, so that no language is lost behind a long text. With
more than ``SAMPLE`` languages some are not learned. The trained weights are some tens of kilobytes, and a row
for each language. Prediction is one Arrow pass without shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0; other texts get a
learned language, even if very short; rows with a null language or id train nothing; repeated
rows get equal predictions; without any labelled row every text is ``und``; an empty table gives
an empty result. Other columns are ignored by ``predict`` and carried along by ``keep_confident``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, table
from .samples import fold, per_class

WINDOW, DIMS, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 16
SAMPLE, SAMPLE_BYTES, EPOCHS, MIN_SCORE = 1000, 8 << 20, 4, 0.5
POSITIONS = WINDOW - max(WIDTHS) + 1


class ByteNet:
    """emb (256, DIMS), filters (all filters, widest * DIMS) with zeros beyond a filter's width,
    bias, out (languages, all filters), base (languages)."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        self.languages = languages
        self.mask = np.repeat([[o < w for o in range(max(WIDTHS))] for w in WIDTHS], FILTERS, axis=0).repeat(DIMS, axis=1).astype(np.float32)
        self.emb = rng.normal(0, 0.5, (256, DIMS)).astype(np.float32)
        self.emb[0] = 0
        self.filters = (rng.normal(0, 0.3, (n, max(WIDTHS) * DIMS)) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (len(languages), n)).astype(np.float32)
        self.base = np.zeros(len(languages), np.float32)

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """Vectors under each position: (widest * DIMS, windows * POSITIONS)."""
        v = np.ascontiguousarray(self.emb.T)[:, windows.reshape(-1)].reshape(DIMS, len(windows), WINDOW)
        return np.concatenate([v[:, :, o : o + POSITIONS].reshape(DIMS, -1) for o in range(max(WIDTHS))])

    def pooled(self, x: np.ndarray, n: int) -> np.ndarray:
        return (self.filters @ x).reshape(-1, n, POSITIONS)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        found = []
        for i in range(0, len(windows), 64):
            part = windows[i : i + 64]
            top = np.maximum(self.pooled(self.patches(part), len(part)).max(2).T + self.bias, 0)
            logit = top @ self.out.T + self.base
            e = np.exp(logit - logit.max(1, keepdims=True))
            found.append(e / e.sum(1, keepdims=True))
        return np.concatenate(found)

    def gradients(self, windows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the loss (mean cross entropy, weighted by language) for each array, and the loss."""
        n = len(windows)
        x = self.patches(windows)
        response = self.pooled(x, n)
        best = response.argmax(2)
        raw = np.take_along_axis(response, best[:, :, None], 2)[:, :, 0].T + self.bias
        top = np.maximum(raw, 0)
        logit = top @ self.out.T + self.base
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = float(-(np.log(p[np.arange(n), labels]) * weight[labels]).mean())
        p[np.arange(n), labels] -= 1
        p *= weight[labels][:, None] / n
        d_top = (p @ self.out) * (raw > 0)
        at = best + np.arange(n) * POSITIONS  # a column of x for each filter and window
        d_filters = np.stack([x[:, at[f]] @ d_top[:, f] for f in range(len(at))])
        d_emb = np.zeros_like(self.emb)
        for o in range(max(WIDTHS)):
            part = d_top.T[:, :, None] * self.filters[:, None, o * DIMS : (o + 1) * DIMS]
            np.add.at(d_emb, windows[np.arange(n), best + o].reshape(-1), part.reshape(-1, DIMS))
        d_emb[0] = 0
        return {"emb": d_emb, "filters": d_filters * self.mask, "bias": d_top.sum(0), "out": p.T @ top, "base": p.sum(0)}, loss

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, batch: int = 64, seed: int = 11) -> "ByteNet":
        rng, names, t = np.random.default_rng(seed), ("emb", "filters", "bias", "out", "base"), 0
        first, second = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        weight = (len(labels) / (len(self.languages) * np.maximum(np.bincount(labels, minlength=len(self.languages)), 1))).astype(np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for rows in (order[i : i + batch] for i in range(0, len(order), batch)):
                grads, _ = self.gradients(windows[rows], labels[rows], weight)
                t += 1
                for k in names:
                    g = grads[k]
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    step = rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - step).astype(np.float32))
        return self


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, the text each belongs to, and its number of real bytes."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    rows = np.frombuffer(b"".join(t + bytes(-len(t) % WINDOW) for t in texts), np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    filled = np.full(len(rows), WINDOW)
    ends = np.cumsum(counts)[counts > 0] - 1
    filled[ends] = [(len(t) - 1) % WINDOW + 1 for t in texts if t]
    return rows, owner, filled


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> ByteNet | None:
    """Learns from the rows of docs that have a language; None if there is none."""
    own = F.xxhash64(F.lit("lid"), F.col(id_col))
    known = docs.filter(F.col(lang).isNotNull() & F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang).alias("lang"), F.col(text_col).alias("text"), own.alias("own"))
    taken, languages = per_class(known, "lang", F.col("own"), sample)
    share = sample_bytes // max(1, languages)
    cut_to = lambda n: F.substring(F.col("text"), F.lit(1), n)  # noqa: E731  characters: a few times the bytes at most
    sized = taken.withColumn("size", F.octet_length("text")).withColumn("long", F.col("size") > share // 8).withColumn("text", cut_to(F.lit(share)))
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("long", "own", "text").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")  # of sampled rows
    fits = sized.withColumn("left", (share - before).cast("int")).filter("left > 0").select("lang", "own", cut_to(F.col("left")).alias("text"))
    rows = sorted((r["lang"], r["own"], r["text"]) for r in fits.collect())
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    windows, owner, _ = windows_of([r[2].encode() for r in rows])
    return ByteNet(languages).fit(windows, np.array([languages.index(r[0]) for r in rows])[owner])


def scored(texts: list[str | None], net: ByteNet | None) -> list[tuple[str, float]]:
    """Language and its probability of each text, a few megabytes at a time."""
    found, sizes = [("und", 0.0)] * len(texts), np.cumsum([len(t or "") for t in texts]) // 2_000_000
    for g in np.unique(sizes) if net else []:
        rows = [i for i in np.flatnonzero(sizes == g) if any(map(str.isalpha, texts[i] or ""))]
        if rows:
            windows, owner, filled = windows_of([texts[i].encode() for i in rows])
            total = np.add.reduceat(net.probabilities(windows) * filled[:, None], np.searchsorted(owner, np.arange(len(rows))), axis=0)
            total /= total.sum(1, keepdims=True)
            for i, best, x in zip(rows, total.argmax(1), total.max(1)):
                found[i] = (net.languages[best], min(1.0, float(x)))
    return found


def predict(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score: a row for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = scored(batch.column(1).to_pylist(), net)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_confident(docs: DataFrame, net: ByteNet | None, min_score: float = MIN_SCORE, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is known with at least ``min_score``."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep = [language != "und" and score >= min_score for language, score in scored(batch.column(at).to_pylist(), net)]
            yield batch.filter(pa.array(keep, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = fold(F.col("doc_id"), 3)
    net = train(docs.filter(remainder != 1))
    return predict(docs, net).select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
