"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses and each clause into words; words are read as symbols: insult, threat,
target, negation, reporting verb, other. Five small transducers read the same symbols:

* insult passes on the weight of insults and words of threats;
* threat notes a word of threat and somebody addressed, in any order; both together multiply the
  clause's weight, so that a word of threat alone reaches that of a sure insult ("I will kill you") and insults in it weigh more;
* target notes whether somebody is addressed, before or after, and raises the clause's weight;
* negation lowers what follows within three words ("not a ...");
* reported speech lowers what follows a reporting verb in the clause ("called him a ...").

They are composed into one machine over the product of their states, built once. A clause's
weight is the composed machine's output along the clause, a text's the sum over its clauses.

The insult words, and word beginnings that several of them share, are learned from labelled texts
and weighted by log-odds. A place (a word after another) counts for one text only, so that copies
of a labelled text are one witness and what is frequent in a single text is too. The words of
threats, targets, negations and reports are fixed, and so is the weight of a threat. A logistic
curve of two numbers, fitted to the same labels, makes the weight a score.

Training takes about ``SAMPLE`` labelled rows of each label (a hash of the id decides); their ids,
of a size that this bound gives, are broadcast, so that texts are not shuffled for it; the labelled texts
are written once. Every word and beginning with ``WITNESSES`` toxic texts and odds of ``LEAST_ODDS``
is learned; the sample bounds their number. Scoring is one Arrow pass without shuffle.

Defined results: null and empty texts, and texts without a match, get the curve's value at weight 0;
ids that are labelled twice count as toxic if one label says so; null labels and ids teach nothing; without
labels of both kinds nothing is learned and the score is the share of toxic labels, or 0; repeated rows
get equal scores; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .samples import fold, per_class

SAMPLE, WITNESSES, LEAST_ODDS = 3000, 5, 12.0
STEMS, WORDS_OF_STEM, REMEMBERED = range(3, 9), 3, 500_000
CLAUSE, WORD = re.compile(r"[.!?;:\n]+"), re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
# Words of a role, in the languages of the texts.
TARGETS = "you your yours yourself he him his she her they them their these those everyone people tu te toi vous ton votre du dich dir ihr euch sie tú ti usted ustedes vosotros ellos ils elles lui"
NEGATIONS = "not no never neither nor without hardly isn't aren't wasn't don't doesn't didn't ne pas jamais ni sans nicht kein keine nie ohne nunca sin tampoco"
REPORTS = "said says say called calls wrote writes claimed claims reported quoted quote quotes alleged dit disait appelle écrit sagte sagt nannte schrieb dijo dice llamó escribió"
THREATS = "kill hurt destroy beat shoot burn attack punish tuer frapper töten schlagen matar golpear"
SCOPE, TARGET_GAIN, NEGATED, REPORTED, HARM = 3, 1.25, 0.35, 0.5, 4.0
# Set beforehand, as few labelled texts hold a threat: a word of threat alone weighs little, joined with a
# target as much as the surest insult.
THREATENED = 1.0
THREAT_GAIN = HARM / THREATENED


def _compose(*machines):
    """The machine over tuples of states. A machine is (start, step, last): step(state, symbol) to
    (state, factor of the word's weight), last(state) to a factor of the whole clause."""
    start = tuple(m[0] for m in machines)
    number, todo, arcs, ends = {start: 0}, [start], [], []
    while todo:
        state = todo.pop(0)
        row = []
        for symbol in range(OTHER + 1):
            parts = [m[1](s, symbol) for m, s in zip(machines, state)]
            after, factor = tuple(p[0] for p in parts), float(np.prod([p[1] for p in parts]))
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append((number[after], factor))
        arcs.append(row)
        ends.append(float(np.prod([m[2](s) for m, s in zip(machines, state)])))
    return arcs, ends


def grammar():
    """Arcs [state][symbol] to (state, factor), and each state's factor at a clause's end."""
    keep = lambda s: 1.0
    insult = (0, lambda s, x: (0, 1.0 if x in (INSULT, THREAT) else 0.0), keep)
    threat = ((False, False), lambda s, x: ((s[0] or x == THREAT, s[1] or x == TARGET), 1.0), lambda s: THREAT_GAIN if all(s) else 1.0)
    target = (0, lambda s, x: (1 if x == TARGET else s, 1.0), lambda s: TARGET_GAIN if s else 1.0)
    negation = (0, lambda s, x: (SCOPE if x == NEGATION else max(0, s - 1), NEGATED if s and x in (INSULT, THREAT) else 1.0), keep)
    report = (0, lambda s, x: (1 if x == REPORT else s, REPORTED if s and x in (INSULT, THREAT) else 1.0), keep)
    return _compose(insult, threat, target, negation, report)


_THREATS = frozenset(THREATS.split())


class _Weights(dict):
    """Word to the greatest weight of itself and its beginnings (written ``abc*``); words of threats
    weigh THREATENED at least."""

    def __init__(self, learned: dict[str, float]):
        self.learned = learned

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        get = self.learned.get
        self[word] = found = max(get(word, 0.0), THREATENED if word in _THREATS else 0.0, *(get(word[:n] + "*", 0.0) for n in STEMS))
        return found


class Grammar:
    """The composed machine with the learned words and the curve."""

    def __init__(self, learned: dict[str, float], slope: float = 1.0, base: float = 0.0):
        self.arcs, self.ends = grammar()
        self.learned, self.slope, self.base = learned, slope, base
        self.symbols = {w: k for k, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in words.split()}
        self.weights = _Weights(learned)

    def __reduce__(self):
        return Grammar, (self.learned, self.slope, self.base)

    def clause(self, words: list[str]) -> float:
        """The machine's output along the words."""
        state, total = 0, 0.0
        for word in words:
            weight = self.weights[word]
            state, factor = self.arcs[state][self.symbols.get(word, INSULT if weight else OTHER)]
            total += factor * weight
        return total * self.ends[state]

    def weight(self, text: str | None) -> float:
        low = (text or "").lower()
        if not any(map(self.weights.__getitem__, WORD.findall(low))):
            return 0.0
        return sum(self.clause(WORD.findall(c)) for c in CLAUSE.split(low))

    def matches(self, text: str | None) -> list[tuple[str, float]]:
        """The clauses that weigh something."""
        return [(c.strip(), w) for c in CLAUSE.split((text or "").lower()) if (w := self.clause(WORD.findall(c))) > 0]

    def score(self, weight: float) -> float:
        return 1 / (1 + exp(min(700.0, max(-700.0, -(self.slope * weight + self.base)))))


def learn_words(labelled: DataFrame) -> dict[str, float]:
    """labelled (text, toxic) to the weights of the words and beginnings that toxic texts have far
    more often."""
    low = F.regexp_replace(F.lower("text"), r"[^\p{L}']+", " ")
    words = F.split(F.trim(low), " ")
    pairs = F.arrays_zip(words.alias("word"), F.concat(F.array(F.lit("")), words).alias("before"))
    placed = labelled.select("toxic", F.xxhash64("text").alias("own"), F.explode(pairs).alias("p")).select("toxic", "own", "p.word", "p.before").filter("word <> ''")
    witnessed = placed.groupBy("toxic", "word", "before").agg(F.min("own").alias("own")).select("toxic", "word", "own").distinct()
    forms = F.array(F.col("word"), *(F.when(F.length("word") >= n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in STEMS))
    counted = witnessed.select("toxic", "own", "word", F.explode(F.array_compact(forms)).alias("form"))
    counts = (
        counted.groupBy("form", "toxic", "own")
        .agg(F.min("word").alias("w1"), F.max("word").alias("w2"))
        .groupBy("form")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"), F.size(F.array_distinct(F.array(F.min("w1"), F.max("w2"), F.max("w1"), F.min("w2")))).alias("many"))
        .filter((F.col("t") >= WITNESSES) & (~F.endswith("form", F.lit("*")) | (F.col("many") >= WORDS_OF_STEM)))
    )
    toxic, clean = (n or 0 for n in labelled.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    odds = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1))
    found = counts.withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
    return {r["form"]: min(HARM, log(r["odds"])) for r in found.collect()}


def _curve(weights: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and base of the logistic curve, by Newton steps with a light penalty."""
    x, b = np.stack([weights, np.ones(len(weights))], 1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (p - toxic) + np.array([0.1, 0.0]) * b
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.1, 1e-6])
        b = b - np.linalg.solve(hess, grad)
    return max(float(b[0]), 0.0), float(b[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Grammar:
    """Learns from docs whose id is in labels (id, toxic)."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = F.broadcast(per_class(known, "toxic", F.xxhash64(F.lit("tox"), "__id"), 2 * sample)[0])  # about 2 * sample ids
    labelled = docs.select(id_col, F.col(text_col).alias("text")).join(chosen, docs[id_col] == chosen["__id"]).select("text", "toxic")
    labelled = cut(labelled)
    grammar_now = Grammar(learn_words(labelled))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([grammar_now.weight(t.as_py()) for t in batch.column(0)], pa.float64()), batch.column(1)], ["weight", "toxic"])

    rows = np.array(sorted(tuple(r) for r in labelled.mapInArrow(run, "weight double, toxic int").collect())).reshape(-1, 2)
    if len(np.unique(rows[:, 1])) < 2:
        share = float(rows[:, 1].mean()) if len(rows) else 0.0
        return Grammar({}, 0.0, 50.0 if share else -50.0)
    return Grammar(grammar_now.learned, *_curve(rows[:, 0], rows[:, 1]))


def score(docs: DataFrame, model: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, weight, score: a row for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            weights = [model.weight(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weights, pa.float64()), pa.array(map(model.score, weights), pa.float64())], [id_col, "weight", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, weight double, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))
    held_out: Column = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
