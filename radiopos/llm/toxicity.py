"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of words and of their beginnings. For every sentence of a labelled document that names
a group of people, a counterfactual copy has the group's term swapped for another of the same kind; training adds
`strength` * (logit(sentence) - logit(copy))^2, so naming a group moves the score as little as the labels allow. The terms
are a parameter (a mapping, or a table through terms_of); IDENTITY is the default.

The vocabulary (the words that tell the labels apart best, and all identity terms seen) is counted by Spark over
the sample; the model is fitted on at most SAMPLE labelled rows (a parameter). Scoring reads every whole text.

Cases: a null or empty text gets the score of a text without known words; rows with null doc_id are scored and
count as not held out; repeated rows score alike; without labelled rows of both kinds every score is the share
of label 1 seen (0 without any); an empty table gives no rows. Other columns are not read for a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labelled

SAMPLE = 8000
VOCABULARY = 1024
THRESHOLD = 0.7
#: Identity terms by kind; a swap stays within the kind.
IDENTITY = {
    "gender": "woman man women men girl boy female male transgender nonbinary frau mann femme homme mujer hombre".split(),
    "faith": "muslim christian jewish jew hindu buddhist sikh catholic atheist muslims christians jews hindus musulman cristiano".split(),
    "origin": "african asian european american mexican arab indian chinese immigrant immigrants refugee refugees black white latino".split(),
    "orientation": "gay lesbian straight bisexual queer homosexual heterosexual".split(),
    "ability": "disabled blind deaf autistic elderly young old".split(),
}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
#: Different changes that enter the penalty, the most frequent ones.
PAIRS = 4096


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(words: set[str]) -> set[str]:
    """The words and their beginnings of 3 to 5 letters, so that inflected forms share evidence."""
    return words | {f"{w[:k]}~" for w in words for k in (3, 4, 5) if len(w) > k}


def terms_of(table: DataFrame) -> dict[str, list[str]]:
    """A table of kind and term (words, at most some thousands) as a mapping; terms are lower-cased."""
    rows = table.select("kind", F.lower("term").alias("term")).na.drop().distinct().orderBy("kind", "term").collect()
    return {kind: [r["term"] for r in rows if r["kind"] == kind] for kind in sorted({r["kind"] for r in rows})}


class Swaps:
    """Swaps each identity term for the next of its kind."""

    def __init__(self, terms: dict[str, list[str]]):
        self.next = {t: of[(i + 1) % len(of)] for of in terms.values() if len(of) > 1 for i, t in enumerate(of)}

    def swapped(self, words: set[str]) -> set[str] | None:
        """The words with the terms swapped; None if there is none."""
        found = words & self.next.keys()
        out = (words - found) | {self.next[t] for t in found}
        return None if out == words else out

    def sentences(self, text: str) -> Iterator[tuple[set[str], set[str]]]:
        """The words of each sentence that names a group, and those of its copy."""
        for sentence in _SENTENCE.findall(text):
            words = words_of(sentence)
            if other := self.swapped(words):
                yield words, other


def vocabulary(rows: DataFrame, size: int, swaps: Swaps) -> list[str]:
    """The words of the largest likelihood ratio between the labels, and the identity terms that occur."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [words_of(t) for t in b["text"]]
            both = [features(s | (swaps.swapped(s) or set())) for s in sets]
            yield pd.DataFrame({"y": np.repeat(b["y"].to_numpy(), [len(s) for s in both]), "word": [w for s in both for w in s]})

    n1, n0 = (x or 0 for x in rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first())
    counts = rows.mapInPandas(words, "y int, word string").groupBy("word").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
    part = lambda k, n: F.when(k > 0, k * F.log(k / n)).otherwise(0.0)
    a, b, s = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    total = float(n1 + n0)
    gain = part(a, s * (n1 / total)) + part(b, s * (n0 / total)) + part(n1 - a, (total - s) * (n1 / total)) + part(n0 - b, (total - s) * (n0 / total))
    best = counts.filter("a + b >= 3").orderBy(gain.desc(), "word").limit(size).select("word")
    named = counts.filter(F.col("word").isin([*swaps.next])).select("word")
    return sorted({r[0] for r in best.union(named).collect()})


def fit(x: np.ndarray, y: np.ndarray, pairs: np.ndarray, strength: float, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Minimises mean log loss (the rarer label weighs more, by the root of the labels' ratio) + ridge |w|^2 + strength * mean (pairs w)^2 by Adam on the full, bounded sample."""
    weight = np.where(y == 1, np.sqrt((y == 0).sum() / (y == 1).sum()), 1.0)
    w, bias = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        # single precision throughout the products: the sample is not copied at each step
        off = weight * (1 / (1 + np.exp(-(x @ w.astype(np.float32) + bias))) - y)
        g = off.astype(np.float32) @ x / len(y) + 2 * ridge * w
        if len(pairs):
            g = g + 2 * strength * ((pairs @ w.astype(np.float32)) @ pairs) / len(pairs)
        g = np.append(g, off.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def train(rows: DataFrame, vocabulary_size: int = VOCABULARY, strength: float = 10.0, ridge: float = 2e-6, steps: int = 400, terms: dict[str, list[str]] = IDENTITY) -> Model:
    """rows: y, text; as labelled.sample returns them."""
    swaps = Swaps(terms)
    rows = common.stage(rows.select("y", "text"), "toxicity-sample")
    n, n1 = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if n1 in (0, n):
        return Model({}, 40.0 if n and n1 else -40.0)
    # no more words than rows can tell apart
    vocab = vocabulary(rows, max(1, min(vocabulary_size, n // 4)), swaps)
    at = {w: i for i, w in enumerate(vocab)}

    def ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            of = lambda s: sorted(at[w] for w in s if w in at)
            yield pd.DataFrame({"y": b["y"], "ids": [of(features(words_of(t))) for t in b["text"]]})

    def changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What a swap takes from a sentence's features and what it adds."""
        of = lambda s: sorted(at[w] for w in s if w in at)
        for b in batches:
            pairs = [(features(s), features(o)) for t in b["text"] for s, o in swaps.sentences(t)]
            yield pd.DataFrame({"gone": [of(s - o) for s, o in pairs], "come": [of(o - s) for s, o in pairs]}, dtype=object)

    found = rows.mapInPandas(ids, "y int, ids array<int>").collect()
    found.sort(key=lambda r: (r["y"], r["ids"]))  # the same sums whatever the partitions
    x = np.zeros((len(found), len(vocab)), np.float32)
    for i, r in enumerate(found):
        x[i, r["ids"]] = 1
    # sentences of equal changes are one row with their number: as many rows as there are sets of terms in a sentence
    alike = rows.mapInPandas(changes, "gone array<int>, come array<int>").groupBy("gone", "come").count()
    alike = alike.orderBy(F.col("count").desc(), "gone", "come").limit(PAIRS).collect()
    pairs = np.zeros((len(alike), len(vocab)), np.float32)
    for i, r in enumerate(alike):
        pairs[i, r["gone"]], pairs[i, r["come"]] = 1, -1
        pairs[i] *= np.sqrt(r["count"] * len(alike) / sum(a["count"] for a in alike))
    w, bias = fit(x, np.array([r["y"] for r in found], np.float32), pairs, strength, ridge, steps)
    return Model({v: float(c) for v, c in zip(vocab, w, strict=True) if abs(c) > 1e-4}, bias)


def score_text(model: Model, text: str) -> float:
    z = model.bias + sum(model.weights[w] for w in sorted(features(words_of(text)) & model.weights.keys()))
    return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": [score_text(model, t) for t in b["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", common.text_of().alias("text")).mapInPandas(run, f"doc_id {kind}, score double")


def model_for(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, terms: dict[str, list[str]] = IDENTITY) -> Model:
    return train(labelled.sample(docs, labels, "toxic", labelled.held_out(3, 1), size), terms=terms)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that score below the threshold, with the columns of docs."""
    judge = F.pandas_udf("double")(_scorer(model))
    return docs.filter(judge(common.text_of()) < THRESHOLD)


def _scorer(model: Model):
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: score_text(model, t)).astype("float64")

    return of


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, model_for(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", labelled.held_out(3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
