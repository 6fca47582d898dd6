"""Quality classifier: naive Bayes support vectors.

n-gram indicators are scaled by the log ratio of the classes' smoothed counts, then a linear hinge-loss model is
fitted by dual coordinate descent. The n-grams do not depend on a language's words: 4-grams of character classes
(65,536 of them) and 3-grams of "this word equals the word d before it", for d from 1 to 4. A logistic map fitted
on a fifth of the sample turns margins into scores.

The model is fitted on at most SAMPLE labelled rows (a parameter); scoring reads every whole text.

Cases: a null or empty text has no n-grams and gets the score of margin `bias`; rows with null doc_id are scored
and count as not held out; repeated rows score alike; without labelled rows of both kinds every score is 0 or 1
as the labels are (0 without any); an empty table gives no rows. Other columns are not read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labelled

SAMPLE = 4000
THRESHOLD = 0.7
_LAGS = 4
DIMENSIONS = 16**4 + _LAGS * 8


class Model(NamedTuple):
    weights: np.ndarray  # of indicators, the log-count ratio included
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float


def _classes() -> np.ndarray:
    """The class of each UTF-8 byte: kinds of letters, digits, spaces and of the commoner signs."""
    out = np.full(256, 15, np.uint32)
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\f\v", "\n", ".", ",", "!?", "|", "#", "$%", "&", "*", "-_'\"():;"]
    for k, chars in enumerate(groups):
        out[[ord(c) for c in chars]] = k
    out[128:] = 14
    return out


_CLASS = _classes()


def features(text: str) -> np.ndarray:
    """Sorted ids of the n-grams in the text."""
    raw = text.encode("utf-8", "replace")
    flags = np.zeros(DIMENSIONS, bool)
    if len(raw) >= 4:
        c = _CLASS[np.frombuffer(raw, np.uint8)]
        flags[(c[:-3] << 12) | (c[1:-2] << 8) | (c[2:-1] << 4) | c[3:]] = True
    parts = raw.split()
    words = np.fromiter(map(hash, parts), np.int64, len(parts))
    for lag in range(1, _LAGS + 1):
        if len(words) >= lag + 3:
            same = (words[lag:] == words[:-lag]).astype(np.int64)
            flags[16**4 + (lag - 1) * 8 + (same[:-2] * 4 + same[1:-1] * 2 + same[2:])] = True
    return np.flatnonzero(flags).astype(np.int32)


def ratios(ids: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    count = lambda k: alpha + sum((np.bincount(i, minlength=DIMENSIONS) for i, t in zip(ids, y, strict=True) if t == k), np.zeros(DIMENSIONS))
    p, q = count(1), count(0)
    return np.log(p / p.sum()) - np.log(q / q.sum())


def values(ids: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    v = ratio[ids]
    return v / (np.sqrt(v @ v) or 1.0)


def descend(ids: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, passes: int = 30, seed: int = 1) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; the bias is a constant feature."""
    w, bias, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(y))
    x, sign = [values(i, ratio) for i in ids], np.where(y == 1, 1.0, -1.0)
    norm, draw = np.array([v @ v + 1 for v in x]), np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for k in draw.permutation(len(y)):
            gradient = sign[k] * (w[ids[k]] @ x[k] + bias) - 1
            new = min(max(alpha[k] - gradient / norm[k], 0.0), cost)
            step = (new - alpha[k]) * sign[k]
            if step:
                w[ids[k]] += step * x[k]
                bias += step
                alpha[k], most = new, max(most, abs(step))
        if most < 1e-3:
            break
    return w, bias


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic map, by Newton steps on smoothed targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z, theta = np.stack([margins, np.ones(len(y))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(z @ theta)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(h, z.T @ (p - goal) + 1e-3 * theta), -2, 2)
    return float(max(theta[0], 1e-3)), float(theta[1])


def train(rows: DataFrame) -> Model:
    """rows: y, text; as labelled.sample returns them. Ids of n-grams come back, never texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "ids": [features(t).tobytes() for t in b["text"]]})

    found = sorted((bytes(r["ids"]), r["y"]) for r in rows.select("y", "text").mapInPandas(run, "y int, ids binary").collect())
    y, ids = np.array([t for _, t in found]), [np.frombuffer(i, np.int32) for i, _ in found]
    flat = np.zeros(DIMENSIONS)
    if len(set(y.tolist())) < 2:
        return Model(flat, flat, 0.0, 1.0, 40.0 if len(y) and y[0] else -40.0)
    aside = np.random.default_rng(0).permutation(len(y)) % 5 == 0
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        aside = np.zeros(len(y), bool)
    fit = np.flatnonzero(~aside)
    ratio = ratios([ids[i] for i in fit], y[fit])
    w, bias = descend([ids[i] for i in fit], y[fit], ratio)
    check = np.flatnonzero(aside) if aside.any() else fit
    margins = np.array([w[ids[i]] @ values(ids[i], ratio) + bias for i in check])
    return Model(w, ratio, bias, *calibrate(margins, y[check]))


def score_text(model: Model, text: str) -> float:
    ids = features(text)
    margin = model.weights[ids] @ values(ids, model.ratios) + model.bias
    return float(1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -500, 500))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": [score_text(model, t) for t in b["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", common.text_of().alias("text")).mapInPandas(run, f"doc_id {kind}, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(labelled.sample(docs, common.table(spark, sf_dir, "labels"), "quality", labelled.held_out(4, 2), SAMPLE))
    return score(docs, model).select("doc_id", labelled.held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
