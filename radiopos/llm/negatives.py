"""Hard-negative mining over a spanning tree of anchors.

The anchors of a block are joined by a minimum spanning tree of their distances. For a block of candidates the root's scores
are computed; then, from the root outwards, a child's score with candidate x lies within its parent's score, or its
bounds where that was not computed, plus or minus |child - parent| |x|, and within |child| |x|. Only candidates whose
bounds overlap a window of the child are scored, alone where they are few and as a row where they are many. A window of positives
is all from the fifth best score so far; one of negatives lies between half and 95 hundredths of a positive's score, and rises
from below to the third best score so far in it. So results are exact.

First every anchor's positives are searched, then, with the windows they give, its negatives. Anchors and candidates are
packed into blocks that meet on their width and a salt; each candidate is shuffled once a search, and a label that most
rows carry makes no group. Best rows are merged per anchor.

How much a tree spares depends on the vectors: anchors that point apart have edges as long as the vectors themselves, whose
bounds exclude nothing (`share_scored` tells).

Cases: null labels, null vectors and those with a null or non-finite component take no part, nor do rows with null vec_id, of no
component, or with a component of 2^62 / 256 or more, as their scores are no longs (windows of scores from 2^53 on have 53
bits); only vectors of one length meet; repeated
rows are candidates each, but rows of the anchor's own vec_id are not, and of several rows of an anchor's vec_id the least by
label and vector is the anchor; ties go to the smaller vec_id; a positive of negative score has no negatives; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, topk

POSITIVES, NEGATIVES = 5, 3
#: Hundredths of a positive's score between which a negative's lies.
LOW, HIGH = 50, 95
ANCHOR_BLOCK, VECTOR_BLOCK = 1024, 2048
#: Vector blocks a salt at most; share of a row's candidates from which the whole row is computed.
BLOCKS_A_SALT, DENSE = 8, 0.25
_BLOCK = "width int, n int, ids binary, labels binary, data binary, low binary, high binary"


def tree(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The minimum spanning tree of the rows of x from the one nearest their mean, by depth: (rows, parents, edge lengths)."""
    x = x.astype(np.float64)
    square = (x * x).sum(axis=1)
    away = lambda at: np.sqrt(np.maximum(square + square[at] - 2 * (x @ x[at]), 0))
    root = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    parent, depth, edge = np.full(len(x), root), np.zeros(len(x), int), away(root)
    left, length = np.ones(len(x), bool), np.zeros(len(x))
    left[root] = False
    for _ in range(len(x) - 1):
        at = int(np.argmin(np.where(left, edge, np.inf)))
        left[at], length[at], depth[at] = False, edge[at], depth[parent[at]] + 1
        there = away(at)
        nearer = left & (there < edge)
        parent[nearer], edge[nearer] = at, there[nearer]
    return [(rows, parent[rows], length[rows]) for rows in (np.flatnonzero(depth == d) for d in range(depth.max() + 1))]


class Anchors:
    """A block of anchors with its tree and windows (a row each: low rises)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.low, self.high = low.copy(), high
        self.float = x.astype(np.float64)
        self.norm = np.sqrt((self.float**2).sum(axis=1))
        self.levels = tree(x)


class Vectors:
    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.float = x.astype(np.float64)
        self.norm = np.sqrt((self.float**2).sum(axis=1))


def scored(a: Anchors, v: Vectors, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all pairs, and which of them were computed: all that may lie in a window."""
    m, n = len(a.ids), len(v.ids)
    fits = ((a.labels[:, None] == v.labels[None, :]) == same) & (a.ids[:, None] != v.ids[None, :])
    if a.norm.max() * v.norm.max() >= 2.0**53:  # floats are not exact: nothing is bounded
        i, j = np.nonzero(fits)
        score = np.zeros((m, n), np.int64)
        score[i, j] = topk.exact(a.x, v.x, i, j)
        return score, fits
    low, high, known = np.zeros((m, n)), np.zeros((m, n)), np.zeros((m, n), bool)
    for depth, (rows, parents, edges) in enumerate(a.levels):
        most = a.norm[rows, None] * v.norm * (1 + 1e-9)
        if depth:
            reach = edges[:, None] * v.norm * (1 + 1e-9) + 1e-6
            low[rows], high[rows] = np.maximum(low[parents] - reach, -most), np.minimum(high[parents] + reach, most)
        else:
            low[rows], high[rows] = -most, most
        near = np.zeros((len(rows), n), bool)
        for w in range(a.low.shape[1]):
            near |= (high[rows] >= a.low[rows, w, None]) & (low[rows] <= a.high[rows, w, None])
        near &= fits[rows]
        many = near.mean(axis=1) >= DENSE
        if depth == 0:  # the root's scores bound all others
            many[:] = True
        at = rows[many]
        low[at] = high[at] = a.float[at] @ v.float.T
        known[at] = near[many]
        i, j = np.nonzero(near & ~many[:, None])
        i = rows[i]
        low[i, j] = high[i, j] = topk.exact(a.x, v.x, i, j)
        known[i, j] = True
    return low.astype(np.int64), known


def searched(a: Anchors, v: Vectors, same: bool, k: int) -> pd.DataFrame:
    """anchor_id, no (of the window), vec_id, score: the k best in each window. The windows' lower ends rise."""
    score, known = scored(a, v, same)
    out = []
    for w in range(a.low.shape[1]):
        held = known & (score >= a.low[:, w, None]) & (score <= a.high[:, w, None])
        rows = np.flatnonzero(held.any(axis=1))
        if not len(rows):
            continue
        if len(v.ids) > k:  # only what reaches a row's k-th best is sorted
            shown = np.where(held[rows], score[rows], np.iinfo(np.int64).min)
            held[rows] &= score[rows] >= np.partition(shown, len(v.ids) - k, axis=1)[:, len(v.ids) - k, None]
        i, j = np.nonzero(held)
        i, j, best = topk.best_of(i, j, score[i, j], v.ids, k)
        out.append(pd.DataFrame({"anchor_id": a.ids[i], "no": w, "vec_id": v.ids[j], "score": best}))
        a.low[:, w] = topk._raised(a.low[:, w], i, best, k)
    return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "no": [], "vec_id": [], "score": []}, dtype=np.int64)


def _packed(rows: int, windows: int) -> Callable:
    """Blocks of up to `rows` vectors of one width."""

    def block(part: pd.DataFrame, width: int) -> pd.DataFrame:
        data = {"width": [width], "n": [len(part)], "ids": [part["id"].to_numpy(np.int64).tobytes()], "labels": [part["label"].to_numpy(np.int64).tobytes()]}
        ends = {c: [np.array(part[c].tolist(), np.float64).tobytes() if windows else b""] for c in ("low", "high")}
        return pd.DataFrame(data | {"data": [topk._bytes(np.array(part["v"].tolist(), np.int64))]} | ends)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, pd.DataFrame] = {}
        for b in batches:
            for width, part in b.groupby(b["v"].map(len)):
                held = pd.concat([waiting.pop(width), part], ignore_index=True) if width in waiting else part
                for at in range(0, len(held) - rows + 1, rows):
                    yield block(held.iloc[at : at + rows], width)
                if len(held) % rows:
                    waiting[width] = held.iloc[len(held) - len(held) % rows :]
        for width, part in waiting.items():
            yield block(part, width)

    return run


def _found(same: bool, k: int, windows: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, Anchors] = {}
        last, v = None, None
        for b in batches:
            for r in b.itertuples():
                if r.block not in kept:
                    if len(kept) >= 64:
                        kept.pop(next(iter(kept)))
                    ends = (np.frombuffer(x, np.float64).reshape(r.a_n, windows) for x in (r.low, r.high))
                    kept[r.block] = Anchors(np.frombuffer(r.a_ids, np.int64), np.frombuffer(r.a_labels, np.int64), topk._read(r.a_data, r.a_n, r.width), *ends)
                if last != r.number:
                    last, v = r.number, Vectors(np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64), topk._read(r.data, r.n, r.width))
                yield searched(kept[r.block], v, same, k)

    return run


def _search(anchors: DataFrame, packed: DataFrame, same: bool, k: int, windows: int) -> DataFrame:
    """anchors: id, label, v, low, high (arrays of `windows` numbers). anchor_id, no, rank, vec_id, score."""
    asked = anchors.repartition(anchors.count() // ANCHOR_BLOCK + 1).mapInPandas(_packed(ANCHOR_BLOCK, windows), _BLOCK)
    asked = common.stage(asked.withColumn("block", F.monotonically_increasing_id()), "anchor-blocks")
    salts = packed.count() // BLOCKS_A_SALT + 1
    dealt = packed.withColumn("salt", F.pmod(F.xxhash64("number"), F.lit(salts)))
    salted = asked.select("block", "width", *(F.col(c).alias(f"a_{c}") for c in ("n", "ids", "labels", "data")), "low", "high")
    salted = salted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    found = dealt.drop("low", "high").join(salted, ["width", "salt"]).mapInPandas(_found(same, k, windows), "anchor_id long, no int, vec_id long, score long")
    best = Window.partitionBy("anchor_id", "no").orderBy(F.col("score").desc(), "vec_id")
    return common.stage(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "best-rows")


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """vectors, anchors: id long, label long, v array<long>. anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score."""
    row = F.min(F.struct("label", "v")).alias("row")
    anchors = common.stage(anchors.groupBy("id").agg(row).select("id", "row.label", "row.v"), "anchors")
    packed = vectors.withColumns({"low": F.lit(None), "high": F.lit(None)}).mapInPandas(_packed(VECTOR_BLOCK, 0), _BLOCK)
    packed = common.stage(packed.withColumn("number", F.monotonically_increasing_id()), "vector-blocks")
    ends = {"low": F.array(F.lit(float("-inf"))), "high": F.array(F.lit(float("inf")))}
    likes = _search(anchors.withColumns(ends), packed, True, positives, 1)
    # whole scores in [low, high] hundredths of the positive's; a negative score has an empty window
    none = F.struct(F.lit(float("inf")).alias("low"), F.lit(float("-inf")).alias("high"))
    part = lambda s, hundredths: s.cast("decimal(20,0)") * hundredths / 100
    window = lambda s: F.when(s >= 0, F.struct(F.ceil(part(s, low)).cast("double").alias("low"), F.floor(part(s, high)).cast("double").alias("high"))).otherwise(none)
    found = likes.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("s"))
    windows = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.when(i < F.size("s"), window(F.get("s", i)["score"])).otherwise(none))
    found = found.select(F.col("anchor_id").alias("id"), windows.alias("w")).select("id", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    unlike = _search(anchors.join(found, "id"), packed, False, negatives, positives)
    pairs = likes.select("anchor_id", (F.col("rank") - 1).alias("no"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    unlike = unlike.select("anchor_id", "no", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(unlike, ["anchor_id", "no"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def share_scored(anchors: np.ndarray, labels: np.ndarray, v: Vectors, low: np.ndarray, high: np.ndarray) -> float:
    """The share of pairs of different labels that are scored for given windows."""
    a = Anchors(np.full(len(anchors), -1), labels, anchors, low, high)
    _, known = scored(a, v, False)
    return float(known.sum() / max(1, (labels[:, None] != v.labels[None, :]).sum()))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").filter("vec_id IS NOT NULL AND label IS NOT NULL")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), topk.quantised().alias("v")).filter("v IS NOT NULL")
    return mine(vectors, vectors.filter("id % 50 = 0"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256e0 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), a AS (
  SELECT vec_id, r.label AS label, r.v AS v FROM (SELECT vec_id, min({'label': label, 'v': v}) AS r FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id)
), s AS (
  SELECT a.vec_id AS anchor_id, x.vec_id AS vec_id, a.label = x.label AS alike, CAST(list_inner_product(a.v, x.v) AS BIGINT) AS score
  FROM a JOIN v x ON a.vec_id <> x.vec_id AND len(a.v) = len(x.v)
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS no FROM s WHERE alike) WHERE no <= 5
), n AS (
  SELECT p.anchor_id AS anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.no ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
