"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector of whole numbers is first turned by an orthogonal matrix that gathers its energy in the leading coordinates
(the principal axes of SEEDS sampled vectors; inner products do not change). At every level the leading coordinates are
segments of their own and the rest is cut into TAIL segments, of which each keeps its mean and its deviation. For a
segment of length l, q.x <= l (mean_q mean_x + dev_q dev_x), with equality of the means' part and Cauchy-Schwarz on the
rest; the same statistics bound the distance from below, as |q - x|^2 = |q|^2 + |x|^2 - 2 q.x. Levels go from coarse
(no leading coordinates) to fine (all of them), each adding its columns to the products of the one before. Only pairs
that may still reach a query's k-th best score go on, and survivors get their exact integer scores. A level that leaves
half of a task's pairs is not tested again by that task; once a level leaves less than GATHER of them, the finer ones
multiply only the pairs that are left. Ties at the k-th score are kept, so results are exact.

A query's floor, the score that a vector has to beat, starts as its k-th best among the sampled vectors, shared by
all blocks, and rises with the blocks that a task has seen.

Queries and vectors are packed into blocks of rows, in the least of 2, 4 or 8 bytes a component; blocks of vectors and
of queries meet by an equi-join on their width and a salt, so each vector is shuffled once. Best rows are merged per query.

Cases: null vectors and vectors with a null or non-finite component take no part, nor do rows with null vec_id, vectors of
no component, or with a component of 2^62 / 256 or more, as their scores are no longs; only vectors of one length meet;
repeated rows are candidates each, but rows of the query's own vec_id are not, and queries of one vec_id share one list; a
query with fewer than k candidates returns them all; scores beyond a long wrap around; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 5
SCALE = 256
#: Shares of the coordinates that stand alone, level by level; segments of the rest.
LEVELS, TAIL = (0.0, 0.25, 0.5, 0.75), 4
QUERY_BLOCK, VECTOR_BLOCK = 1024, 2048
#: The share of pairs below which a level's survivors are gathered.
GATHER = 1 / 3
#: Sampled vectors; the widest vector that is turned; vector blocks a salt at most.
SEEDS, TURNED, BLOCKS_A_SALT = 2048, 1024, 8
_BLOCK = "width int, n int, ids binary, data binary"


def quantised(column: str = "embedding", scale: int = SCALE) -> Column:
    """floor(scale * component) as array<long>; null if a component is null, not finite or too large for a long."""
    fits = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < 2.0**62))
    floors = F.transform(column, lambda x: F.floor(x.cast("double") * scale))
    return F.when(fits & (F.size(column) > 0), floors)


def _bytes(x: np.ndarray) -> bytes:
    """In the least whole numbers that hold x."""
    top = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64).tobytes()


def _read(data: bytes, n: int, width: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(data) // (n * width)]
    return np.frombuffer(data, kind).reshape(n, width).astype(np.int64)


def _packed(rows: int):
    """Blocks of up to `rows` vectors of one width, ids and components as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list[pd.DataFrame]] = {}
        for b in batches:
            for width, part in b.groupby(b["v"].map(len)):
                held = pd.concat([*waiting.pop(width, []), part], ignore_index=True)
                for at in range(0, len(held) - rows + 1, rows):
                    yield block(held.iloc[at : at + rows], width)
                if len(held) % rows:
                    waiting[width] = [held.iloc[len(held) - len(held) % rows :]]
        for width, parts in waiting.items():
            yield block(parts[0], width)

    def block(part: pd.DataFrame, width: int) -> pd.DataFrame:
        data = np.array(part["v"].tolist(), np.int64)
        return pd.DataFrame({"width": [width], "n": [len(part)], "ids": [part["id"].to_numpy(np.int64).tobytes()], "data": [_bytes(data)]})

    return run


def turn(x: np.ndarray) -> np.ndarray | None:
    """Columns: the principal axes of the rows of x, largest first; None for vectors too wide."""
    if x.shape[1] > TURNED:
        return None
    x = x.astype(float) / max(1.0, np.abs(x).max(initial=0))
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


def statistics(x: np.ndarray, lead: int, segments: int = TAIL) -> np.ndarray:
    """Rows of (sqrt(l) mean, sqrt(l) deviation) of each segment beyond `lead`: their inner product bounds that of the
    rows' parts there."""
    rest = x[:, lead:].astype(float)
    if not rest.shape[1]:
        return np.zeros((len(x), 0))
    cuts = np.unique(np.linspace(0, rest.shape[1], segments + 1).astype(int))
    lengths = np.diff(cuts).astype(float)
    mean = np.add.reduceat(rest, cuts[:-1], axis=1) / lengths
    square = np.add.reduceat(rest * rest, cuts[:-1], axis=1) / lengths
    deviation = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.hstack([mean, deviation]) * np.sqrt(np.tile(lengths, 2))


def exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs, in pieces of bounded size."""
    step = max(1, 4_000_000 // q.shape[1])
    return np.concatenate([np.zeros(0, np.int64)] + [np.einsum("ij,ij->i", q[i[a : a + step]], x[j[a : a + step]]) for a in range(0, len(i), step)])


def best_of(i: np.ndarray, j: np.ndarray, score: np.ndarray, xid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each i, ties to the smaller id."""
    order = np.lexsort((xid[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k], score[rank < k]


class Levels:
    """Vectors turned, with their norms and statistics of every level, for use with many blocks."""

    def __init__(self, x: np.ndarray, axes: np.ndarray | None):
        self.x = x
        turned = (x if axes is None else x @ axes).astype(np.float64)
        self.leads = sorted({int(s * x.shape[1]) for s in LEVELS})
        self.norm = np.sqrt((turned * turned).sum(axis=1))
        self.tails = [statistics(turned, lead).astype(np.float32) for lead in self.leads]
        self.turned = turned.astype(np.float32)


def search(qid: np.ndarray, q: Levels, xid: np.ndarray, x: Levels, k: int, floor: np.ndarray, shares: dict[int, float], spent: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, vector position, score) of pairs that reach a query's floor, k a query at most, without its own
    id. floor is raised to each query's k-th best here; shares: the share of pairs that each level left the last time;
    spent["products"] counts multiplications."""
    spent = {} if spent is None else spent
    count = lambda n: spent.__setitem__("products", spent.get("products", 0) + int(n))
    if q.norm.max(initial=0) * x.norm.max(initial=0) >= 2.0**62:  # scores may be no longs: nothing is bounded
        i, j = np.nonzero(qid[:, None] != xid[None, :])
        return best_of(i, j, exact(q.x, x.x, i, j), xid, k)
    # single precision, with room for what it rounds
    room = (2e-7 * (q.x.shape[1] + 16) * q.norm[:, None]).astype(np.float32) * x.norm[None, :].astype(np.float32) + np.float32(1)
    need = np.maximum(floor, -3e38).astype(np.float32)[:, None] - room
    width, leads = q.x.shape[1], q.leads
    product, at, pairs = np.zeros(room.shape, np.float32), 0, None
    for level, lead in enumerate(leads):
        if pairs is None:
            if lead > at:
                product += q.turned[:, at:lead] @ x.turned[:, at:lead].T
                count(room.size * (lead - at))
                at = lead
            if shares.get(level, 0) > 0.5 or not np.isfinite(floor).any():
                continue
            alive = product + q.tails[level] @ x.tails[level].T >= need
            count(room.size * q.tails[level].shape[1])
            shares[level] = float(alive.mean())
            if shares[level] < GATHER:  # what is left goes on alone
                i, j = np.nonzero(alive)
                pairs = product[i, j]
        else:
            pairs += _paired(q.turned[:, at:lead], x.turned[:, at:lead], i, j)
            count(len(i) * (lead - at))
            at = lead
            left = pairs + _paired(q.tails[level], x.tails[level], i, j) >= need[i, j]
            count(len(i) * q.tails[level].shape[1])
            i, j, pairs = i[left], j[left], pairs[left]
    if pairs is not None:
        pairs += _paired(q.turned[:, at:], x.turned[:, at:], i, j)
        count(len(i) * (width - at))
        left = pairs >= need[i, j]
        i, j = i[left], j[left]
    else:
        product += q.turned[:, at:] @ x.turned[:, at:].T
        count(room.size * (width - at))
        alive = product >= need
        if alive.mean() > 0.02:
            # no floor yet: the k most promising give one
            top = min(k + 1, len(xid))
            likely = np.argpartition(-product, top - 1, axis=1)[:, :top]
            i, j = np.repeat(np.arange(len(qid)), top), likely.ravel()
            own = qid[i] == xid[j]
            i, _, score = best_of(i[~own], j[~own], exact(q.x, x.x, i[~own], j[~own]), xid, k)
            count(room.shape[0] * top * width)
            raised = _raised(floor, i, score, k)
            alive &= product >= np.maximum(raised, -3e38).astype(np.float32)[:, None] - room
        i, j = np.nonzero(alive)
    other = qid[i] != xid[j]
    i, j = i[other], j[other]
    score = exact(q.x, x.x, i, j)
    count(len(i) * width)
    keep = score >= floor[i]
    i, j, score = best_of(i[keep], j[keep], score[keep], xid, k)
    floor[:] = _raised(floor, i, score, k)
    return i, j, score


def _paired(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the pairs alone, in pieces of bounded size."""
    out, step = np.zeros(len(i), np.float32), max(1, 4_000_000 // max(1, q.shape[1]))
    for a in range(0, len(i), step):
        out[a : a + step] = np.einsum("ij,ij->i", q[i[a : a + step]], x[j[a : a + step]])
    return out


def _raised(floor: np.ndarray, i: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The floors with the least score of those queries that have k scores."""
    full = np.bincount(i, minlength=len(floor)) >= k
    least = np.full(len(floor), np.inf)
    np.minimum.at(least, i, score.astype(float))
    least[~full] = 0.0
    # a whole number beyond 2^53 may have been rounded up
    return np.where(full, np.maximum(floor, least - np.abs(least) * 2.0**-52), floor)


def _searched(k: int, axes: dict[int, np.ndarray | None]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shares: dict[int, dict[int, float]] = {}
        floors: dict[int, np.ndarray] = {}
        queries: dict[int, tuple[np.ndarray, Levels]] = {}
        last, xid, x = None, None, None
        for b in batches:
            for r in b.itertuples():
                if r.block not in queries:
                    if len(queries) >= 32:
                        queries.pop(next(iter(queries)))
                    queries[r.block] = np.frombuffer(r.q_ids, np.int64), Levels(_read(r.q_data, r.q_n, r.width), axes.get(r.width))
                if r.block not in floors:
                    if len(floors) >= 10_000:
                        floors.pop(next(iter(floors)))
                    floors[r.block] = np.frombuffer(r.floor, np.float64).copy()
                if last != r.number:
                    last, xid, x = r.number, np.frombuffer(r.ids, np.int64), Levels(_read(r.data, r.n, r.width), axes.get(r.width))
                qid, q = queries[r.block]
                i, j, score = search(qid, q, xid, x, k, floors[r.block], shares.setdefault(r.width, {}))
                yield pd.DataFrame({"query_id": qid[i], "vec_id": xid[j], "score": score})

    return run


def _floored(k: int, samples: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Adds each query's k-th best score among the samples of its width."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                floor = np.full(r.n, -np.inf)
                if r.width in samples:
                    xid, x = samples[r.width]
                    search(np.frombuffer(r.ids, np.int64), Levels(_read(r.data, r.n, r.width), None), xid, Levels(x, None), k, floor, {})
                out.append(floor.tobytes())
            yield b.assign(floor=out)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """vectors, queries: id long, v array<long>. Returns query_id, rank, vec_id, score."""
    seeds = vectors.orderBy(F.xxhash64("id", "v"), "id").limit(SEEDS).collect()  # bounded by the parameter
    samples = {}
    for width in {len(r["v"]) for r in seeds}:
        of = [r for r in seeds if len(r["v"]) == width]
        samples[width] = np.array([r["id"] for r in of], np.int64), np.array([r["v"] for r in of], np.int64)
    axes = {width: turn(x) for width, (_, x) in samples.items()}

    asked = queries.repartition(queries.count() // QUERY_BLOCK + 1).mapInPandas(_packed(QUERY_BLOCK), _BLOCK)
    asked = common.stage(asked.mapInPandas(_floored(k, samples), f"{_BLOCK}, floor binary").withColumn("block", F.monotonically_increasing_id()), "query-blocks")
    packed = common.stage(vectors.mapInPandas(_packed(VECTOR_BLOCK), _BLOCK).withColumn("number", F.monotonically_increasing_id()), "vector-blocks")
    salts = packed.count() // BLOCKS_A_SALT + 1
    dealt = packed.withColumn("salt", F.pmod(F.xxhash64("number"), F.lit(salts)))
    salted = asked.select("block", "width", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "floor")
    salted = salted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    pairs = dealt.join(salted, ["width", "salt"])
    found = common.stage(pairs.mapInPandas(_searched(k, axes), "query_id long, vec_id long, score long"), "block-bests")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), quantised().alias("v"))
    vectors = vectors.filter("id IS NOT NULL AND v IS NOT NULL")
    return top_k(vectors, vectors.filter("id % 50 = 0"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256e0 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
