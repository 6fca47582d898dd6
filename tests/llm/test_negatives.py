"""Hard negatives against all pairs."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from radiopos.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, anchor_id long"


def vectors(seed=2, n=700, width=12, clusters=9):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    x = centres[rng.integers(0, clusters, n)] + rng.normal(scale=0.2, size=(n, width))
    rows = [(i, [float(f) for f in x[i].astype(np.float32)], int(rng.integers(0, 4)) if i % 3 else 1, "s", None) for i in range(n)]
    odd = [(800, None, 1, None, 1), (850, [1.0, None], 1, None, 1), (900, [float("nan")] * width, 1, None, 1), (950, [float("inf")] * width, 2, "", 1)]
    odd += [(1000, [1.0] * width, None, "", 1), (None, [1.0] * width, 1, "", 1), (1050, [], 2, "", 1), (1100, [1.0, 2.0], 1, "", 1), (1101, [1.0, 2.0], 1, "", 1), (1102, [0.5, 1.5], 2, "", 1)]
    # ties, repeated rows, an anchor twice, a vector of zeros
    return rows + odd + [(2001, rows[50][1], 1, "", 1), (2002, rows[50][1], 1, "", 1), rows[51], rows[51], rows[100], (1150, [0.0] * width, 3, "", 1)]


def by_sql(rows):
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())}))
    return sorted(con.execute(negatives.ORACLE_SQL).fetchall())


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("negatives")
    spark.createDataFrame(vectors(), SCHEMA).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/none/embeddings.parquet")
    return str(folder)


def test_against_all_pairs(spark, table, monkeypatch):
    want = by_sql(vectors())
    assert len(want) > 100
    assert sorted(map(tuple, negatives.op11_negatives(spark, table).collect())) == want
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 4)
    monkeypatch.setattr(negatives, "VECTOR_BLOCK", 50)
    monkeypatch.setattr(negatives, "BLOCKS_A_SALT", 3)
    assert sorted(map(tuple, negatives.op11_negatives(spark, table).collect())) == want
    assert negatives.op11_negatives(spark, f"{table}/none").collect() == []


def test_the_tree_spans_and_is_minimal():
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (60, 5))
    levels = negatives.tree(x)
    rows = np.concatenate([r for r, _, _ in levels])
    assert sorted(rows) == list(range(60))
    seen = set(levels[0][0])
    for r, parents, lengths in levels[1:]:
        assert set(parents) <= seen
        assert np.allclose(lengths, np.sqrt(((x[r] - x[parents]) ** 2).sum(axis=1)))
        seen |= set(r)
    # Kruskal's total
    pairs = sorted((math.dist(x[i], x[j]), i, j) for i in range(60) for j in range(i))
    root, total = list(range(60)), 0.0
    for d, i, j in pairs:
        if root[i] != root[j]:
            total += d
            root = [root[j] if r == root[i] else r for r in root]
    assert sum(lengths.sum() for _, _, lengths in levels[1:]) == pytest.approx(total)


def test_bounds_spare_candidates_of_near_anchors():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 32))
    make = lambda n: np.floor(256 * (centres[rng.integers(0, 6, n)] + rng.normal(scale=0.01, size=(n, 32)))).astype(np.int64)
    anchors, labels = make(120), rng.integers(0, 3, 120)
    v = negatives.Vectors(np.arange(2000), rng.integers(0, 3, 2000), make(2000))
    best = (anchors.astype(float) ** 2).sum(axis=1, keepdims=True)
    share = negatives.share_scored(anchors, labels, v, 0.93 * best, 0.95 * best)
    assert share < 0.25
    a = negatives.Anchors(np.full(120, -1), labels, anchors, 0.93 * best, 0.95 * best)
    score, known = negatives.scored(a, v, False)
    plain = anchors @ v.x.T
    inside = (labels[:, None] != v.labels) & (plain >= 0.93 * best) & (plain <= 0.95 * best)
    assert (known | ~inside).all() and (score[known] == plain[known]).all()


def test_scores_beyond_doubles(spark):
    rows = [(0, [2.0**29, 1.0], 1), (1, [2.0**29, 2.0], 1), (2, [2.0**28, 3.0], 2), (3, [2.0**28 * 1.5, 3.0], 2), (4, [-1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    df = df.selectExpr("id", "cast(label as long) label", "transform(v, x -> cast(floor(x) as long)) v")
    got = sorted(map(tuple, negatives.mine(df, df.filter("id = 0")).select("rank", "negative_id").collect()))
    assert got == [(1, 3), (2, 2)]
