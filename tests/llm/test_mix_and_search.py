"""Mixing, top-k search and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from radiopos.llm import mixing, topk

DOCS = "doc_id long, text string, source string, n_chars long, row string"


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares by weight; what is above a cap is shared again until nothing is."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return share | fixed
        fixed |= {s: cap * sizes[s] for s in over}


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "Z", "é", None, "tiny"]) if i > 3 else "tiny"
        k = rng.randint(1, 4) if source == "tiny" else rng.randint(0, 300)
        out.append((i, "  ".join(f"w{i}x{j}" for j in range(k)) + "\n", source, 0, "r"))
    return [*out, (n, None, "a", 0, None), (None, "no id here", "b", 0, None), out[9], out[9], (n + 1, "x", "empty", 0, "")]


def test_targets_and_taken(spark):
    df = spark.createDataFrame(corpus(), DOCS)
    got = mixing.per_document(mixing.plan(mixing.sizes(df), block_words=8, shard_slots=64)).collect()
    assert len(got) == len(corpus())
    sizes = Counter()
    for _, t, s, *_ in corpus():
        sizes[s] += len((t or "").encode().split())
    want, taken = targets(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.05, abs=24)
    again = mixing.per_document(mixing.plan(mixing.sizes(df.repartition(7)), block_words=8, shard_slots=64)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixed_texts_hold_what_is_taken(spark):
    df = spark.createDataFrame(corpus(), DOCS)
    options = {"block_words": 8, "shard_slots": 64}
    got = mixing.mix(df, **options).collect()
    assert mixing.mix(df, **options).columns == df.columns
    per = Counter()
    for r in mixing.per_document(mixing.plan(mixing.sizes(df), **options)).collect():
        per[r.doc_id] += r.taken
    words = Counter()
    for r in got:
        words[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert words == Counter({k: v for k, v in per.items() if v})
    texts = {d: t for d, t, *_ in corpus()}
    assert any(r.text == texts[r.doc_id] for r in got) and all(r.text.split()[0] in texts[r.doc_id] for r in got)


@pytest.mark.parametrize("data", [[], [(1, None, "a", 0, ""), (2, " ", None, 0, "")]])
def test_nothing_to_mix(spark, data):
    df = spark.createDataFrame(data, DOCS)
    got = mixing.per_document(mixing.plan(mixing.sizes(df))).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * len(data)
    assert mixing.mix(df).count() == 0


def test_permutation(spark):
    for n in (1, 2, 7, 64, 1000):
        rows = spark.range(n).selectExpr("id AS at", f"{n}L AS blocks", "3 AS sid", "1L AS pass")
        assert sorted(r[0] for r in rows.select(mixing.permuted("at", "blocks", "7, sid, pass")).collect()) == list(range(n))


def brute(vectors, queries, k):
    out = set()
    for q, a in queries:
        scores = sorted((-int(np.dot(a.astype(object), b.astype(object))), v) for v, b in vectors if v != q and len(a) == len(b))
        out |= {(q, i + 1, v, -s) for i, (s, v) in enumerate(scores[:k])}
    return out


def test_top_k_is_exact(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 64).astype(np.float32).tolist()) for i in range(230)]
    rows += [(i, rows[7][1]) for i in range(300, 330)]  # ties
    good = list(rows)
    short = [(1000, [1.0, -2.0]), (1001, [0.5, 0.25]), (1050, [3.0, 3.0])]
    good += short
    bad = [(400, None), (401, []), (402, [None] * 64), (403, [float("nan")] * 64), (404, [float("inf")] + [0.0] * 63), (None, rows[3][1])]
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 50)
    df = spark.createDataFrame([(i, v, "s") for i, v in good + bad], "vec_id long, embedding array<float>, score string")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {tuple(r) for r in topk.op1_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()}
    whole = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in good]
    assert got == brute(whole, [x for x in whole if x[0] % 50 == 0], 5)
    df.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert topk.op1_topk(spark, f"{tmp_path}/none").count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(8)
    q, x = (topk.Levels(rng.integers(-300, 300, (n, 64)), None) for n in (20, 50))
    axes = topk.turn(x.x)
    turned_q, turned_x = topk.Levels(q.x, axes), topk.Levels(x.x, axes)
    assert (np.abs(turned_q.turned @ turned_x.turned.T - q.x @ x.x.T) < 2).all()
    for a, b in ((q, x), (turned_q, turned_x)):
        tighter = np.inf
        for level, lead in enumerate(a.leads):
            bound = a.turned[:, :lead] @ b.turned[:, :lead].T + a.tails[level] @ b.tails[level].T
            assert (bound >= q.x @ x.x.T - 2).all()
            assert bound.mean() < tighter
            tighter = bound.mean()


@pytest.mark.parametrize(("width", "scale", "rank"), [(64, 100, 5), (64, 100, 64), (7, 3, 7), (1, 9, 1), (130, 2**33, 130), (64, 2**50, 64), (1100, 50, 20)])
def test_searches_are_exact_whatever_the_floor(width, scale, rank):
    rng = np.random.default_rng(width + rank)
    x = np.rint(rng.normal(0, 1, (400, rank)) @ rng.normal(0, 1, (rank, width)) * scale / rank**0.5).astype(np.int64)
    x[350:] = x[:50]  # ties
    ids = rng.permutation(400).astype(np.int64)
    axes = topk.turn(x[:100])
    q = topk.Levels(x[:30], axes)
    floor, shares, found = np.full(30, -np.inf), {}, []
    for at in range(0, 400, 80):
        i, j, score = topk.search(ids[:30], q, ids[at : at + 80], topk.Levels(x[at : at + 80], axes), 5, floor, shares)
        found += zip(ids[i].tolist(), (-score).tolist(), ids[at + j].tolist(), strict=True)
    got = set()
    for a in range(30):
        mine = sorted((s, v) for f, s, v in found if f == ids[a])[:5]
        got |= {(int(ids[a]), n + 1, v, -s) for n, (s, v) in enumerate(mine)}
    wrapped = lambda n: (n + 2**63) % 2**64 - 2**63
    want = set()
    for a in range(30):
        scores = sorted((-wrapped(int(np.dot(x[a].astype(object), y.astype(object)))), int(v)) for v, y in zip(ids, x, strict=True) if v != ids[a])
        want |= {(int(ids[a]), n + 1, v, -s) for n, (s, v) in enumerate(scores[:5])}
    assert got == want


def test_levels_prune_vectors_of_few_directions():
    """Vectors about ten directions: coarse levels leave few pairs."""
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 100, (10, 64))
    x = np.rint(centers[rng.integers(0, 10, 2000)] + rng.normal(0, 3, (2000, 64))).astype(np.int64)
    axes = topk.turn(x[:500])
    q, ids = topk.Levels(x[:40], axes), np.arange(2000)
    floor, shares = np.full(40, -np.inf), {}
    topk.search(ids[:40], q, ids[:1000], topk.Levels(x[:1000], axes), 5, floor, shares)
    topk.search(ids[:40], q, ids[1000:], topk.Levels(x[1000:], axes), 5, floor, shares)
    assert shares[min(shares)] < 0.3


def test_survivors_alone_are_multiplied():
    """Vectors about some directions, with floors from the first block: under half of the full product's multiplications, and
    the same pairs as without any bounds."""
    rng = np.random.default_rng(12)
    centers = rng.normal(0, 100, (40, 64))
    x = np.rint(centers[rng.integers(0, 40, 4000)] + rng.normal(0, 8, (4000, 64))).astype(np.int64)
    axes, ids = topk.turn(x[:500]), np.arange(4000)
    q = topk.Levels(x[:60], axes)
    floor, shares, spent, found = np.full(60, -np.inf), {}, {}, []
    for at in range(0, 4000, 500):
        spent = {} if at < 1000 else spent
        i, j, score = topk.search(ids[:60], q, ids[at : at + 500], topk.Levels(x[at : at + 500], axes), 5, floor, shares, spent)
        found += zip(i.tolist(), (-score).tolist(), (at + j).tolist(), strict=True)
    assert spent["products"] < 0.5 * 60 * 3000 * 64
    full = x[:60] @ x.T
    for a in range(60):
        want = sorted((-int(full[a, b]), b) for b in range(4000) if b != a)[:5]
        assert sorted((s, b) for i, s, b in found if i == a)[:5] == want


def test_repeated_vectors_and_small_salts(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 4)
    monkeypatch.setattr(topk, "BLOCKS_A_SALT", 1)
    monkeypatch.setattr(topk, "SEEDS", 3)
    rows = [(i, [i % 3, i % 5 - 2]) for i in range(40)] + [(50, [1, 1])] * 3 + [(100, [70000, -1]), (150, [2**40, 3])]
    v = spark.createDataFrame(rows, "id long, v array<long>")
    asked = v.filter("id % 50 = 0").distinct()
    got = {tuple(r) for r in topk.top_k(v, asked).collect()}
    whole = [(i, np.array(x)) for i, x in rows]
    want = set()
    for q, a in {(i, tuple(x)) for i, x in rows if i % 50 == 0}:
        scores = sorted((-int(np.dot(a, b)), i) for i, b in whole if i != q)
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])}
    assert got == want


def test_pipeline_keeps_clean_and_drops_the_rest(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = {i: " ".join(word() for _ in range(120)) for i in range(150)}
    for i in range(0, 150, 6):
        text[i] += " moron idiot"
    text[201] = text[1]
    near = text[2].split()
    near[60] = "edited"
    text[202] = " ".join(near)
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in text.items()] + [(300, None, None, None, None), (301, "", "en", "s0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 6 == 0)) for i in range(150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        assert name == "sentencepiece" or out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id for r in df.collect()}
    clean = {i for i in text if i >= 200 or i % 6} | {300, 301}
    assert seen["toxicity"] == clean
    assert seen["exact_dedup"] == clean - {1, 300}
    assert seen["simhash"] == clean - {1, 300, 202}
    assert seen["sentencepiece"] == seen["mixing"] <= seen["simhash"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == df.count()


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Ties, repeated rows, nulls in every column, very long texts and columns named like the operators' own."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    text = {i: " ".join(word() for _ in range(60)) + " moron idiot" * (i % 5 == 0) for i in range(60)}
    text[70] = text[71] = text[72] = "equal words of three rows " * 3
    text[80] = " ".join(word() for _ in range(60_000))
    rows = [(i, t, "en", f"s{i % 2}", len(t), 0.5, "d", i, True) for i, t in text.items()]
    rows += [rows[3], rows[3], (None, text[4], None, None, None, None, None, None, None), (90, None, None, None, None, None, None, None, None), (91, "", "en", "s0", 0, 0.1, "x", 1, False)]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, start long, kept boolean"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(40)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        assert name == "sentencepiece" or out.dtypes == df.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "simhash":
            kept = sorted(r.doc_id for r in df.collect() if r.doc_id is not None)
            assert set(kept) >= {72, 80, 91} and not {70, 71, 90} & set(kept) and len(kept) == len(set(kept)) and kept.count(3) == 1
        if name == "mixing":
            again = stage(spark, spark.read.parquet(f"{tmp_path}/simhash").repartition(5), str(tmp_path))
            assert Counter(map(tuple, df.collect())) == Counter(map(tuple, again.collect()))
            assert max(len(r.text) for r in df.collect()) > 100_000
    assert df.columns == ["doc_id", "ids"]


def test_mixing_rows_of_one_doc_id(spark):
    """Rows of equal doc_id, source and size keep their own texts; identical rows are documents each."""
    data = [(1, "a b c d", "s", 0, "r"), (1, "e f g h", "s", 0, "r"), (1, "e f g h", "s", 0, "q"), (None, "i j k l", None, 0, "r")] + [(i, "w " * 500, "t", 0, "r") for i in range(2, 5)]
    df = spark.createDataFrame(data, DOCS)
    out = Counter((r.doc_id, r.text, r.source) for r in mixing.mix(df, block_words=4).collect())
    again = Counter((r.doc_id, r.text, r.source) for r in mixing.mix(df.repartition(3), block_words=4).collect())
    assert out == again and {t for _, t, s in out if s == "s"} == {"a b c d", "e f g h"}
    assert out[1, "e f g h", "s"] == 2 * out[1, "a b c d", "s"]


def test_multinomial_counts_of_a_shard(spark):
    """Shards differ as draws do, and every source has its exact number of slots."""
    rows = spark.createDataFrame([(0, 6000), (1, 3000), (2, 1000)], "sid int, slots long")
    counts, n = mixing.shard_counts(rows, 100, 1)
    got = counts.collect()
    assert n == 10_000 and sum(r.c for r in got if r.shard >= 0) == n
    for sid, share in ((0, 0.6), (1, 0.3), (2, 0.1)):
        c = [r.c for r in got if r.sid == sid and r.shard >= 0] + [0] * (100 - sum(r.sid == sid and r.shard >= 0 for r in got))
        assert np.mean(c) == pytest.approx(100 * share, rel=0.1) and np.var(c) == pytest.approx(100 * share * (1 - share), rel=0.5)
        assert sum(r.c for r in got if r.sid == sid) >= rows.filter(f"sid = {sid}").first().slots
