"""Exact dedup, SimHash and shared passages against brute force, with odd rows."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from radiopos.llm import components, exact_dedup, passages, simhash

SCHEMA = "doc_id long, text string, n long, _goes string, _digest string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def rows(seed=1):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(1, 90)) for _ in range(25)]
    texts = base + base[:8] + base[:3] + [base[0]] * 20 + ["", "", None, " ", "one", "x " * 3000]
    edited = []
    for t in base[5:12]:
        w = t.split()
        w[len(w) // 2] = "changed"
        edited.append(" ".join(w))
    texts += edited
    rng.shuffle(texts)
    out = [(i, t, i % 3, "x", None) for i, t in enumerate(texts)]
    return out + [out[0], (None, "no id", 0, None, "y")]


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_groups(spark, digest_bytes):
    data = rows()
    got = exact_dedup.decide(spark.createDataFrame(data, SCHEMA), digest_bytes).collect()
    assert len(got) == len(data)
    groups = {}
    for i, t, *_ in data:
        groups.setdefault(t or "", []).append(i)
    for r in got:
        members = groups[r.text or ""]
        best = max((m for m in members if m is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(members), r.doc_id == best)
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_exact_keep_leaves_one_row_with_all_columns(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = exact_dedup.keep(df)
    assert got.columns == df.columns
    texts = [r.text or "" for r in got.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, *_ in rows()})


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.decide(none).count() == exact_dedup.keep(none).count() == 0
    assert simhash.near_duplicates(none).count() == simhash.keep(none).count() == 0
    assert passages.shared_passages(none).count() == passages.without_repeats(none).count() == 0


def test_fuse_filter_holds_its_members():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 50, 1024, 5000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        made = exact_dedup.build_filter(keys)
        assert exact_dedup.maybe_in(keys, *made).all()
        others = rng.integers(2**63, 2**64 - 1, 20_000, dtype=np.uint64)
        assert exact_dedup.maybe_in(others, *made).mean() < 0.02


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    runs = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, monkeypatch):
    data = [r[:2] for r in rows(5)]
    expected = [brute_fingerprint(t) for _, t in data]
    root = list(range(len(data)))
    for _ in data:
        for i in range(len(data)):
            for j in range(len(data)):
                if bin(expected[i] ^ expected[j]).count("1") <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[root[i]] = min(least.get(root[i], d), d)
    monkeypatch.setattr(simhash, "CHUNK", 4)  # buckets of more than four are cut
    got = {(r.doc_id, r.fp & (2**64 - 1)): r.component_id for r in simhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {(d, expected[i]): least.get(root[i]) for i, (d, _) in enumerate(data)}


@pytest.mark.parametrize(("bytes_", "radius"), [(8, 3), (8, 0), (32, 50)])
def test_bit_slices_find_all_pairs(bytes_, radius):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 256, (40, bytes_), dtype=np.uint8)
    near = np.repeat(base, 5, axis=0)
    for row in near[1:]:
        for bit in rng.integers(0, bytes_ * 8, rng.integers(0, radius + 2)):
            row[bit // 8] ^= 1 << (bit % 8)
    bits = np.unpackbits(near, axis=1).astype(int)
    distance = (bits[:, None, :] != bits[None, :, :]).sum(axis=2)
    i, j = simhash.near_pairs(near, radius)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(a, b) for a in range(len(near)) for b in range(a + 1, len(near)) if distance[a, b] <= radius]


def test_similar_texts_leave_one(spark):
    rng = random.Random(9)
    data = [(i, words(rng, 200), 0, None, None) for i in range(30)]
    w = data[3][1].split()
    w[100] = "other"
    data += [(100, " ".join(w), 0, None, None), (101, "", 0, None, None), (102, None, 0, None, None), (None, "z", 0, None, None)]
    got = simhash.keep(spark.createDataFrame(data, SCHEMA))
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == [*range(30), 101]
    assert got.columns == [f.split()[0] for f in SCHEMA.split(", ")]


@pytest.mark.parametrize("chunk", [3, 7, 1024])
def test_large_buckets_lose_no_link(spark, monkeypatch, chunk):
    """Groups of near copies that drift apart, so that not all of a group are alike, against all pairs."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(21)
    data = []
    for g in range(4):
        w = words(rng, 60).split()
        for k in range(25 if g else 60):
            w = w[:]
            w[rng.randrange(60)] = words(rng, 1)
            data.append((1000 * g + k, " ".join(w)))
    sets = {i: set(simhash.shingles(t).tolist()) for i, t in data}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = {r.node: r.root for r in simhash.similar(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert {i: got.get(i, i) for i in sets} == {i: top(i) for i in sets}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300), (300, 100), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100, 300: 100}


def test_chains_are_the_best_ones():
    rng = random.Random(2)
    for _ in range(50):
        n = rng.randint(1, 14)
        points = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(n)})
        pos, ref = [p for p, _ in points], [r for _, r in points]
        best = [passages.WEIGHT] * len(points)
        for i in range(len(points)):
            for j in range(i):
                if pos[j] < pos[i] and ref[j] < ref[i]:
                    best[i] = max(best[i], passages.WEIGHT + best[j] - passages.GAP * (pos[i] - pos[j] + ref[i] - ref[j]))
        s, e, rs, re, k, _ = passages.chains(pos, ref)[0]
        score = k * passages.WEIGHT - passages.GAP * (e - s - passages.KMER + re - rs - passages.KMER)
        assert score == pytest.approx(max(best))


def test_shared_passages_are_found(spark):
    rng = random.Random(4)
    shared = words(rng, 70).split()
    fuzzy = shared[:]
    fuzzy[30:31] = ["in", "serted"]
    docs = [(i, words(rng, 150)) for i in range(12)]
    for i, p in ((2, shared), (5, shared), (9, fuzzy)):
        w = docs[i][1].split()
        docs[i] = (i, " ".join(w[:60] + p + w[60:]))
    docs += [(50, ""), (51, None), (52, "la " * 60), (53, "so la " + "la " * 80), (None, docs[2][1]), docs[3]]
    found = passages.shared_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in found} == {(5, 2), (9, 2), (53, 52)}
    exact = next(r for r in found if r.doc_id == 5)
    assert (exact.start, exact.end, exact.other_start, exact.other_end, exact.words) == (60, 130, 60, 130, 70)
    cut = {r.doc_id: r.text for r in passages.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert " ".join(shared) in cut[2] and " ".join(shared) not in cut[5] and len(cut) == len({d for d, _ in docs})


@pytest.mark.parametrize("inserted", [0, 1])
def test_all_passages_of_a_chain_are_found(spark, inserted):
    rng = random.Random(11)
    one, two = words(rng, 60).split(), words(rng, 70).split()
    docs = [(i, " ".join(words(rng, 40).split() + one + words(rng, 80 + i * inserted).split() + two + words(rng, 40).split())) for i in (1, 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.start, r.end, r.other_id, r.other_start, r.other_end) for r in passages.shared_passages(df).collect()}
    assert found == {(2, 40, 100, 1, 40, 100), (2, 180 + 2 * inserted, 250 + 2 * inserted, 1, 180 + inserted, 250 + inserted)}
    cut = {r.doc_id: r.text for r in passages.without_repeats(df).collect()}
    assert " ".join(one) not in cut[2] and " ".join(two) not in cut[2]


@pytest.mark.parametrize("period", [1, 2, 7, 16])
def test_periodic_passages_have_their_whole_extent(spark, period):
    rng = random.Random(12)
    unit = words(rng, period).split()
    run = (unit * 600)[:600]
    docs = [(1, " ".join(words(rng, 90).split() + run)), (2, " ".join(words(rng, 30).split() + run + words(rng, 120).split()))]
    docs += [(3, " ".join(run + words(rng, 10).split()))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.start, r.end, r.other_id, r.other_start, r.other_end) for r in passages.shared_passages(df).collect()}
    assert {(2, 30, 630, 1, 90, 690), (3, 0, 600, 1, 90, 690)} <= found
    left = {r.doc_id: len(r.text.split()) for r in passages.without_repeats(df).collect()}
    assert left == {1: 690, 2: 150, 3: 10}


def test_every_run_shared_with_a_lower_document_is_in_a_passage(spark):
    rng = random.Random(13)
    lines = [words(rng, 20).split() for _ in range(12)]
    texts = [words(rng, 30).split() + line + words(rng, 30).split() for line in lines]  # each line alone, in lower documents
    texts += [words(rng, 25).split() + sum(lines[a:b], []) + words(rng, 25).split() for a, b in ((0, 3), (0, 3), (2, 7), (1, 6), (5, 12), (6, 12))]
    texts += [(["ab", "c"] * 20) + words(rng, 30).split(), words(rng, 9).split() + ["ab", "c"] * 200, ["c", "ab"] * 300 + lines[3]]
    texts += [lines[8] + words(rng, 40).split() + lines[9] + words(rng, 40).split() + lines[8] + lines[9] + lines[10], lines[8] + lines[9] + lines[10]]
    least = passages.MIN_WORDS
    seen, expected = {}, []
    for doc, t in enumerate(texts):
        for i in range(len(t) - least + 1):
            run = tuple(t[i : i + least])
            if seen.setdefault(run, doc) < doc:
                expected.append((doc, i))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    covered = {}
    for r in passages.shared_passages(docs).collect():
        assert r.other_id < r.doc_id and r.words >= least
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    assert (13, 25) in expected and (20, 0) in expected
    assert [(d, i) for d, i in expected if not set(range(i, i + least)) <= covered.get(d, set())] == []


def test_passage_hidden_by_two_lower_documents(spark):
    """Documents 3 and 4 share 53 words; document 1 has the first 49 of them, document 2 the last 49."""
    rng = random.Random(15)
    run = words(rng, 53).split()
    parts = {1: run[:49], 2: run[-49:], 3: run, 4: run}
    docs = [(i, " ".join(words(rng, 30).split() + p + words(rng, 30).split()), "x", 0) for i, p in parts.items()]
    found = passages.shared_passages(spark.createDataFrame(docs, "doc_id long, text string, words string, start int")).collect()
    assert {(r.doc_id, r.other_id, r.start, r.end) for r in found} == {(4, 3, 30, 83)}


@pytest.mark.parametrize("seed", range(3))
def test_all_runs_of_random_documents_are_in_passages(spark, seed):
    """Against every pair of documents, on texts pasted from a few snippets, some of them changed by a word."""
    rng = random.Random(100 + seed)
    snippets = [words(rng, rng.randint(10, 70)).split() for _ in range(8)]
    texts = []
    for _ in range(30):
        t = []
        for _ in range(rng.randint(1, 8)):
            piece = list(rng.choice(snippets))
            if rng.random() < 0.3:
                piece[rng.randrange(len(piece))] = "changed"
            if rng.random() < 0.2:
                piece.insert(rng.randrange(len(piece)), "put")
            t += piece + words(rng, rng.randint(0, 3)).split()
        texts.append(t)
    least, seen, expected = passages.MIN_WORDS, {}, []
    for doc, t in enumerate(texts):
        for i in range(len(t) - least + 1):
            if seen.setdefault(tuple(t[i : i + least]), doc) < doc:
                expected.append((doc, i))
    covered = {}
    for r in passages.shared_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect():
        assert sum(x == y for x, y in zip(texts[r.doc_id][r.start : r.end], texts[r.other_id][r.other_start : r.other_end], strict=False)) > 0
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    assert len(expected) > 100
    assert [(d, i) for d, i in expected if not set(range(i, i + least)) <= covered.get(d, set())] == []


def test_matching_blocks():
    from time import process_time

    rng = np.random.default_rng(6)
    for _ in range(50):
        a = rng.integers(0, 500, 300).astype(np.uint32)
        b = np.concatenate([a[:100], rng.integers(0, 500, rng.integers(0, 9)).astype(np.uint32), a[100 + rng.integers(0, 9) :]])
        blocks = passages.matching(a, b)
        assert sum(n for *_, n in blocks) >= 280
        at = (0, 0)
        for x, y, n in blocks:
            assert x >= at[0] and y >= at[1] and (a[x : x + n] == b[y : y + n]).all()
            at = x + n, y + n
    again = np.tile(rng.integers(0, 40, 40), 2500).astype(np.uint32)
    began = process_time()
    passages.matching(again, np.concatenate([again[7:], again]))
    assert process_time() - began < 5


def test_a_document_with_very_many_ends(spark, monkeypatch):
    monkeypatch.setattr(passages, "ENDS", 2)
    rng = random.Random(17)
    long = words(rng, 900).split()
    docs = [(0, " ".join(long))] + [(i, " ".join(words(rng, 20).split() + long[20 * i : 20 * i + 60] + words(rng, 20).split())) for i in range(1, 40)] + [(0, " ".join(long))]
    found = {(r.doc_id, r.start, r.end, r.other_id) for r in passages.shared_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {(i, 20, 80, 0) for i in range(1, 40)} <= found


def test_similar_texts_are_decided_by_their_shingles(spark):
    rng = random.Random(14)
    data = []
    for k in range(30):  # a Jaccard similarity of 0.8 on 4 and 5 shingles, and of 91 in 117 or 0.78
        short, long = words(rng, 8), words(rng, 108).split()
        data += [(10 * k, short), (10 * k + 1, short + " more"), (10 * k + 2, " ".join(long)), (10 * k + 3, " ".join(long[:-13] + words(rng, 13).split()))]
    sets = {i: {tuple(t.split()[a : a + 5]) for a in range(len(t.split()) - 4)} for i, t in data}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    expected = {i for i, _ in data if not (i % 2 and near(i - 1, i))}
    got = simhash.keep(spark.createDataFrame(data, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == expected
    assert len(expected) == 90
