"""Language-model scores against plain counting."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiopos.llm import labelled, ngrams

SCHEMA = "doc_id long, text string, held_out string, n_tokens string"


def corpus(seed=5, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["É", "éa", "naïve", "a.b", "THE", "the"]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rng.randint(0, 60))) + rng.choice(["", "\n", " \t", "\x0b\x0c\r"]), "x", None) for i in range(n)]
    rows += [(None, "no id the the", None, None), (n, None, None, ""), (n + 1, "", None, ""), (n + 2, " \n ", "", ""), rows[7], rows[7]]
    return [*rows, (n + 3, "x" * 3000 + " the " * 4000 + "y z", "", ""), (n + 4, ("long " + "q" * 700 + " ") * 50, "", "")]


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def plain(rows, order=2, mu=ngrams.MU):
    """(doc_id, held_out, tokens, known, base, score) with counts quantised but never confused."""
    grams, words = Counter(), Counter()
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, text, *_ in rows:
        if not out_of(i):
            t = words_of(text)
            words.update(t)
            for k in range(2, order + 1):
                grams.update(tuple([None, *t][j - k + 1 : j + 1]) for j in range(k - 1, len(t) + 1))
    total, types = sum(words.values()), len(words)
    quantised = lambda c: 0.0 if not c else float(ngrams.COUNTS[1 + math.floor(math.log(c) / math.log(1.5) + 1e-9)])
    found = []
    for i, text, *_ in rows:
        t, base, score = words_of(text), 0.0, 0.0
        for j, w in enumerate(t):
            p = (words[w] + 1) / (total + types + 1)
            base += math.log10(p)
            for k in range(2, order + 1):
                if j + 2 >= k:
                    g = tuple([None, *t][j - k + 2 : j + 2])
                    past = words[g[0]] if k == 2 else quantised(grams[g[:-1]])
                    p = (min(quantised(grams[g]), past) + mu * p) / (past + mu)
            score += math.log10(p)
        found.append((i, out_of(i), len(t), sum(words[w] > 0 for w in t), total, base, score))
    return found


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))


@pytest.mark.parametrize("order", [2, 3])
def test_against_plain_counting_both_ways(spark, monkeypatch, order):
    for name, value in (("BLOCK", 5000), ("SHARD", 4000), ("FLUSH", 2000), ("_WINDOW", 512)):
        monkeypatch.setattr(ngrams, name, value)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    blocks = ngrams.pack(df, labelled.held_out(7, 2), order)
    shards = ngrams.shards_for(blocks)
    assert shards > 5 and blocks.count() > 10
    model = ngrams.train(blocks, order)
    sent = ordered(ngrams.score(blocks, model, shards, order).collect())
    asked = ordered(ngrams.score(blocks, model, shards, order, broadcast=0).collect())
    want = ordered(plain(rows, order))
    assert len(sent) == len(rows)
    for a, b in zip(sent, asked, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-12)
    exact = 0
    for a, w in zip(sent, want, strict=True):
        assert a[:5] == w[:5] and a[5] == pytest.approx(w[5], rel=1e-9)
        exact += a[6] == pytest.approx(w[6], rel=1e-9)
    # false levels are rare
    assert exact > 0.95 * len(rows)
    assert sum(a[6] for a in sent) == pytest.approx(sum(w[6] for w in want), rel=0.002)


def test_filter_never_too_low_and_rarely_too_high():
    rng = np.random.default_rng(1)
    names = np.unique(rng.integers(0, 2**32, 40_000, np.uint64))
    counts = rng.zipf(1.7, len(names)).clip(1, 10**9)
    size, bits = ngrams.built(names, counts)
    f = ngrams.Filter([{"size": size, "bits": bits, "words": b"", "counts": b""}])
    levels = f.levels(np.zeros(len(names), np.int64), names)
    want = ngrams.level_of(counts)
    assert (levels >= want).all() and (levels > want).mean() < 0.01
    others = np.setdiff1d(rng.integers(0, 2**32, 40_000, np.uint64), names)
    assert (f.levels(np.zeros(len(others), np.int64), others) > 0).mean() < 0.01


def test_word_hashes_do_not_depend_on_windows(monkeypatch):
    text = ("é x " * 300 + "y" * 5000 + "\x0b" + "z " * 700 + "y" * 5000).encode()
    whole = [np.concatenate(x) for x in zip(*ngrams.words(text), strict=True)]
    monkeypatch.setattr(ngrams, "_WINDOW", 64)
    cut = [np.concatenate(x) for x in zip(*ngrams.words(text), strict=True)]
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    spans = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    assert whole[0].tolist() == spans and len(set(whole[1].tolist())) == len(set(text.split()))


def test_scores_know_the_language_and_empty_tables(spark):
    rows = [(i, r) for i, (_, r, *_) in enumerate(corpus(8, 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngrams.scores(df, labelled.held_out(7, 2)).collect()
    out = [r for r in got if r.held_out]
    assert out and len({r.train_tokens for r in got}) == 1
    # texts that follow the corpus' order of words are likelier than by their words alone
    follows = [(i, "a b c d e f g h " * 5) for i in range(200)]
    told = [r for r in ngrams.scores(spark.createDataFrame(follows, "doc_id long, text string"), labelled.held_out(7, 2)).collect() if r.held_out]
    assert told and all(r.score > 0.6 * r.base_score for r in told)
    assert ngrams.scores(df.limit(0), labelled.held_out(7, 2)).collect() == []
    alone = ngrams.scores(df.filter("crc32(cast(doc_id as string)) % 7 = 2"), labelled.held_out(7, 2), broadcast=0).collect()
    assert alone and all(r.n_known == 0 and r.base_score == 0 and r.train_tokens == 0 for r in alone)


def test_blocks_reach_python_few_at_once(spark, monkeypatch):
    for name, value in (("BLOCK", 2000), ("SHARD", 4000)):
        monkeypatch.setattr(ngrams, name, value)
    blocks = ngrams.pack(spark.createDataFrame(corpus(3, 300), SCHEMA).coalesce(1), labelled.held_out(7, 2))
    files = [r["count"] for r in blocks.groupBy(F.input_file_name()).count().collect()]
    assert len(files) > 5 and max(files) <= 2
    asked = ngrams.score(blocks, ngrams.train(blocks), ngrams.shards_for(blocks), broadcast=0)
    plan = asked._jdf.queryExecution().toString()
    # replies and blocks meet a block at a time; no task gathers replies in arrays beside Spark's own memory
    assert "collect_list" not in plan and plan.count("FlatMapCoGroupsInPandas") >= 2
