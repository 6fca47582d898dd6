"""Personal data, classifiers, pieces and web pages, with odd rows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiopos.llm import labelled, pieces, pii, quality, toxicity

ODD = [None, "", " ", "x" * 20_000, "12 34-" * 5000, "a@" * 5000, "1." * 5000, "+1" * 5000, "é\U0001f600 +12 345 678 901 ü a@b.cc"]


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
)
PLAIN = [
    "mail a.b@c.org, x_y%z+1@d-e.co.uk_f@g.hi and a@b no",
    "1.2.3.4.5.6.7.8 999.1.1.1 0007.0.0.255 10.0.0.256",
    "4111 1111 1111 1111, 4111111111111112 5500-0000-0000-0004",
    "+1 (428) 555-5743 +12 +1234567890123456 +49.30.1234567)",
]


def test_base_spans_follow_the_rules(spark):
    texts = ODD + PLAIN
    found = pii.base_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in found:
        for kind, pattern, ok in RULES:
            want = [(m.start(), m.end()) for m in re.finditer(pattern, texts[r.doc_id] or "") if ok(m.group())]
            assert [(x.s, x.e) for x in r[f"base_{kind}"]] == want, (kind, texts[r.doc_id])


@pytest.fixture(scope="module")
def prose_docs(spark):
    """300 documents of plain words and a few base spans."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdeghilmnorstu"), rng.integers(2, 9)))
    text = lambda: " ".join(word() + rng.choice(["", "", "", ".", ","]) for _ in range(80))
    rows = [(i, text() + rng.choice(["", f" {i}.9.8.7 ", " a.b@c.org ", " at 12.30 "]) + text()) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def pii_model(spark, prose_docs):
    return pii.train(pii.training_rows(prose_docs))


INJECTED = [
    ("email", "jo.smith5 [at] mail3.example [dot] com"), ("email", "jo_smith at corp dot net"), ("email", "anna-k (at) web7.org"),
    ("ip", "10[.]0[.]77[.]3"), ("ip", "192 . 168 . 4 . 25"), ("ip", "8(dot)8(dot)44(dot)120"),
    ("card", "4111.1111.1111.1111"), ("card", "5500/0000/0000/0004"), ("card", "4111  1111  1111  1111"),
    ("phone", "(428) 555-5743"), ("phone", "0049 301 555 5743"), ("phone", "212-555-0187"),
]
ALIKE = ["look at this, we met at noon", "look at 20.05 the day", "4111.1111.1111.1112", "999[.]10[.]3[.]4", "2021-07-18 08:45:12", "12 345 678 910", "no 0123456789", "1999, 2004, 1234", "read it at home.then go"]


def test_trees_find_injected_data_in_every_text(spark, pii_model):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("aeioukptszx"), rng.integers(2, 9)))
    docs, want = [], {}
    for i in range(240):
        kind, string = INJECTED[i % len(INJECTED)] if i < 180 else ("", ALIKE[i % len(ALIKE)])
        left = " ".join(word() for _ in range(rng.integers(1, 20))) + " "
        docs.append((i, left + string + " " + " ".join(word() for _ in range(rng.integers(1, 20)))))
        want[i] = {(kind, len(left), len(left) + len(string))} if kind else set()
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, spans string")
    rows = pii.detect(df, pii_model).collect()
    got = {r.doc_id: {(x.kind, x.s, x.e) for x in r.spans} for r in rows}
    assert not any(r[f"base_{k}"] for r in rows for k in pii.KINDS)  # all of it lies beyond the base rules
    right = sum(len(got[i] & want[i]) for i in got)
    precision, recall = right / sum(map(len, got.values())), right / sum(map(len, want.values()))
    assert precision >= 0.85 and recall >= 0.8, (precision, recall, [(d, got[d[0]]) for d in docs if got[d[0]] != want[d[0]]])


def test_model_is_calibrated(prose_docs, pii_model):
    from pyspark.sql import functions as F

    total, least = pii_model
    assert set(least) == set(pii.KINDS)
    rows = pii.training_rows(prose_docs).withColumn("z", F.expr(total.replace("c.", "")))
    for kind, z in least.items():
        n, good = rows.filter(f"kind_no = {pii.KINDS.index(kind)} AND z >= {z!r}D").selectExpr("count(1)", "sum(y)").first()
        assert n > 20 and good / n >= pii.PRECISION


def plain_candidates(text):
    """The candidates of a text with their features, in plain Python."""
    count = lambda p, s: len(re.findall(p, s))
    luhn_ok = lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))
    for kind, pattern in pii.GENERATORS:
        if not re.search(pii._SPELT if kind == "email" else pii._NUMBERS, text):
            continue
        for hit in re.finditer(pattern, text):
            m, s, e = hit.group(), *hit.span()
            left, right = text[max(0, s - 24) : s], text[e : e + 3]
            plain = re.sub(pii._DOT, ".", re.sub(pii._AT, "@", m)) if kind == "email" else re.sub("[^0-9]+", ".", m)
            sizes = [*map(len, re.findall("[0-9]+", m))]
            valid = {"email": lambda: bool(re.search(r"^[^@]+@[^@]+\.[A-Za-z]{2,6}$", plain)), "ip": lambda: len(plain.split(".")) == 4 and all(int(x) <= 255 for x in plain.split(".")), "card": lambda: luhn_ok(m), "phone": lambda: 9 <= len(digits(m)) <= 15}[kind]()
            yield kind, s, e, {
                "kind_no": pii.KINDS.index(kind), "digits": count("[0-9]", m), "letters": count("[A-Za-z]", m), "signs": count("[^0-9A-Za-z]", m), "groups": len(sizes), "longest": max(sizes, default=0), "shortest": min(sizes, default=0), "length": len(m),
                "plus": m[0] == "+", "zeros": m[:2] == "00", "spelt_at": bool(re.search("(?i)[^A-Za-z0-9]at[^A-Za-z0-9]", m)), "sign_at": m.count("@"), "dots": m.count("."), "spaces": m.count(" "), "brackets": count(r"[\[\](){}<>]", m),
                "tail": len(re.search("[A-Za-z]*$", plain if kind in ("email", "ip") else m).group()), "valid": valid, "left_word": bool(re.search("[A-Za-z_]$", left)), "right_word": bool(re.search("^[A-Za-z_@]", right)), "left_number": bool(re.search("[0-9][^A-Za-z0-9]{0,2}$", left)), "right_number": bool(re.search("^[^A-Za-z0-9]{0,2}[0-9]", right)),
                "left_sign": bool(re.search(r"[^A-Za-z0-9\s(\[\"'<:]$", left)), "hint": bool(re.search(pii._HINT, left)), "capital": bool(re.search(r"^\s*[A-Z]", right)),
            }


def test_all_columns_follow_a_plain_version(spark, tmp_path, pii_model, monkeypatch):
    import duckdb

    total, least = pii_model
    texts = [t for t in ODD if t is None or len(t) < 100] + PLAIN + [f"hi {x} and {y} or {a} 12 ok" for (_, x), (_, y), a in zip(INJECTED, INJECTED[5:] + INJECTED[:5], ALIKE + ALIKE, strict=False)] + ["+1 (826) 555-4081 190.137.223.5 to", "7536784127813050 4845168114407329", "4111111111111111 4111111111111111 4111111111111111"]
    spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, "a@b.cc")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(pii, "train", lambda rows: pii_model)
    score = lambda f: duckdb.sql(f"SELECT {re.sub(r'(-?[0-9.]+(?:[eE]-?[0-9]+)?)D', r'CAST(\1 AS DOUBLE)', total)} FROM (VALUES ({', '.join(str(int(f[n])) for n in pii.FEATURES)})) c({', '.join(pii.FEATURES)})").fetchall()[0][0]
    want = set()
    for i, t in [*enumerate(texts), (None, "a@b.cc")]:
        text = t or ""
        base = [(k, m.start(), m.end()) for k, p, ok in RULES for m in re.finditer(p, text) if ok(m.group())]
        ranked = sorted((least[k] - score(f), pii.KINDS.index(k), s, e) for k, s, e, f in plain_candidates(text) if k in least and not any(x[1] < e and s < x[2] for x in base))
        spans = list(base)
        for short, k, s, e in ranked:
            if short <= 0 and not any(x[1] < e and s < x[2] for x in spans):
                spans.append((pii.KINDS[k], s, e))
        show = lambda x: ",".join(":".join(map(str, y)) for y in sorted(x, key=lambda y: (pii.KINDS.index(y[0]), y[1])))
        want.add((i, *(sum(x[0] == k for x in base) for k in pii.KINDS), hashlib.sha256(show(base).encode()).hexdigest(), show(spans)))
    got = [tuple(r) for r in pii.op5_pii(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(texts) + 2
    assert any(r[5] != hashlib.sha256(r[6].encode()).hexdigest() for r in got)


def test_redaction(spark, pii_model, monkeypatch):
    monkeypatch.setattr(pii, "train", lambda rows: pii_model)
    df = spark.createDataFrame([(1, "ask jo.smith5 [at] mail3.example [dot] com or a@b.cc now", "k"), (2, "nothing", "k"), (3, None, None)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert (got[1].text, got[1].spans, got[2].text, got[3].text) == ("ask [email] or [email] now", "k", "nothing", "")


def test_pii_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.detect(none).count() == 0


def test_toxicity_learns_words_and_not_identities(spark):
    docs, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        group = "women" if bad or i % 40 == 1 else "men" if i % 3 else "people"
        docs.append((i, f"The {group} went {'to the awful moron' if bad else 'home'} on day {i}", "s"))
        labels.append((i, int(bad), "extra"))
    docs += [(None, "x", "s"), (9000, None, "s"), (9001, "", "s"), (9002, "word " * 5000, "s"), docs[0]]
    labels += [(9001, None, "n"), (None, 1, "n"), (3, 1, "tie"), (3, 0, "tie")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    y = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    model = toxicity.model_for(d, y, 500)
    plain = toxicity.train(labelled.sample(d, y, "toxic", labelled.held_out(3, 1), 500), strength=0.0)
    shift = lambda m: abs(m.weights.get("women", 0) - m.weights.get("men", 0))
    assert shift(model) < shift(plain) / 2
    scored = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    assert len(scored) == len(docs) - 1 and all(0 <= s <= 1 for s in scored.values())
    assert all((scored[i] >= 0.7) == (i % 5 == 0) for i in range(600))
    assert {r.doc_id for r in toxicity.clean(d, model).collect()} == {i for i in scored if i is None or i >= 600 or i % 5}
    none = d.limit(0)
    assert toxicity.score(none, toxicity.model_for(none, y)).count() == 0


def test_swaps_stay_within_sentences_and_kinds(spark):
    terms = {"a": ["red", "green", "blue"], "b": ["north"]}
    swaps = toxicity.Swaps(terms)
    assert list(swaps.sentences("The red one. No term here! North\nRed and blue")) == [({"the", "red", "one"}, {"the", "green", "one"}), ({"red", "and", "blue"}, {"green", "and", "red"})]
    table = spark.createDataFrame([("a", "Red"), ("a", "blue"), ("a", "green"), ("b", "north"), ("b", None), ("a", "red")], "kind string, term string")
    assert toxicity.terms_of(table) == {"a": ["blue", "green", "red"], "b": ["north"]}


def test_training_without_any_term(spark):
    rows = spark.createDataFrame([(i % 2, f"w{i} {'vile' if i % 2 else 'kind'} words") for i in range(60)], "y int, text string")
    model = toxicity.train(rows)
    assert toxicity.score_text(model, "vile words") > 0.5 > toxicity.score_text(model, "kind words")


def test_penalty_spares_neutral_mentions(spark):
    """A term stands mostly in toxic rows: without the penalty neutral sentences with it are flagged."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    terms = {"group": ["zorvian", "mellic", "tarn"]}
    rows = []
    for i in range(900):
        bad = i % 3 == 0
        term = "zorvian" if bad and i % 2 == 0 else "mellic" if i % 50 == 1 else "tarn" if i % 50 == 2 else ""
        text = " ".join(word() for _ in range(6))
        # half of the toxic rows have no other mark than words seen once
        rows.append((i, int(bad), f"{text}. The {term} came {'vile scum' if bad and i % 4 else ''}. {word()}."))
    train = lambda strength: toxicity.train(spark.createDataFrame(rows, "doc_id int, y int, text string"), strength=strength, terms=terms)
    plain, fair = train(0.0), train(10.0)
    neutral = [f"the zorvian {word()} went home" for _ in range(50)]
    flagged = lambda m: sum(toxicity.score_text(m, t) >= toxicity.THRESHOLD for t in neutral)
    moved = lambda m: abs(toxicity.score_text(m, "The zorvian came") - toxicity.score_text(m, "The mellic came"))
    assert flagged(plain) > 25 and flagged(fair) <= 5 and moved(fair) < moved(plain) / 3
    assert toxicity.score_text(fair, "came vile scum") >= toxicity.THRESHOLD


def test_held_out_rows_are_never_sampled(spark):
    from zlib import crc32

    d = spark.createDataFrame([(i, "t") for i in range(200)], "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = labelled.sample(d, y, "quality", labelled.held_out(4, 2), 50).collect()
    assert len(got) == 50 and all(crc32(str(r.doc_id).encode()) % 4 != 2 for r in got)


def test_quality_separates_junk(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    docs, labels = [], []
    for i in range(400):
        w = [word() for _ in range(30)]
        junk = i % 4 == 0
        text = " | ".join(w) if junk and i % 8 else " ".join(x for x in w for _ in range(3)) if junk else " ".join(w).capitalize() + "."
        docs.append((i, text))
        labels.append((i, int(not junk)))
    docs += [(None, "x"), (900, None), (901, ""), (902, "abc " * 5000)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(labelled.sample(d, y, "quality", labelled.held_out(4, 2), 300))
    scored = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    assert all(0 <= s <= 1 for s in scored.values()) and len(scored) == len(docs)
    right = sum((scored[i] >= 0.7) == (i % 4 != 0) for i in range(400))
    assert right >= 396
    assert quality.train(labelled.sample(d, y.limit(0), "quality", labelled.held_out(4, 2), 300)).bias == 0


def test_quality_of_odd_tables(spark, tmp_path):
    """Repeated rows, clashing columns, contradicting labels; then empty tables."""
    docs = [(i, "good words here " * (i % 5 + 1) if i % 2 else "bad | junk | " * (i % 5 + 1), 0.1, 7, "m") for i in range(80)]
    docs += [docs[5], docs[5], (None, "x", None, None, None), (500, None, 0.0, 1, "m"), (501, "long " * 100_000, 0.0, 1, "m")]
    names = "doc_id long, text string, score double, predicted int, held_out string"
    labels = [(i, i % 2, "t") for i in range(80)] + [(9, 0, "t"), (9, 1, "t"), (None, 1, "t"), (500, None, "t")]
    spark.createDataFrame(docs, names).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, text string").write.parquet(f"{tmp_path}/a/labels.parquet")
    got = quality.op10_quality(spark, f"{tmp_path}/a").collect()
    assert len(got) == len(docs) and len({r.score for r in got if r.doc_id == 5}) == 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 80)
    spark.createDataFrame([], names).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert quality.op10_quality(spark, f"{tmp_path}/b").count() == 0


def test_dual_descent_meets_its_optimum():
    rng = np.random.default_rng(5)
    ids = [np.sort(rng.choice(30, 6, replace=False)).astype(np.int32) for _ in range(60)]
    y = np.array([int(3 in i or 7 in i) for i in ids])
    ratio = quality.ratios(ids, y)
    w, bias = quality.descend(ids, y, ratio, passes=2000)
    x = [quality.values(i, ratio) for i in ids]
    sign = np.where(y == 1, 1, -1)
    value = lambda w, b: 0.5 * (w @ w + b * b) + sum(max(0, 1 - s * (w[i] @ v + b)) for i, v, s in zip(ids, x, sign, strict=True))
    best = value(w, bias)
    for _ in range(200):
        step = np.zeros_like(w)
        step[:30] = rng.normal(0, 0.05, 30)
        assert value(w + step, bias + rng.normal(0, 0.05)) >= best - 1e-3


def whole_viterbi(codec, text):
    s = " " + text
    best = [None] * (len(s) + 1)
    best[0] = (0.0, 0, 0)
    for p in range(len(s)):
        for q in range(p + 1, min(len(s), p + codec.longest) + 1):
            known = codec.vocabulary.get(s[p:q])
            score = known[1] if known else codec.unknown if q == p + 1 else None
            if score is not None and (best[q] is None or best[p][0] + score > best[q][0]):
                best[q] = (best[p][0] + score, p, known[0] if known else -1)
    out, q = [], len(s)
    while q:
        _, p, i = best[q]
        out.append([i] if i >= 0 else [codec.bytes_of[b] for b in s[p:q].encode()])
        q = p
    return [i for part in reversed(out) for i in part]


TEXTS = ["hello world", "  two  spaces \n\n end ", "▁literal▁", "a\0b", "日本語テキスト" * 60, "é̀ ﬁ Ａ \U0001f600", "a" * 700, "abcdefgh" * 100, " " * 300, "﻿", "x"]


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec.load()


def likelihoods(codec, across=()):
    """A model of likelihoods with the same pieces, and some that go on past a space."""
    import math

    vocabulary = {p: (i, -math.log(100 - s)) for p, (i, s) in codec.vocabulary.items()}
    ids = (i for i in range(codec.size) if codec.piece[i] is None and i not in codec.bytes_of)
    return pieces.Codec(vocabulary | {p: (i, -1.0) for p, i in zip(across, ids, strict=False)}, codec.bytes_of, codec.size)


def some_texts():
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyzäéñ   .,-'0123456789日") + ["  ", "the", "ing", " of ", "\n"]
    return ["".join(rng.choice(letters, n)) for n in (1, 2, 3, 50, 300, 3000)] + ["".join(rng.choice(list("ab"), 400)), "aa" * 300, "aba" * 100]


def test_ids_are_the_librarys(codec):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for t in [t for t in TEXTS if "▁" not in t] + some_texts():
        assert codec.encode(t).tolist() == model.encode(t)
        assert pieces.Search(codec).all(" " + t).tolist() == model.encode(t)


@pytest.mark.parametrize("across", [(), ("e o", "g the", "o w")])
def test_likelihoods_match_a_whole_search(codec, across):
    own = likelihoods(codec, across)
    assert not across or own.stretches[" the"] is None and own.stretches[" a"] is not None
    for t in TEXTS + some_texts()[:5] + [("hello world the of " * 9) + "to work on the one"]:
        want = whole_viterbi(own, t)
        assert own.encode(t).tolist() == want and own.decode(want) == t


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_streams_in_any_parts(codec, size, monkeypatch):
    monkeypatch.setattr(pieces, "PART", 40)
    for own in (codec, likelihoods(codec)):
        for t in TEXTS + some_texts():
            got = b"".join(own.stream(t[a : a + size] for a in range(0, len(t), size)))
            assert got == own.encode(t).tobytes() and own.decode(np.frombuffer(got, np.int32)) == t


@pytest.mark.parametrize("unit", ["abc" * 7 + "日本" + "é" * 5, "a", "the", "\U0001f600x"])
def test_the_window_is_bounded(codec, unit):
    for own in (codec, likelihoods(codec)):
        search, most, ids = pieces.Search(own), 0, 0
        for _ in range(300):
            ids += sum(len(x) // 4 for x in search.feed(unit * 10))
            most = max(most, len(search.text))
        ids += sum(len(x) // 4 for x in search.end())
        # in some periodic runs paths never meet: they wait for their end
        assert unit in ("a", "the") or most <= 2 * own.longest + pieces.LOOK + 10 and search.commits > 50
        assert ids == len(pieces.Search(own).all(unit * 3000))


def test_pieces_round_trip_in_tables(spark, codec):
    rows = [(i, t, [7], True) for i, t in [*enumerate(TEXTS), (50, None), (51, ""), (None, "no id"), (0, TEXTS[0])]]
    done = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, exact boolean"), codec, check=True)
    assert done.filter("NOT exact").count() == 0 and done.count() == len(rows)
    back = sorted(((r.doc_id, r.text) for r in pieces.decode(done.withColumn("text", F.lit("x")), codec).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t, *_ in rows), key=repr)
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), codec).count() == 0


def test_kept_words_and_pairs_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "_CACHE", 10)
    monkeypatch.setattr(pieces, "_PAIRS", 10)
    own = pieces.Codec.load()
    text = " ".join(f"word{i % 37}" for i in range(500)) + " " + "long" * 50
    assert own.decode(own.encode(text)) == text
    assert all(len(x) <= 10 and len(x.old) <= 10 for x in (own.stretches, own.pairs)) and not any(len(w) > 48 for w in own.stretches)


def test_ids_of_documents_come_from_the_window(codec, monkeypatch):
    """All paths meet at most once a stretch that is kept and once LOOK positions of others; whether anything is kept or not
    changes no id."""
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() if t]
    searches, ids = [pieces.Search(codec) for _ in texts], []
    for s, t in zip(searches, texts, strict=True):
        ids.append(s.all(" " + t).tolist())
    assert sum(s.commits for s in searches) > 50 * len(texts) and all(s.commits for s in searches)
    monkeypatch.setattr(pieces, "_CACHED", 0)
    plain = pieces.Codec.load()
    assert ids == [plain.encode(t).tolist() for t in texts] and not plain.stretches


@pytest.mark.parametrize("text", ["", "A", "a b", "é" * 10])
def test_quality_features_of_short_texts(text):
    assert quality.features(text).dtype == np.int32


def test_digest_of_no_spans(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "a@b.cc")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.op5_pii(spark, str(tmp_path)).collect()}
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1].spans == ""
    assert got[2].base_sha256 == hashlib.sha256(b"email:0:6").hexdigest() and got[2].n_email == 1
