"""Document operators called alone on tables whose other columns bear the operators' own names, and on very long texts."""

import random
from collections import Counter

import pytest

from radiopos.llm import mixing, ngrams, passages, simhash

NAMES = ("a", "b", "h", "start", "end", "words", "other_id", "other_start", "identity", "node", "root", "salt", "bits", "fingerprint", "component_id", "size", "source_size", "target", "taken", "block", "slot", "row", "no", "_n", "text_sha256", "seed", "pos", "key", "value")


def texts():
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    shared = " ".join(word() for _ in range(80))
    rows = [(i, " ".join(word() for _ in range(rng.randint(3, 60))), rng.choice(["a", "b", None])) for i in range(40)]
    rows += [(100, f"{rows[0][1]} {shared}", "a"), (101, f"{shared} {rows[1][1]}", "b"), (102, rows[5][1], "b"), (None, None, None), (103, None, "a"), (104, "", "b"), rows[3]]
    # 120,000 words with the shared passage far inside
    long = [word() for _ in range(120_000)]
    long[90_000:90_000] = shared.split()
    return [*rows, (105, " ".join(long), "a")]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("clash")
    plain = spark.createDataFrame(texts(), "doc_id long, text string, source string")
    for name, more in (("plain", {}), ("clash", {n: n for n in NAMES})):
        df = plain
        for n in more:
            df = df.selectExpr("*", f"array('{n}', cast(doc_id as string)) as {n}" if n in NAMES[::2] else f"'{n}' as {n}")
        df.write.parquet(f"{folder}/{name}/documents.parquet")
    return f"{folder}/plain", f"{folder}/clash"


QUERIES = {
    "op2": (passages.op2_passages, ("doc_id", "start", "end", "other_id", "other_start", "other_end", "words")),
    "op3": (simhash.op3_simhash, ("doc_id", "fingerprint", "component_id")),
    "op7": (mixing.op7_mixing, ("doc_id", "size", "source_size", "target", "taken")),
    "op12": (ngrams.op12_ngrams, ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")),
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_other_columns_change_nothing(spark, folders, name):
    query, columns = QUERIES[name]
    plain, clash = (Counter(tuple(repr(r[c]) for c in columns) for r in query(spark, f).collect()) for f in folders)
    assert plain == clash and sum(plain.values())
    if name != "op2":
        assert sum(plain.values()) == len(texts())


def test_a_passage_deep_in_a_long_text_is_found(spark, folders):
    found = passages.op2_passages(spark, folders[0]).filter("words >= 75").collect()
    assert {(r.doc_id, r.other_id) for r in found} >= {(101, 100), (105, 100)}
    deep = next(r for r in found if r.doc_id == 105)
    assert deep.start <= 90_000 <= deep.end and deep.end - deep.start < 400
