"""Conversation repair against exhaustive search and SQL."""

import hashlib
import itertools
import random
import zlib

import duckdb
import pyarrow as pa
import pytest

from radiopos.llm import dialogues

SCHEMA = "conv_id long, turn long, role string, text string, seg string, conv string"


def messy(seed=3):
    rng = random.Random(seed)
    rows = []
    for conv in range(60):
        for turn in range(rng.choice([1, 2, 3, 5, 8])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ubot"])
            text = rng.choice(["yes.", "no", "a b?", "", " \t", None, "long text. and more", "é!\x0b", "."]) if rng.random() < 0.6 else f"t{rng.random()}."
            rows.append((conv, rng.choice([turn, turn, turn, None, turn * 3]), role, text, "s", None))
    rows += [(None, None, None, None, None, None), (None, 1, "user", "hi.", "", "x"), (77, 5, "user", "once.", "", ""), (77, 5, "user", "once.", "", "")]
    # one conversation of several segments and levels of folding, and one that repeats one row
    rows += [(500, i, rng.choice(["user", "assistant", "system"]), rng.choice(["same.", f"w{i}", f"w{i}."]), "", "") for i in range(700)]
    rows += [(501, 7, "user", "again.", "", "")] * 150
    return rows + [(502, 1, "assistant", "word " * 100_000 + ".", "", "")]


def by_sql(rows):
    con = duckdb.connect()
    names = ["conv_id", "turn", "role", "text"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    con.register("conversations", pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))}))
    result = con.execute(dialogues.ORACLE_SQL)
    columns = [d[0] for d in result.description]
    return sorted((dict(zip(columns, r, strict=True)) for r in result.fetchall()), key=str)


def test_messy_rows_against_sql(spark, monkeypatch):
    rows = messy()
    df = spark.createDataFrame(rows, SCHEMA)
    want = by_sql(rows)
    plain = sorted((r.asDict() for r in dialogues.repair(df).collect()), key=str)
    assert plain == sorted(({k: w[k] for k in plain[0]} for w in want), key=str)
    monkeypatch.setattr(dialogues, "SEGMENT", 5)
    monkeypatch.setattr(dialogues, "FAN", 3)
    assert sorted((r.asDict() for r in dialogues.repair(df.repartition(5)).collect()), key=str) == plain


def test_the_order_of_turns_and_a_plain_case(spark):
    found = {}
    for conv in range(400):
        keep = [t for t in range(4) if zlib.crc32(f"{conv}:{t}".encode()) % 20 > 4]
        if len(keep) == 4:
            found[conv] = [(conv, 3, "assistant", "d."), (conv, 0, "user", "a."), (conv, 2, "user", "c."), (conv, 1, "assistant", "b.")]
    df = spark.createDataFrame([r for rows in found.values() for r in rows], "conv_id long, turn long, role string, text string")
    got = dialogues.repair(df).collect()
    assert len(got) == len(found)
    digest = hashlib.sha256(b"user:a.\nassistant:b.\nuser:c.\nassistant:d.").hexdigest()
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == (0, 0, 0, 0, 0, 0, "KKKK", digest)


def test_all_rows_dropped_and_no_rows(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in dialogues.repair(df).collect()] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert dialogues.repair(df.limit(0)).collect() == []


def legal(roles):
    rest = roles[1:] if roles[:1] == "s" else roles
    return roles == "" or (rest != "" and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def cheapest(letters):
    """The least (cost, audit) of all edits with up to two inserts at every place."""
    found = []
    ways = []
    for x in letters:
        own = [("D", 4, "")]
        if x != "d":
            late = 3 * x.isupper()
            own += [("K", late, x.lower()), ("R", 3 + late, "u"), ("R", 3 + late, "a")]
        ways.append(own)
    for edits in itertools.product(*ways):
        for inserts in itertools.product(["", "u", "a", "ua", "au"], repeat=len(letters) + 1):
            cost = sum(e[1] for e in edits) + 3 * sum(map(len, inserts))
            if found and cost > found[0]:
                continue
            roles = "".join(i + e[2] for i, e in zip(inserts, edits, strict=False)) + inserts[-1]
            if legal(roles):
                audit = "".join("I" * len(i) + e[0] for i, e in zip(inserts, edits, strict=False)) + "I" * len(inserts[-1])
                found = min(found or (cost, audit), (cost, audit))
    return found


@pytest.mark.parametrize("size", [1, 2, 3])
def test_nodes_against_exhaustive_search(size):
    rng = random.Random(size)
    cases = ["".join(x) for x in itertools.product("dsuaxSUAX", repeat=size)]
    for letters in cases if size < 3 else rng.sample(cases, 60):
        top = dialogues.LAST
        for x in reversed(letters):
            top = dialogues.node(x, top)
        ends = [(c[0] + 3 * len(dialogues.TAILS[q]), c[1] + dialogues.TAILS[q]) for q in range(4) if (c := top[q])]
        assert min(ends) == cheapest(letters), letters


def test_each_suffix_is_solved_once(spark, monkeypatch):
    calls = []
    real = dialogues.node
    monkeypatch.setattr(dialogues, "node", lambda letter, rest: calls.append(letter) or real(letter, rest))
    import pandas as pd

    sigs = ["ua" * k for k in range(1, 20)] + ["s" + "ua" * k for k in range(1, 20)] + ["x" + "ua" * 19]
    frame = pd.DataFrame({"reversed": sorted(s[::-1] for s in sigs)})
    got = pd.concat(list(dialogues._solved(iter([frame.iloc[:9], frame.iloc[9:]]))))
    suffixes = {s[i:] for s in sigs for i in range(len(s))}
    assert len(calls) == len(suffixes) and set(got["sig"]) == set(sigs)
