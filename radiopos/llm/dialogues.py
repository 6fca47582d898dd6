"""Conversation structure repair with a suffix-shared automaton of row signatures.

Every row of a conversation becomes one letter: its role's class (s, u, a, x for any other), upper case where the row is
truncated, and d where it has to go (blank or duplicate). The letters of up to SEGMENT rows are a signature. Distinct
signatures of all conversations, sorted from their ends, form an automaton whose nodes are shared suffixes: as equal
endings stand next to each other in that order, each node is solved once, on a stack, and not once a conversation. A node
knows, for each grammar state it may be entered in and each state the segment may end in, the least cost and the
ASCII-least string of edits. Only ranges of the sorted signatures are solved apart, so a range repeats the nodes of its first
signature at most.

Grammar states: START, SYSTEM (a system row is kept), USER (pairs are complete, a user row is due) and ASSISTANT (an
assistant row is due). Inserts stand before the row they precede, so that no string of edits of a segment is the beginning of
another; then costs add up and ties are broken segment by segment. A conversation of more segments is folded from the end,
FAN segments at a time, by costs and ranks of the edit strings alone: a conversation of any length takes a few levels
and is never gathered. Numbers of rows come by ranges of (conversation, turn); equal rows are counted before.

Order of rows of one turn: role, then the SHA-256 of the text. Only the hash of the repaired text takes a conversation's lines
one after the other through one task, as SHA-256 is sequential; it streams them and holds one batch.

Cases: null roles and texts count as one space, in crc keys null ids and turns too; null turns come first and don't count for
gaps; rows with null conv_id are a conversation; repeated rows are duplicates; texts of any length pass whole; an empty
table gives no rows; a gap beyond a long is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import numbering
from . import common

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: Costs of the edits; of leaving a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What is inserted at the end of a conversation in each state: a system row alone needs a pair.
TAILS = ("", "II", "", "I")
#: Rows of a signature, segments folded at a time, copies of a solved signature's row for the join.
SEGMENT, FAN, SALTS = 64, 64, 16
_KEY = ["absent", "conv"]
_NONE = -1
_SOLVED = "cost array<int>, rank array<int>, audit array<string>"


def damaged(rows: DataFrame) -> DataFrame:
    """absent, conv, turn, role, text, digest and n, the copies of a row, by the crc32 of `conv_id:turn`."""
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.col("kind")
    kept = rows.select(*_conversation(), F.col("turn").cast("long").alias("turn"), "role", "text", (F.crc32(named) % 20).alias("kind")).filter(kind != 0)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    kept = kept.select(
        *_KEY, "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )
    return kept.withColumn("digest", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))


def _conversation() -> list[Column]:
    return [F.col("conv_id").isNull().alias("absent"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("conv")]


def structure(rows: DataFrame) -> DataFrame:
    """One narrow row for each group of equal damaged rows: n, first (no earlier row has its role and text), blank, ended."""
    words = F.col("text").rlike(common.WORD)
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    flagged = rows.select(*_KEY, "turn", "role", "digest", "n", words.alias("words"), ended.alias("ended"))
    equal = flagged.groupBy(*_KEY, "turn", "role", "digest").agg(F.sum("n").alias("n"), F.max("words").alias("words"), F.max("ended").alias("ended"))
    first = equal.groupBy(*_KEY, "role", "digest").agg(F.min(F.struct("turn")).alias("least")).select(*(F.col(c).alias(f"f_{c}") for c in (*_KEY, "role", "digest")), F.col("least.turn").alias("f_turn"))
    # the turn is part of the key: a text that a conversation repeats at every turn meets its first row once
    on = [F.col(c) == F.col(f"f_{c}") for c in (*_KEY, "role", "digest")] + [F.col("turn").eqNullSafe(F.col("f_turn"))]
    return equal.join(first, on, "left").select(*_KEY, "turn", "role", "digest", "n", "words", "ended", F.col("f_conv").isNotNull().alias("first"))


def segments(rows: DataFrame) -> DataFrame:
    """One row for SEGMENT rows of a conversation: seg, sig, their keys, counts of faults, and illegal pairs whose second row is
    in it."""
    ordered = numbering.running(rows.withColumn("order", F.struct("turn", "role", "digest")), "at", "n", _KEY, "order")
    # two steps, as one sequence of all copies may be long
    step = 4096
    copies = ordered.withColumn("hundred", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step))))
    copies = copies.withColumn("copy", F.explode(F.sequence(F.col("hundred") * step, F.least(F.col("hundred") * step + step, F.col("n")) - 1)))
    fault = F.when(~F.col("words"), "blank").when(~F.col("first") | (F.col("copy") > 0), "duplicate").when(~F.col("ended"), "truncated")
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    each = copies.select(*_KEY, (F.col("at") + F.col("copy")).alias("pos"), fault.alias("fault"), role.alias("class"), "turn", "role", "digest")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper("class")).otherwise(F.col("class"))
    own = F.floor(F.col("pos") / SEGMENT)
    row = lambda seg, sig: F.struct(seg.alias("seg"), F.struct("pos", "class", sig.alias("letter"), "turn", "role", "digest").alias("row"), F.when(sig != "", F.col("fault")).alias("fault"))
    # the last row of a segment also stands before the next one, for the pair between them
    both = F.when((F.col("pos") + 1) % SEGMENT == 0, F.array(row(own, letter), row(own + 1, F.lit("")))).otherwise(F.array(row(own, letter)))
    each = each.select(*_KEY, F.explode(both).alias("e")).select(*_KEY, "e.*")
    met = each.groupBy(*_KEY, "seg").agg(F.array_sort(F.collect_list("row")).alias("rows"), *(F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")))
    joined = lambda f: F.array_join(F.transform("rows", lambda r: r[f]), "")
    met = met.withColumns({"sig": joined("letter"), "classes": joined("class")}).filter("sig != ''")
    pairs = F.when(F.size("rows") > 1, F.transform(F.sequence(F.lit(1), F.size("rows") - 1), lambda i: F.substring(F.col("classes"), i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    illegal = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")
    keys = F.transform(F.filter("rows", lambda r: r["letter"] != ""), lambda r: F.struct(r["turn"].alias("turn"), r["role"].alias("role"), r["digest"].alias("digest")))
    return met.select(*_KEY, "seg", "sig", keys.alias("keys"), "blank", "duplicate", "truncated", illegal.alias("illegal"))


def inserted(state: int) -> int:
    """The state after an inserted row: the one that is due."""
    return USER if state == ASSISTANT else ASSISTANT


def due(state: int) -> str:
    return "assistant" if state == ASSISTANT else "user"


def kept(letter: str, state: int) -> int | None:
    """The state after keeping a row, None where its role is not due."""
    role = letter.lower()
    if role == "s":
        return SYSTEM if state == START else None
    return inserted(state) if role == due(state)[0] else None


def edits(letter: str, state: int) -> list[tuple[int, str, int]]:
    """(cost, edits, next state) of the ways to handle one row: up to two inserts, then the row's own edit."""
    out = []
    for inserts in range(3):
        paid, done = inserts * INSERT, "I" * inserts
        out.append((paid + DELETE, done + "D", state))
        if letter != "d":
            paid += TRUNCATED * letter.isupper()
            if (after := kept(letter, state)) is not None:
                out.append((paid, done + "K", after))
            out.append((paid + REROLE, done + "R", inserted(state)))
        state = inserted(state)
    return out


#: A node: for each entry and exit state, None or (cost, edits).
Node = list[tuple[int, str] | None]
LAST: Node = [(0, "") if p == q else None for p in range(STATES) for q in range(STATES)]


def node(letter: str, rest: Node) -> Node:
    """The node of a letter before the node `rest`."""
    out: Node = [None] * (STATES * STATES)
    for p in range(STATES):
        for cost, done, after in edits(letter, p):
            for q in range(STATES):
                if (then := rest[after * STATES + q]) is not None:
                    found = cost + then[0], done + then[1]
                    if out[p * STATES + q] is None or found < out[p * STATES + q]:
                        out[p * STATES + q] = found
    return out


def ranks(keys: list) -> list[int]:
    """For each entry state the order of what leads to its exit states; -1 where nothing does."""
    out = [_NONE] * len(keys)
    for p in range(STATES):
        own = [p * STATES + q for q in range(STATES) if keys[p * STATES + q] is not None]
        for rank, at in enumerate(sorted(own, key=lambda a: keys[a])):
            out[at] = rank
    return out


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Signatures in the order of their reversed letters: the stack holds the nodes of the last one's suffixes."""
    last, stack = "", [LAST]
    for b in batches:
        out = []
        for letters in b["reversed"]:
            shared = 0
            while shared < min(len(last), len(letters)) and last[shared] == letters[shared]:
                shared += 1
            del stack[shared + 1 :]
            for letter in letters[shared:]:
                stack.append(node(letter, stack[-1]))
            last = letters
            top = stack[-1]
            out.append((letters[::-1], [x[0] if x else _NONE for x in top], ranks([x and x[1] for x in top]), [x[1] if x else None for x in top]))
        yield pd.DataFrame(out, columns=["sig", "cost", "rank", "audit"])


def automaton(signatures: DataFrame) -> DataFrame:
    """signatures: sig, distinct. sig and, for entry state p and exit state q at p * 4 + q: cost, rank, audit."""
    parts = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = signatures.select(F.reverse("sig").alias("reversed")).repartitionByRange(parts, "reversed").sortWithinPartitions("reversed")
    return ends.mapInPandas(_solved, f"sig string, {_SOLVED}")


def best(costs: list, ranks_: list, state: int, to_go: list[int | None]) -> tuple[int, int, int] | None:
    """(cost, rank, exit state) of the best way through a segment and what follows."""
    ways = [(costs[state * STATES + q] + to_go[q], ranks_[state * STATES + q], q) for q in range(STATES) if costs[state * STATES + q] != _NONE and to_go[q] is not None]
    return min(ways, default=None)


def path(children: list, entry: int, goal: list[int | None]) -> tuple[int, list[tuple[int, int, int]]] | None:
    """The cost and (rank, entry, exit) of each child on the best way from entry to states of which each has a cost."""
    ahead = [goal]
    for c in reversed(children):
        ways = [best(c["cost"], c["rank"], p, ahead[-1]) for p in range(STATES)]
        ahead.append([w and w[0] for w in ways])
    ahead.reverse()
    if ahead[0][entry] is None:
        return None
    state, out = entry, []
    for c, to_go in zip(children, ahead[1:], strict=True):
        _, rank, after = best(c["cost"], c["rank"], state, to_go)
        out.append((rank, state, after))
        state = after
    return ahead[0][entry], out


def _goal(q: int) -> list[int | None]:
    return [0 if s == q else None for s in range(STATES)]


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One cost and rank for each group of consecutive segments."""
    for b in batches:
        out = []
        for children in b["children"]:
            if len(children) == 1:
                out.append((list(children[0]["cost"]), list(children[0]["rank"])))
                continue
            ways = [path(children, p, _goal(q)) for p in range(STATES) for q in range(STATES)]
            out.append(([w[0] if w else _NONE for w in ways], ranks([w and [x[0] for x in w[1]] for w in ways])))
        yield b.assign(cost=[c for c, _ in out], rank=[r for _, r in out])


def _ended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Conversations' exit states, costs and inserts at the end."""
    ends = [INSERT * len(t) for t in TAILS]
    for b in batches:
        found = [best(c, r, START, ends) for c, r in zip(b["cost"], b["rank"], strict=True)]
        yield b.assign(entry=START, exit=[f[2] for f in found], total=[f[0] for f in found], tail=[TAILS[f[2]] for f in found])[["absent", "conv", "seg", "entry", "exit", "total", "tail"]]


def _dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entry and exit states of the segments of a group."""
    for b in batches:
        out = []
        for r in b.itertuples():
            _, ways = path(r.children, r.entry, _goal(r.exit))
            out += [(r.absent, r.conv, c["seg"], entry, after) for c, (_, entry, after) in zip(r.children, ways, strict=True)]
        yield pd.DataFrame(out, columns=["absent", "conv", "seg", "entry", "exit"])


def decided(solved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """solved: absent, conv, seg, cost, rank. Entry and exit state of each segment; total and tail of each conversation."""
    level, levels = solved.select(*_KEY, "seg", "cost", "rank"), []
    while (level.agg(F.max("seg")).first()[0] or 0) > 0:
        groups = level.groupBy(*_KEY, F.floor(F.col("seg") / FAN).alias("up")).agg(F.array_sort(F.collect_list(F.struct("seg", "cost", "rank"))).alias("children")).withColumnRenamed("up", "seg")
        child = "array<struct<seg: bigint, cost: array<int>, rank: array<int>>>"
        level = common.stage(groups.mapInPandas(_folded, f"absent boolean, conv long, seg long, children {child}, cost array<int>, rank array<int>"), "folded")
        levels.append(level)
    ends = common.stage(level.select(*_KEY, "seg", "cost", "rank").mapInPandas(_ended, "absent boolean, conv long, seg long, entry int, exit int, total long, tail string"), "ended")
    states = ends.select(*_KEY, "seg", "entry", "exit")
    for level in reversed(levels):
        states = level.select(*_KEY, "seg", "children").join(states, [*_KEY, "seg"]).mapInPandas(_dealt, "absent boolean, conv long, seg long, entry int, exit int")
    return states, ends.select(*_KEY, "total", "tail")


def lines(audit: str, entry: int, letters: str) -> list[tuple[int, int, str, bool]]:
    """(row, place before it, role, inserted) of the lines that a segment's edits leave; role "" is the row's own."""
    out, state, row, before = [], entry, 0, 0
    for edit in audit:
        if edit == "I":
            out.append((row, before, due(state), True))
            state, before = inserted(state), before + 1
            continue
        if edit == "R":
            out.append((row, before, due(state), False))
            state = inserted(state)
        elif edit == "K":
            out.append((row, before, "", False))
            state = kept(letters[row], state)
        row, before = row + 1, 0
    return out


def _lined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for r in b.itertuples():
            size = len(r.sig)
            for row, before, role, new in lines(r.audit, r.entry, r.sig):
                key = None if new else r.keys[row]
                own = (None, None, None) if new else (key["turn"], key["role"], key["digest"])
                out.append((r.absent, r.conv, *own, r.seg * SEGMENT + row, before, role or own[1]))
            state = r.exit
            for n in range(len(r.tail)):
                out.append((r.absent, r.conv, None, None, None, r.seg * SEGMENT + size, n, due(state)))
                state = inserted(state)
        frame = pd.DataFrame(out, columns=["absent", "conv", "turn", "role", "digest", "pos", "before", "new_role"])
        yield frame.astype({"turn": "Int64"})


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each conversation's lines, which come in order."""
    now, state = None, None
    for b in batches:
        done = []
        for absent, conv, line in zip(b["absent"], b["conv"], b["line"], strict=True):
            if now == (absent, conv):
                state.update(b"\n")
            else:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = (absent, conv), hashlib.sha256()
            state.update(line.encode())
        yield pd.DataFrame(done, columns=["absent", "conv", "repaired_sha256"])
    if now is not None:
        yield pd.DataFrame([(*now, state.hexdigest())], columns=["absent", "conv", "repaired_sha256"])


def repaired_lines(segs: DataFrame, rows: DataFrame) -> DataFrame:
    """segs: absent, conv, seg, sig, keys, audit, entry, exit, tail ('' but for the last); rows as `damaged` gives them.
    absent, conv, pos, before (its place among the inserts before the row) and line, `role:text`."""
    out = segs.mapInPandas(_lined, "absent boolean, conv long, turn long, role string, digest binary, pos long, before int, new_role string")
    key = [*_KEY, "turn", "role", "digest"]
    place = F.struct("pos", "before", "new_role").alias("place")
    made = out.filter("digest IS NULL").select(*_KEY, place, F.lit("").alias("text"))
    # a kept row and its text meet in an aggregation, in which equal texts are one row before the shuffle
    left = out.filter("digest IS NOT NULL").select(*key, place, F.lit(None).cast("string").alias("text"))
    texts = rows.select(*key, F.lit(None).cast("struct<pos: bigint, before: int, new_role: string>").alias("place"), "text")
    met = left.unionByName(texts).groupBy(*key).agg(F.max("place").alias("place"), F.max("text").alias("text")).filter("place IS NOT NULL")
    return met.select(*_KEY, "place", "text").unionByName(made).select(*_KEY, "place.pos", "place.before", F.concat("place.new_role", F.lit(":"), "text").alias("line"))


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation."""
    rows = damaged(conversations)
    narrow = structure(rows)
    turns = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.countDistinct("turn")
    gaps = narrow.groupBy(*_KEY).agg(F.coalesce(turns, F.lit(0)).try_cast("long").alias("gaps"))
    segs = common.stage(segments(narrow), "segments")
    nodes = automaton(segs.select("sig").distinct()).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = segs.withColumn("salt", F.pmod(F.xxhash64(*_KEY, "seg"), F.lit(SALTS)).cast("int"))
    solved = common.stage(salted.join(nodes, ["sig", "salt"]).drop("salt"), "solved")
    states, ends = decided(solved)
    audit = F.get("audit", F.col("entry") * STATES + F.col("exit"))
    ways = common.stage(solved.join(states, [*_KEY, "seg"]).withColumn("audit", audit).drop("cost", "rank"), "ways")
    counts = ("blank", "duplicate", "truncated", "illegal")
    edited = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda s: s["audit"]), "")
    whole = ways.groupBy(*_KEY).agg(*(F.sum(c).alias(c) for c in counts), edited.alias("audit"), F.max("seg").alias("last")).join(ends, _KEY)
    last = whole.select(*_KEY, F.col("last").alias("seg"), "tail")
    tailed = ways.join(last, [*_KEY, "seg"], "left").withColumn("tail", F.coalesce("tail", F.lit("")))
    ordered = repaired_lines(tailed, rows).repartition(*_KEY).sortWithinPartitions(*_KEY, "pos", "before")
    hashes = ordered.mapInPandas(_hashed, "absent boolean, conv long, repaired_sha256 string")
    out = conversations.select(*_conversation()).distinct().join(gaps, _KEY, "left").join(whole, _KEY, "left").join(hashes, _KEY, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(
        F.when(~F.col("absent"), F.col("conv")).alias("conv_id"),
        F.when(F.col("last").isNull(), F.lit(0).cast("long")).otherwise(F.col("gaps")).alias("gaps"), *(zero(c) for c in counts),
        F.coalesce("total", F.lit(0).cast("long")).alias("cost"),
        F.coalesce(F.concat("audit", "tail"), F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(common.table(spark, sf_dir, "conversations"))


def _ways(state: int) -> str:
    """SQL of the ways to handle row r in a state, as structs of cost, edits and lines, for the least of them."""
    out, before, paid, done = [], "", 0, ""
    for _ in range(3):
        rest = lambda line, after: f"'{before}' || {line} || if(z{after}.t = '', '', chr(10) || z{after}.t)"  # noqa: E731,B023
        tail = f"if(z{state}.t = '' AND '{before}' <> '', rtrim('{before}', chr(10)), '{before}' || z{state}.t)"
        out.append(f"{{'c': {paid + DELETE} + z{state}.c, 'w': '{done}D' || z{state}.w, 't': {tail}}}")
        role, after = due(state), inserted(state)
        late = f"if(fault = 'truncated', {TRUNCATED}, 0)"
        fits = f"lost OR initial <> '{role[0]}'"
        out.append(f"{{'c': if({fits}, 1000000000, {paid} + {late} + z{after}.c), 'w': '{done}K' || z{after}.w, 't': {rest("role || ':' || text", after)}}}")
        if state == START:
            out.append(f"{{'c': if(lost OR initial <> 's', 1000000000, {paid} + {late} + z{SYSTEM}.c), 'w': '{done}K' || z{SYSTEM}.w, 't': {rest("role || ':' || text", SYSTEM)}}}")
        out.append(f"{{'c': if(lost, 1000000000, {paid + REROLE} + {late} + z{after}.c), 'w': '{done}R' || z{after}.w, 't': {rest(f"'{role}:' || text", after)}}}")
        before, paid, done, state = f"{before}{role}:\n", paid + INSERT, f"{done}I", after
    return f"list_min([{', '.join(out)}])"


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: ord(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"
_BLANK = r"\x20\x09-\x0D"
_TAIL_LINES = ("", "user:\nassistant:", "", "assistant:")
_LAST = ", ".join(f"{{'c': {INSERT * len(t)}, 'w': '{t}', 't': '{_TAIL_LINES[p]}'}} AS z{p}" for p, t in enumerate(TAILS))

ORACLE_SQL = f"""
WITH RECURSIVE r AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind FROM conversations
), d AS (
  SELECT conv_id, turn, if(kind = 4, 'user', role) AS role,
    if(kind = 1, '', if(kind = 2, regexp_replace(text, '[.!?]', '', 'g'), text)) AS text, unnest(range(if(kind = 3, 2, 1))) AS copy
  FROM r WHERE kind <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d
), g AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^{_BLANK}]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][{_BLANK}]*\\z') THEN 'truncated' ELSE '' END AS fault
  FROM o
), f AS MATERIALIZED (SELECT *, fault IN ('blank', 'duplicate') AS lost FROM g),
n AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, max(i) AS last,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
), w AS (
  SELECT conv_id, last AS i, {_LAST} FROM n
  UNION ALL
  SELECT w.conv_id, w.i - 1, {", ".join(f"{_ways(p)} AS z{p}" for p in range(STATES))}
  FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i
), b AS (SELECT conv_id, z0 FROM w WHERE i = 0)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(z0.c, 0) AS BIGINT) AS cost,
  coalesce(z0.w, '') AS audit, sha256(coalesce(z0.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""
