"""Substring dedup: fuzzy passages that documents share, by collinear chaining of k-mer seeds.

1. Seeds are minimisers: of every WINDOW successive k-mers of words the one of least hash, so any shared run of
   KMER + WINDOW - 1 words has a common seed.
2. Per hash, the document of least doc_id is the reference; every other occurrence makes one match with it. A
   passage in a million documents gives a million matches, not their square, and all documents that share it link
   through the reference.
3. Matches of a pair (document, reference) are chained: a match adds WEIGHT, a gap costs GAP a word on either side,
   and a Fenwick tree over reference positions finds the best chain to extend (prefix maxima).
4. Chains are aligned on words, MARGIN words to either side included, and the whole of a periodic stretch there, as
   seeds of equal hash count once: along the diagonal, or by matching blocks between anchors where
   words were inserted or lost. All passages of MIN_WORDS equal words or more are returned: a chain may hold several.
5. The reference of a seed may share less than a passage and hide a document that shares more. So every run of
   MIN_WORDS words that no passage of its document holds and whose seeds all occur in smaller ones meets the least document
   that has the whole run: a run of MIN_WORDS words that a document of smaller doc_id has too is always in a passage.

Words end at ASCII white space and A-Z is lower-cased.

Cases: rows with null doc_id and null, empty or short texts have no passages; repeats within a document, repeated
rows of one doc_id among them, are not reported; an empty table gives no rows. Other columns are ignored by
shared_passages and kept by without_repeats, whatever their names. Very long texts are cut into slices around their
chains; only those travel.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KMER, WINDOW = 8, 16
WEIGHT, GAP = 8.0, 0.1
#: Pairs of words up to which a gap between anchors is compared word by word; ends of a document cut in one task.
DENSE, ENDS = 250_000, 1000
MARGIN = 64
MIN_WORDS = 50
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_codes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "replace").lower().split()
    return np.fromiter(map(crc32, words), np.uint32, len(words))


def hashes(codes: np.ndarray, size: int, at: np.ndarray | slice) -> np.ndarray:
    """Hashes of the runs of `size` words that start at the positions `at`."""
    n = len(codes) - size + 1
    h = np.zeros(n, np.uint64)[at]
    for i in range(size):
        h = h * _BASE + codes[i : i + n][at]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def seeds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word positions of the text's minimisers; a run of equal ones counts once."""
    codes = word_codes(text).astype(np.uint64)
    n = len(codes) - KMER + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = hashes(codes, KMER, slice(None))
    width = min(WINDOW, n)
    views = np.lib.stride_tricks.sliding_window_view(h, width)
    at = np.unique(np.concatenate([np.arange(a, min(a + 65536, len(views))) + views[a : a + 65536].argmin(axis=1) for a in range(0, len(views), 65536)]))
    at = at[np.concatenate([[True], h[at][1:] != h[at][:-1]])]
    # a long run of one word is a passage too, but shorter runs elsewhere would be its reference: it has its own seed
    edge = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1], [True]]))
    runs = edge[:-1][np.diff(edge) >= MIN_WORDS]
    h, at = np.concatenate([h[at], codes[runs] * _BASE + np.uint64(1)]), np.concatenate([at, runs])
    order = np.lexsort((h, at))
    return h[order].view(np.int64), at[order]


def _seed_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [seeds(t) for t in b["text"]]
        n = [len(h) for h, _ in found]
        first = []
        for h, _ in found:
            flags = np.zeros(len(h), bool)
            flags[np.unique(h, return_index=True)[1]] = True
            first.append(flags)
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        yield pd.DataFrame({"h": join([h for h, _ in found], np.int64), "doc": np.repeat(b["doc"].to_numpy(), n), "pos": join([p for _, p in found], np.int64).astype(np.int32), "first": join(first, bool)})


class Fenwick:
    """Prefix maxima of (value, index)."""

    def __init__(self, size: int):
        self.best = [(-np.inf, -1)] * (size + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def upto(self, at: int) -> tuple[float, int]:
        """The largest value at positions below at."""
        out = (-np.inf, -1)
        while at > 0:
            if self.best[at] > out:
                out = self.best[at]
            at -= at & -at
        return out


def chains(pos: list[int], ref: list[int]) -> list[tuple[int, int, int, int, int, bool]]:
    """(start, end, ref_start, ref_end, matches, bent) of the best disjoint chains of matches, sorted by pos."""
    rank = {r: i for i, r in enumerate(sorted(set(ref)))}
    tree, score, before, held = Fenwick(len(rank)), [0.0] * len(pos), [-1] * len(pos), 0
    for i, (p, r) in enumerate(zip(pos, ref, strict=True)):
        # matches at one position do not chain with each other: they enter the tree when the position is left
        while held < i and pos[held] < p:
            tree.put(rank[ref[held]], (score[held] + GAP * (pos[held] + ref[held]), held))
            held += 1
        value, j = tree.upto(rank[r])
        value -= GAP * (p + r)
        score[i], before[i] = (WEIGHT + value, j) if value > 0 else (WEIGHT, -1)
    used, out = [False] * len(pos), []
    for i in sorted(range(len(pos)), key=lambda k: -score[k]):
        chain, j = [], i
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = before[j]
        if chain:
            a, b = chain[-1], chain[0]
            bent = len({pos[k] - ref[k] for k in chain}) > 1
            out.append((pos[a], pos[b] + KMER, ref[a], ref[b] + KMER, len(chain), bent))
    return out


_CHAIN = "doc long, ref long, s int, e int, rs int, re int, bent boolean"


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Matches come sorted by (doc, ref, pos, ref_pos); whole pairs are chained."""
    rest = None
    for b in batches:
        rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
        key = rest[["doc", "ref"]].to_numpy()
        cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
        if len(cut):
            yield _pairs(rest.iloc[: cut[-1] + 1])
            rest = rest.iloc[cut[-1] + 1 :]
    if rest is not None and len(rest):
        yield _pairs(rest)


def _pairs(rows: pd.DataFrame) -> pd.DataFrame:
    key = rows[["doc", "ref"]].to_numpy()
    edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(rows)]
    pos, ref, out = rows["pos"].tolist(), rows["ref_pos"].tolist(), []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out += [(*key[a], s, e, rs, re, bent) for s, e, rs, re, _, bent in chains(pos[a:b], ref[a:b])]
    return pd.DataFrame(out, columns=["doc", "ref", "s", "e", "rs", "re", "bent"])


def best_run(gain: np.ndarray) -> tuple[int, int]:
    """[start, end) of the run of largest sum."""
    total = np.concatenate([[0.0], np.cumsum(gain)])
    low = np.minimum.accumulate(total)
    end = int((total - low).argmax())
    return int(total[: end + 1].argmin()), end


def runs(gain: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """[start, end) of the best run with gains of `least` or more, and of those on either side of every best run."""
    parts = [(0, len(gain))]
    while parts:
        a, b = parts.pop()
        if np.maximum(gain[a:b], 0).sum() < least:
            continue
        s, e = best_run(gain[a:b])
        if np.maximum(gain[a + s : a + e], 0).sum() >= least:
            yield a + s, a + e
        parts += [(a, a + s), (a + e, b)]


def aligned(a: np.ndarray, b: np.ndarray, shift: int | None, least: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(start, end, other_start, other_end, equal words) of every passage of a in b with `least` equal words or more;
    shift: place in b of a's first word if the chain lies on one diagonal."""
    if shift is not None:
        lead = max(0, -shift)
        n = min(len(a) - lead, len(b) - shift - lead)
        if n <= 0:
            return
        same = a[lead : lead + n] == b[shift + lead : shift + lead + n]
        for s, e in runs(np.where(same, 1.0, -2.0), least):
            yield lead + s, lead + e, lead + s + shift, lead + e + shift, int(same[s:e].sum())
        return
    blocks = matching(a, b)
    gains: list[float] = []
    for i, (x, y, _) in enumerate(blocks):
        lost = max(x - blocks[i - 1][0] - blocks[i - 1][2], y - blocks[i - 1][1] - blocks[i - 1][2]) if i else 0
        gains += [-2.0 * lost, float(blocks[i][2])]
    for s, e in runs(np.array(gains), least):
        run = blocks[s // 2 : (e + 1) // 2]
        yield run[0][0], run[-1][0] + run[-1][2], run[0][1], run[-1][1] + run[-1][2], sum(n for *_, n in run)


def matching(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(place in a, place in b, size) of ordered blocks of equal words. Runs of KMER words that occur once in each
    are anchors; the longest row of anchors rising in both is kept and grown along its diagonals. Only gaps between
    anchors of DENSE pairs of words or fewer are compared word by word, so time does not grow with the square of a
    slice."""
    out: list[tuple[int, int, int]] = []

    def fill(i: int, i2: int, j: int, j2: int) -> None:
        if i < i2 and j < j2 and (i2 - i) * (j2 - j) <= DENSE:
            found = SequenceMatcher(None, a[i:i2].tolist(), b[j:j2].tolist(), autojunk=False).get_matching_blocks()
            out.extend((i + x.a, j + x.b, x.size) for x in found if x.size)

    i = j = 0
    for x, y in _anchors(a, b):
        if x < i or y < j:
            continue  # within the block before
        back = min(x - i, y - j)
        if back:
            differ = np.flatnonzero(a[x - back : x][::-1] != b[y - back : y][::-1])
            back = int(differ[0]) if len(differ) else back
        x, y = x - back, y - back
        size = _agreement(a[x:], b[y:])
        fill(i, x, j, y)
        out.append((x, y, size))
        i, j = x + size, y + size
    fill(i, len(a), j, len(b))
    return out


def _anchors(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The longest row of places, rising in a and in b, of runs of KMER words that both have once."""
    if min(len(a), len(b)) < KMER:
        return []
    once = []
    for codes in (a, b):
        h, at, n = np.unique(hashes(codes.astype(np.uint64), KMER, slice(None)), return_index=True, return_counts=True)
        once.append((h[n == 1], at[n == 1]))
    _, i, j = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    order = np.argsort(once[0][1][i])
    pairs = list(zip(once[0][1][i][order].tolist(), once[1][1][j][order].tolist(), strict=True))
    tails: list[int] = []
    heads: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, y) in enumerate(pairs):
        at = bisect_left(tails, y)
        before[n] = heads[at - 1] if at else -1
        tails[at : at + 1], heads[at : at + 1] = [y], [n]
    out, n = [], heads[-1] if heads else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def past(codes: np.ndarray, at: int) -> int:
    """Where a slice that would end at `at` ends: beyond a stretch of period WINDOW or less there, as it has no seeds."""
    while at < len(codes) and len(set(codes[max(0, at - 2 * WINDOW) : at].tolist())) <= WINDOW:
        low = max(0, at - 2 * WINDOW)
        end = max(low + p + _agreement(codes[low + p :], codes[low:-p]) for p in range(1, WINDOW + 1) if low + p < len(codes))
        if end <= at:
            break
        at = min(len(codes), end + MARGIN)
    return at


def _agreement(a: np.ndarray, b: np.ndarray) -> int:
    """The number of equal words at the start of both."""
    done, size = 0, 4 * WINDOW
    while done < min(len(a), len(b)):
        x, y = a[done : done + size], b[done : done + size]
        n = min(len(x), len(y))
        if len(differ := np.flatnonzero(x[:n] != y[:n])):
            return done + int(differ[0])
        done, size = done + n, 2 * size
    return done


def _sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for doc, text, wanted in zip(b["doc"], b["text"], b["wanted"], strict=True):
            codes = word_codes(text)
            for w in wanted:
                low = len(codes) - past(codes[::-1], len(codes) - max(0, w["s"] - MARGIN))
                out.append((doc, w["s"], w["e"], low, codes[low : past(codes, min(len(codes), w["e"] + MARGIN))].tobytes()))
        yield pd.DataFrame(out, columns=["doc", "s", "e", "low", "words"])


_PASSAGE = "doc_id long, start int, end int, other_id long, other_start int, other_end int, words int, identity double"


def _aligned_rows(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                x, y = np.frombuffer(r.a, np.uint32), np.frombuffer(r.b, np.uint32)
                at, other = r.at, r.other
                for s, e, os, oe, equal in aligned(x, y, None if r.bent else (r.rs - other) - (r.s - at), least):
                    out.append((r.doc, at + s, at + e, r.ref, other + os, other + oe, equal, equal / max(e - s, oe - os)))
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "other_id", "other_start", "other_end", "words", "identity"])

    return run


def windows(text: str, shared: list[int], found: list | None, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and positions of every run of `least` words whose seeds are all in `shared` and which no passage in `found`
    holds, and the seeds of these runs. Runs of a periodic stretch are given until they repeat, and then in steps that
    cover it."""
    codes = word_codes(text).astype(np.uint64)
    n = len(codes) - least + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    inner = least - KMER - WINDOW + 2  # windows of seeds within a run
    low = hashes(codes, KMER, slice(None))
    for k in (1, 2, 4, 8):
        low = np.minimum(low[:-k], low[k:])
    lacks = np.concatenate([[0], np.cumsum(~np.isin(low.view(np.int64), np.array(shared, np.int64)))])
    bad = lacks[inner:] - lacks[:-inner]
    held = np.zeros(n + 1, np.int64)
    for f in () if found is None else found:
        if f["end"] - f["start"] >= least:
            held[f["start"]] += 1
            held[f["end"] - least + 1] -= 1
    at = np.flatnonzero((bad[:n] == 0) & (np.cumsum(held)[:n] == 0))
    h = np.zeros(n, np.uint64)
    h[at] = hashes(codes, least, at)
    again = np.zeros(n + 1, bool)
    for p in range(1, min(WINDOW, n - 1) + 1):
        again[p:n] |= (h[p:] == h[:-p]) & (h[p:] != 0)
    at = at[~again[at] | ~again[at + 1] | (at % min(least, 2 * WINDOW) == 0)]
    edges = np.zeros(len(low) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, np.minimum(at + inner, len(low)), -1)
    return h[at].view(np.int64), at.astype(np.int32), np.unique(low[np.cumsum(edges)[: len(low)] > 0]).view(np.int64)


def _window_rows(least: int, with_seeds: bool):
    """Rows of windows; with_seeds: their seeds as well, at position -1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, text, shared, found in zip(b["doc"], b["text"], b["shared"], b["found"], strict=True):
                h, pos, own = windows(text, shared, found, least)
                if len(h):
                    yield pd.DataFrame({"h": h, "doc": doc, "pos": pos})
                    if with_seeds:
                        yield pd.DataFrame({"h": own, "doc": doc, "pos": np.full(len(own), -1, np.int32)})

    return run


def _aligned(texts: DataFrame, linked: DataFrame, min_words: int) -> DataFrame:
    """The passages of the chains `linked`."""
    ends = common.stage(linked.select("doc", "s", "e").union(linked.select("ref", "rs", "re")).distinct(), "ends")
    # the ends in a document that very many others share go to several tasks
    many = ends.groupBy("doc").count().filter(F.col("count") > ENDS).select("doc", F.ceil(F.col("count") / ENDS).alias("parts"))
    dealt = ends.join(many, "doc", "left").withColumn("part", F.pmod(F.xxhash64("s", "e"), F.coalesce("parts", F.lit(1))))
    wanted = dealt.groupBy("doc", "part").agg(F.collect_list(F.struct("s", "e")).alias("wanted")).drop("part")
    slices = common.stage(texts.join(wanted, "doc").mapInPandas(_sliced, "doc long, s int, e int, low int, words binary"), "slices")
    keys = slices.select("doc", "s", "e")
    if keys.distinct().count() != keys.count():  # repeated doc_ids
        slices = common.stage(slices.dropDuplicates(["doc", "s", "e"]), "slices")
    # plain joins of written tables: where one slice meets very many others, Spark splits its partition
    pairs = linked.join(slices.withColumnsRenamed({"low": "at", "words": "a"}), ["doc", "s", "e"])
    pairs = pairs.join(slices.toDF("ref", "rs", "re", "other", "b"), ["ref", "rs", "re"])
    return pairs.mapInPandas(_aligned_rows(min_words), _PASSAGE)


def shared_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Passages [start, end) in words of doc_id that other_id, the reference, has at [other_start, other_end)."""
    if min_words < KMER + WINDOW - 1:
        raise ValueError(f"shorter passages than {KMER + WINDOW - 1} words may have no seed")
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), common.text_of().alias("text"))
    found = common.stage(texts.mapInPandas(_seed_rows, "h long, doc long, pos int, first boolean"), "seeds")
    # every document counts once, with its first occurrence
    own = found.filter("first").groupBy("h").agg(F.min("doc").alias("ref"), F.min_by("pos", "doc").alias("ref_pos"), F.count(F.lit(1)).alias("n"))
    refs = own.filter("n > 1").drop("n")
    matches = common.stage(found.join(refs, "h").select("h", "doc", "ref", "pos", "ref_pos", "first"), "matches")
    others = matches.filter("doc != ref").drop("h", "first")
    dealt = others.repartition(matches.count() // 200_000 + 1, "doc", "ref").sortWithinPartitions("doc", "ref", "pos", "ref_pos")
    linked = common.stage(dealt.mapInPandas(_chained, _CHAIN), "chains")
    passages = common.stage(_aligned(texts, linked, min_words).distinct(), "passages")
    # what no passage holds yet meets the least document that has the whole run of min_words words: such a document has
    # all of the run's seeds, so only runs whose seeds all have a smaller reference can have one
    rows = "h long, doc long, pos int"
    shared = matches.filter("first AND ref != doc").groupBy("doc").agg(F.collect_set("h").alias("shared"))
    spans = passages.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set(F.struct("start", "end")).alias("found"))
    loose = common.stage(texts.join(shared, "doc").join(spans, "doc", "left").mapInPandas(_window_rows(min_words, True), rows), "loose-windows")
    wanted = found.filter("first").join(loose.filter("pos < 0").select("h").distinct(), "h", "left_semi")
    shared = wanted.groupBy("doc").agg(F.collect_set("h").alias("shared")).withColumn("found", F.lit(None).cast("array<struct<start:int,end:int>>"))
    every = common.stage(texts.join(shared, "doc").mapInPandas(_window_rows(min_words, False), rows), "windows")
    least = every.groupBy("h").agg(F.min(F.struct("doc", "pos")).alias("least"))
    met = loose.filter("pos >= 0").join(least, "h").filter("doc != least.doc")
    met = met.groupBy("doc", F.col("least.doc").alias("ref"), (F.col("pos") - F.col("least.pos")).alias("shift"))
    met = met.agg(F.min("pos").alias("s"), (F.max("pos") + min_words).alias("e"))
    met = met.select("doc", "ref", "s", "e", (F.col("s") - F.col("shift")).alias("rs"), (F.col("e") - F.col("shift")).alias("re"), F.lit(False).alias("bent"))
    more = _aligned(texts, common.stage(met, "more-chains"), min_words)
    return passages.union(more).distinct()


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with every passage removed that a document of smaller doc_id has; the reference keeps it."""
    cut = shared_passages(docs, min_words).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("_cut"))
    cut = cut.withColumnRenamed("doc_id", "_doc")
    whole = docs.select(F.col("doc_id").cast("long").alias("_id"), "text", F.struct(*docs.columns).alias("row"))

    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text: str, holes) -> str:
            if holes is None or text is None:
                return text
            words = text.encode("utf-8", "replace").split()
            left, at = [], 0
            for start, end in sorted((h["start"], h["end"]) for h in holes):
                left += words[at : max(at, start)]
                at = max(at, end)
            return b" ".join(left + words[at:]).decode("utf-8")

        return pd.Series([one(t, h) for t, h in zip(texts, spans, strict=True)], dtype=object)

    joined = whole.join(cut, F.col("_id") == F.col("_doc"), "left")
    changed = joined.filter("_cut IS NOT NULL").withColumn("row", F.col("row").withField("text", kept("text", "_cut")))
    return joined.filter("_cut IS NULL").select("row.*").union(changed.select("row.*"))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
