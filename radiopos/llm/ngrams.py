"""Language-model scores from a log-frequency Bloom filter.

An n-gram seen c times in the training documents is put into the filter at the levels 1 to 1 + floor(log c) to BASE; a
reader probes level after level until one is missing, and so gets the count up to quantisation (exact to 3), never too
small a level, with a false level once in some 1,700 n-grams (BITS a level). Single words keep exact counts by their 64-bit
hashes, as the base score needs them. Probabilities are smoothed order by order with a Dirichlet prior: p(w | h) = (c(hw) + MU p(w | h')) /
(c(h) + MU), from p(w) = (c + 1) / (N + V + 1); a quantised c(hw) is at most c(h). A text's log10 probability is the
sum over its words and its end; the end of a text is also what its first word follows.

Texts are packed into blocks of BLOCK bytes; longer ones are cut between words and their parts' sums added. The filter and
the counts are cut by hash into shards, of which each holds the n-grams of SHARD bytes of text, whatever the corpus' size.
A model of at most BROADCAST bytes is broadcast to the workers. A larger one, and every large corpus has one, is not copied:
each block sends the distinct n-grams it asks for, 4 bytes each, to their shards, where the filter is probed, and
gets their levels back. As a block asks for an n-gram once, no frequent word makes a hot shard. Both ways give
the same scores.

Cases: null texts are empty, and an empty text is its end alone; a null doc_id is a training document; repeated rows are
scored and learned from each; texts and words of any length pass whole; without training documents all counts are zero; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import staging
from . import common, labelled

#: Words of an n-gram; the prior's weight.
ORDER, MU = 2, 64.0
#: Quantisation; filter bits a level and probes of each.
BASE, BITS, PROBES = 1.5, 16, 8
BLOCK, SHARD = 4 << 20, 8 << 20
#: n-grams counted in a task before they are sent.
FLUSH = 2_000_000
#: n-grams that a shard is asked for at once.
ASKED = 500_000
#: The largest model, in bytes, that is broadcast: what Spark's own joins broadcast.
BROADCAST = 10 << 20

_WINDOW = 1 << 18
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LEVELS = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_P = 0xD1342543DE82EF95  # odd, so that it has an inverse
_ZERO = np.zeros(1, np.uint64)


def _powers(base: int) -> np.ndarray:
    """1, base, base^2, ... mod 2^64."""
    factors = np.full(_WINDOW, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_POWERS, _INVERSES = _powers(_P), _powers(pow(_P, -1, 2**64))
END = int(mixed(np.array([0x5EED], np.uint64))[0])


def words(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, hashes) of the words of data, a window at a time: a polynomial of a word's bytes, mixed with its length."""
    a, at = np.frombuffer(data, np.uint8), 0
    while at < len(a):
        end = min(at + _WINDOW, len(a))
        spaces = np.flatnonzero(_SPACE[a[at:end]])
        if end < len(a) and not len(spaces):  # a word longer than a window
            total, size = 0, 0
            while at + size < len(a):
                part = a[at + size : at + size + _WINDOW]
                gap = np.flatnonzero(_SPACE[part])
                n = int(gap[0]) if len(gap) else len(part)
                total += int((_BYTES[part[:n]] * _POWERS[:n]).sum()) * pow(_P, size, 2**64)
                size += n
                if len(gap):
                    break
            yield np.array([at]), mixed(np.array([total % 2**64], np.uint64) + np.uint64(size))
            at += size
            continue
        if end < len(a):
            end = at + int(spaces[-1]) + 1
        window = a[at:end]
        inside = np.concatenate([[False], ~_SPACE[window], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, stops = edges[::2], edges[1::2]
        sums = np.concatenate([_ZERO, np.cumsum(_BYTES[window] * _POWERS[: len(window)])])
        yield starts + at, mixed((sums[stops] - sums[starts]) * _INVERSES[starts] + (stops - starts).astype(np.uint64))
        at = end


class Tokens:
    """Tokens of a window: position of their document in the block, hash, and for each order from 2 the n-gram's hash (0:
    none), with that of its history."""

    def __init__(self, doc: np.ndarray, word: np.ndarray, history: list[int], order: int):
        n = order - 1
        all_ = np.concatenate([np.array(history, np.uint64), word])
        self.doc, self.word, self.before, self.grams = doc, word, all_[n - 1 : -1], []
        gram, fits = all_.copy(), np.ones(len(all_), bool)
        for k in range(2, order + 1):
            longer, ok = np.zeros_like(gram), np.zeros_like(fits)
            longer[1:] = mixed(gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + all_[1:] + np.uint64(k))
            ok[1:] = fits[:-1]
            if k > 2:  # no history reaches into another text
                ok[2:] &= all_[1:-1] != END
            self.grams.append((longer[n:], np.concatenate([_ZERO, gram[:-1]])[n:], ok[n:]))
            gram, fits = longer, ok
        self.history = [int(x) for x in all_[len(all_) - n :]]


def tokens(data: bytes, ends: np.ndarray, whole: np.ndarray, before: bytes, order: int) -> Iterator[Tokens]:
    """The tokens of a block, a window at a time. ends: where each text ends (a space follows); whole: whether it ends in this
    block; before: the last words of the first text's earlier parts."""
    history = [END] * (order - 1)
    for _, hashes in words(before):
        history = [*history, *(int(h) for h in hashes)][-(order - 1) :]
    marks, at = ends[whole], 0
    last = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for starts, hashes in itertools.chain(words(data), [last]):
        upto = int(np.searchsorted(marks, starts[-1])) if len(starts) else len(marks)
        own = marks[at:upto]
        if not len(starts) and not len(own):
            continue
        at = upto
        pos = np.concatenate([starts, own])
        by = np.argsort(pos, kind="stable")
        hashes = np.concatenate([hashes, np.full(len(own), END, np.uint64)])[by]
        t = Tokens(np.searchsorted(ends, pos[by]), hashes, history, order)
        history = t.history
        yield t


def _planes(x: np.ndarray, kind: str = "<u8") -> bytes:
    """Numbers byte by byte, all lowest bytes first, so that small ones compress."""
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize).T).tobytes()


def _numbers(data: bytes, kind: str = "<u8") -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _gaps(x: np.ndarray) -> bytes:
    """Ascending 32-bit numbers by their gaps."""
    return _planes(np.diff(x, prepend=0), "<u4")


def _ungapped(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data, "<u4"), dtype=np.uint64)


_LOW = np.uint64(2**32 - 1)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) % np.uint64(shards)


def keys_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """Shard and, in the low 32 bits, the name of an n-gram there."""
    return (shard_of(grams, shards) << np.uint64(32)) | (grams & _LOW)


def dealt(hashes: np.ndarray, keys: np.ndarray, shards: int) -> Iterator[tuple[int, slice, slice]]:
    """Slices of words (sorted by shard) and n-gram keys (sorted) for each shard that has some."""
    of_word, of_key = shard_of(hashes, shards), keys >> np.uint64(32)
    for s in np.union1d(of_word, of_key):
        yield int(s), slice(*np.searchsorted(of_word, [s, s + np.uint64(1)])), slice(*np.searchsorted(of_key, [s, s + np.uint64(1)]))


def by_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return np.argsort(shard_of(hashes, shards), kind="stable")


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def _count_of(level: int) -> float:
    """The middle of the counts of a level."""
    if level < 1:
        return 0.0
    low, high = math.ceil(BASE ** (level - 1) - 1e-9), math.ceil(BASE**level - 1e-9) - 1
    return (low + high) / 2


COUNTS = np.array([_count_of(level) for level in range(_LEVELS + 1)])


def _steps(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where an n-gram's probes begin and how far they are apart."""
    first = mixed(names + np.uint64(1))
    return first, mixed(first) | np.uint64(1)


def _place(x: np.ndarray, sizes: np.ndarray | np.uint64) -> np.ndarray:
    """A bit of a filter of fewer than 2^32 bits, from the high half of x."""
    return ((x >> np.uint64(32)) * sizes) >> np.uint64(32)


def built(names: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """The size in bits and the bits of a shard's filter."""
    levels = level_of(counts) if len(counts) else np.zeros(0, np.int64)
    size = max(64, -(-int(levels.sum()) * BITS // 8) * 8)
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        first, step = _steps(names[levels >= level])
        for j in range(PROBES):
            bits[_place(first + np.uint64(level * PROBES + j) * step, np.uint64(size))] = True
    return size, np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """Shards of a model, given as rows of size, bits, words, counts."""

    def __init__(self, rows: list):
        self.sizes = np.array([r["size"] for r in rows], np.uint64)
        self.starts = np.concatenate([_ZERO, np.cumsum(self.sizes)])
        self.bits = np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8)
        held = np.concatenate([np.zeros(0, np.uint64), *(_numbers(r["words"]) for r in rows)])
        counts = np.concatenate([np.zeros(0, np.uint64), *(_numbers(r["counts"]) for r in rows)]).astype(np.int64)
        by = np.argsort(held)
        self.words, self.counts = held[by], counts[by]

    def count(self, hashes: np.ndarray) -> np.ndarray:
        return _found(self.words, self.counts, hashes)

    def levels(self, shard: np.ndarray, names: np.ndarray) -> np.ndarray:
        """The highest level up to which all are there, for each n-gram."""
        out, left = np.zeros(len(names), np.uint8), np.arange(len(names))
        first, step = _steps(names)
        one = len(self.sizes) == 1
        start, size = (np.uint64(0), self.sizes[0]) if one else (self.starts[shard], self.sizes[shard])
        for level in range(1, _LEVELS + 1):
            for j in range(PROBES):
                if not len(left):
                    return out
                pos = _place(first + np.uint64(level * PROBES + j) * step, size)
                if not one:
                    pos += start
                held = (self.bits[pos >> np.uint64(3)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1 == 1
                left, first, step = left[held], first[held], step[held]
                if not one:
                    start, size = start[held], size[held]
            out[left] = level
        return out


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The values of sorted keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(asked), values.dtype)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], values.dtype.type(0))


_BLOCKS = "block long, before binary, data binary, ends binary, whole binary, rows binary, ids binary, known binary, out binary"


def _cuts(data: bytes, size: int) -> list[int]:
    """Where a text's parts begin and end: after white space, about every `size` bytes."""
    cuts, a = [0], np.frombuffer(data, np.uint8)
    while len(data) - cuts[-1] > size:
        at = cuts[-1]
        spaces = np.flatnonzero(_SPACE[a[at : at + size]])
        if len(spaces):
            cuts.append(at + int(spaces[-1]) + 1)
            continue
        at += size  # a word as long as a block
        while at < len(data) and not len(spaces):
            spaces = np.flatnonzero(_SPACE[a[at : at + size]])
            at = at + int(spaces[0]) + 1 if len(spaces) else at + size
        cuts.append(min(at, len(data)))
    return [*cuts, len(data)]


def _packed(order: int, most: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 33
        number, blocks, size, held = 0, 0, 0, []

        def block(held: list, before: bytes) -> pd.DataFrame:
            ends = np.cumsum([len(h[0]) + 1 for h in held], dtype=np.int64) - 1
            columns = {"block": first + blocks, "before": before, "data": b"".join(h[0] + b"\n" for h in held), "ends": ends.tobytes()}
            columns["whole"] = np.array([h[1] for h in held], bool).tobytes()
            columns |= {c: np.array([h[i] for h in held], kind).tobytes() for i, (c, kind) in enumerate([("rows", np.int64), ("ids", np.int64), ("known", bool), ("out", bool)], 2)}
            return pd.DataFrame([columns])

        for b in batches:
            for doc, text, out in zip(b["doc_id"], b["text"], b["out"], strict=True):
                data = text.encode().lower()
                known = not pd.isna(doc)
                row = (first + number, int(doc) if known else 0, known, out)
                number += 1
                if len(data) > most:
                    cuts, before = _cuts(data, most), b""
                    for start, stop in zip(cuts, cuts[1:], strict=False):
                        yield block([(data[start:stop], stop == len(data), *row)], before)
                        blocks += 1
                        before = b" ".join(data[start:stop].rsplit(None, order - 1)[-(order - 1) :])
                    continue
                if size + len(data) > most:
                    yield block(held, b"")
                    blocks, size, held = blocks + 1, 0, []
                held.append((data, True, *row))
                size += len(data) + 1
        if held:
            yield block(held, b"")

    return run


class Block:
    """A row of blocks, read."""

    def __init__(self, r: dict):
        self.row, self.data, self.before = r["block"], r["data"], r["before"]
        self.ends = np.frombuffer(r["ends"], np.int64)
        self.whole, self.known, self.out = (np.frombuffer(r[c], bool) for c in ("whole", "known", "out"))
        self.rows, self.ids = (np.frombuffer(r[c], np.int64) for c in ("rows", "ids"))

    @staticmethod
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        """The blocks of Arrow batches, one copied at a time: a batch may hold many."""
        for b in batches:
            for at in range(b.num_rows):
                yield Block(b.slice(at, 1).to_pylist()[0])

    def tokens(self, order: int) -> Iterator[Tokens]:
        return tokens(self.data, self.ends, self.whole, self.before, order)


def pack(docs: DataFrame, out: Column, order: int = ORDER) -> DataFrame:
    """Staged blocks of docs (doc_id, text); `out` tells the documents that are not learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"), out.alias("out"))
    # few blocks a file, as what a task reads of them goes to Python in one batch
    return staging.stage(rows.mapInPandas(_packed(order, BLOCK), _BLOCKS), "blocks", compression="zstd", maxRecordsPerFile="2")


def shards_for(blocks: DataFrame) -> int:
    """Shards by the bytes of text."""
    return (blocks.agg(F.sum(F.length("data"))).first()[0] or 0) // SHARD + 1


def _arrow(rows: list[tuple], columns: list[str]) -> pa.RecordBatch:
    """Rows of a number first and binaries or numbers behind it; at least one."""
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], columns)


def _counted(order: int, shards: int, flush: int) -> Callable:
    def sent(words_: list, keys: list) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *words_]), return_counts=True)
        by = by_shard(h, shards)
        h, c = h[by], c[by]
        k, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_counts=True)
        out = [(s, _planes(h[w]), _planes(c[w]), _gaps(k[g] & _LOW), _planes(n[g])) for s, w, g in dealt(h, k, shards)]
        return _arrow(out, ["shard", "words", "counts", "names", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_, keys, size = [], [], 0
        for block in Block.each(batches):
            for t in block.tokens(order):
                learned = ~block.out[t.doc]
                words_.append(t.word[learned])
                keys += [keys_of(g[ok & learned], shards) for g, _, ok in t.grams]
                size += len(words_[-1])
                if size >= flush:
                    yield sent(words_, keys)
                    words_, keys, size = [], [], 0
        if size:
            yield sent(words_, keys)

    return run


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
    total = np.zeros(len(u), np.int64)
    np.add.at(total, at, np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64))
    return u, total


def _shard(sent: pd.DataFrame) -> pd.DataFrame:
    """A shard of the model from the counts that tasks have sent."""
    h, c = _summed([_numbers(x) for x in sent["words"]], [_numbers(x) for x in sent["counts"]])
    names, times = _summed([_ungapped(x) for x in sent["names"]], [_numbers(x) for x in sent["times"]])
    size, bits = built(names, times)
    return pd.DataFrame([{"shard": sent["shard"].iloc[0], "size": size, "bits": bits, "words": _planes(h), "counts": _planes(c), "tokens": int(c.sum()), "types": len(h), "ngrams": len(names)}])


def train(blocks: DataFrame, order: int = ORDER) -> DataFrame:
    """The model of the blocks' training documents, staged: shard, size, bits (the filter), words, counts (exact), tokens,
    types, ngrams."""
    sent = blocks.select(*blocks.columns).mapInArrow(_counted(order, shards_for(blocks), FLUSH), "shard long, words binary, counts binary, names binary, times binary")
    built_ = sent.groupBy("shard").applyInPandas(_shard, "shard long, size long, bits binary, words binary, counts binary, tokens long, types long, ngrams long")
    return common.stage(built_, "ngram-filter")


def _scores(block: Block, parts: list[Tokens], counts: list, past: list, levels: list, total: int, types: int, mu: float) -> pd.DataFrame:
    """Sums over each text of a block, from the counts of words and of those before them, and for each order the levels of
    n-grams and (from the third) of their histories, a list a window."""
    n = len(block.rows)
    out = {c: np.zeros(n) for c in ("n_tokens", "n_known", "base_score", "score")}
    for at, t in enumerate(parts):
        c = counts[at]
        p = (c + 1.0) / (total + types + 1.0)
        sums = {"n_tokens": np.ones(len(c)), "n_known": (c > 0).astype(float), "base_score": np.log10(p)}
        for k, (_, _, ok) in enumerate(t.grams):
            seen, before = levels[at][k]
            before = past[at].astype(float) if k == 0 else COUNTS[before]
            p = np.where(ok, (np.minimum(COUNTS[seen], before) + mu * p) / (before + mu), p)
        for name, x in (sums | {"score": np.log10(p)}).items():
            out[name] += np.bincount(t.doc, x, n)
    frame = pd.DataFrame({"row": block.rows, "doc_id": block.ids, "known": block.known, "held_out": block.out, **out})
    return frame.astype({"n_tokens": "int64", "n_known": "int64"})


_PARTIAL = "row long, doc_id long, known boolean, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _broadcast(blocks: DataFrame, rows: list, shards: int, options: tuple) -> DataFrame:
    sent = blocks.sparkSession.sparkContext.broadcast([r.asDict() for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Filter(sent.value)
        at = np.full(shards, len(rows), np.int64)
        at[[r["shard"] for r in sent.value]] = np.arange(len(rows))

        def levels(grams: np.ndarray) -> np.ndarray:
            own = at[shard_of(grams, shards).astype(np.int64)]
            out, held = np.zeros(len(grams), np.uint8), own < len(rows)
            out[held] = model.levels(own[held], grams[held] & _LOW)
            return out

        for block in Block.each(batches):
            for t in block.tokens(options[0]):  # a window at a time: the sums over a text's windows add up
                seen = [(levels(g), levels(h) if k else None) for k, (g, h, _) in enumerate(t.grams)]
                part = _scores(block, [t], [model.count(t.word)], [model.count(t.before)], [seen], *options[1:]).iloc[t.doc[0] : t.doc[-1] + 1]
                yield pa.RecordBatch.from_pandas(part, preserve_index=False)

    return blocks.mapInArrow(run, _PARTIAL)


def _asked(parts: list[Tokens], shards: int) -> tuple[np.ndarray, ...]:
    """The distinct words of a block by shard and the keys of its n-grams, and for every word and n-gram, in the order of
    the windows, its position among them."""
    words_, keys = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for t in parts:
        words_ += [t.word, t.before[:1]]
        for k, (grams, histories, _) in enumerate(t.grams):
            keys.append(keys_of(grams, shards))
            if k:
                keys.append(keys_of(histories, shards))
    h, word_at = np.unique(np.concatenate(words_), return_inverse=True)
    by = by_shard(h, shards)
    at = np.empty_like(by)
    at[by] = np.arange(len(by))
    k, key_at = np.unique(np.concatenate(keys), return_inverse=True)
    return h[by], k, at[word_at] if len(h) else word_at, key_at


def _exchanged(blocks: DataFrame, model: DataFrame, shards: int, options: tuple) -> DataFrame:
    order = options[0]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in Block.each(batches):
            h, k, _, _ = _asked(list(block.tokens(order)), shards)
            out = [(s, block.row, _planes(h[w]), _gaps(k[g] & _LOW)) for s, w, g in dealt(h, k, shards)]
            if out:
                yield _arrow(out, ["shard", "block", "words", "names"])

    def answer(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        model, out = Filter(shard.to_dict("records")), []
        # many blocks' n-grams are probed at once: a block asks a shard for few, the fewer the more shards there are
        sums = asked["names"].map(len).cumsum() // (4 * ASKED)
        for _, some in asked.groupby(sums, sort=True):
            names, words_ = [_ungapped(x) for x in some["names"]], [_numbers(x) for x in some["words"]]
            distinct, at = np.unique(np.concatenate(names), return_inverse=True)
            levels = model.levels(np.zeros(len(distinct), np.int64), distinct) if len(shard) else np.zeros(len(distinct), np.uint8)
            levels = np.split(levels[at], np.cumsum([len(x) for x in names])[:-1])
            counts = np.split(model.count(np.concatenate(words_)), np.cumsum([len(x) for x in words_])[:-1])
            out += [(b, s, _planes(c), x.tobytes()) for b, s, c, x in zip(some["block"], some["shard"], counts, levels, strict=True)]
        return pd.DataFrame(out, columns=["block", "shard", "counts", "levels"])

    def scored(one: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        block, replies = Block(one.to_dict("records")[0]), replies.sort_values("shard")
        parts = list(block.tokens(order))
        _, _, word_at, key_at = _asked(parts, shards)
        count = np.concatenate([np.zeros(0, np.uint64), *map(_numbers, replies["counts"])]).astype(np.int64)[word_at]
        level = np.frombuffer(b"".join(replies["levels"]), np.uint8)[key_at]
        counts, past, levels, w, g = [], [], [], 0, 0
        for t in parts:
            n = len(t.word)
            counts.append(count[w : w + n])
            past.append(np.concatenate([count[w + n : w + n + 1], count[w : w + n - 1]]))
            w += n + 1
            seen = []
            for k in range(len(t.grams)):
                seen.append((level[g : g + n], level[g + n : g + 2 * n] if k else None))
                g += 2 * n if k else n
            levels.append(seen)
        return _scores(block, parts, counts, past, levels, *options[1:])

    asked = blocks.mapInArrow(ask, "shard long, block long, words binary, names binary")
    replies = asked.groupBy("shard").cogroup(model.select("shard", "size", "bits", "words", "counts").groupBy("shard")).applyInPandas(answer, "block long, shard long, counts binary, levels binary")
    # a task has as many blocks as it happens to, but only one of them at once outside Spark's own memory
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(scored, _PARTIAL)


def score(blocks: DataFrame, model: DataFrame, shards: int, order: int = ORDER, mu: float = MU, broadcast: int = BROADCAST) -> DataFrame:
    """One row for each text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. shards: as in training."""
    sizes = model.agg(F.sum("tokens"), F.sum("types"), F.sum(F.length("bits") + F.length("words") + F.length("counts"))).first()
    total, types, size = (x or 0 for x in sizes)
    options = (order, total, types, mu)
    if size <= broadcast:
        rows = model.select("shard", "size", "bits", "words", "counts").collect()  # `broadcast` bytes at most
        parts = _broadcast(blocks, rows, shards, options)
    else:
        parts = _exchanged(blocks, model, shards, options)
    sums = parts.groupBy("row").agg(F.max(F.when(F.col("known"), F.col("doc_id"))).alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def scores(docs: DataFrame, out: Column, order: int = ORDER, mu: float = MU, broadcast: int = BROADCAST) -> DataFrame:
    """Scores of all docs by a model of those that are not `out`."""
    blocks = pack(docs, out, order)
    return score(blocks, train(blocks, order), shards_for(blocks), order, mu, broadcast)


def op12_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(common.table(spark, sf_dir, "documents"), labelled.held_out(7, 2))
