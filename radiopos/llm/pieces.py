"""SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation of a text maximises the sum of its pieces' scores. A text goes through the search in parts; the
search keeps a window bounded by the longest piece. Whenever all surviving backpointer paths meet in one boundary, the
ids up to it are final and leave the window, so memory does not grow with the text (but for the ids of a row
themselves). Paths meet wherever no path reaches beyond the next position; otherwise they are followed back every LOOK
positions. Only where they never meet, as in a long run of one character, does the window wait for the end of the periodic run.

A model trained for merges (BPE) has ranks for scores, and its own encoding is not the segmentation of the best sum. For
such a model the search also has forbidden pairs: two pieces stand side by side only if no merge across their border
comes before the merges inside them. Exactly one path to every position is then left, and the ids are those of the merges
(tests/llm compares them with the library that made the model). A model of likelihoods (unigram) has no forbidden pairs.

What paths do between two boundaries in which all of them meet depends on nothing else. So the commits of short stretches, from
such a boundary up to a space that follows another character, are remembered in a bounded cache of each task's process: the
search runs on a stretch when it is first seen, and again only when the cache has lost it. Whether all paths meet before
the space is found by the search itself: no piece of the vocabulary that begins before it goes on past it. Where one does, and in
stretches longer than the cache takes, the window stays open until paths meet.

Text is escaped as the model says: a space in front, nothing collapsed. Characters outside the vocabulary, the
escape sign U+2581 itself among them, become byte pieces, so decoding gives back every text exactly.

The vocabulary is read once on the driver and goes to the tasks with the code; it is as large as the model file
(about 32,000 pieces), whatever the tables hold.

Cases: null and empty texts have no ids and decode to the empty text; repeated rows are encoded each; an empty
table gives no rows. Ids outside the vocabulary and control pieces decode to nothing. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Positions between two walks back to a common boundary; characters of a text handed to the search at once.
LOOK, PART = 32, 65_536
#: Entries of the caches of stretches and of pairs, the longest stretch kept, and characters of a window asked for at once.
_CACHE, _CACHED, _PAIRS, _BITE = 400_000, 48, 400_000, 512
_WORD = re.compile(r" +[^ ]*|[^ ]+")
_BORDER = re.compile(r"[^ ] ")
_NEVER = float("inf")
_NONE = float("-inf")

#: Codecs of this process by content: tasks that follow each other in a worker share stretches already found.
_LIVE: dict = {}


def _revived(key: int, *state) -> Codec:
    if key not in _LIVE:
        _LIVE.clear()
        _LIVE[key] = Codec(*state)
    return _LIVE[key]


class _Kept(dict):
    """Values found on first use. Two generations of `size` entries each bound it: when the young one is full it becomes
    the old one, and entries still in use come back from there."""

    def __init__(self, find, size: int):
        super().__init__()
        self.find, self.size, self.old = find, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.find(key)
        if isinstance(key, int) or len(key) <= _CACHED:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def splits_of(ranks: dict[str, float]) -> dict[str, tuple[str, str]]:
    """The two pieces whose merge makes each piece that merges make at all; ranks: piece -> rank, least first."""
    out = {}
    for piece in ranks:
        parts = list(piece)
        last = None
        while len(parts) > 1:
            best = min((ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == _NEVER:
                break
            i = best[1]
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 1 and last:
            out[piece] = last
    return out


class Codec:
    """vocabulary: piece -> (id, score), spaces unescaped; bytes_of: id of each byte value; splits: how merges make
    pieces, or None for a model of likelihoods."""

    def __init__(self, vocabulary: dict[str, tuple[int, float]], bytes_of: list[int], size: int, splits: dict[str, tuple[str, str]] | None = None):
        self.vocabulary, self.bytes_of, self.size, self.splits = vocabulary, bytes_of, size, splits
        self.longest = max(map(len, vocabulary), default=1)
        self.piece: list[str | None] = [None] * size
        self.table = [b""] * size
        # nodes by character: [next nodes, id or -1, score]
        self.trie: dict = {}
        for piece, (i, score) in vocabulary.items():
            self.piece[i] = piece
            self.table[i] = piece.encode()
            level, node = self.trie, None
            for c in piece:
                node = level.setdefault(c, [{}, -1, 0.0])
                level = node[0]
            if splits is None or len(piece) == 1 or piece in splits:
                node[1:] = i, score  # no encoding has a piece that no merges make
        self.singles = frozenset(p for p in vocabulary if len(p) == 1)
        for value, i in enumerate(bytes_of):
            self.table[i] = bytes([value])
        self.unknown = min((s for _, s in vocabulary.values()), default=0.0) - 10.0
        self.stretches = _Kept(self._stretch, _CACHE)
        self.pairs = _Kept(lambda pair: self._beside(*divmod(pair, size)), _PAIRS)
        self.spines: tuple[dict, dict] = {}, {}

    def __reduce__(self):
        return _revived, (hash((self.size, tuple(self.bytes_of), tuple(self.table), self.splits is None)), self.vocabulary, self.bytes_of, self.size, self.splits)

    @classmethod
    def load(cls, path: str = MODEL) -> Codec:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        plain = [i for i in range(len(pieces)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        vocabulary = {pieces[i].replace("▁", " "): (i, model.get_score(i)) for i in plain}
        found = {int(pieces[i][3:5], 16): i for i in range(len(pieces)) if model.is_byte(i)}
        ranked = all(s <= 0 and s == int(s) for _, s in vocabulary.values())
        splits = splits_of({p: -s for p, (_, s) in vocabulary.items()}) if ranked else None
        return cls(vocabulary, [found[v] for v in range(256)], len(pieces), splits)

    def _spine(self, i: int, side: int) -> list[tuple[str, float]]:
        """From the first (side 0) or last (side 1) character of a piece up to the piece: each one's text and its rank."""
        if i not in self.spines[side]:
            piece, out = self.piece[i], []
            while True:
                out.append((piece, -self.vocabulary[piece][1] if piece in self.vocabulary else _NEVER))
                if piece not in self.splits:
                    break
                piece = self.splits[piece][side]
            self.spines[side][i] = out[::-1]
        return self.spines[side][i]

    def _beside(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay side by side: no merge across their border comes before those inside them. Of
        equal merges the left one comes first."""
        left, right = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while True:
            up = left[i + 1][1] if i + 1 < len(left) else _NEVER
            down = right[j + 1][1] if j + 1 < len(right) else _NEVER
            across = self.vocabulary.get(left[i][0] + right[j][0])
            if across is not None and -across[1] < up and -across[1] <= down:
                return False
            if up == down == _NEVER:
                return True
            if up <= down:
                i += 1
            else:
                j += 1

    def _stretch(self, text: str) -> bytes | None:
        """What the search commits from a boundary where all paths meet up to the space after `text`; None where they
        don't surely meet there, or the text is too long to be remembered."""
        if len(text) > _CACHED:
            return None
        search = Search(self)
        search.text = text + " "
        out = b"".join(search._advance(len(text)))
        return out + search._ids(search.at) if search.closed() else None

    def stream(self, parts: Iterable[str]) -> Iterator[bytes]:
        """Ids (int32) of a text that comes in parts, each as soon as it is final."""
        search, began = Search(self), False
        for part in parts:
            if part:
                yield from search.feed(part if began else " " + part)
                began = True
        yield from search.end()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.stream(text[a : a + PART] for a in range(0, len(text), PART))), np.int32)

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        inside = ids[(ids >= 0) & (ids < self.size)].tolist()
        return b"".join(map(self.table.__getitem__, inside)).removeprefix(b" ").decode("utf-8", "replace")


class Search:
    """The window of one search: `text` from the last committed boundary on, and for each position in it the best path's
    score, its last boundary and its last piece (-1: a character outside the vocabulary; -2: what came before has no say).
    Paths begin at all positions before `at` and end by `reach`; no piece tried there goes beyond `far`. commits counts what has left."""

    def __init__(self, codec: Codec):
        self.codec, self.commits, self.text = codec, 0, ""
        self.at = self.reach = self.far = self.since = 0
        self.best, self.back, self.last = [0.0], [0], [-2]

    def all(self, text: str) -> array:
        out = array("i")
        for ids in (*self.feed(text), *self.end()):
            out.frombytes(ids)
        return out

    def feed(self, part: str) -> Iterator[bytes]:
        self.text += part
        yield from self._run(False)

    def end(self) -> Iterator[bytes]:
        yield from self._run(True)

    def closed(self) -> bool:
        """Whether all paths meet in the position `at`, and no piece goes past it, whatever follows."""
        return self.far <= self.at

    def _run(self, final: bool) -> Iterator[bytes]:
        while self.text:
            if self.at == self.reach == 0 and self.last[0] == -2:
                yield from self._remembered(final)
                if not (final or len(self.text) > _CACHED or _BORDER.search(self.text)):
                    return
            limit = min(len(self.text) if final else len(self.text) - self.codec.longest, self.at + _BITE)
            border = _BORDER.search(self.text, self.at, limit + 1)
            upto = min(limit, border.start() + 1) if border else limit
            if upto > self.at:
                yield from self._advance(upto)
            elif not final:
                return
            if self.at == len(self.text):
                if self.at:
                    yield self._commit(self.at)
            elif self.closed() and self.text[self.at] == " " and self.at and self.text[self.at - 1] != " ":
                yield self._commit(self.at)
                self.last[0], self.since = -2, 0

    def _remembered(self, final: bool) -> Iterator[bytes]:
        """From a boundary where all paths meet: the commits of stretches that are remembered, up to one that isn't."""
        while self.text:
            end = len(text := self.text[:_BITE])
            if not final or end < len(self.text):
                # the last place before a space that follows another character
                while (end := text.rfind(" ", 0, end)) > 0 and text[end - 1] == " ":
                    pass
            words = _WORD.findall(text, 0, max(end, 0))
            found = [self.codec.stretches[w] for w in words]
            most = found.index(None) if None in found else len(found)
            if not most:
                return
            self.text = self.text[sum(map(len, words[:most])) :]
            self.commits += most
            yield b"".join(found[:most])
            if most < len(found):
                return

    def _advance(self, upto: int) -> Iterator[bytes]:
        """Extends the paths from every position before `upto`."""
        codec, text, best, back, last, at, reach, far = self.codec, self.text, self.best, self.back, self.last, self.at, self.reach, self.far
        longest, trie, singles, size, pairs, free = codec.longest, codec.trie, codec.singles, codec.size, codec.pairs, codec.splits is None
        more = min(upto + longest, len(text)) + 1 - len(best)
        best += [_NONE] * more
        back += [0] * more
        last += [-2] * more
        look = at + LOOK - self.since
        while at < upto:
            here, prior = best[at], last[at] * size
            if here > _NONE:
                level, end = trie, at
                for c in text[at : at + longest]:
                    node = level.get(c)
                    if node is None:
                        break
                    end += 1
                    level, i, score = node
                    # merges leave one path to a position
                    if i >= 0 and (here + score > best[end] if free else best[end] == _NONE and (prior < 0 or pairs[prior + i])):
                        best[end], back[end], last[end] = here + score, at, i
                        if end > reach:
                            reach = end
                if end > far:
                    far = end
                if text[at] not in singles and here + codec.unknown > best[at + 1]:
                    best[at + 1], back[at + 1], last[at + 1] = here + codec.unknown, at, -1
                    reach = max(reach, at + 1)
            at += 1
            if at == look:
                look += LOOK
                # where no path goes beyond this position, all meet in it
                met = at if reach == at else self._meeting(at, reach)
                if met and at < len(text):
                    self.at, self.reach, self.far = at, reach, far
                    yield self._commit(met)
                    text, at, reach, far = self.text, self.at, self.reach, self.far
                    upto, look = upto - met, look - met
        self.at, self.reach, self.far, self.since = at, reach, far, LOOK - look + at

    def _meeting(self, at: int, reach: int) -> int:
        """The boundary in which the paths to all positions from `at` on meet; 0 if there is none."""
        front = {p for p in range(at, reach + 1) if self.best[p] > _NONE}
        while len(front) > 1:
            late = max(front)
            front.remove(late)
            front.add(self.back[late])
        return front.pop() if front else 0

    def _ids(self, end: int) -> bytes:
        """The ids up to position `end`."""
        out, at, back, last = [], end, self.back, self.last
        while at:
            start, i = back[at], last[at]
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.codec.bytes_of[b] for b in reversed(self.text[start:at].encode("utf-8", "replace")))
            at = start
        return array("i", reversed(out)).tobytes()

    def _commit(self, end: int) -> bytes:
        """The ids up to position `end`, which leave the window."""
        out = self._ids(end)
        self.commits += 1
        self.text = self.text[end:]
        self.at, self.reach, self.far = (max(x - end, 0) for x in (self.at, self.reach, self.far))
        ground = self.best[end]
        del self.best[:end], self.back[:end], self.last[:end]
        self.best[:] = [b - ground for b in self.best]
        self.back[:] = [max(b - end, 0) for b in self.back]
        return out


def _list(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))


def encode(docs: DataFrame, codec: Codec, check: bool = False) -> DataFrame:
    """doc_id, ids of every row; with check also exact: whether the ids decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.small(batches):
            texts = b.column(1).to_pylist()
            parts = [codec.encode(t) for t in texts]
            columns = {"doc_id": b.column(0), "ids": _list(parts)}
            if check:
                columns["exact"] = pa.array([codec.decode(p) == t for p, t in zip(parts, texts, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", common.text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", exact boolean" * check)


def decode(rows: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, text of rows with doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [codec.decode([i for i in ids or () if i is not None]) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "text": pa.array(texts, pa.string())})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(common.table(spark, sf_dir, "documents").select("doc_id", "text"), Codec.load(), check=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")
