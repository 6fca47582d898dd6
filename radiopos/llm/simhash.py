"""SimHash near-dedup with bit-sliced comparison.

A fingerprint has the majority bit of the XXH64 hashes (seed 42) of a text's word shingles. Two fingerprints
link when at most `radius` of their 64 bits differ; documents linked directly or through others form a component.

Equal fingerprints collapse first, so copies never meet as pairs. The 64 bits are cut into blocks such that any two
linked fingerprints agree on `match` whole blocks (pigeonhole); every choice of `match` blocks is a table of
buckets. Within a bucket, bit planes are stored vertically, 64 fingerprints a word; distances to 64 fingerprints
grow at once in carry-save counters, plane by plane, and words whose 64 distances all exceed the radius are
abandoned. A bucket emits a spanning forest of its links, never all pairs. Buckets of more than CHUNK
fingerprints are cut into chunks that are compared in separate tasks, and what is in one component already need not
meet, so a large group of near copies costs no squares.

`similar` and `keep` look for texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more. Their
fingerprints differ in more bits than blocks can bear, so they are 256 bits wide and min-hash bands make the buckets.
The fingerprints only leave out pairs that are far apart; a link is made by the Jaccard similarity itself.

Cases: a null text equals the empty text; a text without words has fingerprint 0 and links like any other; a
text of fewer words than a shingle is one shingle; repeated rows share a component; component_id ignores null
doc_ids (null if a component has no other); an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, components, labelled

SHINGLE = 3
RADIUS = 3
CHUNK = 1024
#: For `similar`: words a shingle, bits of the fingerprint and how many may differ, min-hash bands and rows.
SIMILAR_SHINGLE, WIDE, SIMILAR_RADIUS, BANDS, ROWS = 5, 256, 100, 16, 4
_SEEDS = np.random.default_rng(20).integers(1, 2**63, 2 * BANDS * ROWS, dtype=np.uint64)
_ODD, _ADD = _SEEDS[: BANDS * ROWS] | np.uint64(1), _SEEDS[BANDS * ROWS :]
_FULL = np.uint64(2**64 - 1)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer. A-Z is lower-cased; words end at ASCII white space."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = h[at : at + 65536]
        votes += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": [fingerprint(t, shingle) for t in b["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", common.text_of().alias("text")).mapInPandas(run, f"doc_id {kind}, fp long")


def near_pairs(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of all fingerprints (rows of bytes) that differ in at most `radius` bits."""
    n, width = len(prints), prints.shape[1] * 8
    bits = np.unpackbits(prints, axis=1, bitorder="little")
    padded = np.zeros((width, -(-n // 64) * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    own = bits.astype(np.uint64) * _FULL
    q, w = np.nonzero(np.arange(planes.shape[1])[None, :] >= (np.arange(n) // 64)[:, None])
    counters = [np.zeros(len(q), np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(len(q), np.uint64)
    for b in range(width):
        carry = planes[b, w] ^ own[q, b]
        for c in counters:
            spill = c & carry
            c ^= carry
            carry = spill
        over |= carry
        if b >= 15 and b % 8 == 7:
            live = _beyond(counters, over, radius) != _FULL
            q, w, over, counters = q[live], w[live], over[live], [c[live] for c in counters]
    spread = np.unpackbits(_beyond(counters, over, radius).view(np.uint8), bitorder="little").reshape(-1, 64)
    row, bit = np.nonzero(spread == 0)
    i, j = q[row], w[row] * 64 + bit
    keep = (j > i) & (j < n)
    return i[keep], j[keep]


def _beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Bits of the distances above the radius, by comparing the sliced counters with it from the top bit down."""
    above, equal = over, ~over
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above, equal = above | (equal & counters[k]), equal & ~counters[k]
    return above


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least position each of n positions reaches over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def alike(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs those of a Jaccard similarity of 0.8 or more, without pairs that others of them, or a group
    (numbers from 0) that holds both, join already."""
    root = np.unique(group, return_index=True)[1][group].tolist()

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    linked = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = top(a), top(b)
        small, large = sorted((len(sets[a]), len(sets[b])))
        if x != y and 5 * small >= 4 * large:
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 5 * both >= 4 * (small + large - both):
                root[max(x, y)] = min(x, y)
                linked.append((a, b))
    pairs = np.array(linked, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _links(radius: int):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(group["node"].to_numpy(np.int64), return_index=True)
        if "fp" in group:
            prints = np.frombuffer(b"".join(group["fp"].iloc[at]), np.uint8).reshape(len(nodes), -1)
        else:
            prints = nodes.view(np.uint8).reshape(-1, 8)
        i, j = near_pairs(prints, radius)
        if "set" in group:
            _, known = np.unique(group["root"].to_numpy(np.int64)[at], return_inverse=True)
            i, j = alike([np.frombuffer(x, np.uint64) for x in group["set"].iloc[at]], i, j, known)
        root = forest(len(nodes), i, j)
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[moved], "b": nodes[root[moved]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket; whole buckets are compared, small ones several at a time."""
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            key = rest[["t", "key", "ci", "cj"]].to_numpy()
            ends = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            at = 0
            for k, end in enumerate(ends):
                if end - at >= CHUNK // 4 or k == len(ends) - 1:
                    yield compare(rest.iloc[at:end])
                    at = end
            rest = rest.iloc[at:]
        if rest is not None and len(rest):
            yield compare(rest)

    return run


def tables(radius: int, expected: int) -> list[int]:
    """Bit masks of the bucket tables: the fewest blocks for which a bucket of random bits holds CHUNK rows or less."""
    for match in range(1, 5):
        blocks = radius + match
        edges = [64 * k // blocks for k in range(blocks + 1)]
        masks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
        if match == 4 or expected >> (64 // blocks * match) <= CHUNK:
            return [sum(m) for m in combinations(masks, match)]
    raise AssertionError


def link_edges(keyed: DataFrame, radius: int, prints: DataFrame | None = None) -> DataFrame:
    """keyed: t, key, node; only nodes of one bucket (t, key) are compared. prints: node, fp (binary) and set (hashes
    of the shingles), which decides; without it the node is the fingerprint. Edges (a, b) whose components are those of
    all links.

    Buckets of more than CHUNK nodes are dealt into chunks in two ways, and first only nodes of one chunk are compared:
    a group of near copies becomes one component at that. Then the components tell what is left to compare. In such a
    bucket the nodes of its largest component need not meet each other, and a bucket of one component is done.
    """
    mark = lambda salt: F.bit_xor(F.xxhash64("node", F.lit(salt)))
    full = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), mark(0).alias("x"), mark(1).alias("y")).filter("n > 1")
    # near copies share many buckets: of buckets with the same nodes one is enough
    full = full.groupBy("n", "least", "x", "y").agg(F.min(F.struct("t", "key")).alias("bucket"))
    full = full.select("bucket.t", "bucket.key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    rows = common.stage(keyed.join(full, ["t", "key"]), "buckets")
    chunk = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    one = rows.select("t", "key", "node", F.col("node").alias("root"), chunk(0, F.col("chunks")).alias("ci"), F.lit(0).alias("cj"))
    two = rows.filter("chunks > 1").select("t", "key", "node", F.col("node").alias("root"), chunk(1, F.col("chunks")).alias("ci"), F.lit(1).alias("cj"))
    edges = _compared(one.union(two), radius, prints)
    many = rows.filter("chunks > 1")
    if not many.head(1):
        return edges
    roots = components.components(edges)
    rooted = many.join(roots, "node", "left").select("t", "key", "node", F.coalesce("root", "node").alias("root"))
    each = rooted.groupBy("t", "key", "root").agg(F.count(F.lit(1)).alias("n"))
    left = each.groupBy("t", "key").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.max("n").alias("big"), F.sum("n").alias("all")).filter("all > big")
    left = left.select("t", "key", "most", F.ceil(F.col("big") / CHUNK).cast("int").alias("bigs"), F.ceil((F.col("all") - F.col("big")) / CHUNK).cast("int").alias("smalls"))
    rest = rooted.join(left, ["t", "key"])
    steps = lambda n: F.sequence(F.lit(0), n - 1)
    # chunks of small components meet each other and the chunks of the largest, which are numbered after them
    small = rest.filter("root != most").withColumn("c", chunk(2, F.col("smalls"))).withColumn("o", F.explode(steps(F.col("smalls") + F.col("bigs"))))
    large = rest.filter("root = most").withColumn("c", F.col("smalls") + chunk(2, F.col("bigs"))).withColumn("o", F.explode(steps(F.col("smalls"))))
    met = small.unionByName(large).select("t", "key", "node", "root", F.least("c", "o").alias("ci"), F.greatest("c", "o").alias("cj"))
    return common.stage(edges.union(_compared(met, radius, prints)), "links")


def _compared(rows: DataFrame, radius: int, prints: DataFrame | None) -> DataFrame:
    """rows: t, key, ci, cj, node, root. Nodes of equal (t, key, ci, cj) are compared; edges of those of two roots."""
    if prints is not None:
        rows = rows.join(prints, "node")
    rows = common.stage(rows, "chunks")
    # rows with sets of shingles are some kilobytes each
    dealt = rows.repartition(rows.count() // (50_000 if prints is None else 4_000) + 1, "t", "key", "ci", "cj").sortWithinPartitions("t", "key", "ci", "cj")
    return common.stage(dealt.mapInPandas(_links(radius), "a long, b long"), "links")


def block_keys(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct: node, the fingerprint. Its buckets: bits of `match` whole blocks, for every choice of them."""
    signed = lambda m: m - 2**64 if m >= 2**63 else m
    masks = tables(radius, distinct.count())
    keys = [F.struct(F.lit(t).alias("t"), F.col("node").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)]
    return distinct.select("node", F.inline(F.array(*keys)))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    rows = common.stage(fingerprints(docs, shingle), "fingerprints")
    distinct = common.stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    edges = link_edges(block_keys(distinct.select(F.col("fp").alias("node")), radius), radius)
    linked = components.components(edges).withColumnRenamed("node", "fp")
    rooted = distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(least, "root").select("fp", "component_id"), "fp")


def shingles(text: str, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The sorted hashes of the set of shingles."""
    words = text.encode("utf-8", "replace").lower().split()
    runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return np.array(sorted({xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs}), np.uint64)


def wide(text: str, shingle: int = SIMILAR_SHINGLE) -> tuple[bytes, list[int]]:
    """A 256-bit fingerprint of the set of shingles, and the keys of its min-hash bands."""
    h = shingles(text, shingle)
    votes, least = np.zeros(WIDE, np.int64), np.full(BANDS * ROWS, _FULL)
    for at in range(0, len(h), 16384):
        part = h[at : at + 16384]
        planes = np.stack([_mixed(part, k) for k in range(WIDE // 64)], axis=1)
        votes += np.unpackbits(planes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        for k in range(BANDS * ROWS):
            least[k] = min(least[k], (part * _ODD[k] + _ADD[k]).min())
    keys = [xxhash.xxh64_intdigest(band.tobytes(), 0) for band in least.reshape(BANDS, ROWS)]
    return np.packbits(2 * votes > len(h), bitorder="little").tobytes(), [k - 2**64 if k >= 2**63 else k for k in keys]


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = h ^ _ADD[salt]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def similar(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, radius: int = SIMILAR_RADIUS) -> DataFrame:
    """(node, root) for the doc_ids in groups of documents whose shingle sets have a Jaccard similarity of 0.8 or
    more. Candidates share one of BANDS min-hash bands of ROWS values; at 0.8 all but 2 in 10,000 pairs do. Of 256
    bits they differ in at most `radius`: at 0.8 39 differ on average (standard deviation 5.7), 48 where a text has
    five shingles. Every candidate is then decided by its sets."""

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "keys": [wide(t, shingle)[1] for t in b["text"]]})

    def printed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "fp": [wide(t, shingle)[0] for t in b["text"]], "set": [shingles(t, shingle).tobytes() for t in b["text"]]})

    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("node"), common.text_of().alias("text"))
    bands = common.stage(texts.mapInPandas(banded, "node long, keys array<long>"), "bands")
    keyed = bands.select("node", F.posexplode("keys").alias("t", "key"))
    met = keyed.join(keyed.groupBy("t", "key").count().filter("count > 1").drop("count"), ["t", "key"]).select("node").distinct()
    prints = common.stage(texts.join(met, "node").mapInPandas(printed, "node long, fp binary, set binary"), "wide-fingerprints")
    return components.components(link_edges(keyed, radius, prints))


def keep(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, radius: int = SIMILAR_RADIUS) -> DataFrame:
    """One document of each group of similar ones, that of the smallest doc_id, with the columns of docs. Rows
    without doc_id stay."""
    goes = similar(docs, shingle, radius).filter("node != root").select(F.col("node").alias("_goes"))
    return docs.join(goes, docs["doc_id"].cast("long") == goes["_goes"], "left_anti")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
