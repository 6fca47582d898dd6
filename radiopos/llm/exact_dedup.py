"""Exact dedup of an incoming batch against an immutable snapshot, screened by static binary-fuse filters.

The snapshot keeps one narrow row per digest and one filter per bucket of digests; both are written once and
never change. Digests of a new batch are grouped among themselves first, then each bucket's filter screens
them; only positives meet the snapshot's exact bucket. Every digest left with more than one row has its texts
compared byte by byte: rows are grouped by the text itself, so texts that merely share a digest stay apart.

Texts shuffle once to meet the digests that have more than one row; only the texts of these shuffle again, as partial
groups: a text with a million copies leaves each task as one row.

Cases: a null text equals the empty text. Rows with equal text form one group; the largest doc_id stays.
A row without doc_id never wins over one with it. Repeated rows count in group_size and are all marked as the
document they repeat; `keep` leaves one of them. An empty table gives an empty result. Other columns stay as they are,
but those named like one that `decide` adds are replaced by it.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Digests per filter; the number of buckets follows the number of rows.
BUCKET = 1024
SALTS = 16
_FILTER = "bucket long, seed long, segment int, reach int, cells binary"


class Snapshot(NamedTuple):
    index: DataFrame  # bucket, digest, keep_id, n
    filters: DataFrame  # bucket, seed, segment, reach, cells
    buckets: int


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _cells_of(h: np.ndarray, segment: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The three cells of each hash, in three consecutive segments, and its 8-bit fingerprint."""
    mask = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(reach)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third], axis=1).astype(np.int64), ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment, reach, cells) of a 3-wise binary-fuse filter over distinct 64-bit keys."""
    n = len(keys)
    segment = 1 << int(math.log(max(n, 2)) / math.log(3.33) + 2.25)
    slack = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    reach = max(1, math.ceil(n * slack / segment)) * segment
    for seed in range(1, 1000):
        cells, prints = _cells_of(_mixed(keys, seed * 0x9E3779B97F4A7C15 % 2**64), segment, reach)
        size = reach + 2 * segment
        degree = np.bincount(cells.ravel(), minlength=size)
        holds = np.zeros(size, np.int64)
        for j in range(3):
            np.bitwise_xor.at(holds, cells[:, j], np.arange(n))
        alone, order, rows = list(np.flatnonzero(degree == 1)), [], cells.tolist()
        while alone:
            cell = alone.pop()
            if degree[cell] != 1:
                continue
            key = int(holds[cell])
            order.append((key, cell))
            for other in rows[key]:
                degree[other] -= 1
                holds[other] ^= key
                if degree[other] == 1:
                    alone.append(other)
        if len(order) == n:
            table = np.zeros(size, np.uint8)
            for key, cell in reversed(order):
                a, b, c = rows[key]
                table[cell] = prints[key] ^ table[a] ^ table[b] ^ table[c] ^ table[cell]
            return seed, segment, reach, table.tobytes()
    raise ValueError("no seed peels these keys; they are not distinct")


def maybe_in(keys: np.ndarray, seed: int, segment: int, reach: int, cells: bytes) -> np.ndarray:
    """Whether each key may be in the filter: true for every member, and for about one other in 256."""
    where, prints = _cells_of(_mixed(keys, seed * 0x9E3779B97F4A7C15 % 2**64), segment, reach)
    table = np.frombuffer(cells, np.uint8)
    return (table[where[:, 0]] ^ table[where[:, 1]] ^ table[where[:, 2]]) == prints


def _keys(digests: pd.Series) -> np.ndarray:
    return np.array([int.from_bytes(x[:8].ljust(8, b"\0"), "little") for x in digests], np.uint64)


def _filter_of(group: pd.DataFrame) -> pd.DataFrame:
    seed, segment, reach, cells = build_filter(np.unique(_keys(group["digest"])))
    return pd.DataFrame({"bucket": [group["bucket"].iloc[0]], "seed": [seed], "segment": [segment], "reach": [reach], "cells": [cells]})


def _screen(batch: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    if not len(batch) or not len(held):
        return pd.DataFrame({"digest": []})
    f = held.iloc[0]
    hit = maybe_in(_keys(batch["digest"]), int(f["seed"]), int(f["segment"]), int(f["reach"]), f["cells"])
    return batch.loc[hit, ["digest"]]


def _digest(digest_bytes: int) -> Column:
    return F.substring(F.unhex(F.sha2(common.text_of(), 256)), 1, digest_bytes)


def _salt() -> Column:
    """Which of SALTS copies of its group's narrow row a document's row meets; a hot group is met in as many tasks."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))


def _groups(docs: DataFrame, buckets: int, digest_bytes: int) -> DataFrame:
    keyed = docs.select("doc_id", _digest(digest_bytes).alias("digest"))
    found = keyed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return found.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))


def build_snapshot(docs: DataFrame, digest_bytes: int = 32) -> Snapshot:
    """Writes the digest index of docs (doc_id, text) and its filters in the shared folder."""
    buckets = max(1, math.ceil(docs.count() / BUCKET))
    index = common.stage(_groups(docs, buckets, digest_bytes), "snapshot-index")
    filters = index.select("bucket", "digest").groupBy("bucket").applyInPandas(_filter_of, _FILTER)
    return Snapshot(index, common.stage(filters, "snapshot-filters"), buckets)


def groups(snapshot_docs: DataFrame, incoming: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """One row (digest, text_hash, keep_id, group_size) for each text that more than one row has."""
    snap = build_snapshot(snapshot_docs, digest_bytes)
    batch = common.stage(_groups(incoming, snap.buckets, digest_bytes), "incoming-groups")
    screened = (
        batch.select("bucket", "digest")
        .groupBy("bucket")
        .cogroup(snap.filters.groupBy("bucket"))
        .applyInPandas(_screen, "digest binary")
    )
    in_snapshot = screened.join(snap.index.select("digest"), "digest")
    repeated = [x.filter("n > 1").select("digest") for x in (snap.index, batch)]
    suspects = in_snapshot.union(repeated[0]).union(repeated[1]).distinct()
    both = snapshot_docs.select("doc_id", "text").union(incoming.select("doc_id", "text"))
    rows = both.select("doc_id", common.text_of().alias("text"), _digest(digest_bytes).alias("digest"), _salt().alias("salt"))
    return (
        rows.join(suspects.withColumn("salt", _salts()), ["digest", "salt"], "left_semi")
        .groupBy("digest", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select("digest", F.xxhash64("text").alias("text_hash"), "keep_id", "group_size")
    )


def halves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits one table into a snapshot and an incoming batch, by a hash of doc_id; together they are all rows."""
    side = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return docs.filter(side), docs.filter(~side)


def decide(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256; every row stays."""
    names = ("keep_id", "group_size", "kept", "text_sha256", "_digest", "_hash", "_salt")
    found = groups(*halves(docs), digest_bytes).withColumnsRenamed({"digest": "_digest", "text_hash": "_hash"})
    rows = docs.drop(*names).select("*", F.sha2(common.text_of(), 256).alias("text_sha256"), F.xxhash64(common.text_of()).alias("_hash"))
    rows = rows.withColumns({"_digest": F.substring(F.unhex("text_sha256"), 1, digest_bytes), "_salt": _salt()})
    return (
        rows.join(found.withColumn("_salt", _salts()), ["_digest", "_hash", "_salt"], "left")
        .withColumn("keep_id", F.coalesce("keep_id", "doc_id"))
        .withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
        .withColumn("kept", F.col("keep_id").eqNullSafe(F.col("doc_id")))
        .drop("_digest", "_hash", "_salt")
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of docs. Repeats of a doc_id are looked for, and only then dropped."""
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    left = decide(whole).filter("kept").select("doc_id", "text", "row")
    again = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    return (left.dropDuplicates(["doc_id", "text"]) if again else left).select("row.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return decide(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
