"""Exact dedup against a history, by a minimal perfect hash over its distinct digests.

The history's distinct digests are dealt into shards of bounded size. Each shard gets a minimal
perfect hash (levels of bit arrays: a key sits in the first level where its position is its own)
whose slots hold the full digest, the locator of the winning row and the number of rows. New
digests, already grouped, look their slot up; only an equal digest byte for byte counts as a
repeat, everything else is a nonmember and forms groups of its own.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.shared import stored

SHARD_KEYS = 16_384
INDEX = "shard int, sizes array<bigint>, bits binary, digests binary, winners binary, counts binary"


def digests(docs: DataFrame, mark: Column) -> DataFrame:
    """(doc_id, old, digest): SHA-256 of the text in UTF-8 after lower-casing A-Z; null counts as empty."""

    def run(batches):
        for batch in batches:
            texts = pc.ascii_lower(pc.fill_null(batch.column("text"), ""))
            made = [hashlib.sha256(t.as_buffer()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("old"), pa.array(made, pa.binary())], ["doc_id", "old", "digest"]
            )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(mark, F.lit(False)).alias("old"),
    )
    return rows.mapInArrow(run, "doc_id bigint, old boolean, digest binary")


def _lanes(raw: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), "<u8").reshape(-1, 4)


def _place(lanes: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = lanes[:, level % 4] ^ seed
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + lanes[:, (level + 1) % 4]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def build(lanes: np.ndarray, gamma: float = 2.0) -> tuple[list[int], np.ndarray]:
    """Level sizes and bits of a minimal perfect hash over distinct digests."""
    sizes, bits, left = [], [], lanes
    while len(left):
        size = max(1, math.ceil(gamma * len(left)))
        at = _place(left, len(sizes), size)
        alone = np.bincount(at, minlength=size)[at] == 1
        level = np.zeros(size, bool)
        level[at[alone]] = True
        sizes.append(size)
        bits.append(level)
        left = left[~alone]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots(lanes: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of every key of the set; for others a slot that holds another key, or -1."""
    rank = np.concatenate([[0], np.cumsum(bits)])
    out, todo, base = np.full(len(lanes), -1, np.int64), np.arange(len(lanes)), 0
    for level, size in enumerate(sizes):
        at = base + _place(lanes[todo], level, size)
        hit = bits[at]
        out[todo[hit]] = rank[at[hit]]
        todo, base = todo[~hit], base + size
    return out


def _build_shard(table: pa.Table) -> pa.Table:
    lanes = _lanes(table["digest"])
    sizes, bits = build(lanes)
    at = slots(lanes, sizes, bits)
    digest, winner, count = np.empty_like(lanes), np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    digest[at] = lanes
    winner[at] = pc.fill_null(table["winner"], -(2**63)).to_numpy()
    count[at] = table["n"].to_numpy()
    return pa.table(
        {
            "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
            "sizes": pa.array([sizes], pa.list_(pa.int64())),
            "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
            "digests": pa.array([digest.tobytes()], pa.binary()),
            "winners": pa.array([winner.tobytes()], pa.binary()),
            "counts": pa.array([count.tobytes()], pa.binary()),
        }
    )


def _resolve_shard(index: pa.Table, fresh: pa.Table) -> pa.Table:
    """Every digest of the shard, old or new, with its winner and size."""
    lanes = _lanes(fresh["digest"])
    best = pc.fill_null(fresh["winner"], -(2**63)).to_numpy().copy()
    count = fresh["n"].to_numpy().copy()
    member = np.zeros(len(lanes), bool)
    rest = (np.empty((0, 4), "<u8"), np.empty(0, np.int64), np.empty(0, np.int64))
    if index.num_rows:
        sizes = index["sizes"][0].as_py()
        bits = np.unpackbits(np.frombuffer(index["bits"][0].as_py(), np.uint8), count=sum(sizes)).astype(bool)
        held = np.frombuffer(index["digests"][0].as_py(), "<u8").reshape(-1, 4)
        winners, counts = (np.frombuffer(index[c][0].as_py(), np.int64) for c in ("winners", "counts"))
        at = slots(lanes, sizes, bits)
        member = (at >= 0) & (held[at] == lanes).all(axis=1)
        best[member] = np.maximum(best[member], winners[at[member]])
        count[member] += counts[at[member]]
        unseen = np.ones(len(held), bool)
        unseen[at[member]] = False
        rest = held[unseen], winners[unseen], counts[unseen]
    raw = np.concatenate([lanes, rest[0]]).tobytes()
    keep = np.concatenate([best, rest[1]])
    return pa.table(
        {
            "digest": pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()),
            "keep_id": pa.array(keep, pa.int64(), mask=keep == -(2**63)),
            "group_size": pa.array(np.concatenate([count, rest[2]]), pa.int64()),
            "repeat": pa.array(np.concatenate([member, np.zeros(len(rest[1]), bool)])),
        }
    )


def exact_dedup(spark: SparkSession, docs: DataFrame, history: Column) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``history`` marks the rows of ``docs`` that were there before; a null mark counts as new. The row
    with the largest doc_id of equal texts stays. Null and empty texts are equal. A null doc_id never
    wins over another; where every row of a group has none, they all stay. Rows that repeat a doc_id
    share its fate. An empty table gives no rows. Columns besides doc_id and text are ignored.

    Copies are counted before the shuffle; a digest reaches a shard once however many rows have it.
    """
    rows = stored(spark, digests(docs, history), "exact-digests")
    groups = stored(
        spark, rows.groupBy("digest", "old").agg(F.max("doc_id").alias("winner"), F.count("*").alias("n")), "exact-groups"
    )
    shards = max(1, math.ceil(groups.count() / SHARD_KEYS))
    groups = groups.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))
    index = stored(spark, groups.where("old").groupBy("shard").applyInArrow(_build_shard, INDEX), "exact-index")
    fresh = groups.where("NOT old").select("shard", "digest", "winner", "n")
    answer = index.groupBy("shard").cogroup(fresh.groupBy("shard")).applyInArrow(
        _resolve_shard, "digest binary, keep_id bigint, group_size bigint, repeat boolean"
    )
    return rows.join(answer, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def earlier_half(id_col: str = "doc_id") -> Column:
    """A stand-in for an earlier run where a table has no such mark: half of the ids, by hash."""
    return F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(2)) == 0


def drop_exact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents without the repeats, all columns as they were.

    A row without a doc_id cannot be named and stays.
    """
    out = exact_dedup(spark, docs, earlier_half())
    gone = stored(spark, out.where("NOT kept").select(F.col("doc_id").alias("_gone")), "exact-gone")
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["_gone"], "left_anti")
