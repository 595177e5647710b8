"""Near-duplicate documents by circulant MinHash, confirmed on full shingle sets.

Two fixed permutations of the 32-bit universe make the whole signature: the first scatters the
shingles, the second, shifted circularly by 1, 2, ... K, gives coordinate k as the least value that
any scattered shingle takes. Coordinates are cut into bands; documents that share a band are
candidates, and a candidate counts only when the exact Jaccard similarity of the whole sets does.

Documents with equal sets are one class and only its smallest doc_id takes part. In a band's bucket
every member is confirmed against the bucket's first member, which is linear in the bucket. What
is still in another component than the first member is then compared with the other members, a
block of sets against a stream of sets, so that no pair becomes a row before it is confirmed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.shared import components, documents, narrowed, small_side, stored
from caseflow.llm.textkernel import mix, shingle_sets

BANDS, ROWS = 40, 6
SALTS = 1024
BLOCK = 256


def _scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 32-bit universe."""
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
    return x ^ (x >> np.uint32(15))


def _permute(x: np.ndarray) -> np.ndarray:
    """The second permutation, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    return x


def signature(hashes: np.ndarray, length: int) -> np.ndarray:
    """Coordinate k is the least value of the second permutation, shifted by k + 1, over the set."""
    seen = _scatter((hashes >> np.uint64(32)).astype(np.uint32))
    shift = np.arange(1, length + 1, dtype=np.uint32)[:, None]
    low = np.full(length, 2**32 - 1, np.uint32)
    for at in range(0, len(seen), 512):
        np.minimum(low, _permute(seen[None, at : at + 512] - shift).min(axis=1), out=low)
    return low


def signatures(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The signatures of many sets that lie one after another, from ``starts`` on; one column for each."""
    seen = _scatter((hashes >> np.uint64(32)).astype(np.uint32))
    rows = [np.minimum.reduceat(_permute(seen - np.uint32(k + 1)), starts) for k in range(length)]
    return np.stack(rows)


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of the signature; the band's number is part of it."""
    low = signature(hashes, bands * rows).reshape(bands, rows).astype(np.uint64)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for j in range(rows):
        key = mix(key ^ low[:, j])
    return key.view(np.int64)


def features(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands); no set_key and no bands where a text has no word."""

    def run(batches):
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1), width):
                ids = batch.column(0).slice(first, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([band_keys(s, bands, rows) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "set_key", "bands"],
                )

    return documents(docs).mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Pairs are dealt by a and a salt of b. A task reads each a once, then its partners one at a time,
    so it holds two sets however many partners one document has.
    """
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    wanted = salted.select(F.col("b").alias("doc_id"), "a", "salt", F.lit(1).alias("part")).union(
        salted.select("a", "salt").distinct().select(F.col("a").alias("doc_id"), "a", "salt", F.lit(0))
    )
    texts = narrowed(documents(docs), wanted.select("doc_id").distinct(), "doc_id")
    rows = wanted.join(texts, "doc_id").select("a", "salt", "part", F.col("doc_id").alias("b"), "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "part")

    def run(batches):
        held, mine = None, None
        for batch in batches:
            for first, sets in shingle_sets(batch.column("text"), width):
                ids = [batch.column(c).slice(first, len(sets)).to_pylist() for c in ("a", "salt", "part", "b")]
                out_a, out_b = [], []
                for a, salt, part, b, own in zip(*ids, sets):
                    if part == 0:
                        held, mine = (a, salt), own
                    elif held == (a, salt):
                        both = len(np.intersect1d(mine, own, assume_unique=True))
                        if 100 * both >= percent * (len(mine) + len(own) - both):
                            out_a.append(a)
                            out_b.append(b)
                if out_a:
                    yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def unsettled(spark: SparkSession, first: DataFrame, roots: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between documents that met under one first member and are in different components.

    Members in the component of their first member need no comparison with each other. The rest are
    cut into blocks of about ``BLOCK``; a task holds the sets of one block and streams the members
    past it, counting shared shingles with the whole block at once.
    """
    first = first.join(small_side(roots.select(F.col("id").alias("a"), F.col("root").alias("root_a"))), "a", "left")
    first = first.join(small_side(roots.select(F.col("id").alias("b"), "root")), "b", "left").select(
        "a", "b", F.coalesce("root", "b").alias("root"), (F.coalesce("root", "b") != F.coalesce("root_a", "a")).alias("apart")
    )
    first = stored(spark, first, "near-placed")
    size = first.groupBy("a").agg(F.count_if("apart").alias("apart_n"), F.count("*").alias("n"))
    size = size.where("apart_n > 0 AND n > 1").select("a", F.ceil(F.col("apart_n") / BLOCK).cast("int").alias("blocks"))
    rows = first.join(small_side(stored(spark, size, "near-sizes")), "a")
    held = rows.where("apart").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("part"), "b", "root")
    passed = rows.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("part"), "b", "root")
    texts = narrowed(documents(docs), passed.select(F.col("b").alias("doc_id")).distinct(), "doc_id")
    texts = texts.select(F.col("doc_id").alias("b"), "text")
    rows = held.union(passed).join(texts, "b").select("a", "block", "part", "b", "root", "text")
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", "part")

    def run(batches):
        key, block, index = None, [], None
        for batch in batches:
            for start, sets in shingle_sets(batch.column("text"), width):
                cells = [batch.column(c).slice(start, len(sets)).to_pylist() for c in ("a", "block", "part", "b", "root")]
                out_a, out_b = [], []
                for a, number, part, b, root, own in zip(*cells, sets):
                    if (a, number) != key:
                        key, block, index = (a, number), [], None
                    if part == 0:
                        block.append((b, root, own))
                        continue
                    if not block:
                        continue
                    index = index or _Block(block, percent)
                    found = index.linked(b, root, own)
                    out_a.extend([b] * len(found))
                    out_b.extend(found)
                if out_a:
                    yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


class _Block:
    """An inverted index over the sets of one block."""

    def __init__(self, block: list[tuple[int, int, np.ndarray]], percent: int):
        self.percent = percent
        self.ids, self.roots = (np.array([x[i] for x in block], np.int64) for i in (0, 1))
        self.sizes = np.array([len(x[2]) for x in block], np.int64)
        values = np.concatenate([x[2] for x in block])
        owner = np.repeat(np.arange(len(block)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.owner = owner[order]
        self.values, self.starts = np.unique(values[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(values))

    def linked(self, doc_id: int, root: int, own: np.ndarray) -> list[int]:
        """The ids of the block's sets, of other components, that are similar enough to this one."""
        at = np.searchsorted(self.values, own)
        at[at == len(self.values)] = 0
        at = at[self.values[at] == own]
        length = self.ends[at] - self.starts[at]
        spots = np.repeat(self.starts[at] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        both = np.bincount(self.owner[spots], minlength=len(self.ids))
        fit = (100 * both >= self.percent * (self.sizes + len(own) - both)) & (self.roots != root) & (self.ids != doc_id)
        return self.ids[fit].tolist()


def near_dedup(
    spark: SparkSession,
    docs: DataFrame,
    width: int = 4,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set is its distinct shingles of ``width`` words; fewer words make one shingle; no
    word makes an empty set, linked with nothing, so the document stays. With 40 bands of 6 rows a
    pair at similarity 0.8 shares a band with probability 0.999995, above it with more. Null text
    counts as empty; a null doc_id is linked with nothing and stays. Rows that repeat a doc_id are
    one document. Ties go to the smallest doc_id. An empty table gives no rows. Columns besides
    doc_id and text are ignored.
    """
    feats = stored(spark, features(docs, width, bands, rows), "near-features")
    usable = feats.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = stored(spark, usable.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "near-classes")
    reps = usable.join(classes, (usable["doc_id"] == classes["rep"]) & (usable["set_key"] == classes["set_key"]))
    buckets = stored(spark, reps.select("rep", F.explode("bands").alias("band")).distinct(), "near-buckets")
    shared = buckets.groupBy("band").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("band", "a")
    first = buckets.join(shared, "band").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    first = stored(spark, first, "near-first")
    links = stored(spark, confirmed(first, docs, width, percent), "near-links")
    roots = stored(spark, components(spark, links, "near-one"), "near-roots")

    more = stored(spark, unsettled(spark, first, roots, docs, width, percent), "near-more")
    roots = stored(spark, components(spark, links.union(more), "near-all"), "near-final")

    named = classes.join(roots, classes["rep"] == roots["id"], "left").select(
        "set_key", F.coalesce("root", "rep").alias("component")
    )
    return feats.join(named, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def keep_first(spark: SparkSession, docs: DataFrame, width: int = 5) -> DataFrame:
    """The documents without all but the first of each near-duplicate group, all columns as they were."""
    out = near_dedup(spark, docs, width)
    gone = stored(spark, out.where("NOT kept").select(F.col("doc_id").alias("_gone")), "near-gone")
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["_gone"], "left_anti")
