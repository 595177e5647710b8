"""The prefix trie of conversations, built in sorted shards around a skeleton of splitter paths.

A conversation's path is the digests of its turns. Paths, each with its conv_id, are dealt to shards by
range, so every shard holds a run of the whole order, copies of one conversation included. Members of a
node are neighbours in that order: a node with members in two shards is on the path of the first
conversation of the later one. These paths are the skeleton, which is broadcast; a shard finishes every
other node on its own and gives partial aggregates of skeleton nodes, which are added up afterwards.

A record holds at most ``CHUNK`` turns of a path. Longer paths go on in a further layer under the node
where the chunk ends, and layers are done from the deepest up; what only one conversation reaches needs no
trie.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.shared import small_side, stored
from caseflow.operators.ordered import Running, running
from caseflow.operators.skew import spread_join

CHUNK = 512
SHARD_TURNS = 500_000
SHARD_RECORDS = 100_000
HEADS, FAMILY = 9, 5
WIDTH = 16
NO_IDS = hashlib.sha256(b"").hexdigest()

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SHARD = (
    "kind int, skeleton bigint, parent_skeleton bigint, start binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, below_children bigint, below_leaves bigint, "
    "below_saved bigint, ids string, part bigint"
)
_FINAL, _PARTIAL, _ROOT = 0, 1, 2


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % HEADS


def rebuilt(spark: SparkSession, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) and the turns (conv_id, place from 1, digest in hex, bytes) of rebuilt conversations.

    Turns go by turn, nulls first, then role and text. A row without a conv_id belongs to no conversation.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text")
    )
    placed = running(rows, ["conv_id"], ["turn", "role", "text"], {"before": Running("sum", F.lit(1))})
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    turns = placed.select(
        "conv_id",
        (F.coalesce("before", F.lit(0)) + 1).cast("bigint").alias("place"),
        F.substring(said, 1, 2 * WIDTH).alias("digest"),
        F.octet_length("text").cast("bigint").alias("bytes"),
    )
    turns = stored(spark, turns, "trie-turns")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns(
        {"h": head_length(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % FAMILY}
    )
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    ids = sizes.join(bases, "base", "left").select(
        "conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")
    )
    ids = stored(spark, ids, "trie-ids")
    heads = turns.where(F.col("place") < HEADS).withColumnRenamed("conv_id", "base")
    borrowed = ids.join(heads, "base").where("place <= h").select("conv_id", "place", "digest", "bytes")
    own = turns.where(F.col("place") > head_length(F.col("conv_id")))
    own = spread_join(own, ids.select("conv_id", "h", "taken"), ["conv_id"], ["place"])
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "bytes")
    return ids.select("conv_id", "length"), borrowed.union(own)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands for a path up to and after each chunk; chunks come in order."""
    conv_id, chain = None, b""
    for batch in batches:
        starts, after = [], []
        for own, path in zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist()):
            chain = chain if own == conv_id else b""
            starts.append(chain)
            conv_id, chain = own, hashlib.sha256(chain + path).digest()
            after.append(chain)
        columns = [*batch.columns, pa.array(starts, pa.binary()), pa.array(after, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "start", "after"])


def _chunks(spark: SparkSession, ids: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, layer, path, bytes, length, start, after): a record for each chunk, one without turns for an empty path."""
    layer = F.floor((F.col("place") - 1) / CHUNK).cast("bigint")
    held = F.sort_array(F.collect_list(F.struct("place", "digest", "bytes")))  # a chunk's turns at most
    cut = turns.groupBy("conv_id", layer.alias("layer")).agg(held.alias("held"))
    cut = cut.select(
        "conv_id", "layer", F.unhex(F.array_join(F.col("held.digest"), "")).alias("path"), F.col("held.bytes").alias("bytes")
    )
    cut = spread_join(cut, ids, ["conv_id"], ["layer"])
    empty = ids.where("length = 0").select(
        "conv_id", F.lit(0).cast("bigint"), F.unhex(F.lit("")), F.array().cast("array<bigint>"), "length"
    )
    cut = cut.select("conv_id", "layer", "path", "bytes", "length").union(empty)
    none = F.unhex(F.lit(""))
    if not ids.where(F.col("length") > CHUNK).limit(1).count():
        return stored(spark, cut.select("*", none.alias("start"), none.alias("after")), "trie-chunks")
    long = cut.where(F.col("length") > CHUNK).repartition("conv_id").sortWithinPartitions("conv_id", "layer")
    schema = "conv_id bigint, layer bigint, path binary, bytes array<bigint>, length bigint, start binary, after binary"
    short = cut.where(F.col("length") <= CHUNK)
    # A path that ends with its only chunk may be where longer ones go on.
    only = F.unhex(F.sha2("path", 256))
    return stored(spark, short.select("*", none.alias("start"), only.alias("after")).union(long.mapInArrow(_chained, schema)), "trie-chunks")


class Skeleton:
    """The trie of the splitters' paths: an entry (parent, depth, bytes, start, root_conv) for each node, parents first."""

    def __init__(self) -> None:
        self.nodes: list[tuple] = []
        self.steps: dict[tuple, int] = {}

    def add(self, start: bytes, path: bytes, sizes: list[int], root_conv: int | None) -> None:
        at = self._step(("", start), (-1, 0, 0, start, root_conv))
        for k in range(len(path) // WIDTH):
            at = self._step((at, path[k * WIDTH : (k + 1) * WIDTH]), (at, k + 1, sizes[k], start, root_conv))

    def _step(self, key: tuple, node: tuple) -> int:
        if key not in self.steps:
            self.steps[key] = len(self.nodes)
            self.nodes.append(node)
        return self.steps[key]


def _shard(table: pa.Table, skeleton: Skeleton, first_depth: int) -> pa.Table:
    """Final rows of a shard's own nodes, partial ones of skeleton nodes, summaries of its own roots in deeper layers."""
    columns = [table[c].to_pylist() for c in ("start", "path", "conv_id", "bytes", "goes_on", "below", "root_conv")]
    records = sorted(zip(*columns), key=lambda r: r[:3])
    part = table["part"][0].as_py()
    steps = skeleton.steps
    # Nodes in preorder, so every parent comes before its children.
    parent, depth, size, place = [], [], [], []
    count, least, ends, below, start_of, root_conv = [], [], [], [], [], []
    previous, trail = None, []
    for start, path, conv_id, sizes, goes_on, under, root in records:
        turns = len(path) // WIDTH
        if previous is None or previous[0] != start:
            trail = []
            keep = 0
        else:
            old, limit = previous[1], min(turns, len(previous[1]) // WIDTH)
            keep = 0
            while keep < limit and path[keep * WIDTH : keep * WIDTH + WIDTH] == old[keep * WIDTH : keep * WIDTH + WIDTH]:
                keep += 1
            del trail[keep + 1 :]
            keep += 1
        for k in range(keep, turns + 1):
            up = trail[-1] if k else -1
            if not k:
                here = steps.get(("", start), -1)
            else:
                here = steps.get((place[up], path[(k - 1) * WIDTH : k * WIDTH]), -1) if place[up] >= 0 else -1
            trail.append(len(parent))
            parent.append(up)
            depth.append(k)
            size.append(sizes[k - 1] if k else 0)
            place.append(here)
            count.append(0)
            least.append(conv_id)
            ends.append(None)
            below.append(None)
            start_of.append(start)
            root_conv.append(root)
        previous = start, path
        last = trail[-1]
        count[last] += 1
        least[last] = min(least[last], conv_id)
        if goes_on:
            below[last] = (under["n_children"], under["n_leaves"], under["saved_tokens"])
        else:
            ends[last] = ends[last] or []
            ends[last].append(conv_id)
    children, leaves, saved = [0] * len(parent), [0] * len(parent), [0] * len(parent)
    for i in range(len(parent) - 1, -1, -1):
        up, mine = parent[i], place[i] < 0
        if mine:
            more = below[i] or (0, 0, 0)
            children[i] += more[0]
            leaves[i] = leaves[i] + more[1] if children[i] else 1
            saved[i] += more[2] + (count[i] - 1) * size[i]
        if up >= 0:
            count[up] += count[i]
            least[up] = min(least[up], least[i])
            if mine:
                children[up] += 1
                leaves[up] += leaves[i]
                saved[up] += saved[i]
    rows = []
    for i, up in enumerate(parent):
        ids = ",".join(map(str, ends[i] or ()))
        row = {"kind": _FINAL, "conv_id": least[i], "depth": first_depth + depth[i], "n_convs": count[i]}
        row |= {"n_children": children[i], "n_leaves": leaves[i], "saved_tokens": saved[i]}
        if place[i] >= 0:
            more = below[i] or (0, 0, 0)
            row |= {"kind": _PARTIAL, "skeleton": place[i], "ids": ids or None, "part": part}
            row |= {"below_children": more[0], "below_leaves": more[1], "below_saved": more[2]}
        elif up < 0:
            row |= {"kind": _ROOT, "start": start_of[i]}
        else:
            row["ends_sha256"] = hashlib.sha256(ids.encode()).hexdigest() if ids else NO_IDS
            row["parent_conv_id"] = root_conv[i] if first_depth and depth[i] == 1 else None if place[up] >= 0 else least[up]
            row["parent_skeleton"] = place[up] if place[up] >= 0 else None
        rows.append(row)
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in SHARD.split(", "))])
    return pa.Table.from_pylist(rows, schema)


def _id_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each skeleton node's ids, shard after shard."""
    now, state, names, hashes = None, None, [], []
    for batch in batches:
        for at, ids in zip(batch.column("skeleton").to_pylist(), batch.column("ids").to_pylist()):
            if at != now:
                if state:
                    names.append(now)
                    hashes.append(state.hexdigest())
                now, state = at, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state:
        names.append(now)
        hashes.append(state.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(hashes, pa.string())], ["skeleton", "ends_sha256"])


def _layer(spark: SparkSession, records: DataFrame, layer: int) -> tuple[DataFrame, DataFrame | None]:
    """The nodes of one layer, and (start, n_children, n_leaves, saved_tokens) of its tops where it is a deeper one."""
    turns, n = records.agg(F.sum(F.length("path") / WIDTH), F.count("*")).first()
    shards = max(1, math.ceil((turns or 0) / SHARD_TURNS), math.ceil(n / SHARD_RECORDS))
    dealt = records.repartitionByRange(shards, "start", "path", "conv_id").withColumn("part", F.spark_partition_id().cast("bigint"))
    dealt = stored(spark, dealt, "trie-shards")
    firsts = dealt.groupBy("part").agg(F.min(F.struct("start", "path", "conv_id", "bytes", "root_conv")).alias("first"))
    skeleton = Skeleton()
    for row in firsts.orderBy("part").collect():  # a path of a chunk at most for each shard
        first = row["first"]
        skeleton.add(bytes(first["start"]), bytes(first["path"]), first["bytes"], first["root_conv"])
    shared, first_depth = spark.sparkContext.broadcast(skeleton), layer * CHUNK
    made = dealt.groupBy("part").applyInArrow(lambda table: _shard(table, shared.value, first_depth), SHARD)
    made = stored(spark, made, "trie-made")

    partial = made.where(F.col("kind") == _PARTIAL)
    sums = partial.groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        *[F.max(c).alias(c) for c in ("below_children", "below_leaves", "below_saved")],
    )
    total = {r["skeleton"]: r.asDict() for r in sums.collect()}  # a row for each skeleton node
    for at in range(len(skeleton.nodes) - 1, -1, -1):
        up, _, size, *_ = skeleton.nodes[at]
        own = total[at]
        own["n_children"] += own["below_children"]
        own["n_leaves"] = own["n_leaves"] + own["below_leaves"] if own["n_children"] else 1
        own["saved_tokens"] += own["below_saved"] + (own["n_convs"] - 1) * size
        if up >= 0:
            for c, more in (("n_children", 1), ("n_leaves", own["n_leaves"]), ("saved_tokens", own["saved_tokens"])):
                total[up][c] += more
    rows = []
    for at, (up, depth, _, start, root_conv) in enumerate(skeleton.nodes):
        # The top of a deeper layer is a node of the layer above, which knows its smallest member.
        above = None if up < 0 else root_conv if layer and depth == 1 else total[up]["conv_id"]
        numbers = [total[at][c] for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
        rows.append((at, start, total[at]["conv_id"], first_depth + depth, above, *numbers))
    names = "skeleton bigint, start binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
    bones = spark.createDataFrame(rows, names)
    ids = partial.where("ids IS NOT NULL").select("skeleton", "part", "ids")
    hashes = ids.repartition("skeleton").sortWithinPartitions("skeleton", "part").mapInArrow(_id_hashes, "skeleton bigint, ends_sha256 string")
    inner = bones.where(F.col("depth") > first_depth) if layer else bones
    inner = inner.join(hashes, "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_IDS)))
    tops = F.broadcast(bones.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("_conv")))  # the skeleton's size
    final = made.where(F.col("kind") == _FINAL).join(tops, "parent_skeleton", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "_conv")
    )
    nodes = final.select(*NODE).union(inner.select(*NODE))
    if not layer:
        return nodes, None
    summary = ["start", "n_children", "n_leaves", "saved_tokens"]
    return nodes, bones.where(F.col("depth") == first_depth).select(*summary).union(made.where(F.col("kind") == _ROOT).select(*summary))


def prefix_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Null roles and texts are empty. Rows go by turn, nulls first, and rows of one turn by role and text; repeated
    rows are turns of their own. A row without a conv_id belongs to no conversation. Conversations
    left without turns are members of the root, and end there. An empty table gives no rows. Columns
    besides conv_id, turn, role and text are ignored.

    Turns are compared by 128 bits of their SHA-256. The driver gets the skeleton: for each shard at most one
    path of ``CHUNK`` turns.
    """
    ids, turns = rebuilt(spark, conversations)
    chunks = _chunks(spark, ids, turns)
    on = F.col("length") > (F.col("layer") + 1) * CHUNK
    under = "struct<n_children:bigint,n_leaves:bigint,saved_tokens:bigint>"
    if not ids.where(F.col("length") > CHUNK).limit(1).count():
        own = chunks.withColumns({"goes_on": F.lit(False), "below": F.lit(None).cast(under), "root_conv": F.lit(None).cast("bigint")})
        return _layer(spark, own.drop("after", "layer", "length"), 0)[0]
    full = chunks.where(F.length("path") == CHUNK * WIDTH)
    tops = full.groupBy(F.col("after").alias("start")).agg(F.count("*").alias("members"), F.min("conv_id").alias("root_conv"))
    chunks = stored(spark, chunks.join(tops, "start", "left").withColumn("goes_on", on), "trie-layers")
    alone = (F.col("layer") > 0) & (F.col("members") == 1)
    out = chunks.where(alone).select(
        "conv_id", "layer", "length", F.explode(F.sequence(F.lit(1), F.size("bytes"))).alias("k")
    ).withColumn("depth", F.col("layer") * CHUNK + F.col("k")).select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("bigint").alias("n_convs"),
        (F.col("depth") < F.col("length")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(F.col("depth") == F.col("length"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NO_IDS).alias("ends_sha256"),
    )
    shared = chunks.where(~alone | (F.col("layer") == 0))
    deepest = shared.agg(F.max("layer")).first()[0]
    below = spark.createDataFrame([], "start binary, n_children bigint, n_leaves bigint, saved_tokens bigint")
    for layer in range(deepest, -1, -1):
        found = small_side(below.withColumnRenamed("start", "after"))
        # Where no layer was done, one conversation alone goes on.
        counts = F.struct(*[F.coalesce(c, F.lit(v)).cast("bigint").alias(c) for c, v in (("n_children", 1), ("n_leaves", 1), ("saved_tokens", 0))])
        own = shared.where(F.col("layer") == layer).join(found, "after", "left").withColumn("below", F.when(F.col("goes_on"), counts))
        nodes, below = _layer(spark, own.select("conv_id", "path", "bytes", "start", "goes_on", "below", "root_conv"), layer)
        out = out.union(nodes)
    return out
