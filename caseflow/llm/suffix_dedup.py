"""Exact removal of repeated byte strings with suffix arrays.

Equal strings of ``LENGTH`` bytes choose the same anchor: the position with the least hash of a short
gram among the first ``REACH`` positions. An anchor's key is the hash of the core that follows it,
which lies inside every string that chose it, so equal strings meet under one key. Only keys that
occur more than once matter; their occurrences travel with the text around them.

A task takes the occurrences of many keys at a time. The text from the anchor on is written in
symbols of ``STEP`` bytes, ranked in byte order, and the suffix array of all these sequences gives
the order of the occurrences and with it the common prefix of any two. Two strings are equal when
what precedes the anchor is, and when the common prefix of what follows is long enough; among
occurrences with the same lead it suffices to look at neighbours in the order.

Runs of ``WORDS`` words that another document has too are reported from the same order. For them a text is
the sequence of its words' hashes, eight bytes a word; anchors, cores and steps are whole words, and
of equal windows it counts that they are in different texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.grouping import suffix_array
from caseflow.llm.shared import dropped, narrowed, small_side, stored
from caseflow.llm.textkernel import RangeHash, mix, run_hashes, slices, words

LENGTH, REACH, GRAM, STEP = 400, 300, 16, 100
CORE = LENGTH - REACH
WORDS, WORD_REACH, WORD_GRAM, WORD_BYTES = 51, 38, 4, 8
# (window, core, step, stride) of the two kinds of symbols, in bytes; a key's lowest bit is its kind.
KINDS = [(LENGTH, CORE, STEP, 1), (WORDS * WORD_BYTES, (WORDS - WORD_REACH) * WORD_BYTES, WORD_REACH * WORD_BYTES // 2, WORD_BYTES)]
BATCH = 4096
MOST = 20_000
NAME = ["_id", "_none", "tag"]
CUT = ["n_removed", "n_spans", "kept_sha256", "n_repeated_words", "n_repeated_runs"]


def _least(low: np.ndarray, reach: int) -> np.ndarray:
    """The place of the least value of every ``reach`` values, from running minima to both sides of block borders."""
    blocks = np.full(-(-len(low) // reach) * reach, np.uint64(2**64 - 1))
    blocks[: len(low)] = low
    blocks = blocks.reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: len(low) - reach + 1], ahead[reach - 1 : len(low)])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _chosen(gram: np.ndarray, offsets: np.ndarray, window: int, reach: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first, last, place): the runs of window starts of each row that chose the same anchor.

    The anchor is the place of the least gram among the first ``reach`` symbols of a window. All but
    ``place`` count from the row's start.
    """
    low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram)).astype(np.uint64)
    chosen = _least(low, reach)
    size = np.diff(offsets)
    many = np.maximum(0, size - window + 1)
    row = np.repeat(np.arange(len(size)), many)
    start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + offsets[row]
    chosen = chosen[start]
    if not len(row):
        return row, chosen, start, start, chosen
    head = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])))
    tail = np.append(head[1:], len(row)) - 1
    base = offsets[row[head]]
    return row[head], chosen[head] - base, start[head] - base, start[tail] - base, chosen[head]


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, anchor, first, last, key) of the byte windows, in row positions."""
    if len(data) < LENGTH:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    ranges = RangeHash(data)
    at = np.arange(len(data) - GRAM + 1)
    *found, place = _chosen(ranges.of(at, at + GRAM), offsets, LENGTH, REACH)
    return *found, ranges.of(place, place + CORE) & ~np.uint64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the words' offsets by row."""
    start, end, row = words(data, offsets)
    return RangeHash(data).of(start, end), np.searchsorted(row, np.arange(len(offsets)))


def word_anchors(word_hash: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, anchor, first, last, key) of the windows of ``WORDS`` words, counted in words."""
    if len(word_hash) < WORDS:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    *found, place = _chosen(run_hashes(word_hash, WORD_GRAM), offsets, WORDS, WORD_REACH)
    return *found, run_hashes(word_hash, WORDS - WORD_REACH)[place] | np.uint64(1)


def _pack(anchor, first, last):
    return anchor << 18 | (anchor - first) << 9 | (anchor - last)


def _unpack(packed):
    anchor = packed >> 18
    return anchor, anchor - (packed >> 9 & 511), anchor - (packed & 511)


def repeated(
    contexts: list[bytes], leads: np.ndarray, runs: np.ndarray, keys: np.ndarray, kind: int = 0, owners: np.ndarray | None = None
) -> np.ndarray:
    """For each window of each occurrence, in order, whether it equals a window of another occurrence.

    A context is the text from an occurrence's first window start to its last window's end; ``leads``
    are the bytes before the anchor and ``runs`` the number of windows. With ``owners`` the other
    occurrence must have another owner.
    """
    length, core_size, step, stride = KINDS[kind]
    n = len(contexts)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.array([len(c) for c in contexts])
    base = np.cumsum(size) - size
    after = np.minimum(size - leads, length)
    body = np.zeros((n, length), np.uint8)
    for i, context in enumerate(contexts):
        body[i, : after[i]] = np.frombuffer(context, np.uint8)[leads[i] : leads[i] + after[i]]

    # the core is equal under one key, so one symbol stands for it; then come the steps, then a separator
    steps = (length - core_size) // step
    cells = np.ascontiguousarray(body[:, core_size:]).reshape(n * steps, step)
    _, symbol = np.unique(cells.view(f"V{step}").ravel(), return_inverse=True)
    cores, core = np.unique(keys, return_inverse=True)
    text = np.ones((n, steps + 2), np.int64)
    text[:, 0] = core + 2
    text[:, 1:-1] = symbol.reshape(n, steps) + 2 + len(cores)
    order = np.array(suffix_array([*text.ravel().tolist(), 0]))
    order = order[(order % (steps + 2) == 0) & (order < text.size)] // (steps + 2)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    lower, upper = body[order[:-1]], body[order[1:]]
    differ = lower != upper
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    common = np.minimum(common, np.minimum(after[order[:-1]], after[order[1:]]))
    common[keys[order[:-1]] != keys[order[1:]]] = 0
    # least[k][i]: the least common prefix of the 2^k neighbours from i on
    least = [common]
    while 2 ** len(least) <= len(common):
        half = 2 ** (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))

    row = np.repeat(np.arange(n), runs)
    begin = base[row] + stride * (np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs))
    lead = base[row] + leads[row] - begin
    group = mix(RangeHash(data).of(begin, begin + lead) + mix(keys[row] + lead.astype(np.uint64)))
    sort = np.lexsort((rank[row], group))
    group, place, need = group[sort], rank[row][sort], length - lead[sort]
    same = np.flatnonzero(group[1:] == group[:-1])
    out = np.zeros(len(row), bool)
    if len(same):
        low, high = place[same], place[same + 1]
        level = np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level):
            at = level == k
            span = np.minimum(least[k][low[at]], least[k][high[at] - 2**k])
            hit = same[at][span >= need[same[at]]]
            out[hit + 1] = True  # equal to the window before it
    if owners is None:
        out[:-1] |= out[1:]
    else:
        head = np.flatnonzero(~out)
        own = owners[row][sort]
        several = np.minimum.reduceat(own, head) != np.maximum.reduceat(own, head) if len(own) else own
        out = np.repeat(several, np.diff(np.append(head, len(own))))
    result = np.empty(len(row), bool)
    result[sort] = out
    return result


def _ranges(hit: np.ndarray, first: np.ndarray, runs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurrence, begin, end) of the symbols that repeated windows cover."""
    row = np.repeat(np.arange(len(runs)), runs)
    start = np.repeat(first, runs) + np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
    row, start = row[hit], start[hit]
    if not len(row):
        return row, start, start
    head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)))
    tail = np.append(head[1:], len(row)) - 1
    return row[head], start[head], start[tail] + length


def _features(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, digest, n_bytes, n_words, keys, packed): a text's digest, its first eight bytes, and its anchors."""

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for row, end, data, offsets in slices(texts):
                word_hash, word_offsets = word_hashes(data, offsets)
                both = [np.concatenate(x) for x in zip(anchors(data, offsets), word_anchors(word_hash, word_offsets))]
                of, anchor, first, last, key = (x[np.argsort(both[0], kind="stable")] for x in both)
                bounds = pa.array(np.searchsorted(of, np.arange(end - row + 1)), pa.int32())
                raw = data.tobytes()
                digest = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, end - row),
                        pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digest], pa.int64()),
                        pa.array(digest, pa.binary()),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.array(np.diff(word_offsets), pa.int64()),
                        pa.ListArray.from_arrays(bounds, pa.array(key.view(np.int64))),
                        pa.ListArray.from_arrays(bounds, pa.array(_pack(anchor, first, last))),
                    ],
                    ["doc_id", "tag", "digest", "n_bytes", "n_words", "keys", "packed"],
                )

    return docs.mapInArrow(
        run, "doc_id bigint, tag bigint, digest binary, n_bytes bigint, n_words bigint, keys array<bigint>, packed array<bigint>"
    )


class _Symbols:
    """The windows of one text, in bytes or in words, which are found when they are asked for."""

    def __init__(self, text: pa.Scalar):
        self.raw = memoryview(text.as_buffer())
        self.hashes: memoryview | None = None
        self.bounds: tuple[list[int], list[int]] | None = None

    def text(self, key: int, first: int, windows: int) -> bytes:
        """The bytes of some windows in a row. Words go as they are: their hashes are longer and cannot be compressed."""
        if not key & 1:
            return self.cut(key, first, windows)
        if self.bounds is None:
            data = np.frombuffer(self.raw, np.uint8)
            start, end, _ = words(data, np.array([0, len(data)]))
            self.bounds = start.tolist(), end.tolist()
        start, end = self.bounds
        return bytes(self.raw[start[first] : end[first + windows + WORDS - 2]])

    def cut(self, key: int, first: int, windows: int = 1) -> bytes:
        """The symbols of some windows in a row, of the kind of the key."""
        if not key & 1:
            return bytes(self.raw[first : first + windows - 1 + LENGTH])
        if self.hashes is None:
            data = np.frombuffer(self.raw, np.uint8)
            self.hashes = memoryview(word_hashes(data, np.array([0, len(data)]))[0].tobytes())
        return bytes(self.hashes[first * WORD_BYTES : (first + windows - 1 + WORDS) * WORD_BYTES])


def _word_symbols(contexts: list[bytes]) -> list[bytes]:
    """The hashes of each context's words."""
    offsets = np.cumsum([0, *map(len, contexts)])
    word_hash, bounds = word_hashes(np.frombuffer(b"".join(contexts), np.uint8), offsets)
    bounds = np.append(bounds[: len(contexts)], len(word_hash)).tolist()
    return [word_hash[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


def _named(df: DataFrame, *columns: str) -> DataFrame:
    """With doc_id as the two columns of ``NAME``, none of them null: groups of these are joined without a shuffle."""
    return df.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), "tag", *columns)


def _context_rows(texts: DataFrame) -> DataFrame:
    """(doc_id, tag, key, packed, context): the text around every anchor that few enough others share."""

    def run(batches):
        for batch in batches:
            for doc_id, tag, text, found in zip(*(batch.column(c) for c in ("doc_id", "tag", "text", "found"))):
                symbols = _Symbols(text)
                few = ~found.values.field("many").to_numpy(zero_copy_only=False)
                keys, packed = (found.values.field(c).to_numpy()[few] for c in ("key", "packed"))
                _, first, last = _unpack(packed)
                cut = [symbols.text(k, a, b - a + 1) for k, a, b in zip(keys.tolist(), first.tolist(), last.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id.as_py()] * len(keys), pa.int64()),
                        pa.array([tag.as_py()] * len(keys), pa.int64()),
                        pa.array(keys),
                        pa.array(packed),
                        pa.array(cut, pa.binary()),
                    ],
                    ["doc_id", "tag", "key", "packed", "context"],
                )

    return texts.mapInArrow(run, "doc_id bigint, tag bigint, key bigint, packed bigint, context binary")


def _matched(contexts: DataFrame) -> DataFrame:
    """(doc_id, tag, kind, begin, end): repeated symbols under the keys with few occurrences."""
    rows = contexts.repartition("key").sortWithinPartitions("key")

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for kind, (length, _, _, stride) in enumerate(KINDS):
            own = [r for r in rows if r[0] & 1 == kind]
            if not own:
                continue
            keys, ids, tags, packed, texts = zip(*own)
            anchor, first, last = _unpack(np.array(packed, np.int64))
            runs = last - first + 1
            owners = np.array(tags, np.int64) if kind else None
            texts = _word_symbols(texts) if kind else texts
            hit = repeated(list(texts), (anchor - first) * stride, runs, np.array(keys, np.int64).view(np.uint64), kind, owners)
            row, begin, end = _ranges(hit, first, runs, length // stride)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in row], pa.int64()), pa.array([tags[i] for i in row], pa.int64()),
                 pa.array([kind] * len(row), pa.int32()), pa.array(begin), pa.array(end)],
                ["doc_id", "tag", "kind", "begin", "end"],
            )

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "tag", "packed", "context"))):
                if len(held) >= BATCH and row[0] != held[-1][0]:
                    yield from solve(held)
                    held = []
                held.append(row)
        if held:
            yield from solve(held)

    return rows.mapInArrow(run, "doc_id bigint, tag bigint, kind int, begin bigint, end bigint")


def _matched_many(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """The same for keys with more occurrences than a task takes at once: windows are counted by Spark.

    A mark may have very many windows. They are combined before the shuffle to a row for each task, and what is
    joined with the windows is stored, so that a hot mark can be split.
    """

    def run(batches):
        for batch in batches:
            for doc_id, tag, text, found in zip(*(batch.column(c) for c in ("doc_id", "tag", "text", "found"))):
                symbols = _Symbols(text)
                many = found.values.field("many").to_numpy(zero_copy_only=False)
                keys = found.values.field("key").to_numpy()[many]
                _, first, last = _unpack(found.values.field("packed").to_numpy()[many])
                runs = zip(keys.tolist(), first.tolist(), last.tolist())
                places = [(key, k) for key, a, b in runs for k in range(a, b + 1)]
                marks = [hashlib.blake2b(symbols.cut(key, k), digest_size=16, salt=bytes([key & 1])).digest() for key, k in places]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id.as_py()] * len(marks), pa.int64()),
                        pa.array([tag.as_py()] * len(marks), pa.int64()),
                        pa.array([key & 1 for key, _ in places], pa.int32()),
                        pa.array([k for _, k in places], pa.int64()),
                        pa.array(marks, pa.binary()),
                    ],
                    ["doc_id", "tag", "kind", "begin", "mark"],
                )

    windows = texts.where("exists(found, f -> f.many)").mapInArrow(run, "doc_id bigint, tag bigint, kind int, begin bigint, mark binary")
    windows = stored(spark, windows, "suffix-windows")
    place = F.xxhash64("tag", F.when(F.col("kind") == 0, F.col("begin")))  # of words, only other texts count
    often = windows.groupBy("mark").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("mark")
    often = small_side(stored(spark, often, "suffix-often"))
    size = F.when(F.col("kind") == 0, LENGTH).otherwise(WORDS)
    return windows.join(often, "mark", "left_semi").select("doc_id", "tag", "kind", "begin", (F.col("begin") + size).alias("end"))


def _covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((begin, end))
    return out


def _cut(texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
                raw = memoryview(text.as_buffer())
                gone, said = (_covered([(s["begin"], s["end"]) for s in spans if s["kind"] == kind]) for kind in (0, 1))
                kept, done = hashlib.sha256(), 0
                for begin, end in gone:
                    kept.update(raw[done:begin])
                    done = end
                kept.update(raw[done:])
                out.append((sum(e - b for b, e in gone), len(gone), kept.hexdigest(), sum(e - b for b, e in said), len(said)))
            columns = zip(*out) if out else ((),) * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tag"), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                ["doc_id", "tag", *CUT],
            )

    return texts.mapInArrow(
        run, "doc_id bigint, tag bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_repeated_words bigint, n_repeated_runs bigint"
    )


def suffix_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and what it says that others say too.

    Every byte covered by a string of 400 bytes that also starts anywhere else, in this document or
    another, is removed; texts are UTF-8 bytes, null counts as empty. Equal texts are one text with
    several copies: all of their windows are repeated, and one copy stands for them elsewhere. Texts
    shorter than 400 bytes keep every byte. Repeated rows and rows without an id are documents of their
    own. An empty table gives no rows. Columns besides doc_id and text are ignored.

    ``n_repeated_words`` counts the words in runs of over 50 words that another document has as well, whatever
    white space is between them, ``n_repeated_runs`` those runs, and ``repeats`` tells whether there is one.
    Nothing is removed for that. Such runs are mostly shorter than 400 bytes or a little longer.

    A text is named by its doc_id and the first eight bytes of its digest. Only texts with a candidate
    anchor are stored again. A key with more than ``MOST`` occurrences is not given to one task: its
    windows are counted exactly by their digests instead.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = stored(spark, _features(rows), "suffix-features")
    copies = known.groupBy("digest", "tag").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    copies = stored(spark, copies, "suffix-copies")

    anchor_rows = known.select("doc_id", "tag", F.explode(F.arrays_zip("keys", "packed")).alias("a")).select(
        "doc_id", "tag", F.col("a.keys").alias("key"), F.col("a.packed").alias("packed")
    )
    # Copies share a place, so that they alone do not make a key repeat; for words only other texts do.
    place = F.xxhash64("tag", F.when(F.col("key").bitwiseAND(1) == 0, F.col("packed")))
    often = anchor_rows.groupBy("key").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n"))
    often = stored(spark, often.where("low <> high").select("key", (F.col("n") > MOST).alias("many")), "suffix-keys")
    found = _named(anchor_rows.join(small_side(often), "key"), "key", "packed", "many")
    found = found.groupBy(*NAME).agg(F.collect_set(F.struct("key", "packed", "many")).alias("found"))
    first = _named(copies.withColumnRenamed("first_id", "doc_id"), "digest")
    found = found.join(first, NAME).select(F.when(~F.col("_none"), F.col("_id")).alias("doc_id"), "tag", "found", "digest")
    found = stored(spark, found, "suffix-found")
    # the anchors are most of the bytes and have done their work
    featured, known = known, stored(spark, known.select("doc_id", "tag", "digest", "n_bytes", "n_words"), "suffix-sizes")
    dropped(spark, featured, often)
    ids = found.select(F.xxhash64("doc_id").alias("_hash")).distinct()
    texts = narrowed(rows.where("text IS NOT NULL").withColumn("_hash", F.xxhash64("doc_id")), ids, "_hash")
    texts = texts.select(F.col("doc_id").alias("_id"), "text")
    texts = texts.join(found, F.col("_id").eqNullSafe(F.col("doc_id"))).where(F.sha2(F.col("text").cast("binary"), 256) == F.lower(F.hex("digest")))
    texts = stored(spark, texts.select("doc_id", "tag", "text", "found"), "suffix-texts")
    dropped(spark, found)

    spans = _matched(_context_rows(texts).select("key", "doc_id", "tag", "packed", "context"))
    matched = stored(spark, spans.union(_matched_many(spark, texts)), "suffix-spans")
    spans = _named(matched, "kind", "begin", "end").groupBy(*NAME).agg(F.collect_list(F.struct("kind", "begin", "end")).alias("spans"))
    hit = _named(texts, "doc_id", "text").join(spans, NAME)
    cut = stored(spark, _cut(hit.select("doc_id", "tag", "text", "spans")).distinct(), "suffix-cut")
    dropped(spark, texts, matched)

    copied = F.col("copies") > 1
    whole = copied & (F.col("n_bytes") >= LENGTH)
    spoken = copied & (F.col("n_words") >= WORDS)
    cut = cut.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), *CUT)
    answer = known.select("doc_id", "tag", "digest", "n_bytes", "n_words").join(copies.select("digest", "copies"), "digest")
    answer = answer.join(cut, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), "left")
    said = F.when(spoken, F.col("n_words")).otherwise(F.coalesce("n_repeated_words", F.lit(0)))
    return answer.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256))
        .otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest"))))
        .alias("kept_sha256"),
        said.alias("n_repeated_words"),
        F.when(spoken, 1).otherwise(F.coalesce("n_repeated_runs", F.lit(0))).cast("bigint").alias("n_repeated_runs"),
        (said > 0).alias("repeats"),
    )
