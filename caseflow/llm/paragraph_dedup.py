"""Repeated paragraphs across documents by MinHash banding, confirmed by exact Jaccard similarity.

A paragraph is a line of at least 20 words, or a run of shorter lines up to a blank line. Long ones are also compared in pieces, cut where the hash of a word
pair is the least of its neighbourhood in the line, so a stretch inside a long line is cut alike wherever
it stands. Bands of two rows are enough: unrelated paragraphs share no five-word shingle, and at a
similarity of 0.8 a pair shares one of seven bands with probability 0.9992.

Passages of over 50 words that repeat word for word are found wherever they stand, also across lines.
Every window of 51 words is known by the least hash of its 20-word runs (winnowing), so equal windows have
an equal mark. Marks that occur once are left; the windows of the others are counted by their own hash.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.llm.near_dedup import confirmed, signatures, unsettled
from caseflow.llm.shared import components, documents, dropped, narrowed, small_side, stored
from caseflow.llm.textkernel import RangeHash, by_row, lower_ascii, mix, run_hashes, shingles, slices, words

WIDTH, BANDS, ROWS = 5, 7, 2
LEAST, LONG, LEAST_PIECE, RADIUS = 20, 48, 10, 6
PASSAGE, RUN = 51, 20
NONE = np.uint64(2**64 - 1)


def _cuts(word: np.ndarray, of_line: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Where pieces begin: at heads of lines and at least word pairs, but no piece of under ``LEAST_PIECE`` words."""
    same = np.append(of_line[1:] == of_line[:-1], False)
    pair = np.where(same, mix(word + mix(np.append(word[1:], np.uint64(0)))), NONE)
    lowest = pair.copy()
    for shift in range(1, min(RADIUS + 1, len(pair))):
        near = of_line[shift:] == of_line[:-shift]
        np.minimum(lowest[shift:], np.where(near, pair[:-shift], NONE), out=lowest[shift:])
        np.minimum(lowest[:-shift], np.where(near, pair[shift:], NONE), out=lowest[:-shift])
    at = np.flatnonzero(head | ((pair == lowest) & same))
    short = np.diff(np.append(at, len(word))) < LEAST_PIECE
    after_head = np.append(False, (short & head[at])[:-1])
    cut = np.zeros(len(word), bool)
    cut[at[head[at] | ~(short | after_head)]] = True
    return cut


def _joined(head: np.ndarray, line: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The heads of lines without those of short lines that follow a short line with no blank line between."""
    at = np.flatnonzero(head)
    short = np.diff(np.append(at, len(head))) < LEAST
    on = short[1:] & short[:-1] & (row[at[1:]] == row[at[:-1]]) & (line[at[1:]] - line[at[:-1]] == 1)
    head = head.copy()
    head[at[1:][on]] = False
    return head


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, begin, end, first word, words, line, class, band keys) of the paragraphs of a slice.

    begin and end are slice positions, the first word counts in its row; line is the begin of the line
    that a piece was cut from, -1 for a whole line.
    """
    data = lower_ascii(data)
    start, end, row = words(data, offsets)
    if not len(start):
        none = np.empty(0, np.int64)
        return none, none, none, none, none, none, none, np.empty((0, BANDS), np.int64)
    word = RangeHash(data).of(start, end)
    line = np.searchsorted(np.flatnonzero(data == 0x0A), start)
    head = np.append(True, (line[1:] != line[:-1]) | (row[1:] != row[:-1]))
    head = _joined(head, line, row)
    of_line = np.cumsum(head) - 1
    size = np.bincount(of_line)
    heads = np.flatnonzero(head)
    whole = np.flatnonzero(size >= LEAST)
    cut = np.flatnonzero(_cuts(word, of_line, head))
    length = np.diff(np.append(cut, len(word)))
    piece = size[of_line[cut]] > LONG
    cut, length = cut[piece], length[piece]

    first = np.concatenate([heads[whole], cut])
    length = np.concatenate([size[whole], length])
    inside = np.concatenate([np.full(len(whole), -1), start[heads[of_line[cut]]]])
    if not len(first):
        return paragraphs(data[:0], np.zeros(1, np.int64))
    number = np.repeat(np.arange(len(first)), length)
    spot = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + first[number]
    word = word[spot]
    hashes, of = shingles(word, number, WIDTH)
    order = by_row(hashes, of)
    hashes, of = hashes[order], of[order]
    fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1]))
    hashes, of = hashes[fresh], of[fresh]
    at = np.searchsorted(of, np.arange(len(first)))
    kind = mix(np.add.reduceat(mix(hashes), at))
    low = signatures(hashes, at, BANDS * ROWS).astype(np.uint64)
    bands = np.empty((len(first), BANDS), np.uint64)
    for b in range(BANDS):
        key = mix(np.full(len(first), b + 1, np.uint64))
        for j in range(ROWS):
            key = mix(key ^ low[b * ROWS + j])
        bands[:, b] = key
    at = first - np.searchsorted(row, row[first])
    return row[first], start[first], end[first + length - 1], at, length, inside, kind.view(np.int64), bands.view(np.int64)


def _paragraph_rows(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for base, _, data, offsets in slices(batch.column("text")):
                row, begin, end, at, size, line, kind, bands = paragraphs(data, offsets)
                line = np.where(line < 0, line, line - offsets[row])
                bounds = pa.array(np.arange(len(row) + 1) * BANDS, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(row + base)),
                        *(pa.array(x) for x in (begin - offsets[row], end - offsets[row], at, size, line, kind)),
                        pa.ListArray.from_arrays(bounds, pa.array(bands.ravel())),
                    ],
                    ["doc_id", "begin", "end", "at", "n_words", "line", "class", "bands"],
                )

    schema = "doc_id bigint, begin bigint, end bigint, at bigint, n_words bigint, line bigint, class bigint, bands array<bigint>"
    return docs.mapInArrow(run, schema)


def _texts(spark: SparkSession, docs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, text): the text of one paragraph of each class, under the class's number."""
    one = narrowed(rows.select("class", "doc_id", "begin", "end"), classes, "class").join(classes, "class")
    one = stored(spark, one.dropDuplicates(["class"]), "paragraph-places")
    places = one.groupBy("doc_id").agg(F.collect_list(F.struct("class", "begin", "end")).alias("places"))
    texts = narrowed(documents(docs), one.select("doc_id").distinct(), "doc_id").join(places, "doc_id")

    def run(batches):
        for batch in batches:
            row, place = _flat(batch.column("places"))
            raw = [text.as_buffer() for text in batch.column("text")]
            spans = zip(row.tolist(), place.field("begin").to_pylist(), place.field("end").to_pylist())
            cut = [raw[r][a:b].to_pybytes().decode() for r, a, b in spans]
            yield pa.RecordBatch.from_arrays([place.field("class"), pa.array(cut, pa.string())], ["doc_id", "text"])

    made = stored(spark, texts.select("text", "places").mapInArrow(run, "doc_id bigint, text string"), "paragraph-texts")
    # a class comes twice only where rows repeat a doc_id
    return made if made.count() == one.count() else stored(spark, made.dropDuplicates(["doc_id"]), "paragraph-texts")


def _lost(windows: np.ndarray, row: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """How many words of each window lie in cuts."""
    change = np.zeros(len(row) + 1, np.int64)
    begin = np.searchsorted(row, cuts[0]) + cuts[1]
    np.add.at(change, begin, 1)
    np.add.at(change, begin + cuts[2], -1)
    sums = np.append(0, np.cumsum(np.cumsum(change[:-1]) > 0))
    return sums[windows + PASSAGE] - sums[windows]


def marks(data: np.ndarray, offsets: np.ndarray, cuts: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """(row, start, end, word, windows, mark, marked, cut) of a slice.

    Its words, where windows begin, their marks, the runs that are marks, and which windows lose words to
    the cuts (row, first word, words, line). Windows that lie in cut lines wholly are left out.
    """
    data = lower_ascii(data)
    start, end, row = words(data, offsets)
    word = RangeHash(data).of(start, end)
    n, reach = len(word), PASSAGE - RUN + 1
    if n < PASSAGE:
        none = np.empty(0, np.int64)
        return row, start, end, word, none, none.view(np.uint64), none, none.astype(bool)
    runs = run_hashes(word, RUN)
    windows = np.flatnonzero(row[: n - PASSAGE + 1] == row[PASSAGE - 1 :])
    lost, gone = (_lost(windows, row, [x[here] for x in cuts]) for here in (slice(None), cuts[3] < 0))
    windows, lost = windows[gone < PASSAGE], lost[gone < PASSAGE]
    least = np.lib.stride_tricks.sliding_window_view(runs, reach).min(axis=1)
    top = np.zeros(n + reach, np.uint64)
    top[windows + reach - 1] = least[windows]
    top = np.lib.stride_tricks.sliding_window_view(top, reach).max(axis=1)[: len(runs)]
    return row, start, end, word, windows, least[windows], np.flatnonzero(top == runs), lost > 0


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of an array of lists; a null list has no values."""
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    return np.repeat(np.arange(len(lists)), size), lists.flatten()


def _cut_words(lists: pa.Array) -> tuple[np.ndarray, ...]:
    row, cut = _flat(lists)
    return row, *(np.asarray(cut.field(x), np.int64) for x in ("at", "n_words", "line"))


def _of_slice(cuts: tuple[np.ndarray, ...], base: int, stop: int) -> tuple[np.ndarray, ...]:
    here = (cuts[0] >= base) & (cuts[0] < stop)
    return cuts[0][here] - base, *(x[here] for x in cuts[1:])


def _mark_rows(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            cuts = _cut_words(batch.column("cuts"))
            for base, stop, data, offsets in slices(batch.column("text")):
                row, _, _, word, windows, _, marked, _ = marks(data, offsets, _of_slice(cuts, base, stop))
                if len(windows):
                    ids = batch.column("doc_id").take(pa.array(row[marked] + base))
                    hashes = pa.array(run_hashes(word, RUN)[marked].view(np.int64))
                    yield pa.RecordBatch.from_arrays([ids, hashes], ["doc_id", "mark"])

    return docs.mapInArrow(run, "doc_id bigint, mark bigint")


def _windows(texts: DataFrame) -> DataFrame:
    """One row for each window whose mark is shared: its hash and place, and whether a removed paragraph takes words of it."""

    def run(batches):
        for batch in batches:
            mark_row, mark = _flat(batch.column("marks"))
            mark, cuts = np.asarray(mark, np.int64), _cut_words(batch.column("cuts"))
            for base, stop, data, offsets in slices(batch.column("text")):
                row, start, end, word, windows, least, _, cut = marks(data, offsets, _of_slice(cuts, base, stop))
                if not len(windows):
                    continue
                shared = np.isin(least, mark[(mark_row >= base) & (mark_row < stop)].view(np.uint64))
                windows, cut = windows[shared], cut[shared]
                first = np.searchsorted(row, np.arange(stop - base))
                of, last = row[windows], windows + PASSAGE - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(of + base)),
                        pa.array(run_hashes(word, PASSAGE)[windows].view(np.int64)),
                        pa.array(windows - first[of]),
                        pa.array(start[windows] - offsets[of]),
                        pa.array(end[last] - offsets[of]),
                        pa.array(cut),
                    ],
                    ["doc_id", "window", "at", "begin", "end", "cut"],
                )

    return texts.mapInArrow(run, "doc_id bigint, window bigint, at bigint, begin bigint, end bigint, cut boolean")


def gaps(spans: tuple[np.ndarray, ...], listed: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """(span, begin, end, words) of what of the spans lies outside the listed stretches of their rows.

    Both are (row, first word, word after the last, begin, end).
    """
    row, at, stop, begin, end = listed
    width = 1 + max(stop.max(initial=0), spans[2].max(initial=0))
    order = np.lexsort((at, row))
    at, stop, begin, end = (row * width + at)[order], (row * width + stop)[order], begin[order], end[order]
    # stretches that meet are one, which ends where the one that reaches furthest does
    reached = np.maximum.accumulate(stop)
    further = np.append(True, reached[1:] > reached[:-1])[: len(at)]
    furthest = np.maximum.accumulate(np.where(further, np.arange(len(at)), 0))
    head = np.flatnonzero(np.append(True, at[1:] > reached[:-1])[: len(at)])
    tail = furthest[np.append(head[1:], len(at))[: len(head)] - 1]
    at, begin, stop, end = at[head], begin[head], stop[tail], end[tail]

    own_at, own_stop = spans[0] * width + spans[1], spans[0] * width + spans[2]
    first = np.searchsorted(stop, own_at, "right")
    met = np.maximum(0, np.searchsorted(at, own_stop) - first)
    which = np.repeat(np.arange(len(met)), met + 1)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(met + 1) - met - 1, met + 1)
    after, before = turn > 0, turn < met[which]
    left, right = (first[which] + turn - 1)[after], (first[which] + turn)[before]
    out = own_at[which], own_stop[which], spans[3][which], spans[4][which]
    out[0][after], out[2][after] = stop[left], end[left]
    out[1][before], out[3][before] = at[right], begin[right]
    some = out[1] > out[0]
    return which[some], out[2][some], out[3][some], (out[1] - out[0])[some]


def _outside(spans: DataFrame) -> DataFrame:
    """What of a document's spans lies outside its paragraphs in ``listed``; what goes, outside those that go too."""

    def run(batches):
        for batch in batches:
            (row, span), (listed_row, listed) = (_flat(batch.column(c)) for c in ("spans", "listed"))
            own, known = (
                [x, *(np.asarray(cells.field(c), np.int64) for c in ("at", "stop", "begin", "end"))]
                for x, cells in ((row, span), (listed_row, listed))
            )
            goes, gone = (np.asarray(pc.cast(cells.field("removed"), pa.int8())) > 0 for cells in (span, listed))
            for here, there in ((~goes, slice(None)), (goes, gone)):
                which, begin, end, n_words = gaps(tuple(x[here] for x in own), tuple(x[there] for x in known))
                of = np.flatnonzero(here)[which]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(row[of])),
                        *(pa.array(x) for x in (begin, end, n_words)),
                        *(span.field(c).take(pa.array(of)) for c in ("component_id", "n_copies", "removed")),
                    ],
                    ["doc_id", "begin", "end", "n_words", "component_id", "n_copies", "removed"],
                )

    schema = "doc_id bigint, begin bigint, end bigint, n_words bigint, component_id bigint, n_copies bigint, removed boolean"
    return spans.mapInArrow(run, schema)


def _passages(spark: SparkSession, docs: DataFrame, listed: DataFrame) -> DataFrame:
    """Repeated passages of at least ``PASSAGE`` words, as far as they lie outside the listed paragraphs.

    Windows that lie in removed lines wholly are no occurrences: they go in any case. The one that stays is the first one that no removed paragraph takes words of, else the first.
    """
    cuts = listed.where("removed").groupBy("doc_id").agg(F.collect_set(F.struct("at", "n_words", "line")).alias("cuts"))
    texts = documents(docs).where("doc_id IS NOT NULL").join(small_side(stored(spark, cuts, "passage-cuts")), "doc_id", "left")
    rows = stored(spark, _mark_rows(texts), "passage-marks")
    shared = rows.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    wanted = rows.join(shared, "mark").groupBy("doc_id").agg(F.collect_set("mark").alias("marks"))
    wanted = stored(spark, wanted, "passage-wanted")
    texts = narrowed(texts, wanted.select("doc_id"), "doc_id").join(wanted, "doc_id")
    windows = stored(spark, _windows(texts), "passage-windows")
    firsts = windows.groupBy("window").agg(
        F.count("*").alias("n_copies"), F.min(F.struct("cut", "doc_id", "at", "begin", "end")).alias("first")
    )
    met = windows.join(firsts.where("n_copies > 1"), "window")
    own, last = F.col("doc_id") == F.col("first.doc_id"), F.col("at") + PASSAGE
    behind, before = own & (F.col("at") > F.col("first.at")), own & (F.col("at") < F.col("first.at"))
    met = met.select(
        "doc_id",
        F.when(behind, F.greatest("at", F.col("first.at") + PASSAGE)).otherwise(F.col("at")).alias("at"),
        F.when(before, F.least(last, F.col("first.at"))).otherwise(last).alias("stop"),
        F.when(behind, F.greatest("begin", "first.end")).otherwise(F.col("begin")).alias("begin"),
        F.when(before, F.least("end", "first.begin")).otherwise(F.col("end")).alias("end"),
        F.col("first.doc_id").alias("component_id"),
        "n_copies",
        (~own | behind | before).alias("removed"),
    )
    order = Window.partitionBy("doc_id", "component_id", "removed").orderBy("at", "stop")
    met = met.withColumn("reached", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    met = met.withColumn("span", F.count_if(F.col("at") > F.col("reached")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = met.groupBy("doc_id", "component_id", "removed", "span").agg(
        *[F.min(c).alias(c) for c in ("at", "begin")], *[F.max(c).alias(c) for c in ("stop", "end", "n_copies")]
    )
    spans = stored(spark, spans, "passage-spans")
    known = narrowed(listed, spans.select("doc_id").distinct(), "doc_id")
    stretch = F.struct("at", (F.col("at") + F.col("n_words")).alias("stop"), "begin", "end", "removed")
    known = known.groupBy("doc_id").agg(F.collect_set(stretch).alias("listed"))
    # a document's spans go together, so that its paragraphs are read once and not once for each of them
    own = F.struct("at", "stop", "begin", "end", "component_id", "n_copies", "removed")
    return _outside(spans.groupBy("doc_id").agg(F.collect_list(own).alias("spans")).join(known, "doc_id", "left"))


def repeated_paragraphs(spark: SparkSession, docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row for each paragraph or passage that occurs more than once: doc_id, begin, end, n_words, component_id, n_copies, removed.

    begin and end count bytes of the UTF-8 text. Lines of at least 20 words count, of any length, runs of
    shorter lines without a blank line between count as one line, and so do pieces of at least 10 words
    of lines of more than 48. A line or run of under 20 words is found as part of passages only. Two are linked when their sets of distinct
    five-word shingles, A-Z lower-cased, have a similarity of 0.8 or more; equal sets are one class whatever
    their number. Of a connected component the first whole line by doc_id and place stays, or else the
    first piece whose line stays, the others are marked as removed; component_id is the doc_id of what
    stays. Pieces of removed lines are not listed.

    Runs of over 50 words that occur again word for word, A-Z lower-cased, are listed as passages as far as
    they lie outside these paragraphs: what repeats an earlier one as removed, under that one's doc_id. A
    passage can lie inside a paragraph that stays. Places that lie in removed lines wholly do not count
    as occurrences. n_copies is that of its most frequent 51 words.

    Null and empty texts have no paragraphs; rows without a doc_id are left out; rows that repeat a doc_id
    hold the same paragraphs twice and both rows are listed, passages once. An empty table gives no rows.
    Columns besides doc_id and text are ignored.
    """
    rows = stored(spark, _paragraph_rows(documents(docs).where("doc_id IS NOT NULL")), "paragraph-rows")
    # One shuffle of narrow rows; most bands have one class, so an aggregate before it would combine little.
    buckets = rows.select("class", F.explode("bands").alias("band"))
    buckets = buckets.withColumn("a", F.min("class").over(Window.partitionBy("band")))
    first = buckets.where("class <> a").select("a", F.col("class").alias("b")).distinct()
    first = stored(spark, first, "paragraph-first")
    # the bands are most of the bytes and have done their work
    banded, rows = rows, stored(spark, rows.drop("bands"), "paragraph-lines")
    dropped(spark, banded)
    classes = first.select(F.col("a").alias("class")).union(first.select(F.col("b").alias("class"))).distinct()
    texts = _texts(spark, docs, rows, stored(spark, classes, "paragraph-classes"))
    links = stored(spark, confirmed(first, texts, WIDTH, percent), "paragraph-links")
    roots = stored(spark, components(spark, links, "paragraph-one"), "paragraph-roots")
    more = stored(spark, unsettled(spark, first, roots, texts, WIDTH, percent), "paragraph-more")
    roots = stored(spark, components(spark, links.union(more), "paragraph-all"), "paragraph-final")
    dropped(spark, texts, first)

    counted = rows.groupBy("class").agg(F.count("*").alias("n"))
    named = counted.join(roots.withColumnRenamed("id", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = stored(spark, named, "paragraph-named")
    groups = named.groupBy("root").agg(F.sum("n").alias("n")).where("n > 1").select("root")
    kept = named.join(groups, "root").select("class", "root")
    found = rows.select("doc_id", "begin", "end", "at", "n_words", "line", "class").join(kept, "class")
    found = stored(spark, found, "paragraph-found")
    dropped(spark, rows, named)
    # a piece close to the very line that it was cut from is no copy of it
    own = found.where("line < 0").select("doc_id", F.col("begin").alias("line"), "root")
    found = found.join(own, ["doc_id", "line", "root"], "left_anti")
    copies = found.groupBy("root").agg(F.count("*").alias("n_copies")).where("n_copies > 1")
    found = stored(spark, found.join(copies, "root"), "paragraph-copies")

    place = (F.col("doc_id") != F.col("stay.doc_id")) | (F.col("begin") != F.col("stay.begin"))
    whole = found.where("line < 0")
    first = whole.groupBy("root").agg(F.min(F.struct("doc_id", "begin")).alias("stay"))
    gone = whole.join(first, "root").where(place).select("doc_id", F.col("begin").alias("line"), F.lit(True).alias("gone")).distinct()
    found = found.join(gone, ["doc_id", "line"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    found = stored(spark, found, "paragraph-placed")
    rank = F.struct((F.col("line") >= 0).alias("piece"), "gone", "doc_id", "begin")
    stays = found.groupBy("root").agg(F.min(rank).alias("stay"))
    listed = found.where("NOT gone").join(stays, "root").select(
        "doc_id",
        "begin",
        "end",
        "at",
        "n_words",
        "line",
        F.col("stay.doc_id").alias("component_id"),
        "n_copies",
        (place | (F.col("stay.piece") != (F.col("line") >= 0))).alias("removed"),
    )
    listed = stored(spark, listed, "paragraph-listed")
    return listed.drop("at", "line").unionByName(_passages(spark, docs, listed))


def remove_paragraphs(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text) without the paragraphs and passages marked as removed; other documents as they are."""
    cuts = found.where("removed").groupBy("doc_id").agg(F.collect_set(F.struct("begin", "end")).alias("cuts"))
    rows = documents(docs).join(cuts, "doc_id", "left")

    def run(batches):
        for batch in batches:
            out = []
            for text, cut in zip(batch.column("text"), batch.column("cuts").to_pylist()):
                raw, done, parts = text.as_buffer().to_pybytes(), 0, []
                for begin, end in sorted((c["begin"], c["end"]) for c in cut or ()):
                    parts.append(raw[done:begin])
                    done = max(done, end)
                out.append(b"".join([*parts, raw[done:]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id bigint, text string")
