"""Streams that arrive in pieces, out of order, twice, or after a crash equal their batch form."""

from __future__ import annotations

import os
from functools import partialmethod

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.operators import correlate, memory, spans, usage
from caseflow.plans import mapping
from caseflow.sources import notifications
from caseflow.streaming import jobs, nearest, tables
from tests.conftest import SMALL

HOUR = 3_600_000_000
FILES = 6


@pytest.fixture(scope="module")
def pieces():
    """The events in six files; rows are shuffled and up to ten hours late."""
    events = pq.read_table(f"{SMALL}/events.parquet")
    us = events["ts"].cast(pa.timestamp("us")).cast(pa.int64()).to_numpy()
    rng = np.random.default_rng(5)
    arrival = us + rng.integers(0, 10 * HOUR, len(us))
    edges = np.linspace(arrival.min(), arrival.max() + 1, FILES + 1)
    out = []
    for i in range(FILES):
        index = np.flatnonzero((arrival >= edges[i]) & (arrival < edges[i + 1]))
        rng.shuffle(index)
        out.append(events.take(pa.array(index)))
    assert sum(p.num_rows for p in out) == events.num_rows
    return out


def deliver(folder, parts, start=0):
    for i, part in enumerate(parts, start):
        pq.write_table(part, folder / f"{i:03d}.parquet")


def in_two_runs(spark, tmp_path, pieces, run):
    """Run on the first files, then again from the checkpoint on all of them, a file at a time."""
    source = tmp_path / "source"
    source.mkdir()
    deliver(source, pieces[:3])
    run(tables.stream_files(spark, str(source), max_files=1), str(tmp_path / "out")).collect()
    deliver(source, pieces[3:], 3)
    return run(tables.stream_files(spark, str(source), max_files=1), str(tmp_path / "out"))


def same(got, want):
    names = sorted(want.columns)
    a = sorted(map(str, got.select(*names).collect()))
    b = sorted(map(str, want.select(*names).collect()))
    assert a == b
    assert a


SLOT = 3 * 24 * HOUR


def test_velocity(spark, tmp_path, pieces):
    places = mapping.locations(spark, SMALL)
    got = in_two_runs(
        spark, tmp_path, pieces,
        lambda s, path: jobs.stream_velocity(
            spark, mapping.signals_from(s), places, path, delay_minutes=720, slot_us=SLOT, hot_rows=20),
    )
    same(got, correlate.velocity_alerts(mapping.signals(spark, SMALL), places))
    # Rows are answered as time passes, each exactly once; only the last ones wait in the state.
    versions = spark.read.parquet(f"{tmp_path}/out/rows")
    assert versions.filter("kind <> 'answer'").count() == 0
    assert versions.count() == versions.select("body").distinct().count() > 800
    assert versions.select("batch_id").distinct().count() > 3


def one_after_the_other(folder, parts):
    """Files whose times of change differ."""
    folder.mkdir()
    deliver(folder, parts)
    for i in range(len(parts)):
        os.utime(folder / f"{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def test_files_of_one_clock_tick_are_taken_up_by_name(spark, tmp_path):
    """In any other order the rows of the earlier ones would come late."""
    for i in range(12):
        pq.write_table(pa.table({"n": [i]}), tmp_path / f"{i:03d}.parquet")
        os.utime(tmp_path / f"{i:03d}.parquet", (1_700_000_000, 1_700_000_000))
    got = []
    tables.run_available(
        tables.stream_files(spark, str(tmp_path), max_files=1), str(tmp_path / "out"), "append", lambda batch, _: got.append(batch.first().n))
    assert got == list(range(12))


@pytest.mark.parametrize("few", [0, 5])
def test_many_keys_share_one_state(spark, tmp_path, pieces, monkeypatch, few):
    """One entry of the state holds many keys, in blocks and row by row, and gives what one for each key gives."""
    monkeypatch.setattr(nearest.Spec, "__init__", partialmethod(nearest.Spec.__init__, shares=3))
    monkeypatch.setattr(nearest, "FEW_ROWS", few)
    monkeypatch.setattr(nearest, "PACK_BYTES", 500)
    source = tables.stream_files(spark, one_after_the_other(tmp_path / "source", pieces), max_files=1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = jobs.stream_span_pairs(spark, mapping.spans_from(source), str(tmp_path / "out"), 3000, delay_minutes=720, slot_us=SLOT, hot_rows=20)
        same(got, spans.span_pairs(mapping.spans(spark, SMALL), 3000))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    keys = spark.read.format("statestore").option("path", f"{tmp_path}/out/checkpoint").option("stateVarName", "waiting").load()
    assert {r[0] for r in keys.select("key.share").distinct().collect()} == {0, 1, 2}


def test_replies_of_one_time_go_by_kind_and_id(spark, tmp_path, monkeypatch):
    """Many rows of few times, in two batches; rows without a time or behind the watermark are listed."""
    monkeypatch.setattr(nearest, "FEW_ROWS", 3)
    n = 400
    at = [(1_000 + i // 200 * 500 + i * 7 % 5 * 10) * 60_000_000 for i in range(n)]
    at[:4] = [None] * 4
    at[396:] = [60_000_000] * 4
    events = pa.table({
        "event_id": [i * 13 % n for i in range(n)], "ts": pa.array(at, pa.timestamp("us")),
        "user_id": pa.array([None if i % 11 == 0 else i % 3 for i in range(n)], pa.int64()),
        "event_type": ["signup" if i % 2 else "click" for i in range(n)], "value": [1.0] * n, "props": [f'{{"k": {i % 7}}}' for i in range(n)],
    })
    source = one_after_the_other(tmp_path / "source", [events.slice(0, 200), events.slice(200)])
    stream = tables.stream_files(spark, source, max_files=1)
    challenges, replies = mapping.challenges_from(stream), mapping.replies_from(stream)
    got = jobs.stream_step_up(spark, challenges, replies, str(tmp_path / "out"))
    pq.write_table(events.slice(4, 392), tmp_path / "taken.parquet")
    taken = spark.read.parquet(str(tmp_path / "taken.parquet"))
    same(got, correlate.step_up_audit(mapping.challenges_from(taken), mapping.replies_from(taken)))
    lost = jobs.rejected_answers(spark, challenges, replies, str(tmp_path / "out")).select("_id", "reason").collect()
    ids = events["event_id"].to_pylist()
    assert sorted(map(tuple, lost)) == sorted([(i, "no time") for i in ids[:4]] + [(i, "late") for i in ids[396:]])


def test_rows_later_than_the_delay_are_listed(spark, tmp_path, pieces):
    """Nothing is lost: a row is answered, waits, or is listed as late."""
    places = mapping.locations(spark, SMALL)
    signals = mapping.signals(spark, SMALL)
    in_two_runs(
        spark, tmp_path, pieces,
        lambda s, path: jobs.stream_velocity(spark, mapping.signals_from(s), places, path, delay_minutes=1),
    )
    late = jobs.rejected_signals(spark, signals, f"{tmp_path}/out")
    assert {r.reason for r in late.collect()} == {"late"}
    taken = spark.read.parquet(f"{tmp_path}/out/rows").filter("kind = 'answer'")
    taken = taken.select(F.get_json_object("body", "$.signal_id").cast("long").alias("signal_id"))
    state = spark.read.format("statestore").option("path", f"{tmp_path}/out/checkpoint").option("stateVarName", "waiting").load()
    waits = state.select(F.get_json_object("list_element.body", "$.signal_id").cast("long").alias("signal_id"))
    everything = late.select("signal_id").unionByName(taken).unionByName(waits)
    assert everything.count() == everything.distinct().count() == 1000


def test_what_is_not_late_is_answered_as_if_the_late_rows_never_came(spark, tmp_path, pieces):
    places = mapping.locations(spark, SMALL)
    got = in_two_runs(
        spark, tmp_path, pieces,
        lambda s, path: jobs.stream_velocity(spark, mapping.signals_from(s), places, path, delay_minutes=1),
    )
    signals = mapping.signals(spark, SMALL)
    late = jobs.rejected_signals(spark, signals, f"{tmp_path}/out").select("signal_id")
    same(got, correlate.velocity_alerts(signals.join(late, "signal_id", "left_anti"), places))


def test_rows_without_a_time_are_listed_in_every_batch(spark, tmp_path, pieces):
    """Two batches with such rows, some of them alike."""
    source = tmp_path / "source"
    source.mkdir()
    timeless = []
    for part in pieces[:3]:
        own = part.slice(0, 4).set_column(1, "ts", pa.nulls(4, part.schema.field("ts").type))
        timeless += own.column("event_id").to_pylist() * 2
        pq.write_table(pa.concat_tables([part, own, own]), source / f"{len(timeless):03d}.parquet")
    places = mapping.locations(spark, SMALL)
    signals = mapping.signals_from(tables.stream_files(spark, str(source), max_files=1))
    got = jobs.stream_velocity(spark, signals, places, str(tmp_path / "out"), delay_minutes=720)
    want = spark.read.parquet(str(source)).where("ts is not null")
    same(got, correlate.velocity_alerts(mapping.signals_from(want), places))
    lost = jobs.rejected_signals(spark, signals, str(tmp_path / "out")).collect()
    assert sorted(r.signal_id for r in lost) == sorted(timeless)
    assert {r.reason for r in lost} == {"no time"}


def test_missing_and_equal_keys_and_times(spark, tmp_path):
    """A key without a value is a key; equal times go by id, ids beyond a double's digits included."""
    big = 2**53
    rows = [(big + i, pa_time, None if i % 3 == 0 else i % 2, "click", 1.0, f'{{"k": {i % 7}}}') for i, pa_time in enumerate([5, 5, 5, 9, 9, 1, 1, 70, 70, 70, 71, 71] * 3)]
    table = pa.table({
        "event_id": pa.array([r[0] for r in rows]), "ts": pa.array([r[1] * 60_000_000 for r in rows], pa.timestamp("us")),
        "user_id": pa.array([r[2] for r in rows], pa.int64()), "event_type": [r[3] for r in rows], "value": [r[4] for r in rows], "props": [r[5] for r in rows],
    })
    source = tmp_path / "source"
    source.mkdir()
    pq.write_table(table, source / "0.parquet")
    places = mapping.locations(spark, SMALL)
    got = jobs.stream_velocity(
        spark, mapping.signals_from(tables.stream_files(spark, str(source))), places, str(tmp_path / "out"), 1.0, 500.0, delay_minutes=0, slot_us=1)
    same(got, correlate.velocity_alerts(mapping.signals_from(spark.read.parquet(str(source))), places, 1.0, 500.0))


def test_step_up(spark, tmp_path, pieces):
    got = in_two_runs(
        spark, tmp_path, pieces,
        lambda s, path: jobs.stream_step_up(
            spark, mapping.challenges_from(s), mapping.replies_from(s), path, 300, delay_minutes=720, slot_us=SLOT, hot_rows=20),
    )
    same(got, correlate.step_up_audit(mapping.challenges(spark, SMALL), mapping.replies(spark, SMALL), 300))


def test_span_pairs(spark, tmp_path, pieces):
    got = in_two_runs(
        spark, tmp_path, pieces,
        lambda s, path: jobs.stream_span_pairs(spark, mapping.spans_from(s), path, 3000, delay_minutes=720, slot_us=SLOT, hot_rows=20),
    )
    same(got, spans.span_pairs(mapping.spans(spark, SMALL), 3000))


def test_an_open_start_is_answered_once_by_its_timer(spark, tmp_path):
    """No completion comes; the answer is there when the watermark passes the timeout, and not again."""
    source = tmp_path / "source"
    source.mkdir()
    minute = 60_000_000

    def batch(name, rows):
        columns = list(zip(*rows))
        pq.write_table(pa.table({
            "span_id": pa.array(columns[0]), "session_id": pa.array([1] * len(rows)), "span_type": list(columns[1]), "name": list(columns[2]),
            "ts": pa.array([t * minute for t in columns[3]], pa.timestamp("us")),
        }), source / f"{name}.parquet")

    def answers():
        jobs.stream_span_pairs(spark, tables.stream_files(spark, str(source), max_files=1), str(tmp_path / "out"), 10, delay_minutes=0)
        rows = spark.read.parquet(f"{tmp_path}/out/rows").collect()
        return [(r.batch_id, r.next) for r in rows if '"span_id":1,' in r.body]

    batch("0", [(1, "START", "a", 100), (2, "START", "b", 105)])
    assert answers() == []
    batch("1", [(3, "START", "c", 109)])
    assert answers() == []
    batch("2", [(4, "COMPLETE", "c", 111)])
    first = answers()
    assert [x[1] for x in first] == [None]
    batch("3", [(5, "COMPLETE", "a", 300)])
    assert answers() == first


@pytest.mark.parametrize("width, slide", [("1 day", None), ("6 hours", "2 hours")])
def test_usage_windows(spark, tmp_path, pieces, width, slide):
    got = in_two_runs(
        spark, tmp_path, pieces,
        lambda s, path: jobs.stream_usage(spark, mapping.signals_from(s), path, width, slide, delay_minutes=720),
    )
    same(got, jobs.usage_windows(mapping.signals(spark, SMALL), width, slide))


def test_sessions(spark, tmp_path, pieces):
    got = in_two_runs(
        spark, tmp_path, pieces, lambda s, path: jobs.stream_sessions(spark, mapping.signals_from(s), path, 600)
    )
    same(got, usage.sessions(usage.session_records(mapping.signals(spark, SMALL)), 600))


def test_compaction(spark, tmp_path, pieces):
    people = mapping.customers(spark, SMALL)
    got = in_two_runs(
        spark, tmp_path, pieces,
        lambda s, path: jobs.stream_compaction(spark, people, mapping.event_fragments_from(s), path),
    )
    same(got, memory.compact_memory(people, mapping.event_fragments(spark, SMALL)))


def document_pieces():
    """The documents in four files; every second one comes again in the next file."""
    docs = pq.read_table(f"{SMALL}/documents.parquet")
    n = docs.num_rows // 4
    parts = []
    for i in range(4):
        own = docs.slice(i * n, n if i < 3 else None)
        again = docs.slice((i - 1) * n, n) if i else docs.slice(0, 0)
        again = again.take(pa.array(np.arange(0, again.num_rows, 2)))
        parts.append(pa.concat_tables([own, again]))
    return parts


def test_ingest_stores_each_object_once(spark, tmp_path):
    objects = mapping.stored_objects(spark, SMALL)
    now = F.lit(mapping.NOW)

    def run(stream, path):
        metadata, rejected = jobs.stream_ingest(
            spark, mapping.notifications_from(stream), objects, path, mapping.TAG_WORDS, now)
        return metadata

    got = in_two_runs(spark, tmp_path, document_pieces(), run)
    usable, _ = notifications.decode_notifications(mapping.notifications(spark, SMALL))
    contents = notifications.attach_content(notifications.one_per_object(usable), objects)
    same(got, notifications.metadata_rows(contents, mapping.TAG_WORDS, now))


def test_redeliveries_are_stored_once_whatever_is_missing(spark, tmp_path):
    """The same four notifications in two batches: no generation, no time, an empty time, a garbage time."""
    import base64
    import json

    bodies = [
        {"bucket": "b", "name": "1", "timeCreated": "2026-01-02T00:00:00Z"},
        {"bucket": "b", "name": "2", "timeCreated": "", "generation": "1"},
        {"bucket": "b", "name": "3", "generation": "1"},
        {"bucket": "b", "name": "4", "timeCreated": "what ever this is", "generation": "1"},
    ]
    raw = [json.dumps({"message": {"data": base64.b64encode(json.dumps(b).encode()).decode()}}) for b in bodies]
    source = tmp_path / "source"
    source.mkdir()
    deliver(source, [pa.table({"raw": raw}), pa.table({"raw": raw[::-1]})])
    objects = spark.createDataFrame([("b", str(i), "text") for i in range(1, 5)], "bucket string, name string, content string")
    stream = tables.stream_files(spark, str(source), max_files=1)
    metadata, rejected = jobs.stream_ingest(spark, stream, objects, str(tmp_path / "out"), now=F.lit("NOW"))
    assert sorted((r.filename, r.date) for r in metadata.collect()) == [
        ("1", "2026-01-02T00:00:00Z"), ("2", "NOW"), ("3", "NOW"), ("4", "what ever this is")]
    assert rejected.count() == 0


def test_a_crash_after_the_write_doubles_nothing(spark, tmp_path, pieces, monkeypatch):
    source = tmp_path / "source"
    source.mkdir()
    deliver(source, pieces)
    write = tables.write_version
    crashed = []

    def write_then_crash(batch, batch_id, path, partitions=()):
        write(batch, batch_id, path, partitions)
        if batch_id == 2 and not crashed:
            crashed.append(batch_id)
            raise RuntimeError("lost after the write")

    monkeypatch.setattr(tables, "write_version", write_then_crash)
    people = mapping.customers(spark, SMALL)

    def run():
        stream = mapping.event_fragments_from(tables.stream_files(spark, str(source), max_files=1))
        return jobs.stream_compaction(spark, people, stream, str(tmp_path / "out"))

    with pytest.raises(Exception, match="lost after the write"):
        run()
    same(run(), memory.compact_memory(people, mapping.event_fragments(spark, SMALL)))
    assert crashed


def faulty_pieces(pieces):
    """The pieces, the first of them once more at the end without its times, and as it was."""
    early = pieces[0]
    place = early.schema.get_field_index("ts")
    timeless = early.set_column(place, early.schema.field("ts"), pa.nulls(len(early), early.schema.field("ts").type))
    return [*pieces, timeless, early]


def test_usage_totals_count_late_and_timeless_rows(spark, tmp_path, pieces):
    parts = faulty_pieces(pieces)

    def run(stream, path):
        return jobs.stream_usage_totals(spark, mapping.signals_from(stream), path)

    got = {tuple(r) for r in in_two_runs(spark, tmp_path, parts, run).collect()}
    whole = tmp_path / "whole"
    whole.mkdir()
    deliver(whole, parts)
    signals = mapping.signals_from(spark.read.parquet(str(whole)))
    windows = jobs.usage_windows(signals)
    assert {r for r in got if r[0] is not None} == {tuple(r) for r in windows.collect()}
    timeless = signals.where("ts IS NULL").groupBy("channel").agg(*jobs.usage_counts())
    assert {r[2:] for r in got if r[0] is None} == {tuple(r) for r in timeless.collect()}
    assert sum(r[3] for r in got) == sum(len(p) for p in parts)


def test_usage_totals_of_nothing(spark, tmp_path):
    (tmp_path / "source").mkdir()
    deliver(tmp_path / "source", [pa.table({
        "customer_id": pa.array([], pa.int64()), "channel": pa.array([], pa.string()), "ts": pa.array([], pa.timestamp("us")),
        "amount": pa.array([], pa.float64())})])
    stream = tables.stream_files(spark, str(tmp_path / "source"))
    assert jobs.stream_usage_totals(spark, stream, str(tmp_path / "out")).count() == 0


def snapshot_files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet") if "checkpoint" not in str(p)}


def test_snapshot_is_replaced_bucket_by_bucket(spark, tmp_path, pieces):
    def run(stream, path):
        return jobs.stream_compacted_memory(spark, mapping.event_fragments_from(stream), path, 4)

    got = in_two_runs(spark, tmp_path, pieces, run)
    fragments = mapping.event_fragments(spark, SMALL)
    report = memory.compact_memory(fragments.select("customer_id").distinct(), fragments)
    same(got, memory.compacted_fragments(report))
    assert got.count() == got.select("customer_id").distinct().count() == fragments.select("customer_id").distinct().count()


def fragment_table(customers, start=0):
    import datetime as dt

    n = len(customers)
    return pa.table({
        "fragment_id": list(range(start, start + n)), "customer_id": pa.array(customers, pa.string()), "channel": ["web"] * n,
        "ts": pa.array([dt.datetime(2026, 1, 1 + (start + i) % 20) for i in range(n)], pa.timestamp("us")),
        "summary": [f"line {start + i}" for i in range(n)], "severity": ["LOW"] * n, "is_compacted_summary": [False] * n})


def test_a_batch_reads_and_writes_only_its_customers_buckets(spark, tmp_path):
    """Text keys; the second batch has one customer, the third none, and the same input again changes nothing."""
    source, out = tmp_path / "source", tmp_path / "out"
    source.mkdir()
    people = [f"c{i}" for i in range(40)]

    def run():
        stream = tables.stream_files(spark, str(source), max_files=1)
        return jobs.stream_compacted_memory(spark, stream, str(out), 8)

    deliver(source, [fragment_table(people)])
    assert run().count() == 40
    before = tables.named_buckets(spark, str(out))
    assert set(before.values()) == {0} and len(before) > 4
    deliver(source, [fragment_table(["c7"], 119), fragment_table([None], 200)], 1)
    assert {r.customer_id: r.summary for r in run().collect()} == {
        p: "[web] line 119" if p == "c7" else f"[web] line {i}" for i, p in enumerate(people)}
    after = tables.named_buckets(spark, str(out))
    assert sorted(after.values())[-1] == 1 and sum(after[b] != before[b] for b in before) == 1
    files = snapshot_files(out)
    run()
    assert snapshot_files(out) == files


def test_a_snapshot_that_was_not_named_is_not_read(spark, tmp_path, monkeypatch):
    """A batch is lost before its pointer is written, and once after; tried again it gives the same rows."""
    source, out = tmp_path / "source", tmp_path / "out"
    source.mkdir()
    name, lost = tables.name_buckets, []

    def lose(session, buckets, batch_id, path):
        if batch_id == 1 and not lost:
            lost.append("before")
            raise RuntimeError("lost before the pointer")
        name(session, buckets, batch_id, path)
        if batch_id == 1 and len(lost) == 1:
            lost.append("after")
            raise RuntimeError("lost after the pointer")

    monkeypatch.setattr(tables, "name_buckets", lose)
    deliver(source, [fragment_table(["a", "b"]), fragment_table(["a"], 5)])

    def run():
        return jobs.stream_compacted_memory(spark, tables.stream_files(spark, str(source), max_files=1), str(out), 4)

    def digests():
        shape = T.StructType([T.StructField("customer_id", T.StringType()), T.StructField("fragments", T.LongType())])
        rows = tables.read_buckets(spark, f"{out}/digests", shape, tables.named_buckets(spark, str(out)))
        return {r[0]: r[1] for r in rows.collect()}

    with pytest.raises(Exception, match="lost before"):
        run()
    assert digests() == {"a": 1, "b": 1}
    with pytest.raises(Exception, match="lost after"):
        run()
    assert digests() == {"a": 2, "b": 1}
    assert run().count() == 2
    assert digests() == {"a": 2, "b": 1}


def test_undated_notifications_are_looked_up_by_bucket(spark, tmp_path):
    """Sixty notifications without a date, delivered in two batches: dealt over partitions, each stored once."""
    import base64
    import json

    bodies = [{"bucket": "b", "name": str(i), "generation": "1"} for i in range(60)]
    raw = [json.dumps({"message": {"data": base64.b64encode(json.dumps(b).encode()).decode()}}) for b in bodies]
    (tmp_path / "source").mkdir()
    deliver(tmp_path / "source", [pa.table({"raw": raw}), pa.table({"raw": raw[:30]})])
    objects = spark.createDataFrame([], "bucket string, name string, content string")
    stream = tables.stream_files(spark, str(tmp_path / "source"), max_files=1)
    jobs.stream_ingest(spark, stream, objects, str(tmp_path / "out"), now=F.lit("NOW"), undated_buckets=8)
    seen = spark.read.parquet(str(tmp_path / "out" / "seen" / "rows"))
    days = {r[0]: r[1] for r in seen.groupBy("created_day").count().collect()}
    assert sum(days.values()) == 60 == seen.select("object_key").distinct().count()
    assert 5 <= len(days) <= 8 and all(d.startswith("undated-") for d in days) and max(days.values()) < 30


@pytest.mark.parametrize("layout", ["file", "folder", "one file in a folder", "partitioned"])
def test_a_table_is_streamed_from_a_file_or_a_folder(spark, tmp_path, layout):
    """Other tables lie beside it, a folder among them."""
    rows = pa.table({"n": list(range(10)), "lang": ["en", "de"] * 5})
    pq.write_table(rows, tmp_path / "other.parquet")
    (tmp_path / "more.parquet").mkdir()
    pq.write_table(rows, tmp_path / "more.parquet" / "part-0.parquet")
    at = tmp_path / "things.parquet"
    if layout == "partitioned":
        pq.write_to_dataset(rows, at, partition_cols=["lang"])
    elif layout == "file":
        pq.write_table(rows, at)
    else:
        at.mkdir()
        cuts = [0, 10] if layout == "one file in a folder" else [0, 4, 10]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            pq.write_table(rows.slice(a, b - a), at / ("things.parquet" if len(cuts) == 2 else f"part-{i}.parquet"))
    tables.run_available(tables.stream_table(spark, f"{tmp_path}/", "things"), str(tmp_path / "out"), "append")
    got = spark.read.parquet(f"{tmp_path}/out/rows").collect()
    assert sorted((r.n, r.lang) for r in got) == sorted(zip(*rows.to_pydict().values()))


def test_ingest_reads_documents_in_a_folder(spark, tmp_path):
    from caseflow.plans import streams

    docs = pq.read_table(f"{SMALL}/documents.parquet")
    (tmp_path / "documents.parquet").mkdir()
    half = docs.num_rows // 2
    for i, part in enumerate([docs.slice(0, half), docs.slice(half)]):
        pq.write_table(part, tmp_path / "documents.parquet" / f"part-{i}.parquet")
    for query in (streams.stream_ingest, streams.stream_rejects):
        same(query(spark, str(tmp_path)), query(spark, SMALL))
