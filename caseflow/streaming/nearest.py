"""The nearest earlier and later rows of each row, on a stream, kept in the engine's keyed state.

Keys are dealt to a fixed number of shares by hash, and rows go by share and time slot. A share is one key of
the engine's state and holds many keys' rows, since a call of the state costs far more than a row of it. A
key with a third of all rows is spread over its slots. What a slot needs from its neighbours is handed on
with the rows: one that lies within reach of a slot's edge goes to the next slot as well, as context that is
not answered there. Every slot can so be judged alone.

The rows that a task reads for one share and slot travel as one block, an Arrow stream, and a block is one
entry of the state's list. A handler sees columns, not rows.

A row waits until the watermark passes its time; then its place in the order is final. It is answered as
soon as the row looked for is final too, or when an event-time timer fires at the end of its reach. Each row
is answered once. Rows that come behind the watermark, and rows without a time, are output as such.

The rows still waiting when the input ends are read from the state store and answered, by the batch
operator, with what is known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators.ordered import HOT_ROWS, Running, running
from caseflow.streaming import tables

MINUTE_US = 60_000_000
DAY_US = 24 * 60 * MINUTE_US
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ANSWER, LATE, NO_TIME = "answer", "late", "no time"
# Fixed for a checkpoint's life. A share's slot is in memory as a whole when its timer fires.
SHARES = 256
# Up to this many rows are kept one by one, more as a block.
FEW_ROWS = 64
# A task packs what it has read when it comes to this many bytes.
PACK_BYTES = 64_000_000

_ROW = "us bigint, asks boolean, before boolean, after boolean, body string, who string"
_HELD = "us bigint, body string, prev string, who string, is_open boolean"
_GROUP = ["share", "slot"]
_OUT = "kind string, us bigint, body string, prev string, next string"


@dataclass(frozen=True)
class Spec:
    """What is looked for.

    ``order`` is the time in microseconds and further columns. ``asks`` marks the rows to answer, ``before`` and
    ``after`` those that may be found as the row before and the row after; reaches say how far off a
    partner may be.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    asks: Column
    before: Column
    after: Column
    reach_before_us: int = 0
    reach_after_us: int = 0
    delay_us: int = 60 * MINUTE_US
    slot_us: int = 32 * DAY_US
    shares: int = SHARES

    @property
    def width(self) -> int:
        """No slot is narrower than a reach, so only neighbouring slots share rows."""
        return max(self.slot_us, self.reach_before_us, self.reach_after_us, 1)


def _dealt(rows: DataFrame, spec: Spec) -> DataFrame:
    """Each row under its slot, and under the neighbouring ones that can see it."""
    us, width = F.col(spec.order[0]), spec.width
    slot = F.call_function("div", us - F.pmod(us, F.lit(width)), F.lit(width))
    later = F.when(spec.before & ((slot + 1) * width - us <= spec.reach_before_us), slot + 1)
    earlier = F.when(spec.after & (us - slot * width < spec.reach_after_us), slot - 1)
    # Rows without a time keep no state, and one key may have very many of them: they go by the whole row.
    keys = [F.col(k).cast("string") for k in spec.keys]
    share = F.pmod(F.when(us.isNull(), F.xxhash64(*rows.columns)).otherwise(F.xxhash64(*keys)), F.lit(spec.shares))
    slots = F.when(us.isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.array_compact(F.array(slot, later, earlier)))
    body = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    keyed = rows.select(
        share.alias("share"), us.alias("us"), spec.asks.alias("asks"), spec.before.alias("before"), spec.after.alias("after"),
        body.alias("body"), F.to_json(F.array(*keys)).alias("who"), slot.alias("home_slot"), F.explode(slots).alias("slot"),
    )
    home = F.coalesce(F.col("slot") == F.col("home_slot"), F.lit(True))
    dealt = keyed.withColumn("home", home).withColumn("asks", F.col("asks") & home).drop("home_slot")
    return dealt.mapInArrow(_packer(PACK_BYTES), "share bigint, slot bigint, block binary")


def _blocks():
    """Functions to write a table as a block and to read it; made here, so they go to the workers by value."""
    import pyarrow as pa

    def write(table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()

    def read(block: bytes):
        return pa.ipc.open_stream(pa.py_buffer(bytes(block))).read_all()

    return write, read


def _packer(limit: int):
    """Makes one block of the rows that a task has for each share and slot."""
    import numpy as np
    import pyarrow as pa

    write, _ = _blocks()

    def packed(batches: list):
        table = pa.Table.from_batches(batches).sort_by([("share", "ascending"), ("slot", "ascending")])
        share, slot = (table[c].to_numpy() for c in ("share", "slot"))
        starts = np.flatnonzero(np.r_[True, (share[1:] != share[:-1]) | (slot[1:] != slot[:-1])])
        rows = table.drop_columns(["share", "slot"]).combine_chunks()
        blocks = [write(rows.slice(i, j - i)) for i, j in zip(starts, [*starts[1:], len(share)])]
        arrays = [pa.array(share[starts]), pa.array(slot[starts]), pa.array(blocks, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["share", "slot", "block"])

    def pack(batches: Iterator) -> Iterator:
        taken, size = [], 0
        for batch in batches:
            if batch.num_rows:
                taken.append(batch)
                size += batch.nbytes
            if size >= limit:
                yield packed(taken)
                taken, size = [], 0
        if taken:
            yield packed(taken)

    return pack


def _unpacker(columns: list[str]):
    """Gives the rows of the state's entries, single ones and those in blocks, each with its slot."""
    import pyarrow as pa

    _, read = _blocks()

    def unpack(batches: Iterator) -> Iterator:
        for batch in batches:
            entries = pa.Table.from_batches([batch])
            if set(columns) <= set(entries.column_names):
                yield from entries.filter(entries["block"].is_null()).select(["slot", *columns]).to_batches()
            for slot, block in zip(entries["slot"].to_pylist(), entries["block"]):
                if block.is_valid:
                    rows = read(block.as_py())
                    rows = rows.append_column("slot", pa.array([slot] * rows.num_rows, pa.int64()))
                    yield from rows.select(["slot", *columns]).to_batches()

    return unpack


def _processor(order: tuple[str, ...], reach_after_us: int, seeks_after: bool, width: int):
    """The processor's class is made here, so it goes to the workers by value."""
    import json

    import numpy as np
    import pandas as pd
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.streaming import StatefulProcessor

    write, read = _blocks()
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    row_schema, held_schema, out_schema = (
        pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in columns.split(", "))])
        for columns in (_ROW, _HELD, _OUT)
    )

    def place(body: str) -> tuple:
        values = json.loads(body)
        return tuple((values[c] is not None, values[c]) for c in order[1:])

    def in_order(who, us, bodies):
        """The rows by key and time. Only rows of one key and time need the further columns, which are in the body."""
        index = np.lexsort((us, who))
        alike = np.flatnonzero((np.diff(who[index]) == 0) & (np.diff(us[index]) == 0))
        if len(alike) and len(order) > 1:
            for run in np.split(alike, np.flatnonzero(np.diff(alike) > 1) + 1):
                i, j = run[0], run[-1] + 2
                index[i:j] = sorted(index[i:j], key=lambda k: place(bodies[int(k)].as_py()))
        return index

    def picked(values, index):
        """The values at these places, null where the place is negative."""
        return values.take(pa.array(index, pa.int64(), mask=index < 0))

    def answers(us, body, prev, after) -> pa.Table:
        return pa.table([pa.repeat(ANSWER, len(us)), us, body, prev, after], schema=out_schema)

    def judged(placed: pa.Table, held: pa.Table, watermark: int, end: int) -> tuple[pa.Table, pa.Table]:
        """The answers that are final now, and what is held on to: open rows and each key's last one."""
        n = placed.num_rows
        people = pa.concat_arrays([placed["who"].combine_chunks(), held["who"].combine_chunks()]).dictionary_encode()
        codes = people.indices.to_numpy()
        held_who, is_open = codes[n:], held["is_open"].to_numpy()
        index = in_order(codes[:n], placed["us"].to_numpy(), placed["body"].combine_chunks())
        placed, who, at = placed.take(pa.array(index)), codes[:n][index], np.arange(n)
        us, asks, before, after = (placed[c].to_numpy() for c in ("us", "asks", "before", "after"))

        # For each key its first row here and the row behind its last one, and the place of its last one held.
        first, stop = np.searchsorted(who, np.arange(len(people.dictionary)), "left"), np.searchsorted(who, np.arange(len(people.dictionary)), "right")
        known = np.full(len(people.dictionary), -1)
        known[held_who[~is_open]] = n + np.flatnonzero(~is_open)
        texts = pa.concat_arrays([placed["body"].combine_chunks(), held["body"].combine_chunks()])

        so_far = np.r_[-1, np.maximum.accumulate(np.where(before, at, -1))]
        to_come = np.r_[np.minimum.accumulate(np.where(after, at, n)[::-1])[::-1], n]

        def last_before(key, i):
            return np.where(so_far[i] >= first[key], so_far[i], known[key])

        def next_from(key, i):
            return np.where(to_come[i] < stop[key], to_come[i], -1)

        prev, following = picked(texts, last_before(who, at)), next_from(who, at + 1)
        stays = asks & seeks_after & (following < 0) & (us + reach_after_us > watermark)
        done = np.flatnonzero(asks & ~stays)
        if not seeks_after:
            following = np.full(n, -1)
        out = [answers(placed["us"].take(done), placed["body"].take(done), prev.take(done), picked(texts, following[done]))]

        opened = np.flatnonzero(is_open)
        due = held["us"].take(opened).to_numpy() + reach_after_us
        found = next_from(held_who[opened], first[held_who[opened]])
        closes = (found >= 0) | (due <= watermark)
        gone = held.take(opened[closes])
        out.append(answers(gone["us"], gone["body"], gone["prev"], picked(texts, found[closes])))

        stays = np.flatnonzero(stays)
        kept = [held.take(opened[~closes])]
        kept.append(pa.table(
            [placed["us"].take(stays), placed["body"].take(stays), prev.take(stays), placed["who"].take(stays), pa.repeat(True, len(stays))],
            schema=held_schema))
        if end > watermark:
            last = last_before(np.arange(len(known)), stop)
            has = np.flatnonzero(last >= 0)
            nothing = pa.nulls(len(has))
            kept.append(pa.table(
                [nothing.cast(pa.int64()), picked(texts, last[has]), nothing.cast(pa.string()), people.dictionary.take(pa.array(has)), pa.repeat(False, len(has))],
                schema=held_schema))
        return pa.concat_tables(out), pa.concat_tables(kept)

    class Nearest(StatefulProcessor):
        """``waiting`` has the rows whose place is not final, ``held`` those that were placed and each key's last one."""

        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", f"{_ROW}, block binary")
            self.held = handle.getValueState("held", "block binary")
            self.due = handle.getValueState("due", "due bigint")

        def entries(self, rows: pa.Table) -> list[tuple]:
            if rows.num_rows > FEW_ROWS:
                return [(*[None] * len(row_schema), write(rows))]
            return [(*row.values(), None) for row in rows.to_pylist()]

        def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
            watermark = timerValues.getCurrentWatermarkInMs() * 1000
            table = pa.concat_tables([read(block) for frame in rows for block in frame["block"]])
            waits = pc.fill_null(pc.greater(table["us"], watermark), False)
            new = table.filter(waits).select(row_schema.names).cast(row_schema)
            if new.num_rows:
                self.waiting.appendList(self.entries(new))
                # One timer a share, the first that is due, does for all its rows.
                due, known = pc.min(new["us"]).as_py() // 1000 + 1, self.due.get()
                if known is None or due < known[0]:
                    self.handle.registerTimer(due)
                    self.due.update((due,))
            gone = table.filter(pc.and_(pc.invert(waits), table["home"]))
            if gone.num_rows:
                kind = pc.if_else(gone["us"].is_null(), NO_TIME, LATE)
                nothing = pa.nulls(gone.num_rows, pa.string())
                out = pa.table([kind, gone["us"], gone["body"].cast(pa.string()), nothing, nothing], schema=out_schema)
                yield out.to_pandas(integer_object_nulls=True)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
            watermark = timerValues.getCurrentWatermarkInMs() * 1000
            due = self.due.get()
            if due is not None and expiredTimerInfo.getExpiryTimeInMs() < due[0]:
                return  # an earlier call of this batch has done what was due
            entries, held = list(self.waiting.get()), self.held.get()
            single = [dict(zip(row_schema.names, e)) for e in entries if e[-1] is None]
            waiting = pa.concat_tables([pa.Table.from_pylist(single, row_schema), *[read(e[-1]) for e in entries if e[-1] is not None]])
            is_due = pc.less_equal(waiting["us"], watermark)
            rest = waiting.filter(pc.invert(is_due))
            end = (int(key[-1]) + 1) * width + reach_after_us
            known = read(held[0]) if held else held_schema.empty_table()
            out, kept = judged(waiting.filter(is_due), known, watermark, end)
            if rest.num_rows < waiting.num_rows:
                self.waiting.put(self.entries(rest)) if rest.num_rows else self.waiting.clear()
            if kept.num_rows:
                self.held.update((write(kept),))
            elif held:
                self.held.clear()
            ends = [pc.min(rest["us"]).as_py(), pc.min(pc.add(kept["us"], reach_after_us)).as_py()]
            ends = [x for x in ends if x is not None] + [end] * (kept.num_rows > 0 and not pc.all(kept["is_open"]).as_py())
            if ends:
                self.due.update((min(ends) // 1000 + 1,))
                self.handle.registerTimer(min(ends) // 1000 + 1)
            elif due is not None:
                self.due.clear()
            if out.num_rows:
                yield out.to_pandas(integer_object_nulls=True)

        def close(self) -> None:
            pass

    return Nearest()


@contextmanager
def _state_store(spark: SparkSession):
    """Keyed state with timers needs the RocksDB store; the session's own choice is put back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def take_in(rows: DataFrame, path: str, spec: Spec) -> None:
    """Answer what has arrived, one output version for each micro-batch.

    The watermark is tracked on a column that goes no further: so the engine drops no late row, and the
    processor outputs it as late.
    """
    seen = rows.withColumn("event_time", F.timestamp_micros(F.col(spec.order[0])))
    seen = seen.withWatermark("event_time", f"{spec.delay_us // 1000} milliseconds").drop("event_time")
    answered = _dealt(seen, spec).groupBy(*_GROUP).transformWithStateInPandas(
        statefulProcessor=_processor(spec.order, spec.reach_after_us, spec.reach_after_us > 0, spec.width),
        outputStructType=_OUT,
        outputMode="append",
        timeMode="eventTime",
    )
    with _state_store(rows.sparkSession):
        tables.run_available(answered, path, "append")


def _still_open(spark: SparkSession, path: str, spec: Spec, schema: str, hot_rows: int) -> DataFrame:
    """The rows that wait in the state, answered by the batch operator."""

    def state(name: str) -> DataFrame:
        reader = spark.read.format("statestore").option("path", f"{path}/checkpoint").option("stateVarName", name)
        return reader.load()

    def unpacked(entries: DataFrame, shape: str) -> DataFrame:
        return entries.mapInArrow(_unpacker([x.split(" ")[0] for x in shape.split(", ")]), f"slot bigint, {shape}")

    names = ["who", "slot"]
    with _state_store(spark):
        waiting = unpacked(state("waiting").select("key.slot", "list_element.*"), _ROW)
        held = unpacked(state("held").select("key.slot", "value.block"), _HELD)
    place = F.from_json("body", schema)[spec.order[0]]
    opened = held.where("is_open").select(*names, "us", "body", "prev")
    last = held.where("NOT is_open").select(*names, "body")

    def marked(df: DataFrame, **flags: bool | str | None) -> DataFrame:
        return df.withColumns({c: F.lit(v).cast("string" if c == "prev" else "boolean") for c, v in flags.items()})

    rows = marked(waiting, is_open=False, prev=None)
    rows = rows.unionByName(marked(opened, is_open=True, asks=True, before=False, after=False))
    rows = rows.unionByName(marked(last.withColumn("us", place), is_open=False, asks=False, before=True, after=False, prev=None))
    others = {f"_o{i}": F.from_json("body", schema)[c] for i, c in enumerate(spec.order[1:])}
    found = running(
        rows.withColumns(others),
        names,
        ["us", *others],
        {
            "_before": Running("last", F.when(F.col("before"), F.col("body"))),
            "_after": Running("last", F.when(F.col("after"), F.col("body")), backwards=True),
        },
        hot_rows=hot_rows,
    ).where("asks")
    previous = F.when(F.col("is_open"), F.col("prev")).otherwise(F.col("_before"))
    return found.select("us", "body", previous.alias("prev"), F.col("_after").alias("next"))


def shape(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def _versions(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_versions(spark, path, _OUT)


def _opened(rows: DataFrame, schema: str) -> DataFrame:
    return rows.withColumn("row", F.from_json("body", schema)).select("row.*", *[c for c in rows.columns if c not in ("us", "body")])


def run(spark: SparkSession, rows: DataFrame, path: str, spec: Spec, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Take in what has arrived; the rows to answer, with the row ``_prev`` before and ``_next`` after."""
    schema = shape(rows)
    take_in(rows, path, spec)
    final = _versions(spark, path).where(F.col("kind") == ANSWER).select("us", "body", "prev", "next")
    rows = _opened(final.unionByName(_still_open(spark, path, spec, schema, hot_rows)), schema)
    return rows.withColumns({f"_{c}": F.from_json(c, schema) for c in ("prev", "next")}).drop("prev", "next")


def rejected(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that were not taken in: ``reason`` is ``late`` or ``no time``."""
    rows = _versions(spark, path).where(F.col("kind") != ANSWER).select("body", F.col("kind").alias("reason"))
    return _opened(rows, schema)
