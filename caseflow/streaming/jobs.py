"""The streaming jobs. Each gives what its batch operator gives on the same rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions import fixed_values as fixed
from caseflow.operators import correlate, memory, spans, usage
from caseflow.operators.ordered import HOT_ROWS, micros
from caseflow.sources import notifications
from caseflow.streaming import nearest, tables
from caseflow.streaming.nearest import DAY_US, MINUTE_US, Spec

DELAY_MINUTES = 60.0
SLOT_US = 32 * DAY_US
BUCKETS = 64


# --- impossible travel ------------------------------------------------------------------------


def velocity_rows(signals: DataFrame) -> DataFrame:
    return signals.select("customer_id", "signal_id", "location_id", micros(F.col("ts")).alias("_us"))


def stream_velocity(
    spark: SparkSession,
    signals: DataFrame,
    locations: DataFrame,
    path: str,
    max_minutes: float = correlate.VELOCITY_MINUTES,
    min_mph: float = correlate.VELOCITY_MPH,
    delay_minutes: float = DELAY_MINUTES,
    slot_us: int = SLOT_US,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Velocity alerts, with each customer's last place kept in the state.

    A place is forgotten when no speed could make an alert of it any more. Signals that come behind the
    watermark, or have no time, are in ``rejected_signals``.
    """
    spec = Spec(
        ("customer_id",),
        ("_us", "signal_id"),
        asks=F.lit(True),
        before=F.lit(True),
        after=F.lit(False),
        reach_before_us=correlate.velocity_horizon_us(max_minutes, min_mph),
        delay_us=int(delay_minutes * MINUTE_US),
        slot_us=slot_us,
    )
    rows = nearest.run(spark, velocity_rows(signals), path, spec, hot_rows)
    moves = correlate.as_transitions(rows.withColumn("ts", _time(signals.schema["ts"].dataType)))
    return correlate.velocity_from_transitions(moves, locations, max_minutes, min_mph)


def rejected_signals(spark: SparkSession, signals: DataFrame, path: str) -> DataFrame:
    """The signals ``stream_velocity`` could not place, with the reason."""
    return nearest.rejected(spark, path, nearest.shape(velocity_rows(signals)))


def _time(kind: T.DataType) -> Column:
    return F.timestamp_micros("_us").cast(kind)


# --- challenge and reply ----------------------------------------------------------------------


def stream_step_up(
    spark: SparkSession,
    challenges: DataFrame,
    replies: DataFrame,
    path: str,
    within_minutes: float = correlate.REPLY_WITHIN_MINUTES,
    delay_minutes: float = DELAY_MINUTES,
    slot_us: int = SLOT_US,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """First reply to each challenge; a timer gives up when the reply may come no more.

    Only the nearest reply is looked for, so many replies to many challenges make no pairs.
    """
    rows = correlate.challenge_rows(challenges, replies)
    spec = Spec(
        ("customer_id",),
        ("_us", "_kind", "_id"),
        asks=F.col("_kind") == 1,
        before=F.lit(False),
        after=F.col("_kind") == 0,
        reach_after_us=int(within_minutes * MINUTE_US),
        delay_us=int(delay_minutes * MINUTE_US),
        slot_us=slot_us,
    )
    found = nearest.run(spark, rows.drop("ts"), path, spec, hot_rows).withColumnRenamed("_next", "_reply")
    return correlate.judge_reply(found.withColumn("ts", _time(rows.schema["ts"].dataType)), within_minutes)


def rejected_answers(spark: SparkSession, challenges: DataFrame, replies: DataFrame, path: str) -> DataFrame:
    """The challenges (``_kind`` 1) and replies (0) ``stream_step_up`` could not place, with the reason."""
    return nearest.rejected(spark, path, nearest.shape(correlate.challenge_rows(challenges, replies).drop("ts")))


# --- span pairs -------------------------------------------------------------------------------


def stream_span_pairs(
    spark: SparkSession,
    all_spans: DataFrame,
    path: str,
    timeout_minutes: float,
    delay_minutes: float = DELAY_MINUTES,
    slot_us: int = SLOT_US,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Start and completion pairs; a start that nothing follows is answered by its timer."""
    timeout_us = int(timeout_minutes * MINUTE_US)
    spec = Spec(
        ("session_id", "name"),
        ("_us", "span_id"),
        asks=F.lit(True),
        before=F.lit(True),
        after=F.lit(True),
        reach_before_us=timeout_us,
        reach_after_us=timeout_us,
        delay_us=int(delay_minutes * MINUTE_US),
        slot_us=slot_us,
    )
    rows = nearest.run(spark, spans.pair_rows(all_spans), path, spec, hot_rows)
    return spans.judge_pairs(rows.withColumnRenamed("_next", "_next_span"), timeout_minutes)


def rejected_spans(spark: SparkSession, all_spans: DataFrame, path: str) -> DataFrame:
    """The spans ``stream_span_pairs`` could not place, with the reason."""
    return nearest.rejected(spark, path, nearest.shape(spans.pair_rows(all_spans)))


# --- usage per window -------------------------------------------------------------------------


def stream_usage(
    spark: SparkSession,
    signals: DataFrame,
    path: str,
    width: str = "1 day",
    slide: str | None = None,
    delay_minutes: float = DELAY_MINUTES,
) -> DataFrame:
    """Counts and amounts per window and channel, tumbling or sliding.

    Windows are updated as rows arrive, so the last ones are there too; the newest version of a
    window is its answer.
    """
    at = F.col("ts").cast("timestamp")
    counted = (
        signals.withColumn("event_time", at)
        .withWatermark("event_time", f"{int(delay_minutes * 60)} seconds")
        .groupBy(F.window("event_time", width, slide), "channel")
        .agg(*usage_counts())
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "channel",
            "records",
            "amount_cents",
        )
    )
    tables.run_available(counted, path, "update")
    return tables.latest(
        tables.read_versions(spark, path, counted.schema), ["window_start", "window_end", "channel"]
    )


def stream_usage_totals(
    spark: SparkSession, signals: DataFrame, path: str, width: str = "1 day", slide: str | None = None
) -> DataFrame:
    """``stream_usage`` that leaves no row out, however late it comes.

    Counts add up, so a batch stores those of its own rows and reading adds them. There is no state and no
    watermark to wait for: a batch costs what its own rows cost, and a read one row for each batch, window and channel.
    Rows without a time are in no window; they are counted by channel with null for the window's ends.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        own = usage_windows(batch, width, slide)
        timeless = batch.where("ts IS NULL").groupBy("channel").agg(*usage_counts())
        nowhere = timeless.withColumns({c: F.lit(None).cast("timestamp") for c in ("window_start", "window_end")})
        tables.write_version(own.unionByName(nowhere), batch_id, f"{path}/rows")

    tables.run_available(signals, path, "append", write)
    schema = "window_start TIMESTAMP, window_end TIMESTAMP, channel STRING, records BIGINT, amount_cents BIGINT"
    stored = tables.read_versions(spark, path, schema)
    return stored.groupBy("window_start", "window_end", "channel").agg(
        F.sum("records").alias("records"), F.sum("amount_cents").alias("amount_cents")
    )


def usage_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("records"),
        F.sum(F.round(F.col("amount") * 100).cast("long")).alias("amount_cents"),
    ]


def usage_windows(signals: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """The batch form of ``stream_usage``."""
    return (
        signals.groupBy(F.window(F.col("ts").cast("timestamp"), width, slide), "channel")
        .agg(*usage_counts())
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "channel",
            "records",
            "amount_cents",
        )
    )


def stream_sessions(spark: SparkSession, signals: DataFrame, path: str, gap_minutes: float) -> DataFrame:
    """Activity sessions by gap.

    Each batch stores the sessions of its own rows; reading joins those that touch. Nothing waits
    for a watermark, so late rows count and the last sessions are there.
    """
    single = usage.session_records(signals)

    def write(batch: DataFrame, batch_id: int) -> None:
        tables.write_version(usage.sessions(batch, gap_minutes), batch_id, f"{path}/rows")

    tables.run_available(single, path, "append", write)
    return usage.sessions(tables.read_versions(spark, path, single.schema), gap_minutes)


# --- compaction -------------------------------------------------------------------------------


def stream_compaction(
    spark: SparkSession, customers: DataFrame, fragments: DataFrame, path: str
) -> DataFrame:
    """Compaction kept up to date as fragments arrive.

    A batch stores the digests of the customers it touches. Digests add up, so earlier fragments
    are never read again, and the report merges them.
    """
    shape = fragments.select(
        "fragment_id", "customer_id", "channel", "ts", "summary", "severity", "is_compacted_summary"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        digests = memory.with_best_text(memory.channel_digest(batch), batch)
        tables.write_version(digests, batch_id, f"{path}/rows")

    tables.run_available(shape, path, "append", write)
    stored = tables.read_versions(spark, path, memory.DIGEST_SCHEMA)
    return memory.compaction_report(customers, memory.merge_digests(stored))


def stream_compacted_memory(
    spark: SparkSession, fragments: DataFrame, path: str, buckets: int = BUCKETS
) -> DataFrame:
    """The snapshot of ``memory.compacted_fragments``: one flagged row per customer, replaced as fragments arrive.

    Customers are dealt to buckets by hash. A batch reads the newest digests of the buckets that its customers are in,
    adds its own, writes digests and snapshot of these buckets as a new version, and names them in the pointer
    last. Readers only see named versions, so a batch that fails half way changes nothing, and one that is tried
    again starts from what the earlier ones named. Without new fragments nothing is written. Replaced
    versions stay in their folders. Fragments without a customer are in no snapshot.
    """
    shape = fragments.select(
        "fragment_id", "customer_id", "channel", "ts", "summary", "severity", "is_compacted_summary"
    )
    digest = memory.with_best_text(memory.channel_digest(shape), shape)
    digest_schema = digest.schema
    snapshot_schema = memory.compacted_fragments(
        memory.compaction_report(digest.select("customer_id").distinct(), digest)
    ).schema

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        known = batch.where("customer_id IS NOT NULL")
        own = memory.with_best_text(memory.channel_digest(known), known)
        # Stored and read back, so that the list of buckets and the merge see the same rows.
        tables.write_version(tables.with_bucket(own, ["customer_id"], buckets), batch_id, f"{path}/own/rows")
        own = tables.read_version(session, f"{path}/own", batch_id)
        touched = sorted(r[0] for r in own.select(tables.BUCKET).distinct().collect())
        named = tables.named_buckets(session, path, below=batch_id)
        before = tables.read_buckets(session, f"{path}/digests", digest_schema, {b: named[b] for b in touched if b in named})
        merged = memory.merge_digests(before.unionByName(own.drop(tables.BUCKET)))
        tables.write_buckets(tables.with_bucket(merged, ["customer_id"], buckets), batch_id, f"{path}/digests")
        merged = tables.read_buckets(session, f"{path}/digests", digest_schema, dict.fromkeys(touched, batch_id))
        report = memory.compaction_report(merged.select("customer_id").distinct(), merged)
        rows = tables.with_bucket(memory.compacted_fragments(report), ["customer_id"], buckets)
        tables.write_buckets(rows, batch_id, f"{path}/snapshot")
        tables.name_buckets(session, touched, batch_id, path)

    tables.run_available(shape, path, "append", write)
    return tables.read_buckets(spark, f"{path}/snapshot", snapshot_schema, tables.named_buckets(spark, path))


# --- notification ingest ----------------------------------------------------------------------


def stream_ingest(
    spark: SparkSession,
    raw: DataFrame,
    objects: DataFrame,
    path: str,
    rules: Mapping[str, Sequence[str]] = fixed.DOCUMENT_TAGS,
    now: Column | None = None,
    undated_buckets: int = BUCKETS,
) -> tuple[DataFrame, DataFrame]:
    """Decode, fetch, tag and store notifications; returns the metadata and the rejected rows.

    A redelivery may come at any time, so it is not left to a watermark: each batch drops what
    its own rows repeat, and what earlier batches already stored for the same day of creation.
    The day is a partition of the stored keys; the batch's days prune them while the query runs. Keys whose
    creation time is no date have no day to be looked up by; they are dealt to ``undated_buckets`` partitions by hash, so
    that no one partition grows with all of them and a batch reads those of its own undated keys.
    """
    decoded_schema = T.StructType([*notifications.decoded(raw).schema.fields, T.StructField("created_day", T.StringType())])
    kept = [*notifications.KEY, "time_created", "object_key", "created_day"]
    seen_schema = ", ".join(f"{c} STRING" for c in kept)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession

        # Each step is stored and read back, so it runs once and later steps agree on its rows.
        created = F.try_to_timestamp(F.left("time_created", F.lit(10)), F.lit("yyyy-MM-dd"))
        bucket = F.pmod(F.xxhash64(notifications.object_key()), F.lit(undated_buckets))
        undated = F.concat(F.lit("undated-"), bucket.cast("string"))
        day = F.coalesce(F.date_format(created, "yyyy-MM-dd"), undated)
        tables.write_version(
            notifications.decoded(batch).withColumn("created_day", day), batch_id, f"{path}/decoded/rows"
        )
        usable = tables.read_version(session, f"{path}/decoded", batch_id).filter(F.col("reject_reason").isNull())
        usable = usable.withColumn("object_key", notifications.object_key())
        days = usable.filter(F.col("created_day") > "").select("created_day").distinct()
        stored = tables.read_versions(session, f"{path}/seen", seen_schema).filter(F.col(tables.BATCH) < batch_id)
        stored = stored.join(days, "created_day", "left_semi").select("created_day", "object_key")
        new = notifications.one_per_object(usable).select(*kept).join(stored, ["created_day", "object_key"], "left_anti")
        tables.write_version(new.hint("rebalance", "created_day"), batch_id, f"{path}/seen/rows", ["created_day"])
        # A batch may store no keys at all, so the schema is given here.
        fresh = (
            tables.read_versions(session, f"{path}/seen", seen_schema)
            .filter(F.col(tables.BATCH) == batch_id)
            .drop(tables.BATCH)
        )
        contents = notifications.attach_content(fresh, objects)
        tables.write_version(notifications.metadata_rows(contents, rules, now), batch_id, f"{path}/rows")

    tables.run_available(raw, path, "append", write)
    rejected = (
        tables.read_versions(spark, f"{path}/decoded", decoded_schema)
        .filter(F.col("reject_reason").isNotNull())
        .select(*raw.columns, "reject_reason")
    )
    metadata = tables.read_versions(spark, path, notifications.METADATA_SCHEMA)
    return metadata.drop(tables.BATCH), rejected
