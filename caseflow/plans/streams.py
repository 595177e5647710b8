"""The registered streaming queries: the given tables read as file streams, run until all is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators import spans
from caseflow.operators.ordered import micros
from caseflow.plans import mapping
from caseflow.plans.batch import Query
from caseflow.session import work_dir
from caseflow.streaming import jobs, tables
from caseflow.streaming.nearest import DAY_US

PAIR_TIMEOUT_MINUTES = 2 * 24 * 60
SESSION_GAP_MINUTES = 60
SNAPSHOT_BUCKETS = 16


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.stream_table(spark, sf_dir, "events")


PIECES = 3
ROWS_A_FILE = 100_000


def in_pieces(spark: SparkSession, df: DataFrame, order: Column, last: DataFrame | None = None) -> DataFrame:
    """A table as a stream that arrives in several micro-batches, in the given order, then the ``last`` rows.

    Rows without an order come with the first.
    """
    folder = work_dir(spark, "pieces")
    middle = F.percentile_approx(order, [i / PIECES for i in range(1, PIECES)], 10_000)
    cuts, rows = df.agg(middle, F.count("*")).first()
    # Every piece has as many files as one micro-batch takes up.
    files = max(2, -(-rows // (PIECES * ROWS_A_FILE)))
    edges = [None, *(cuts or []), None]
    for low, high in zip(edges, edges[1:]):
        piece = df if low is None else df.filter(order > low)
        piece = piece if high is None else piece.filter((order <= high) if low is not None else (order <= high) | order.isNull())
        # one write after the other, so that files are taken up in this order
        piece.repartition(files).write.mode("append").parquet(folder)
    if last is not None:
        last.repartition(files).write.mode("append").parquet(folder)
    return tables.stream_files(spark, folder, max_files=files)


def events_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_pieces(spark, mapping.table(spark, sf_dir, "events"), micros(F.col("ts")))


def with_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in pieces; every tenth comes once more without its time, and every seventh again days later."""
    events = mapping.table(spark, sf_dir, "events")
    us = micros(F.col("ts"))
    newest = events.agg(F.max(us)).first()[0]
    timeless = events.where("event_id % 10 = 0").withColumn("ts", F.lit(None).cast(events.schema["ts"].dataType))
    again = events.where("event_id % 7 = 0").where(us < F.lit(newest) - DAY_US)
    return in_pieces(spark, events.unionByName(timeless), us, again)


def stream_velocity_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes late or without a time changes no alert."""
    signals = mapping.signals_from(with_faults(spark, sf_dir))
    return jobs.stream_velocity(spark, signals, mapping.locations(spark, sf_dir), work_dir(spark, "velocity"))


def stream_velocity_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = mapping.signals_from(with_faults(spark, sf_dir))
    path = work_dir(spark, "velocity")
    jobs.stream_velocity(spark, signals, mapping.locations(spark, sf_dir), path)
    return jobs.rejected_signals(spark, signals, path).select("signal_id", "customer_id", "reason")


def stream_step_up_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, path = with_faults(spark, sf_dir), work_dir(spark, "step-up")
    challenges, replies = mapping.challenges_from(source), mapping.replies_from(source)
    jobs.stream_step_up(spark, challenges, replies, path)
    kind = F.when(F.col("_kind") == 1, "challenge").otherwise("reply")
    return jobs.rejected_answers(spark, challenges, replies, path).select(kind.alias("kind"), F.col("_id").alias("event_id"), "reason")


def stream_span_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, path = mapping.spans_from(with_faults(spark, sf_dir)), work_dir(spark, "span-pairs")
    jobs.stream_span_pairs(spark, source, path, PAIR_TIMEOUT_MINUTES)
    return jobs.rejected_spans(spark, source, path).select("span_id", "session_id", "name", "reason")


def stream_velocity_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = mapping.signals_from(events_in_pieces(spark, sf_dir))
    return jobs.stream_velocity(spark, signals, mapping.locations(spark, sf_dir), work_dir(spark, "velocity"))


def stream_step_up_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = events_in_pieces(spark, sf_dir)
    challenges, replies = mapping.challenges_from(source), mapping.replies_from(source)
    return jobs.stream_step_up(spark, challenges, replies, work_dir(spark, "step-up"))


def stream_span_pairs_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = mapping.spans_from(events_in_pieces(spark, sf_dir))
    return jobs.stream_span_pairs(spark, source, work_dir(spark, "span-pairs"), PAIR_TIMEOUT_MINUTES)


def stream_usage_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = mapping.signals_from(events_in_pieces(spark, sf_dir))
    return _windows(jobs.stream_usage(spark, signals, work_dir(spark, "usage")))


def stream_ingest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = in_pieces(spark, mapping.table(spark, sf_dir, "documents"), F.col("doc_id"))
    raw = mapping.notifications_from(source)
    objects = mapping.stored_objects(spark, sf_dir)
    return jobs.stream_ingest(spark, raw, objects, work_dir(spark, "ingest"), mapping.TAG_WORDS, F.lit(mapping.NOW))[0]


def stream_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = mapping.signals_from(events(spark, sf_dir))
    path = work_dir(spark, "velocity")
    return jobs.stream_velocity(spark, signals, mapping.locations(spark, sf_dir), path)


def stream_step_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    challenges = mapping.challenges_from(events(spark, sf_dir))
    replies = mapping.replies_from(events(spark, sf_dir))
    return jobs.stream_step_up(spark, challenges, replies, work_dir(spark, "step-up"))


def stream_span_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.stream_span_pairs(
        spark,
        mapping.spans_from(events(spark, sf_dir)),
        work_dir(spark, "span-pairs"),
        PAIR_TIMEOUT_MINUTES,
    )


def timed_span_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of ``stream_span_pairs``."""
    return spans.span_pairs(mapping.spans(spark, sf_dir), PAIR_TIMEOUT_MINUTES)


def _windows(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {name: F.col(name).cast("timestamp_ntz") for name in ("window_start", "window_end")}
    )


def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = mapping.signals_from(events(spark, sf_dir))
    return _windows(jobs.stream_usage(spark, signals, work_dir(spark, "usage")))


def stream_usage_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = mapping.signals_from(events(spark, sf_dir))
    return _windows(jobs.stream_usage(spark, signals, work_dir(spark, "sliding"), "6 hours", "2 hours"))


def usage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of ``stream_usage``."""
    return _windows(jobs.usage_windows(mapping.signals(spark, sf_dir)))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = mapping.signals_from(events(spark, sf_dir))
    return jobs.stream_sessions(spark, signals, work_dir(spark, "sessions"), SESSION_GAP_MINUTES)


def stream_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments = mapping.event_fragments_from(events(spark, sf_dir))
    return jobs.stream_compaction(
        spark, mapping.customers(spark, sf_dir), fragments, work_dir(spark, "compaction")
    )


def _snapshot(df: DataFrame) -> DataFrame:
    return df.select(
        "fragment_id", "customer_id", "channel", "severity", "summary", "is_compacted_summary", F.col("veracity.status").alias("status")
    )


def stream_compacted_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments = mapping.event_fragments_from(events(spark, sf_dir))
    return _snapshot(jobs.stream_compacted_memory(spark, fragments, work_dir(spark, "snapshot"), SNAPSHOT_BUCKETS))


def stream_compacted_memory_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments = mapping.event_fragments_from(events_in_pieces(spark, sf_dir))
    return _snapshot(jobs.stream_compacted_memory(spark, fragments, work_dir(spark, "snapshot"), SNAPSHOT_BUCKETS))


def stream_usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of every event, of those that come late or without a time too."""
    signals = mapping.signals_from(with_faults(spark, sf_dir))
    return _windows(jobs.stream_usage_totals(spark, signals, work_dir(spark, "usage-totals")))


def _ingest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = mapping.notifications_from(tables.stream_table(spark, sf_dir, "documents"))
    return jobs.stream_ingest(
        spark,
        raw,
        mapping.stored_objects(spark, sf_dir),
        work_dir(spark, "ingest"),
        mapping.TAG_WORDS,
        F.lit(mapping.NOW),
    )


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingest(spark, sf_dir)[0]


def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingest(spark, sf_dir)[1].select("doc_id", "delivery", "reject_reason")


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        stream_velocity,
        stream_step_up,
        stream_span_pairs,
        timed_span_pairs,
        stream_usage,
        stream_usage_sliding,
        usage_windows,
        stream_sessions,
        stream_compaction,
        stream_compacted_memory,
        stream_compacted_memory_pieces,
        stream_usage_totals,
        stream_ingest,
        stream_rejects,
        stream_velocity_faults,
        stream_velocity_rejects,
        stream_step_up_rejects,
        stream_span_rejects,
        stream_velocity_pieces,
        stream_step_up_pieces,
        stream_span_pairs_pieces,
        stream_usage_pieces,
        stream_ingest_pieces,
    )
}
