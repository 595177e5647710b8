"""Telemetry spans: latency figures, the newest spans, start and completion pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import fixed_values as fixed
from caseflow.operators.ordered import HOT_ROWS, Running, micros, running

PERCENTS = (50, 95)
LOG_SERVICE = "case-service"
LOG_COMPONENT = "case-pipeline"


def span_stats(
    spans: DataFrame,
    limit_ms: float = fixed.LATENCY_LIMIT_MS,
    percents: Sequence[int] = PERCENTS,
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Count, mean, exact percentiles, maximum and share under the limit per kind of span.

    Each kind is first reduced to counts per distinct duration. Percentiles then come from running
    counts over those, not from one task that gathers every duration of a kind. Durations are taken
    as they are; only the mean and the share are rounded, at the end.
    """
    kind = ["span_type", "name"]
    counts = spans.groupBy(*kind, F.col("duration_ms").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running(
        counts,
        kind,
        ["d"],
        {
            "_below": Running("sum", F.col("n")),
            "_above": Running("sum", F.col("n"), backwards=True),
        },
        hot_rows=hot_rows,
    )
    upto = F.coalesce("_below", F.lit(0)) + F.col("n")
    total = upto + F.coalesce("_above", F.lit(0))

    def percentile(p: int) -> Column:
        """The smallest duration with at least p percent of the spans at or below it."""
        return F.min(F.when(upto * 100 >= total * p, F.col("d"))).alias(f"p{p}_ms")

    under = F.sum(F.when(F.col("d") < limit_ms, F.col("n")).otherwise(0))
    return ranked.groupBy(*kind).agg(
        F.sum("n").alias("spans"),
        F.round(F.sum(F.col("n") * F.col("d")) / F.sum("n"), 4).alias("mean_ms"),
        *[percentile(p) for p in percents],
        F.max("d").alias("max_ms"),
        F.round(under * 100.0 / F.sum("n"), 4).alias("under_limit_pct"),
    )


def recent_spans(spans: DataFrame, n: int = fixed.SPAN_BUFFER) -> DataFrame:
    """The ``n`` newest spans, newest first: each task sends at most ``n`` rows."""
    return spans.orderBy(F.desc("ts"), F.desc("span_id")).limit(n)


def pair_rows(spans: DataFrame) -> DataFrame:
    """Starts and completions as ordered rows."""
    return spans.filter(F.col("span_type").isin("START", "COMPLETE")).select(
        "session_id",
        "name",
        "span_id",
        "span_type",
        micros(F.col("ts")).alias("_us"),
    )


def both_neighbours() -> dict[str, Running]:
    span = F.struct("span_type", "span_id", "_us")
    return {"_prev": Running("last", span), "_next_span": Running("last", span, backwards=True)}


def judge_pairs(rows: DataFrame, timeout_minutes: float | None = None) -> DataFrame:
    """Paired and unpaired spans, from rows that know the row before and the row after.

    A start pairs with the next row of its session and name if that is a completion, and comes
    soon enough when there is a timeout. A completion nobody started lasts zero.
    """
    start, complete = F.col("span_type") == "START", F.col("span_type") == "COMPLETE"
    to_next = F.col("_next_span._us") - F.col("_us")
    pairs = start & (F.col("_next_span.span_type") == "COMPLETE")
    follows = complete & (F.col("_prev.span_type") == "START")
    if timeout_minutes is not None:
        limit = int(timeout_minutes * 60_000_000)
        pairs = pairs & (to_next <= limit)
        follows = follows & (F.col("_us") - F.col("_prev._us") <= limit)
    paired = F.coalesce(pairs, F.lit(False))
    return rows.filter(start | ~F.coalesce(follows, F.lit(False))).select(
        "session_id",
        "name",
        F.when(start, F.col("span_id")).alias("start_span_id"),
        F.when(paired, F.col("_next_span.span_id")).when(complete, F.col("span_id")).alias("complete_span_id"),
        F.when(paired, to_next / 1000.0).when(complete, F.lit(0.0)).alias("duration_ms"),
        F.when(paired, "PAIRED").when(start, "NO_COMPLETION").otherwise("NO_START").alias("pairing"),
    )


def span_pairs(
    spans: DataFrame, timeout_minutes: float | None = None, *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Durations from start to completion within a session and name; unpaired spans are kept."""
    rows = running(
        pair_rows(spans), ["session_id", "name"], ["_us", "span_id"], both_neighbours(), hot_rows=hot_rows
    )
    return judge_pairs(rows, timeout_minutes)


def normalise_logs(
    logs: DataFrame, service: str = LOG_SERVICE, component: str = LOG_COMPONENT
) -> DataFrame:
    """Upper-case severity, default service and component, and ids as fixed-width lower hex."""

    def hex_id(number: Column, digits: int) -> Column:
        return F.lpad(F.lower(F.hex(number)), digits, "0")

    return logs.withColumns(
        {
            "severity": F.upper(F.coalesce("level", F.lit("info"))),
            "service": F.coalesce("service", F.lit(service)),
            "component": F.coalesce("component", F.lit(component)),
            "trace_id": hex_id(F.col("trace_number"), 32),
            "span_id": hex_id(F.col("span_number"), 16),
        }
    ).drop("level", "trace_number", "span_number")
