"""Token and cost accounting per conversation turn, and activity sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import fixed_values as fixed
from caseflow.functions.text import token_estimate
from caseflow.operators.ordered import HOT_ROWS, Running, running

# Prices are in 1e-8 USD; a cost is kept to 1e-6 USD.
UNITS_PER_MICRO_USD = 100


def half_even_div(value: Column, by: int) -> Column:
    """Integer division rounded half to even, exact where a double would not be."""
    rest = value % by
    whole = ((value - rest) / by).cast("long")
    up = (rest * 2 > by) | ((rest * 2 == by) & (whole % 2 != 0))
    return whole + F.when(up, 1).otherwise(0)


def token_usage(
    turns: DataFrame,
    first_input: int = fixed.FIRST_TURN_INPUT,
    first_output: int = fixed.FIRST_TURN_OUTPUT,
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Tokens and running cost of each turn within its session.

    ``turns`` has ``session_id``, ``turn``, the lengths ``memory_chars``, ``message_chars`` and
    ``reply_chars``, and ``tools``. A session starts from one fixed turn. Costs are added up as
    whole units and divided last.
    """
    per_turn = turns.select(
        "session_id",
        "turn",
        (
            F.lit(fixed.SYSTEM_TOKENS)
            + token_estimate(F.col("memory_chars"))
            + token_estimate(F.col("message_chars"))
            + F.col("tools") * fixed.TOOL_INPUT_TOKENS
        ).cast("long").alias("input_tokens"),
        (token_estimate(F.col("reply_chars")) + F.col("tools") * fixed.TOOL_OUTPUT_TOKENS)
        .cast("long")
        .alias("output_tokens"),
    )
    totals = running(
        per_turn,
        ["session_id"],
        ["turn"],
        {
            "_in": Running("sum", F.col("input_tokens")),
            "_out": Running("sum", F.col("output_tokens")),
            "_turns": Running("sum", F.lit(1).cast("long")),
        },
        hot_rows=hot_rows,
    )
    none = F.lit(0)
    summed = totals.select(
        "session_id",
        "turn",
        "input_tokens",
        "output_tokens",
        (F.coalesce("_turns", none) + 2).alias("turns_count"),
        (F.coalesce("_in", none) + F.col("input_tokens") + first_input).alias("total_input"),
        (F.coalesce("_out", none) + F.col("output_tokens") + first_output).alias("total_output"),
    )
    units = F.col("total_input") * fixed.INPUT_PRICE + F.col("total_output") * fixed.OUTPUT_PRICE
    total = F.col("total_input") + F.col("total_output")
    # Tenths of a percent, half up, as the dashboard shows them.
    share = F.floor((F.col("total_input") * 2000 + total) / (total * 2))
    return summed.select(
        "*",
        total.alias("total_tokens"),
        half_even_div(units, UNITS_PER_MICRO_USD).alias("cost_micro_usd"),
        (share / 10.0).alias("input_share_pct"),
        ((F.lit(1000) - share) / 10.0).alias("output_share_pct"),
    )


def sessions(
    records: DataFrame, gap_minutes: float, *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Runs of activity per customer that no pause of ``gap_minutes`` interrupts.

    ``records`` has ``customer_id``, ``start_us``, ``end_us``, ``records`` and ``amount_cents``;
    a single event starts and ends at its own time. Sessions of separate inputs are records too,
    so running this over them again joins what belongs together.
    """
    gap = int(gap_minutes * 60_000_000)
    order = ["start_us", "end_us", "records", "amount_cents"]
    reached = running(
        records.select("customer_id", *order),
        ["customer_id"],
        order,
        {"_reach": Running("max", F.col("end_us"))},
        hot_rows=hot_rows,
    )
    opens = F.col("_reach").isNull() | (F.col("start_us") - F.col("_reach") > gap)
    # Where a session opens, its own start is the mark later rows inherit.
    marked = reached.withColumn("_opens", F.when(opens, F.col("start_us")))
    # Among equal rows the one that opens comes first, or its twins would miss it.
    labelled = running(
        marked.select("customer_id", *order, "_opens", F.col("_opens").isNull().alias("_inherits")),
        ["customer_id"],
        [*order, "_inherits"],
        {"_earlier": Running("last", F.col("_opens"))},
        hot_rows=hot_rows,
    )
    return (
        labelled.groupBy("customer_id", F.coalesce("_opens", "_earlier").alias("start_us"))
        .agg(
            F.max("end_us").alias("end_us"),
            F.sum("records").alias("records"),
            F.sum("amount_cents").alias("amount_cents"),
        )
    )


def session_records(signals: DataFrame) -> DataFrame:
    """Signals as the shortest possible sessions."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return signals.select(
        "customer_id",
        at.alias("start_us"),
        at.alias("end_us"),
        F.lit(1).cast("long").alias("records"),
        F.round(F.col("amount") * 100).cast("long").alias("amount_cents"),
    )
