"""Correlation across channels: what happened before, after, or within range of a record.

Every operator is linear in its input. Interval questions ask for the nearest partner instead of
joining all pairs, and go through ``running``, which stays parallel under a hot customer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.geo import MAX_DISTANCE_MILES, miles
from caseflow.operators.ordered import HOT_ROWS, Running, micros, running

MICROS = 1_000_000

# Two places within nine minutes is the only case the domain states.
VELOCITY_MINUTES = 9.0
# Faster than an airliner between two places, whatever the gap.
VELOCITY_MPH = 600.0
HIGH_VALUE_FLOOR = 50_000.0
REPLY_WITHIN_MINUTES = 30
CALL_WITHIN_HOURS = 2
WALLET_WITHIN_HOURS = 24
RECURRING_MONTHS = 2
DAY_SHARES = 2048


# --- impossible travel ------------------------------------------------------------------------


def previous_signal() -> dict[str, Running]:
    return {"_prev": Running("last", F.struct("signal_id", "location_id", "_us"))}


def transitions(signals: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each signal next to the same customer's previous one."""
    located = signals.select(
        "signal_id", "customer_id", "ts", "location_id", micros(F.col("ts")).alias("_us")
    )
    return as_transitions(
        running(located, ["customer_id"], ["_us", "signal_id"], previous_signal(), hot_rows=hot_rows)
    )


def as_transitions(rows: DataFrame) -> DataFrame:
    return rows.select(
        "signal_id",
        "customer_id",
        "ts",
        F.col("_prev.signal_id").alias("prev_signal_id"),
        F.col("_prev.location_id").alias("from_location_id"),
        F.col("location_id").alias("to_location_id"),
        (F.col("_us") - F.col("_prev._us")).alias("gap_us"),
    )


def velocity_horizon_us(max_minutes: float, min_mph: float) -> int:
    """The longest gap an alert can have: beyond it no two places on Earth imply the speed."""
    return int(max(max_minutes * 60, MAX_DISTANCE_MILES / min_mph * 3600) * MICROS)


def velocity_from_transitions(
    moves: DataFrame,
    locations: DataFrame,
    max_minutes: float = VELOCITY_MINUTES,
    min_mph: float = VELOCITY_MPH,
) -> DataFrame:
    """Alert where the place changed and the gap is short or the implied speed too high.

    The cheap bound on the gap comes first, so few moves reach the two lookups.
    """
    near = moves.filter(
        (F.col("from_location_id") != F.col("to_location_id"))
        & (F.col("gap_us") <= velocity_horizon_us(max_minutes, min_mph))
    )

    def at(side: str) -> DataFrame:
        return locations.select(
            F.col("location_id").alias(f"{side}_location_id"),
            F.col("city").alias(f"{side}_city"),
            F.col("lat").alias(f"{side}_lat"),
            F.col("lon").alias(f"{side}_lon"),
        )

    measured = (
        near.join(at("from"), "from_location_id")
        .join(at("to"), "to_location_id")
        .withColumn(
            "distance_miles",
            F.round(
                miles(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon")), 3
            ),
        )
    )
    hours = F.col("gap_us") / (3600.0 * MICROS)
    quick = F.col("gap_us") <= int(max_minutes * 60 * MICROS)
    # Distance against distance coverable: no division by a zero gap.
    fast = F.col("distance_miles") > hours * min_mph
    return measured.filter(quick | fast).select(
        "signal_id",
        "customer_id",
        "ts",
        "prev_signal_id",
        "from_city",
        "to_city",
        F.floor(F.col("gap_us") / MICROS).alias("gap_seconds"),
        "distance_miles",
        F.when(quick, "DUAL_CITY").otherwise("SPEED").alias("alert_type"),
    )


def velocity_alerts(
    signals: DataFrame,
    locations: DataFrame,
    max_minutes: float = VELOCITY_MINUTES,
    min_mph: float = VELOCITY_MPH,
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Signals of one customer from two places too far apart for the time between them."""
    return velocity_from_transitions(
        transitions(signals, hot_rows=hot_rows), locations, max_minutes, min_mph
    )


# --- first contact with a merchant ------------------------------------------------------------


def unfamiliar_high_value(charges: DataFrame, floor: float = HIGH_VALUE_FLOOR) -> DataFrame:
    """First charge a customer makes at a merchant, if it is above ``floor``.

    One aggregate finds the first charge and, among its line items, the largest: map-side
    combining leaves one row per pair and task, so a hot pair costs no more than a cold one.
    """
    first = charges.groupBy("customer_id", "merchant_id").agg(
        F.min(F.struct("ts", "transaction_id", (-F.col("amount")).alias("neg"))).alias("f")
    )
    return first.select(
        "customer_id",
        "merchant_id",
        F.col("f.transaction_id").alias("transaction_id"),
        F.col("f.ts").alias("ts"),
        (-F.col("f.neg")).alias("amount"),
    ).filter(F.col("amount") > floor)


# --- challenge and reply ----------------------------------------------------------------------


def challenge_rows(challenges: DataFrame, replies: DataFrame) -> DataFrame:
    """Both kinds in one ordered stream of rows.

    A reply counts only if strictly later, so at equal times it sorts before the challenge.
    """
    reply = replies.select(
        "customer_id",
        F.col("reply_ts").alias("ts"),
        F.lit(0).alias("_kind"),
        F.col("reply_id").alias("_id"),
        F.col("reply_origin").alias("origin"),
    )
    challenge = challenges.select(
        "customer_id",
        F.col("challenge_ts").alias("ts"),
        F.lit(1).alias("_kind"),
        F.col("challenge_id").alias("_id"),
        F.col("challenge_origin").alias("origin"),
    )
    return reply.unionByName(challenge).withColumn("_us", micros(F.col("ts")))


def next_reply() -> dict[str, Running]:
    reply = F.when(F.col("_kind") == 0, F.struct("_id", "_us", "origin"))
    return {"_reply": Running("last", reply, backwards=True)}


def judge_reply(rows: DataFrame, within_minutes: float = REPLY_WITHIN_MINUTES) -> DataFrame:
    """Audit rows of the challenges, from rows that know the next reply."""
    delay_us = F.col("_reply._us") - F.col("_us")
    answered = F.coalesce(delay_us <= int(within_minutes * 60 * MICROS), F.lit(False))
    mismatch = F.col("_reply.origin") != F.col("origin")
    return rows.filter(F.col("_kind") == 1).select(
        F.col("_id").alias("challenge_id"),
        "customer_id",
        F.col("ts").alias("challenge_ts"),
        F.when(answered, F.col("_reply._id")).alias("reply_id"),
        F.when(answered, F.floor(delay_us / MICROS)).alias("reply_after_seconds"),
        F.when(~answered, "NO_REPLY").when(mismatch, "HIGH").otherwise("LOW").alias("compromise_likelihood"),
    )


def step_up_audit(
    challenges: DataFrame,
    replies: DataFrame,
    within_minutes: float = REPLY_WITHIN_MINUTES,
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """First reply to each challenge; one from another origin makes compromise likely."""
    rows = running(
        challenge_rows(challenges, replies),
        ["customer_id"],
        ["_us", "_kind", "_id"],
        next_reply(),
        hot_rows=hot_rows,
    )
    return judge_reply(rows, within_minutes)


# --- travel notices ---------------------------------------------------------------------------


def travel_coverage(
    charges: DataFrame, notices: DataFrame, *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Each charge with the latest-ending notice of its customer that covers the charge date.

    Of the notices already started, the one that ends last covers the charge if any does, so a
    running maximum replaces the join of all notices with all charges.
    """

    def at(day: str, kind: int, row_id: str) -> Column:
        """Day, then notices before charges, then an even spread.

        Days are coarse and many rows may share one, but within a day and kind any order will do,
        so a hash of the id lets even a single day be cut.
        """
        number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).cast("long")
        return (number * 2 + kind) * DAY_SHARES + F.pmod(F.xxhash64(row_id), F.lit(DAY_SHARES))

    started = notices.select(
        "customer_id",
        at("start_date", 0, "notice_id").alias("_at"),
        F.col("notice_id").alias("_id"),
        F.lit(0).alias("_kind"),
        F.struct(F.col("end_date").alias("end"), F.col("notice_id").alias("id")).alias("_notice"),
    )
    asked = charges.select(
        "customer_id",
        at("charge_date", 1, "charge_id").alias("_at"),
        F.col("charge_id").alias("_id"),
        F.lit(1).alias("_kind"),
        "charge_date",
    )
    rows = running(
        started.unionByName(asked, allowMissingColumns=True),
        ["customer_id"],
        ["_at", "_id"],
        {"_best": Running("max", F.col("_notice"))},
        hot_rows=hot_rows,
    ).filter(F.col("_kind") == 1)
    covered = F.coalesce(F.col("_best.end") >= F.col("charge_date"), F.lit(False))
    return rows.select(
        F.col("_id").alias("charge_id"),
        "customer_id",
        "charge_date",
        F.when(covered, F.col("_best.id")).alias("notice_id"),
        covered.alias("is_covered"),
    )


def covered_charges(charges: DataFrame, notices: DataFrame, covered: bool = True) -> DataFrame:
    """The charges some notice covers, or those none does."""
    wanted = F.col("is_covered") if covered else ~F.col("is_covered")
    return travel_coverage(charges, notices).filter(wanted).select("charge_id", "customer_id", "charge_date")


# --- decline, call, wallet failure ------------------------------------------------------------


def incident_chain(
    declines: DataFrame,
    calls: DataFrame,
    wallet: DataFrame,
    call_within_hours: float = CALL_WITHIN_HOURS,
    wallet_within_hours: float = WALLET_WITHIN_HOURS,
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Declines followed by a call and then by a failed wallet set-up, each soon after the last.

    The nearest later record is taken at both steps: first every call finds its wallet failure,
    then every decline finds its call.
    """

    def rows(df: DataFrame, prefix: str, kind: int) -> DataFrame:
        return df.select(
            "customer_id",
            micros(F.col(f"{prefix}_ts")).alias("_us"),
            F.lit(kind).alias("_kind"),
            F.col(f"{prefix}_id").alias("_id"),
        )

    order = ["_us", "_kind", "_id"]
    # What is looked for sorts before what looks, so equal times do not count as later.
    with_wallet = running(
        rows(wallet, "wallet", 0).unionByName(rows(calls, "call", 1)),
        ["customer_id"],
        order,
        {"_wallet": Running("last", F.when(F.col("_kind") == 0, F.struct("_id", "_us")), backwards=True)},
        hot_rows=hot_rows,
    ).filter(F.col("_kind") == 1)
    call_rows = with_wallet.withColumn("_kind", F.lit(0)).withColumn("_call", F.struct("_id", "_us", "_wallet"))
    decline_rows = rows(declines, "decline", 1)
    chained = running(
        call_rows.select("customer_id", "_us", "_kind", "_id", "_call").unionByName(
            decline_rows, allowMissingColumns=True
        ),
        ["customer_id"],
        order,
        {"_next": Running("last", F.col("_call"), backwards=True)},
        hot_rows=hot_rows,
    ).filter(F.col("_kind") == 1)
    to_call = F.col("_next._us") - F.col("_us")
    to_wallet = F.col("_next._wallet._us") - F.col("_next._us")
    hour = 3600 * MICROS
    return chained.filter(
        (to_call <= int(call_within_hours * hour)) & (to_wallet <= int(wallet_within_hours * hour))
    ).select(
        F.col("_id").alias("decline_id"),
        "customer_id",
        F.col("_next._id").alias("call_id"),
        F.col("_next._wallet._id").alias("wallet_id"),
        F.floor(to_call / MICROS).alias("call_after_seconds"),
        F.floor(to_wallet / MICROS).alias("wallet_after_seconds"),
    )


# --- status as of a charge --------------------------------------------------------------------


def status_asof(charges: DataFrame, statuses: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The status in force when a charge was made; equal times are settled by id."""
    change = statuses.select(
        "customer_id",
        F.col("status_ts").alias("ts"),
        F.col("status_id").alias("_id"),
        F.struct("status_id", "status").alias("_change"),
    )
    charge = charges.select(
        "customer_id", F.col("charge_ts").alias("ts"), F.col("charge_id").alias("_id")
    )
    rows = running(
        change.unionByName(charge, allowMissingColumns=True)
        .withColumn("_us", micros(F.col("ts"))),
        ["customer_id"],
        ["_us", "_id"],
        {"_in_force": Running("last", F.col("_change"))},
        hot_rows=hot_rows,
    ).filter(F.col("_change").isNull())
    return rows.select(
        F.col("_id").alias("charge_id"),
        "customer_id",
        "ts",
        F.col("_in_force.status_id").alias("status_id"),
        F.col("_in_force.status").alias("status"),
        F.coalesce(F.col("_in_force.status") == "LOCKED", F.lit(False)).alias("explained_by_lock"),
    )


# --- recurring payees -------------------------------------------------------------------------


def recurring_payees(charges: DataFrame, min_months: int = RECURRING_MONTHS) -> DataFrame:
    """Merchants a customer pays in several distinct months: those to tell about a new card.

    Reducing to one row per pair and month first keeps a hot pair small before it is counted.
    """
    month = F.date_trunc("month", F.col("ts").cast("timestamp")).cast("date")
    per_month = charges.groupBy("customer_id", "merchant_id", month.alias("month")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        per_month.groupBy("customer_id", "merchant_id")
        .agg(
            F.count(F.lit(1)).alias("months"),
            F.sum("n").alias("charges"),
            F.max("month").alias("last_month"),
        )
        .filter(F.col("months") >= min_months)
    )


def biller_fanout(cards: DataFrame, payees: DataFrame) -> DataFrame:
    """One row for every replaced card and payee to be told about it."""
    return cards.join(payees.select("customer_id", "merchant_id", "months", "last_month"), "customer_id")
