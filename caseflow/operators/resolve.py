"""Case decisions in bulk: disputes, and the whole resolution of a compromised card.

These decide and document; nothing is issued, shipped or posted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import fixed_values as fixed
from caseflow.functions.rules import KeywordRules, approval_gate, claim_outcome, claim_scenario, needs_review
from caseflow.functions.text import contains_any, is_blank, mask_pan, strip
from caseflow.operators.lookup import cents
from caseflow.operators.ordered import HOT_ROWS
from caseflow.operators.skew import spread_join
from caseflow.operators.validate import checked, transaction_checks

# Eight digits, as ids are often shown, collide within a hundred thousand cases.
ID_DIGITS = 32


def stable_id(prefix: str, *keys: Column, digits: int = ID_DIGITS) -> Column:
    """The same id for the same keys, on every run and every retry."""
    text = F.concat_ws("|", F.lit(prefix), *[k.cast("string") for k in keys])
    return F.concat(F.lit(prefix), F.upper(F.left(F.sha2(text, 256), F.lit(digits))))


def file_disputes(
    txs: DataFrame, limit: float = fixed.DISPUTE_LIMIT, keep: Sequence[str] = ()
) -> DataFrame:
    """One decision per transaction: an error, a stop for approval, or a credit.

    ``txs`` has ``transaction_id``, ``customer_id``, ``amount``, ``merchant``, ``approved`` and
    ``token``; the columns to ``keep`` are carried along. Checks come before the gate.
    """
    rows = checked(txs, transaction_checks("transaction_id", "amount", "merchant"))
    gate = approval_gate(F.col("amount"), limit, F.col("approved"), F.col("token"))
    status = (
        F.when(F.col("error_type").isNotNull(), "ERROR")
        .when(gate == "APPROVAL_REQUIRED", "APPROVAL_REQUIRED")
        .otherwise(fixed.CREDIT_POSTED)
    )
    posted = F.col("status") == fixed.CREDIT_POSTED
    return rows.withColumn("status", status).select(
        "transaction_id",
        "customer_id",
        "status",
        "error_type",
        F.when(posted, stable_id("DSP-", F.col("transaction_id"))).alias("case_id"),
        F.when(posted, F.col("amount")).alias("credit"),
        F.when(posted, fixed.DISPUTE_DAYS).alias("resolution_days"),
        *keep,
    )


def dispute_totals(disputes: DataFrame) -> DataFrame:
    """Decisions and credit per customer."""

    def count(status: str) -> Column:
        return F.sum(F.when(F.col("status") == status, 1).otherwise(0)).cast("long")

    return disputes.groupBy("customer_id").agg(
        count(fixed.CREDIT_POSTED).alias("credited"),
        count("APPROVAL_REQUIRED").alias("stopped"),
        count("ERROR").alias("errors"),
        (F.coalesce(F.sum(cents(F.col("credit"))), F.lit(0)) / 100.0).alias("total_credit"),
    )


def resolve_cases(
    cases: DataFrame,
    dispute_limit: float = fixed.DISPUTE_LIMIT,
    card_limit: float = fixed.VIRTUAL_CARD_LIMIT,
) -> DataFrame:
    """Gate, dispute, virtual card, courier and billers for every case, in one projection.

    ``cases`` has ``case_id``, ``customer_id``, ``approved``, ``token``, ``transaction_id``,
    ``amount``, ``merchant``, ``spending_limit``, ``card_last4``, ``address``, ``opened_at`` and
    ``billers``. A card or courier that fails, fails the case; a failed dispute does not.
    """
    amount, token, approved = F.col("amount"), F.col("token"), F.col("approved")
    dispute_gate = approval_gate(amount, dispute_limit, F.lit(True), token)
    dispute = (
        F.when(is_blank(F.col("transaction_id").cast("string")) | is_blank(F.col("merchant")), "ERROR")
        .when(dispute_gate == "EXECUTE", fixed.CREDIT_POSTED)
        .otherwise(dispute_gate)
    )
    # Inside a confirmed resolution the card step has no token of its own.
    card_gate = approval_gate(F.col("spending_limit"), card_limit, F.lit(True), F.lit(None))
    card = F.when(card_gate == "EXECUTE", fixed.CARD_PROVISIONED).otherwise("ERROR")
    complete = F.length(strip(F.coalesce("address", F.lit("")))) >= fixed.MIN_ADDRESS_LENGTH
    courier = F.when(complete, fixed.COURIER_DISPATCHED).otherwise("ERROR")
    gate = approval_gate(None, None, approved, None)

    staged = cases.withColumns(
        {
            "_blank": is_blank(F.col("customer_id").cast("string")),
            "_gate": gate,
            "_dispute": dispute,
            "_card": card,
            "_courier": courier,
        }
    )
    failed = (
        F.when(F.col("_blank"), "customer")
        .when(F.col("_gate") != "EXECUTE", "approval")
        .when(F.col("_card") == "ERROR", "virtual_card")
        .when(F.col("_courier") == "ERROR", "courier")
    )
    status = (
        F.when(F.col("_failed").isNull(), "SUCCESS")
        .when(F.col("_failed") == "approval", "APPROVAL_REQUIRED")
        .otherwise("ERROR")
    )
    key = F.col("case_id")
    done = F.col("_failed").isNull()
    credited = done & (F.col("_dispute") == fixed.CREDIT_POSTED)
    arrives = F.col("opened_at") + F.expr("INTERVAL 24 HOURS")
    return staged.withColumn("_failed", failed).select(
        "case_id",
        "customer_id",
        status.alias("status"),
        F.col("_failed").alias("failed_step"),
        F.when(done, fixed.OLD_CARD_REVOKED).alias("old_card_action"),
        F.when(
            done,
            F.struct(
                F.col("_dispute").alias("status"),
                F.when(credited, stable_id("DSP-", F.col("transaction_id"))).alias("case_id"),
                F.when(credited, amount).alias("credit"),
            ),
        ).alias("dispute"),
        F.when(
            done,
            F.struct(
                stable_id("vcn-", key).alias("vcn_id"),
                mask_pan(F.col("card_last4")).alias("masked_pan"),
                F.col("spending_limit").alias("spending_limit"),
                F.col("_card").alias("status"),
            ),
        ).alias("virtual_card"),
        F.when(
            done,
            F.struct(
                stable_id("SHP-", key).alias("tracking_number"),
                strip(F.col("address")).alias("address"),
                F.date_format(arrives, fixed.DELIVERY_FORMAT).alias("estimated_delivery"),
                F.col("_courier").alias("status"),
            ),
        ).alias("courier"),
        F.when(done, F.coalesce("billers", F.lit(0))).alias("billers_updated"),
        F.when(done, stable_id("trace-", key)).alias("trace_id"),
    )


def case_disputes(
    resolved: DataFrame, charges: DataFrame, disputed: Column | None = None, limit: float = fixed.DISPUTE_LIMIT,
    *, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """All disputes of every resolved case, one row per flagged charge, decided like any other dispute.

    ``resolved`` is the result of ``resolve_cases``; only its successes file disputes. ``charges`` has ``case_id``,
    ``transaction_id``, ``amount``, ``merchant`` and ``token``; within a confirmed resolution they count as
    approved. ``disputed`` is the switch of a case, an expression over ``resolved``: a case for which it is false or
    null has no rows here and is resolved all the same. A case without charges has none either, and a case id that
    occurs twice counts once.
    """
    chosen = resolved.filter((F.col("status") == "SUCCESS") & (F.lit(True) if disputed is None else disputed))
    chosen = chosen.groupBy("case_id").agg(F.min("customer_id").alias("customer_id"))
    rows = spread_join(
        charges.select("case_id", "transaction_id", "amount", "merchant", "token"), chosen, ["case_id"], ["transaction_id"],
        hot_rows=hot_rows,
    )
    rows = rows.withColumnRenamed("case_id", "_case").withColumn("approved", F.lit(True))
    return file_disputes(rows, limit, ["_case"]).withColumnsRenamed({"case_id": "dispute_id", "_case": "case_id"})


def policy_support(policies: DataFrame, rules: KeywordRules = fixed.CLAIM_RULES) -> DataFrame:
    """How many policies speak of each claim scenario: one pass, one row per scenario."""
    text = F.col("_text")
    counts = [F.sum(contains_any(text, words).cast("long")).alias(f"_s{label}") for label, words in rules]
    rows = [
        F.struct(F.lit(label).alias("scenario"), F.col(f"_s{label}").alias("policies")) for label, _ in rules
    ]
    rows.append(F.struct(F.lit(fixed.CLAIM_DEFAULT).alias("scenario"), F.col("_all").alias("policies")))
    return (
        policies.select(F.concat_ws("\n", F.lower("title"), F.lower("summary")).alias("_text"))
        .agg(*counts, F.count(F.lit(1)).alias("_all"))
        .select(F.inline(F.array(*rows)))
    )


def claim_veracity(
    claims: DataFrame,
    evidence: DataFrame,
    policies: DataFrame,
    rules: KeywordRules = fixed.CLAIM_RULES,
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Judge each claim by its scenario and its customer's evidence.

    ``evidence`` holds one row per customer and ``policy_support`` one per scenario, so a claim
    stays one row. The ledger and travel checks fail only on contradicted claims and the other
    three always pass; evidence counts are reported next to them.
    """
    has_notice = F.coalesce(F.col("notices") > 0, F.lit(False))
    # One row per rule: its length is fixed by the rule list, not by the data.
    support = F.broadcast(policy_support(policies, rules))
    judged = spread_join(
        claims.withColumn("scenario", claim_scenario(F.col("claim_text"), rules)).join(support, "scenario", "left"),
        evidence,
        ["customer_id"],
        ["turn"],
        "left",
        hot_rows=hot_rows,
    ).withColumn("_outcome", claim_outcome(F.col("scenario"), has_notice))
    contradicted = F.col("_outcome.status") == "CONTRADICTED_BY_TELEMETRY"
    blank = is_blank(F.col("claim_text"))

    def outcome(field: str) -> Column:
        return F.when(~blank, F.col(f"_outcome.{field}"))

    def check(bad: Column) -> Column:
        return F.when(~blank, F.when(bad, "FAIL").otherwise("PASS"))

    zero = F.lit(0)
    return judged.select(
        "customer_id",
        "turn",
        "claim_text",
        F.when(~blank, F.col("scenario")).alias("scenario"),
        F.when(blank, "ERROR").otherwise(F.col("_outcome.status")).alias("status"),
        outcome("confidence").alias("confidence"),
        outcome("signals").alias("signals"),
        check(contradicted).alias("ledger_check"),
        check(contradicted).alias("travel_check"),
        check(F.lit(False)).alias("baseline_check"),
        check(F.lit(False)).alias("consent_check"),
        check(F.lit(False)).alias("policy_check"),
        needs_review(outcome("confidence")).alias("needs_review"),
        F.coalesce("ledger_rows", zero).alias("ledger_rows"),
        F.coalesce("notices", zero).alias("notices"),
        F.coalesce("baseline_rows", zero).alias("baseline_rows"),
        F.coalesce("suspect_replies", zero).alias("suspect_replies"),
        F.coalesce("policies", zero).alias("policies"),
    )


def evidence_rows(*parts: tuple[str, DataFrame]) -> DataFrame:
    """One row per customer with one count per named part.

    The parts are stacked before they are counted: one shuffle, combined in the tasks, instead
    of one join per part.
    """
    names = [name for name, _ in parts]
    stacked = None
    for name, df in parts:
        rows = df.select("customer_id", *[F.lit(1 if n == name else 0).cast("long").alias(n) for n in names])
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return stacked.groupBy("customer_id").agg(*[F.sum(n).alias(n) for n in names])


def verified_fragments(judged: DataFrame) -> DataFrame:
    """Verified claims as timeline fragments, ready to append."""
    return judged.filter(F.col("status") == "VERIFIED_TRUE").select(
        stable_id("clm-", F.col("customer_id"), F.col("turn")).alias("fragment_id"),
        "customer_id",
        F.lit("CLAIM").alias("channel"),
        F.col("claim_text").alias("summary"),
        F.struct("status", "confidence").alias("veracity"),
        F.lit(False).alias("is_compacted_summary"),
    )
