"""Ordered keyword rules, tiers, and the approval decision, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.functions import fixed_values as fixed
from caseflow.functions.text import contains_any, strip

KeywordRules = Sequence[tuple[Any, Sequence[str]]]


def first_match(text: Column, rules: KeywordRules, default: Any) -> Column:
    """Label of the first rule with a word in the text; rules are tried in order."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(contains_any(lowered, words), F.lit(label)) for label, words in rules]
    return F.coalesce(*hits, F.lit(default))


def lookup(key: Column, values: Mapping[Any, Any]) -> Column:
    """A literal table as an expression; null for a key it does not have."""
    found = F.lit(None)
    for k, v in values.items():
        found = F.when(key == F.lit(k), F.lit(v)).otherwise(found)
    return found


def route_intent(message: Column, rules: KeywordRules = fixed.INTENT_RULES) -> Column:
    return first_match(strip(message), rules, fixed.INTENT_DEFAULT)


def needs_audit(message: Column, words: Sequence[str] = fixed.AUDIT_WORDS) -> Column:
    return contains_any(F.lower(strip(F.coalesce(message, F.lit("")))), words)


def tools_used(intent: Column, audited: Column) -> Column:
    """Tool calls a turn makes: its audit, if any, and those of its action."""
    audit = F.when(audited, fixed.TOOLS_PER_AUDIT).otherwise(0)
    return audit + lookup(intent, fixed.TOOLS_PER_INTENT)


def claim_scenario(claim: Column, rules: KeywordRules = fixed.CLAIM_RULES) -> Column:
    return first_match(strip(claim), rules, fixed.CLAIM_DEFAULT)


def claim_outcome(scenario: Column, has_notice: Column) -> Column:
    """Struct of status, confidence and number of corroborating signals."""

    def outcome(values: tuple[str, float, int]) -> Column:
        status, confidence, signals = values
        return F.struct(
            F.lit(status).alias("status"),
            F.lit(confidence).alias("confidence"),
            F.lit(signals).alias("signals"),
        )

    decided = F.when((scenario == 1) & ~has_notice, outcome(fixed.CLAIM_NO_NOTICE))
    for number, values in fixed.CLAIM_OUTCOMES.items():
        decided = decided.when(scenario == number, outcome(values))
    return decided


def needs_review(confidence: Column, below: float = fixed.REVIEW_BELOW) -> Column:
    """Strictly below the threshold."""
    return confidence < below


def model_tier(task: Column, risk: Column, multi_hop: Column, pro_risk: int = fixed.PRO_RISK) -> Column:
    """Triage tier of a work item."""
    pro = F.coalesce(multi_hop, F.lit(False)) | (F.coalesce(risk, F.lit(0)) >= pro_risk) | task.isin(fixed.PRO_TASKS)
    return F.when(pro, "pro").when(task.isin(fixed.LITE_TASKS), "lite").otherwise("fast")


def is_positive(amount: Column) -> Column:
    """A usable amount. NaN compares greater than any number in Spark, so it is named."""
    return F.coalesce((amount > 0) & ~F.isnan(amount), F.lit(False))


def session_gate(
    approved: Column,
    session_requires: Column,
    session_confirmed: Column,
    amount: Column | None = None,
    limit: float | None = None,
    token: Column | None = None,
) -> Column:
    """The gate in front of a whole session's actions.

    Only an explicit refusal counts as unapproved here, a missing amount is zero, and bad amounts
    are left to the checks of the action itself.
    """
    none = F.lit(False)
    refused = F.coalesce(~approved, none)
    unconfirmed = F.coalesce(session_requires, none) & ~F.coalesce(session_confirmed, none)
    stop = refused | unconfirmed
    if amount is not None:
        too_much = (F.nanvl(F.coalesce(amount, F.lit(0.0)), F.lit(0.0)) > limit) & (F.coalesce(token, F.lit("")) == "")
        stop = stop | too_much
    return F.when(stop, "APPROVAL_REQUIRED").otherwise("EXECUTE")


def approval_gate(amount: Column | None, limit: float | None, approved: Column, token: Column | None) -> Column:
    """EXECUTE, APPROVAL_REQUIRED or ERROR. Without an amount only the approval counts."""
    stop = ~F.coalesce(approved, F.lit(False))
    if amount is None:
        return F.when(stop, "APPROVAL_REQUIRED").otherwise("EXECUTE")
    has_token = F.coalesce(token, F.lit("")) != ""
    stop = stop | ((amount > limit) & ~has_token)
    return F.when(~is_positive(amount), "ERROR").when(stop, "APPROVAL_REQUIRED").otherwise("EXECUTE")
