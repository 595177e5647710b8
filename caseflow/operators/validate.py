"""Input checks as columns, and the split of a table into usable rows and error rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import fixed_values as fixed
from caseflow.functions.rules import is_positive
from caseflow.functions.text import clean_last4, is_blank, strip


@dataclass(frozen=True)
class Check:
    """``bad`` marks the rows that fail; the first failing check names the error."""

    error_type: str
    message: str
    bad: Column
    retryable: bool = True
    fallback: str | None = None


def first_error(checks: Sequence[Check]) -> Column:
    """Struct describing the first check that fails, null when all pass."""

    def described(c: Check) -> Column:
        return F.struct(
            F.lit(c.error_type).alias("error_type"),
            F.lit(c.message).alias("error_message"),
            F.lit(c.retryable).alias("retryable"),
            F.lit(c.fallback).cast("string").alias("fallback"),
        )

    return F.coalesce(*[F.when(F.coalesce(c.bad, F.lit(True)), described(c)) for c in checks])


def checked(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """All rows, with the four error columns null on the usable ones."""
    return df.withColumn("_error", first_error(checks)).select(*df.columns, "_error.*")


def split_valid(df: DataFrame, checks: Sequence[Check]) -> tuple[DataFrame, DataFrame]:
    """Usable rows as they came, and failing rows with their error."""
    rows = checked(df, checks)
    return (
        rows.filter(F.col("error_type").isNull()).select(*df.columns),
        rows.filter(F.col("error_type").isNotNull()),
    )


def blank(name: str, error_type: str = "EMPTY_VALUE", fallback: str | None = None) -> Check:
    return Check(error_type, f"{name} must not be empty", is_blank(F.col(name).cast("string")), fallback=fallback)


def reserved_id(name: str, fallback: str | None = None) -> Check:
    """Placeholders that stand for a missing customer."""
    known = F.lower(strip(F.col(name).cast("string"))).isin(fixed.RESERVED_IDS)
    return Check("NOT_FOUND", f"{name} is not on file", known, retryable=False, fallback=fallback)


def not_positive(name: str, fallback: str | None = None) -> Check:
    return Check("INVALID_AMOUNT", f"{name} must be a number above zero", ~is_positive(F.col(name)), fallback=fallback)


def bad_last4(name: str) -> Check:
    return Check("INVALID_CARD_ENDING", f"{name} must have four digits", clean_last4(F.col(name)).isNull())


def short_address(name: str, least: int = fixed.MIN_ADDRESS_LENGTH) -> Check:
    return Check(
        "INCOMPLETE_ADDRESS",
        f"{name} is too short",
        F.length(strip(F.coalesce(F.col(name), F.lit("")))) < least,
    )


def transaction_checks(key: str, amount: str, merchant: str) -> list[Check]:
    """The checks a dispute needs, in the order they are reported."""
    return [
        blank(key, "EMPTY_TRANSACTION", fallback="account_statement"),
        not_positive(amount, fallback="account_statement"),
        blank(merchant, "EMPTY_MERCHANT", fallback="account_statement"),
    ]
