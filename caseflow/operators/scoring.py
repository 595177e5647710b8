"""Scores: rollups, evaluation checks, leak audits, customer risk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import fixed_values as fixed
from caseflow.operators.ordered import HOT_ROWS
from caseflow.operators.skew import spread_join

# Two alerts of these kinds make the one score the domain states, 92.
ALERT_WEIGHTS = {"VELOCITY": 52, "STEP_UP_MISMATCH": 40}
MAX_RISK = 100
# 85 is stated; the lower bands are ours.
RISK_BANDS = [("CRITICAL", 85), ("HIGH", 60), ("MEDIUM", 30)]


def risk_summary(alerts: DataFrame, weights: Mapping[str, int] = ALERT_WEIGHTS) -> DataFrame:
    """Capped, weighted score and band per customer from rows of (customer_id, kind, ts)."""
    weight = F.lit(0)
    for kind, points in weights.items():
        weight = F.when(F.col("kind") == kind, points).otherwise(weight)
    per_customer = alerts.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.least(F.lit(MAX_RISK), F.sum(weight)).cast("long").alias("risk_score"),
        F.max("ts").alias("last_alert_ts"),
    )
    level = F.lit("LOW")
    for name, least in reversed(RISK_BANDS):
        level = F.when(F.col("risk_score") >= least, name).otherwise(level)
    locked = F.col("risk_score") >= RISK_BANDS[0][1]
    return per_customer.select(
        "*",
        level.alias("risk_level"),
        F.when(locked, fixed.SECURITY_LOCKED).otherwise("MONITORED").alias("containment_status"),
    )


def percentage(part: Column, whole: Column) -> Column:
    return F.format_string("%.1f%%", F.bround(part * 100.0 / whole, 1))


def score_rollup(scores: DataFrame) -> DataFrame:
    """Points and percentage per set and pillar, per set, and overall."""
    return (
        scores.rollup("set", "pillar")
        .agg(
            F.sum("score").alias("score"),
            F.sum("max_score").alias("max_score"),
            (F.grouping("set") + F.grouping("pillar")).cast("int").alias("level"),
        )
        .select(
            F.coalesce("set", F.lit("ALL")).alias("set"),
            F.coalesce("pillar", F.lit("ALL")).alias("pillar"),
            "level",
            "score",
            "max_score",
            percentage(F.col("score"), F.col("max_score")).alias("percentage"),
        )
    )


def check_expressions(text: str = "text") -> dict[str, Column]:
    """The checks a case may ask for; a check the case does not name passes.

    They read the case's arrays and bounds and the output's ``text``, ``trace_id``, ``value`` and
    ``members``.
    """
    body, lowered = F.col(text), F.lower(text)

    def each(column: str, test) -> Column:
        # The arrays belong to one case: a handful of words.
        return F.coalesce(F.forall(F.col(column), test), F.lit(True))

    return {
        "has_expected_terms": each("expected_terms", lambda t: F.contains(lowered, F.lower(t))),
        "has_no_forbidden_terms": each("forbidden_terms", lambda t: ~F.contains(lowered, F.lower(t))),
        "matches_required_patterns": each("required_patterns", lambda p: F.regexp_like(body, p)),
        "matches_no_forbidden_pattern": each("forbidden_patterns", lambda p: ~F.regexp_like(body, p)),
        "has_trace_prefix": F.coalesce(F.startswith(F.col("trace_id"), F.col("expected_prefix")), F.col("expected_prefix").isNull()),
        "reaches_minimum": F.coalesce(F.col("value") >= F.col("minimum"), F.col("minimum").isNull()),
        "stays_below_maximum": F.coalesce(F.col("value") < F.col("maximum"), F.col("maximum").isNull()),
        "covers_members": F.coalesce(
            F.size(F.array_except("expected_members", "members")) == 0, F.col("expected_members").isNull()
        ),
    }


CHECKED_FIELDS = [
    "expected_terms",
    "forbidden_terms",
    "required_patterns",
    "forbidden_patterns",
    "expected_prefix",
    "minimum",
    "maximum",
    "expected_members",
]


def eval_scoring(cases: DataFrame, outputs: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Score outputs, each with an ``output_id``, against their case: all of its checks, or no points.

    Each output meets exactly one case, so the join grows with the outputs only. A case that got no
    output has failed: none of its points, which still count as possible.
    """
    joined = spread_join(outputs, cases, ["eval_id"], ["output_id"], hot_rows=hot_rows)
    passed = None
    for check in check_expressions().values():
        passed = check if passed is None else passed & check
    scored = (
        joined.select("eval_id", "weight_points", passed.alias("passed"))
        .groupBy("eval_id")
        .agg(
            F.count(F.lit(1)).alias("outputs"),
            F.sum(F.col("passed").cast("long")).alias("passed"),
            F.sum("weight_points").cast("long").alias("points_possible"),
            F.sum(F.when(F.col("passed"), F.col("weight_points")).otherwise(0)).cast("long").alias("points"),
        )
    )
    none = F.lit(0).cast("long")
    return cases.select("eval_set_id", "eval_id", "weight_points").join(scored, "eval_id", "left").select(
        "eval_set_id",
        "eval_id",
        F.coalesce("outputs", none).alias("outputs"),
        F.coalesce("passed", none).alias("passed"),
        F.coalesce("points_possible", F.col("weight_points").cast("long")).alias("points_possible"),
        F.coalesce("points", none).alias("points"),
    )


def occurrences(text: Column, word: str) -> Column:
    """How often a plain word occurs, from the length that removing it takes away."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))
    return (gone / len(word)).cast("long")


def leak_audit(
    df: DataFrame, columns: Sequence[str], patterns: Mapping[str, str], words: Sequence[str] = ()
) -> DataFrame:
    """Rows and matches of each pattern and each plain word in each text column.

    All counts come from one pass over the table; the single result row is then unpivoted, so
    the table itself is never multiplied.
    """
    tests = {label: (lambda c, p=p: F.regexp_count(c, F.lit(p)).cast("long")) for label, p in patterns.items()}
    tests |= {word: (lambda c, w=word: occurrences(c, w)) for word in words}
    found = {f"c{i}_{j}": test(F.col(c)) for i, c in enumerate(columns) for j, test in enumerate(tests.values())}
    zero = F.lit(0).cast("long")
    totals, lines = [], []
    for i, column in enumerate(columns):
        for j, label in enumerate(tests):
            name = f"c{i}_{j}"
            totals += [
                F.coalesce(F.sum(F.when(F.col(name) > 0, 1).otherwise(0)), zero).alias(f"rows_{name}"),
                F.coalesce(F.sum(name), zero).alias(f"matches_{name}"),
            ]
            lines.append(
                F.struct(
                    F.lit(column).alias("column_name"),
                    F.lit(label).alias("pattern"),
                    F.col(f"rows_{name}").alias("rows_with_match"),
                    F.col(f"matches_{name}").alias("matches"),
                )
            )
    counts = df.select(*[count.alias(name) for name, count in found.items()])
    return counts.agg(*totals).select(F.inline(F.array(*lines)))
