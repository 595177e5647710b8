"""An equality join that stays parallel when one key holds a large share of the left side.

Adaptive execution splits such a key only where both inputs come straight from a shuffle. An input
that was just aggregated does not, and then the whole key lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.operators.ordered import BROADCAST_GROUPS, HOT_ROWS

MISSING_KEY_SHARES = 1000


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``left.join(right, keys, how)`` for ``inner`` and ``left``, with large keys of ``left`` spread.

    The rows of a large key are dealt to shares by a hash of ``spread_by`` (an id of the row), and
    the few rows ``right`` has for that key are repeated once per share. Smaller keys have a single
    share. Keys are counted first; without a large one the join is a plain one.
    """
    if how not in ("inner", "left"):
        raise ValueError("repeating the right side is exact for inner and left joins only")
    hot = (
        left.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_shares"))
    )
    found = hot.count()
    if not found:
        return left.join(right, list(keys), how)
    if found <= BROADCAST_GROUPS:
        hot = F.broadcast(hot)
    shares = F.coalesce("_shares", F.lit(1))
    # A missing key meets nothing, so those rows can go anywhere.
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    dealt = left.join(hot, list(keys), "left").select(
        *left.columns,
        F.pmod(F.xxhash64(*spread_by), F.when(missing, MISSING_KEY_SHARES).otherwise(shares)).cast("int").alias("_share"),
    )
    repeated = right.join(hot, list(keys), "left").select(
        *right.columns, F.explode(F.sequence(F.lit(0), shares - 1)).alias("_share")
    )
    return dealt.join(repeated, [*keys, "_share"], how).drop("_share")
