"""Ordered computation inside a group that stays parallel when one group is very large.

A window over ``partitionBy(customer)`` sorts each customer in one task, so a customer holding a
third of all rows holds a third of the job. ``running`` computes the same values but cuts every
large group into slots along the whole ordering. The rows of large groups are dealt out by range of
(keys, order) and stored, so slots hold about equally many rows however uneven the order is, one far
off value or many equal ones included. Each slot is windowed on its own, and the value a slot needs
from its neighbours arrives as one extra *edge* row per slot, unioned in before the window.

Which groups are cut never changes a result, only how the work is spread. Where no group is large the
plan is a plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.session import work_dir

# A group above this many rows is cut; one sorted slot of this size fits easily in a task.
HOT_ROWS = 2_000_000
# A list of large groups up to this length is sent to every task; a longer one is joined by shuffle.
BROADCAST_GROUPS = 10_000

_FIRST_EDGE, _ROW, _LAST_EDGE = -1, 0, 1


@dataclass(frozen=True)
class Running:
    """One running value, over the rows strictly before the current row (after, if ``backwards``).

    ``last`` takes the nearest non-null value, ``max`` the greatest, ``sum`` the total.
    """

    kind: str
    value: Column
    backwards: bool = False


def large_groups(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The groups above ``hot_rows`` rows with their number of rows."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(*[F.col(k).alias(f"_hot_{k}") for k in keys], "_n")
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: Mapping[str, Running],
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add one column per entry of ``outputs``, computed in ``order`` within ``keys``.

    Groups are counted first, and only where one is large is anything cut. Backward values use
    their own descending window: a frame that reaches to the end of the partition would be quadratic.
    """
    values = {f"_v_{name}": spec.value for name, spec in outputs.items()}
    valued = df.select("*", *[v.alias(name) for name, v in values.items()])
    hot = large_groups(df, keys, hot_rows)
    groups, rows = hot.agg(F.count("*"), F.sum("_n")).first()
    if not groups:
        return _windowed(valued.withColumn("_edge", F.lit(_ROW)), keys, order, outputs).select(*df.columns, *outputs)

    match = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    listed = F.broadcast(hot) if groups <= BROADCAST_GROUPS else hot
    small = valued.join(listed, match, "left_anti").withColumn("_edge", F.lit(_ROW))
    cut = valued.join(listed, match, "left_semi").repartitionByRange(int(-(-2 * rows // hot_rows)), *keys, *order)
    path = work_dir(df.sparkSession, "slots")
    cut.withColumn("_slot", F.spark_partition_id().cast("long")).write.parquet(path)
    cut = df.sparkSession.read.parquet(path).withColumn("_edge", F.lit(_ROW))
    both = cut.unionByName(_edge_rows(cut, keys, order, outputs), allowMissingColumns=True)
    names = [*df.columns, *outputs]
    large = _windowed(both, [*keys, "_slot"], order, outputs)
    return _windowed(small, keys, order, outputs).select(*names).unionByName(large.select(*names))


def _windowed(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], outputs: Mapping[str, Running]
) -> DataFrame:
    group = Window.partitionBy(*keys)
    ahead = group.orderBy("_edge", *order).rowsBetween(Window.unboundedPreceding, -1)
    back = group.orderBy(F.desc("_edge"), *[F.desc(c) for c in order]).rowsBetween(
        Window.unboundedPreceding, -1
    )
    computed = {
        name: _fold(spec.kind, F.col(f"_v_{name}")).over(back if spec.backwards else ahead)
        for name, spec in outputs.items()
    }
    kept = [c for c in rows.columns if not c.startswith("_v_")]
    return rows.select(*kept, *[c.alias(name) for name, c in computed.items()]).filter(F.col("_edge") == _ROW)


def _fold(kind: str, value: Column) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True)
    if kind == "max":
        return F.max(value)
    if kind == "sum":
        return F.sum(value)
    raise ValueError(f"unknown running kind: {kind}")


def _edge_rows(
    cut: DataFrame, keys: Sequence[str], order: Sequence[str], outputs: Mapping[str, Running]
) -> DataFrame:
    """Per slot of a large group, the value carried in from its neighbours, one row per side."""
    at = F.struct(*order)
    summary = {}
    for name, spec in outputs.items():
        value = F.col(f"_v_{name}")
        if spec.kind == "last":
            pick = F.min_by if spec.backwards else F.max_by
            # A null ordering value makes max_by / min_by pass over the row.
            summary[name] = pick(value, F.when(value.isNotNull(), at))
        else:
            summary[name] = _fold(spec.kind, value)
    slots = cut.groupBy(*keys, "_slot").agg(*[c.alias(f"_v_{n}") for n, c in summary.items()])

    sides = []
    for backwards, edge in ((False, _FIRST_EDGE), (True, _LAST_EDGE)):
        names = [n for n, s in outputs.items() if s.backwards == backwards]
        if not names:
            continue
        along = F.desc("_slot") if backwards else F.asc("_slot")
        window = (
            Window.partitionBy(*keys)
            .orderBy(along)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        sides.append(
            slots.select(
                *keys,
                "_slot",
                F.lit(edge).alias("_edge"),
                *[
                    _fold(outputs[n].kind, F.col(f"_v_{n}")).over(window).alias(f"_v_{n}")
                    for n in names
                ],
            )
        )
    if len(sides) == 1:
        return sides[0]
    return sides[0].unionByName(sides[1], allowMissingColumns=True)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, the integer axis used for ordering and gaps."""
    return F.unix_micros(ts.cast("timestamp"))
