"""Customer timelines: merging channels, paging, coverage, compaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import fixed_values as fixed
from caseflow.functions.text import token_estimate
from caseflow.operators.ordered import HOT_ROWS, Running, micros, running

PAGE_LINES = 1000
EMPTY_TIMELINE = "No earlier records for this customer."
SEVERITY_ORDER = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
COMPACTED_CHANNEL = "COMPACTION"


def append_fragments(fragments: DataFrame, new: DataFrame) -> DataFrame:
    """Both sets of records in one shape; fields only one side has are null on the other."""
    return fragments.unionByName(new, allowMissingColumns=True)


def memories_of(fragments: DataFrame, customer_id) -> DataFrame:
    """One customer's records; an unknown id gives no rows. The filter reaches the scan."""
    return fragments.filter(F.col("customer_id") == F.lit(customer_id))


def timeline_line(veracity: bool = True) -> Column:
    """One fragment as a line of text."""
    evaluation = F.lit(fixed.UNVERIFIED_TEXT)
    if veracity:
        percent = (F.coalesce(F.col("veracity.confidence"), F.lit(1.0)) * 100).cast("int")
        evaluation = F.when(F.col("veracity").isNull(), evaluation).otherwise(
            F.concat(
                F.lit("[Veracity: "),
                F.coalesce(F.col("veracity.status"), F.lit("None")),
                F.lit(" (Conf: "),
                percent.cast("string"),
                F.lit("%)]"),
            )
        )
    compacted = F.when(F.coalesce("is_compacted_summary", F.lit(False)), fixed.COMPACTED_TEXT).otherwise("")
    return F.concat(
        F.lit("- ["), F.col("day_label"), F.lit("] ["), F.col("channel"), F.lit("]"),
        compacted, F.lit(" "), evaluation, F.lit(": "), F.col("summary"),
    )


def timeline_lines(fragments: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every fragment as a numbered line in time order, with the number of lines after it."""
    lines = fragments.select(
        "customer_id",
        "fragment_id",
        micros(F.col("ts")).alias("_us"),
        timeline_line("veracity" in fragments.columns).alias("line"),
    )
    numbered = running(
        lines,
        ["customer_id"],
        ["_us", "fragment_id"],
        {
            "_before": Running("sum", F.lit(1).cast("long")),
            "_after": Running("sum", F.lit(1).cast("long"), backwards=True),
        },
        hot_rows=hot_rows,
    )
    return numbered.select(
        "customer_id",
        "fragment_id",
        "line",
        F.coalesce("_before", F.lit(0)).alias("line_number"),
        F.coalesce("_after", F.lit(0)).alias("lines_after"),
    )


def timeline_context(
    customers: DataFrame, fragments: DataFrame, page_lines: int = PAGE_LINES, *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The timeline text of every customer, in time order, in pages.

    A customer with up to ``page_lines`` fragments has one page: the whole text. More fragments
    make more pages, because no row can hold a third of the table. Nothing is left out.
    """
    lines = timeline_lines(fragments, hot_rows=hot_rows)
    page = F.floor(F.col("line_number") / page_lines)
    body = (
        lines.groupBy("customer_id", page.alias("page"))
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("line_number", "line"))), lambda r: r["line"]
                ),
                "\n",
            ).alias("body"),
            F.min("lines_after").alias("after"),
            F.count(F.lit(1)).alias("lines"),
        )
    )
    header = F.concat(F.lit("=== TIMELINE (customer "), F.col("customer_id").cast("string"), F.lit(") ===\n"))
    text = F.concat(
        F.when(F.col("page") == 0, header).otherwise(""),
        F.col("body"),
        F.when(F.col("after") == 0, "\n=== END OF TIMELINE ===").otherwise(""),
    )
    pages = body.select("customer_id", "page", "lines", text.alias("context"))
    without = customers.select("customer_id").join(
        fragments.select("customer_id").distinct(), "customer_id", "left_anti"
    )
    empty = without.select(
        "customer_id",
        F.lit(0).cast("long").alias("page"),
        F.lit(0).cast("long").alias("lines"),
        F.lit(EMPTY_TIMELINE).alias("context"),
    )
    return pages.unionByName(empty)


def channel_coverage(customers: DataFrame, fragments: DataFrame, required: Sequence[str]) -> DataFrame:
    """Which of the required channels each customer has records on.

    One flag per required channel keeps the aggregate fixed in size and combinable in the tasks.
    """
    seen = fragments.groupBy("customer_id").agg(
        *[F.max(F.col("channel") == c).alias(f"_has_{i}") for i, c in enumerate(required)]
    )
    flags = [F.coalesce(F.col(f"_has_{i}"), F.lit(False)) for i in range(len(required))]
    missing = F.array_compact(F.array(*[F.when(~f, F.lit(c)) for f, c in zip(flags, required)]))
    return (
        customers.select("customer_id")
        .join(seen, "customer_id", "left")
        .withColumn("_missing", missing)
        .select(
            "customer_id",
            (F.lit(len(required)) - F.size("_missing")).alias("channels_present"),
            F.array_join(F.array_sort("_missing"), ", ").alias("missing_channels"),
            (F.size("_missing") == 0).alias("is_complete"),
        )
    )


def severity_rank(severity: Column) -> Column:
    rank = F.lit(-1)
    for i, name in enumerate(SEVERITY_ORDER):
        rank = F.when(severity == name, i).otherwise(rank)
    return rank


DIGEST_SCHEMA = (
    "customer_id BIGINT, channel STRING, fragments BIGINT, chars BIGINT, "
    "best STRUCT<rank: INT, us: BIGINT, fragment_id: BIGINT>, summary STRING, is_compacted_summary BOOLEAN"
)


def channel_digest(fragments: DataFrame) -> DataFrame:
    """Per customer and channel: how much there is and which fragment speaks for it.

    Only sizes and ids are aggregated, so texts are neither sorted nor shuffled here. Digests of
    separate inputs add up: see ``merge_digests``.
    """
    best = F.struct(
        severity_rank(F.col("severity")).alias("rank"), micros(F.col("ts")).alias("us"), "fragment_id"
    )
    return fragments.groupBy("customer_id", "channel").agg(
        F.count(F.lit(1)).alias("fragments"),
        F.sum(F.length("summary").cast("long")).alias("chars"),
        F.max(best).alias("best"),
    )


def with_best_text(digest: DataFrame, fragments: DataFrame) -> DataFrame:
    """Fetch the text of each channel's chosen fragment."""
    texts = fragments.select(
        "customer_id", "channel", "fragment_id", "summary", "is_compacted_summary"
    )
    chosen = digest.withColumn("fragment_id", F.col("best.fragment_id"))
    return chosen.join(texts, ["customer_id", "channel", "fragment_id"]).drop("fragment_id")


def merge_digests(digests: DataFrame) -> DataFrame:
    """Combine digests with text that were made from separate parts of the fragments."""
    return (
        digests.groupBy("customer_id", "channel")
        .agg(
            F.sum("fragments").alias("fragments"),
            F.sum("chars").alias("chars"),
            F.max(F.struct("best", "summary", "is_compacted_summary")).alias("m"),
        )
        .select(
            "customer_id", "channel", "fragments", "chars", "m.best", "m.summary", "m.is_compacted_summary"
        )
    )


def compaction_report(customers: DataFrame, digests: DataFrame) -> DataFrame:
    """One compacted text per customer with what it saves; customers without records are NO_OP.

    The text joins one line per channel, so its parts are as many as there are channels.
    """
    line = F.when(F.col("is_compacted_summary"), F.col("summary")).otherwise(
        F.concat(F.lit("["), F.col("channel"), F.lit("] "), F.col("summary"))
    )
    per_customer = digests.groupBy("customer_id").agg(
        F.sum("fragments").alias("fragments"),
        F.sum("chars").alias("chars"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("channel", line.alias("line")))), lambda r: r["line"]
            ),
            "\n",
        ).alias("compacted_summary"),
    )
    raw = token_estimate(F.col("chars"))
    compact = token_estimate(F.length("compacted_summary"), floor=None)
    saved = raw - compact
    # array_join over no rows gives an empty text, so the join decides what is missing.
    return (
        customers.select("customer_id")
        .join(per_customer, "customer_id", "left")
        .select(
            "customer_id",
            F.when(F.col("fragments").isNull(), "NO_OP").otherwise("COMPACTED").alias("status"),
            F.coalesce("fragments", F.lit(0)).alias("source_fragments"),
            F.when(F.col("fragments").isNotNull(), raw).alias("raw_tokens"),
            F.when(F.col("fragments").isNotNull(), compact).alias("compacted_tokens"),
            F.when(F.col("fragments").isNotNull(), F.bround(saved / raw * 100, 1)).alias("reduction_pct"),
            F.when(
                F.col("fragments").isNotNull(), F.bround(saved * fixed.COMPACTION_USD_PER_TOKEN, 5)
            ).alias("saved_usd"),
            F.when(F.col("fragments").isNotNull(), F.greatest(F.lit(0), saved)).alias("tokens_saved"),
            "compacted_summary",
        )
    )


def compact_memory(customers: DataFrame, fragments: DataFrame) -> DataFrame:
    """Replace each customer's fragments by the best one of every channel."""
    return compaction_report(customers, with_best_text(channel_digest(fragments), fragments))


def compacted_fragments(report: DataFrame) -> DataFrame:
    """The fragments that take the place of the compacted ones: one flagged row per customer."""
    return report.filter(F.col("status") == "COMPACTED").select(
        F.concat(F.lit("compact-"), F.sha2(F.col("customer_id").cast("string"), 256)).alias("fragment_id"),
        "customer_id",
        F.lit(COMPACTED_CHANNEL).alias("channel"),
        F.lit("Compacted Context").alias("day_label"),
        F.lit("INFO").alias("severity"),
        F.col("compacted_summary").alias("summary"),
        F.lit(True).alias("is_compacted_summary"),
        F.struct(F.lit("VERIFIED_TRUE").alias("status"), F.lit(0.99).alias("confidence")).alias("veracity"),
    )
