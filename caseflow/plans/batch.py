"""The registered batch queries: a mapping of the given tables fed to an operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions import fixed_values as fixed
from caseflow.functions import rules, text
from caseflow.functions.redact import redact_columns
from caseflow.operators import correlate, lookup, memory, resolve, scoring, spans, usage, validate
from caseflow.plans import mapping
from caseflow.session import work_dir
from caseflow.sources import notifications, records

Query = Callable[[SparkSession, str], DataFrame]


# --- correlation ------------------------------------------------------------------------------


def velocity_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.velocity_alerts(mapping.signals(spark, sf_dir), mapping.locations(spark, sf_dir))


def unfamiliar_high_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.unfamiliar_high_value(mapping.merchant_charges(spark, sf_dir))


def step_up_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.step_up_audit(mapping.challenges(spark, sf_dir), mapping.replies(spark, sf_dir))


def travel_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.travel_coverage(mapping.travel_charges(spark, sf_dir), mapping.travel_notices(spark, sf_dir))


def covered_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The charges a travel notice covers, and those none does."""
    inputs = mapping.travel_charges(spark, sf_dir), mapping.travel_notices(spark, sf_dir)
    covered, other = (correlate.covered_charges(*inputs, covered=c).withColumn("covered", F.lit(c)) for c in (True, False))
    return covered.unionByName(other)


def incident_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.incident_chain(
        mapping.declines(spark, sf_dir), mapping.calls(spark, sf_dir), mapping.wallet_failures(spark, sf_dir)
    )


def status_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.status_asof(mapping.purchases(spark, sf_dir), mapping.status_events(spark, sf_dir))


def recurring_payees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.recurring_payees(mapping.merchant_charges(spark, sf_dir))


def biller_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = mapping.customers(spark, sf_dir).select("customer_id", F.right("name", F.lit(4)).alias("card_last4"))
    return correlate.biller_fanout(cards, recurring_payees(spark, sf_dir))


def claim_veracity(spark: SparkSession, sf_dir: str) -> DataFrame:
    suspect = step_up_audit(spark, sf_dir).filter(F.col("compromise_likelihood") == "HIGH")
    evidence = resolve.evidence_rows(
        ("ledger_rows", mapping.transactions(spark, sf_dir)),
        ("notices", mapping.travel_notices(spark, sf_dir)),
        ("baseline_rows", mapping.signals(spark, sf_dir)),
        ("suspect_replies", suspect),
    )
    return resolve.claim_veracity(
        mapping.claims(spark, sf_dir), evidence, mapping.policies(spark, sf_dir), mapping.CLAIM_WORDS
    )


# --- text, rules, checks ----------------------------------------------------------------------


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    redacted = text.redact_text(F.col("text"))
    return mapping.table(spark, sf_dir, "documents").select(
        "doc_id", redacted.alias("redacted_text"), (redacted != F.col("text")).alias("was_changed")
    )


def redact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = "details"
    return redact_columns(mapping.event_details(spark, sf_dir)).select(
        "event_id",
        F.col(f"{d}.PIN").alias("pin"),
        F.col(f"{d}.note").alias("note"),
        F.col(f"{d}.device.otp").alias("device_otp"),
        F.col(f"{d}.device.label").alias("device_label"),
        F.array_join(f"{d}.remarks", "|").alias("remarks"),
        F.col(f"{d}.attributes")["Cvv"].alias("cvv"),
        F.col(f"{d}.attributes")["memo"].alias("memo"),
        F.col(f"{d}.amount").alias("amount"),
    )


def mask_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    last4 = text.clean_last4(F.col("card_ending"))
    return mapping.card_endings(spark, sf_dir).select(
        "customer_id", last4.alias("last4"), text.mask_pan(last4).alias("masked_pan"), last4.isNotNull().alias("is_valid")
    )


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.table(spark, sf_dir, "documents").select(
        "doc_id",
        text.token_estimate(F.length("text")).alias("tokens"),
        text.token_estimate(F.length("lang"), floor=None).alias("unfloored_tokens"),
    )


def tag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tag_documents(
        mapping.table(spark, sf_dir, "documents").select("doc_id", "text"), rules=mapping.TAG_WORDS
    ).select("doc_id", "tags", "word_count")


def route_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    intent = rules.route_intent(F.col("claim_text"), mapping.INTENT_WORDS)
    audited = rules.needs_audit(F.col("claim_text"), mapping.AUDIT_WORDS)
    return mapping.claims(spark, sf_dir).select(
        "customer_id",
        "turn",
        intent.alias("intent"),
        audited.alias("is_audited"),
        rules.tools_used(intent, audited).alias("tools"),
    )


def claim_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.claims(spark, sf_dir).select(
        "customer_id", "turn", rules.claim_scenario(F.col("claim_text"), mapping.CLAIM_WORDS).alias("scenario")
    )


def model_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.work_items(spark, sf_dir).select(
        "event_id", rules.model_tier(F.col("task"), F.col("risk"), F.col("multi_hop")).alias("tier")
    )


def validate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [
        validate.blank("customer_id", "INVALID_CUSTOMER", fallback="card_status"),
        validate.reserved_id("customer_id", fallback="card_status"),
        validate.not_positive("amount", fallback="account_statement"),
        validate.bad_last4("card_ending"),
        validate.short_address("address"),
    ]
    return validate.checked(mapping.flawed_orders(spark, sf_dir), checks).select(
        "transaction_id", "error_type", "error_message", "retryable", "fallback"
    )


def gate_disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = rules.approval_gate(F.col("amount"), mapping.GATE_LIMIT, F.col("approved"), F.col("token"))
    return mapping.disputable(spark, sf_dir).select("transaction_id", "amount", gate.alias("decision"))


def gate_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole session's gate: a partly approved order waits where its session asks for confirmation."""
    gate = rules.session_gate(
        F.col("approved"), F.col("transaction_id") % 3 == 0, F.col("transaction_id") % 2 == 0,
        F.col("amount"), mapping.GATE_LIMIT, F.col("token"),
    )
    return mapping.disputable(spark, sf_dir).select("transaction_id", gate.alias("decision"))


def normalise_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.normalise_logs(mapping.log_rows(spark, sf_dir))


# --- lookups and searches ---------------------------------------------------------------------


def account_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.account_statement(mapping.customers(spark, sf_dir), mapping.transactions(spark, sf_dir))


def card_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.card_status(mapping.status_events(spark, sf_dir))


def channel_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.channel_activity(mapping.signals(spark, sf_dir), "click")


def channel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.channel_summary(mapping.signals(spark, sf_dir))


def channel_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.channel_logs(mapping.signals(spark, sf_dir), ["click", "view", "error"])


def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.memory_search(
        mapping.searchable_documents(spark, sf_dir), mapping.memory_queries(spark, sf_dir)
    )


def policy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.policy_search(mapping.policies(spark, sf_dir), mapping.policy_queries(spark, sf_dir))


def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against a rule table with the words of all benchmark items."""
    documents = mapping.table(spark, sf_dir, "documents").select("doc_id", "text")
    return lookup.match_rules(documents, mapping.word_rules(spark, sf_dir), "doc_id", "text", "none")


# --- timelines --------------------------------------------------------------------------------


def merge_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = mapping.event_fragments(spark, sf_dir).select(
        F.concat(F.lit("event-"), F.col("fragment_id").cast("string")).alias("fragment_id"),
        "customer_id",
        "channel",
        "ts",
        "summary",
        "severity",
    )
    return memory.append_fragments(events, mapping.chat_fragments(spark, sf_dir))


def timeline_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.timeline_context(mapping.customers(spark, sf_dir), mapping.event_fragments(spark, sf_dir))


def channel_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.channel_coverage(
        mapping.customers(spark, sf_dir), mapping.event_fragments(spark, sf_dir), mapping.REQUIRED_CHANNELS
    )


def compact_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.compact_memory(mapping.customers(spark, sf_dir), mapping.event_fragments(spark, sf_dir))


def compacted_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot that takes the place of the compacted fragments."""
    snapshot = memory.compacted_fragments(compact_memory(spark, sf_dir))
    return snapshot.select(
        "fragment_id", "customer_id", "channel", "severity", "summary", "is_compacted_summary", F.col("veracity.status").alias("status")
    )


def claim_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' timeline with the verified claims appended."""
    events = mapping.event_fragments(spark, sf_dir).withColumn("fragment_id", F.col("fragment_id").cast("string"))
    both = memory.append_fragments(events, resolve.verified_fragments(claim_veracity(spark, sf_dir)))
    return both.select(
        "fragment_id", "customer_id", "channel", "ts", "summary", F.col("veracity.status").alias("status"),
        F.col("veracity.confidence").alias("confidence"),
    )


def compact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = mapping.document_fragments(spark, sf_dir)
    return memory.compact_memory(documents.select("customer_id").distinct(), documents)


# --- usage, spans, scores ---------------------------------------------------------------------


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.token_usage(mapping.turns(spark, sf_dir))


def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.sessions(usage.session_records(mapping.signals(spark, sf_dir)), gap_minutes=60)


def span_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.span_stats(mapping.spans(spark, sf_dir), limit_ms=100)


def recent_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.recent_spans(mapping.spans(spark, sf_dir))


def span_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.span_pairs(mapping.spans(spark, sf_dir))


def score_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_rollup(mapping.quality_scores(spark, sf_dir))


def eval_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.eval_scoring(*mapping.eval_inputs(spark, sf_dir))


def leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks before and after redaction, counted in one scan."""
    columns = ["text", "source", "lang"]
    both = mapping.table(spark, sf_dir, "documents").select(
        *columns, *[text.redact_text(F.col(c)).alias(f"after_{c}") for c in columns]
    )
    counted = scoring.leak_audit(both, both.columns, mapping.LEAK_PATTERNS, fixed.FORBIDDEN_TELEMETRY_KEYS)
    is_after = F.startswith("column_name", F.lit("after_"))
    return counted.select(
        F.when(is_after, "after").otherwise("before").alias("stage"),
        F.regexp_replace("column_name", "^after_", "").alias("column_name"),
        "pattern",
        "rows_with_match",
        "matches",
    )


def risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.risk_summary(mapping.risk_alerts(spark, sf_dir))


# --- case decisions ---------------------------------------------------------------------------


def file_disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.file_disputes(mapping.disputable(spark, sf_dir), mapping.GATE_LIMIT)


def dispute_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.dispute_totals(file_disputes(spark, sf_dir))


def resolve_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = resolve.resolve_cases(mapping.open_cases(spark, sf_dir), mapping.GATE_LIMIT, mapping.CARD_LIMIT)
    return cases.select(
        "case_id",
        "customer_id",
        "status",
        "failed_step",
        "old_card_action",
        F.col("dispute.status").alias("dispute_status"),
        F.col("dispute.case_id").alias("dispute_case_id"),
        F.col("dispute.credit").alias("credit"),
        F.col("virtual_card.vcn_id").alias("vcn_id"),
        F.col("virtual_card.masked_pan").alias("masked_pan"),
        F.col("virtual_card.spending_limit").alias("spending_limit"),
        F.col("courier.tracking_number").alias("tracking_number"),
        F.col("courier.address").alias("address"),
        F.col("courier.estimated_delivery").alias("estimated_delivery"),
        "billers_updated",
        "trace_id",
    )


def case_disputes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The disputes of every resolved case; every fifth case leaves them out."""
    cases = resolve.resolve_cases(mapping.open_cases(spark, sf_dir), mapping.GATE_LIMIT, mapping.CARD_LIMIT)
    return resolve.case_disputes(cases, mapping.case_charges(spark, sf_dir), F.col("case_id") % 5 != 0, mapping.CHARGE_LIMIT)


# --- ingest -----------------------------------------------------------------------------------


def decode_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notifications.decoded(mapping.notifications(spark, sf_dir)).select(
        "doc_id", "delivery", "bucket", "name", "time_created", "generation", "reject_reason"
    )


def attach_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable, _ = notifications.decode_notifications(mapping.notifications(spark, sf_dir))
    return notifications.attach_content(usable, mapping.stored_objects(spark, sf_dir)).select(
        "doc_id", "delivery", "name", "status", F.length("content").alias("chars"), F.md5("content").alias("content_md5")
    )


def metadata_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable, _ = notifications.decode_notifications(mapping.notifications(spark, sf_dir))
    contents = notifications.attach_content(
        notifications.one_per_object(usable), mapping.stored_objects(spark, sf_dir)
    )
    return notifications.metadata_rows(contents, mapping.TAG_WORDS, F.lit(mapping.NOW))


def appended_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata appended in two batches, the first of them twice, as after a failure, and read back."""
    rows = stored_copy(metadata_rows(spark, sf_dir), "metadata")
    path = work_dir(spark, "metadata-table")
    even = F.pmod(F.crc32("filename"), F.lit(2)) == 0
    for name, part in (("0", even), ("0", even), ("1", ~even)):
        notifications.append_metadata(rows.where(part), path, name)
    return notifications.read_metadata(spark, path).drop("batch")


def stored_copy(df: DataFrame, name: str) -> DataFrame:
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def eval_set_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation sets written as files, read back and scored."""
    sets, outputs = mapping.eval_set_records(spark, sf_dir)
    path = work_dir(spark, "eval-sets")
    records.write_eval_sets(sets, path)
    return scoring.eval_scoring(records.scoring_cases(records.read_eval_sets(spark, path)), outputs)


def explode_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = mapping.nested_records(spark, sf_dir)
    listed = records.explode_records(nested, "records", ["event_id"])
    keyed = records.explode_records(nested, "props_map", ["event_id"]).select(
        "event_id", F.col("key").alias("label"), F.col("value").cast("double").alias("amount")
    )
    return listed.withColumn("kind", F.lit("list")).unionByName(keyed.withColumn("kind", F.lit("map")))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        velocity_alerts,
        unfamiliar_high_value,
        step_up_audit,
        travel_coverage,
        covered_charges,
        incident_chain,
        status_asof,
        claim_veracity,
        recurring_payees,
        biller_fanout,
        redact_documents,
        redact_events,
        mask_accounts,
        token_estimate,
        tag_documents,
        route_intent,
        claim_scenario,
        model_tier,
        validate_orders,
        gate_disputes,
        gate_sessions,
        normalise_logs,
        account_statement,
        card_status,
        channel_activity,
        channel_summary,
        channel_logs,
        memory_search,
        policy_search,
        rule_table,
        merge_channels,
        timeline_context,
        channel_coverage,
        compact_memory,
        compacted_memory,
        compact_documents,
        claim_fragments,
        token_usage,
        activity_sessions,
        span_stats,
        recent_spans,
        span_pairs,
        score_rollup,
        eval_scoring,
        eval_set_files,
        appended_metadata,
        leak_audit,
        risk_summary,
        file_disputes,
        dispute_totals,
        resolve_cases,
        case_disputes,
        decode_notifications,
        attach_content,
        metadata_rows,
        explode_props,
    )
}
