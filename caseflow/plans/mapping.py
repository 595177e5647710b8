"""The given tables seen as the domain's records.

Each view is a projection (and at most a filter) of one table, so column pruning and filter
pushdown reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions import fixed_values as fixed
from caseflow.functions.rules import needs_audit, route_intent, tools_used
from caseflow.functions.text import CARD_NUMBER, IDENTITY_NUMBER, strip
from caseflow.operators.correlate import recurring_payees, step_up_audit, velocity_alerts
from caseflow.operators.skew import spread_join

NOTICE_PRIORITY = "1-URGENT"
NOTICE_DAYS = 14
LOCATIONS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def props_key() -> Column:
    """The number in an event's ``{"k": n}`` properties."""
    return F.get_json_object("props", "$.k").cast("int")


def signals_from(events: DataFrame) -> DataFrame:
    """Cross-channel signals: who was seen where, when, on which channel."""
    return events.select(
        F.col("event_id").alias("signal_id"),
        F.col("user_id").alias("customer_id"),
        "ts",
        F.col("event_type").alias("channel"),
        F.col("value").alias("amount"),
        (props_key() % LOCATIONS).alias("location_id"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals_from(table(spark, sf_dir, "events"))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per location; the coordinates are invented from the key."""
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        key.alias("location_id"),
        F.col("n_name").alias("city"),
        ((key * 37) % 121 - 60).cast("double").alias("lat"),
        ((key * 53) % 361 - 180).cast("double").alias("lon"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )


def merchant_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as charges at a merchant; the order gives the customer and the date."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("customer_id"),
        F.col("l_suppkey").alias("merchant_id"),
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("l_extendedprice").alias("amount"),
    )


def travel_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders as notices that run from the order date for two weeks."""
    start = F.col("o_orderdate").cast("date")
    return (
        table(spark, sf_dir, "orders")
        .filter(F.col("o_orderpriority") == NOTICE_PRIORITY)
        .select(
            F.col("o_orderkey").alias("notice_id"),
            F.col("o_custkey").alias("customer_id"),
            start.alias("start_date"),
            F.date_add(start, NOTICE_DAYS).alias("end_date"),
        )
    )


def travel_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .filter(F.col("o_orderpriority") != NOTICE_PRIORITY)
        .select(
            F.col("o_orderkey").alias("charge_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").cast("date").alias("charge_date"),
        )
    )


def _events_of(events: DataFrame, kind: str, prefix: str, *extra: Column) -> DataFrame:
    return events.filter(F.col("event_type") == kind).select(
        F.col("event_id").alias(f"{prefix}_id"),
        F.col("user_id").alias("customer_id"),
        F.col("ts").alias(f"{prefix}_ts"),
        *extra,
    )


def challenges_from(events: DataFrame) -> DataFrame:
    return _events_of(events, "signup", "challenge", props_key().alias("challenge_origin"))


def replies_from(events: DataFrame) -> DataFrame:
    return _events_of(events, "click", "reply", props_key().alias("reply_origin"))


def challenges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return challenges_from(table(spark, sf_dir, "events"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies_from(table(spark, sf_dir, "events"))


def declines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events_of(table(spark, sf_dir, "events"), "error", "decline")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events_of(table(spark, sf_dir, "events"), "click", "call")


def wallet_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events_of(table(spark, sf_dir, "events"), "signup", "wallet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events_of(table(spark, sf_dir, "events"), "purchase", "charge")


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors lock a card, signups activate it."""
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type").isin("error", "signup"))
        .select(
            F.col("event_id").alias("status_id"),
            F.col("user_id").alias("customer_id"),
            F.col("ts").alias("status_ts"),
            F.when(F.col("event_type") == "error", "LOCKED").otherwise("ACTIVE").alias("status"),
        )
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation_id"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers say: the user turns; a conversation belongs to the customer of its number."""
    return (
        table(spark, sf_dir, "conversations")
        .filter(F.col("role") == "user")
        .select(
            F.col("conv_id").alias("customer_id"),
            F.col("turn").alias("turn"),
            F.col("text").alias("claim_text"),
        )
    )


def event_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_fragments_from(table(spark, sf_dir, "events"))


def event_fragments_from(events: DataFrame) -> DataFrame:
    """Events as timeline fragments; every evaluation case occurs, a missing one too."""
    kind = F.col("event_type")
    confidence = (
        F.when(kind == "error", 0.15).when(kind == "signup", 0.99).when(kind == "purchase", 0.57)
    )
    status = (
        F.when(kind == "error", "CONTRADICTED_BY_TELEMETRY")
        .when(kind.isin("signup", "view"), "VERIFIED_TRUE")
        .when(kind == "purchase", "UNVERIFIED_PENDING")
    )
    return events.select(
        F.col("event_id").alias("fragment_id"),
        F.col("user_id").alias("customer_id"),
        kind.alias("channel"),
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("day_label"),
        "ts",
        F.concat_ws(" ", kind, F.lit("value"), F.col("value").cast("decimal(12,2)").cast("string"),
                    F.lit("props"), F.col("props")).alias("summary"),
        F.when(kind == "error", "HIGH").when(kind == "purchase", "MEDIUM").otherwise("INFO").alias("severity"),
        F.lit(False).alias("is_compacted_summary"),
        F.when(kind != "click", F.struct(status.alias("status"), confidence.alias("confidence"))).alias("veracity"),
    )


def document_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as fragments of their source, one channel per language."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("fragment_id"),
        F.col("source").alias("customer_id"),
        F.col("lang").alias("channel"),
        F.timestamp_seconds(F.col("doc_id")).alias("ts"),
        F.col("text").alias("summary"),
        F.when(F.col("n_chars") >= 2000, "HIGH").when(F.col("n_chars") >= 500, "MEDIUM").otherwise("INFO").alias("severity"),
        F.lit(False).alias("is_compacted_summary"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_from(table(spark, sf_dir, "events"))


def spans_from(events: DataFrame) -> DataFrame:
    """Events as telemetry spans: clicks start work, views complete it."""
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("span_id"),
        F.col("user_id").alias("session_id"),
        F.when(kind == "click", "START").when(kind == "view", "COMPLETE").otherwise(kind).alias("span_type"),
        F.concat(F.lit("tool_"), (props_key() % 5).cast("string")).alias("name"),
        "ts",
        F.col("value").alias("duration_ms"),
    )


# --- words that occur in the given texts --------------------------------------------------------
# The domain's own words do not, so the keyword queries add these to exercise every branch.

TAG_WORDS = {
    **fixed.DOCUMENT_TAGS,
    "credential": ["token", "password", "@"],
    "licence": ["license", "apache", "mit"],
}
INTENT_WORDS = [
    (label, [*words, extra])
    for (label, words), extra in zip(fixed.INTENT_RULES, ["with", "from", "und ", "que "])
]
AUDIT_WORDS = [*fixed.AUDIT_WORDS, "this", "der "]
CLAIM_WORDS = [
    (label, [*words, extra])
    for (label, words), extra in zip(fixed.CLAIM_RULES, ["with", "from", "und ", "que "])
]
GATE_LIMIT = 250_000.0
CHARGE_LIMIT = 30_000.0
CARD_LIMIT = 9_000.0
REQUIRED_CHANNELS = ["click", "error", "purchase", "signup"]
NOW = "2026-01-01T00:00:00Z"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the sizes of the turn before (their context) and of the reply after.

    Turn numbers are unique in a conversation, so the neighbours are fetched by equality.
    """
    text = table(spark, sf_dir, "conversations")
    sized = text.select("conv_id", "turn", "role", F.length("text").alias("chars"))
    before = sized.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("chars").alias("memory"))
    after = sized.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("chars").alias("reply")
    )
    intent = route_intent(F.col("text"), INTENT_WORDS)
    audited = needs_audit(F.col("text"), AUDIT_WORDS)
    asked = text.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.length(strip(F.col("text"))).alias("chars"), tools_used(intent, audited).alias("tools")
    )
    return (
        asked.join(before, ["conv_id", "turn"], "left")
        .join(after, ["conv_id", "turn"], "left")
        .select(
            F.col("conv_id").alias("session_id"),
            "turn",
            F.coalesce("memory", F.lit(0)).alias("memory_chars"),
            F.col("chars").alias("message_chars"),
            F.coalesce("reply", F.lit(0)).alias("reply_chars"),
            "tools",
        )
    )


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as policies, titled by their item number."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("policy_id"),
        F.col("item_id").alias("position"),
        F.concat(F.lit("policy "), F.col("item_id").cast("string")).alias("title"),
        F.col("text").alias("summary"),
    )


def item_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, word): every distinct word of every benchmark item, and one for each that no text has."""
    items = table(spark, sf_dir, "benchmark")
    words = items.select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word <> ''")
    none = items.select("item_id", F.concat(F.lit("qzx"), F.col("item_id").cast("string")).alias("word"))
    return words.union(none).distinct()


def word_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for every word of the benchmark items: longer words come first, words of one length and first letter are one rule."""
    words = item_words(spark, sf_dir).select("word").distinct()
    return words.select(
        (F.lit(100) - F.length("word")).cast("long").alias("priority"),
        F.concat(F.lit("starts-"), F.left("word", F.lit(1))).alias("label"),
        "word",
    )


def policy_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word that an item has, with the same turned round as a second one; each such pair is a query."""
    words = item_words(spark, sf_dir).select("word").distinct()
    return words.select(F.col("word").alias("query_id"), F.concat_ws(" ", "word", F.reverse("word")).alias("query"))


def memory_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every benchmark item, asked about one source's documents; items are dealt over the sources."""
    sources = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source").distinct()
    names = sorted(r[0] for r in sources.collect())  # a name for each source
    listed = spark.createDataFrame(list(enumerate(names)), "n int, customer_id string")
    words = item_words(spark, sf_dir).withColumn("n", (F.col("item_id") % max(1, len(names))).cast("int"))
    return words.join(F.broadcast(listed), "n").select(
        F.concat_ws("-", F.col("item_id").cast("string"), "word").alias("query_id"), "customer_id", F.col("word").alias("query")
    )


def searchable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("fragment_id"),
        F.col("source").alias("customer_id"),
        F.col("lang").alias("channel"),
        F.col("text").alias("summary"),
        F.create_map(F.lit("size"), F.col("n_chars").cast("string")).alias("metadata"),
    )


def chat_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("chat"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("fragment_id"),
        F.col("conv_id").alias("customer_id"),
        F.concat(F.lit("chat_"), F.col("role")).alias("channel"),
        F.col("text").alias("summary"),
    )


def disputable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as disputed transactions: some without a merchant, unapproved, or with a token."""
    priority = F.col("priority")
    return transactions(spark, sf_dir).select(
        "transaction_id",
        "customer_id",
        "ts",
        "amount",
        F.when(priority == "4-NOT SPECIFIED", "  ").otherwise(priority).alias("merchant"),
        (F.col("status") != "P").alias("approved"),
        F.when(priority == "2-HIGH", "token").otherwise(F.lit(None)).alias("token"),
    )


def case_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as the flagged charges of its case: some without a merchant, some with a token."""
    returned = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("transaction_id"),
        F.col("l_extendedprice").alias("amount"),
        F.when(returned == "A", " ").otherwise(F.col("l_suppkey").cast("string")).alias("merchant"),
        F.when(returned == "R", "token").alias("token"),
    )


def flawed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with every kind of input error, told by their own values."""
    priority, status, amount = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice")
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.when(priority == "5-LOW", " Unknown ")
        .when((priority == "4-NOT SPECIFIED") & (status == "P"), " \t")
        .otherwise(F.col("o_custkey").cast("string"))
        .alias("customer_id"),
        F.when(amount > 450_000, float("nan")).when(amount < 50_000, -amount).otherwise(amount).alias("amount"),
        F.when(
            (priority == "3-MEDIUM") & (status == "F"), "ab12"
        ).otherwise(F.concat(F.lit(" **"), F.when(F.length(key) > 4, key).otherwise(F.lpad(key, 4, "0")))).alias("card_ending"),
        F.when((priority == "2-HIGH") & (status == "O"), " 12 ").otherwise(priority).alias("address"),
    )


def open_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as compromised-card cases, joined with their customer and recurring payees."""
    billers = (
        recurring_payees(merchant_charges(spark, sf_dir)).groupBy("customer_id").agg(F.count(F.lit(1)).alias("billers"))
    )
    holder = customers(spark, sf_dir).select(
        "customer_id",
        F.col("balance").alias("spending_limit"),
        F.right("name", F.lit(4)).alias("card_last4"),
        F.when(F.col("segment") == "FURNITURE", F.lit(" N/A ")).otherwise(F.col("name")).alias("address"),
    )
    cases = disputable(spark, sf_dir).withColumn("case_id", F.col("transaction_id")).withColumnRenamed("ts", "opened_at")
    # One row per customer first, so the cases are shuffled once.
    profile = holder.join(billers, "customer_id", "left")
    return spread_join(cases, profile, ["customer_id"], ["case_id"], "left")


def risk_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocity alerts and mismatched replies as rows of (customer_id, kind, ts)."""
    moved = velocity_alerts(signals(spark, sf_dir), locations(spark, sf_dir))
    audited = step_up_audit(challenges(spark, sf_dir), replies(spark, sf_dir))
    suspect = audited.filter(F.col("compromise_likelihood") == "HIGH")
    return moved.select("customer_id", F.lit("VELOCITY").alias("kind"), "ts").unionByName(
        suspect.select("customer_id", F.lit("STEP_UP_MISMATCH").alias("kind"), F.col("challenge_ts").alias("ts"))
    )


def notifications_from(documents: DataFrame) -> DataFrame:
    """Every document as a storage notification; some come twice, and each has a faulty one beside it.

    Delivery 1 is good, 2 repeats it, 3 is broken in one of nine ways or names an object that is gone.
    """
    doc, fault = F.col("doc_id"), F.col("sent.fault")
    created = F.date_format(F.timestamp_seconds(doc + 1_700_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.struct(
        F.concat(F.lit("docs-"), F.col("lang")).alias("bucket"),
        F.when(fault == 10, F.concat(F.lit("gone/"), object_name())).when(fault != 5, object_name()).alias("name"),
        F.when(doc % 7 != 0, created).alias("timeCreated"),
        doc.cast("string").alias("generation"),
    )
    data = F.when(fault == 4, F.base64(F.encode(F.lit("{oops"), "UTF-8"))).when(
        fault != 3, F.base64(F.encode(F.to_json(body), "UTF-8"))
    )
    message = F.struct(data.alias("data"), doc.cast("string").alias("messageId"), created.alias("publishTime"))
    raw = (
        F.when(fault == 1, F.when(doc % 20 == 1, "").otherwise("{}"))
        .when(fault == 2, '{"subscription":"files"}')
        .when(fault == 6, F.when(doc % 20 == 6, "5").otherwise('"text"'))
        .when(fault == 7, '{"message":{"data":""}}')
        .when(fault == 8, '{"message":{"data":null}}')
        .when(fault == 9, "\t\n")
        .otherwise(F.to_json(F.struct(message.alias("message"), F.lit("files").alias("subscription"))))
    )

    def delivery(number: int, how: Column) -> Column:
        return F.struct(F.lit(number).alias("delivery"), how.cast("int").alias("fault"))

    sent = F.array(
        delivery(1, F.lit(0)),
        F.when(doc % 8 == 0, delivery(2, F.lit(0))),
        delivery(3, F.when(doc % 10 == 0, 10).otherwise(doc % 10)),
    )
    return documents.select("doc_id", "lang", "source", F.explode(F.array_compact(sent)).alias("sent")).select(
        "doc_id",
        raw.alias("raw"),
        F.timestamp_seconds(doc + 1_700_000_000).alias("received_at"),
        F.col("sent.delivery").alias("delivery"),
    )


def object_name() -> Column:
    return F.concat_ws("", F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notifications_from(table(spark, sf_dir, "documents"))


def stored_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in storage: every document."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs-"), F.col("lang")).alias("bucket"),
        object_name().alias("name"),
        F.col("text").alias("content"),
    )


def event_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with nested details that hold card and identity numbers and secrets."""
    key = F.col("event_id").cast("string")
    card = F.concat(F.lit("4"), F.lpad(key, 15, "0"))
    identity = F.concat(F.lit("123-45-"), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.struct(
            props_key().alias("PIN"),
            F.concat_ws(" ", F.lit("card"), card, F.lit("of"), F.col("user_id").cast("string")).alias("note"),
            F.struct(F.lit(None).cast("string").alias("otp"), F.col("event_type").alias("label")).alias("device"),
            F.array(F.concat(F.lit("id "), identity), F.col("event_type")).alias("remarks"),
            F.create_map(
                F.lit("Cvv"), F.col("value").cast("string"), F.lit("memo"), F.concat(F.lit("paid with "), card)
            ).alias("attributes"),
            F.col("value").alias("amount"),
        ).alias("details"),
    )


def card_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card endings as customers write them."""
    ending = F.right("name", F.lit(4))
    return customers(spark, sf_dir).select(
        "customer_id",
        F.when(F.col("segment") == "HOUSEHOLD", F.concat(F.lit(" **"), ending, F.lit(" \n")))
        .when(F.col("segment") == "BUILDING", F.concat(F.lit("* "), ending))
        .when(F.col("segment") == "FURNITURE", F.col("name"))
        .otherwise(ending)
        .alias("card_ending"),
    )


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines; every second one lacks the service."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("level"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("svc-"), F.col("user_id").cast("string"))).alias("service"),
        F.when(F.col("event_type") == "error", "gateway").alias("component"),
        F.col("user_id").alias("trace_number"),
        F.col("event_id").alias("span_number"),
    )


def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as work items: the kind of task from the event, the risk from its key."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "error", "VERACITY_AUDIT")
        .when(kind == "click", "IVR_LOG_LOOKUP")
        .when(kind == "signup", "WALLET_EVENT_LOOKUP")
        .otherwise("CARD_OPS")
        .alias("task"),
        props_key().alias("risk"),
        (F.col("value") > 200).alias("multi_hop"),
    )


def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a list of small records; views have an empty one."""
    record = "array<struct<label:string,amount:double>>"
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(
            F.col("event_type") != "view",
            F.array(
                F.struct(F.lit("k").alias("label"), props_key().cast("double").alias("amount")),
                F.struct(F.col("event_type").alias("label"), F.col("value").alias("amount")),
            ),
        )
        .otherwise(F.array().cast(record))
        .alias("records"),
        F.from_json("props", "map<string,int>").alias("props_map"),
    )


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels as scores: the language is the set, the source the pillar."""
    where = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return table(spark, sf_dir, "labels").join(where, "doc_id").select(
        F.col("lang").alias("set"),
        F.col("source").alias("pillar"),
        (F.col("quality") * 19).cast("long").alias("score"),
        F.lit(19).cast("long").alias("max_score"),
    )


def eval_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark items as cases, each asking for different checks, and documents as outputs.

    The outputs are dealt to as many cases as the table has numbers for.
    """
    last = table(spark, sf_dir, "benchmark").agg(F.max("item_id")).first()[0]
    item = F.col("item_id")
    first = F.element_at(F.split("text", " "), 1)
    cases = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("set-"), (item % 5).cast("string")).alias("eval_set_id"),
        item.alias("eval_id"),
        F.when(item % 4 == 3, 4).otherwise(5).alias("weight_points"),
        F.when(item % 2 == 0, F.array(first)).alias("expected_terms"),
        F.array(F.lit("password"), F.lit("Full_Pan")).alias("forbidden_terms"),
        F.when(item % 3 == 0, F.array(F.lit("[a-z]{4}"))).alias("required_patterns"),
        F.array(F.lit("[0-9]{16}")).alias("forbidden_patterns"),
        F.when(item % 5 == 0, F.lit("src1")).alias("expected_prefix"),
        F.when(item % 2 == 1, F.lit(100.0)).alias("minimum"),
        F.when(item % 4 == 1, F.lit(5000.0)).alias("maximum"),
        F.when(item % 3 == 1, F.array(F.lit("en"))).alias("expected_members"),
    )
    outputs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("output_id"),
        (F.col("doc_id") % ((last or 0) + 1)).alias("eval_id"),
        "text",
        F.col("source").alias("trace_id"),
        F.col("n_chars").cast("double").alias("value"),
        F.array("lang", "source").alias("members"),
    )
    return cases, outputs


CASES_PER_SET = 10


def eval_set_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The cases of ``eval_inputs`` as the nested records of evaluation-set files, ten to a set, and the outputs."""
    cases, outputs = eval_inputs(spark, sf_dir)
    number = F.floor(F.col("eval_id") / CASES_PER_SET).cast("string")
    case = F.struct(
        F.col("eval_id").cast("string").alias("eval_id"),
        "weight_points",
        "expected_terms",
        F.col("forbidden_terms").alias("forbidden_questions"),
        "required_patterns",
        "forbidden_patterns",
        F.col("expected_prefix").alias("expected_trace_prefix"),
        F.col("minimum").alias("minimum_token_reduction_pct"),
        F.col("maximum").alias("max_acceptable_latency_ms"),
        F.col("expected_members").alias("expected_channels"),
    )
    sets = cases.groupBy(F.concat(F.lit("set-"), number).alias("eval_set_id")).agg(F.collect_list(case).alias("eval_cases"))
    return sets, outputs.withColumn("eval_id", F.col("eval_id").cast("string"))


LEAK_PATTERNS = {"card_number": CARD_NUMBER, "identity_number": IDENTITY_NUMBER}
