"""For each registered query, SQL with the same answer, written without looking at the plan.

Where the Spark plan walks an ordered group once, the SQL states the rule directly (a correlated
pick or a join), so that the two agree only if the rule is met.
"""

from __future__ import annotations

from collections.abc import Sequence

from caseflow.functions import fixed_values as fixed
from caseflow.plans import mapping

_K = "CAST(regexp_extract(props, '[0-9]+') AS INTEGER)"

_SIGNALS = f"""
signals AS (
  SELECT event_id AS signal_id, user_id AS customer_id, ts, epoch_us(ts) AS us, {_K} % 25 AS location_id
  FROM events
),
locations AS (
  SELECT n_nationkey AS location_id, n_name AS city,
         CAST((n_nationkey * 37) % 121 - 60 AS DOUBLE) AS lat,
         CAST((n_nationkey * 53) % 361 - 180 AS DOUBLE) AS lon
  FROM nation
)"""

_VELOCITY = f"""{_SIGNALS},
moves AS (
  SELECT *, lag(signal_id) OVER w AS prev_signal_id, lag(location_id) OVER w AS prev_location_id,
         us - lag(us) OVER w AS gap_us
  FROM signals WINDOW w AS (PARTITION BY customer_id ORDER BY ts, signal_id)
),
measured AS (
  SELECT m.signal_id, m.customer_id, m.ts, m.prev_signal_id, a.city AS from_city, b.city AS to_city, m.gap_us,
         round(2 * 3958.7613 * asin(sqrt(least(1.0,
           pow(sin(radians(b.lat - a.lat) / 2), 2)
           + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 3) AS distance_miles
  FROM moves m JOIN locations a ON a.location_id = m.prev_location_id
               JOIN locations b ON b.location_id = m.location_id
  WHERE m.prev_location_id <> m.location_id
),
velocity AS (
  SELECT signal_id, customer_id, ts, prev_signal_id, from_city, to_city, gap_us // 1000000 AS gap_seconds,
         distance_miles, CASE WHEN gap_us <= 540000000 THEN 'DUAL_CITY' ELSE 'SPEED' END AS alert_type
  FROM measured
  WHERE gap_us <= 540000000 OR distance_miles > gap_us / 3600000000.0 * 600
)"""

_STEP_UP = f"""
challenges AS (SELECT event_id AS challenge_id, user_id AS customer_id, ts, {_K} AS origin FROM events WHERE event_type = 'signup'),
replies AS (SELECT event_id AS reply_id, user_id AS customer_id, ts, {_K} AS origin FROM events WHERE event_type = 'click'),
step_up_pairs AS (
  SELECT c.challenge_id, c.customer_id, c.ts AS challenge_ts, r.reply_id, (epoch_us(r.ts) - epoch_us(c.ts)) // 1000000 AS reply_after_seconds,
         r.origin <> c.origin AS mismatch,
         row_number() OVER (PARTITION BY c.challenge_id ORDER BY r.ts, r.reply_id) AS rn
  FROM challenges c LEFT JOIN replies r
    ON r.customer_id = c.customer_id AND r.ts > c.ts AND r.ts <= c.ts + INTERVAL 30 MINUTE
),
step_up AS (
  SELECT challenge_id, customer_id, challenge_ts, reply_id, reply_after_seconds,
         CASE WHEN reply_id IS NULL THEN 'NO_REPLY' WHEN mismatch THEN 'HIGH' ELSE 'LOW' END AS compromise_likelihood
  FROM step_up_pairs WHERE rn = 1
)"""

_CHARGES = """
charges AS (
  SELECT o_custkey AS customer_id, l_suppkey AS merchant_id, o_orderkey AS transaction_id, o_orderdate AS ts,
         l_extendedprice AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""

_PAYEES = f"""{_CHARGES},
payees AS (
  SELECT customer_id, merchant_id, count(DISTINCT date_trunc('month', ts)) AS months, count(*) AS charges,
         CAST(max(date_trunc('month', ts)) AS DATE) AS last_month
  FROM charges GROUP BY customer_id, merchant_id HAVING count(DISTINCT date_trunc('month', ts)) >= 2
)"""


# The engine's regular expressions spell code points differently.
_WS = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CARD = fixed.CARD_NUMBER_PATTERN
_IDENTITY = fixed.IDENTITY_NUMBER_PATTERN


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _any(column: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {_quote(w)})" for w in words) + ")"


def _first(column: str, rules, default) -> str:
    def lit(v):
        return _quote(v) if isinstance(v, str) else str(v)

    whens = " ".join(f"WHEN {_any(column, words)} THEN {lit(label)}" for label, words in rules)
    return f"CASE {whens} ELSE {lit(default)} END"


def _redact(column: str) -> str:
    cards = f"regexp_replace({column}, '{_CARD}', '{fixed.CARD_NUMBER_REPLACEMENT}', 'g')"
    return f"regexp_replace({cards}, '{_IDENTITY}', '{fixed.IDENTITY_NUMBER_REPLACEMENT}', 'g')"


def _stable_id(prefix: str, key: str, digits: int = 32) -> str:
    return f"'{prefix}' || upper(left(sha256('{prefix}|' || {key}), {digits}))"


def _even(value: str, by: int) -> str:
    """Integer division rounded half to even."""
    return (
        f"({value}) // {by} + CASE WHEN ({value}) % {by} * 2 > {by} "
        f"OR (({value}) % {by} * 2 = {by} AND (({value}) // {by}) % 2 = 1) THEN 1 ELSE 0 END"
    )


_INTENT = _first(_strip("text"), mapping.INTENT_WORDS, fixed.INTENT_DEFAULT)
_AUDITED = _any(_strip("text"), mapping.AUDIT_WORDS)
_SCENARIO = _first(_strip("text"), mapping.CLAIM_WORDS, fixed.CLAIM_DEFAULT)

_ROUTED = f"""
routed AS (
  SELECT conv_id, turn, text, {_INTENT} AS intent, {_AUDITED} AS is_audited FROM conversations WHERE role = 'user'
),
tooled AS (
  SELECT *, CAST(is_audited AS INTEGER) + CASE intent WHEN 'ONE_CLICK_RESOLUTION' THEN 2 WHEN 'DISPUTE_FILED' THEN 1
                                                      WHEN 'VCN_PROVISIONED' THEN 1 ELSE 0 END AS tools
  FROM routed
)"""

_FRAGMENTS = """
fragments AS (
  SELECT event_id AS fragment_id, user_id AS customer_id, event_type AS channel, ts,
         strftime(ts, '%Y-%m-%d %H:%M') AS day_label,
         event_type || ' value ' || CAST(CAST(value AS DECIMAL(12, 2)) AS VARCHAR) || ' props ' || props AS summary,
         CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'purchase' THEN 'MEDIUM' ELSE 'INFO' END AS severity
  FROM events
)"""

_COMPACTION = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY customer_id, channel ORDER BY
            CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 0 END DESC, ts DESC, fragment_id DESC) AS rn
  FROM fragments
),
packed AS (
  SELECT customer_id, count(*) AS n, sum(length(summary)) AS chars,
         string_agg('[' || channel || '] ' || summary, chr(10) ORDER BY channel) FILTER (rn = 1) AS compacted_summary
  FROM ranked GROUP BY customer_id
),
tokens AS (
  SELECT *, greatest(1, CAST(chars AS BIGINT) // 4) AS raw, length(compacted_summary) // 4 AS compact FROM packed
)
SELECT k.customer_id, CASE WHEN n IS NULL THEN 'NO_OP' ELSE 'COMPACTED' END AS status, coalesce(n, 0) AS source_fragments,
       raw AS raw_tokens, compact AS compacted_tokens,
       CAST(round_even(CAST(raw - compact AS DOUBLE) / raw * 100, 1) AS DOUBLE) AS reduction_pct,
       CAST(round_even((raw - compact) * CAST(0.000002 AS DOUBLE), 5) AS DOUBLE) AS saved_usd,
       CASE WHEN n IS NOT NULL THEN greatest(0, raw - compact) END AS tokens_saved, compacted_summary
FROM holders k LEFT JOIN tokens USING (customer_id)"""

_SPANS = f"""
spans AS (
  SELECT event_id AS span_id, user_id AS session_id, ts, value AS duration_ms, 'tool_' || ({_K} % 5) AS name,
         CASE event_type WHEN 'click' THEN 'START' WHEN 'view' THEN 'COMPLETE' ELSE event_type END AS span_type
  FROM events
)"""

_PAIRS_FROM = """
marks AS (SELECT * FROM spans WHERE span_type IN ('START', 'COMPLETE')),
linked AS (
  SELECT *, lead(span_type) OVER w AS next_type, lead(span_id) OVER w AS next_id, lead(ts) OVER w AS next_ts,
         lag(span_type) OVER w AS prev_type, lag(ts) OVER w AS prev_ts
  FROM marks WINDOW w AS (PARTITION BY session_id, name ORDER BY ts, span_id)
)"""


def _pairs(timeout_us: int | None) -> str:
    soon = "" if timeout_us is None else f" AND epoch_us(next_ts) - epoch_us(ts) <= {timeout_us}"
    late = "false" if timeout_us is None else f"epoch_us(ts) - epoch_us(prev_ts) > {timeout_us}"
    return f"""WITH {_SPANS}, {_PAIRS_FROM}
SELECT session_id, name, span_id AS start_span_id, next_id AS complete_span_id,
       (epoch_us(next_ts) - epoch_us(ts)) / CAST(1000 AS DOUBLE) AS duration_ms, 'PAIRED' AS pairing
FROM linked WHERE span_type = 'START' AND next_type = 'COMPLETE'{soon}
UNION ALL
SELECT session_id, name, span_id, NULL, NULL, 'NO_COMPLETION'
FROM linked WHERE span_type = 'START' AND NOT coalesce(next_type = 'COMPLETE'{soon}, false)
UNION ALL
SELECT session_id, name, NULL, span_id, 0.0, 'NO_START'
FROM linked WHERE span_type = 'COMPLETE' AND (prev_type IS NULL OR prev_type = 'COMPLETE' OR {late})"""


_DISPUTABLE = """
txs AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_totalprice AS amount, o_orderdate AS ts,
         o_orderpriority = '4-NOT SPECIFIED' AS no_merchant, o_orderstatus <> 'P' AS approved,
         o_orderpriority = '2-HIGH' AS has_token
  FROM orders
)"""

_DISPUTES = f"""{_DISPUTABLE},
decided AS (
  SELECT *, CASE WHEN amount <= 0 OR no_merchant THEN 'ERROR'
                 WHEN NOT approved OR (amount > 250000 AND NOT has_token) THEN 'APPROVAL_REQUIRED'
                 ELSE 'PROVISIONAL_CREDIT_POSTED' END AS status
  FROM txs
),
disputes AS (
  SELECT transaction_id, customer_id, status,
         CASE WHEN amount <= 0 THEN 'INVALID_AMOUNT' WHEN no_merchant THEN 'EMPTY_MERCHANT' END AS error_type,
         CASE WHEN status LIKE 'PROV%' THEN {_stable_id("DSP-", "transaction_id")} END AS case_id,
         CASE WHEN status LIKE 'PROV%' THEN amount END AS credit,
         CASE WHEN status LIKE 'PROV%' THEN 10 END AS resolution_days
  FROM decided
)"""

_NOTIFICATIONS = """
copies AS (
  SELECT *, 1 AS delivery, 0 AS fault FROM documents
  UNION ALL SELECT *, 2, 0 FROM documents WHERE doc_id % 8 = 0
  UNION ALL SELECT *, 3, CASE WHEN doc_id % 10 = 0 THEN 10 ELSE doc_id % 10 END FROM documents
),
decoded AS (
  SELECT *, CASE WHEN fault IN (1, 9) THEN 'NO_PAYLOAD' WHEN fault IN (2, 6) THEN 'INVALID_FORMAT' WHEN fault = 3 THEN 'NO_DATA'
                 WHEN fault IN (4, 7, 8) THEN 'DECODE_FAILED' WHEN fault = 5 THEN 'MISSING_OBJECT' END AS reject_reason,
         CASE WHEN fault IN (0, 5, 10) THEN 'docs-' || lang END AS bucket,
         CASE fault WHEN 0 THEN '' WHEN 10 THEN 'gone/' END || source || '/' || doc_id || '.txt' AS name,
         CASE WHEN fault IN (0, 5, 10) AND doc_id % 7 <> 0
              THEN strftime(make_timestamp((doc_id + 1700000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS time_created,
         CASE WHEN fault IN (0, 5, 10) THEN CAST(doc_id AS VARCHAR) END AS generation
  FROM copies
)"""

_TAGS = (
    "coalesce(nullif(array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {_any('text', words)} THEN '{tag}' END" for tag, words in sorted(mapping.TAG_WORDS.items()))
    + "], lambda t: t IS NOT NULL), ', '), ''), 'document')"
)
_WORDS = f"len(regexp_extract_all(text, '[^{_WS}]+'))"


def _leaks(stage: str, column: str, value: str) -> str:
    parts = []
    patterns = {"card_number": _CARD, "identity_number": _IDENTITY, **{w: w for w in fixed.FORBIDDEN_TELEMETRY_KEYS}}
    for label, pattern in patterns.items():
        found = f"len(regexp_extract_all({value}, '{pattern}'))"
        parts.append(
            f"SELECT '{stage}' AS stage, '{column}' AS column_name, '{label}' AS pattern, "
            f"CAST(count(*) FILTER ({found} > 0) AS BIGINT) AS rows_with_match, CAST(sum({found}) AS BIGINT) AS matches "
            f"FROM documents"
        )
    return " UNION ALL ".join(parts)


_ITEM_WORDS = """words AS (
  SELECT DISTINCT item_id, word FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS word FROM benchmark) WHERE word <> ''
  UNION ALL SELECT item_id, 'qzx' || item_id FROM benchmark
)"""

ORACLES: dict[str, str] = {
    "velocity_alerts": f"WITH {_VELOCITY} SELECT * FROM velocity",
    "unfamiliar_high_value": f"""
WITH {_CHARGES}, ranked AS (
  SELECT *, rank() OVER (PARTITION BY customer_id, merchant_id ORDER BY ts, transaction_id) AS r FROM charges
)
SELECT customer_id, merchant_id, transaction_id, ts, max(amount) AS amount
FROM ranked WHERE r = 1 GROUP BY ALL HAVING max(amount) > 50000""",
    "step_up_audit": f"WITH {_STEP_UP} SELECT * FROM step_up",
    "travel_coverage": """
WITH notices AS (
  SELECT o_orderkey AS notice_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS start_date,
         CAST(o_orderdate AS DATE) + 14 AS end_date
  FROM orders WHERE o_orderpriority = '1-URGENT'
),
charges AS (
  SELECT o_orderkey AS charge_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS charge_date
  FROM orders WHERE o_orderpriority <> '1-URGENT'
),
pairs AS (
  SELECT c.*, n.notice_id, row_number() OVER (PARTITION BY c.charge_id ORDER BY n.end_date DESC, n.notice_id DESC) AS rn
  FROM charges c LEFT JOIN notices n ON n.customer_id = c.customer_id AND c.charge_date BETWEEN n.start_date AND n.end_date
)
SELECT charge_id, customer_id, charge_date, notice_id, notice_id IS NOT NULL AS is_covered FROM pairs WHERE rn = 1""",
    "incident_chain": """
WITH d AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
w AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'),
dc AS (
  SELECT d.event_id AS decline_id, d.user_id AS customer_id, d.ts AS decline_ts, c.event_id AS call_id, c.ts AS call_ts,
         row_number() OVER (PARTITION BY d.event_id ORDER BY c.ts, c.event_id) AS rn
  FROM d JOIN c ON c.user_id = d.user_id AND c.ts > d.ts AND c.ts <= d.ts + INTERVAL 2 HOUR
),
dcw AS (
  SELECT dc.* EXCLUDE (rn), w.event_id AS wallet_id, w.ts AS wallet_ts,
         row_number() OVER (PARTITION BY dc.decline_id ORDER BY w.ts, w.event_id) AS rn
  FROM dc JOIN w ON w.user_id = dc.customer_id AND w.ts > dc.call_ts AND w.ts <= dc.call_ts + INTERVAL 24 HOUR
  WHERE dc.rn = 1
)
SELECT decline_id, customer_id, call_id, wallet_id,
       (epoch_us(call_ts) - epoch_us(decline_ts)) // 1000000 AS call_after_seconds,
       (epoch_us(wallet_ts) - epoch_us(call_ts)) // 1000000 AS wallet_after_seconds
FROM dcw WHERE rn = 1""",
    "status_asof": """
WITH charges AS (SELECT event_id AS charge_id, user_id AS customer_id, ts FROM events WHERE event_type = 'purchase'),
changes AS (
  SELECT event_id AS status_id, user_id AS customer_id, ts,
         CASE event_type WHEN 'error' THEN 'LOCKED' ELSE 'ACTIVE' END AS status
  FROM events WHERE event_type IN ('error', 'signup')
),
pairs AS (
  SELECT c.*, s.status_id, s.status, row_number() OVER (PARTITION BY c.charge_id ORDER BY s.ts DESC, s.status_id DESC) AS rn
  FROM charges c LEFT JOIN changes s
    ON s.customer_id = c.customer_id AND (s.ts < c.ts OR (s.ts = c.ts AND s.status_id < c.charge_id))
)
SELECT charge_id, customer_id, ts, status_id, status, coalesce(status = 'LOCKED', false) AS explained_by_lock
FROM pairs WHERE rn = 1""",
    "recurring_payees": f"WITH {_PAYEES} SELECT * FROM payees",
    "claim_veracity": f"""
WITH {_STEP_UP},
claims AS (SELECT conv_id AS customer_id, turn, text AS claim_text, {_SCENARIO} AS scenario FROM conversations WHERE role = 'user'),
ledger AS (SELECT o_custkey AS customer_id, count(*) AS ledger_rows, count(*) FILTER (o_orderpriority = '1-URGENT') AS notices
           FROM orders GROUP BY 1),
baseline AS (SELECT user_id AS customer_id, count(*) AS baseline_rows FROM events GROUP BY 1),
suspect AS (SELECT customer_id, count(*) AS suspect_replies FROM step_up WHERE compromise_likelihood = 'HIGH' GROUP BY 1),
support AS (
  {" UNION ALL ".join(
      f"SELECT {label} AS scenario, count(*) FILTER ({_any('text', words)} OR {_any(chr(39) + 'policy ' + chr(39) + ' || item_id', words)}) AS policies FROM benchmark"
      for label, words in mapping.CLAIM_WORDS)}
  UNION ALL SELECT 5, count(*) FROM benchmark
),
judged AS (
  SELECT c.*, coalesce(ledger_rows, 0) AS ledger_rows, coalesce(notices, 0) AS notices,
         coalesce(baseline_rows, 0) AS baseline_rows, coalesce(suspect_replies, 0) AS suspect_replies,
         coalesce(policies, 0) AS policies,
         CASE WHEN scenario = 4 THEN 'CONTRADICTED_BY_TELEMETRY'
              WHEN scenario = 1 AND coalesce(notices, 0) = 0 THEN 'UNVERIFIED_PENDING' ELSE 'VERIFIED_TRUE' END AS status
  FROM claims c LEFT JOIN ledger USING (customer_id) LEFT JOIN baseline USING (customer_id)
       LEFT JOIN suspect USING (customer_id) LEFT JOIN support USING (scenario)
),
scored AS (
  SELECT *, CAST(CASE WHEN status = 'UNVERIFIED_PENDING' THEN 0.65
                      ELSE [0.99, 0.99, 0.98, 0.15, 0.92][scenario] END AS DOUBLE) AS confidence,
         CASE WHEN status = 'UNVERIFIED_PENDING' THEN 0 ELSE [3, 4, 3, 0, 2][scenario] END AS signals,
         CASE WHEN status LIKE 'CONTRA%' THEN 'FAIL' ELSE 'PASS' END AS verdict
  FROM judged
)
SELECT customer_id, turn, claim_text, scenario, status, confidence, signals, verdict AS ledger_check,
       verdict AS travel_check, 'PASS' AS baseline_check, 'PASS' AS consent_check, 'PASS' AS policy_check,
       confidence < 0.8 AS needs_review, ledger_rows, notices, baseline_rows, suspect_replies, policies
FROM scored""",
    "redact_documents": f"""
SELECT doc_id, {_redact('text')} AS redacted_text, {_redact('text')} <> text AS was_changed FROM documents""",
    "redact_events": f"""
WITH d AS (
  SELECT event_id, event_type, value, 'card 4' || lpad(CAST(event_id AS VARCHAR), 15, '0') || ' of ' || user_id AS note,
         'id 123-45-' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') || '|' || event_type AS remarks,
         'paid with 4' || lpad(CAST(event_id AS VARCHAR), 15, '0') AS memo
  FROM events
)
SELECT event_id, '***REDACTED_CVV***' AS pin, {_redact('note')} AS note, '***REDACTED_CVV***' AS device_otp,
       event_type AS device_label, {_redact('remarks')} AS remarks, '***REDACTED_CVV***' AS cvv, {_redact('memo')} AS memo,
       value AS amount
FROM d""",
    "mask_accounts": """
WITH e AS (
  SELECT c_custkey AS customer_id, CASE WHEN c_mktsegment IN ('FURNITURE', 'BUILDING') THEN NULL ELSE right(c_name, 4) END AS last4
  FROM customer
)
SELECT customer_id, last4, '************' || last4 AS masked_pan, last4 IS NOT NULL AS is_valid FROM e""",
    "token_estimate": """
SELECT doc_id, greatest(1, length(text) // 4) AS tokens, length(lang) // 4 AS unfloored_tokens FROM documents""",
    "tag_documents": f"SELECT doc_id, {_TAGS} AS tags, {_WORDS} AS word_count FROM documents",
    "route_intent": f"""
WITH {_ROUTED} SELECT conv_id AS customer_id, turn, intent, is_audited, tools FROM tooled""",
    "claim_scenario": f"""
SELECT conv_id AS customer_id, turn, {_SCENARIO} AS scenario FROM conversations WHERE role = 'user'""",
    "model_tier": f"""
SELECT event_id, CASE WHEN value > 200 OR {_K} >= 85 OR event_type = 'error' THEN 'pro'
                      WHEN event_type IN ('click', 'signup') THEN 'lite' ELSE 'fast' END AS tier FROM events""",
    "validate_orders": """
WITH e AS (
  SELECT o_orderkey AS transaction_id,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' THEN 1
              WHEN o_orderpriority = '5-LOW' THEN 2
              WHEN o_totalprice > 450000 OR o_totalprice < 50000 THEN 3
              WHEN (o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F') OR o_orderkey > 9999 THEN 4
              WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN 5 ELSE 0 END AS e
  FROM orders
)
SELECT transaction_id,
       ['INVALID_CUSTOMER', 'NOT_FOUND', 'INVALID_AMOUNT', 'INVALID_CARD_ENDING', 'INCOMPLETE_ADDRESS'][e] AS error_type,
       ['customer_id must not be empty', 'customer_id is not on file', 'amount must be a number above zero',
        'card_ending must have four digits', 'address is too short'][e] AS error_message,
       [true, false, true, true, true][e] AS retryable,
       ['card_status', 'card_status', 'account_statement', NULL, NULL][e] AS fallback
FROM e""",
    "gate_disputes": f"""
WITH {_DISPUTABLE}
SELECT transaction_id, amount, CASE WHEN amount <= 0 THEN 'ERROR'
       WHEN NOT approved OR (amount > 250000 AND NOT has_token) THEN 'APPROVAL_REQUIRED' ELSE 'EXECUTE' END AS decision
FROM txs""",
    "normalise_logs": """
SELECT event_id, upper(event_type) AS severity, CASE WHEN event_id % 2 = 0 THEN 'svc-' || user_id ELSE 'case-service' END AS service,
       CASE WHEN event_type = 'error' THEN 'gateway' ELSE 'case-pipeline' END AS component,
       lpad(lower(to_hex(user_id)), 32, '0') AS trace_id, lpad(lower(to_hex(event_id)), 16, '0') AS span_id
FROM events""",
    "account_statement": """
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS recency FROM orders
),
b AS (
  SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM orders GROUP BY 1
)
SELECT c_custkey AS customer_id, coalesce(cents, 0) / CAST(100 AS DOUBLE) AS current_balance,
       (2500000 - coalesce(cents, 0)) / CAST(100 AS DOUBLE) AS available_credit, coalesce(n, 0) AS transactions,
       CAST(recency AS INTEGER) AS recency, o_orderkey AS transaction_id, o_orderdate AS ts, o_totalprice AS amount,
       o_orderstatus AS status
FROM customer LEFT JOIN b ON b.o_custkey = c_custkey LEFT JOIN t ON t.o_custkey = c_custkey AND recency <= 3""",
    "card_status": """
SELECT user_id AS customer_id, arg_max(CASE event_type WHEN 'error' THEN 'LOCKED' ELSE 'ACTIVE' END, (ts, event_id)) AS status,
       CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'DECLINE_EVENT' END AS lock_reason,
       max(ts) AS since, arg_max(event_id, (ts, event_id)) AS status_id, count(*) AS changes,
       arg_max(event_type, (ts, event_id)) = 'error' AS replacement_eligible,
       arg_max(event_type, (ts, event_id)) <> 'error' AS wallet_eligible
FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id""",
    "channel_activity": f"""
SELECT user_id AS customer_id, count(*) AS records, min(ts) AS first_ts, max(ts) AS last_ts,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS amount_cents, count(DISTINCT {_K} % 25) AS locations,
       'click' AS channel
FROM events WHERE event_type = 'click' GROUP BY user_id""",
    "memory_search": f"""
WITH {_ITEM_WORDS},
names AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS n FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
q AS (
  SELECT item_id || '-' || word AS query_id, source AS customer_id, word AS q
  FROM words JOIN names ON n = item_id % (SELECT count(*) FROM names)
),
pairs AS (
  SELECT query_id, customer_id, doc_id AS fragment_id,
         contains(lower(text), q) OR contains(lower(lang), q) OR contains(CAST(n_chars AS VARCHAR), q) AS hit
  FROM q JOIN documents ON source = customer_id
),
flagged AS (SELECT *, bool_or(hit) OVER (PARTITION BY query_id) AS any_hit FROM pairs)
SELECT query_id, customer_id, fragment_id, hit AS is_match FROM flagged WHERE hit OR NOT any_hit""",
    "policy_search": f"""
WITH {_ITEM_WORDS},
q AS (SELECT DISTINCT word AS query_id, word || ' ' || reverse(word) AS query FROM words),
w AS (SELECT query_id, unnest(string_split_regex(lower(query), '[{_WS}]+')) AS word FROM q),
m AS (
  SELECT DISTINCT query_id, item_id AS policy_id FROM w, benchmark
  WHERE contains(lower(text), word) OR contains('policy ' || item_id, word)
)
SELECT query_id, policy_id, policy_id AS position, true AS is_match FROM m
UNION ALL
SELECT query_id, policy_id, policy_id, false
FROM q, (SELECT item_id AS policy_id FROM benchmark ORDER BY 1 LIMIT 2) WHERE query_id NOT IN (SELECT query_id FROM m)""",
    "merge_channels": f"""
WITH {_FRAGMENTS}
SELECT 'event-' || fragment_id AS fragment_id, customer_id, channel, ts, summary, severity FROM fragments
UNION ALL
SELECT 'chat-' || conv_id || '-' || turn, conv_id, 'chat_' || role, NULL, text, NULL FROM conversations""",
    "timeline_context": f"""
WITH {_FRAGMENTS},
lines AS (
  SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY ts, fragment_id) - 1 AS n,
         '- [' || day_label || '] [' || channel || '] ' || CASE channel
           WHEN 'click' THEN '[Veracity: Unverified]'
           WHEN 'error' THEN '[Veracity: CONTRADICTED_BY_TELEMETRY (Conf: 15%)]'
           WHEN 'signup' THEN '[Veracity: VERIFIED_TRUE (Conf: 99%)]'
           WHEN 'view' THEN '[Veracity: VERIFIED_TRUE (Conf: 100%)]'
           ELSE '[Veracity: UNVERIFIED_PENDING (Conf: 56%)]' END || ': ' || summary AS line
  FROM fragments
),
sized AS (SELECT *, n // 1000 AS page, count(*) OVER (PARTITION BY customer_id) AS total FROM lines),
pages AS (
  SELECT customer_id, page, count(*) AS lines, max(n) + 1 = max(total) AS is_last, string_agg(line, chr(10) ORDER BY n) AS body
  FROM sized GROUP BY customer_id, page
)
SELECT customer_id, page, lines, CASE WHEN page = 0 THEN '=== TIMELINE (customer ' || customer_id || ') ===' || chr(10) ELSE '' END
       || body || CASE WHEN is_last THEN chr(10) || '=== END OF TIMELINE ===' ELSE '' END AS context
FROM pages
UNION ALL
SELECT c_custkey, 0, 0, 'No earlier records for this customer.' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""",
    "channel_coverage": """
WITH need AS (SELECT unnest(['click', 'error', 'purchase', 'signup']) AS channel),
have AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT c_custkey AS customer_id, CAST(count(event_type) AS INTEGER) AS channels_present,
       coalesce(string_agg(channel, ', ' ORDER BY channel) FILTER (event_type IS NULL), '') AS missing_channels,
       count(event_type) = 4 AS is_complete
FROM customer CROSS JOIN need LEFT JOIN have ON user_id = c_custkey AND event_type = channel GROUP BY c_custkey""",
    "compact_memory": f"WITH {_FRAGMENTS}, holders AS (SELECT c_custkey AS customer_id FROM customer), {_COMPACTION}",
    "compact_documents": f"""
WITH fragments AS (
  SELECT doc_id AS fragment_id, source AS customer_id, lang AS channel, doc_id AS ts, text AS summary,
         CASE WHEN n_chars >= 2000 THEN 'HIGH' WHEN n_chars >= 500 THEN 'MEDIUM' ELSE 'INFO' END AS severity
  FROM documents
), holders AS (SELECT DISTINCT source AS customer_id FROM documents), {_COMPACTION}""",
    "token_usage": f"""
WITH {_ROUTED},
sized AS (
  SELECT u.conv_id, u.turn, u.tools, length({_strip("u.text")}) AS message, coalesce(length(b.text), 0) AS memory,
         coalesce(length(a.text), 0) AS reply
  FROM tooled u LEFT JOIN conversations b ON b.conv_id = u.conv_id AND b.turn = u.turn - 1
       LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
),
spent AS (
  SELECT conv_id, turn, CAST(265 + greatest(1, memory // 4) + greatest(1, message // 4) + 48 * tools AS BIGINT) AS i,
         CAST(greatest(1, reply // 4) + 36 * tools AS BIGINT) AS o
  FROM sized
),
total AS (
  SELECT *, count(*) OVER w + 1 AS turns_count, CAST(482 + sum(i) OVER w AS BIGINT) AS ti, CAST(146 + sum(o) OVER w AS BIGINT) AS t_o
  FROM spent WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
)
SELECT conv_id AS session_id, turn, i AS input_tokens, o AS output_tokens, turns_count, ti AS total_input, t_o AS total_output,
       ti + t_o AS total_tokens, {_even("ti * 15 + t_o * 60", 100)} AS cost_micro_usd,
       ((ti * 2000 + ti + t_o) // ((ti + t_o) * 2)) / CAST(10 AS DOUBLE) AS input_share_pct,
       (1000 - (ti * 2000 + ti + t_o) // ((ti + t_o) * 2)) / CAST(10 AS DOUBLE) AS output_share_pct
FROM total""",
    "activity_sessions": """
WITH gaps AS (
  SELECT user_id, epoch_us(ts) AS us, event_id, CAST(round(value * 100) AS BIGINT) AS cents,
         epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap
  FROM events
),
numbered AS (
  SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS s
  FROM gaps
)
SELECT user_id AS customer_id, min(us) AS start_us, max(us) AS end_us, count(*) AS records, CAST(sum(cents) AS BIGINT) AS amount_cents
FROM numbered GROUP BY user_id, s""",
    "span_stats": f"""
WITH {_SPANS},
ranked AS (
  SELECT span_type, name, duration_ms AS d,
         row_number() OVER (PARTITION BY span_type, name ORDER BY duration_ms) AS rn,
         count(*) OVER (PARTITION BY span_type, name) AS total
  FROM spans
)
SELECT span_type, name, count(*) AS spans, round(avg(d), 4) AS mean_ms,
       min(d) FILTER (rn * 100 >= total * 50) AS p50_ms, min(d) FILTER (rn * 100 >= total * 95) AS p95_ms, max(d) AS max_ms,
       round(count(*) FILTER (d < 100) * CAST(100 AS DOUBLE) / count(*), 4) AS under_limit_pct
FROM ranked GROUP BY span_type, name""",
    "recent_spans": f"WITH {_SPANS} SELECT * FROM spans ORDER BY ts DESC, span_id DESC LIMIT 200",
    "span_pairs": _pairs(None),
    "score_rollup": """
WITH s AS (SELECT lang AS s, source AS p, quality * 19 AS score FROM labels JOIN documents USING (doc_id)),
r AS (
  SELECT s, p, CAST(grouping(s) + grouping(p) AS INTEGER) AS level, CAST(sum(score) AS BIGINT) AS score,
         CAST(count(*) * 19 AS BIGINT) AS max_score
  FROM s GROUP BY ROLLUP (s, p)
)
SELECT coalesce(s, 'ALL') AS set, coalesce(p, 'ALL') AS pillar, level, score, max_score,
       format('{:.1f}%', CAST(round_even(score * CAST(100 AS DOUBLE) / max_score, 1) AS DOUBLE)) AS percentage
FROM r""",
    "eval_scoring": """
WITH cases AS (
  SELECT item_id, lower(split_part(text, ' ', 1)) AS first_word, CASE WHEN item_id % 4 = 3 THEN 4 ELSE 5 END AS points FROM benchmark
),
checked AS (
  SELECT c.item_id, c.points, doc_id,
         (item_id % 2 <> 0 OR contains(lower(text), first_word)) AND NOT contains(lower(text), 'password')
         AND NOT contains(lower(text), 'full_pan') AND (item_id % 3 <> 0 OR regexp_matches(text, '[a-z]{4}'))
         AND NOT regexp_matches(text, '[0-9]{16}') AND (item_id % 5 <> 0 OR starts_with(source, 'src1'))
         AND (item_id % 2 <> 1 OR n_chars >= 100) AND (item_id % 4 <> 1 OR n_chars < 5000)
         AND (item_id % 3 <> 1 OR lang = 'en') AS ok
  FROM cases c LEFT JOIN documents ON c.item_id = doc_id % (SELECT max(item_id) + 1 FROM benchmark)
)
SELECT 'set-' || (item_id % 5) AS eval_set_id, item_id AS eval_id, count(doc_id) AS outputs, count(*) FILTER (doc_id IS NOT NULL AND ok) AS passed,
       CAST(sum(points) AS BIGINT) AS points_possible,
       CAST(sum(CASE WHEN doc_id IS NOT NULL AND ok THEN points ELSE 0 END) AS BIGINT) AS points
FROM checked GROUP BY item_id""",
    "leak_audit": " UNION ALL ".join(
        [
            _leaks("before", "text", "text"),
            _leaks("before", "source", "source"),
            _leaks("before", "lang", "lang"),
            _leaks("after", "text", _redact("text")),
            _leaks("after", "source", _redact("source")),
            _leaks("after", "lang", _redact("lang")),
        ]
    ),
    "risk_summary": f"""
WITH {_VELOCITY}, {_STEP_UP},
alerts AS (
  SELECT customer_id, 52 AS points, ts FROM velocity
  UNION ALL
  SELECT s.customer_id, 40, e.ts FROM step_up s JOIN events e ON e.event_id = s.challenge_id WHERE compromise_likelihood = 'HIGH'
),
scored AS (SELECT customer_id, count(*) AS alerts, CAST(least(100, sum(points)) AS BIGINT) AS risk_score, max(ts) AS last_alert_ts
           FROM alerts GROUP BY customer_id)
SELECT *, CASE WHEN risk_score >= 85 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 30 THEN 'MEDIUM'
          ELSE 'LOW' END AS risk_level, CASE WHEN risk_score >= 85 THEN 'SECURITY_LOCKED' ELSE 'MONITORED' END AS containment_status
FROM scored""",
    "file_disputes": f"WITH {_DISPUTES} SELECT * FROM disputes",
    "dispute_totals": f"""
WITH {_DISPUTES}
SELECT customer_id, count(*) FILTER (status LIKE 'PROV%') AS credited, count(*) FILTER (status LIKE 'APPR%') AS stopped,
       count(*) FILTER (status = 'ERROR') AS errors,
       CAST(coalesce(sum(CAST(round(credit * 100) AS BIGINT)), 0) AS DOUBLE) / 100 AS total_credit
FROM disputes GROUP BY customer_id""",
    "resolve_cases": f"""
WITH {_DISPUTABLE}, {_PAYEES},
billers AS (SELECT customer_id, count(*) AS billers FROM payees GROUP BY 1),
staged AS (
  SELECT t.*, c_acctbal, c_name, coalesce(billers, 0) AS billers,
         CASE WHEN NOT approved THEN 'approval'
              WHEN NOT coalesce(c_acctbal > 0 AND c_acctbal <= 9000, false) THEN 'virtual_card'
              WHEN c_name IS NULL OR c_mktsegment = 'FURNITURE' THEN 'courier' END AS failed_step,
         CASE WHEN no_merchant OR amount <= 0 THEN 'ERROR' WHEN amount > 250000 AND NOT has_token THEN 'APPROVAL_REQUIRED'
              ELSE 'PROVISIONAL_CREDIT_POSTED' END AS d
  FROM txs t LEFT JOIN customer ON c_custkey = t.customer_id LEFT JOIN billers b ON b.customer_id = t.customer_id
),
s AS (SELECT *, failed_step IS NULL AS done, failed_step IS NULL AND d LIKE 'PROV%' AS credited FROM staged)
SELECT transaction_id AS case_id, customer_id,
       CASE WHEN done THEN 'SUCCESS' WHEN failed_step = 'approval' THEN 'APPROVAL_REQUIRED' ELSE 'ERROR' END AS status, failed_step,
       CASE WHEN done THEN 'PERMANENTLY_REVOKED_AND_BLOCKED' END AS old_card_action, CASE WHEN done THEN d END AS dispute_status,
       CASE WHEN credited THEN {_stable_id("DSP-", "transaction_id")} END AS dispute_case_id,
       CASE WHEN credited THEN amount END AS credit, CASE WHEN done THEN {_stable_id("vcn-", "transaction_id")} END AS vcn_id,
       CASE WHEN done THEN '************' || right(c_name, 4) END AS masked_pan, CASE WHEN done THEN c_acctbal END AS spending_limit,
       CASE WHEN done THEN {_stable_id("SHP-", "transaction_id")} END AS tracking_number, CASE WHEN done THEN c_name END AS address,
       CASE WHEN done THEN strftime(ts + INTERVAL 24 HOUR, '%A, %b %d at 2:00 PM GMT') END AS estimated_delivery,
       CASE WHEN done THEN billers END AS billers_updated, CASE WHEN done THEN {_stable_id("trace-", "transaction_id")} END AS trace_id
FROM s""",
    "decode_notifications": f"""
WITH {_NOTIFICATIONS} SELECT doc_id, delivery, bucket, name, time_created, generation, reject_reason FROM decoded""",
    "attach_content": f"""
WITH {_NOTIFICATIONS}
SELECT doc_id, delivery, name, CASE WHEN fault = 0 THEN 'OK' ELSE 'CONTENT_NOT_FOUND' END AS status,
       CAST(CASE WHEN fault = 0 THEN length(text) END AS INTEGER) AS chars, CASE WHEN fault = 0 THEN md5(text) END AS content_md5
FROM decoded WHERE reject_reason IS NULL""",
    "metadata_rows": f"""
WITH {_NOTIFICATIONS}
SELECT name AS filename, coalesce(time_created, '2026-01-01T00:00:00Z') AS date, {_TAGS} AS tags, {_WORDS} AS word_count
FROM decoded WHERE delivery = 1""",
    "explode_props": f"""
SELECT event_id, 'k' AS label, CAST({_K} AS DOUBLE) AS amount, 'list' AS kind FROM events WHERE event_type <> 'view'
UNION ALL SELECT event_id, event_type, value, 'list' FROM events WHERE event_type <> 'view'
UNION ALL SELECT event_id, NULL, NULL, 'list' FROM events WHERE event_type = 'view'
UNION ALL SELECT event_id, 'k', CAST({_K} AS DOUBLE), 'map' FROM events""",
}


def _windows(width: str, slide: str) -> str:
    """Windows of one width every slide; each event is in as many as overlap it."""
    return f"""
WITH e AS (SELECT *, time_bucket(INTERVAL '{slide}', ts, TIMESTAMP '1970-01-01') AS newest FROM events),
w AS (
  SELECT event_type, value, ts, unnest(generate_series(newest - INTERVAL '{width}' + INTERVAL '{slide}', newest, INTERVAL '{slide}')) AS window_start
  FROM e
)
SELECT window_start, window_start + INTERVAL '{width}' AS window_end, event_type AS channel, count(*) AS records,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS amount_cents
FROM w GROUP BY window_start, event_type"""


ORACLES |= {
    "covered_charges": f"""
SELECT charge_id, customer_id, charge_date, is_covered AS covered FROM ({ORACLES["travel_coverage"]}) AS t""",
    "biller_fanout": f"""
WITH {_PAYEES}
SELECT c_custkey AS customer_id, right(c_name, 4) AS card_last4, merchant_id, months, last_month
FROM customer JOIN payees ON c_custkey = customer_id""",
    "gate_sessions": f"""
WITH {_DISPUTABLE}
SELECT transaction_id, CASE WHEN NOT approved OR (transaction_id % 3 = 0 AND transaction_id % 2 <> 0)
       OR (amount > 250000 AND NOT has_token) THEN 'APPROVAL_REQUIRED' ELSE 'EXECUTE' END AS decision
FROM txs""",
    "channel_summary": """
SELECT user_id AS customer_id, event_type AS channel, count(*) AS records, min(ts) AS first_ts, max(ts) AS last_ts,
       CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS amount_cents
FROM events GROUP BY user_id, event_type""",
    "channel_logs": f"""
SELECT user_id AS customer_id, event_type AS channel, event_id AS signal_id, ts, {_K} % 25 AS location_id, value AS amount
FROM events WHERE event_type IN ('click', 'view', 'error')""",
    "compacted_memory": f"""
SELECT 'compact-' || sha256(CAST(customer_id AS VARCHAR)) AS fragment_id, customer_id, 'COMPACTION' AS channel, 'INFO' AS severity,
       compacted_summary AS summary, true AS is_compacted_summary, 'VERIFIED_TRUE' AS status
FROM ({ORACLES["compact_memory"]}) AS t WHERE status = 'COMPACTED'""",
}

ORACLES |= {
    "appended_metadata": ORACLES["metadata_rows"],
    "eval_set_files": f"""
SELECT 'set-' || (eval_id // 10) AS eval_set_id, CAST(eval_id AS VARCHAR) AS eval_id, outputs, passed, points_possible, points
FROM ({ORACLES["eval_scoring"]}) AS t""",
}

ORACLES |= {
    "rule_table": f"""
WITH {_ITEM_WORDS},
r AS (SELECT DISTINCT word, CAST(100 - length(word) AS BIGINT) AS priority, 'starts-' || left(word, 1) AS label FROM words),
hit AS (
  SELECT doc_id, label, priority, word, row_number() OVER (PARTITION BY doc_id ORDER BY priority, label, word) AS n
  FROM documents, r WHERE contains(lower(text), word)
)
SELECT d.doc_id, coalesce(label, 'none') AS label, priority, word FROM documents d LEFT JOIN hit h ON h.doc_id = d.doc_id AND n = 1""",
    "claim_fragments": f"""
WITH {_FRAGMENTS}
SELECT CAST(fragment_id AS VARCHAR) AS fragment_id, customer_id, channel, ts, summary,
       CASE channel WHEN 'error' THEN 'CONTRADICTED_BY_TELEMETRY' WHEN 'signup' THEN 'VERIFIED_TRUE' WHEN 'view' THEN 'VERIFIED_TRUE'
         WHEN 'purchase' THEN 'UNVERIFIED_PENDING' END AS status,
       CAST(CASE channel WHEN 'error' THEN 0.15 WHEN 'signup' THEN 0.99 WHEN 'purchase' THEN 0.57 END AS DOUBLE) AS confidence
FROM fragments
UNION ALL
SELECT {_stable_id("clm-", "customer_id || '|' || turn")}, customer_id, 'CLAIM', NULL, claim_text, status, confidence
FROM ({ORACLES["claim_veracity"]}) AS t WHERE status = 'VERIFIED_TRUE'""",
}

ORACLES |= {
    "case_disputes": f"""
WITH c AS (SELECT case_id, customer_id FROM ({ORACLES["resolve_cases"]}) AS t WHERE status = 'SUCCESS' AND case_id % 5 <> 0),
d AS (
  SELECT case_id, customer_id, l_orderkey || '-' || l_linenumber AS transaction_id, l_extendedprice AS amount,
         CASE WHEN l_extendedprice <= 0 THEN 'INVALID_AMOUNT' WHEN l_returnflag = 'A' THEN 'EMPTY_MERCHANT' END AS error_type,
         l_extendedprice > 30000 AND l_returnflag <> 'R' AS stopped
  FROM c JOIN lineitem ON l_orderkey = case_id
),
s AS (
  SELECT *, CASE WHEN error_type IS NOT NULL THEN 'ERROR' WHEN stopped THEN 'APPROVAL_REQUIRED' ELSE 'PROVISIONAL_CREDIT_POSTED' END AS status,
         error_type IS NULL AND NOT stopped AS posted
  FROM d
)
SELECT transaction_id, customer_id, status, error_type, CASE WHEN posted THEN {_stable_id("DSP-", "transaction_id")} END AS dispute_id,
       CASE WHEN posted THEN amount END AS credit, CASE WHEN posted THEN 10 END AS resolution_days, case_id
FROM s""",
}

# A streaming query answers what its batch form answers.
ORACLES |= {
    "stream_velocity": ORACLES["velocity_alerts"],
    "stream_step_up": ORACLES["step_up_audit"],
    "timed_span_pairs": _pairs(2 * 24 * 3600 * 1_000_000),
    "stream_span_pairs": _pairs(2 * 24 * 3600 * 1_000_000),
    "usage_windows": _windows("1 day", "1 day"),
    "stream_usage": _windows("1 day", "1 day"),
    "stream_usage_sliding": _windows("6 hours", "2 hours"),
    "stream_sessions": ORACLES["activity_sessions"],
    "stream_compaction": ORACLES["compact_memory"],
    "stream_ingest": ORACLES["metadata_rows"],
    "stream_rejects": f"""
WITH {_NOTIFICATIONS} SELECT doc_id, delivery, reject_reason FROM decoded WHERE reject_reason IS NOT NULL""",
}


def _rejects(columns: str, where: str = "true") -> str:
    """Every tenth event comes without a time, every seventh again when its time is over."""
    return f"""
SELECT {columns}, 'no time' AS reason FROM events WHERE event_id % 10 = 0 AND {where}
UNION ALL
SELECT {columns}, 'late' FROM events WHERE event_id % 7 = 0 AND ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY AND {where}"""


ORACLES |= {
    "stream_velocity_faults": ORACLES["velocity_alerts"],
    "stream_velocity_rejects": _rejects("event_id AS signal_id, user_id AS customer_id"),
    "stream_step_up_rejects": _rejects(
        "CASE event_type WHEN 'signup' THEN 'challenge' ELSE 'reply' END AS kind, event_id", "event_type IN ('signup', 'click')"
    ),
    "stream_span_rejects": _rejects(
        f"event_id AS span_id, user_id AS session_id, 'tool_' || CAST({_K} % 5 AS VARCHAR) AS name", "event_type IN ('click', 'view')"
    ),
}
_FAULTY_EVENTS = """
faulty AS (
  SELECT event_type, value, ts FROM events
  UNION ALL SELECT event_type, value, NULL FROM events WHERE event_id % 10 = 0
  UNION ALL SELECT event_type, value, ts FROM events WHERE event_id % 7 = 0 AND ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY
)"""

ORACLES |= {
    "stream_compacted_memory": ORACLES["compacted_memory"],
    "stream_compacted_memory_pieces": ORACLES["compacted_memory"],
    "stream_usage_totals": f"""
WITH {_FAULTY_EVENTS}
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type AS channel,
       count(*) AS records, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS amount_cents
FROM faulty GROUP BY ALL""",
}
ORACLES |= {
    f"{name}_pieces": ORACLES[name]
    for name in ("stream_velocity", "stream_step_up", "stream_span_pairs", "stream_usage", "stream_ingest")
}
