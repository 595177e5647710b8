"""Words, patterns, formats and constants that results depend on.

They are part of the specification, not of the design, and must not change. Everything that may
be tuned is a parameter of the operator that uses it.
"""

# --- patterns and replacement texts -----------------------------------------------------------
CARD_NUMBER_PATTERN = r"\b(?:\d[ -]*?){13,16}\b"
IDENTITY_NUMBER_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD_NUMBER_REPLACEMENT = "************REDACTED"
IDENTITY_NUMBER_REPLACEMENT = "***-**-REDACTED"
SECRET_FIELD_NAMES = ["cvv", "cvc", "security_code", "pin", "otp"]
SECRET_FIELD_REPLACEMENT = "***REDACTED_CVV***"
FORBIDDEN_TELEMETRY_KEYS = ["password", "card_number_raw", "full_pan", "ssn"]
MASK_PREFIX = "************"

# --- document tags ------------------------------------------------------------------------------
DOCUMENT_TAGS = {
    "invoice": ["invoice", "bill", "payment", "amount", "due"],
    "receipt": ["receipt", "purchase", "store", "tax"],
    "contract": ["contract", "agreement", "party", "signature", "terms"],
    "report": ["report", "analysis", "summary", "finding", "result"],
    "urgent": ["urgent", "asap", "immediate", "attention"],
}
DEFAULT_TAG = "document"

# --- message intent, first match wins -----------------------------------------------------------
INTENT_RULES = [
    (
        "ONE_CLICK_RESOLUTION",
        ["replace", "unlock", "send replacement", "issue", "resolve", "yes", "confirm", "stolen in london"],
    ),
    ("DIAGNOSIS", ["why", "declined", "locked", "not working", "target"]),
    ("DISPUTE_FILED", ["chicago", "1000", "1,000", "fraud"]),
    ("VCN_PROVISIONED", ["virtual", "vcn", "apple pay", "wallet"]),
]
INTENT_DEFAULT = "OVERVIEW"
# "1,000" is not an audit word although it is a dispute word.
AUDIT_WORDS = ["stolen", "london", "wallet", "lost", "fraud", "chicago", "1000", "target", "declined"]
TOOLS_PER_AUDIT = 1
TOOLS_PER_INTENT = {
    "ONE_CLICK_RESOLUTION": 2,
    "DIAGNOSIS": 0,
    "DISPUTE_FILED": 1,
    "VCN_PROVISIONED": 1,
    "OVERVIEW": 0,
}

# --- claim scenarios, first match wins ----------------------------------------------------------
CLAIM_RULES = [
    (1, ["stolen", "london", "wallet", "lost", "theft"]),
    (2, ["chicago", "1000", "1,000", "fraud", "unauthorized", "didn't make", "did not make"]),
    (3, ["target", "142", "declined", "locked", "why", "not working"]),
    (4, ["tokyo", "paris", "50,000", "50000", "ignore previous instructions"]),
]
CLAIM_DEFAULT = 5
# scenario: (status, confidence, corroborating signals)
CLAIM_OUTCOMES = {
    1: ("VERIFIED_TRUE", 0.99, 3),
    2: ("VERIFIED_TRUE", 0.99, 4),
    3: ("VERIFIED_TRUE", 0.98, 3),
    4: ("CONTRADICTED_BY_TELEMETRY", 0.15, 0),
    5: ("VERIFIED_TRUE", 0.92, 2),
}
# Scenario 1 without an active travel notice.
CLAIM_NO_NOTICE = ("UNVERIFIED_PENDING", 0.65, 0)
REVIEW_BELOW = 0.80

# --- work-item tiers ----------------------------------------------------------------------------
PRO_TASKS = ["SYNTHESIS", "VERACITY_AUDIT"]
LITE_TASKS = ["TELEMETRY_INGESTION", "IVR_LOG_LOOKUP", "WALLET_EVENT_LOOKUP"]
PRO_RISK = 85

# --- checks and approval limits -----------------------------------------------------------------
RESERVED_IDS = ["invalid", "unknown", "none", "null"]
DISPUTE_LIMIT = 2500.00
VIRTUAL_CARD_LIMIT = 25000.00
MIN_ADDRESS_LENGTH = 5
DISPUTE_DAYS = 10

# --- token and cost accounting ------------------------------------------------------------------
CHARS_PER_TOKEN = 4
SYSTEM_TOKENS = 265
TOOL_INPUT_TOKENS = 48
TOOL_OUTPUT_TOKENS = 36
FIRST_TURN_INPUT = 482
FIRST_TURN_OUTPUT = 146
# In 1e-8 USD per token: 0.15 and 0.60 USD per million.
INPUT_PRICE = 15
OUTPUT_PRICE = 60
COMPACTION_USD_PER_TOKEN = 0.000002

# --- spans ------------------------------------------------------------------------------------
LATENCY_LIMIT_MS = 500
SPAN_BUFFER = 200

# --- result states ------------------------------------------------------------------------------
CREDIT_POSTED = "PROVISIONAL_CREDIT_POSTED"
CARD_PROVISIONED = "ACTIVE_PROVISIONED"
COURIER_DISPATCHED = "DISPATCHED_TO_COURIER"
OLD_CARD_REVOKED = "PERMANENTLY_REVOKED_AND_BLOCKED"
SECURITY_LOCKED = "SECURITY_LOCKED"
DELIVERY_FORMAT = "EEEE, MMM dd 'at 2:00 PM GMT'"

# --- timeline lines -----------------------------------------------------------------------------
UNVERIFIED_TEXT = "[Veracity: Unverified]"
COMPACTED_TEXT = " [COMPACTED SUMMARY]"
