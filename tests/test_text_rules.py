"""Golden rows for expressions: redaction, masking, estimates, tags, rules, gates."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions import rules, text
from caseflow.functions.redact import redact_columns


def column(spark, values, expression, kind="string"):
    """The expression over a column ``x`` of values, in their order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression.alias("y")).orderBy("i").collect()]


REDACTED = [
    ("Card 4147 2024 8888 4821 failed", "Card ************REDACTED failed"),
    ("123-45-6789", "***-**-REDACTED"),
    ("123-45-6789 123-45-6789", "************REDACTED-6789"),
    ("12345678901234567", "12345678901234567"),
    ("1234 5678 9012 3456 7890", "************REDACTED 7890"),
    ("id 1234567 8901234", "id ************REDACTED"),
    ("x4785380592391139", "x4785380592391139"),
    ("é4785380592391139", "é4785380592391139"),
    ("٤١٤٧٢٠٢٤٨٨٨٨٤٨٢١", "************REDACTED"),
    ("4111-1111-1111-1111 and 123-45-6789", "************REDACTED and ***-**-REDACTED"),
    ("", ""),
    (None, None),
]


def test_redaction(spark):
    got = column(spark, [a for a, _ in REDACTED], text.redact_text(F.col("x")))
    assert got == [b for _, b in REDACTED]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789- xé", max_size=60), min_size=20, max_size=40))
def test_redaction_is_idempotent_and_leaves_nothing(spark, values):
    once = column(spark, values, text.redact_text(F.col("x")))
    assert column(spark, once, text.redact_text(F.col("x"))) == once
    left = column(spark, once, F.regexp_count("x", F.lit(text.IDENTITY_NUMBER)))
    assert not any(left)


def test_last4(spark):
    values = ["4821", " **4821 ", "* 4821", "invalid-pan", "12345", "", " *4821\n", None, "\x1c4821\x1f"]
    assert column(spark, values, text.clean_last4(F.col("x"))) == [
        "4821", "4821", None, None, None, None, "4821", None, "4821",
    ]
    assert column(spark, ["4821"], text.mask_pan(F.col("x"))) == ["************4821"]


def test_token_estimate(spark):
    values = ["", "abc", "abcdefg", "abcdefgh"]
    assert column(spark, values, text.token_estimate(F.length("x"))) == [1, 1, 1, 2]
    assert column(spark, values, text.token_estimate(F.length("x"), None)) == [0, 0, 1, 2]


def test_word_count_knows_every_space(spark):
    values = ["", "  ", "one", " two  words\n", "a b c　d", "a\x1cb\x1fc", "tab\tand\x0bmore\x85x"]
    assert column(spark, values, text.word_count(F.col("x"))) == [len(v.split()) for v in values]


def test_tags(spark):
    df = spark.createDataFrame(
        [(1, "Please pay this INVOICE, a summary is attached, asap"), (2, "hello world"), (3, ""), (4, None)],
        "i int, text string",
    )
    rows = text.tag_documents(df).orderBy("i").collect()
    assert [(r.tags, r.word_count) for r in rows] == [
        ("invoice, report, urgent", 9), ("document", 2), ("document", 0), ("document", 0),
    ]


def test_empty_rule_words_are_refused():
    with pytest.raises(ValueError):
        text.contains_any(F.col("x"), ["ok", ""])
    with pytest.raises(ValueError):
        text.contains_any(F.col("x"), [])


INTENTS = [
    ("Why was my card declined at Target?", "DIAGNOSIS", True, 1),
    ("I didn't make the $1,000 charge in Chicago. Please dispute it.", "DISPUTE_FILED", True, 2),
    ("Someone stole my wallet in London! Send replacement please", "ONE_CLICK_RESOLUTION", True, 3),
    ("My eyes hurt", "ONE_CLICK_RESOLUTION", False, 2),
    ("a $1,000 thing", "DISPUTE_FILED", False, 1),
    ("VCN please", "VCN_PROVISIONED", False, 1),
    ("hello", "OVERVIEW", False, 0),
    (None, "OVERVIEW", False, 0),
]


def test_intents_audits_and_tools(spark):
    messages = [m for m, *_ in INTENTS]
    intent, audited = rules.route_intent(F.col("x")), rules.needs_audit(F.col("x"))
    assert column(spark, messages, intent) == [i for _, i, _, _ in INTENTS]
    assert column(spark, messages, audited) == [a for *_, a, _ in INTENTS]
    assert column(spark, messages, rules.tools_used(intent, audited)) == [n for *_, n in INTENTS]


CLAIMS = [
    ("lost my card in Tokyo", True, 1, "VERIFIED_TRUE", 0.99, 3, False),
    ("lost my card in Tokyo", False, 1, "UNVERIFIED_PENDING", 0.65, 0, True),
    ("refund $21000", False, 2, "VERIFIED_TRUE", 0.99, 4, False),
    ("why is it locked", False, 3, "VERIFIED_TRUE", 0.98, 3, False),
    ("I am in Paris", True, 4, "CONTRADICTED_BY_TELEMETRY", 0.15, 0, True),
    ("hello", False, 5, "VERIFIED_TRUE", 0.92, 2, False),
]


def test_claim_scenarios(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CLAIMS)], "i int, x string, notice boolean")
    scenario = rules.claim_scenario(F.col("x"))
    rows = (
        df.select("i", scenario.alias("s"), rules.claim_outcome(scenario, F.col("notice")).alias("o"))
        .select("i", "s", "o.*", rules.needs_review(F.col("o.confidence")).alias("review"))
        .orderBy("i")
        .collect()
    )
    assert [tuple(r)[1:] for r in rows] == [c[2:] for c in CLAIMS]


def test_tiers(spark):
    cases = [
        ("SYNTHESIS", 92, False, "pro"), ("TELEMETRY_INGESTION", 10, False, "lite"),
        ("TELEMETRY_INGESTION", 85, False, "pro"), ("CARD_OPS", 40, False, "fast"),
        ("CARD_OPS", 40, True, "pro"), ("IVR_LOG_LOOKUP", None, None, "lite"),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, t string, r int, m boolean")
    tier = rules.model_tier(F.col("t"), F.col("r"), F.col("m"))
    assert [r.y for r in df.select("i", tier.alias("y")).orderBy("i").collect()] == [c[3] for c in cases]


GATES = [
    (1000.0, True, None, "EXECUTE"),
    (2500.0, True, None, "EXECUTE"),
    (2500.01, True, None, "APPROVAL_REQUIRED"),
    (5000.0, True, "t", "EXECUTE"),
    (5000.0, True, "", "APPROVAL_REQUIRED"),
    (100.0, False, "t", "APPROVAL_REQUIRED"),
    (100.0, None, "t", "APPROVAL_REQUIRED"),
    (0.0, True, None, "ERROR"),
    (-10.0, True, None, "ERROR"),
    (None, True, None, "ERROR"),
    (float("nan"), True, None, "ERROR"),
]


def test_approval_gate(spark):
    df = spark.createDataFrame([(i, *g[:3]) for i, g in enumerate(GATES)], "i int, a double, ok boolean, t string")
    gate = rules.approval_gate(F.col("a"), 2500.0, F.col("ok"), F.col("t"))
    assert [r.y for r in df.select("i", gate.alias("y")).orderBy("i").collect()] == [g[3] for g in GATES]


def test_nan_is_greater_than_any_number(spark):
    """The reason ``is_positive`` names NaN."""
    assert column(spark, [float("nan")], F.col("x") > 2500.0, "double") == [True]


def test_redact_columns_walks_the_schema(spark):
    schema = (
        "id bigint, CVV int, note string, nested struct<otp: string, inner: struct<text: string, n: int>>, "
        "tags array<string>, items array<struct<pin: int, text: string>>, attrs map<string, string>, "
        "counts map<string, int>, pin array<int>"
    )
    row = (
        1, 123, "pay 4111111111111111", (None, ("ssn 123-45-6789", 5)), ["4111 1111 1111 1111", None],
        [(7, "123-45-6789")], {"Pin": "99", "memo": "4111111111111111", "none": None}, {"otp": 5, "n": 6}, [1, 2],
    )
    empty = (2, None, None, None, None, None, None, None, None)
    df = redact_columns(spark.createDataFrame([row, empty], schema))
    got = {r.id: r.asDict(recursive=True) for r in df.collect()}
    assert got[1] == {
        "id": 1,
        "CVV": "***REDACTED_CVV***",
        "note": "pay ************REDACTED",
        "nested": {"otp": "***REDACTED_CVV***", "inner": {"text": "ssn ***-**-REDACTED", "n": 5}},
        "tags": ["************REDACTED", None],
        "items": [{"pin": "***REDACTED_CVV***", "text": "***-**-REDACTED"}],
        "attrs": {"Pin": "***REDACTED_CVV***", "memo": "************REDACTED", "none": None},
        "counts": {"otp": "***REDACTED_CVV***", "n": "6"},
        "pin": "***REDACTED_CVV***",
    }
    # A secret is replaced whatever it holds, nothing included.
    assert got[2]["CVV"] == got[2]["pin"] == "***REDACTED_CVV***"
    assert got[2]["nested"] is None and got[2]["attrs"] is None
    assert isinstance(df.schema["counts"].dataType, T.MapType)


def test_redact_columns_reaches_nested_and_keyed_maps(spark):
    schema = "a map<string, struct<x: string>>, b map<string, array<string>>, c map<int, string>, d map<int, struct<pin: string>>"
    row = ({"PIN": ("1234",), "memo": ("4147202488884821",)}, {"otp": ["9999"], "m": ["123-45-6789"]}, {1: "4147202488884821"}, {2: ("77",)})
    got = redact_columns(spark.createDataFrame([row], schema)).first().asDict(recursive=True)
    assert got == {
        "a": {"PIN": None, "memo": {"x": "************REDACTED"}},
        "b": {"otp": None, "m": ["***-**-REDACTED"]},
        "c": {1: "************REDACTED"},
        "d": {2: {"pin": "***REDACTED_CVV***"}},
    }


def test_session_gate(spark):
    cases = [
        (True, False, False, 10.0, None, "EXECUTE"),
        (None, None, None, None, None, "EXECUTE"),
        (False, False, True, 10.0, "t", "APPROVAL_REQUIRED"),
        (True, True, False, 10.0, None, "APPROVAL_REQUIRED"),
        (True, True, True, 10.0, None, "EXECUTE"),
        (True, False, False, 2500.01, None, "APPROVAL_REQUIRED"),
        (True, False, False, 2500.01, "t", "EXECUTE"),
        (True, False, False, float("nan"), None, "EXECUTE"),
    ]
    df = spark.createDataFrame(
        [(i, *c[:5]) for i, c in enumerate(cases)], "i int, ok boolean, r boolean, c boolean, a double, t string"
    )
    gate = rules.session_gate(F.col("ok"), F.col("r"), F.col("c"), F.col("a"), 2500.0, F.col("t"))
    assert [r.y for r in df.select("i", gate.alias("y")).orderBy("i").collect()] == [c[5] for c in cases]
