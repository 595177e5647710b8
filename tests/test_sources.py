"""Notifications, metadata, nested records, evaluation sets."""

from __future__ import annotations

import base64
import json

from pyspark.sql import functions as F

from caseflow.operators import scoring
from caseflow.sources import notifications, records


def envelope(body, **message) -> str:
    data = base64.b64encode(body if isinstance(body, bytes) else json.dumps(body).encode()).decode()
    return json.dumps({"message": {"data": data, "messageId": "1", **message}, "subscription": "s"})


GOOD = {"bucket": "b", "name": "a/b.txt", "timeCreated": "2026-06-28T16:00:00.000Z", "generation": "1"}
NOTIFICATIONS = [
    (envelope(GOOD), None),
    (envelope({"bucket": "b", "name": "Größe 1.txt"}), None),
    (None, "NO_PAYLOAD"),
    ("", "NO_PAYLOAD"),
    ("  ", "NO_PAYLOAD"),
    ("{}", "NO_PAYLOAD"),
    ("[]", "NO_PAYLOAD"),
    ("null", "NO_PAYLOAD"),
    ("{oops", "NO_PAYLOAD"),
    ("\t\n", "NO_PAYLOAD"),
    ("5", "INVALID_FORMAT"),
    ('"abc"', "INVALID_FORMAT"),
    ("true", "INVALID_FORMAT"),
    ('{"message": {"data": ""}}', "DECODE_FAILED"),
    ('{"message": {"data": null}}', "DECODE_FAILED"),
    ("[1, 2]", "INVALID_FORMAT"),
    ('{"subscription": "s"}', "INVALID_FORMAT"),
    ('{"message": {}}', "NO_DATA"),
    ('{"message": {"messageId": "1"}}', "NO_DATA"),
    ('{"message": {"data": "%%%"}}', "DECODE_FAILED"),
    (envelope(b"{not json"), "DECODE_FAILED"),
    (envelope(b"\xff\xfe{}"), "DECODE_FAILED"),
    (envelope({"bucket": "b"}), "MISSING_OBJECT"),
    (envelope({"name": "n"}), "MISSING_OBJECT"),
    (envelope({"bucket": "", "name": "n"}), "MISSING_OBJECT"),
    (envelope({}), "MISSING_OBJECT"),
]


def raw_rows(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, raw string")


def test_every_reject_reason(spark):
    df = raw_rows(spark, [n for n, _ in NOTIFICATIONS])
    got = {r.i: r.reject_reason for r in notifications.decoded(df).collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(NOTIFICATIONS)}
    usable, rejected = notifications.decode_notifications(df)
    assert {r.name for r in usable.collect()} == {"a/b.txt", "Größe 1.txt"}
    assert usable.count() + rejected.count() == len(NOTIFICATIONS)


def test_content_and_metadata(spark, tmp_path):
    df = raw_rows(spark, [envelope(GOOD), envelope(GOOD), envelope({**GOOD, "name": "x", "timeCreated": None}), envelope({**GOOD, "name": "gone"})])
    usable, _ = notifications.decode_notifications(df)
    objects = spark.createDataFrame([("b", "a/b.txt", "An invoice, urgent"), ("b", "x", "plain words here")], "bucket string, name string, content string")
    contents = notifications.attach_content(notifications.one_per_object(usable), objects)
    assert sorted((r.name, r.status) for r in contents.collect()) == [("a/b.txt", "OK"), ("gone", "CONTENT_NOT_FOUND"), ("x", "OK")]
    rows = notifications.metadata_rows(contents, now=F.lit("NOW"))
    want = [("a/b.txt", "2026-06-28T16:00:00.000Z", "invoice, urgent", 3), ("x", "NOW", "document", 3)]
    assert sorted(tuple(r) for r in rows.collect()) == want
    for fmt in ("json", "parquet"):
        for batch in ("7", "8", "7"):  # the first batch is tried again
            notifications.append_metadata(rows, str(tmp_path / fmt), batch, fmt)
        back = notifications.read_metadata(spark, str(tmp_path / fmt), fmt)
        assert sorted(tuple(r) for r in back.collect()) == sorted((*w, batch) for w in want for batch in "78")


def test_a_filter_does_not_decode_again(spark):
    usable, _ = notifications.decode_notifications(raw_rows(spark, [n for n, _ in NOTIFICATIONS]))
    plan = notifications.one_per_object(usable)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 3


def test_the_earliest_redelivery_stays(spark):
    rows = [("b", "n", "1", t, m, c, i) for i, (t, m, c) in enumerate([("2", "a", "x"), ("1", "b", "y"), ("1", "a", "z"), ("3", None, None)])]
    rows += [("b", "n", None, None, None, None, 9), ("b", "n", None, "0", None, None, 8)]
    df = spark.createDataFrame(rows, "bucket string, name string, generation string, publish_time string, message_id string, time_created string, i int")
    for parts in (1, 3):
        assert sorted(r.i for r in notifications.one_per_object(df.repartition(parts)).collect()) == [2, 9]


def test_explode_keeps_rows_without_records(spark):
    df = spark.createDataFrame([(1, [("a", 1.0), ("b", None)], {"k": 1}), (2, [], {}), (3, None, None)], "id int, r array<struct<l:string,x:double>>, m map<string,int>")
    assert sorted(map(str, records.explode_records(df, "r", ["id"]).collect())) == [
        "Row(id=1, l='a', x=1.0)", "Row(id=1, l='b', x=None)", "Row(id=2, l=None, x=None)", "Row(id=3, l=None, x=None)",
    ]
    assert sorted((r.id, str(r.key)) for r in records.explode_records(df, "m", ["id"]).collect()) == [(1, "k"), (2, "None"), (3, "None")]


SET = {
    "eval_set_id": "set-1",
    "name": "Set one",
    "max_score": 19,
    "eval_cases": [
        {"eval_id": "terms", "weight_points": 5, "expected_terms": ["Zero liability", "credit"], "rubrics": [{"rubric_id": "r1", "type": "BOOLEAN"}, {"rubric_id": "r2", "type": "BOOLEAN"}]},
        {"eval_id": "patterns", "weight_points": 4, "forbidden_patterns": ["\\b[0-9]{16}\\b"], "required_patterns": ["\\*4821"]},
        {"eval_id": "trace", "weight_points": 5, "expected_trace_prefix": "trace-"},
        {"eval_id": "fast", "weight_points": 5, "max_acceptable_latency_ms": 500.0},
        {"eval_id": "saving", "weight_points": 5, "minimum_token_reduction_pct": 50.0},
        {"eval_id": "channels", "weight_points": 5, "expected_channels": ["IVR", "POS"]},
        {"eval_id": "silence", "weight_points": 4, "forbidden_questions": ["what is your card number"]},
        {"eval_id": "keys", "weight_points": 4, "forbidden_telemetry_keys": ["password"], "claims_to_test": [{"claim": "c", "expected_status": "OK", "min_confidence": 0.9}]},
    ],
}
# (case, text, trace id, value, members, passes)
OUTPUTS = [
    ("terms", "ZERO LIABILITY and a Credit", None, None, None, True),
    ("terms", "zero liability only", None, None, None, False),
    ("patterns", "card *4821", None, None, None, True),
    ("patterns", "card *4821 4111111111111111", None, None, None, False),
    ("patterns", "card", None, None, None, False),
    ("trace", "", "trace-9", None, None, True),
    ("trace", "", "span-9", None, None, False),
    ("trace", "", None, None, None, False),
    ("fast", "", None, 499.9, None, True),
    ("fast", "", None, 500.0, None, False),
    ("saving", "", None, 50.0, None, True),
    ("saving", "", None, 49.9, None, False),
    ("channels", "", None, None, ["POS", "IVR", "WEB"], True),
    ("channels", "", None, None, ["POS"], False),
    ("channels", "", None, None, None, False),
    ("silence", "All done.", None, None, None, True),
    ("silence", "What is your card number?", None, None, None, False),
    ("keys", "PASSWORD=1", None, None, None, False),
]


def test_eval_sets_are_read_and_scored(spark, tmp_path):
    (tmp_path / "set.json").write_text(json.dumps(SET, indent=2))
    sets = records.read_eval_sets(spark, str(tmp_path))
    assert records.eval_cases(sets).count() == 8
    assert sorted(r.rubric_id for r in records.eval_rubrics(sets).collect() if r.rubric_id) == ["r1", "r2"]
    outputs = spark.createDataFrame([(i, *o[:5]) for i, o in enumerate(OUTPUTS)], "output_id int, eval_id string, text string, trace_id string, value double, members array<string>")
    scored = scoring.eval_scoring(records.scoring_cases(sets), outputs).collect()
    points = {c["eval_id"]: c["weight_points"] for c in SET["eval_cases"]}
    for r in scored:
        passing = sum(o[5] for o in OUTPUTS if o[0] == r.eval_id)
        assert (r.eval_id, r.passed, r.points) == (r.eval_id, passing, passing * points[r.eval_id])
        assert r.outputs == sum(o[0] == r.eval_id for o in OUTPUTS)
    assert len(scored) == 8
    rest = scoring.eval_scoring(records.scoring_cases(sets), outputs.filter("eval_id = 'terms'")).collect()
    assert {(r.eval_id, r.outputs, r.points, r.points_possible) for r in rest if r.eval_id != "terms"} == {
        (name, 0, 0, weight) for name, weight in points.items() if name != "terms"
    }
