"""Golden rows for operators on small hand-made tables."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from caseflow.functions.text import CARD_NUMBER, IDENTITY_NUMBER
from caseflow.functions.redact import redact_columns
from caseflow.functions import contained as finder_module
from caseflow.operators import correlate, lookup, memory, resolve, scoring, spans, usage, validate
from caseflow.plans import mapping
from tests.conftest import SMALL


def at(minutes: float, day: int = 1) -> dt.datetime:
    return dt.datetime(2026, 9, day) + dt.timedelta(minutes=minutes)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# --- correlation ------------------------------------------------------------------------------


def test_velocity(spark):
    places = spark.createDataFrame(
        [(1, "New York", 40.7128, -74.0060), (2, "Chicago", 41.8781, -87.6298), (3, "Newark", 40.7357, -74.1724)],
        "location_id int, city string, lat double, lon double",
    )
    signals = spark.createDataFrame(
        [
            (1, 1, at(0), 1), (2, 1, at(9), 2),          # nine minutes, 711 miles
            (3, 2, at(0), 1), (4, 2, at(5), 1),          # same place
            (5, 3, at(0), 1), (6, 4, at(1), 2),          # different customers
            (7, 5, at(0), 1), (8, 5, at(60), 2),         # 711 mph
            (9, 6, at(0), 1), (10, 6, at(120), 2),       # 356 mph
            (11, 7, at(0), 1), (12, 7, at(0), 2),        # no time at all
            (13, 8, at(0), 1), (14, 8, at(8), 3),        # near, but within nine minutes
        ],
        "signal_id long, customer_id long, ts timestamp_ntz, location_id int",
    )
    got = correlate.velocity_alerts(signals, places)
    assert rows(got, "signal_id", "prev_signal_id", "gap_seconds", "alert_type") == [
        (2, 1, 540, "DUAL_CITY"), (8, 7, 3600, "SPEED"), (12, 11, 0, "DUAL_CITY"), (14, 13, 480, "DUAL_CITY"),
    ]
    miles = {r.signal_id: r.distance_miles for r in got.collect()}
    assert 710 < miles[2] < 713 and 8 < miles[14] < 10


def test_travel_edges(spark):
    day = dt.date
    notices = spark.createDataFrame(
        [(1, 7, day(2026, 9, 28), day(2026, 10, 12)), (2, 7, day(2026, 10, 1), day(2026, 10, 2)), (3, 8, day(2026, 9, 1), day(2026, 9, 2))],
        "notice_id long, customer_id long, start_date date, end_date date",
    )
    charges = spark.createDataFrame(
        [(10, 7, day(2026, 9, 27)), (11, 7, day(2026, 9, 28)), (12, 7, day(2026, 10, 12)), (13, 7, day(2026, 10, 13)),
         (14, 7, day(2026, 9, 5)), (15, 8, day(2026, 9, 28)), (16, 9, day(2026, 10, 1)), (17, 7, day(2026, 10, 2))],
        "charge_id long, customer_id long, charge_date date",
    )
    assert rows(correlate.travel_coverage(charges, notices).fillna(-1), "charge_id", "notice_id", "is_covered") == [
        (10, -1, False), (11, 1, True), (12, 1, True), (13, -1, False), (14, -1, False), (15, -1, False),
        (16, -1, False), (17, 1, True),
    ]
    assert rows(correlate.covered_charges(charges, notices), "charge_id") == [(11,), (12,), (17,)]
    assert rows(correlate.covered_charges(charges, notices, covered=False), "charge_id") == [(10,), (13,), (14,), (15,), (16,)]


def test_step_up(spark):
    asked = spark.createDataFrame(
        [(1, 1, at(0), 5), (2, 1, at(100), 5), (3, 2, at(0), 5), (4, 3, at(0), 5)],
        "challenge_id long, customer_id long, challenge_ts timestamp_ntz, challenge_origin int",
    )
    given = spark.createDataFrame(
        [(10, 1, at(0.5), 6), (11, 1, at(1), 5), (12, 1, at(130.1), 5), (13, 2, at(30), 5), (14, 3, at(0), 5)],
        "reply_id long, customer_id long, reply_ts timestamp_ntz, reply_origin int",
    )
    got = correlate.step_up_audit(asked, given).fillna(-1)
    assert rows(got, "challenge_id", "reply_id", "reply_after_seconds", "compromise_likelihood") == [
        (1, 10, 30, "HIGH"), (2, -1, -1, "NO_REPLY"), (3, 13, 1800, "LOW"), (4, -1, -1, "NO_REPLY"),
    ]


def test_incident_chain(spark):
    def events(prefix, data):
        return spark.createDataFrame(data, f"{prefix}_id long, customer_id long, {prefix}_ts timestamp_ntz")

    got = correlate.incident_chain(
        events("decline", [(1, 1, at(0)), (2, 2, at(0)), (3, 3, at(0)), (4, 1, at(10))]),
        events("call", [(11, 1, at(2)), (12, 2, at(121)), (13, 3, at(2)), (14, 1, at(12))]),
        events("wallet", [(21, 1, at(600)), (22, 2, at(130)), (23, 3, at(2 + 24 * 60 + 1))]),
    )
    assert rows(got, "decline_id", "call_id", "wallet_id", "call_after_seconds") == [(1, 11, 21, 120), (4, 14, 21, 120)]


def test_status_asof(spark):
    changes = spark.createDataFrame(
        [(5, 1, at(10), "LOCKED"), (7, 1, at(20), "ACTIVE")], "status_id long, customer_id long, status_ts timestamp_ntz, status string"
    )
    charges = spark.createDataFrame(
        [(1, 1, at(5)), (2, 1, at(15)), (3, 1, at(25)), (4, 1, at(10)), (6, 1, at(10)), (8, 2, at(15))],
        "charge_id long, customer_id long, charge_ts timestamp_ntz",
    )
    got = correlate.status_asof(charges, changes).fillna("none")
    assert rows(got, "charge_id", "status", "explained_by_lock") == [
        (1, "none", False), (2, "LOCKED", True), (3, "ACTIVE", False), (4, "none", False), (6, "LOCKED", True), (8, "none", False),
    ]


def test_line_numbers_need_not_be_unique(spark):
    """Two lines of the first order tie; the larger one counts, once."""
    charges = spark.createDataFrame(
        [(1, 9, 100, at(0), 60_000.0), (1, 9, 100, at(0), 70_000.0), (1, 9, 101, at(5), 90_000.0), (1, 8, 102, at(0), 10.0)],
        "customer_id long, merchant_id long, transaction_id long, ts timestamp_ntz, amount double",
    )
    assert rows(correlate.unfamiliar_high_value(charges), "merchant_id", "transaction_id", "amount") == [(9, 100, 70_000.0)]


# --- searches ---------------------------------------------------------------------------------


def test_memory_search_falls_back_to_all(spark):
    fragments = spark.createDataFrame(
        [(1, 1, "POS", "Target decline", {"code": "X9"}), (2, 1, "TRAVEL", "travel", None), (3, 2, "POS", "other", {})],
        "fragment_id long, customer_id long, channel string, summary string, metadata map<string,string>",
    )
    queries = spark.createDataFrame(
        [(1, 1, "target"), (2, 1, "zzz"), (3, 1, "x9"), (4, 1, ""), (5, 2, "pos"), (6, 3, "pos")],
        "query_id long, customer_id long, query string",
    )
    assert rows(lookup.memory_search(fragments, queries), "query_id", "fragment_id", "is_match") == [
        (1, 1, True), (2, 1, False), (2, 2, False), (3, 1, True), (4, 1, True), (4, 2, True), (5, 3, True),
    ]


def test_substring_hits_equal_brute_force(spark):
    """Words of one to many letters, letters beyond 16 bits, line breaks, repeated words, missing keys and fields."""
    rnd = random.Random(3)
    letters = ["a", "b", "ß", "é", "漢", "😀", " ", "\n", "."]
    texts = [(i, rnd.choice([1, 2, None]), ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(rnd.randint(0, 3))]) for i in range(60)]
    words = [(rnd.choice([1, 2, 3, None]), "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6)))) for _ in range(120)] * 2
    got = lookup.substring_hits(
        spark.createDataFrame(texts, "id int, k int, fields array<string>"), spark.createDataFrame(words, "k int, word string"), ["k"], "id", hot_rows=9
    )
    want = sorted({(k, w, i) for k, w in words for i, own, fields in texts if k is not None and k == own and any(w in f for f in fields)})
    assert rows(got, "k", "word", "id") == want
    assert len(want) > 100


@pytest.mark.parametrize("listed", [0, 250_000])
@pytest.mark.parametrize("keys", [["k"], []])
def test_long_and_short_lists_of_words_find_the_same(spark, monkeypatch, listed, keys):
    """Phrases, spaces alone, ids that come twice or are missing; both ways give a row for each text and word in it."""
    rnd = random.Random(11)
    letters = ["a", "b", "ab", "é", "漢", " ", " ", "\t", "\u00a0", "\u2003", "x" * 70]
    texts = [(None if i == 5 else i // 2 if i < 10 else i, rnd.choice([1, 2, None]), ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(2)]) for i in range(60)]
    words = [(rnd.choice([1, 2, 3, None]), "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 5)))) for _ in range(150)]
    words += [(1, " "), (2, " \t"), (1, None), (1, "x" * 71)]
    monkeypatch.setattr(lookup, "LISTED_WORDS", listed)
    monkeypatch.setattr(finder_module, "KEPT", 3)
    asked = spark.createDataFrame(words, "k int, word string")
    got = lookup.substring_hits(spark.createDataFrame(texts, "id int, k int, fields array<string>"), asked, keys, "id", hot_rows=9)
    pairs = {((k,) if keys else ()) + (w,) for k, w in words if w is not None and not (keys and k is None)}
    want = sorted((*p, i) for p in pairs for i, own, fields in texts if i is not None and (not keys or p[0] == own) and any(p[-1] in f for f in fields))
    assert rows(got, *keys, "word", "id") == want
    assert len(want) > 100


def test_a_short_list_of_words_makes_no_index_of_the_texts(spark, monkeypatch):
    """What is written grows with the words, not with the texts."""
    stored = []
    real = lookup._stored
    monkeypatch.setattr(lookup, "_stored", lambda df, name: stored.append(name) or real(df, name))
    texts = spark.createDataFrame([(i, [f"common {i}"]) for i in range(50)], "id int, fields array<string>")
    got = lookup.substring_hits(texts, spark.createDataFrame([("common",), ("49",)], "word string"), [], "id")
    assert got.count() == 51
    assert stored == ["words", "word-lists"]


def test_one_word_common_to_all_texts_is_no_single_key(spark, monkeypatch):
    """The rows of its substring are dealt to shares; the largest task's part is tested."""
    texts = spark.createDataFrame([(i, 1, [f"common {i}"]) for i in range(2000)], "id int, k int, fields array<string>")
    words = spark.createDataFrame([(1, "common"), (1, "1999"), (1, "zzz")], "k int, word string")
    shares = []
    real = lookup.spread_join

    def spying(left, right, keys, spread_by, how="inner", *, hot_rows):
        out = real(left, right, keys, spread_by, how, hot_rows=hot_rows)
        shares.append(max(r["n"] for r in left.groupBy(*keys, (F.xxhash64(*spread_by) % (2000 // hot_rows))).agg(F.count("*").alias("n")).collect()))
        return out

    monkeypatch.setattr(lookup, "spread_join", spying)
    got = lookup.substring_hits(texts, words, ["k"], "id", hot_rows=100)
    assert got.count() == 2001
    assert max(shares) <= 200


def test_policy_search(spark):
    policies = spark.createDataFrame(
        [(1, 0, "Zero liability", "unauthorised charges"), (2, 1, "Courier", "Delivery within a day"),
         (3, 2, "Virtual", "a é b"), (4, 3, "Gate", "checks claims")],
        "policy_id long, position long, title string, summary string",
    )
    queries = spark.createDataFrame(
        [(1, "LIABILITY"), (2, "nothing-like-it qqq"), (3, " within  virt "), (4, "é"), (5, "y\tz"), (6, "claims")],
        "query_id long, query string",
    )
    assert rows(lookup.policy_search(policies, queries), "query_id", "policy_id", "is_match") == [
        (1, 1, True), (2, 1, False), (2, 2, False), (3, 2, True), (3, 3, True), (4, 3, True), (5, 1, True), (5, 2, True), (6, 4, True),
    ]


def test_policy_search_matches_brute_force(spark):
    texts = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    words = [t.split()[i % len(t.split())] for i, (_, t) in enumerate(texts)] + ["a", "th", "ou er", "zzzz"]
    policies = spark.createDataFrame([(i, i, f"t{i}", t) for i, t in texts], "policy_id long, position long, title string, summary string")
    queries = spark.createDataFrame(list(enumerate(words)), "query_id long, query string")
    want = []
    for q, query in enumerate(words):
        hits = [i for i, t in texts if any(w in t.lower() or w in f"t{i}" for w in query.lower().split())]
        want += [(q, i) for i in (hits or [i for i, _ in texts[:2]])]
    assert rows(lookup.policy_search(policies, queries), "query_id", "policy_id") == sorted(want)


# --- timelines --------------------------------------------------------------------------------


def fragments(spark, data):
    return spark.createDataFrame(
        data,
        "fragment_id long, customer_id long, channel string, day_label string, ts timestamp_ntz, summary string, severity string, "
        "is_compacted_summary boolean, veracity struct<status: string, confidence: double>",
    )


def test_timeline_text_and_pages(spark):
    df = fragments(
        spark,
        [
            (2, 1, "B", "Day 2", at(0, 2), "later", "INFO", False, ("VERIFIED_TRUE", 0.57)),
            (1, 1, "A", "Day 1", at(0, 1), "first", "INFO", True, None),
            (3, 1, "C", "Day 3", at(0, 3), "last", "INFO", False, ("VERIFIED_TRUE", None)),
        ],
    )
    people = spark.createDataFrame([(1,), (2,)], "customer_id long")
    whole = memory.timeline_context(people, df).collect()
    text = {r.customer_id: r.context for r in whole}
    assert text[2] == memory.EMPTY_TIMELINE
    assert text[1].split("\n") == [
        "=== TIMELINE (customer 1) ===",
        "- [Day 1] [A] [COMPACTED SUMMARY] [Veracity: Unverified]: first",
        "- [Day 2] [B] [Veracity: VERIFIED_TRUE (Conf: 56%)]: later",
        "- [Day 3] [C] [Veracity: VERIFIED_TRUE (Conf: 100%)]: last",
        "=== END OF TIMELINE ===",
    ]
    for hot_rows in (1, 10**9):
        paged = memory.timeline_context(people, df, page_lines=2, hot_rows=hot_rows).filter("customer_id = 1")
        pages = [r.context for r in paged.orderBy("page").collect()]
        assert len(pages) == 2 and "\n".join(pages) == text[1]


def test_coverage(spark):
    df = fragments(spark, [(1, 1, "A", "", at(0), "", "", False, None), (2, 1, "B", "", at(0), "", "", False, None)])
    people = spark.createDataFrame([(1,), (2,)], "customer_id long")
    got = memory.channel_coverage(people, df, ["A", "B"])
    assert rows(got, "customer_id", "channels_present", "missing_channels", "is_complete") == [(1, 2, "", True), (2, 0, "A, B", False)]


def test_compaction_numbers(spark):
    long = fragments(
        spark,
        [
            (1, 1, "A", "", at(0), "x" * 573, "INFO", False, None),
            (2, 1, "A", "", at(1), "y" * 612, "HIGH", False, None),
            (3, 2, "A", "", at(0), "z" * 40, "INFO", False, None),
        ],
    )
    people = spark.createDataFrame([(1,), (2,), (3,)], "customer_id long")
    got = {r.customer_id: r for r in memory.compact_memory(people, long).collect()}
    # 1,185 characters are 296 tokens; the higher severity speaks for its channel.
    assert got[1].raw_tokens == 296 and got[1].compacted_summary == "[A] " + "y" * 612
    assert got[1].compacted_tokens == 616 // 4 and got[1].reduction_pct == 48.0
    assert got[1].saved_usd == 0.00028 and got[1].tokens_saved == 142
    # 40 characters grow to 44: savings may be negative, what is shown as saved may not.
    assert (got[2].raw_tokens, got[2].compacted_tokens, got[2].reduction_pct, got[2].tokens_saved) == (10, 11, -10.0, 0)
    assert got[3].status == "NO_OP" and got[3].raw_tokens is None and got[3].source_fragments == 0


def test_compacting_twice_changes_nothing(spark):
    people = mapping.customers(spark, SMALL)
    once = memory.compact_memory(people, mapping.event_fragments(spark, SMALL))
    again = memory.compacted_fragments(once).withColumn("ts", F.lit(at(0)))
    twice = memory.compact_memory(people, again)
    a = rows(once.filter("status = 'COMPACTED'"), "customer_id", "compacted_summary")
    b = rows(twice.filter("status = 'COMPACTED'"), "customer_id", "compacted_summary")
    assert a == b and a


def test_digests_add_up(spark):
    df = mapping.event_fragments(spark, SMALL)
    parts = [df.filter(F.col("fragment_id") % 3 == i) for i in range(3)]
    digests = None
    for part in parts:
        d = memory.with_best_text(memory.channel_digest(part), part)
        digests = d if digests is None else digests.unionByName(d)
    people = mapping.customers(spark, SMALL)
    split = memory.compaction_report(people, memory.merge_digests(digests))
    assert rows(split.fillna(-1), *split.columns) == rows(memory.compact_memory(people, df).fillna(-1), *split.columns)


def test_half_even_where_it_counts(spark):
    got = spark.range(1).select(F.bround(F.lit(0.125), 2).alias("even"), F.round(F.lit(0.125), 2).alias("up")).first()
    assert (got.even, got.up) == (0.12, 0.13)
    values = spark.createDataFrame([(150,), (250,), (251,), (249,), (0,), (10**15 + 50,)], "v long")
    halved = [r.h for r in values.select(usage.half_even_div(F.col("v"), 100).alias("h")).collect()]
    assert halved == [2, 2, 3, 2, 0, 10**13]


# --- usage and spans --------------------------------------------------------------------------


def test_token_usage(spark):
    turns = spark.createDataFrame(
        [(1, 1, 40, 9, 100, 1), (1, 2, 0, 0, 0, 0), (2, 5, 4, 4, 4, 2)],
        "session_id long, turn long, memory_chars int, message_chars int, reply_chars int, tools int",
    )
    got = {(r.session_id, r.turn): r for r in usage.token_usage(turns).collect()}
    first, second = got[1, 1], got[1, 2]
    assert (first.input_tokens, first.output_tokens, first.turns_count) == (325, 61, 2)
    assert (first.total_input, first.total_output, first.total_tokens) == (807, 207, 1014)
    assert (second.input_tokens, second.output_tokens) == (267, 1)
    assert (second.total_input, second.total_output, second.turns_count) == (1074, 208, 3)
    # 1074 at 0.15 and 208 at 0.60 USD per million.
    assert second.cost_micro_usd == round(1074 * 0.15 + 208 * 0.60)
    assert second.input_share_pct == 83.8 and second.output_share_pct == 16.2
    assert got[2, 5].input_tokens == 265 + 1 + 1 + 96


def test_sessions(spark):
    signals = spark.createDataFrame(
        [(1, at(0), 1.0), (1, at(0), 1.0), (1, at(60), 2.0), (1, at(121), 3.0), (2, at(0), 4.0)],
        "customer_id long, ts timestamp_ntz, amount double",
    )
    for hot_rows in (1, 2, 10**9):
        got = usage.sessions(usage.session_records(signals), 60, hot_rows=hot_rows)
        assert rows(got, "customer_id", "records", "amount_cents") == [(1, 1, 300), (1, 3, 400), (2, 1, 400)]


def test_sessions_of_parts_join(spark):
    records = usage.session_records(mapping.signals(spark, SMALL))
    parts = records.withColumn("p", F.pmod(F.hash("start_us"), F.lit(4)))
    stored = None
    for i in range(4):
        s = usage.sessions(parts.filter(F.col("p") == i).drop("p"), 300)
        stored = s if stored is None else stored.unionByName(s)
    names = ["customer_id", "start_us", "end_us", "records", "amount_cents"]
    assert rows(usage.sessions(stored, 300, hot_rows=5), *names) == rows(usage.sessions(records, 300), *names)


def test_span_stats_percentiles_match_brute_force(spark):
    df = mapping.spans(spark, SMALL)
    kinds = {}
    for r in df.collect():
        kinds.setdefault((r.span_type, r.name), []).append(r.duration_ms)
    for hot_rows in (4, 10**9):
        for r in spans.span_stats(df, 100, hot_rows=hot_rows).collect():
            values = sorted(kinds[r.span_type, r.name])
            n = len(values)
            assert r.spans == n and r.max_ms == values[-1]
            assert r.p50_ms == values[-(-n * 50 // 100) - 1]
            assert r.p95_ms == values[-(-n * 95 // 100) - 1]


def test_span_stats_round_no_duration(spark):
    df = spark.createDataFrame([("a", "b", 499.997), ("a", "b", 0.001)], "span_type string, name string, duration_ms double")
    r = spans.span_stats(df, 500).first()
    assert (r.under_limit_pct, r.max_ms, r.p50_ms, r.mean_ms) == (100.0, 499.997, 0.001, 249.999)


def test_recent_spans_keep_the_newest(spark):
    df = spark.createDataFrame([(i, at(i)) for i in range(201)], "span_id long, ts timestamp_ntz")
    got = [r.span_id for r in spans.recent_spans(df).collect()]
    assert got == list(range(200, 0, -1)) and len(set(got)) == 200


def test_span_pairs(spark):
    df = spark.createDataFrame(
        [(1, 1, "START", at(0)), (2, 1, "COMPLETE", at(1)), (3, 1, "COMPLETE", at(2)), (4, 1, "START", at(3)),
         (5, 1, "START", at(4)), (6, 1, "other", at(5)), (7, 1, "COMPLETE", at(100)), (8, 2, "COMPLETE", at(0)), (9, 2, "START", at(1))],
        "span_id long, session_id long, span_type string, ts timestamp_ntz",
    ).withColumn("name", F.lit("tool"))
    names = ["start_span_id", "complete_span_id", "duration_ms", "pairing"]
    for hot_rows in (1, 10**9):
        assert rows(spans.span_pairs(df, hot_rows=hot_rows).fillna(-1), *names) == [
            (-1, 3, 0.0, "NO_START"), (-1, 8, 0.0, "NO_START"), (1, 2, 60000.0, "PAIRED"), (4, -1, -1.0, "NO_COMPLETION"),
            (5, 7, 96 * 60000.0, "PAIRED"), (9, -1, -1.0, "NO_COMPLETION"),
        ]
        # Past the timeout neither end of the late pair has a partner.
        timed = rows(spans.span_pairs(df, 30, hot_rows=hot_rows).fillna(-1), *names)
        assert (5, -1, -1.0, "NO_COMPLETION") in timed and (-1, 7, 0.0, "NO_START") in timed


def test_normalise_logs(spark):
    df = spark.createDataFrame(
        [("warning", None, "c", 255, 16), (None, "s", None, 1, 2)],
        "level string, service string, component string, trace_number long, span_number long",
    )
    assert rows(spans.normalise_logs(df), "severity", "service", "component", "trace_id", "span_id") == [
        ("INFO", "s", "case-pipeline", "0" * 31 + "1", "0" * 15 + "2"),
        ("WARNING", "case-service", "c", "0" * 30 + "ff", "0" * 14 + "10"),
    ]


# --- scores -----------------------------------------------------------------------------------


def test_full_marks(spark):
    scores = spark.createDataFrame([("s", f"p{i}", 19, 19) for i in range(5)], "set string, pillar string, score long, max_score long")
    total = scoring.score_rollup(scores).filter("level = 2").first()
    assert (total.score, total.max_score, total.percentage) == (95, 95, "100.0%")


def test_risk_bands(spark):
    alerts = spark.createDataFrame(
        [(1, "VELOCITY", at(0)), (1, "STEP_UP_MISMATCH", at(5)), (2, "VELOCITY", at(0)), (3, "other", at(0)), (4, "VELOCITY", at(0)), (4, "VELOCITY", at(1))],
        "customer_id long, kind string, ts timestamp_ntz",
    )
    assert rows(scoring.risk_summary(alerts), "customer_id", "risk_score", "risk_level", "containment_status") == [
        (1, 92, "CRITICAL", "SECURITY_LOCKED"), (2, 52, "MEDIUM", "MONITORED"), (3, 0, "LOW", "MONITORED"), (4, 100, "CRITICAL", "SECURITY_LOCKED"),
    ]


def test_leaks_are_gone_after_redaction(spark):
    df = spark.createDataFrame([("a 4111111111111111 b", "123-45-6789"), ("password", None)], "x string, y string")
    patterns = {"card": CARD_NUMBER, "identity": IDENTITY_NUMBER}
    before = rows(scoring.leak_audit(df, ["x", "y"], patterns, ["password", "ss"]), "column_name", "pattern", "rows_with_match", "matches")
    assert ("x", "card", 1, 1) in before and ("y", "identity", 1, 1) in before and ("x", "password", 1, 1) in before
    assert ("x", "ss", 1, 1) in before and ("y", "password", 0, 0) in before
    after = scoring.leak_audit(redact_columns(df), ["x", "y"], patterns)
    assert {(r.pattern, r.matches) for r in after.collect()} == {("card", 0), ("identity", 0)}


# --- decisions --------------------------------------------------------------------------------


def test_checks_report_the_first_failure(spark):
    df = spark.createDataFrame(
        [(1, "t1", 5.0, "m"), (2, " \n", -1.0, ""), (3, "t3", float("nan"), ""), (4, "t4", 1.0, " "), (5, None, 1.0, "m")],
        "i int, transaction_id string, amount double, merchant string",
    )
    good, bad = validate.split_valid(df, validate.transaction_checks("transaction_id", "amount", "merchant"))
    assert rows(good, "i") == [(1,)] and good.columns == df.columns
    assert rows(bad, "i", "error_type") == [
        (2, "EMPTY_TRANSACTION"), (3, "INVALID_AMOUNT"), (4, "EMPTY_MERCHANT"), (5, "EMPTY_TRANSACTION"),
    ]


def test_reserved_ids_and_addresses(spark):
    df = spark.createDataFrame([(1, " None ", "somewhere"), (2, "c", " abcd "), (3, "c", "abcde"), (4, "c", None)], "i int, customer_id string, address string")
    checked = validate.checked(df, [validate.reserved_id("customer_id"), validate.short_address("address")]).fillna("ok")
    assert rows(checked, "i", "error_type") == [(1, "NOT_FOUND"), (2, "INCOMPLETE_ADDRESS"), (3, "ok"), (4, "INCOMPLETE_ADDRESS")]


def dispute_rows(spark, data):
    return spark.createDataFrame(data, "transaction_id long, customer_id long, amount double, merchant string, approved boolean, token string")


def test_disputes_check_before_the_gate(spark):
    df = dispute_rows(spark, [(1, 1, 1000.0, "m", True, None), (2, 1, 9000.0, "m", True, None), (3, 1, -1.0, "m", False, None), (4, 1, 9000.0, "m", True, "t"), (5, 2, 5.0, "", False, None)])
    got = resolve.file_disputes(df)
    assert rows(got.fillna("-"), "transaction_id", "status", "error_type") == [
        (1, "PROVISIONAL_CREDIT_POSTED", "-"), (2, "APPROVAL_REQUIRED", "-"), (3, "ERROR", "INVALID_AMOUNT"),
        (4, "PROVISIONAL_CREDIT_POSTED", "-"), (5, "ERROR", "EMPTY_MERCHANT"),
    ]
    assert rows(resolve.dispute_totals(got), "customer_id", "credited", "stopped", "errors", "total_credit") == [(1, 2, 1, 1, 10000.0), (2, 0, 0, 1, 0.0)]
    ids = [r.case_id for r in got.collect() if r.case_id]
    assert len(set(ids)) == 2 and all(i.startswith("DSP-") and i == i.upper() for i in ids)
    assert ids == [r.case_id for r in resolve.file_disputes(df).collect() if r.case_id]


def test_resolution_steps(spark):
    base = dict(case_id=1, customer_id="1", approved=True, token=None, transaction_id=7, amount=100.0, merchant="m",
                spending_limit=500.0, card_last4="4821", address="1 Long Street", opened_at=at(0), billers=4)
    changes = [{}, {"approved": False}, {"spending_limit": 30000.0}, {"spending_limit": 0.0}, {"address": " abc "},
               {"amount": 5000.0}, {"merchant": ""}, {"customer_id": " "}, {"spending_limit": -1.0, "approved": False}]
    data = [{**base, **c, "case_id": i} for i, c in enumerate(changes)]
    schema = ("case_id int, customer_id string, approved boolean, token string, transaction_id long, amount double, merchant string, "
              "spending_limit double, card_last4 string, address string, opened_at timestamp_ntz, billers long")
    df = spark.createDataFrame([tuple(d[f.split()[0]] for f in schema.split(", ")) for d in data], schema)
    got = resolve.resolve_cases(df).select("case_id", "status", "failed_step", F.col("dispute.status").alias("dispute"), F.col("courier.estimated_delivery").alias("eta"))
    assert rows(got.fillna("-"), "case_id", "status", "failed_step", "dispute") == [
        (0, "SUCCESS", "-", "PROVISIONAL_CREDIT_POSTED"), (1, "APPROVAL_REQUIRED", "approval", "-"), (2, "ERROR", "virtual_card", "-"),
        (3, "ERROR", "virtual_card", "-"), (4, "ERROR", "courier", "-"), (5, "SUCCESS", "-", "APPROVAL_REQUIRED"),
        (6, "SUCCESS", "-", "ERROR"), (7, "ERROR", "customer", "-"), (8, "APPROVAL_REQUIRED", "approval", "-"),
    ]
    assert {r.eta for r in got.collect() if r.eta} == {"Wednesday, Sep 02 at 2:00 PM GMT"}


def test_a_claim_stays_one_row(spark):
    claims = spark.createDataFrame([(1, 1, "lost it"), (1, 2, "lost it"), (2, 1, "lost it"), (3, 1, " ")], "customer_id long, turn long, claim_text string")
    notice = spark.createDataFrame([(1,), (1,), (1,)], "customer_id long")
    none = notice.filter("false")
    evidence = resolve.evidence_rows(("ledger_rows", none), ("notices", notice), ("baseline_rows", notice), ("suspect_replies", none))
    policies = spark.createDataFrame([("Lost cards", "are replaced"), ("Fraud", "is refunded")], "title string, summary string")
    got = resolve.claim_veracity(claims, evidence, policies)
    assert rows(got.fillna(-1).fillna("-"), "customer_id", "turn", "status", "notices", "policies") == [
        (1, 1, "VERIFIED_TRUE", 3, 1), (1, 2, "VERIFIED_TRUE", 3, 1), (2, 1, "UNVERIFIED_PENDING", 0, 1), (3, 1, "ERROR", 0, 2),
    ]
    written = resolve.verified_fragments(got)
    assert rows(written, "customer_id", "summary") == [(1, "lost it"), (1, "lost it")]
    joined = memory.append_fragments(fragments(spark, []), written)
    assert joined.count() == 2 and memory.memories_of(joined, 99).count() == 0


# --- rule tables --------------------------------------------------------------------------------

RULES = "priority int, label string, word string"
ITEMS = "id int, text string"


def test_rule_table_equals_the_expression_form(spark):
    from caseflow.functions import rules

    table = [(i, label, w) for i, (label, words) in enumerate(mapping.CLAIM_WORDS) for w in words]
    claims = mapping.claims(spark, SMALL).withColumn("id", F.concat_ws("-", "customer_id", "turn"))
    got = lookup.match_rules(claims, spark.createDataFrame(table, "priority int, label int, word string"), "id", "claim_text")
    want = claims.select("id", rules.first_match(F.col("claim_text"), mapping.CLAIM_WORDS, None).alias("label"))
    assert rows(got, "id", "label") == rows(want, "id", "label") != []


def test_ten_thousand_rules_equal_brute_force(spark):
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("abcdé ") for _ in range(rng.randint(3, 9))) for _ in range(14_000)})[:10_000]
    assert len(words) == 10_000
    table = [(rng.randrange(500), f"l{rng.randrange(9)}", w) for w in words]
    items = [(i, "".join(rng.choice("ABCDabcdé ") for _ in range(rng.choice([0, 2, 30, 400])))) for i in range(300)]
    got = lookup.match_rules(spark.createDataFrame(items, ITEMS), spark.createDataFrame(table, RULES), "id", "text", "none")
    want = []
    for i, text in items:
        hits = [r for r in table if r[2] in text.lower()]
        priority, label, word = min(hits, default=(None, "none", None))
        want.append((i, label, priority, word))
    assert rows(got, "id", "label", "priority", "word") == want


def test_rule_table_edge_cases(spark):
    """Nulls, empty words and texts, ties, repeated rows and ids, a word in every text, none at all."""
    items = spark.createDataFrame(
        [(1, "Lost card"), (1, "stolen"), (2, None), (3, ""), (4, "card card card"), (4, "card card card"), (5, "x")]
        + [(i, "every text has it") for i in range(100, 400)], ITEMS)
    table = [(5, "b", "card"), (5, "a", "card"), (5, "b", "card"), (1, "s", "stolen"), (3, None, "lost"), (None, "n", "x"),
             (2, "n", None), (9, "all", "every"), (9, "all", "text"), (2, "up", "Lost")]
    got = lookup.match_rules(items, spark.createDataFrame(table, RULES), "id", "text", "none", hot_rows=50)
    some = [(1, "s", 1, "stolen")] * 2 + [(2, "none", None, None), (3, "none", None, None)]
    some += [(4, "a", 5, "card")] * 2 + [(5, "none", None, None)]
    assert rows(got, "id", "label", "priority", "word") == some + [(i, "all", 9, "every") for i in range(100, 400)]
    blank = spark.createDataFrame([*table, (4, "blank", "")], RULES)
    got = rows(lookup.match_rules(items.where("id < 100"), blank, "id", "text"), "id", "label")
    assert got == [(1, "s"), (1, "s"), (2, "blank"), (3, "blank"), (4, "blank"), (4, "blank"), (5, "blank")]
    none = spark.createDataFrame([], RULES)
    assert set(rows(lookup.match_rules(items, none, "id", "text", "none"), "label")) == {("none",)}
    assert lookup.match_rules(items.limit(0), blank, "id", "text").count() == 0


def test_long_rule_tables_are_joined_by_shuffle(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"w{i % 7} common") for i in range(200)], ITEMS)
    table = spark.createDataFrame([(9, "c", "common"), *[(i, f"l{i}", f"w{i}") for i in range(3)]], RULES)
    want = rows(lookup.match_rules(items, table, "id", "text"), "id", "label")
    monkeypatch.setattr(lookup, "LISTED_ROWS", 0)
    assert rows(lookup.match_rules(items, table, "id", "text", hot_rows=20), "id", "label") == want
    assert want[:4] == [(0, "l0"), (1, "l1"), (2, "l2"), (3, "c")]


def test_case_disputes(spark):
    """Several charges of a case; failed cases and those whose switch is off or missing have none."""
    cases = spark.createDataFrame(
        [(1, 7, "SUCCESS", True), (1, 7, "SUCCESS", True), (2, 8, "ERROR", True), (3, 9, "SUCCESS", False), (4, 9, "SUCCESS", None),
         (5, 9, "SUCCESS", True)], "case_id int, customer_id int, status string, dispute boolean")
    charges = spark.createDataFrame(
        [(c, f"{c}-{n}", amount, merchant, token) for c in (1, 2, 3, 4, 6, None) for n, amount, merchant, token in (
            (1, 10.0, "shop", None), (2, 900.0, "shop", None), (3, 900.0, "shop", "t"), (4, 10.0, " ", None), (5, -1.0, "shop", None))],
        "case_id int, transaction_id string, amount double, merchant string, token string")
    got = resolve.case_disputes(cases, charges, F.col("dispute"), 500.0, hot_rows=2)
    posted, stopped = "PROVISIONAL_CREDIT_POSTED", "APPROVAL_REQUIRED"
    assert rows(got, "case_id", "customer_id", "transaction_id", "status", "credit") == [
        (1, 7, "1-1", posted, 10.0), (1, 7, "1-2", stopped, None), (1, 7, "1-3", posted, 900.0), (1, 7, "1-4", "ERROR", None),
        (1, 7, "1-5", "ERROR", None)]
    assert resolve.case_disputes(cases, charges, None, 500.0).select("case_id").distinct().count() == 3
