"""Reputation, personal data, licences, mixing, quality, decontamination and the pipeline."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from caseflow.llm import decontam, host_reputation, licenses, mixing, pii, quality
from tests.conftest import MEDIUM, SMALL
from tests.llm import brute

ROWS = brute.awkward_documents()
PAIRS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, brute.SCHEMA).repartition(5)


# --- hosts ---


def test_rules_and_parts_of_urls(spark):
    rows = [
        (1, "HTTP://A.Example.NET/en/x?q#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "http://example.net/de/", "example.net", "/de/", "net/", "block"),
        (3, "http://example.net", "example.net", "", None, "allow"),
        (4, "https://x.example.com/de/1", "x.example.com", "/de/1", "example.com/de/", "block"),
        (5, "https://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
        (6, "https://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"),
        (7, "https://a.org/fr", "a.org", "/fr", None, "allow"),
        (8, None, "", "", None, "allow"),
        (9, "no scheme", "", "", None, "allow"),
        (10, "", "", "", None, "allow"),
        (11, "a://b?x://c/d", "b", "", None, "allow"),
        (None, "http://EXAMPLE.net/fr/?", "example.net", "/fr/", "net/", "block"),
        (12, "http://10.0.0.1:80/net/", "10.0.0.1:80", "/net/", None, "allow"),
    ]
    pages = spark.createDataFrame([(r[0], r[1], 1, 2.0) for r in rows], "page_id long, url string, host long, mean double")
    outcomes = spark.createDataFrame([], "page_id long, good int")
    got = host_reputation.judge_urls(pages, outcomes)
    assert {tuple(r)[:5] for r in got.collect()} == {(r[0], *r[2:]) for r in rows}
    assert host_reputation.judge_urls(pages.limit(0), outcomes).count() == 0


def test_bad_hosts_are_blocked_and_small_ones_follow_their_domain(spark):
    pages, outcomes, n = [], [], 0
    for host, good, bad, open_pages in [
        ("spam.bad.com", 1, 60, 3), ("new.bad.com", 0, 0, 2), ("more.bad.com", 2, 40, 1), ("a.fine.com", 50, 2, 2),
        ("b.fine.com", 0, 1, 2), ("c.fine.com", 130, 0, 1), ("other.com", 0, 0, 1),
    ]:
        for good_page in [1] * good + [0] * bad + [None] * open_pages:
            n += 1
            pages.append((n, f"http://{host}/{n}"))
            outcomes.append((n, good_page))
    outcomes += [(None, 0), (1, 7), (99999, 0)]
    got = host_reputation.judge_urls(
        spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good int")
    )
    verdicts = {r.host: r.verdict for r in got.collect()}
    assert {h for h, v in verdicts.items() if v == "block"} == {"spam.bad.com", "new.bad.com", "more.bad.com"}


# --- personal data ---

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_spans(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    return {
        "email": [m.span() for m in _EMAIL.finditer(text)],
        "ip": [m.span() for m in _IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [
            m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 13 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))
        ],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m.group())) <= 15],
    }


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="0123459 .@+-()aBé%_\n", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_very_long_runs_of_zeros():
    text = "at " + "0" * 5000 + "1.2.3.4 and " + ".".join(["0" * 6000] * 4)
    assert [text[a:b].lstrip("0")[:1] for a, b in pii.base_spans(text)["ip"]] in ([], ["1"], ["1", "."])


def test_the_field_learns_its_examples():
    field = pii.train(pii._listed())
    assert all(field.decode(text) == spans for text, spans in pii._listed())


def test_segmentation_is_the_best_one():
    """Decoding equals trying every segmentation."""
    field = pii.train(pii._listed(), rounds=5)

    def best(text):
        pieces, segments = pii.candidates(text)
        score = {(i, j): max(field._score(f)) for i, j, f in segments}

        def go(i):
            if i == len(pieces):
                return 0.0
            return max([go(i + 1)] + [s + go(j) for (a, j), s in score.items() if a == i])

        return go(0)

    rnd = random.Random(9)
    for _ in range(60):
        text = pii.shape("".join(rnd.choice(["12", "345", "6789", ".", "-", " ", "@", "+", "ab", "("]) for _ in range(rnd.randint(1, 9))))
        pieces, segments = pii.candidates(text)
        score = {(pieces[i][0], pieces[j - 1][1], k): field._score(f)[k] for i, j, f in segments for k in range(4)}
        assert sum(score[s] for s in field.decode(text)) == pytest.approx(best(text))


def test_pii_spans(spark, docs):
    rows = [
        (1, "é mail me: First.Last@mail.example.com, or +1 (212) 555-0123!"),
        (2, "card 4111 1111 1111 1111 and 9807915762804490$$$ here"),
        (3, "300.1.1.1 and 10.0.0.255 and 2.0"),
        (4, None), (5, ""), (6, "clean words only"), (7, "x" * 100_000 + " 10.0.0.1"), (7, "10.0.0.1"), (None, "a@b.cd"),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_ip int, spans string")
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.pii_spans(spark, df).collect())
    want = Counter()
    for i, t in rows:
        base = plain_spans(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for k in base for a, b in base[k])
        want[(i, *(len(base[k]) for k in ("email", "ip", "card", "phone")), hashlib.sha256(joined.encode()).hexdigest())] += 1
    assert got == want
    spans = {r.doc_id: r.spans for r in pii.pii_spans(spark, df).where("doc_id < 7").collect()}
    assert spans[2] == "card:5:24,card:29:45" and spans[4] == spans[5] == spans[6] == ""
    assert pii.pii_spans(spark, docs.limit(0)).count() == 0 and pii.pii_spans(spark, docs).count() == len(ROWS)


def test_a_run_of_digits_is_not_cut_in_every_way():
    """The time of a stretch with digits and something behind them does not double with each digit."""

    def took(digits):
        start = time.process_time()
        for _ in range(20):
            pii.candidates("9" * digits + ".9 9.a")
        return time.process_time() - start

    took(10)
    assert took(22) < 50 * took(10) + 0.1
    _, segments = pii.candidates("9" * 60 + " " + "9" * 60 + ".9")
    assert [any(f.startswith("number") for f in found) for _, _, found in segments] == [True, True, False, True, False, True]
    spans = pii.train(pii._listed()).decode("4111111111111111 4111111111111111 a@b.cd")
    assert [pii.KINDS[k] for *_, k in spans] == ["card", "card", "email"]


def test_like_segments_are_scored_once(monkeypatch):
    calls = []
    plain = pii.segment_features
    field = pii.train(pii._listed(), rounds=2)
    monkeypatch.setattr(pii, "segment_features", lambda *a: calls.append(a) or plain(*a))
    field.decode("1234 567 " * 400 + "4111111111111111")
    assert 0 < len(calls) < 500
    for text in ("1234 567 1234 567", "(4111 1111 1111 1111)", "a@b.cd +1 (212) 555-0123 a@b.cd"):
        shaped = pii.shape(text)
        pieces, segments = pii.candidates(shaped)
        for _ in range(2):
            for i, j, found in segments:
                scores = field._score(found)
                assert field._best(shaped, pieces[i][0], pieces[j - 1][1], j - i) == (scores.max(), scores.argmax())


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="12@+.a -\t\n\xa0\u2003\x1c\u200b", max_size=40))
def test_stretches_are_runs_of_words_with_signs(text):
    words = [m.span() for m in re.finditer(r"\S+", text) if re.search("[0-9@+]", m.group())]
    runs = []
    for start, end in words:
        if runs and runs[-1][1] == start - 1 and text[start - 1] == " ":
            runs[-1] = (runs[-1][0], end)
        else:
            runs.append((start, end))
    assert pii.stretches(text) == runs
    assert pii.signed(pa.array([text, None])).to_pylist() == [bool(runs), False]


def test_a_text_is_searched_once_for_its_sample(monkeypatch):
    calls = []
    plain = pii.base_spans
    monkeypatch.setattr(pii, "base_spans", lambda *a: calls.append(a) or plain(*a))
    text = "x 10.0.0.1 a@b.cd x +1 (212) 555-0123 x 4111111111111111 a@b.cd x 10.0.0.1.2 x 10.0.0.1"
    assert pii.sample(text) == [
        ("99.9.9.9 a@a.aa", "0:8:1,9:15:0"), ("+9 (999) 999-9999", "0:17:3"), ("9999999999999999 a@a.aa", "0:16:2,17:23:0"), ("99.9.9.9", "0:8:1"),
    ]
    assert len(calls) == 1


# --- licences ---


def test_licences_and_inheritance(spark):
    rows = [
        ("p/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
        ("p/a.py", "some code"), ("p/q/b.py", "more code"),
        ("p/q/r/LICENSE.txt", "Licensed under the Apache License, Version 2.0"), ("p/q/r/c.py", None), ("p/q/r/s/t/d.py", ""),
        ("p/q/e.py", "some lines of code\nLicensed under CC BY-NC 4.0.\nand some more of it"), ("z/f.py", "no licence here, but a licence is a thing"),
        ("g.py", "top"), (None, "nothing"), ("p/a.py", "some code"),
    ]
    df = spark.createDataFrame([(i, t, p, "x") for i, (p, t) in enumerate(rows)], "doc_id long, text string, path string, license string")
    got = {r.doc_id: (r.license, r.origin, r.license_dir) for r in licenses.license_scan(spark, df, F.col("path")).collect()}
    assert got == {
        0: ("MIT", "header", None), 1: ("MIT", "directory", "p"), 2: ("MIT", "directory", "p"), 3: ("Apache-2.0", "header", None),
        4: ("Apache-2.0", "directory", "p/q/r"), 5: ("Apache-2.0", "directory", "p/q/r"), 6: ("CC-BY-NC-4.0", "header", None),
        7: (None, None, None), 8: (None, None, None), 9: (None, None, None), 10: ("MIT", "directory", "p"),
    }
    assert licenses.license_scan(spark, df.limit(0), F.col("path")).count() == 0


def test_cosine_is_that_of_the_vectors():
    matcher = licenses.Matcher({"": 1000, "the": 900, "license": 20, "licensed": 15, "under": 300, "mit": 5})
    line = "Licensed under the MIT License today"
    name, value = matcher.best(licenses.terms(line))
    weights = {t: c * matcher.idf.get(t, matcher.unseen) for t, c in Counter(licenses.terms(line)).items()}
    best = 0.0
    for licence, text in licenses.TEMPLATES:
        other = {t: c * matcher.idf[t] for t, c in Counter(licenses.terms(text)).items()}
        dot = sum(w * other.get(t, 0) for t, w in weights.items())
        norm = np.sqrt(sum(w * w for w in weights.values()) * sum(w * w for w in other.values()))
        best = max(best, dot / norm)
    assert name == "MIT" and value == pytest.approx(best)


def test_headers_among_other_words_and_full_texts(spark):
    prose = brute.prose(random.Random(3), brute.vocabulary(), 400)
    apache = "Licensed under the Apache License, Version 2.0"
    rows = [
        ("MIT", "Copyright (c) 2020 Foo. Licensed under the MIT License."),
        ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
        ("Apache-2.0", "This file is licensed under the Apache License, Version 2.0; see the file LICENSE for details."),
        ("Apache-2.0", f"{prose} {apache} {prose}"),
        ("Apache-2.0", f"{prose}\n# licensed under the\n# Apache License,\n# Version 2.0\n{prose}"),
        (None, prose),
        *licenses.full_texts(),
    ]
    rows += [(None, brute.prose(random.Random(k), brute.vocabulary(), 100)) for k in range(200)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.license_scan(spark, df, F.lit("d/x.py")).collect() if r.origin == "header"}
    assert got == {i: name for i, (name, _) in enumerate(rows) if name}
    assert len(licenses.full_texts()) >= 8


def test_every_licence_line_of_the_documents_is_found(spark):
    table = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    got = licenses.license_scan(spark, table, licenses.document_path())
    marked = table.where("text RLIKE 'License, Version 2|MIT License|General Public License|CC BY-NC'").select("doc_id")
    found = got.where("origin = 'header'").select("doc_id")
    assert found.exceptAll(marked).count() == 0 and marked.exceptAll(found).count() == 0


# --- mixing ---


@pytest.mark.parametrize("seed", range(4))
def test_apportionment_is_that_of_the_highest_quotients(spark, seed):
    rnd = random.Random(seed)
    cells = [(k // 3, k % 3, float(rnd.choice([0, 1, 5, 40, rnd.randint(1, 5000)]))) for k in range(20)]
    seats = rnd.randint(0, 400)
    heap = [(-t, a, b, 1, t) for a, b, t in cells if t > 0]
    heapq.heapify(heap)
    want = Counter()
    for _ in range(seats if heap else 0):
        _, a, b, k, t = heapq.heappop(heap)
        want[a, b] += 1
        heapq.heappush(heap, (-t / (2 * k + 1), a, b, k + 1, t))
    df = spark.createDataFrame(cells, "rank long, shard long, target double")
    got = {(r["rank"], r["shard"]): r["quota"] for r in mixing.apportion(spark, df, seats, "test").collect()}
    assert got == {(a, b): want[a, b] for a, b, _ in cells}


def plain_targets(sizes):
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    targets, open_ = {}, set(sizes)
    left = 1.5 * sum(sizes.values())
    while open_:
        rate = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if rate * weights[s] >= 2 * sizes[s]}
        if not full:
            return targets | {s: rate * weights[s] for s in open_}
        targets |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return targets


@pytest.mark.parametrize("shard_words", [mixing.SHARD_WORDS, 300])
def test_mixing(spark, docs, monkeypatch, shard_words):
    monkeypatch.setattr(mixing, "SHARD_WORDS", shard_words)
    got = mixing.mix(spark, docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(brute.words_of(t))) for i, t in PAIRS)
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(brute.words_of(r[1]))
    source = {r[0]: r[3] for r in ROWS if r[0] is not None}
    targets, taken = plain_targets(sizes), Counter()
    for r in got:
        where = source.get(r.doc_id, ROWS[[x[0] for x in ROWS].index(None)][3])
        assert r.source_size == sizes[where] and r.target == pytest.approx(targets[where])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[where] += r.taken
    for s, t in targets.items():
        # a shard's quota is within a block of its share, and its last block may be short in each of two rounds
        assert abs(taken[s] - t) <= 3 * mixing.BLOCK_WORDS * (1 + sizes[s] / shard_words)
    again = mixing.mix(spark, docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_the_mix_gives_out_the_words_that_it_takes(spark):
    rnd, words = random.Random(4), brute.vocabulary()
    rows = [(i, brute.prose(rnd, words, rnd.randint(1, 200)), "abc"[i % 3]) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in mixing.mix(spark, df).collect() if r.taken}
    want = {i: Counter() for i, _, _ in rows}
    for r in mixing.mix_blocks(spark, df).collect():
        own = rows[r.doc_id][1].split(" ")
        assert 0 <= r.first_word < r.end_word <= len(own)
        for w in own[r.first_word : r.end_word]:
            want[r.doc_id][w] += r.repeats
    got = {r.doc_id: r for r in mixing.mixed_documents(spark, df).collect()}
    assert {i: r.words_taken for i, r in got.items()} == taken == {i: w.total() for i, w in want.items() if w}
    assert all(Counter(r.text.split()) == want[i] for i, r in got.items())
    assert any(len(r.text.split()) < len(rows[i][1].split(" ")) for i, r in got.items())
    assert any(len(r.text.split()) > len(rows[i][1].split(" ")) for i, r in got.items())


def test_mixing_nothing(spark, docs):
    assert mixing.mix(spark, docs.limit(0)).count() == 0
    rows = mixing.mix(spark, docs.where("text IS NULL")).collect()
    assert rows and all((r["size"], r.target, r.taken) == (0, 0.0, 0) for r in rows)


# --- quality ---


def test_quality_on_held_out_documents(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = quality.quality(spark, table, labels).join(labels, "doc_id").where("held_out AND quality IS NOT NULL")
    counts = {(r.quality, r.predicted): r["count"] for r in got.groupBy("quality", "predicted").count().collect()}
    right = counts.get((0, 0), 0) + counts.get((1, 1), 0)
    assert right / sum(counts.values()) > 0.98
    assert counts.get((0, 0), 0) / (counts.get((0, 0), 0) + counts.get((0, 1), 0)) > 0.95


def test_quality_ignores_what_is_not_text(spark, docs):
    labels = spark.createDataFrame(
        [(i, int(i % 2), None) for i in range(1, 60)] + [(None, 1, 1), (3, None, 0), (160, 5, 0)], "doc_id long, quality int, toxic int"
    )
    one = quality.quality(spark, docs, labels).collect()
    other = quality.quality(spark, docs.withColumn("source", F.lit("z")).withColumn("lang", F.lit(1)), labels).collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, other)) and len(one) == len(ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in one)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in one)
    none = quality.quality(spark, docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    good = quality.quality(spark, docs, labels.where("quality = 1")).collect()
    assert len({r.score for r in good}) == 1 and good[0].score > 0.9
    assert quality.quality(spark, docs.limit(0), labels).count() == 0


def test_scores_are_gaussian_log_densities(spark):
    """The score equals the posterior from densities computed with plain inverses and determinants."""
    table, labels = (spark.read.parquet(f"{MEDIUM}/{n}.parquet") for n in ("documents", "labels"))
    feats = quality.features(table)
    model = quality.fit(feats, labels, shrink=0.2, pool=0.4)
    kinds = {r.doc_id: r.quality for r in labels.collect()}
    import zlib

    rows = {r.doc_id: np.array(r.x) / quality.UNIT for r in feats.collect()}
    train = {c: np.array([rows[i] for i, k in kinds.items() if k == c and i in rows and zlib.crc32(str(i).encode()) % 4 != 2]) for c in (0, 1)}
    n = {c: len(x) for c, x in train.items()}
    cov = {c: np.cov(x.T, bias=True) for c, x in train.items()}
    pooled = sum(n[c] * cov[c] for c in n) / sum(n.values())
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    x = np.array(list(rows.values()))[:50]
    logs = {}
    for c in (0, 1):
        s = (0.8 * (0.6 * cov[c] + 0.4 * pooled) / np.outer(scale, scale)) + 0.2 * np.eye(len(scale))
        d = (x - train[c].mean(axis=0)) / scale
        logs[c] = np.log(n[c] / sum(n.values())) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d)
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    assert model.score(np.rint(x * quality.UNIT)) == pytest.approx(want, abs=1e-6)


# --- decontamination ---


def test_contaminated_documents(spark, docs):
    texts = dict((i, t) for i, t in PAIRS if i is not None)
    words = texts[161].split(" ")
    items = [
        (1, " ".join(words[4000:4030])), (2, " ".join(words[10:16])), (3, "one two"), (4, None), (5, ""), (6, "none of these words"),
        (7, " ".join(words[50:65] + ["changed", "words", "here"])), (8, " ".join(words[200:240]).upper()), (None, texts[161]), (1, " ".join(words[4000:4030])),
    ]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    got = Counter(tuple(r) for r in decontam.contaminated(spark, docs, bench).collect())
    want = brute.leaks(PAIRS, items)
    assert got == Counter(want) and {(161, 1), (162, 1), (166, 3), (167, 3)} <= {w[:2] for w in want}
    assert decontam.contaminated(spark, docs.limit(0), bench).count() == 0
    assert decontam.contaminated(spark, docs, bench.limit(0)).count() == 0
    assert decontam.drop_contaminated(spark, docs, bench).schema == docs.schema


def test_decontamination_runs_no_python(spark):
    from caseflow.llm.queries import QUERIES

    for name in ("op10_decontamination", "op5_url_filter"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# --- pipeline ---


def test_pipeline_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    from caseflow.llm.shared import stored

    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stored(spark, stage(spark, frames[-1], SMALL), "test-stage"))
    rows = [[(r.doc_id, r.text) for r in f.collect()] for f in frames]
    assert all(f.columns == docs.columns for f in frames[:5])

    scored = {r.doc_id: r.score for r in quality.quality(spark, docs, labels).collect()}
    assert sorted(rows[1]) == sorted((i, t) for i, t in rows[0] if scored[i] >= 0.7)
    best = {}
    for i, t in rows[1]:
        best[t.translate(brute.LOWER)] = max(i, best.get(t.translate(brute.LOWER), i))
    assert sorted(rows[2]) == sorted((i, t) for i, t in rows[1] if best[t.translate(brute.LOWER)] == i)
    roots = brute.near(rows[2], 5)[1]
    assert sorted(rows[3]) == sorted((i, t) for i, t in rows[2] if roots[i] == i)
    bad = {x[0] for x in brute.leaks(rows[3], items)}
    assert sorted(rows[4]) == sorted((i, t) for i, t in rows[3] if i not in bad) and bad
    taken = {r.doc_id: r.taken for r in mixing.mix(spark, frames[4]).collect()}
    assert {r.doc_id: r.words_taken for r in frames[5].collect()} == {i: k for i, k in taken.items() if k}
    whole = corpus_pipeline.run(spark, SMALL)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, frames[5].collect()))


def test_stages_on_awkward_documents(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert set(docs.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
        assert out.count() <= len(ROWS)
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_mixed_documents_take_any_column_name(spark):
    """Names that the mix uses inside, a dot and a space among them."""
    names = ["_text", "_id", "_take", "_words", "_mixed", "_row", "a.b", "c d"]
    plain = spark.createDataFrame([(i, f"some words of text {i} " * 9, f"s{i % 3}") for i in range(30)], "doc_id long, text string, source string")
    more = plain.withColumns({n: F.lit(n) for n in names})
    got = mixing.mixed_documents(spark, more)
    assert got.columns == [*more.columns, "words_taken"]
    want = mixing.mixed_documents(spark, plain)
    same = ["doc_id", "text", "source", "words_taken"]
    assert sorted(map(tuple, got.select(*same).collect())) == sorted(map(tuple, want.select(*same).collect()))
    assert {tuple(r) for r in got.select(*[F.col(f"`{n}`") for n in names]).collect()} == {tuple(names)}
