"""The dedup operators against plain Python on awkward documents."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caseflow.llm import exact_dedup, grouping, near_dedup, paragraph_dedup, suffix_dedup
from tests.llm import brute

ROWS = brute.awkward_documents()
PAIRS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, brute.SCHEMA).repartition(5)


def counted(df, *names):
    return Counter(tuple(r) for r in df.select(*names).collect())


def test_near_dedup_equals_brute_force(spark, docs):
    got = counted(near_dedup.near_dedup(spark, docs), "doc_id", "n_shingles", "component_id", "kept")
    sets, roots = brute.near(PAIRS, 4)
    want = Counter(
        (i, len(brute.shingle_set(t, 4)), None, True) if i is None else (i, len(sets[i]), roots[i], roots[i] == i)
        for i, t in PAIRS
    )
    assert got == want
    assert max(Counter(roots.values()).values()) > 10


def test_near_dedup_needs_the_second_round(spark):
    """Members that are near each other but not near the first member of their bucket are still found."""
    rnd, words = random.Random(11), brute.vocabulary()
    base = brute.prose(rnd, words, 300).split(" ")
    rows = []
    for i in range(80):
        own = list(base)
        for at in rnd.sample(range(300), rnd.choice([0, 4, 8, 12, 14, 16])):
            own[at] = f"w{rnd.randrange(40)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark, df).collect()}
    assert got == brute.near(rows, 4)[1]


def test_exact_dedup_equals_brute_force(spark, docs):
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    digests = [(i, hashlib.sha256((t or "").translate(brute.LOWER).encode()).hexdigest()) for i, t in PAIRS]
    groups = {}
    for i, h in digests:
        groups.setdefault(h, []).append(i)
    want = Counter()
    for i, h in digests:
        keep = max((x for x in groups[h] if x is not None), default=None)
        want[(i, keep, len(groups[h]), i == keep, h)] += 1
    for history in (exact_dedup.earlier_half(), F.lit(True), F.lit(False), F.lit(None).cast("boolean")):
        assert counted(exact_dedup.exact_dedup(spark, docs, history), *names) == want


def test_perfect_hash_is_minimal_and_checks_bytes():
    import numpy as np

    rnd = np.random.default_rng(4)
    keys = rnd.integers(0, 2**63, (5000, 4), dtype=np.uint64)
    sizes, bits = exact_dedup.build(keys)
    at = exact_dedup.slots(keys, sizes, bits)
    assert sorted(at) == list(range(5000))
    others = exact_dedup.slots(rnd.integers(0, 2**63, (1000, 4), dtype=np.uint64), sizes, bits)
    assert others.max() < 5000  # some slot or none; the digest in the slot tells
    assert exact_dedup.build(keys[:0])[0] == []


def test_suffix_array_equals_sorting():
    rnd = random.Random(8)
    for _ in range(2000):
        text = [rnd.randint(1, rnd.choice([1, 2, 3, 6])) for _ in range(rnd.randint(0, 40))] + [0]
        assert grouping.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("most", [suffix_dedup.MOST, 1])
def test_suffix_dedup_equals_brute_force(spark, docs, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    got = counted(suffix_dedup.suffix_dedup(spark, docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = Counter(brute.suffix(PAIRS))
    assert got == want
    assert sum(0 < r[2] < r[1] for r in want) > 5


@pytest.mark.parametrize("most", [suffix_dedup.MOST, 1])
def test_suffix_dedup_reports_runs_of_over_50_words(spark, monkeypatch, most):
    """Passages of 45 to 70 words, short words or long ones, in other prose, twice in one text, over line breaks."""
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    rnd, words = random.Random(12), brute.vocabulary()
    rows = list(PAIRS)
    for n in range(45, 71):
        passage = brute.prose(rnd, words if n % 2 else list("abcdefghi"), n)
        for k in range(2):
            broken = passage.replace(" ", "\n ", k * 5)
            rows.append((1000 + 2 * n + k, f"{brute.prose(rnd, words, rnd.randint(0, 60))} {broken} {brute.prose(rnd, words, 20)}"))
    twice = brute.prose(rnd, words, 60)
    rows += [(2000, f"{twice} between {twice}"), (2001, "x" * 300 + " y " * 60), (2002, "q " + "x" * 300 + " y " * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    made = suffix_dedup.suffix_dedup(spark, docs).cache()
    got = counted(made, "doc_id", "n_repeated_words", "n_repeated_runs")
    assert got == Counter(brute.spoken(rows))
    assert counted(made, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute.suffix(rows))
    assert made.where("repeats <> (n_repeated_words > 0)").count() == 0
    assert made.where("repeats AND n_removed = 0").count() > 5


def test_paragraphs_equal_brute_force(spark):
    """Lines of 20 to 48 words, so that each is one paragraph."""
    rnd, words = random.Random(2), brute.vocabulary()
    lines = [brute.prose(rnd, words, rnd.randint(12, 48)) for _ in range(60)]
    rows = []
    for i in range(40):
        own = [rnd.choice(lines).split(" ") for _ in range(4)]
        for line in own:
            if rnd.random() < 0.3:
                line[rnd.randrange(len(line))] = f"new{rnd.randrange(99)}"
        rows.append((i, "\n".join(" ".join(x) for x in own)))
    rows += [(50, None), (51, ""), (52, "\n\n"), (None, lines[0])]
    units = {}
    for i, t in rows:
        at = 0
        for line in (t or "").split("\n"):
            if i is not None and len(line.split(" ")) >= 20:
                units[(i, at)] = brute.shingle_set(line, 5)
            at += len(line.encode()) + 1
    ids = sorted(units)
    roots = brute.components(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if brute.similar(units[a], units[b])])
    sizes = Counter(roots.values())
    want = {(i, at, roots[i, at][0], sizes[roots[i, at]], roots[i, at] != (i, at)) for i, at in ids if sizes[roots[i, at]] > 1}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = paragraph_dedup.repeated_paragraphs(spark, df)
    got = {(r.doc_id, r.begin, r.component_id, r.n_copies, r.removed) for r in found.collect()}
    assert got == want
    cleaned = {r.doc_id: r.text for r in paragraph_dedup.remove_paragraphs(df, found).collect()}
    gone = {(r.doc_id, r.begin, r.end) for r in found.where("removed").collect()}
    for i, t in rows:
        if i is not None:
            raw = (t or "").encode()
            left = bytes(c for k, c in enumerate(raw) if not any(d == i and a <= k < b for d, a, b in gone))
            assert cleaned[i] == left.decode()


def test_a_passage_inside_long_lines_is_found(spark):
    rnd, words = random.Random(6), brute.vocabulary()
    passage = brute.prose(rnd, words, 70)
    rows = [(i, f"{brute.prose(rnd, words, 40 + i)} {passage} {brute.prose(rnd, words, 60)}") for i in range(12)]
    rows += [(100 + i, brute.prose(rnd, words, 150)) for i in range(12)]
    found = paragraph_dedup.repeated_paragraphs(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in found.collect()} == set(range(12))


def covered(spark, rows, parts):
    """The word numbers of each document that the removed rows take, and those of all rows."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    found = paragraph_dedup.repeated_paragraphs(spark, df)
    spans = found.collect()
    raw = {i: t.encode() for i, t in rows}
    out = []
    for wanted in ([r for r in spans if r.removed], spans):
        taken = {i: set() for i, _ in rows}
        for r in wanted:
            before = len(raw[r.doc_id][: r.begin].split())
            inside = len(raw[r.doc_id][r.begin : r.end].split())
            assert inside == r.n_words
            taken[r.doc_id].update(range(before, before + inside))
        out.append(taken)
    cleaned = {r.doc_id: r.text for r in paragraph_dedup.remove_paragraphs(df, found).collect()}
    for i, t in rows:
        words = t.split()
        assert cleaned[i].split() == [w for k, w in enumerate(words) if k not in out[0][i]]
    return out


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_every_word_of_a_passage_in_long_lines_is_found(spark, parts):
    """Passages of 51 to 60 words inside lines that differ, 30 seeds for each length."""
    words = brute.vocabulary()
    rows, want = [], {}
    for seed in range(300):
        rnd = random.Random(seed)
        n = 51 + seed % 10
        passage, heads = brute.prose(rnd, words, n), [rnd.randint(40, 90) for _ in range(2)]
        for k, head in enumerate(heads):
            rows.append((2 * seed + k, f"{brute.prose(rnd, words, head)} a{seed}k{k} {passage} b{seed}k{k} {brute.prose(rnd, words, 70)}"))
            want[2 * seed + k] = set(range(head + 1, head + 1 + n))
    removed, listed = covered(spark, rows, parts)
    for i, w in want.items():  # a piece at its edge is linked at a similarity of 0.8, so a few words beyond it may go too
        assert w <= listed[i] and len(listed[i] - w) <= 12
        assert w <= removed[i] if i % 2 else not removed[i]


def wrapped(text, n):
    words = text.split(" ")
    return "\n".join(" ".join(words[k : k + n]) for k in range(0, len(words), n))


def test_text_wrapped_at_12_words_is_found(spark):
    """Passages of 55 words in wrapped texts, and blocks of 45 words between blank lines, wrapped in two ways."""
    words = brute.vocabulary()
    rows, want = [], {}
    for seed in range(60):
        rnd = random.Random(seed)
        own = brute.prose(rnd, words, 55 if seed % 2 else 45)
        for k in range(2):
            i, head, tail = 2 * seed + k, rnd.randint(30, 80), brute.prose(rnd, words, 60)
            before = brute.prose(rnd, words, head)
            if seed % 2:
                text = wrapped(f"{before} {own} {tail}", 12)
            else:
                text = "\n\n".join(wrapped(x, 12 - k) for x in (before, own, tail))
            rows.append((i, text))
            want[i] = set(range(head, head + len(own.split(" "))))
    removed, listed = covered(spark, rows, 3)
    for i, w in want.items():
        assert w <= listed[i] and len(listed[i] - w) <= 12
        assert w <= removed[i] if i % 2 else not removed[i]


def test_copies_of_long_lines_go_whole(spark):
    """An exact copy, and copies with one to three of 200 words changed, whose similarity is still over 0.8."""
    words = brute.vocabulary()
    rows = []
    for seed in range(40):
        rnd = random.Random(seed)
        line = brute.prose(rnd, words, 200).split(" ")
        rows.append((2 * seed, " ".join(line)))
        for _ in range(seed % 4):
            line[rnd.randrange(200)] = f"new{seed}"
        rows.append((2 * seed + 1, " ".join(line)))
    removed, listed = covered(spark, rows, 4)
    assert removed == {i: set(range(200)) if i % 2 else set() for i, _ in rows}
    assert listed == {i: set(range(200)) for i, _ in rows}


def test_passages_equal_brute_force(spark):
    """All words of repeated runs of 51 words, across lines too; every line differs by far."""
    rnd, words = random.Random(8), brute.vocabulary()
    passages = [brute.prose(rnd, words, rnd.randint(45, 130)) for _ in range(8)]
    rows = []
    for i in range(40):
        parts = [brute.prose(rnd, words, rnd.randint(90, 200))]
        for p in rnd.sample(passages, 2):
            own, a = p.split(" "), rnd.randint(0, 20)
            parts += [" ".join(own[a : a + rnd.randint(45, 130)]), brute.prose(rnd, words, rnd.randint(90, 200))]
        rows.append((i, " ".join(parts)))
    rows.append((50, "the " * 300))
    runs = Counter()
    for _, t in rows:
        w = brute.words_of(t)
        runs.update(tuple(w[k : k + 51]) for k in range(len(w) - 50))
    want = {}
    for i, t in rows:
        w = brute.words_of(t)
        want[i] = {k + j for k in range(len(w) - 50) if runs[tuple(w[k : k + 51])] > 1 for j in range(51)}
    removed, listed = covered(spark, rows, 5)
    assert all(want[i] <= listed[i] for i in want)
    left = Counter()
    for i, t in rows:
        w = brute.words_of(t)
        left.update({tuple(w[k : k + 51]) for k in range(len(w) - 50) if not removed[i] & set(range(k, k + 51))})
    # what stays is there once; nothing is lost, each run's words stay somewhere
    assert max(left.values()) == 1
    assert removed[50] == set(range(51, 300))


def test_awkward_documents_have_paragraphs(spark, docs):
    found = paragraph_dedup.repeated_paragraphs(spark, docs).collect()
    assert {140, 149, 151} <= {r.doc_id for r in found}
    assert not {163, 164, 165, 166, 168} & {r.doc_id for r in found}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], brute.SCHEMA)
    assert near_dedup.near_dedup(spark, empty).count() == 0
    assert exact_dedup.exact_dedup(spark, empty, exact_dedup.earlier_half()).count() == 0
    assert suffix_dedup.suffix_dedup(spark, empty).count() == 0
    assert paragraph_dedup.repeated_paragraphs(spark, empty).count() == 0


def test_filters_keep_every_column(spark, docs):
    near = near_dedup.keep_first(spark, docs)
    exact = exact_dedup.drop_exact(spark, docs)
    assert near.schema == docs.schema and exact.schema == docs.schema
    _, roots = brute.near(PAIRS, 5)
    assert sorted(r.doc_id for r in near.collect() if r.doc_id is not None) == sorted(
        i for i, _ in PAIRS if i is not None and roots[i] == i
    )
