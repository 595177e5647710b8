"""What the operators leave on disk."""

from __future__ import annotations

import time
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from caseflow.llm import paragraph_dedup, shared, suffix_dedup


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    found = set()
    while files.hasNext():
        name = files.next().getName()
        if name.startswith("shuffle_") and name.endswith(".data"):
            found.add(name)
    return found


def test_a_stored_table_leaves_no_shuffle(spark):
    before = shuffle_files(spark)
    table = shared.stored(spark, spark.range(10_000).groupBy((F.col("id") % 977).alias("k")).count(), "disk-test")
    until = time.monotonic() + 20
    while shuffle_files(spark) - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert table.count() == 977


def test_tables_of_paragraphs_go_when_they_have_done_their_work(spark):
    work = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(work.iterdir())
    line = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(i, f"{line}\nown{i} " + " ".join(f"w{i}x{j}" for j in range(25))) for i in range(4)], "doc_id bigint, text string")
    found = paragraph_dedup.repeated_paragraphs(spark, docs).collect()
    assert sorted((r.doc_id, r.removed) for r in found) == [(0, False), (1, True), (2, True), (3, True)]
    names = {p.name.rsplit("-", 1)[0] for p in set(work.iterdir()) - before}
    assert "paragraph-listed" in names
    assert not names & {"paragraph-rows", "paragraph-lines", "paragraph-texts", "paragraph-named"}


def test_tables_of_anchors_go_when_they_have_done_their_work(spark):
    work = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(work.iterdir())
    line = " ".join(f"word{i}" for i in range(100))
    docs = spark.createDataFrame([(i, f"own{i} {line} {i}") for i in range(3)] + [(3, "short"), (None, None)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in suffix_dedup.suffix_dedup(spark, docs).collect()}
    assert {i: r.n_removed for i, r in found.items()} == {0: len(line) + 2, 1: len(line) + 2, 2: len(line) + 2, 3: 0, None: 0}
    assert [found[i].repeats for i in (0, 3, None)] == [True, False, False]
    names = {p.name.rsplit("-", 1)[0] for p in set(work.iterdir()) - before}
    assert {"suffix-sizes", "suffix-copies", "suffix-cut"} <= names
    assert not names & {"suffix-features", "suffix-keys", "suffix-found", "suffix-texts", "suffix-spans"}


def test_windows_of_words_travel_as_text():
    text = "  ".join(f"Wort{i % 60}ä\n" for i in range(80))
    symbols = suffix_dedup._Symbols(pa.scalar(text))
    cuts = [(0, 3), (5, 1), (20, 10)]
    sent = [symbols.text(1, first, windows) for first, windows in cuts]
    assert all(s in text.encode() for s in sent)
    assert suffix_dedup._word_symbols(sent) == [symbols.cut(1, first, windows) for first, windows in cuts]
    assert [len(s) for s in suffix_dedup._word_symbols(sent)] == [(w + suffix_dedup.WORDS - 1) * 8 for _, w in cuts]
    assert np.frombuffer(symbols.text(0, 2, 1), np.uint8).size == suffix_dedup.LENGTH
