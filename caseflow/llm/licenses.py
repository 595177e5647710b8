"""Licence scan: TF-IDF cosine of lines, word windows and whole texts to templates, then inheritance down the directories.

A line's vector holds the terms of the templates, weighted by how rare they are in the corpus; all
its other terms count towards its length with the weight of a term seen once. Windows of as many terms
as a template has are scored likewise over the whole text, whatever the line breaks. A document that is
close as a whole to a full licence text, or whose best line or window is close enough to a template, has
that licence by its own header. A document that has none
takes the licence of the nearest directory above it that holds a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.shared import stored

# Short headers under which the licences are commonly declared.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; version 2.1"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
TEXTS = Path(__file__).resolve().parent / "license_texts"
COSINE = 0.7
FILE_SHARE = 0.5
_TERM = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([.-][^/]*)?$"


def terms(line: str) -> list[str]:
    return _TERM.findall(line.lower())


def full_texts() -> tuple[tuple[str, str], ...]:
    """The full licence texts, read on the driver."""
    return tuple((p.stem, p.read_text()) for p in sorted(TEXTS.glob("*.txt")))


def _vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({t for _, text in templates for t in terms(text)})


def _document_frequency(docs: DataFrame) -> dict[str, int]:
    """How many documents hold each template term; the driver gets one number for each term."""
    vocabulary = frozenset(_vocabulary(TEMPLATES + full_texts()))

    def run(batches):
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(vocabulary.intersection(terms(text)) if text else ())
                seen[""] += 1
        yield pa.RecordBatch.from_pydict({"term": list(seen), "n": list(seen.values())}, pa.schema([("term", pa.string()), ("n", pa.int64())]))

    counts = docs.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n"))
    return dict(counts.collect())


class Matcher:
    """The templates' vectors under given document frequencies."""

    def __init__(self, frequency: dict[str, int], templates=TEMPLATES):
        n = frequency.get("", 0)
        self.unseen = math.log(1 + n)
        self.idf = {t: math.log((1 + n) / (1 + frequency.get(t, 0))) + 1e-9 for t in _vocabulary(templates)}
        self.vectors = []
        for name, text in templates:
            counts = Counter(terms(text))
            weights = {t: c * self.idf[t] for t, c in counts.items()}
            self.vectors.append((name, weights, math.sqrt(sum(w * w for w in weights.values()))))
        # a line that is close to a template shares at least one of its heavier terms
        self.heavy = frozenset(
            t for _, w, length in self.vectors for t, x in w.items() if x * math.sqrt(len(w)) >= COSINE * length
        )

        self.sizes = [len(terms(text)) for _, text in templates]
        self.number = {t: k for k, t in enumerate(self.idf)}
        # by term, the last column is every other term: its weight, and what one adds to the dot product
        self.weight = np.array([*self.idf.values(), self.unseen])
        self.gain = np.array([[w.get(t, 0.0) * x for t, x in self.idf.items()] + [0.0] for _, w, _ in self.vectors])

    def windows(self, found: list[str], cosine: float) -> tuple[tuple[str | None, float], np.ndarray]:
        """The best window of a template's length, and which terms lie in windows of that cosine or more, no two overlapping.

        A window's length is at least that of its terms taken one by one, which bounds its cosine from above.
        """
        other = len(self.number)
        ids = np.array([self.number.get(t, other) for t in found], np.int64)
        squares = np.append(0, np.cumsum(self.weight[ids] ** 2))
        near = []
        for k, (name, weights, size) in enumerate(self.vectors):
            n = self.sizes[k]
            if n > len(found):
                continue
            dots = np.append(0, np.cumsum(self.gain[k][ids]))
            dots, least = dots[n:] - dots[:-n], squares[n:] - squares[:-n]
            for a in np.flatnonzero(dots >= (cosine - 1e-9) * np.sqrt(least) * size):
                length = math.sqrt(sum((c * self.idf.get(t, self.unseen)) ** 2 for t, c in Counter(found[a : a + n]).items()))
                value = float(dots[a]) / length / size
                if value >= cosine:
                    near.append((-round(value, 9), k, int(a), n, name, value))
        hit = np.zeros(len(found), bool)
        near.sort()
        for _, _, a, n, _, _ in near:  # of windows that overlap, the closest counts
            if not hit[a : a + n].any():
                hit[a : a + n] = True
        return (near[0][4:] if near else (None, 0.0)), hit

    def best(self, found: list[str]) -> tuple[str | None, float]:
        """The closest template's licence and the cosine; ties go to the first template."""
        counts = Counter(found)
        mine = {t: c * self.idf[t] for t, c in counts.items() if t in self.idf}
        other = sum((c * self.unseen) ** 2 for t, c in counts.items() if t not in self.idf)
        length = math.sqrt(sum(w * w for w in mine.values()) + other)
        top: tuple[str | None, float] = (None, 0.0)
        for name, weights, size in self.vectors:
            dot = sum(w * weights[t] for t, w in mine.items() if t in weights)
            if dot and dot / length / size > top[1] + 1e-12:
                top = (name, dot / length / size)
        return top


def headers(docs: DataFrame, cosine: float) -> DataFrame:
    """(doc_id, path, own_license, cosine, license_words, n_words) from each document's closest line, window or full text."""
    frequency = _document_frequency(docs)
    matcher, whole = Matcher(frequency), Matcher(frequency, full_texts())

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                best, every, hits = (None, 0.0), [], []
                for line in (text or "").split("\n"):
                    found = terms(line)
                    every += found
                    hits.append((len(found), False))
                    if not matcher.heavy.isdisjoint(found):
                        name, value = matcher.best(found)
                        if value >= cosine:
                            hits[-1] = len(found), True
                            if value > best[1]:
                                best = name, value
                words = hit_words = len(every)
                if matcher.heavy.isdisjoint(every):
                    hit_words = 0
                else:
                    top, hit = matcher.windows(every, cosine)
                    hit |= np.repeat([h for _, h in hits], [n for n, _ in hits])
                    hit_words = int(hit.sum())
                    if top[1] > best[1] + 1e-12:
                        best = top
                if not whole.heavy.isdisjoint(every):
                    name, value = whole.best(every)
                    if value >= cosine:
                        best, hit_words = (name, value), words
                out.append((*best, hit_words, words))
            names, values, hits, totals = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("path"),
                    pa.array(names, pa.string()),
                    pa.array(values, pa.float64()),
                    pa.array(hits, pa.int64()),
                    pa.array(totals, pa.int64()),
                ],
                ["doc_id", "path", "own_license", "cosine", "license_words", "n_words"],
            )

    schema = "doc_id bigint, path string, own_license string, cosine double, license_words bigint, n_words bigint"
    return docs.mapInArrow(run, schema)


def license_scan(spark: SparkSession, docs: DataFrame, path: Column, cosine: float = COSINE) -> DataFrame:
    """One row per document: doc_id, path, license, cosine, origin (header, directory or null), license_dir.

    ``path`` is the file's path with ``/`` between directories. A licence file is one with a usual name
    (LICENSE, COPYING, ...) or one where licence lines and windows hold at least half of the words, or that is close to a full licence text; a directory that
    holds several takes the licence that most of them name, then the first by name. The nearest directory
    above a file wins, the file's own first. Null or empty texts have no header; a null path inherits
    nothing. Repeated rows are scanned each. An empty table gives no rows. Columns besides doc_id, text and
    those that ``path`` uses are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), path.alias("path"), F.col("text").cast("string").alias("text")
    )
    found = stored(spark, headers(rows, cosine), "license-headers")
    is_file = F.col("path").rlike(FILE_NAME) | (F.col("license_words") >= F.lit(FILE_SHARE) * F.col("n_words"))
    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    votes = found.where(F.col("own_license").isNotNull() & F.col("path").isNotNull() & is_file)
    votes = votes.groupBy(directory.alias("dir"), "own_license").agg(F.count("*").alias("n"))
    named = votes.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "own_license")).alias("top"))
    named = stored(spark, named.select("dir", F.col("top.own_license").alias("dir_license")), "license-dirs")

    # every directory that some file lies in finds its nearest named ancestor; files then look theirs up
    open_rows = found.where("own_license IS NULL AND path IS NOT NULL").withColumn("file_dir", directory)
    dirs = open_rows.select("file_dir").distinct()
    parts = F.split("file_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    nearest = (
        dirs.select("file_dir", F.posexplode(above).alias("depth", "dir"))
        .join(named, "dir")
        .groupBy("file_dir")
        .agg(F.max(F.struct("depth", "dir", "dir_license")).alias("near"))
    )
    inherited = found.withColumn("file_dir", F.when(F.col("own_license").isNull(), directory)).join(nearest, "file_dir", "left")
    return inherited.select(
        "doc_id",
        "path",
        F.coalesce("own_license", "near.dir_license").alias("license"),
        F.when(F.col("own_license").isNotNull(), F.col("cosine")).alias("cosine"),
        F.when(F.col("own_license").isNotNull(), "header").when(F.col("near").isNotNull(), "directory").alias("origin"),
        F.col("near.dir").alias("license_dir"),
    )


def document_path() -> Column:
    """The documents have no paths: their source, language and id stand for two directories and a file."""
    return F.concat_ws(
        "/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string")
    )
