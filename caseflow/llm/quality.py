"""Document quality by regularised quadratic discriminant analysis over text statistics.

Every text becomes a vector of transformed counts. The labelled vectors give one mean and one
covariance for each class; each covariance is shrunk towards the pooled one and towards a sphere,
and its Cholesky factor is kept. A document's score is the posterior of class 1 from the difference
of the two log densities, whose quadratic part is a squared Mahalanobis distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.shared import documents, narrowed, stored
from caseflow.llm.textkernel import RangeHash, distinct_sets, lower_ascii, shingles, slices, words

FEATURES = (
    "words, word length, its spread, capitals, symbols, punctuation, digits, non-ASCII letters, line breaks, "
    "repeated words, repeated word triples, repeated lines, words that end in a symbol, capitalised words, "
    "words without letters, words said twice in a row"
).split(", ")
THRESHOLD = 0.7
UNIT = 2048
_LETTER, _UPPER, _DIGIT, _BREAK, _SPACE, _POINT, _SYMBOL, _LEAD, _INNER = range(9)
_KIND = np.full(256, _SYMBOL, np.uint8)
_KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[ord("A") : ord("Z") + 1] = _UPPER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = _SPACE
_KIND[0x0A] = _BREAK
_KIND[list(b".,;:'\"-?()")] = _POINT
_KIND[0x80:0xC0] = _INNER
_KIND[0xC0:] = _LEAD


def _slice_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    kinds = _KIND[data]
    of_byte = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(of_byte * 9 + kinds, minlength=9 * n).reshape(n, 9).astype(float)
    chars = np.maximum(1, counts.sum(axis=1) - counts[:, _INNER])

    start, end, row = words(data, offsets)
    total = np.bincount(row, minlength=n)
    some = np.maximum(1, total)
    length = (end - start).astype(float)
    mean = np.bincount(row, length, minlength=n) / some
    spread = np.sqrt(np.maximum(0, np.bincount(row, length**2, minlength=n) / some - mean**2))
    lower = lower_ascii(data)
    ranges = RangeHash(lower)
    word_hash = ranges.of(start, end)
    own = np.array([len(s) for s in distinct_sets(word_hash, row, n)])
    twice = np.zeros(len(row), bool)
    twice[1:] = (word_hash[1:] == word_hash[:-1]) & (row[1:] == row[:-1])
    triple, of_triple = shingles(word_hash, row, 3)
    triples = np.bincount(of_triple, minlength=n)
    own_triples = np.array([len(s) for s in distinct_sets(triple, of_triple, n)])

    cut = np.union1d(np.flatnonzero(data == 0x0A) + 1, offsets[:-1])
    cut = cut[cut < len(data)]
    stop = np.append(cut[1:], len(data))
    of_line = np.searchsorted(offsets, cut, "right") - 1
    lines = np.bincount(of_line, minlength=n)
    own_lines = np.array([len(s) for s in distinct_sets(ranges.of(cut, stop), of_line, n)])

    letters = np.concatenate([[0], np.cumsum((kinds == _LETTER) | (kinds == _UPPER) | (kinds == _LEAD))])
    part = lambda mask: np.sqrt(np.bincount(row, mask, minlength=n) / some)
    share = lambda kind: np.sqrt(counts[:, kind] / chars)
    columns = [
        np.log1p(total),
        np.log1p(mean),
        np.log1p(spread),
        share(_UPPER),
        share(_SYMBOL),
        share(_POINT),
        share(_DIGIT),
        share(_LEAD),
        share(_BREAK),
        np.log((1 + own) / (1 + total)),
        np.sqrt(1 - own_triples / np.maximum(1, triples)) * (triples > 0),
        np.sqrt(1 - own_lines / np.maximum(1, lines)) * (lines > 0),
        part(kinds[end - 1] == _SYMBOL) if len(end) else np.zeros(n),
        part(kinds[start] == _UPPER) if len(end) else np.zeros(n),
        part(letters[end] == letters[start]),
        part(twice),
    ]
    return np.rint(np.stack(columns, axis=1) * UNIT).astype(np.int64)


def vectors(texts: pa.Array) -> np.ndarray:
    """One row of statistics for each text, in whole units of 1/2048 so that sums are exact."""
    made = [_slice_features(data, offsets) for _, _, data, offsets in slices(texts)]
    return np.concatenate(made) if made else np.zeros((0, len(FEATURES)), np.int64)


@dataclass
class Model:
    """Class means, inverse Cholesky factors and log priors; None where a class had no rows."""

    scale: np.ndarray
    classes: list[tuple[np.ndarray, np.ndarray, float]] | None
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.prior)
        x = x / UNIT / self.scale
        logs = []
        for mean, inverse, constant in self.classes:
            logs.append(constant - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""

    def run(batches):
        for batch in batches:
            x = vectors(batch.column(1))
            bounds = pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(bounds, pa.array(x.ravel(), pa.int64()))], ["doc_id", "x"]
            )

    return documents(docs).mapInArrow(run, "doc_id bigint, x array<bigint>")


def fit(feats: DataFrame, labels: DataFrame, shrink: float = 0.1, pool: float = 0.3) -> Model:
    """Fit from all labelled rows that are not held out.

    The driver gets the sums of each class, a few hundred numbers whatever the number of rows.
    Labels other than 0 and 1, and null labels or ids, count for nothing.
    """
    d = len(FEATURES)
    upper = np.triu_indices(d)
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = feats.where(~held_out()).join(marked.where("quality IN (0, 1)").distinct(), "doc_id").select("quality", "x")

    def run(batches):
        sums = np.zeros((2, 1 + d + len(upper[0])), np.int64)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            kind = batch.column("quality").to_numpy()
            for c in (0, 1):
                own = x[kind == c]
                sums[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own)[upper]])
        c, at = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (c, at, sums)], ["quality", "at", "total"])

    sums = np.zeros((2, 1 + d + len(upper[0])))
    partial = rows.mapInArrow(run, "quality bigint, at bigint, total bigint")
    for c, at, total in partial.groupBy("quality", "at").agg(F.sum("total")).collect():
        sums[c, at] = total
    n = sums[:, 0]
    if not n.all():
        return Model(np.ones(d), None, float((n[1] + 1) / (n.sum() + 2)))
    means, spreads = [], []
    for c in (0, 1):
        square = np.zeros((d, d))
        square[upper] = sums[c, 1 + d :]
        square = (square + np.triu(square, 1).T) / n[c] / UNIT**2
        mean = sums[c, 1 : 1 + d] / n[c] / UNIT
        means.append(mean)
        spreads.append(square - np.outer(mean, mean))
    pooled = (n[0] * spreads[0] + n[1] * spreads[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    classes = []
    for c in (0, 1):
        own, both = spreads[c] / np.outer(scale, scale), pooled / np.outer(scale, scale)
        cov = (1 - shrink) * ((1 - pool) * own + pool * both) + shrink * np.eye(d)
        factor = np.linalg.cholesky(cov)
        constant = float(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
        classes.append((means[c] / scale, np.linalg.inv(factor), constant))
    return Model(scale, classes, float(n[1] / n.sum()))


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.7 on).

    The score depends on the text alone; null text counts as empty and gets a score like any other.
    Without training rows of both classes every score is the smoothed share of label 1, 0.5 without
    any. Repeated rows are scored each; a null doc_id is scored and trains nothing. An empty table
    gives no rows. Columns besides doc_id and text, and quality of the labels, are ignored.
    """
    feats = stored(spark, features(docs), "quality-features")
    model = fit(feats, labels)

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(score, pa.float64()),
                    pa.array((score >= THRESHOLD).astype(np.int32), pa.int32()),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = feats.select("doc_id", held_out().alias("held_out"), "x")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score at least 0.7, all columns as they were; texts are not shuffled.

    The model comes from one pass over the labelled documents, or over all where the labels are too many
    to send round; the texts are then scored where they lie.
    """
    ids = labels.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    model = fit(features(narrowed(documents(docs), ids, "doc_id")), labels)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.score(vectors(batch.column(at))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
