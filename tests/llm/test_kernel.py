"""Whole-slice steps of the text operators against the plain walk over their rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from caseflow.llm import paragraph_dedup, textkernel

FIELDS = ["at", "stop", "begin", "end"]


def walked(span, listed):
    """What of a span lies outside the listed stretches, one after the other."""
    out, at, begin = [], span["at"], span["begin"]
    for o in sorted(listed, key=lambda o: o["at"]):
        if o["stop"] <= at or o["at"] >= span["stop"] or (span["removed"] and not o["removed"]):
            continue
        if o["at"] > at:
            out.append((begin, o["begin"], o["at"] - at))
        at, begin = o["stop"], o["end"]
    if at < span["stop"]:
        out.append((begin, span["end"], span["stop"] - at))
    return out


def some(rng, n):
    at = rng.integers(0, 40, n)
    stop = at + rng.integers(1, 15, n)
    gone = rng.integers(0, 2, n) > 0
    return [dict(zip([*FIELDS, "removed"], r)) for r in zip(at.tolist(), stop.tolist(), (at * 7).tolist(), (stop * 7 - 1).tolist(), gone.tolist())]


class Held:
    """A frame whose one partition holds the given batches."""

    def __init__(self, batches):
        self.batches = batches

    def mapInArrow(self, run, schema):
        return pa.Table.from_batches(run(iter(self.batches)))


def test_a_document_s_paragraphs_are_read_once_for_all_of_its_spans():
    rng = np.random.default_rng(3)
    docs = [(i, some(rng, rng.integers(1, 6)), some(rng, rng.integers(0, 9)) or None) for i in range(400)]
    stretch = [*((f, pa.int64()) for f in FIELDS), ("removed", pa.bool_())]
    listed = pa.list_(pa.struct(stretch))
    own = pa.list_(pa.struct([*stretch, ("component_id", pa.int64()), ("n_copies", pa.int64())]))
    spans = [[s | {"component_id": i * 10 + j, "n_copies": j + 2} for j, s in enumerate(of)] for i, of, _ in docs]
    columns = [pa.array([d[0] for d in docs]), pa.array(spans, own), pa.array([d[2] for d in docs], listed)]
    batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "spans", "listed"])
    got = paragraph_dedup._outside(Held([batch.slice(0, 150), batch.slice(150)])).to_pylist()
    want = [
        (i, *piece, s["component_id"], s["n_copies"], s["removed"])
        for (i, _, known), of in zip(docs, spans)
        for s in of
        for piece in walked(s, known or ())
    ]
    assert sorted(tuple(r.values()) for r in got) == sorted(want)


def test_order_by_row_and_hash_where_high_bits_are_alike():
    rng = np.random.default_rng(4)
    for high, rows in ((1, 40), (5, 40), (5, 1), (1, 1)):
        hashes = (rng.integers(0, high, 500).astype(np.uint64) << np.uint64(60)) | rng.integers(0, 3, 500).astype(np.uint64)
        row = rng.integers(0, rows, 500)
        got, want = textkernel.by_row(hashes, row), np.lexsort((hashes, row))
        assert hashes[got].tolist() == hashes[want].tolist()
        assert row[got].tolist() == row[want].tolist()
    assert not len(textkernel.by_row(hashes[:0], row[:0]))
