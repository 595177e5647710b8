"""BPE by dynamic programming against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseflow.llm import bpe, queries
from tests.conftest import SMALL
from tests.llm import brute

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path(queries.TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.vocabulary(PATH)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_query_equals_the_library_on_whole_documents(spark, library):
    got = {tuple(r) for r in queries.QUERIES["op12_bpe"](spark, SMALL).collect()}
    want = set()
    for doc_id, text in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        ids = ids_of(library, text or "")
        back = library.decode(ids, skip_special_tokens=False)
        want.add((doc_id, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), back))))
    assert got == want


def test_awkward_documents(spark, library):
    rows = brute.awkward_documents()
    rows += [(900 + i, t, *[None] * (len(rows[0]) - 2)) for i, t in enumerate(["a<|endoftext|>b", "<|endoftext|>", "x" * 300_000, " " * 70_000 + "y", "<|endo"])]
    docs = spark.createDataFrame(rows, brute.SCHEMA).repartition(4)
    made = bpe.encoded(spark, docs, PATH)
    assert Counter((r.doc_id, tuple(r.ids)) for r in made.collect()) == Counter((r[0], tuple(ids_of(library, r[1] or ""))) for r in rows)
    back = Counter((r.doc_id, r.text) for r in bpe.decoded(spark, made, PATH).collect())
    assert back == Counter((r[0], r[1] or "") for r in rows)


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, ids long")
    assert bpe.encoded(spark, empty, PATH, decode=True).collect() == []
    rows = spark.createDataFrame([(1, None), (2, []), (3, [None, -1, 10**6, 64])], "doc_id long, ids array<int>")
    assert {tuple(r) for r in bpe.decoded(spark, rows, PATH).collect()} == {(1, ""), (2, ""), (3, "a")}


def test_stretches_are_cut_where_no_piece_reaches_over(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 7)
    rnd = random.Random(5)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "bc", " ", "  ", "\n", "'s", "12", "!", "é", "　", "<|endoftext|>"]) for _ in range(60))
        assert own.encode(text).tolist() == ids_of(library, text)


def test_random_tokens_side_by_side(own, library):
    rnd = random.Random(6)
    texts = [t.decode("utf-8", "ignore") for t in own.texts]
    for _ in range(3000):
        text = "".join(rnd.choice(texts) for _ in range(rnd.randint(0, 9))).replace(" ", "")
        assert own.encode(text).tolist() == ids_of(library, text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aeinst 'ghl\n", max_size=200))
def test_any_text(text):
    library = tokenizers.Tokenizer.from_file(PATH) if not hasattr(test_any_text, "library") else test_any_text.library
    test_any_text.library = library
    own = bpe.vocabulary(PATH)
    ids = own.encode(text).tolist()
    assert ids == ids_of(library, text)
    assert own.decode(ids) == text == library.decode(ids, skip_special_tokens=False)


def test_decode_replaces_bytes_that_are_no_text(own, library):
    rnd = random.Random(7)
    for _ in range(500):
        ids = [rnd.randrange(len(own.texts)) for _ in range(5)]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_pair_test_equals_merging_side_by_side(own):
    """Against plain merging: lowest rank first, leftmost of equals."""

    def plain(raw):
        ids = [own_byte[b] for b in raw]
        while True:
            ranked = [(own.ranks[a << 32 | b], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a << 32 | b in own.ranks]
            if not ranked:
                return ids
            rank, i = min(ranked)
            whole = next(t for t, (a, b, r) in made[ids[i], ids[i + 1]] if r == rank)
            ids[i : i + 2] = [whole]

    own_byte = {t[0]: n for n, t in enumerate(own.texts) if len(t) == 1}
    made = {}
    for t, (a, b, r) in own.halves.items():
        made.setdefault((a, b), []).append((t, (a, b, r)))
    rnd = random.Random(8)
    for _ in range(2000):
        a, b = rnd.randrange(50_000), rnd.randrange(50_000)
        assert (not own.meets(a, b)) == (plain(own.texts[a] + own.texts[b]) == [a, b])
