"""Exact byte-level BPE by dynamic programming over prefixes.

Merging pair after pair is quadratic on a long piece. Here every prefix of a piece stores one token:
the last one of that prefix's encoding, which is unique. A suffix automaton of the vocabulary reads the piece
once and names, at each byte, the tokens that end there; a candidate is the right one if it starts
the piece, or if the token stored for the prefix before it and the candidate stay apart when both
are merged side by side. The stored tokens are the back-pointers: reading them from the end gives
the ids.

Whether two tokens stay apart is told from their merge trees. While nothing crosses the seam, each side
is merged as it would be alone, so the tokens that ever touch the seam are the left one's right edge and
the right one's left edge. A pair of them merges if its rank comes before either of the two is merged
away; of equal ranks the leftmost goes first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from caseflow.llm.shared import documents

# The pieces a byte-level tokenizer cuts a text into before merging. Fixed value.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# No piece reaches over a space that follows something else than white space.
SEAM = regex.compile(r"(?<=\S) ")
STRETCH = 1 << 20
NEVER = 1 << 30
# Pieces and pairs that a task remembers; beyond that it forgets all and goes on.
MEMO = 1 << 19
LONG_PIECE = 64


def stand_ins() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file: itself where it is printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def automaton(tokens: dict[int, bytes]) -> dict[str, object]:
    """The suffix automaton of several strings, as one table of steps and a list for each property of a state.

    A state stands for substrings that end at the same places; a token is the longest of its state.
    ``above`` is the nearest state on the way of suffix links whose longest string is a token.
    """
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def state(size: int, towards: dict[int, int], up: int) -> int:
        step.append(towards)
        link.append(up)
        length.append(size)
        return len(step) - 1

    def split(p: int, byte: int, q: int) -> int:
        copy = state(length[p] + 1, dict(step[q]), link[q])
        link[q] = copy
        while p >= 0 and step[p].get(byte) == q:
            step[p][byte] = copy
            p = link[p]
        return copy

    for text in tokens.values():
        last = 0
        for byte in text:
            q = step[last].get(byte)
            if q is not None:  # the string so far is a substring of an earlier one
                last = q if length[q] == length[last] + 1 else split(last, byte, q)
                continue
            new, p = state(length[last] + 1, {}, 0), last
            while p >= 0 and byte not in step[p]:
                step[p][byte] = new
                p = link[p]
            if p >= 0:
                q = step[p][byte]
                link[new] = q if length[q] == length[p] + 1 else split(p, byte, q)
            last = new
    token = [-1] * len(step)
    for number, text in tokens.items():
        at = 0
        for byte in text:
            at = step[at][byte]
        token[at] = number
    above = [0] * len(step)
    for s in sorted(range(1, len(step)), key=length.__getitem__):
        up = link[s]
        above[s] = up if token[up] >= 0 else above[up]
    goto = {s << 8 | byte: q for s, towards in enumerate(step) for byte, q in towards.items()}
    return {"goto": goto, "link": link, "length": length, "token": token, "above": above}


@dataclass
class Vocabulary:
    """What a task needs of a vocabulary file; its size is bounded by that file."""

    texts: list[bytes]
    special: dict[str, int]
    halves: dict[int, tuple[int, int, int]]
    ranks: dict[int, int]
    parts: dict[str, object]
    edges: tuple[dict[int, list], dict[int, list]] = field(default_factory=lambda: ({}, {}))
    pairs: dict[int, bool] = field(default_factory=dict)
    pieces: dict[str, tuple[int, ...]] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        held = json.loads(Path(path).read_text(encoding="utf-8"))
        model, split = held["model"], held.get("pre_tokenizer") or {}
        ordinary = model["type"] == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        if not ordinary or held.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE without a normalizer is offered")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in held["added_tokens"]):
            raise ValueError("added tokens that take their neighbours along are not offered")
        byte, ids = stand_ins(), model["vocab"]
        special = {t["content"]: t["id"] for t in held["added_tokens"]}
        texts = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for name, number in ids.items():
            texts[number] = bytes(map(byte.__getitem__, name))
        for name, number in special.items():
            texts[number] = name.encode()
        halves, ranks = {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made = ids[a + b]
            if made in halves:
                raise ValueError("a token with two merges has no single tree")
            halves[made] = ids[a], ids[b], rank
            ranks[ids[a] << 32 | ids[b]] = rank
        out = cls(texts, special, halves, ranks, {})
        own = {n: texts[n] for n in ids.values() if len(texts[n]) == 1 or n in halves and out.reachable(n)}
        out.parts = automaton(own)
        return out

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens on one edge of a token's merge tree, each with the rank that merges it away."""
        out = self.edges[side].get(token)
        if out is None:
            at, until, out = token, NEVER, [(token, NEVER)]
            while (split := self.halves.get(at)) is not None:
                at, until = split[side], split[2]
                out.append((at, until))
            self.edges[side][token] = out
        return out

    def meets(self, a: int, b: int) -> list[tuple[int, int]]:
        """The pairs that would merge across the seam of two tokens."""
        ranks, left, out = self.ranks, self.edge(b, 0), []
        for x, x_until in self.edge(a, 1):
            for y, y_until in left:
                rank = ranks.get(x << 32 | y)
                if rank is not None and rank < x_until and rank <= y_until:
                    out.append((x, y))
        return out

    def reachable(self, token: int) -> bool:
        """Whether merging the token's own bytes ends in the token."""
        if token not in self.halves:
            return True
        a, b, _ = self.halves[token]
        return self.meets(a, b) == [(a, b)] and self.reachable(a) and self.reachable(b)

    def merge(self, raws: list[bytes]) -> Iterator[tuple[int, ...]]:
        """The ids of each piece. Pieces in byte order share the work on what they begin with alike."""
        goto, link, length, token, above = self.parts.values()
        pairs, texts = self.pairs, self.texts
        if len(pairs) >= MEMO:
            pairs.clear()
        previous, last, states, sizes = b"", [-1], [0], [0]
        for raw in raws:
            alike = 0
            for alike, (a, b) in enumerate(zip(raw, previous)):
                if a != b:
                    break
            else:
                alike = min(len(raw), len(previous))
            previous = raw
            del last[alike + 1 :], states[alike + 1 :], sizes[alike + 1 :]
            state, size = states[alike], sizes[alike]
            for end in range(alike + 1, len(raw) + 1):
                step = raw[end - 1]
                to = goto.get(state << 8 | step)
                while to is None:
                    state = link[state]
                    size = length[state]
                    to = goto.get(state << 8 | step)
                state, size = to, size + 1
                found = state if size == length[state] and token[state] >= 0 else above[state]
                while True:
                    before, here = end - length[found], token[found]
                    if not before:
                        break
                    pair = last[before] << 32 | here
                    apart = pairs.get(pair)
                    if apart is None:
                        apart = pairs[pair] = not self.meets(last[before], here)
                    if apart:
                        break
                    found = above[found]
                last.append(here)
                states.append(state)
                sizes.append(size)
            ids, end = [], len(raw)
            while end:
                ids.append(last[end])
                end -= len(texts[last[end]])
            ids.reverse()
            yield tuple(ids)

    def stretches(self, text: str) -> Iterator[tuple[str, int]]:
        """The text in order, as ordinary stretches (number -1) and added tokens."""
        if not self.special or not any(name in text for name in self.special):
            parts = [text]
        else:
            names = sorted(self.special, key=len, reverse=True)
            parts = regex.split("(" + "|".join(map(regex.escape, names)) + ")", text)
        for part in parts:
            number = self.special.get(part, -1)
            if number >= 0:
                yield part, number
                continue
            begin = 0
            while begin < len(part):
                cut = SEAM.search(part, begin + STRETCH) if len(part) - begin > STRETCH else None
                end = cut.start() if cut else len(part)
                yield part[begin:end], -1
                begin = end

    def _flat(self, group: list[list[str]]) -> list[np.ndarray]:
        known = self.pieces
        if len(known) >= MEMO:
            known.clear()
        unseen = sorted(p.encode() for p in set().union(*group).difference(known))
        fresh = {raw.decode(): ids for raw, ids in zip(unseen, self.merge(unseen))}
        known.update(fresh)
        out = [np.fromiter(chain.from_iterable(map(known.__getitem__, pieces)), np.int32) for pieces in group]
        for piece in fresh:
            if len(piece) > LONG_PIECE:
                del known[piece]
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Work is done in groups of about a stretch, or one where it is longer."""
        out, group, owners, held = [[] for _ in texts], [], [], 0

        def flush() -> None:
            for owner, ids in zip(owners, self._flat(group)):
                out[owner].append(ids)
            group.clear()
            owners.clear()

        for owner, text in enumerate(texts):
            for part, number in self.stretches(text):
                if number >= 0:
                    flush()
                    out[owner].append(np.array([number], np.int32))
                    continue
                group.append(PIECES.findall(part))
                owners.append(owner)
                held += len(part)
                if held >= STRETCH:
                    flush()
                    held = 0
        flush()
        return [np.concatenate([*x, np.empty(0, np.int32)]) for x in out]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters, unknown ids nothing."""
        texts = self.texts
        return b"".join(texts[i] for i in ids if 0 <= i < len(texts)).decode("utf-8", "replace")


_held: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """A vocabulary file as read and prepared once by the driver."""
    if path not in _held:
        _held[path] = Vocabulary.read(path)
    return _held[path]


def _ids_column(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0, np.int32)]), pa.int32()))


def encoded(spark: SparkSession, docs: DataFrame, path: str, *, decode: bool = False) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text; with ``decode`` also the text that they decode to.

    ``path`` is a vocabulary file on the driver; what is made of it is broadcast. Null and empty texts
    have no ids. A text is cut into stretches at places where no piece can reach over, so a very long one
    is never in pieces all at once, and a very long piece takes time in proportion to its length. Added
    tokens in a text become their ids. Rows that repeat a doc_id, or have none, each get their row. An
    empty table gives no rows. Columns besides doc_id and text are ignored.
    """
    shared = spark.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for row in range(0, len(texts), 512):
                ids = own.encode_all(texts[row : row + 512].to_pylist())
                columns = {"doc_id": batch.column("doc_id")[row : row + 512], "ids": _ids_column(ids)}
                if decode:
                    columns["decoded"] = pa.array([own.decode(x.tolist()) for x in ids], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, ids array<int>" + (", decoded string" if decode else "")
    return documents(docs).mapInArrow(run, schema)


def decoded(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the other way round. Null ids, and none, give an empty text."""
    shared = spark.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = [own.decode([i for i in x.as_py() or () if i is not None]) for x in batch.column("ids")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
