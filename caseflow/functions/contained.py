"""Which words of a list are in a text, as substrings; a small helper for the tasks, on UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

# What was found in a short stretch of text is kept for the next time, up to so many stretches.
KEPT, KEPT_BYTES = 100_000, 64


def finder() -> Callable[[Iterator, dict[int, list[bytes]]], Iterator]:
    """A function on Arrow batches with ``_list``, the number of a list of words, and ``fields``: ``_words`` replaces both.

    A list is indexed by how its words begin. A text is cut at white space. What has none itself lies within one
    stretch of the text, so a word is looked up by its longest piece without white space; one of several
    pieces is then tested against the whole text. All is made here, so it goes to the workers by value.
    """
    import pyarrow as pa

    class Words:
        def __init__(self, words: list[bytes]) -> None:
            self.plain, self.longer, self.begins, self.known, self.starts = set(), {}, {}, {}, {}
            for word in words:
                piece = max(word.split(), key=len, default=b"")
                if piece == word:
                    self.plain.add(word)
                else:
                    self.longer.setdefault(piece, []).append(word)
                if len(piece) > 3:
                    self.begins.setdefault(piece[:3], set()).add(len(piece))
            self.pieces = {p: p for p in (*self.plain, *self.longer) if p}

        def start(self, gram: bytes) -> tuple[list[bytes], list[int]]:
            """The pieces that three bytes begin with, and how long the longer ones are that begin with them."""
            if len(self.starts) >= KEPT:
                self.starts.clear()
            short = [self.pieces[gram[:n]] for n in range(1, len(gram) + 1) if gram[:n] in self.pieces]
            self.starts[gram] = found = short, sorted(self.begins.get(gram, ()))
            return found

        def pieces_of(self, stretch: bytes) -> tuple[bytes, ...]:
            found = self.known.get(stretch)
            if found is None:
                inside, size = set(), len(stretch)
                for i in range(size):
                    gram = stretch[i : i + 3]
                    short, lengths = self.starts.get(gram) or self.start(gram)
                    inside.update(short)
                    for n in lengths:
                        if n > size - i:
                            break
                        part = self.pieces.get(stretch[i : i + n])
                        if part is not None:
                            inside.add(part)
                found = tuple(inside)
                if size <= KEPT_BYTES:
                    if len(self.known) >= KEPT:
                        self.known.clear()
                    self.known[stretch] = found
            return found

        def within(self, fields: list[bytes]) -> list[bytes]:
            stretches = {s for field in fields for s in field.split()}
            pieces = set().union(*map(self.pieces_of, stretches))
            if not self.longer:
                return list(pieces)
            tried = [w for p in (*pieces, b"") for w in self.longer.get(p, ())]
            return [*(pieces & self.plain), *(w for w in tried if any(w in field for field in fields))]

    def run(batches: Iterator, lists: dict[int, list[bytes]]) -> Iterator:
        current, size = {}, 0
        for batch in batches:
            found = []
            for number, fields in zip(batch.column("_list").to_pylist(), batch.column("fields").to_pylist()):
                if number not in current:
                    size += len(lists[number])
                    if size > KEPT or len(current) >= 64:
                        current.clear()
                        size = len(lists[number])
                    current[number] = Words(lists[number])
                found.append(current[number].within([f for f in fields or [] if f is not None]))
            kept = [n for n in batch.schema.names if n not in ("_list", "fields")]
            columns = [*[batch.column(n) for n in kept], pa.array(found, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "_words"])

    return run
