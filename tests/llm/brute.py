"""Plain Python versions of the corpus operators, and a table of awkward documents."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
# Extra columns under names that the operators use inside.
CLASHES = "rank long, key long, band long, class long, size long, kept boolean, taken long, score double, tag long, root long, words_taken long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"


def vocabulary(seed=1, n=400):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rnd.randint(2, 9))) for _ in range(n)]


def prose(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n))


def awkward_documents(seed=3):
    """Copies, near copies, shared passages, nulls, empty and very long texts, repeated rows, few words."""
    rnd, words = random.Random(seed), vocabulary()
    texts = {}
    for i in range(1, 60):
        texts[i] = prose(rnd, words, rnd.randint(1, 150))
    base = prose(rnd, words, 160)
    for i in range(100, 130):  # a family of near copies, some of them only near each other
        own = base.split(" ")
        for _ in range(rnd.randint(0, 9)):
            own[rnd.randrange(len(own))] = "edit" + str(rnd.randrange(1000))
        texts[i] = " ".join(own)
    passage = prose(rnd, words, 90)
    for i in range(140, 150):  # a passage inside other prose
        texts[i] = f"{prose(rnd, words, 30)}\n{passage}\n{prose(rnd, words, 30)}"
    for i in range(150, 156):  # exact copies up to case
        texts[i] = base.upper() if i % 2 else base
    texts[160] = "the " * 3000  # a long repetitive text
    texts[161] = prose(rnd, words, 9000)  # a long text
    texts[162] = texts[161] + " end"
    texts[163], texts[164], texts[165], texts[166] = None, "", " \t\n ", "one two"
    texts[167], texts[168] = "One two", "x" * 5000
    texts[169] = "ab" * 900
    rows = [(i, t) for i, t in texts.items()]
    rows += [(166, "one two"), (5, texts[5]), (None, "a text without an id " * 5), (None, None)]
    rnd.shuffle(rows)
    sources = ["a", "b", None, "c"]
    return [
        (i, t, "en" if (i or 0) % 3 else None, sources[(i or 0) % 4], None if t is None else len(t), *([None] * 11))
        for i, t in rows
    ]


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text, width):
    w = words_of(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def similar(a, b, percent=80):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= percent * (len(a) + len(b) - both)


def near(rows, width):
    sets = {i: shingle_set(t, width) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if similar(sets[a], sets[b])]
    return sets, components(ids, links)


def suffix(rows, length=400):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, b in raw:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def leaks(docs, items, width=5, percent=80):
    def grams(text):
        w = WORD.findall((text or "").lower())
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}

    wanted = {i: grams(t) for i, t in items if i is not None}
    out = set()
    for i, t in docs:
        own = grams(t)
        for item, g in wanted.items():
            if i is not None and g and len(g & own) * 100 >= percent * len(g):
                out.add((i, item, len(g & own), len(g)))
    return out


def spoken(rows, length=51):
    """Words in runs of ``length`` that another row has too, and the number of such runs."""
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    holders = {}
    for n, (_, w) in enumerate(texts):
        for k in range(len(w) - length + 1):
            holders.setdefault(tuple(w[k : k + length]), set()).add(n)
    out = []
    for i, w in texts:
        gone = bytearray(len(w))
        for k in range(len(w) - length + 1):
            if len(holders[tuple(w[k : k + length])]) > 1:
                gone[k : k + length] = b"\1" * length
        out.append((i, sum(gone), sum(1 for k in range(len(w)) if gone[k] and (k == 0 or not gone[k - 1]))))
    return out
