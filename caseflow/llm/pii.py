"""Personal data by patterns and a semi-Markov conditional random field.

The patterns give the base spans. The field then looks at every stretch of text around digits, ``@``
and ``+`` and cuts it into pieces; a segment of up to ``LONGEST`` pieces is scored as a whole for each
kind, a dynamic programme picks boundaries and kinds together, and what it finds beside the base
spans is added. Its weights are fitted by maximum likelihood on the listed examples and on a bounded
sample of stretches whose base spans are beyond doubt; whether digits pass a check sum is no feature,
so numbers that look like cards are found also where the sum is off.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LONGEST = 16
SAMPLE = 400
LONGEST_SAMPLE = 200
SCORED = 1 << 16

_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+$")
_SIGN = re.compile(r"[0-9@+]")
_SPACE = re.compile(r"\s")
_PIECE = re.compile(r"[^\W_]+|(.)\1*", re.DOTALL)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """From each ``@`` outwards, so that a long run without one costs a single look."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str, where: list[Span] | None = None) -> dict[str, list[Span]]:
    """The spans of the patterns, leftmost and non-overlapping for each kind; failing matches are dropped.

    ``where`` may give the text's stretches: no ip or card crosses the end of one.
    """
    out: dict[str, list[Span]] = {"email": _emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    for start, end in stretches(text) if where is None else where:
        out["ip"] += [
            m.span()
            for m in _IP.finditer(text, start, end)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))
        ]
        for m in _CARD.finditer(text, start, end):
            found = _digits(m.group())
            if 13 <= len(found) <= 19 and luhn(found):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def stretches(text: str) -> list[Span]:
    """Runs of words that hold a digit, ``@`` or ``+``, one space apart; other words are passed over."""
    out: list[Span] = []
    end = 0
    while sign := _SIGN.search(text, end):
        start = sign.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        space = _SPACE.search(text, sign.end())
        end = space.start() if space else len(text)
        if out and out[-1][1] + 1 == start and text[start - 1] == " ":
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def signed(texts: pa.Array) -> pa.Array:
    """Which texts hold a digit, ``@`` or ``+``, and so may hold a span; null ones do not."""
    return pc.match_substring_regex(texts, _SIGN.pattern).fill_null(False)


def shape(text: str) -> str:
    """What the features see: every digit as 9, every letter as a."""
    return "".join("9" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in text)


def _bucket(n: int, bounds: tuple[int, ...]) -> int:
    return sum(n >= b for b in bounds)


def segment_features(text: str, start: int, end: int, pieces: int) -> tuple[str, ...]:
    """The whole-span features of one candidate segment of a shape."""
    s = text[start:end]
    groups = re.findall("9+", s)
    digits = sum(map(len, groups))
    letters = s.count("a")
    before, after = text[start - 1 : start], text[end : end + 1]
    edge = lambda c, next_: "none" if not c else "space" if c.isspace() else "alnum" if c in "9a" else "join" if c in "._%+-@" and next_ else "mark"
    rest = s.replace("9", "").replace("a", "")
    local, _, domain = s.partition("@")
    out = [
        f"digits{_bucket(digits, (1, 4, 7, 9, 12, 13, 16, 17, 20))}",
        f"groups{min(len(groups), 6)}",
        f"longest{_bucket(max(map(len, groups), default=0), (1, 2, 4, 5, 7, 12, 13, 20))}",
        f"pieces{_bucket(pieces, (2, 4, 7, 8, 10, 13))}",
        f"before-{edge(before, text[start - 2 : start - 1] in tuple('9a'))}",
        f"after-{edge(after, text[end + 1 : end + 2] in tuple('9a'))}",
        f"at{min(s.count('@'), 2)}",
        f"dots{min(s.count('.'), 4)}",
        "plus" if s[:1] == "+" else "noplus",
        "letters" if letters else "noletters",
    ]
    if re.fullmatch(r"9{1,3}(\.9{1,3}){3}", s):
        out.append("quad")
    if re.fullmatch(r"9+([ -]9+)*", s):  # an optional separator would cut a run of digits in every possible way
        out.append(f"number{_bucket(digits, (7, 9, 13, 20))}")
    if re.fullmatch(r"9{3,6}([ -]9{3,6}){2,4}", s):
        out.append("grouped")
    if re.fullmatch(r"\+?[9 ().-]+", s):
        out.append(f"dial{_bucket(digits, (7, 9, 16))}" + ("plus" if s[0] == "+" else ""))
    if domain and local and re.fullmatch(r"[9a._%+-]+", local) and re.fullmatch(r"[9a-]+(\.[9a-]+)+", domain):
        out.append("address")
    if letters and digits and "@" not in s:
        out.append("mixed")
    if set(rest) - set(" ().+-@_%"):
        out.append("odd")
    return tuple(out)


def _cut(text: str) -> tuple[list[Span], list[int]]:
    """Pieces of a shape, and how many before each, and in all, hold a digit or ``@``."""
    pieces = [m.span() for m in _PIECE.finditer(text)]
    return pieces, list(accumulate(("9" in text[a:b] or text[a] == "@" for a, b in pieces), initial=0))


def candidates(text: str) -> tuple[list[Span], list[tuple[int, int, tuple[str, ...]]]]:
    """Pieces of a shape, and the segments (first piece, end piece, features) that may be an entity."""
    pieces, marks = _cut(text)
    out = []
    for i, (a, _) in enumerate(pieces):
        if text[a] not in "9a+(":
            continue
        for j in range(i + 1, min(len(pieces), i + LONGEST) + 1):
            b = pieces[j - 1][1]
            if text[b - 1] in "9a" and marks[j] > marks[i]:
                out.append((i, j, segment_features(text, a, b, j - i)))
    return pieces, out


class Field:
    """A semi-Markov field with one weight for each feature and kind; outside pieces score 0."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights
        self.known: dict[str, list[tuple[int, int, int]]] = {}
        self.scored: dict[tuple[str, str, str], tuple[float, int]] = {}

    def _score(self, found: tuple[str, ...]) -> np.ndarray:
        none = np.zeros(len(KINDS))
        return sum((self.weights.get(f, none) for f in found), none)

    def _best(self, text: str, start: int, end: int, pieces: int) -> tuple[float, int]:
        """The best kind's score of a segment and that kind; what the features see of a segment is scored once."""
        seen = text[max(0, start - 2) : start], text[start:end], text[end : end + 2]
        if seen in self.scored:
            return self.scored[seen]
        scores = self._score(segment_features(text, start, end, pieces))
        k = int(scores.argmax())
        if end - start <= LONGEST_SAMPLE:
            if len(self.scored) >= SCORED:
                self.scored.clear()
            self.scored[seen] = float(scores[k]), k
        return float(scores[k]), k

    def decode(self, text: str) -> list[tuple[int, int, int]]:
        """The best segmentation of a stretch: (start, end, kind) of its entities."""
        text = shape(text)
        if text in self.known:
            return self.known[text]
        pieces, marks = _cut(text)
        best, back = [0.0], [None]
        for j, (_, b) in enumerate(pieces, 1):
            top, how = best[j - 1], None
            for i in range(max(0, j - LONGEST), j) if text[b - 1] in "9a" else ():
                a = pieces[i][0]
                if text[a] in "9a+(" and marks[j] > marks[i]:
                    score, k = self._best(text, a, b, j - i)
                    if best[i] + score > top:
                        top, how = best[i] + score, (i, k)
            best.append(top)
            back.append(how)
        out, j = [], len(pieces)
        while j:
            if back[j]:
                i, k = back[j]
                out.append((pieces[i][0], pieces[j - 1][1], k))
                j = i
            else:
                j -= 1
        if len(self.known) < 20_000 and len(text) <= LONGEST_SAMPLE:
            self.known[text] = out[::-1]
        return out[::-1]


# Listed examples: a stretch and the kinds of its entities, each between brackets.
EXAMPLES = (
    ("[4111 1111 1111 1111]", "card"), ("[4111-1111-1111-1111]", "card"), ("[9807915762804490]", "card"),
    ("[5500005555555559]!!", "card"), ("([378282246310005])", "card"), ("[3782 822463 10005]", "card"),
    ("[5927243074273351]$$$", "card"), ("[7536784127813050] [4845168114407329]", "card card"), ("card:[4111111111111111],", "card"),
    ("[+1 (017) 555-7713]", "phone"), ("[+49 30 1234567]", "phone"), ("[+33 1 23 45 67 89]%%%", "phone"),
    ("[(212) 555-0123]", "phone"), ("[212-555-0123]", "phone"), ("[+442071838750].", "phone"), ("[555-123-4567],", "phone"),
    ("[97.51.17.173]", "ip"), ("[10.0.0.1],", "ip"), ("[192.168.100.200]!!", "ip"), ("ip=[8.8.8.8];", "ip"),
    ("[34@mail7.example.com]", "email"), ("[first.last@example.org],", "email"), ("<[a_b+c@mail.example.net]>", "email"),
    ("[und.34@mail7.example.com]###", "email"), ("mailto:[someone@example.com]", "email"),
    ("2.0.", ""), ("3.", ""), ("4.0", ""), ("1.2.3", ""), ("1.2.3.4.5.6", ""), ("2021-03-04", ""), ("10:30", ""), ("$1,000", ""),
    ("1,234,567.89", ""), ("#12345", ""), ("2024", ""), ("12.5%", ""), ("v1.2", ""), ("12345678", ""), ("123456789012", ""),
    ('"9233A8ECF7C5B09FE5949719B6B82BC439E9329B"', ""), ('"2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"###', ""),
    ("3rd", ""), ("a+b", ""), ("x@y", ""), ("@name", ""), ("1 2 3 4 5 6 7 8 9 10 11 12 13 14", ""), ("0.1 0.2 0.3", ""),
    ("100 200 300 400 500 600", ""), ("550e8400-e29b-41d4-a716-446655440000", ""), ("01234567890123456789012345", ""),
)


def _listed() -> list[tuple[str, list[tuple[int, int, int]]]]:
    out = []
    for text, kinds in EXAMPLES:
        plain, spans, start = "", [], 0
        for c in text:
            if c == "[":
                start = len(plain)
            elif c == "]":
                spans.append((start, len(plain), KINDS.index(kinds.split()[len(spans)])))
            else:
                plain += c
        out.append((shape(plain), spans))
    return out


def sample(text: str) -> list[tuple[str, str]]:
    """(shape, spans) of the stretches of a text that hold base spans and nothing doubtful."""
    where = stretches(text)
    base = base_spans(text, where)
    found = sorted((a, b, k) for k, kind in enumerate(KINDS) for a, b in base[kind])
    starts = [a for a, _, _ in found]
    out = []
    for start, end in where:
        begun = found[bisect_left(starts, start) : bisect_left(starts, end)]
        own = [(a - start, b - start, k) for a, b, k in begun if b <= end]
        clear = all(x[1] <= y[0] for x, y in zip(own, own[1:]))
        rest = list(text[start:end])
        for a, b, _ in own:
            rest[a:b] = " " * (b - a)
        if own and clear and not _SIGN.search("".join(rest)) and end - start <= LONGEST_SAMPLE:
            out.append((shape(text[start:end]), ",".join(f"{a}:{b}:{k}" for a, b, k in own)))
    return out


def train(examples: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 60, decay: float = 0.01) -> Field:
    """Maximum likelihood by full gradients; forward and backward sums over all segmentations."""
    names: dict[str, int] = {}
    windows = []
    for text, spans in examples:
        pieces, segments = candidates(text)
        at = {a: i for i, (a, _) in enumerate(pieces)}
        until = {b: j + 1 for j, (_, b) in enumerate(pieces)}
        gold = {(at.get(a), until.get(b)): k for a, b, k in spans}
        if not gold.keys() <= {(i, j) for i, j, _ in segments}:
            continue
        rows = [[names.setdefault(f, len(names)) for f in found] for _, _, found in segments]
        windows.append((len(pieces), [(i, j) for i, j, _ in segments], rows, gold))
    weights = np.zeros((len(names), len(KINDS)))
    seen = np.full_like(weights, 1e-8)
    for _ in range(rounds):
        slope = -decay * weights
        for n, segments, rows, gold in windows:
            scores = np.array([weights[r].sum(axis=0) for r in rows]).reshape(-1, len(KINDS))
            forward, backward = np.zeros(n + 1), np.zeros(n + 1)
            whole = np.logaddexp.reduce(scores, axis=1) if len(rows) else np.zeros(0)
            into: dict[int, list[int]] = {}
            out_of: dict[int, list[int]] = {}
            for s, (i, j) in enumerate(segments):
                into.setdefault(j, []).append(s)
                out_of.setdefault(i, []).append(s)
            for j in range(1, n + 1):
                forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[segments[s][0]] + whole[s] for s in into.get(j, ()))])
            for i in range(n - 1, -1, -1):
                backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[segments[s][1]] + whole[s] for s in out_of.get(i, ()))])
            for s, (i, j) in enumerate(segments):
                expected = np.exp(forward[i] + scores[s] + backward[j] - forward[n])
                if (i, j) in gold:
                    expected[gold[i, j]] -= 1
                if np.abs(expected).max() > 1e-4:
                    slope[rows[s]] -= expected
        seen += slope**2
        weights += 0.5 * slope / np.sqrt(seen)
    return Field({f: weights[k] for f, k in names.items()})


def fit(docs: DataFrame, size: int = SAMPLE) -> Field:
    """Train on the listed examples and on the first ``size`` distinct shapes, by hash, of clear stretches."""

    def run(batches):
        for batch in batches:
            texts = batch.column(0)
            rows = {pair for text in texts.filter(signed(texts)).to_pylist() for pair in sample(text)}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*sorted(rows))], ["shape", "spans"])

    rows = docs.select("text").mapInArrow(run, "shape string, spans string").distinct()
    taken = rows.orderBy(F.xxhash64("shape", "spans"), "shape", "spans").limit(size).collect()
    examples = [(r["shape"], [tuple(map(int, s.split(":"))) for s in r["spans"].split(",")]) for r in taken]
    return train(_listed() + examples)


def find(text: str, field: Field) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and all spans with what the field adds beside them."""
    where = stretches(text)
    base = base_spans(text, where)
    held = sorted(s for spans in base.values() for s in spans)
    every = {kind: list(spans) for kind, spans in base.items()}
    starts = np.array([a for a, _ in held])
    reach = np.maximum.accumulate([b for _, b in held]) if held else np.zeros(0)
    for start, end in where:
        for a, b, k in field.decode(text[start:end]):
            a, b = a + start, b + start
            before = int(np.searchsorted(starts, b))  # base spans that begin before this one's end
            if not before or reach[before - 1] <= a:
                every[KINDS[k]].append((a, b))
    return base, every


def _joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind]))


def pii_spans(spark: SparkSession, docs: DataFrame, sample_size: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are those of the base spans; ``spans`` lists all spans as kind:start:end in
    code points, by kind, then start. Null texts count as empty and have none. Texts of any length are
    read whole; the work is linear in their length. The field trains on at most ``sample_size`` sampled
    stretches of up to 200 characters, and on the listed examples alone where there are none. Repeated
    rows and null ids are kept. An empty table gives no rows. Columns besides doc_id and text are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    field = fit(rows, sample_size)
    weights = field.weights

    def run(batches):
        field = Field(weights)
        none = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts = batch.column("text")
            held = signed(texts)
            counts = np.zeros((len(KINDS), len(texts)), np.int64)
            digests, spans = [none] * len(texts), [""] * len(texts)
            for row, text in zip(np.flatnonzero(held), texts.filter(held).to_pylist()):
                base, every = find(text, field)
                counts[:, row] = [len(base[k]) for k in KINDS]
                digests[row] = hashlib.sha256(_joined(base).encode()).hexdigest()
                spans[row] = _joined(every)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    schema = ", ".join(["doc_id bigint", *(f"n_{k} bigint" for k in KINDS), "base_sha256 string", "spans string"])
    return rows.mapInArrow(run, schema)
