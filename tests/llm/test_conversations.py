"""Conversation repair and the prefix trie against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from caseflow.llm import repair, trie

NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, rank long, block long, copies string, said string, again boolean"


def talk(seed, conversations=60, longest=9):
    """Conversations with repeats, nulls, ties, shared beginnings, odd roles and a long one."""
    rnd = random.Random(seed)
    texts = ["Hello there.", "So what?", "no end", "", " \t", "Yes!", "Hello there.  ", "x" * 3000, "é.", None, "two\nlines."]
    rows = []
    for c in range(conversations):
        for t in range(rnd.randint(1, longest) if c != 7 else 45):
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"])
            turn = rnd.choice([t, t, t, t, t + 3, None])
            rows.append((c, turn, role, rnd.choice(texts)))
    rows += rnd.sample(rows, 20)
    rows += [(None, t, "user", "Lost.") for t in range(5)] + [(900 + i, 1, "user", "only") for i in range(30)]
    rows += [(7, 2**62, "user", "far"), (7, -(2**62), "user", "near.")]
    rows += [(55, None, "user", "Same.")] * 30
    rnd.shuffle(rows)
    return rows


def plain_audit(rows):
    """The least repair by rows and states, one row after the other."""
    best = {0: (0, "")}

    def close(d):
        for _ in range(4):
            for (p, letter), q in repair.STEP.items():
                if letter in "ua" and p in d:
                    d[q] = min(d.get(q, (9**9, "")), (d[p][0] + 2, d[p][1] + "I"))

    for initial, dead, late in rows:
        close(best)
        after = {}
        for p, (cost, audit) in best.items():
            options = [(p, cost + 3, "D")]
            for (at, letter), q in repair.STEP.items():
                if at == p and not dead:
                    options += [(q, cost + late, "K")] if letter == initial else []
                    options += [(q, cost + 2 + late, "R")] if letter in "ua" else []
            for q, paid, edit in options:
                after[q] = min(after.get(q, (9**9, "")), (paid, audit + edit))
        best = after
    close(best)
    return min(best[q] for q in (0, 3) if q in best)


def every_audit(rows):
    """The least repair by trying all edits."""
    found = None

    def go(i, out, audit, cost):
        nonlocal found
        if found and cost > found[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            found = min(found or (cost, audit), (cost, audit))
        for letter in "ua":
            if cost + 2 <= 3 * len(rows):
                go(i, out + letter, audit + "I", cost + 2)
        if i < len(rows):
            initial, dead, late = rows[i]
            go(i + 1, out, audit + "D", cost + 3)
            if not dead:
                if initial:
                    go(i + 1, out + initial, audit + "K", cost + late)
                for letter in "ua":
                    go(i + 1, out + letter, audit + "R", cost + 2 + late)

    go(0, "", "", 0)
    return found


def plain_repair(rows):
    groups = defaultdict(list)
    for conv_id, turn, role, text in rows:
        place = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        fault = zlib.crc32(place.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        own = groups[conv_id]
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [((turn is not None, turn or 0), "user" if fault == 4 else role, text, turn)] * (2 if fault == 3 else 1)
    out = []
    for conv_id, own in groups.items():
        own.sort(key=lambda r: (r[0], r[1].encode(), r[2].encode()))
        said, sums, marks = set(), Counter(), []
        for _, role, text, _ in own:
            words = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            kind = "blank" if not words else "duplicate" if (role, text) in said else "truncated" if words[-1] not in ".!?" else ""
            said.add((role, text))
            sums[kind] += 1
            marks.append((role[:1], kind in ("blank", "duplicate"), kind == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        turns = {r[3] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = plain_audit(marks)
        lines, each = [], iter(own)
        odd = sum(e != "D" for e in audit) % 2
        for e in audit:
            role, text = next(each)[1:3] if e != "I" else ("", "")
            if e != "D":
                new = "user" if (len(lines) - odd) % 2 == 0 else "assistant"
                lines.append(f"{role if e == 'K' else new}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv_id, min(gaps, 2**63 - 1), sums["blank"], sums["duplicate"], sums["truncated"], illegal, cost, audit, digest))
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 5) for r in rows], SCHEMA).repartition(6)


@pytest.mark.parametrize("seed", range(3))
def test_parser_equals_state_by_state_and_all_edits(seed):
    rnd = random.Random(seed)
    for _ in range(700):
        rows = [(rnd.choice(["s", "u", "a", "u", "x", ""]), rnd.random() < 0.15, rnd.random() < 0.2) for _ in range(rnd.randint(0, 9))]
        got = repair.chosen(repair.combined([repair.row_cell(*r) for r in rows]))
        assert got == plain_audit(rows)
        if len(rows) <= 3:
            assert got == every_audit(rows)


def test_every_split_gives_the_same_cell():
    """A whole chart over all spans and splits holds what doubling spans give."""
    rnd = random.Random(4)
    for _ in range(20):
        rows = [repair.row_cell(rnd.choice("suax"), rnd.random() < 0.2, rnd.random() < 0.2) for _ in range(8)]
        chart = {(i, i + 1): c for i, c in enumerate(rows)}
        for size in range(2, 9):
            for i in range(9 - size):
                cells = {repair.joined(chart[i, k], chart[k, i + size]) for k in range(i + 1, i + size)}
                assert len(cells) == 1
                chart[i, i + size] = cells.pop()
        assert chart[0, 8] == repair.combined(rows)


def test_many_equal_rows():
    cell = repair.row_cell("", True, False)
    for n in range(1, 20):
        assert repair._many(cell, n) == repair.combined([cell] * n)


def test_repair_equals_plain_python(spark):
    rows = talk(1)
    got = Counter(tuple(r) for r in repair.repair(spark, repair.damaged(frame(spark, rows))).select(*NAMES).collect())
    assert got == plain_repair(rows)
    assert any("I" in r[7] for r in got) and any("R" in r[7] for r in got)


def test_long_conversations_go_in_blocks(spark, monkeypatch):
    """With tiny limits nearly every conversation is cut, over several levels, and nothing changes."""
    monkeypatch.setattr(repair, "LONG_ROWS", 4)
    monkeypatch.setattr(repair, "BLOCK_ROWS", 3)
    monkeypatch.setattr(repair, "FAN", 2)
    rows = talk(2, 40) + [(None, t, "user", f"No {t}.") for t in range(9)]
    rows += [(1_000_000 + i, 5, "user", "gone") for i in range(40) for _ in range(6)]  # some of these drop out whole
    got = Counter(tuple(r) for r in repair.repair(spark, repair.damaged(frame(spark, rows))).select(*NAMES).collect())
    assert got == plain_repair(rows)


def test_repair_of_nothing(spark):
    assert repair.repair(spark, repair.damaged(frame(spark, []))).collect() == []


def plain_trie(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append(((turn is not None, turn or 0), role or "", text or ""))
    for c in own:
        own[c] = [r[1:] for r in sorted(own[c], key=lambda r: (r[0], r[1].encode(), r[2].encode()))]
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
    out = Counter()
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(paths[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out[min(cs), len(p), parent, len(cs), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def family(seed):
    """Conversations that share beginnings, copies of some, and paths of several chunks."""
    rnd = random.Random(seed)
    rows = [(c, t, r, x) for c, t, r, x in talk(seed, 40) if c is None or c < 900]
    base = [(rnd.choice(["user", "assistant"]), f"turn {rnd.randrange(3)}") for _ in range(40)]
    for c in range(100, 160):
        own = base[: rnd.randint(0, 40)] + ([("user", f"own {rnd.randrange(4)}")] if rnd.random() < 0.7 else [])
        rows += [(c, t, *x) for t, x in enumerate(own)]
    rows += [(c, t, "user", "copy") for c in range(200, 240) for t in range(3)]
    rows += [(c, t, "user", "copy") for c in range(300, 306) for t in range(24 + c % 2)]
    rows += [(c, 1, "user", "short") for c in range(1001, 1040, 5)]  # no base, so some have no turns left
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk,shard", [(512, 500_000), (512, 15), (6, 40)])
def test_trie_equals_plain_python(spark, monkeypatch, chunk, shard):
    """Also with tiny shards, so that most nodes are on the skeleton, and with many layers."""
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie, "SHARD_TURNS", shard)
    rows = family(3)
    got = Counter(tuple(r) for r in trie.prefix_trie(spark, frame(spark, rows)).select(*trie.NODE).collect())
    assert got == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(spark, frame(spark, [])).collect() == []
    assert trie.prefix_trie(spark, frame(spark, [(None, 1, "user", "x")])).collect() == []
