"""Repair of conversation structure by weighted interval parsing.

A repaired conversation has role initials ``(s?(ua)+)?``. With four states (nothing yet, after s, after u, after
a) the grammar in Chomsky normal form has a symbol [p,q] for what leads from state p to state q, the rules
[p,q] -> [p,r] [r,q], and one terminal for each edit. A cell holds, for a span of rows and each symbol, the
least (cost, audit); what insertions alone can derive is closed around every row. Cells are combined bottom
up by span length. Whatever derives a span passes some state at every split of it, so each
split gives the same cell, and spans of doubling length are all that has to be filled.

Two audits of a span with equal cost are never a prefix of each other: the longer one would have paid for more
insertions. So the least audit of a span is made of least audits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.shared import ranked, small_side, stored

KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
SPACE = " \t\n\x0b\f\r"
ENDS = ".!?"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE = {"u": "user", "a": "assistant"}
SYMBOLS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
RULES = [[(SYMBOLS.index((p, r)), SYMBOLS.index((r, q))) for r in range(4) if (p, r) in SYMBOLS and (r, q) in SYMBOLS] for p, q in SYMBOLS]
NONE = (math.inf, "")
LARGEST = 2**63 - 1

# A conversation above these goes block by block; that changes the plan, not the answer.
LONG_ROWS = 10_000
LONG_BYTES = 32 << 20
BLOCK_ROWS = 1_024
FAN = 16

Cell = tuple[tuple[float, str], ...]
FRAGMENT = (
    "conv_id bigint, block bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, "
    "first_turn bigint, last_turn bigint, turns bigint, costs array<bigint>, audits array<string>"
)
RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two spans side by side."""
    out = []
    for rules in RULES:
        best, audit = math.inf, ""
        for a, b in rules:
            cost = left[a][0] + right[b][0]
            if cost > best or cost == math.inf:
                continue
            text = left[a][1] + right[b][1]
            if cost < best or text < audit:
                best, audit = cost, text
        out.append((best, audit))
    return tuple(out)


def _inserted() -> Cell:
    """What insertions alone derive: the closure over an empty span."""
    one = {(p, q): (INSERT_COST, INSERT) for (p, letter), q in STEP.items() if letter in ROLE}
    cell = tuple((0, "") if p == q else one.get((p, q), NONE) for p, q in SYMBOLS)
    while (more := joined(cell, cell)) != cell:
        cell = more
    return cell


NOTHING = _inserted()


@cache
def row_cell(initial: str, dead: bool, truncated: bool) -> Cell:
    """The cell of one row with insertions around it. A dead row, blank or a duplicate, can only go."""
    options = {(p, p): [(DELETE_COST, DELETE)] for p in range(4)}
    late = TRUNCATED_COST if truncated else 0
    for (p, letter), q in {} if dead else STEP.items():
        if letter == initial:
            options.setdefault((p, q), []).append((late, KEEP))
        if letter in ROLE:
            options.setdefault((p, q), []).append((REROLE_COST + late, REROLE))
    bare = tuple(min(options.get(s, [NONE])) for s in SYMBOLS)
    return joined(joined(NOTHING, bare), NOTHING)


def combined(cells: list[Cell]) -> Cell:
    """Bottom up by span length."""
    while len(cells) > 1:
        odd = cells[-1:] if len(cells) % 2 else []
        cells = [joined(a, b) for a, b in zip(cells[::2], cells[1::2])] + odd
    return cells[0] if cells else NOTHING


def _many(cell: Cell, n: int) -> Cell:
    """The cell of n equal rows."""
    out = None
    while n:
        if n & 1:
            out = cell if out is None else joined(out, cell)
        cell, n = joined(cell, cell) if n > 1 else cell, n >> 1
    return out or NOTHING


def chosen(cell: Cell) -> tuple[int, str]:
    """The least whole repair: nothing left, or ending after an assistant."""
    return min(cell[SYMBOLS.index((0, 0))], cell[SYMBOLS.index((0, 3))])


def _is_blank(text: str) -> bool:
    return not text.strip(SPACE)


def _is_truncated(text: str) -> bool:
    return text.rstrip(SPACE)[-1:] not in ENDS


def repaired_lines(rows: list[tuple[str, str, int]], audit: str, before: int, with_system: bool) -> Iterator[str]:
    """The lines that an audit leaves of rows (role, text, copies). ``before``: lines already there."""
    each = (row[:2] for row in rows for _ in range(row[2]))
    for edit in audit:
        role, text = next(each) if edit != INSERT else ("", "")
        if edit == DELETE:
            continue
        if edit != KEEP:
            role = ROLE["ua"[(before - with_system) % 2]]
        before += 1
        yield f"{role}:{text}"


def starts_with_system(audit: str) -> bool:
    """(ua)+ is even, so an odd number of lines begins with s."""
    return (len(audit) - audit.count(DELETE)) % 2 == 1


def _summary(rows: list[tuple], seen: set | None) -> dict:
    """Faults, borders and cell of rows (turn, role, text, copies, again) in order.

    ``seen`` collects what was said before; without it ``again`` marks the rows said before.
    """
    out = dict.fromkeys(("n", "blank", "duplicate", "truncated", "illegal", "turns"), 0)
    out |= {"first": None, "last": None, "first_turn": None, "last_turn": None}
    cells = []
    for turn, role, text, copies, again in rows:
        if not copies:
            continue
        out["n"] += copies
        if turn is not None and turn != out["last_turn"]:
            out["turns"] += 1
            out["first_turn"] = turn if out["first_turn"] is None else out["first_turn"]
            out["last_turn"] = turn
        initial = role[:1]
        if out["last"] is not None:
            out["illegal"] += out["last"] + initial not in ("su", "ua", "au")
        out["illegal"] += (copies - 1) * (initial + initial not in ("su", "ua", "au"))
        out["first"] = initial if out["first"] is None else out["first"]
        out["last"] = initial
        if _is_blank(text):
            out["blank"] += copies
            cells.append(_many(row_cell("", True, False), copies))
            continue
        if seen is not None:
            said = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            again = said in seen
            seen.add(said)
        repeats = copies if again else copies - 1
        out["duplicate"] += repeats
        if not again:
            truncated = _is_truncated(text)
            out["truncated"] += truncated
            cells.append(row_cell(initial, False, truncated))
        if repeats:
            cells.append(_many(row_cell("", True, False), repeats))
    return out | {"cell": combined(cells)}


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else min(LARGEST, last - first + 1 - turns)


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys, nulls equal, of sorted rows."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(row[k] for k in key)
            if held and own != now:
                yield now, held
                held = []
            now = own
            held.append(row)
    if held:
        yield now, held


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in RESULT.split(", ")]
    out = []
    for (conv_id,), rows in _groups(batches, ["conv_id"]):
        kept = [(r["turn"], r["role"], r["text"], r["copies"], False) for r in rows]
        s = _summary(kept, set())
        cost, audit = chosen(s["cell"])
        lines = repaired_lines([r[1:4] for r in kept], audit, 0, starts_with_system(audit))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        gaps = _gaps(s["first_turn"], s["last_turn"], s["turns"])
        out.append((conv_id, gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], cost, audit, digest))
        if len(out) >= 1_000:
            yield _batch(out, names)
            out = []
    yield _batch(out, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _fragment(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["rank"])
    s = _summary([(r["turn"], r["role"], r["text"], r["copies"], r["again"]) for r in rows], None)
    return _fragment_table(rows[0]["conv_id"], rows[0]["block"], s)


def _fragment_table(conv_id: int | None, block: int, s: dict) -> pa.Table:
    cell = s.pop("cell")
    row = {"conv_id": conv_id, "block": block, **s, "costs": [-1 if c == math.inf else c for c, _ in cell], "audits": [a for _, a in cell]}
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.Table.from_pylist([row], pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in FRAGMENT.split(", "))]))


def _cell_of(row: dict) -> Cell:
    return tuple((math.inf if c < 0 else c, a) for c, a in zip(row["costs"], row["audits"]))


def _merged(table: pa.Table) -> pa.Table:
    """Neighbouring fragments of a conversation as one."""
    parts = sorted(table.to_pylist(), key=lambda r: r["block"])
    out = dict(parts[0])
    for x in parts[1:]:
        if out["last"] is not None and x["first"] is not None:
            out["illegal"] += out["last"] + x["first"] not in ("su", "ua", "au")
        for k in ("n", "blank", "duplicate", "truncated", "illegal", "turns"):
            out[k] += x[k]
        if x["first_turn"] is not None:
            out["turns"] -= out["last_turn"] == x["first_turn"]
            out["first_turn"] = x["first_turn"] if out["first_turn"] is None else out["first_turn"]
            out["last_turn"] = x["last_turn"]
        out["last"] = x["last"]
    s = {k: out[k] for k in ("n", "blank", "duplicate", "truncated", "illegal", "first", "last", "first_turn", "last_turn", "turns")}
    return _fragment_table(out["conv_id"], out["level"], s | {"cell": combined([_cell_of(x) for x in parts])})


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's share of its conversation's audit, with the number of lines before it."""
    for batch in batches:
        for row in batch.to_pylist():
            audit, at, before = row["audit"], 0, 0
            odd, blocks, out = starts_with_system(audit), sorted(row["blocks"], key=lambda b: b["block"]), []
            for k, b in enumerate(blocks):
                end, rows = at, b["n"]
                while rows:
                    rows -= audit[end] != INSERT
                    end += 1
                end = len(audit) if k == len(blocks) - 1 else end
                out.append((row["conv_id"], b["block"], audit[at:end], before, odd))
                before += end - at - audit.count(DELETE, at, end)
                at = end
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "block", "piece", "before", "with_system"])


def _text(rows: pa.Table, piece: pa.Table) -> pa.Table:
    own = piece.to_pylist()[0]
    triples = [(r["role"], r["text"], r["copies"]) for r in sorted(rows.to_pylist(), key=lambda r: r["rank"])]
    lines = list(repaired_lines(triples, own["piece"], own["before"], own["with_system"]))
    return pa.table({
        "conv_id": pa.array([own["conv_id"]], pa.int64()), "block": pa.array([own["block"]], pa.int64()),
        "lines": pa.array(["\n".join(lines)], pa.string()), "some": pa.array([bool(lines)]),
    })


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of a conversation's text, block after block."""
    now, state, begun, out = None, None, False, []
    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != now:
                if state is not None:
                    out.append((now, state.hexdigest()))
                now, state, begun = row["conv_id"], hashlib.sha256(), False
            if row["some"]:
                state.update((b"\n" if begun else b"") + row["lines"].encode())
                begun = True
    if state is not None:
        out.append((now, state.hexdigest()))
    yield _batch(out, ["conv_id", "repaired_sha256"])


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows with faults put in by the checksum of their place.

    A null role or text is one space, and so is a null conv_id or turn in ``conv_id:turn``. Dropped rows
    have no copies.
    """
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(place) % 20
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _in_blocks(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The results of long conversations. Equal rows are one with a count, so no task gets a crowd of them."""
    same = ["conv_id", "turn", "role", "text"]
    rows = rows.groupBy(*same).agg(F.sum("copies").cast("bigint").alias("copies"))
    said = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role"), F.concat("role", "text")), 256)
    # A dropped row has no place.
    rows = ranked(spark, rows.withColumn("said", said), _order(), "repair-rows").where("copies > 0")
    firsts = rows.groupBy("said").agg(F.min("rank").alias("first_rank"), F.count("*").alias("times")).where("times > 1").drop("times")
    firsts = small_side(stored(spark, firsts, "repair-said"))
    rows = rows.join(firsts, "said", "left").select(
        "conv_id", "turn", "role", "text", "copies", "rank",
        F.coalesce(F.col("rank") > F.col("first_rank"), F.lit(False)).alias("again"),
        F.floor(F.col("rank") / BLOCK_ROWS).cast("bigint").alias("block"),
    )
    rows = stored(spark, rows, "repair-blocks")
    blocks = stored(spark, rows.groupBy("conv_id", "block").applyInArrow(_fragment, FRAGMENT), "repair-fragments")
    tops = blocks
    while tops.groupBy("conv_id").count().where("count > 1").limit(1).count():
        wider = tops.withColumn("level", F.floor(F.col("block") / FAN).cast("bigint"))
        tops = stored(spark, wider.groupBy("conv_id", "level").applyInArrow(_merged, FRAGMENT), "repair-level")

    def finish(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                gaps = _gaps(r["first_turn"], r["last_turn"], r["turns"])
                out.append((r["conv_id"], gaps, r["blank"], r["duplicate"], r["truncated"], r["illegal"], *chosen(_cell_of(r))))
            yield _batch(out, [x.split(" ")[0] for x in RESULT.split(", ")][:-1])

    done = stored(spark, tops.mapInArrow(finish, RESULT.rpartition(",")[0]), "repair-audits")
    sizes = blocks.groupBy("conv_id").agg(F.collect_list(F.struct("block", "n")).alias("blocks"))
    wide = done.select("conv_id", "audit").join(sizes.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    pieces = wide.mapInArrow(_cuts, "conv_id bigint, block bigint, piece string, before bigint, with_system boolean")
    texts = rows.groupBy("conv_id", "block").cogroup(pieces.groupBy("conv_id", "block")).applyInArrow(
        _text, "conv_id bigint, block bigint, lines string, some boolean"
    )
    hashes = texts.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_hashes, "conv_id bigint, repaired_sha256 string")
    return done.join(hashes.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")


def repair(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, copies): its faults and its least repair.

    ``cost`` and ``audit`` are those of the least repair, ties to the audit least in ASCII;
    ``repaired_sha256`` is the hash of its lines ``role:text``. Rows go by turn, nulls first, and rows of
    one turn by role and text. A null conv_id is one conversation. A conversation whose rows all have no copies
    has zeros, an empty audit and the hash of nothing; an empty table gives no rows. Roles go by their first
    letter; one that is no s, u or a, or empty, cannot be kept. A gap count beyond a long is its largest value.
    Columns besides the five are ignored.

    A conversation is parsed in one task up to ``LONG_ROWS`` rows and ``LONG_BYTES`` of text. Longer
    ones are cut into blocks whose cells are combined over several rounds.
    """
    size = F.length("text") + F.length("role") + 32
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    long = stored(spark, sizes.where((F.col("n") > LONG_ROWS) | (F.col("bytes") > LONG_BYTES)).select(F.col("conv_id").alias("_long")), "repair-long")
    kept = ("conv_id", "turn", "role", "text", "copies")
    if not long.limit(1).count():
        return _short(rows.select(*kept))
    mine = F.col("conv_id").eqNullSafe(F.col("_long"))
    listed = small_side(long)
    blocks = _in_blocks(spark, rows.select(*kept).join(listed, mine, "left_semi"))
    dropped = long.join(blocks.select(F.col("conv_id").alias("_c")), F.col("_long").eqNullSafe(F.col("_c")), "left_anti")
    empty = dropped.select(
        F.col("_long").alias("conv_id"), *[F.lit(0).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.lit("").alias("audit"), F.lit(hashlib.sha256(b"").hexdigest()).alias("repaired_sha256"),
    )
    return _short(rows.select(*kept).join(listed, mine, "left_anti")).union(blocks.select(*[x.split(" ")[0] for x in RESULT.split(", ")])).union(empty)


def _short(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(*_order()).mapInArrow(_whole, RESULT)
