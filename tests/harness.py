"""Run a registered query and its SQL side by side and compare whole results."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    """One spelling per value whichever engine it came from."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (int(value) if value == int(value) else round(value, 9))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day).isoformat()
    return value


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    rows = df.select(*[f"`{n}`" for n in names]).collect()
    return names, Counter(tuple(plain(v) for v in r) for r in rows)


def duck_rows(con, sql: str) -> tuple[list[str], Counter]:
    rel = con.sql(sql)
    names = sorted(rel.columns)
    rows = rel.select(", ".join(f'"{n}"' for n in names)).fetchall()
    return names, Counter(tuple(plain(v) for v in r) for r in rows)


def type_names(df, con, sql: str) -> list[str]:
    """Columns whose type family differs between the two engines."""
    family = {
        "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
        "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
    }
    rel = con.sql(sql)
    have = dict(zip(rel.columns, map(str, rel.types)))
    return [
        f"{n}: {t} vs {have.get(n)}" for n, t in df.dtypes if family.get(t, t) != have.get(n)
    ]


def compare(spark, name: str, sf_dir: str, verbose: bool = False) -> list[str]:
    """Differences between a query and its SQL; empty when they agree."""
    import __spark_entry__ as entry

    started = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got_names, got = spark_rows(df)
    spent = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        print(f"{name}: {sum(got.values())} rows, no SQL, {spent:.1f}s")
        return []
    con = duck(sf_dir)
    started = time.time()
    want_names, want = duck_rows(con, sql)
    duck_spent = time.time() - started
    problems = []
    if got_names != want_names:
        problems.append(f"columns {got_names} vs {want_names}")
    problems += [f"type {t}" for t in type_names(df, con, sql)]
    if got != want:
        extra, missing = got - want, want - got
        problems.append(
            f"rows {sum(got.values())} vs {sum(want.values())}; "
            f"only spark {sum(extra.values())} e.g. {sorted(map(str, list(extra)[:3]))}; "
            f"only sql {sum(missing.values())} e.g. {sorted(map(str, list(missing)[:3]))}"
        )
    if verbose:
        state = "OK" if not problems else "DIFF"
        print(f"{state} {name}: {sum(got.values())} rows, spark {spent:.1f}s, sql {duck_spent:.1f}s", flush=True)
        for p in problems:
            print("   ", p[:1500], flush=True)
    return problems


if __name__ == "__main__":
    # python -m tests.harness <sf_dir> [query ...]
    from caseflow.session import build_session

    import __spark_entry__ as entry

    session = build_session(
        "harness", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                               "spark.ui.showConsoleProgress": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    folder, wanted = sys.argv[1], sys.argv[2:] or list(entry.queries())
    size = duck(folder).sql("SELECT count(*) FROM documents").fetchall()[0][0]
    print(f"folder {folder}: {size} documents", flush=True)
    bad = []
    for query in wanted:
        try:
            if compare(session, query, folder, verbose=True):
                bad.append(query)
        except Exception as exc:  # noqa: BLE001 - report and go on with the next query
            print(f"FAIL {query}: {str(exc)[:1500]}", flush=True)
            bad.append(query)
    print("differing:", bad)
