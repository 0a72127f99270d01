"""Run registered queries against their oracle statements: python tests/check_oracle.py [sf] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(value)
    if isinstance(value, int):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def kind(name: str) -> str:
    """Family of a column type, the same for both engines; integers of any width are one."""
    name = name.lower()
    if name.endswith("[]") or name.startswith(("array", "struct", "map")):
        return "nested"
    families = {
        "number": ("tinyint", "smallint", "int", "bigint", "hugeint", "ubigint", "long", "decimal(", "integer", "uinteger"),
        "float": ("double", "float"),
        "text": ("string", "varchar"),
        "boolean": ("boolean",),
        "time": ("timestamp", "date"),
    }
    return next((k for k, starts in families.items() if name.startswith(starts)), name)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def oracle_rows(sf: str, statement: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    res = con.sql(statement)
    return res.columns, [str(t) for t in res.types], res.fetchall()


def compare(df, sf: str, statement: str) -> str | None:
    """None if equal, else what differs."""
    rows = df.collect()
    columns, types, expected = oracle_rows(sf, statement)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    ours, theirs = dict(df.dtypes), dict(zip(columns, types))
    odd = {c: (ours[c], theirs[c]) for c in columns if {kind(ours[c]), kind(theirs[c])} - {"number", '"null"', "void"} and kind(ours[c]) != kind(theirs[c])}
    if odd:
        return f"types {odd}"
    if len(rows) != len(expected):
        return f"rows {len(rows)} / {len(expected)}"
    a, b = sorted_rows(df.columns, rows), sorted_rows(columns, expected)
    for x, y in zip(a, b):
        if x != y:
            return f"first difference\n   spark  {str(x)[:700]}\n   oracle {str(y)[:700]}"
    return None if rows else "no rows"


def main() -> None:
    import __spark_entry__ as entry
    from parley.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not sys.argv[2:] or n in sys.argv[2:]]
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            result = compare(df, sf, oracle[name]) if name in oracle else f"{df.count()} rows, no oracle"
        except Exception as e:  # noqa: BLE001
            result = f"{type(e).__name__}: {str(e)[:1200]}"
        bad += result is not None and "no oracle" not in result
        print(f"{'ok ' if result is None else '-- '}{name} {time.time() - start:.1f}s {result or ''}", flush=True)
    print(f"{len(names)} queries, {bad} differ")


if __name__ == "__main__":
    main()
