"""Compare registered queries with their SQL on one scale: python tests/compare.py DIR [NAME..]"""

from __future__ import annotations

import datetime
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(str(_plain(row[i])) for i in order) for row in rows),
    )


def duck(sf_dir: str):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def difference(spark, con, sf_dir: str, name: str) -> str | None:
    """What differs between a query and its SQL; None where nothing does."""
    got = queries()[name](spark, sf_dir)
    want = con.execute(oracle_sql()[name])
    want_columns = [d[0] for d in want.description]
    if sorted(got.columns) != sorted(want_columns):
        return f"columns {sorted(got.columns)} != {sorted(want_columns)}"
    a = rows_of(got.columns, got.collect())
    b = rows_of(want_columns, want.fetchall())
    if a == b:
        kinds = {c: t for c, t in zip(want_columns, (d[1] for d in want.description))}
        types = {
            c: (t, str(kinds[c]))
            for c, t in got.dtypes
            if (t, str(kinds[c])) not in _SAME_TYPES
        }
        return f"types {types}" if types else None
    extra, missing = [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]
    return f"{len(a)} rows, expected {len(b)}; extra {extra[:2]}; missing {missing[:2]}"


_SAME_TYPES = {
    ("bigint", "BIGINT"),
    ("int", "INTEGER"),
    ("double", "DOUBLE"),
    ("string", "VARCHAR"),
    ("boolean", "BOOLEAN"),
}


def main(sf_dir: str, names: list[str]) -> int:
    from lodeseek.workspace import local_session

    spark, con, bad = local_session(8), duck(sf_dir), 0
    for name in names or queries():
        start = time.time()
        try:
            note = difference(spark, con, sf_dir, name)
        except Exception as e:
            note = f"{type(e).__name__}: {str(e)[:600]}"
        bad += note is not None
        print(f"{name:24} {time.time() - start:6.2f}s  {(note or 'ok')[:1200]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
