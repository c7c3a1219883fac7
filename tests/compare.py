"""Run registered queries next to their SQL twins and report differences."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


SQL_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
}


def type_difference(spark_df, con, sql: str) -> str | None:
    want = {r[0]: SQL_TYPES.get(r[1], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    got = dict(spark_df.dtypes)
    bad = {c: (got.get(c), want.get(c)) for c in {*got, *want} if got.get(c) != want.get(c)}
    return f"types {bad}" if bad else None


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides agree on columns, row count and values."""
    types = type_difference(spark_df, con, sql)
    if types:
        return types
    rows = [tuple(r) for r in spark_df.collect()]
    got = _sorted_rows(spark_df.columns, rows)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = _sorted_rows(names, cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {sorted(set(got[0]) ^ set(want[0]))}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return f"{len(bad)} rows differ, first: {bad[0]}" if bad else None


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from tests.conftest import make_session

    spark, con = make_session(), duck(sf_dir)
    queries, oracles, failed = entry.queries(), entry.oracle_sql(), 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = difference(df, con, oracles[name])
            else:
                problem = None if df.count() > 0 else "no rows"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed of {len(names or queries)}")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
