"""Run registered queries and their SQL side by side: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[str], list[tuple]]:
    with duckdb.connect() as db:
        for name in TABLES:
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        types = [str(d[1]) for d in found.description]
        return names, types, found.fetchall()


def canonical(names, rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, Decimal):
        return str(value)
    return value


def difference(spark_df, sql: str, sf_dir: str) -> str | None:
    """None when columns, rows and values agree."""
    names, types, expected = sql_rows(sql, sf_dir)
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    got = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    want = canonical(names, expected)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if repr(g) != repr(w)]
    if wrong:
        return f"{len(wrong)} of {len(want)} rows differ, first {wrong[0]}"
    spark_types = dict(spark_df.dtypes)
    odd = [(n, spark_types[n], t) for n, t in zip(names, types) if _type(spark_types[n]) != _type(t)]
    return f"types {odd}" if odd else None


def _type(name: str) -> str:
    return name.lower().replace(" ", "").replace("integer", "int").replace("varchar", "string")


def main() -> None:
    import __spark_entry__ as entry
    from ridetide.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    sf_dir = f"/root/testdata/{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[2:] or list(entry.queries())
    failed = 0
    for name in wanted:
        started = time.time()
        try:
            problem = difference(entry.queries()[name](spark, sf_dir), entry.oracle_sql()[name], sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.2f}s {problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
