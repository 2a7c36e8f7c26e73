"""Run queries against their SQL: ``python tests/compare.py SF [name-prefix ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "float": "FLOAT",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return repr(value + 0.0)
    return repr(value)


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if names, types and rows agree, else what differs."""
    result = con.sql(sql)
    mine = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
            for f in spark_df.schema.fields}
    theirs = dict(zip(result.columns, map(str, result.types)))
    got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    wanted = _rows(result.columns, result.fetchall())
    if mine != theirs:
        return f"columns {mine} != {theirs}"
    if got != wanted:
        only_got = sorted(set(got) - set(wanted))[:3]
        only_wanted = sorted(set(wanted) - set(got))[:3]
        return f"{len(got)} / {len(wanted)} rows; spark only {only_got}; sql only {only_wanted}"
    if not got:
        return "no rows on either side"
    return None


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark, con, bad = session(), duck(sf_dir), 0
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in sqls:
                found = difference(query(spark, sf_dir), con, sqls[name])
            else:
                found = None
                print(f"  rows only: {query(spark, sf_dir).count()}", flush=True)
        except Exception as error:  # noqa: BLE001 - a report, not control flow
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - start:.2f}s", flush=True)
        if found:
            print("    " + found, flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
