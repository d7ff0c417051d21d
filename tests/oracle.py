"""Run a registered query and its SQL on the same tables and compare everything."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as driver  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def _content(table: pa.Table) -> tuple[list[tuple[str, str]], list[tuple]]:
    table = table.select(sorted(table.column_names))
    schema = [(f.name, str(f.type).replace("large_", "")) for f in table.schema]
    columns = [[_plain(v) for v in column.to_pylist()] for column in table.columns]
    return schema, sorted(zip(*columns)) if columns else []


def compare(spark, con, folder: str, name: str) -> str | None:
    """None when equal, else what differs."""
    schema, rows = _content(driver.queries()[name](spark, folder).toArrow())
    sql = driver.oracle_sql().get(name)
    if sql is None:
        return None if rows else "no rows"
    wanted_schema, wanted = _content(con.sql(sql).to_arrow_table())
    if schema != wanted_schema:
        return f"schema {schema} instead of {wanted_schema}"
    if len(rows) != len(wanted):
        return f"{len(rows)} rows instead of {len(wanted)}"
    differing = [(a, b) for a, b in zip(rows, wanted) if a != b]
    return f"{len(differing)} of {len(rows)} rows differ, first: {differing[0]}" if differing else None


def main() -> None:
    from caseloom.session import build_session

    folder, *names = sys.argv[1:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name in names or driver.queries():
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)


if __name__ == "__main__":
    main()
