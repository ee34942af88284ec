"""Compares registered queries with their SQL on DuckDB: columns, kinds of values, and every row.

``python tests/oracle.py [--sf DIR] [NAME...]`` compares all, or those whose name contains one of the words.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session() -> SparkSession:
    conf = {"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.driver.memory": "6g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": "/tmp/marlstone-warehouse"}
    spark = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(x):
    """A value by which both engines' results can be compared."""
    if x is None or isinstance(x, bool | str):
        return x
    if isinstance(x, int):
        return x
    if isinstance(x, decimal.Decimal):
        return int(x) if x == x.to_integral_value() else round(float(x), 6)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, bytes | bytearray | memoryview):
        return bytes(x).hex()
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    return tuple(map(plain, x))


def kinds(rows: list[tuple]) -> list[set]:
    return [{type(v).__name__ for v in col if v is not None} for col in zip(*rows, strict=True)]


def rows_of(df: DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, [tuple(plain(r[c]) for c in names) for r in df.select(*[f"`{c}`" for c in names]).toArrow().to_pylist()]


def duck(sf_dir: str, text: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as db:
        for t in TABLES:
            if Path(f"{sf_dir}/{t}.parquet").exists():
                db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        found = db.execute(text)
        names = [d[0] for d in found.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(names), [tuple(plain(r[i]) for i in order) for r in found.fetchall()]


def difference(df: DataFrame, sf_dir: str, text: str) -> str | None:
    """What distinguishes the two results, or None."""
    (names, mine), (other_names, other) = rows_of(df), duck(sf_dir, text)
    if names != other_names:
        return f"columns {names} against {other_names}"
    a, b = Counter(mine), Counter(other)
    if a != b:
        return f"{len(mine)} against {len(other)} rows; only here {list((a - b).items())[:2]}; only there {list((b - a).items())[:2]}"
    if mine and kinds(mine) != kinds(other):
        return f"kinds {dict(zip(names, kinds(mine), strict=True))} against {kinds(other)}"
    return None


def main(args: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).parent.parent))
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf_dir, args = args[1], args[2:]
    spark, bad = session(), 0
    sql = entry.oracle_sql()
    for name, f in entry.queries().items():
        if args and not any(w in name for w in args):
            continue
        began = time.time()
        try:
            if name in sql:
                said = difference(f(spark, sf_dir), sf_dir, sql[name])
            else:
                said = f"rows only: {f(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += name in sql and said is not None
        print(f"{name} {time.time() - began:.1f} s: {said or 'equal'}", flush=True)
    print(f"{bad} differ")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
