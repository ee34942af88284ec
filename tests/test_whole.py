"""Registered queries read all of their tables: results against brute force where the SQL reads less."""

import pyarrow as pa
import pyarrow.parquet as pq
from marlstone.plans import relational

from tests import oracle

SF = "/root/testdata/sf0.001"


def ranks(rows):
    """(k, rn) of (k, priority): urgent and null priorities last, null keys last in theirs."""
    order = sorted(rows, key=lambda r: (r[1] in (None, "1-URGENT"), "" if r[1] in (None, "1-URGENT") else r[1], r[0] is None, r[0] or 0))
    return [(k, i) for i, (k, _) in enumerate(order, 1)]


def test_sort_nulls_ranks_all(spark):
    orders = [(r["o_orderkey"], r["o_orderpriority"]) for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderpriority").collect()]
    got = sorted(((r["k"], r["rn"]) for r in relational.queries()["rel_sort_nulls"](spark, SF).collect()), key=lambda r: r[1])
    assert len(got) == len(orders) > 500 and got == ranks(orders)
    assert sorted(got) == sorted(oracle.duck(SF, relational.oracle_sql()["rel_sort_nulls"])[1])


def test_sort_nulls_odd_keys(spark, tmp_path):
    rows = [(k, p) for k in (-(2**62), -5, 0, 499, 500, 2**40, 2**62) for p in ("2-HIGH", "1-URGENT", None)]
    rows = [(k + 7 * i if abs(k) < 2**62 else k + i, p) for i, (k, p) in enumerate(rows)] + [(None, "2-HIGH"), (None, "5-LOW")]
    spark.createDataFrame(rows, "o_orderkey bigint, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(((r["k"], r["rn"]) for r in relational.queries()["rel_sort_nulls"](spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert got == ranks(rows)


def test_not_in_and_nulls(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    for values, want in (([1], [2]), ([1, None], []), ([], [None, 1, 2]), ([None], []), ([7], [1, 2])):
        given = spark.createDataFrame([(v,) for v in values], "v int")
        rows.createOrReplaceTempView("not_in_rows"), given.createOrReplaceTempView("not_in_values")
        got = sorted((r["k"] for r in relational.not_in(rows, "k", given).collect()), key=str)
        assert got == sorted(want, key=str) == sorted((r["k"] for r in spark.sql("SELECT k FROM not_in_rows WHERE k NOT IN (SELECT v FROM not_in_values)").collect()), key=str)


def approximate_errors(spark, folder, rows):
    """Rows of rel_approximate_error over (flag, part, price) rows, after a comparison with its SQL."""
    flags, parts, prices = zip(*rows, strict=True)
    pq.write_table(pa.table({"l_returnflag": pa.array(flags, pa.string()), "l_partkey": pa.array(parts, pa.int64()), "l_extendedprice": pa.array(prices, pa.float64())}), f"{folder}/lineitem.parquet")
    df = relational.queries()["rel_approximate_error"](spark, str(folder))
    assert oracle.difference(df, str(folder), relational.oracle_sql()["rel_approximate_error"]) is None
    return sorted(map(tuple, df.collect()), key=str)


def test_approximate_counts_within_a_tenth(spark, tmp_path):
    """150 groups of 1000 keys each: approx_count_distinct misses six of them by more than a tenth."""
    got = approximate_errors(spark, tmp_path, [(f"{g:03}", 1000 * g + i, float(i)) for g in range(150) for i in range(1000)])
    assert got == [(f"{g:03}", True, True) for g in range(150)]


def test_approximate_error_of_odd_groups(spark, tmp_path):
    """A null flag, equal prices, null prices and keys, single rows."""
    rows = [(None, i, float(i)) for i in range(300)] + [("equal", i, 5.0) for i in range(300)] + [("gaps", i, float(i) if i % 3 else None) for i in range(300)]
    rows += [("none", None, None), ("none", None, None), ("one", 7, 1.5), ("two", 7, 1.5), ("two", 8, 2.5)]
    assert {r[0] for r in approximate_errors(spark, tmp_path, rows)} == {None, "equal", "gaps", "none", "one", "two"}
