"""The relational surface as declarative plans over the star schema, and the SQL that must give the same rows.

Most plans are one SQL text that Catalyst plans as it likes; ``{table}`` stands for a DataFrame, so no view is left in the session. Plans for which Spark
has a better form than portable SQL (as-of and range joins, frames by group, sketches) are written with DataFrames.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Texts that both engines read. That of rel_sort_nulls, whose window would be one task, is left to DuckDB: :func:`sort_nulls` gives the same ranks.
SHARED: dict[str, str] = {
    "rel_project_filter": "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS double_qty, upper(l_returnflag) AS flag FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'F%' AND l_shipdate IS NOT NULL",
    "rel_case_cast": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, CAST(floor(o_totalprice) AS BIGINT) AS whole, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status, TRY_CAST(o_orderpriority AS INT) AS bad FROM orders",
    "rel_inner_join": "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "rel_star_join": "SELECT r_name, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, extract(year FROM o_orderdate)",
    "rel_left_outer": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    "rel_right_outer": "SELECT p_partkey, count(l_orderkey) AS sold FROM lineitem RIGHT JOIN part ON l_partkey = p_partkey AND l_quantity > 45 GROUP BY p_partkey",
    "rel_full_outer": "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) b ON a.k = b.k",
    "rel_semi_join": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "rel_anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "rel_in_subquery": "SELECT count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)",
    "rel_correlated_subquery": "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > 2 * (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "rel_scalar_subquery": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
    "rel_cross_join": "SELECT r_name, p_brand FROM region CROSS JOIN (SELECT DISTINCT p_brand FROM part) b",
    "rel_theta_join": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "rel_self_join": "SELECT a.l_orderkey AS k, count(*) AS pairs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY a.l_orderkey",
    "rel_group_agg": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "rel_having": "SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150",
    "rel_count_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag",
    "rel_filter_agg": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders GROUP BY o_orderpriority",
    "rel_grouping_sets": "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())",
    "rel_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "rel_rollup": "SELECT n_regionkey, n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)",
    "rel_statistics": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r, round(median(l_quantity), 6) AS med, min(l_shipdate) AS first_ship, max(l_extendedprice) AS top FROM lineitem GROUP BY l_returnflag",
    "rel_bool_bit_agg": "SELECT o_custkey, bool_and(o_totalprice > 1000) AS all_large, bool_or(o_orderstatus = 'F') AS any_done, bit_or(CAST(o_orderkey AS BIGINT)) AS bits, bit_xor(CAST(o_orderkey AS BIGINT)) AS parity FROM orders GROUP BY o_custkey",
    "rel_rank": "SELECT c_custkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, CAST(ntile(4) OVER w AS BIGINT) AS quarter FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)",
    "rel_percent_rank": "SELECT c_custkey, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal)",
    "rel_lag_lead": "SELECT event_id, lag(value) OVER w AS before, lead(value, 2, 0.0) OVER w AS after, first_value(event_type) OVER w AS first_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "rel_nth_value": "SELECT event_id, nth_value(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_type, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_type FROM events",
    "rel_frame_rows": "SELECT event_id, count(value) OVER w AS n, round(sum(value) OVER w, 4) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)",
    "rel_frame_range": "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM lineitem",
    "rel_sort_nulls": "SELECT k, rn FROM (SELECT k, row_number() OVER (ORDER BY v ASC NULLS LAST, k) AS rn FROM (SELECT o_orderkey AS k, nullif(o_orderpriority, '1-URGENT') AS v FROM orders) t) s",
    "rel_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10",
    "rel_topk": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50",
    "rel_topk_per_group": "SELECT n_nationkey, c_custkey FROM (SELECT n_nationkey, c_custkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey) t WHERE rn <= 3",
    "rel_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "rel_union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "rel_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier",
    "rel_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier",
    "rel_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 48",
    "rel_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier",
    "rel_distinct": "SELECT DISTINCT l_shipdate, l_returnflag FROM lineitem",
    "rel_cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT o_custkey FROM big WHERE t > (SELECT avg(t) FROM big)) SELECT c_mktsegment, count(*) AS n FROM customer JOIN top ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "rel_recursive_cte": "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    "rel_values": "SELECT k, v FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)",
    "rel_trivial": "SELECT 40 + 2 AS answer",
    "rel_string_fns": "SELECT c_custkey, lower(c_name) AS lo, length(c_name) AS len, substr(c_name, 3, 4) AS mid, replace(c_name, '#', '-') AS rep, trim(concat('  ', c_mktsegment, ' ')) AS tr, lpad(CAST(c_custkey AS STRING), 8, '0') AS pad, reverse(c_mktsegment) AS rev, repeat('x', 3) AS xs, ascii(c_name) AS code, split_part(c_name, '#', 2) AS part, translate(c_mktsegment, 'AEIOU', 'aeiou') AS vow, left(c_name, 2) AS l2, right(c_name, 2) AS r2 FROM customer",
    "rel_math_fns": "SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS a, CAST(ceil(l_extendedprice) AS BIGINT) AS c, CAST(floor(l_extendedprice) AS BIGINT) AS f, round(sqrt(l_quantity), 6) AS s, round(ln(l_extendedprice), 6) AS l, round(power(l_quantity, 2), 2) AS p, mod(l_orderkey, 7) AS m, CAST(sign(l_quantity - 25) AS BIGINT) AS sg, greatest(l_quantity, 25.0) AS g, round(radians(l_quantity), 6) AS rad, round(cbrt(l_quantity), 6) AS cb FROM lineitem",
    "rel_date_fns": "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m, CAST(extract(day FROM o_orderdate) AS BIGINT) AS d, CAST(extract(quarter FROM o_orderdate) AS BIGINT) AS q, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(o_orderdate + INTERVAL '7' DAY AS DATE) AS week_later, CAST(last_day(CAST(o_orderdate AS DATE)) AS DATE) AS last FROM orders",
    "rel_crypto_fns": "SELECT c_custkey, md5(c_name) AS m, to_hex FROM (SELECT c_custkey, c_name, lower(hex(c_name)) AS to_hex FROM customer) t",
    "rel_pivot_manual": "SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o FROM orders GROUP BY o_orderpriority",
}

#: Where the two dialects differ: (Spark, DuckDB).
PAIRED: dict[str, tuple[str, str]] = {
    "rel_integer_division": ("SELECT o_orderkey, o_orderkey div 7 AS q, o_orderkey % 7 AS r FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r FROM orders"),
    "rel_array_fns": (
        "SELECT o_custkey, array_join(transform(k, x -> CAST(x AS STRING)), ',') AS keys, size(k) AS n, array_contains(k, 7) AS has7, element_at(k, 1) AS first, array_join(transform(filter(k, x -> x % 2 = 0), x -> CAST(x AS STRING)), ',') AS even, aggregate(k, CAST(0 AS BIGINT), (a, x) -> a + x) AS total, array_position(k, element_at(k, -1)) AS pos, array_join(slice(transform(k, x -> CAST(x AS STRING)), 1, 2), ',') AS two FROM (SELECT o_custkey, sort_array(collect_list(o_orderkey)) AS k FROM orders GROUP BY o_custkey)",
        "SELECT o_custkey, array_to_string(k, ',') AS keys, len(k)::INTEGER AS n, list_contains(k, 7) AS has7, k[1] AS first, array_to_string(list_filter(k, lambda x: x % 2 = 0), ',') AS even, list_sum(k)::BIGINT AS total, list_position(k, k[-1])::BIGINT AS pos, array_to_string(k[1:2], ',') AS two FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k FROM orders GROUP BY o_custkey)",
    ),
    "rel_unnest": (
        "SELECT c_custkey, pos, w FROM customer LATERAL VIEW posexplode(split(c_name, '#')) AS pos, w",
        "SELECT c_custkey, (i - 1)::INTEGER AS pos, string_split(c_name, '#')[i] AS w FROM customer, range(1, len(string_split(c_name, '#')) + 1) t(i)",
    ),
    "rel_generate_series": ("SELECT CAST(x AS BIGINT) AS x FROM (SELECT explode(sequence(1, 100, 3)) AS x)", "SELECT x::BIGINT AS x FROM generate_series(1, 100, 3) t(x)"),
    "rel_map_fns": (
        "SELECT o_custkey, element_at(m, 'F') AS f, size(m) AS n, array_join(array_sort(map_keys(m)), ',') AS ks FROM (SELECT o_custkey, map_from_entries(collect_list(struct(o_orderstatus, n))) AS m FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus) GROUP BY o_custkey)",
        "SELECT o_custkey, max(n) FILTER (WHERE o_orderstatus = 'F') AS f, count(*)::INTEGER AS n, string_agg(o_orderstatus, ',' ORDER BY o_orderstatus) AS ks FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus) GROUP BY o_custkey",
    ),
    "rel_struct_fns": (
        "SELECT o_orderkey, s.price AS price, s.flag AS flag FROM (SELECT o_orderkey, named_struct('price', o_totalprice, 'flag', o_orderstatus) AS s FROM orders)",
        "SELECT o_orderkey, s.price AS price, s.flag AS flag FROM (SELECT o_orderkey, {'price': o_totalprice, 'flag': o_orderstatus} AS s FROM orders)",
    ),
    "rel_json_fns": (
        "SELECT event_id, get_json_object(concat('{\"page\":{\"n\":', event_id, '}}'), '$.page.n') AS page, get_json_object(props, '$.k') AS k, json_array_length('[1,2,3]') AS n FROM events",
        "SELECT event_id, json_extract_string(concat('{\"page\":{\"n\":', event_id, '}}'), '$.page.n') AS page, json_extract_string(props, '$.k') AS k, json_array_length('[1,2,3]')::INTEGER AS n FROM events",
    ),
    "rel_regexp_fns": (
        r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(url, '[0-9]+', 'N') AS masked, url RLIKE '/[a-z]{2}/' AS has_lang, size(regexp_extract_all(url, '[0-9]+', 0)) AS numbers FROM pages",
        r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(url, '[0-9]+', 'N', 'g') AS masked, regexp_matches(url, '/[a-z]{2}/') AS has_lang, len(regexp_extract_all(url, '[0-9]+'))::INTEGER AS numbers FROM pages",
    ),
    "rel_hash_fns": ("SELECT c_custkey, sha2(c_name, 256) AS s, base64(CAST(c_name AS BINARY)) AS b FROM customer", "SELECT c_custkey, sha256(c_name) AS s, to_base64(c_name::BLOB) AS b FROM customer"),
    "rel_string_agg": (
        "SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "rel_date_bin": (
        "SELECT CAST(window.start AS TIMESTAMP_NTZ) AS bucket, count(*) AS n FROM events GROUP BY window(ts, '6 hours')",
        "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS n FROM events GROUP BY 1",
    ),
    "rel_pivot": (
        "SELECT * FROM (SELECT user_id, event_type FROM events) PIVOT (count(*) FOR event_type IN ('click' AS click, 'view' AS view_, 'purchase' AS purchase))",
        "SELECT user_id, nullif(count(*) FILTER (WHERE event_type = 'click'), 0) AS click, nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS view_, nullif(count(*) FILTER (WHERE event_type = 'purchase'), 0) AS purchase FROM events GROUP BY user_id",
    ),
}


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """``text`` over the tables of a folder, without temporary views."""
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", text)]
    text = text.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
        text = re.sub(rf"(\{{{t}\}})(?!\s+(?!WHERE|JOIN|GROUP|ORDER|ON|CROSS|FULL|LEFT|RIGHT|INNER|UNION|INTERSECT|EXCEPT|LATERAL|WINDOW|LIMIT|CLUSTER)[a-z]\b)", rf"\1 AS {t}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}) if used else spark.sql(text.replace("{{", "{").replace("}}", "}"))


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the latest earlier view of its user: one union and one window, so no pairs of rows are made."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type").isin("purchase", "view"))
    view = F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))
    earlier = Window.partitionBy("user_id").orderBy("ts", F.col("event_type").desc(), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("seen", F.last(view, ignorenulls=True).over(earlier)).where("event_type = 'purchase'").select("event_id", F.col("seen.event_id").alias("view_id"))


AS_OF_SQL = "SELECT p.event_id, (SELECT v.event_id FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS view_id FROM events p WHERE p.event_type = 'purchase'"


def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within an hour after a click of the same user: hourly bins make the range an equality on at most two bins."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    click = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("from_ts"), F.explode(F.array(hour, hour + 1)).alias("bin"))
    buy = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy_id"), "ts", hour.alias("bin"))
    return click.join(buy, ["user_id", "bin"]).where(F.col("ts").between(F.col("from_ts"), F.col("from_ts") + F.expr("INTERVAL '1' HOUR"))).select("click_id", "buy_id")


RANGE_SQL = "SELECT c.event_id AS click_id, b.event_id AS buy_id FROM events c JOIN events b ON c.user_id = b.user_id AND b.ts BETWEEN c.ts AND c.ts + INTERVAL 1 HOUR WHERE c.event_type = 'click' AND b.event_type = 'purchase'"


def frame_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GROUPS frame (one peer group before to one after) by ranges over a dense rank."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    ranked = line.withColumn("g", F.dense_rank().over(Window.partitionBy("l_suppkey").orderBy("l_quantity")))
    near = Window.partitionBy("l_suppkey").orderBy("g").rangeBetween(-1, 1)
    return ranked.select("l_orderkey", "l_linenumber", F.count("*").over(near).alias("n"))


GROUPS_SQL = "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM lineitem"


def not_in(rows: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is NOT IN the one column of ``values``, by SQL's rules for null: nothing if ``values`` has a null, everything if it is empty, else no null key.

    An anti join by key, which may shuffle, and one row of counts: the NOT IN of a SQL text broadcasts all of ``values``, however many there are.
    """
    (name,) = values.columns
    counts = values.agg(F.count("*").alias("_n"), F.count_if(F.col(name).isNull()).alias("_nulls"))
    kept = rows.join(values.select(F.col(name).alias("_v")), F.col(key) == F.col("_v"), "left_anti").crossJoin(F.broadcast(counts))
    return kept.where("_n = 0 OR (_nulls = 0 AND " + f"`{key}` IS NOT NULL)").drop("_n", "_nulls")


def in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part", "supplier"))
    small = part.where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    found = not_in(line.join(small, "l_partkey", "left_semi").select("l_suppkey"), "l_suppkey", supplier.where("s_acctbal < 0").select("s_suppkey"))
    return found.agg(F.count("*").alias("n"))


def approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches: distinct count and percentile; engines differ in them, so rows are compared only in number.

    The counting sketch has a standard error of 1.6 % and is as good as exact on few keys. That of approx_count_distinct has 4.6 %, so a group in thirty would miss by more than a tenth.
    """
    parts = F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").agg(parts.alias("parts"), F.percentile_approx("l_extendedprice", 0.5).alias("median_price"))


def approximate_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sketches of :func:`approximate` are near the exact figures: distinct counts to a tenth, the rank of the percentile to a hundredth.

    Equal prices share all of their ranks, null ones have none, and a null flag is a group like others.
    """
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_partkey", "l_extendedprice")
    sketch = approximate(spark, sf_dir).withColumnRenamed("l_returnflag", "flag")
    price, median = F.col("l_extendedprice"), F.col("median_price")
    figures = (F.count_distinct("l_partkey").alias("exact"), F.count(price).alias("n"), F.count_if(price < median).alias("below"), F.count_if(price <= median).alias("up_to"))
    both = line.join(sketch, F.col("l_returnflag").eqNullSafe(F.col("flag"))).groupBy("l_returnflag", "parts").agg(*figures)
    median_near = (F.col("below") <= 0.51 * F.col("n")) & (F.col("up_to") >= 0.49 * F.col("n"))
    return both.select("l_returnflag", (F.abs(F.col("parts") - F.col("exact")) <= 0.1 * F.col("exact")).alias("parts_near"), median_near.alias("median_near"))


APPROXIMATE_SQL = "SELECT l_returnflag, true AS parts_near, true AS median_near FROM lineitem GROUP BY l_returnflag"


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement with bound parameters."""
    return spark.sql("SELECT o_orderkey FROM {orders} WHERE o_totalprice > :least AND o_orderstatus = :status", args={"least": 150000, "status": "F"}, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


#: Ranges of equal width into which keys fall, for ranks without one task for all rows.
KEY_BINS = 1024


def sort_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of every order by priority, urgent ones (null) last, then key: running counts over ranges of keys, and ranks within a range.

    Only the counts, at most KEY_BINS a priority and one for null keys, meet in one task. Null keys come last in their priority.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.expr("nullif(o_orderpriority, '1-URGENT')").alias("v"))
    span = orders.agg(F.min("k").cast("double").alias("lo"), F.max("k").cast("double").alias("hi"))
    at = F.floor((F.col("k").cast("double") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * KEY_BINS)
    binned = orders.crossJoin(F.broadcast(span)).select("k", "v", F.coalesce(at, F.lit(KEY_BINS)).alias("bin"))
    earlier = Window.orderBy(F.asc_nulls_last("v"), "bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = binned.groupBy("v", "bin").agg(F.count("*").alias("n"))
    first = counts.select(F.col("v").alias("of_v"), F.col("bin").alias("of_bin"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("v", "bin").orderBy(F.asc_nulls_last("k")))
    ranked = binned.withColumn("i", inside).join(first, F.col("v").eqNullSafe(F.col("of_v")) & (F.col("bin") == F.col("of_bin")))
    return ranked.select("k", (F.col("before") + F.col("i")).alias("rn"))


FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "rel_asof_join": (as_of, AS_OF_SQL),
    "rel_range_join": (range_join, RANGE_SQL),
    "rel_frame_groups": (frame_groups, GROUPS_SQL),
    "rel_in_subquery": (in_subquery, SHARED["rel_in_subquery"]),
    "rel_sort_nulls": (sort_nulls, SHARED["rel_sort_nulls"]),
    "rel_approximate": (approximate, None),
    "rel_approximate_error": (approximate_error, APPROXIMATE_SQL),
    "rel_prepared": (prepared, "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F'"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    texts = SHARED | {k: v[0] for k, v in PAIRED.items()}
    return {k: lambda spark, sf_dir, t=t: sql(spark, sf_dir, t) for k, t in texts.items()} | {k: f for k, (f, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    duck = {k: re.sub(r"\bSTRING\b", "VARCHAR", t) for k, t in SHARED.items()}
    return duck | {k: v[1] for k, v in PAIRED.items()} | {k: s for k, (_, s) in FRAMES.items() if s}
