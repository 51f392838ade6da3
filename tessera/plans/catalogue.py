"""Registered queries over the star schema and the event stream, and their DuckDB SQL.

Their scope is this project's own choice: no capabilities of another project are matched here.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.vectorized import Digits, FillGaps, digit_sum, least_squares, spread
from tessera.operators.chains import chains
from tessera.operators.dominance import dominance_counts
from tessera.operators.frequent import heavy_hitters
from tessera.operators.joins import as_of_join, range_join, salted_join, small_side
from tessera.operators.overlaps import overlap_totals
from tessera.operators.quantiles import exact_quantiles as quantiles
from tessera.operators.ranks import neighbours, positions, tile, within_before
from tessera.operators.sketches import RANK_ERROR, common, distinct_by_theta, keep_daily, merged, near, only_first, quantile
from tessera.operators.windows import running_sum, sessions, top_k
from tessera.sources.clustered import read_clustered, write_clustered
from tessera.sources.files import load, save
from tessera.sources.records import in_ranges, read_records, stream_records, write_records
from tessera.sources.scratch import scratch, write_down
from tessera.sources.tables import table
from tessera.sources.workers import importable
from tessera.streaming.events import deduplicated, events_stream, run_once, sliding_counts, tumbling_counts, user_sessions, user_totals
from tessera.streaming.stateful import first_of_each, followed_within, silent_users

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its DuckDB SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


REVENUE = "l_extendedprice * (1 - l_discount)"


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_items FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-table equality join and aggregate; the two small tables are broadcast if their size allows it."""
    t = lambda name: table(spark, sf_dir, name)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(small_side(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.expr(REVENUE)), 2).alias("revenue"), F.count("*").alias("n_items"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter pushed to the scan, then partial and final aggregation."""
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.expr(REVENUE)), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT p_partkey, upper(p_brand) AS brand, round(p_retailprice * 1.1, 2) AS with_tax, p_size BETWEEN 10 AND 20 AS middle FROM part WHERE p_type IN ('PROMO', 'SMALL') AND p_retailprice > 700 AND NOT p_brand LIKE '%1'")
def projection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").where(F.col("p_type").isin("PROMO", "SMALL") & (F.col("p_retailprice") > 700) & ~F.col("p_brand").like("%1"))
    return rows.select("p_partkey", F.upper("p_brand").alias("brand"), F.round(F.col("p_retailprice") * 1.1, 2).alias("with_tax"), F.col("p_size").between(10, 20).alias("middle"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are summed before the join, so it moves one row a customer."""
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    joined = table(spark, sf_dir, "customer").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("total"))


@query("SELECT coalesce(c.k, s.k) AS nationkey, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM (SELECT c_nationkey k, count(*) n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c FULL JOIN (SELECT s_nationkey k, count(*) n FROM supplier GROUP BY 1) s ON c.k = s.k")
def full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nationkey", "full").select("nationkey", F.coalesce("customers", F.lit(0)).cast("long").alias("customers"), F.coalesce("suppliers", F.lit(0)).cast("long").alias("suppliers"))


@query("SELECT e.event_id, count(p.event_id) AS earlier FROM events e LEFT JOIN events p ON e.user_id = p.user_id AND p.ts < e.ts AND p.ts >= e.ts - INTERVAL 1 HOUR GROUP BY e.event_id")
def range_join_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events the user had in the hour before each event: an interval join on time buckets."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    spans = events.select("event_id", F.col("user_id").alias("u"), (F.col("t") - 3_600_000_000).alias("low"), F.col("t").alias("high"))
    points = events.select("user_id", "t")
    n = range_join(points, spans, point="t", low="low", high="high", width=3_600_000_000.0, on=F.col("user_id") == F.col("u")).groupBy("event_id").agg(F.count("*").alias("n"))
    return events.select("event_id").join(n, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).cast("long").alias("earlier"))


@query("SELECT e.event_id, p.event_id AS purchase FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts > p.ts")
def as_of_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's last purchase before each event."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'")
    return as_of_join(events.select("event_id", "user_id", "ts"), bought, key="user_id", left_time="ts", right_time="ts", value="event_id", out="purchase", strict=True).select("event_id", "purchase")


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def salted_join_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on a column of five values, which would give five tasks: salted."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    types = events.select("event_type").distinct()
    return salted_join(events, types, "event_type").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
def lateral_top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's two dearest orders. They are ranked in a window with an order of its own: Spark 4.1.2 turns ORDER BY with LIMIT in a lateral subquery into a sort of all rows and a window without an
    order behind a shuffle, which takes any two orders when its blocks come from several executors."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("tessera_customer")
    table(spark, sf_dir, "orders").createOrReplaceTempView("tessera_orders")
    ranked = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST) AS place FROM tessera_orders"
    return spark.sql(f"SELECT c_custkey, o_orderkey FROM tessera_customer, LATERAL (SELECT o_orderkey FROM ({ranked}) WHERE o_custkey = c_custkey AND place <= 2)")


@query("SELECT count(*) AS pairs, round(sum(p.p_retailprice), 2) AS total FROM part p JOIN region r ON p.p_size > r.r_regionkey * 10")
def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inequality join with a table of a handful of rows, broadcast behind a size check."""
    joined = table(spark, sf_dir, "part").join(small_side(table(spark, sf_dir, "region")), F.col("p_size") > F.col("r_regionkey") * 10)
    return joined.agg(F.count("*").alias("pairs"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance, CAST(grouping(r_name) * 2 + grouping(n_name) AS BIGINT) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_region_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(small_side(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(small_side(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.grouping_id().alias("level"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_flag_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return customer.groupingSets([["c_mktsegment"], ["c_nationkey"], []], "c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT props) AS props FROM events GROUP BY event_type")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("props").alias("props"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS parts_near, true AS median_near FROM lineitem GROUP BY l_returnflag")
def approximate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HyperLogLog and quantile estimates held against the exact count and the estimate's rank."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_extendedprice")
    about = rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("about"), F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("median"))
    about = small_side(write_down(about, "about"))
    exact = rows.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"))
    ranks = rows.join(about, "l_returnflag").groupBy("l_returnflag").agg(F.avg((F.col("l_extendedprice") <= F.col("median")).cast("int")).alias("rank"))
    return exact.join(about, "l_returnflag").join(ranks, "l_returnflag").select("l_returnflag", "parts", near(F.col("about"), F.col("parts"), F.col("parts"), 0.06).alias("parts_near"), (F.abs(F.col("rank") - 0.5) <= 0.002).alias("median_near"))


@query("WITH y AS (SELECT DISTINCT CAST(year(l_shipdate) AS BIGINT) AS year, l_partkey FROM lineitem) SELECT a.year, count(*) AS parts, count(b.l_partkey) AS kept, count(*) - count(b.l_partkey) AS fresh, true AS hll_near, true AS theta_near, true AS kept_near, true AS fresh_near, true AS median_near FROM y a LEFT JOIN y b ON b.year = a.year - 1 AND b.l_partkey = a.l_partkey GROUP BY a.year")
def stored_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches kept for each day of shipping and merged for years: parts, those that the year before had too, those it had not, and the median price, each held against the exact value."""
    rows, path = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_partkey", "l_extendedprice"), scratch(spark, "sketches")
    keep_daily(rows, path, time="l_shipdate", key="l_partkey", number="l_extendedprice")
    years = write_down(merged(spark.read.parquet(path), F.year("day").cast("long"), "year"), "years")
    pairs = years.alias("a").join(years.alias("b"), F.col("b.year") == F.col("a.year") - 1, "left")
    none = F.col("b.theta").isNull()
    own = distinct_by_theta(F.col("a.theta"))
    about = pairs.select(F.col("a.year").alias("year"), F.hll_sketch_estimate("a.hll").alias("hll"), own.alias("theta"), F.when(none, 0).otherwise(common(F.col("a.theta"), F.col("b.theta"))).alias("both"), F.when(none, own).otherwise(only_first(F.col("a.theta"), F.col("b.theta"))).alias("only"), (own + F.coalesce(distinct_by_theta(F.col("b.theta")), F.lit(0))).alias("union"), quantile(F.col("a.kll"), 0.5).alias("median"))
    about = small_side(write_down(about, "about-years"))
    year = F.year("l_shipdate").cast("long")
    own = rows.select(year.alias("year"), "l_partkey").distinct()
    exact = own.join(own.select((F.col("year") + 1).alias("year"), "l_partkey", F.lit(1).alias("old")), ["year", "l_partkey"], "left").groupBy("year").agg(F.count("*").alias("parts"), F.count("old").alias("kept"))
    ranks = rows.withColumn("year", year).join(about, "year").groupBy("year").agg(F.avg((F.col("l_extendedprice") <= F.col("median")).cast("int")).alias("rank"), F.count("*").alias("rows"))
    c = F.col
    return exact.join(about, "year").join(ranks, "year").select("year", "parts", "kept", (c("parts") - c("kept")).alias("fresh"), near(c("hll"), c("parts"), c("parts")).alias("hll_near"), near(c("theta"), c("parts"), c("parts")).alias("theta_near"), near(c("both"), c("kept"), c("union")).alias("kept_near"), near(c("only"), c("parts") - c("kept"), c("union")).alias("fresh_near"), (F.abs(c("rank") - 0.5) <= RANK_ERROR + 1 / c("rows")).alias("median_near"))


@query("SELECT l_returnflag, round(median(l_extendedprice), 4) AS median_price, round(quantile_cont(l_quantity, 0.9), 4) AS p90, round(stddev_samp(l_discount), 8) AS spread FROM lineitem GROUP BY l_returnflag")
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles by counting in ranges: no task holds a group's values."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity", "l_discount")
    found = quantiles(rows, "l_returnflag", {"median_price": ("l_extendedprice", 0.5), "p90": ("l_quantity", 0.9)}, more={"spread": F.stddev_samp("l_discount")})
    return found.select("l_returnflag", F.round("median_price", 4).alias("median_price"), F.round("p90", 4).alias("p90"), F.round("spread", 8).alias("spread"))


@query("SELECT sum_of_digits, count(*) AS n FROM (SELECT CAST(list_sum(list_transform(string_split(CAST(p_partkey AS VARCHAR), ''), lambda x: CAST(x AS BIGINT))) AS BIGINT) AS sum_of_digits FROM part) GROUP BY sum_of_digits")
def vectorized_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-defined function in Arrow batches."""
    importable(spark)
    return table(spark, sf_dir, "part").groupBy(digit_sum("p_partkey").alias("sum_of_digits")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 2")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "orders"), 2, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "rank")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = running_sum(table(spark, sf_dir, "events"), key="user_id", time="ts", tie="event_id", value="value", out="running")
    return out.select("event_id", F.round("running", 4).alias("running"))


@query("SELECT event_id, lag(event_type) OVER w AS before, lead(event_type, 2) OVER w AS after_two, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS INTEGER) AS type_rank, round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean_of_three FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours, moving means and dense ranks without a task that sees a user: by places, and by each user's types."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    types = events.select("user_id", F.col("event_type").alias("kind")).distinct()
    types = small_side(write_down(types.select(F.col("user_id").alias("u"), "kind", F.dense_rank().over(W.partitionBy("user_id").orderBy("kind")).alias("type_rank")), "types"))  # one row a user and type
    near_by = neighbours(positions(events, ["user_id"], [F.asc("ts"), F.asc("event_id")]), ["user_id"], "at", {"before": ("event_type", 1), "after_two": ("event_type", -2), "one": ("value", 1), "two": ("value", 2)})
    out = near_by.join(types, F.col("user_id").eqNullSafe(F.col("u")) & F.col("event_type").eqNullSafe(F.col("kind")))
    three = F.filter(F.array("value", "one.value", "two.value"), lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate(three, F.lit(0.0), lambda a, v: a + v), F.size(three))
    return out.select("event_id", F.col("before.value").alias("before"), F.col("after_two.value").alias("after_two"), "type_rank", F.round(mean, 6).alias("mean_of_three"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS last_hour, CAST(ntile(4) OVER (PARTITION BY user_id ORDER BY value, event_id) AS INTEGER) AS quarter, round(percent_rank() OVER (PARTITION BY user_id ORDER BY value, event_id), 8) AS part FROM events")
def window_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame of an hour, tiles and relative ranks, from places within ranges of each user's order."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts")
    hour = within_before(events, ["user_id"], F.unix_micros(F.col("ts").cast("timestamp")), "event_id", 3_600_000_000, out="last_hour")
    placed = positions(events, ["user_id"], [F.asc("value"), F.asc("event_id")])
    part = F.when(F.col("of") > 1, (F.col("at") - 1) / (F.col("of") - 1)).otherwise(0.0)
    return placed.select("event_id", tile(F.col("at"), F.col("of"), 4).alias("quarter"), F.round(part, 8).alias("part")).join(hour, "event_id").select("event_id", "last_hour", "quarter", "part")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def most_expensive_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("nationkey")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).exceptAll(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS O, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS F FROM lineitem GROUP BY l_returnflag")
def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pivot's values are given, so no extra job looks for them."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.round(F.sum("l_quantity"), 2))


@query("SELECT s_suppkey, 'nation' AS field, CAST(s_nationkey AS DOUBLE) AS amount FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier")
def unpivot_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return rows.unpivot(["s_suppkey"], ["nation", "balance"], "field", "amount")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)")
def scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = table(spark, sf_dir, "orders").agg((F.avg("o_totalprice") * 1.9).alias("limit"))
    return table(spark, sf_dir, "orders").where(F.col("o_totalprice") > mean.scalar()).select("o_orderkey")


@query("SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)")
def correlated_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decorrelated by hand: one aggregate and one join."""
    part = table(spark, sf_dir, "part")
    means = part.groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean"))
    return part.join(means, "p_brand").where("p_retailprice > mean").select("p_partkey")


@query("SELECT p_partkey, upper(p_name) AS upper_name, length(p_name) AS n, replace(p_name, 'a', 'A') AS swapped, regexp_replace(p_name, '[0-9]+', '#', 'g') AS masked, lpad(p_brand, 12, '*') AS padded, reverse(p_type) AS backwards, split_part(p_name, '_', 1) AS head, p_name || '/' || p_type AS both_names, md5(p_name) AS digest FROM part")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("upper_name"), F.length("p_name").cast("long").alias("n"), F.replace(c("p_name"), F.lit("a"), F.lit("A")).alias("swapped"), F.regexp_replace("p_name", "[0-9]+", "#").alias("masked"), F.lpad("p_brand", 12, "*").alias("padded"), F.reverse("p_type").alias("backwards"), F.split_part(c("p_name"), F.lit("_"), F.lit(1)).alias("head"), F.concat("p_name", F.lit("/"), "p_type").alias("both_names"), F.md5("p_name").alias("digest"))


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofweek(o_orderdate) + 1 AS weekday, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start, o_orderdate + INTERVAL 90 DAY AS due, CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS BIGINT) AS days FROM orders")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(d).cast("long").alias("y"), F.month(d).cast("long").alias("m"), F.dayofweek(d).cast("long").alias("weekday"), F.date_trunc("month", d).cast("timestamp_ntz").alias("month_start"), (d + F.expr("INTERVAL 90 DAY")).alias("due"), F.datediff(d, F.lit("1995-01-01")).cast("long").alias("days"))


@query("SELECT c_custkey, round(abs(c_acctbal), 2) AS size, CAST(sign(c_acctbal) AS INTEGER) AS side, CAST(floor(c_acctbal) AS BIGINT) AS low, round(sqrt(abs(c_acctbal)), 6) AS root, c_custkey % 7 AS rest, round(ln(abs(c_acctbal) + 1), 6) AS log, greatest(c_custkey, 100) AS most, CASE WHEN c_custkey = 0 THEN NULL ELSE round(c_acctbal / c_custkey, 4) END AS each FROM customer")
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, k = F.col("c_acctbal"), F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(F.abs(b), 2).alias("size"), F.signum(b).cast("int").alias("side"), F.floor(b).alias("low"), F.round(F.sqrt(F.abs(b)), 6).alias("root"), (k % 7).alias("rest"), F.round(F.log(F.abs(b) + 1), 6).alias("log"), F.greatest(k, F.lit(100).cast("long")).alias("most"), F.round(F.try_divide(b, k), 4).alias("each"))


@query("SELECT o_custkey, len(l) AS n, list_sum(list_transform(l, lambda x: x * 2))::BIGINT AS doubled, l[1] AS first_key, list_contains(l, 7) AS has_seven, len(list_filter(l, lambda x: x % 2 = 0)) AS even FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey)")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table behind this has some ten orders a customer, so lists stay small."""
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("l"))
    doubled = F.aggregate(F.transform("l", lambda x: x * 2), F.lit(0).cast("long"), lambda a, x: a + x)
    return lists.select("o_custkey", F.size("l").cast("long").alias("n"), doubled.alias("doubled"), F.col("l")[0].alias("first_key"), F.array_contains("l", F.lit(7).cast("long")).alias("has_seven"), F.size(F.filter("l", lambda x: x % 2 == 0)).cast("long").alias("even"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def json_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_type(props, '$.k') AS kind, json_extract(props, '$.none') IS NULL AS absent FROM events")
def variant_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.parse_json("props")
    kind = F.when(F.schema_of_variant(F.variant_get(v, "$.k", "variant")) == "BIGINT", "UBIGINT")
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(v, "$.k", "bigint").alias("k"), kind.alias("kind"), F.variant_get(v, "$.none", "variant").isNull().alias("absent"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, count(*) AS kinds, CAST(sum(n) AS BIGINT) AS total, coalesce(max(n) FILTER (event_type = 'purchase'), 0) AS purchases, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (n > 10), '') AS frequent FROM c GROUP BY user_id")
def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of counts by type for each user: five entries at most."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x)
    frequent = F.array_join(F.array_sort(F.map_keys(F.map_filter("m", lambda _, n: n > 10))), ",")
    return maps.select("user_id", F.size("m").cast("long").alias("kinds"), total.alias("total"), F.coalesce(F.try_element_at("m", F.lit("purchase")), F.lit(0)).cast("long").alias("purchases"), frequent.alias("frequent"))


@query("SELECT p_partkey, p_name AS part_name, p_size + 1 AS larger FROM part")
def xml_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To XML and back, by path and by schema."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.to_xml(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))).alias("x"))
    return rows.select("p_partkey", F.xpath_string("x", F.lit("/ROW/name")).alias("part_name"), (F.from_xml("x", "name string, size int")["size"] + 1).alias("larger"))


@query("SELECT p_brand, round(max(p_retailprice) - min(p_retailprice), 6) AS price_range FROM part GROUP BY p_brand")
def grouped_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-defined aggregate in Arrow batches."""
    importable(spark)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(spread("p_retailprice"), 6).alias("price_range"))


@query("SELECT l_returnflag, l_linestatus, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope FROM lineitem GROUP BY ALL")
def two_phase_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-defined aggregate in two phases: regression of price on quantity; tasks hand on moments, not rows."""
    importable(spark)
    found = least_squares(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", ["l_quantity"])
    return found.select("l_returnflag", "l_linestatus", "n", F.round("intercept", 4).alias("intercept"), F.round("l_quantity", 6).alias("slope"))


@query("WITH d AS (SELECT user_id, date_trunc('day', ts)::DATE AS day, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY user_id) SELECT s.user_id, s.day, coalesce(n, 0) AS n, n IS NULL AS filled FROM s LEFT JOIN d ON s.user_id = d.user_id AND s.day = d.day")
def filled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function over a table: each user's days without events are added with a count of 0."""
    importable(spark)
    daily = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return FillGaps(daily.asTable().partitionBy("user_id").orderBy("day"), F.lit("day"), F.lit("n"))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '1998-06-30' AND l_extendedprice BETWEEN 20000 AND 40000 GROUP BY l_returnflag")
def clustered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in files near in date and price; a query over both opens the files that can match."""
    rows, path = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", "l_extendedprice", "l_quantity"), scratch(spark, "clustered")
    write_clustered(rows, path, by=("l_shipdate", "l_extendedprice"), files=32)
    found = read_clustered(spark, path, rows.schema, where=[("l_shipdate", datetime(1998, 3, 1), datetime(1998, 6, 30)), ("l_extendedprice", 20000.0, 40000.0)])
    return found.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT s_suppkey, CAST(i AS INTEGER) AS place, CAST(substr(CAST(s_suppkey AS VARCHAR), CAST(i + 1 AS INTEGER), 1) AS INTEGER) AS digit FROM supplier, LATERAL (SELECT unnest(range(length(CAST(s_suppkey AS VARCHAR)))) AS i) t")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user-defined table function, joined laterally."""
    importable(spark)
    return table(spark, sf_dir, "supplier").select("s_suppkey").lateralJoin(Digits(F.col("s_suppkey").outer()))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("SELECT s AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR])::TIMESTAMP AS s FROM events) GROUP BY s")
def sliding_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two hours, one begun each hour."""
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n, round(max(value), 4) AS most FROM s GROUP BY user_id, k")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessions(table(spark, sf_dir, "events"), key="user_id", time="ts", gap="30 minutes", aggregates=[F.count("*").alias("n"), F.round(F.max("value"), 4).alias("most")])
    return out.select("user_id", "session_start", "n", "most")


_SPANS = "SELECT user_id, min(ts) AS a, max(ts) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k UNION ALL SELECT -1, min(ts), max(ts) FROM events"


@query(f"WITH s AS ({_SPANS}) SELECT x.user_id, count(*) AS pairs, count(DISTINCT y.user_id) AS users, CAST(round(sum(epoch_us(least(x.b, y.b)) - epoch_us(greatest(x.a, y.a)))) AS BIGINT) AS together FROM s x JOIN s y ON x.user_id <> y.user_id AND x.a <= y.b AND y.a <= x.b GROUP BY x.user_id")
def overlapping_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of different users that overlap, and one span over all of them: from single moments to a month."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("t"))
    by_user = events.repartition("user_id")  # as two numbers: a session window would shuffle four more for each event
    found = sessions(by_user, key="user_id", time="t", gap="30 minutes", aggregates=[F.min("t").alias("first"), F.max("t").alias("last")])
    every = events.agg(F.lit(-1).cast("long").alias("user_id"), F.min("t").alias("first"), F.max("t").alias("last"))
    spans = found.select("user_id", "first", "last").union(every).select("user_id", F.unix_micros("first").alias("a"), (F.unix_micros("last") - F.unix_micros("first") + 1).alias("length"))
    spans = write_down(spans, "session-spans").select("user_id", "a", (F.col("a") + F.col("length")).alias("b"))
    found = overlap_totals(spans, key="user_id", span=("a", "b"))
    return found.select("user_id", "pairs", F.col("partners").alias("users"), (F.col("together") - F.col("pairs")).alias("together"))


@query("SELECT o_orderkey, CAST((SELECT count(*) FROM orders p WHERE p.o_orderdate < o.o_orderdate AND p.o_totalprice > o.o_totalprice) AS BIGINT) AS older_and_dearer FROM orders o")
def older_and_dearer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders are older and dearer than each: a join by two inequalities without its pairs."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    by = ("o_orderdate", "o_totalprice")
    return dominance_counts(orders, orders, left_by=by, right_by=by, out="older_and_dearer").select("o_orderkey", "older_and_dearer")


@query("SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY l_quantity HAVING count(*) >= 0.02 * (SELECT count(*) FROM lineitem)")
def frequent_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of at least a fiftieth of all lines."""
    return heavy_hitters(table(spark, sf_dir, "lineitem"), "l_quantity", 0.02)


_NEXT = "SELECT a, b FROM (SELECT o_orderkey AS a, lead(o_orderkey) OVER w AS b, lead(o_orderdate) OVER w - o_orderdate <= INTERVAL 30 DAY AS soon FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE soon"


@query(f"WITH RECURSIVE l AS ({_NEXT}), walk(head, last, length) AS (SELECT a, b, 1::BIGINT FROM l WHERE a NOT IN (SELECT b FROM l) UNION ALL SELECT head, b, length + 1 FROM walk JOIN l ON a = last) SELECT head, last, length, 'end' AS ends FROM walk WHERE last NOT IN (SELECT a FROM l)")
def order_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of orders of a customer, each within 30 days of the one before."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    nexts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b"), (F.lead("o_orderdate").over(w) <= F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("soon"))
    return chains(write_down(nexts.where("soon").select("a", "b"), "order-links"))


@query(ORACLES["tumbling_day"])
def stream_tumbling_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily counts as a stream with a watermark, in complete mode."""
    return run_once(tumbling_counts(events_stream(spark, sf_dir)), "complete", "stream-day")


@query("SELECT * FROM (" + ORACLES["tumbling_day"] + ") WHERE day + INTERVAL 25 HOUR <= (SELECT max(ts) FROM events)")
def stream_closed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in append mode: each day once, when the watermark has passed its end; open days are not given."""
    return run_once(tumbling_counts(events_stream(spark, sf_dir)), "append", "stream-closed")


@query(ORACLES["sliding_hours"])
def stream_sliding_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_once(sliding_counts(events_stream(spark, sf_dir)), "complete", "stream-sliding")


@query("SELECT * EXCLUDE (last_ts) FROM (" + ORACLES["session_windows"].replace("round(max(value), 4) AS most", "round(max(value), 4) AS most, max(ts) AS last_ts") + ") WHERE last_ts + INTERVAL 90 MINUTE <= (SELECT max(ts) FROM events)")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that ended over an hour (the watermark) before the last event."""
    return run_once(user_sessions(events_stream(spark, sf_dir)), "append", "stream-sessions")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First events of each key, from a watermark that covers all of the stream."""
    first = deduplicated(events_stream(spark, sf_dir), ["user_id", "event_type"], "60 days")
    return run_once(first.select("user_id", "event_type"), "append", "stream-dedup")


@query("SELECT user_id, count(*) AS n, max(value) AS most FROM events GROUP BY user_id")
def stream_user_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arbitrary state for each user; a user's last update is the one with the largest count."""
    updates = run_once(user_totals(events_stream(spark, sf_dir)), "update", "stream-totals")
    return updates.groupBy("user_id").agg(F.max(F.struct("n", "most")).alias("last")).select("user_id", "last.n", "last.most")


_RUNS = "SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new, lead(ts) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(f"SELECT user_id, max(ts) AS last_seen, count(*) AS n FROM ({_RUNS}) GROUP BY user_id, run HAVING max(ts) + INTERVAL 7 HOUR < (SELECT max(ts) FROM events)")
def stream_silent_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that have been silent for six hours, each time a timer finds it out, behind a watermark of an hour."""
    return run_once(silent_users(events_stream(spark, sf_dir)), "append", "stream-silent")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def stream_first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type, from state that expires a day later."""
    return run_once(first_of_each(events_stream(spark, sf_dir), key="user_id", value="event_type", id_col="event_id"), "append", "stream-first", one_batch=True)


@query("WITH c AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase'), w AS (SELECT least((SELECT max(ts) FROM c), (SELECT max(ts) FROM p)) - INTERVAL 1 HOUR AS mark) SELECT c.event_id, p.event_id AS purchase FROM c LEFT JOIN p ON c.user_id = p.user_id AND p.ts > c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR, w WHERE p.event_id IS NOT NULL OR c.ts + INTERVAL 1 HOUR < mark")
def stream_click_to_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the purchases that follow within an hour, as a join of two streams; clicks without one come behind the watermark."""
    clicks, bought = (events_stream(spark, sf_dir).where(F.col("event_type") == kind) for kind in ("click", "purchase"))
    return run_once(followed_within(clicks, bought, key="user_id", time="ts", id_col="event_id", out="purchase"), "append", "stream-followed")


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, min(md5(text)) AS least FROM documents WHERE n_chars >= 5000 AND n_chars < 20000 GROUP BY ALL")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through record files dealt in ranges of text length: the conditions leave out the files of other lengths."""
    path = scratch(spark, "records")
    documents = table(spark, sf_dir, "documents")
    write_records(in_ranges(documents, "n_chars", size=F.octet_length("text"), tie="doc_id"), path, keys=["n_chars", "lang"])
    rows = read_records(spark, path, where=[("n_chars", ">=", 5000), ("n_chars", "<", 20000)])
    return rows.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.min(F.md5("text")).alias("least"))


@query("SELECT event_id, user_id, ts FROM events WHERE event_type <> 'view'")
def stream_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record files as a stream with offsets: a run over one half of the events, then a run that goes on from there when the rest has come."""
    path, out, state = (scratch(spark, f"stream-records-{x}") for x in ("in", "out", "state"))
    events = table(spark, sf_dir, "events").where("event_type <> 'view'").select("event_id", "user_id", "ts")
    first = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    for part in (first, ~first):
        write_records(events.where(part), path)
        stream_records(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(out)


def _through(kind: str, name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, path = table(spark, sf_dir, name), scratch(spark, f"files-{kind}")
        save(rows, path, kind)
        return load(spark, path, rows.schema, kind)

    run.__name__ = f"through_{kind}"
    return run


for _kind, _name in (("parquet", "supplier"), ("orc", "customer"), ("json", "events"), ("csv", "orders")):
    query(f"SELECT * FROM {_name}")(_through(_kind, _name))
