"""Views, lookups, samples, windows and set operations on the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..registry import query, table


def orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"), "o_orderdate", "o_orderpriority")


@query(2, 3, 4, 39, 41, sql="""SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS price FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW' AND year(o_orderdate) >= 1996 AND year(o_orderdate) < 1999""")
def scoped_view(spark, d):
    rows = orders(spark, d).withColumn("y", F.year("o_orderdate"))
    rows = R.scope(rows, "o_orderpriority", ["5-LOW"], "y", 1996, 1999)
    return rows.where(R.predicate({"o_orderstatus": ["F", "O"]})).select("o_orderkey", "o_orderstatus", "price")


@query(4, sql="SELECT o_orderkey FROM orders WHERE false")
def empty_list_predicate(spark, d):
    return orders(spark, d).where(R.predicate({"o_orderstatus": []})).select("o_orderkey")


@query(40, 42, 250, 251, sql="""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def semi_and_anti(spark, d):
    o = orders(spark, d).withColumnRenamed("o_custkey", "c_custkey")
    return table(spark, d, "customer").join(o.where("o_orderstatus = 'F'"), "c_custkey", "left_semi").join(o.where("o_orderpriority = '1-URGENT'"), "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query(5, sql="SELECT i.position, o_orderkey, o_orderstatus FROM (VALUES (0, 96), (1, 3), (2, 33), (3, 1)) AS i(position, k) JOIN orders ON o_orderkey = k")
def lookup_by_id(spark, d):
    ids = spark.createDataFrame([(0, 96), (1, 3), (2, 33), (3, 1)], "position int, o_orderkey long")
    return R.lookup(orders(spark, d), ids, "o_orderkey", "position").select("position", "o_orderkey", "o_orderstatus")


@query(6, sql="SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def neighbouring_rows(spark, d):
    return R.neighbours(orders(spark, d), "o_custkey", "o_orderkey", "o_orderkey").select("o_custkey", "o_orderkey", "previous", "next")


@query(7, sql="SELECT o_orderkey, coalesce(array_to_string(array_agg(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), ','), '') AS following FROM orders")
def following_rows(spark, d):
    return R.following(orders(spark, d), "o_custkey", "o_orderkey", "o_orderkey", 3).select("o_orderkey", F.concat_ws(",", F.col("following").cast("array<string>")).alias("following"))


@query(46, sql="""WITH s AS (SELECT o_custkey AS c, min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM orders GROUP BY 1)
SELECT x.c AS left_id, y.c AS right_id, CASE WHEN x.b < y.a THEN 'before' WHEN y.b < x.a THEN 'after' ELSE 'undetermined' END AS ordering
FROM s x JOIN s y ON y.c = x.c + 1""")
def interval_order(spark, d):
    s = orders(spark, d).groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    x, y = s.select(F.col("o_custkey").alias("left_id"), F.col("a").alias("xa"), F.col("b").alias("xb")), s.select(F.col("o_custkey").alias("right_id"), F.col("a").alias("ya"), F.col("b").alias("yb"))
    return x.join(y, F.col("right_id") == F.col("left_id") + 1).select("left_id", "right_id", R.interval_order(F.col("xa"), F.col("xb"), F.col("ya"), F.col("yb")).alias("ordering"))


PERIODS = [("early", 1996, 1998), ("late", 1998, 2000)]


@query(78, 80, sql="""SELECT CASE WHEN y < 1998 THEN 'early' ELSE 'late' END AS clamped, CASE WHEN y >= 1996 AND y < 1998 THEN 'early' WHEN y >= 1998 AND y < 2000 THEN 'late' END AS strict, count(*) AS n
FROM (SELECT year(o_orderdate) AS y FROM orders) GROUP BY 1, 2""")
def period_edges(spark, d):
    y = F.year("o_orderdate")
    return orders(spark, d).groupBy(R.period(y, PERIODS, "clamp_both").alias("clamped"), R.period(y, PERIODS).alias("strict")).agg(F.count(F.lit(1)).alias("n"))


@query(41, sql="""WITH s AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)
SELECT 'before' AS side, count(*) AS n FROM s WHERE b < TIMESTAMP '1998-01-01' UNION ALL SELECT 'after', count(*) FROM s WHERE a >= TIMESTAMP '1998-01-01'""")
def time_machine_split(spark, d):
    s = orders(spark, d).groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    before, after = R.time_split(s, "a", "b", cut)
    return before.agg(F.count(F.lit(1)).alias("n")).select(F.lit("before").alias("side"), "n").union(after.agg(F.count(F.lit(1)).alias("n")).select(F.lit("after").alias("side"), "n"))


@query(225, 226, 253, sql="SELECT o_custkey, o_orderkey, price FROM (SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def earliest_per_group(spark, d):
    return R.keep_first(orders(spark, d), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "price")


@query(247, sql="SELECT o_orderpriority, rank, o_orderkey FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY round(o_totalprice, 2) DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 5")
def top_k_per_group(spark, d):
    return R.top_k(orders(spark, d), ["o_orderpriority"], [F.desc("price"), F.col("o_orderkey")], 5).select("o_orderpriority", "rank", "o_orderkey")


@query(242, sql="""SELECT o_orderpriority, o_orderkey, turn FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY round(o_totalprice, 2) DESC, o_orderkey)::INT AS turn FROM orders)
ORDER BY turn, o_orderpriority LIMIT 12""")
def round_robin(spark, d):
    return R.round_robin(orders(spark, d), "o_orderpriority", [F.desc("price"), F.col("o_orderkey")], 12).select("o_orderpriority", "o_orderkey", "turn")


@query(53, sql="""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, o_orderkey FROM r WHERE n <= 4 OR i = 0 OR (i * 3 + n - 2) // greatest(n - 1, 1) > ((i - 1) * 3 + n - 2) // greatest(n - 1, 1)""")
def even_sample(spark, d):
    return R.even_sample(orders(spark, d), ["o_custkey"], ["o_orderkey"], 4).select("o_custkey", "o_orderkey")


@query(54, sql="SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 3 = 0")
def strided_sample(spark, d):
    return R.strided_sample(orders(spark, d), ["o_custkey"], ["o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query(326, sql="""SELECT DISTINCT o_orderkey, o_orderstatus FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY round(o_totalprice, 2) DESC, o_orderkey) AS a,
row_number() OVER (PARTITION BY o_orderstatus ORDER BY round(o_totalprice, 2) DESC, o_orderkey) AS b FROM orders) WHERE a <= 50 OR b <= 10""")
def stratified_frame(spark, d):
    return R.stratified_frame(orders(spark, d), "o_orderstatus", [F.desc("price"), F.col("o_orderkey")], 50, 10).select("o_orderkey", "o_orderstatus")


@query(327, sql="""WITH r AS (SELECT c_custkey, c_nationkey, count(*) OVER (PARTITION BY c_nationkey) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('s7|' || c_custkey)) AS p FROM customer)
SELECT c_custkey, n > 1 AND p <= greatest(1, least(round(n * 0.2), n - 1)) AS held FROM r""")
def cluster_hold_out(spark, d):
    return R.hold_out(table(spark, d, "customer"), "c_nationkey", "c_custkey", 0.2, "s7").select("c_custkey", "held")


@query(30, 241, sql="""WITH s AS (SELECT source, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source), r AS (SELECT source, chars, sum(chars) OVER (ORDER BY chars DESC, source ROWS UNBOUNDED PRECEDING)::BIGINT AS running, sum(chars) OVER () AS total FROM s)
SELECT source, chars, running FROM r WHERE running <= 1000000""")
def budget_selection(spark, d):
    s = table(spark, d, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("chars"))
    return R.within_budget(s, [F.desc("chars"), F.col("source")], "chars", 1_000_000)


@query(50, 248, sql="SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 100")
def paged(spark, d):
    return R.page(orders(spark, d), [F.col("o_orderdate"), F.col("o_orderkey")], 100, 25).select("o_orderkey", "o_custkey")


@query(43, sql="SELECT count(*) AS leaked FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def leakage_check(spark, d):
    o = orders(spark, d)
    return R.leaks(o.where("o_orderstatus <> 'P'"), o.where("o_orderstatus = 'P'"), "o_orderkey").agg(F.count(F.lit(1)).alias("leaked"))


@query(94, sql="""SELECT 'segment' AS facet, c_mktsegment AS value, count(DISTINCT c_custkey) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'nation', c_nationkey::VARCHAR, count(DISTINCT c_custkey) FROM customer GROUP BY 2""")
def facet_counts(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return R.facets(c, ["segment", "nation"], "c_custkey")


@query(113, sql="SELECT o_orderpriority, o_orderstatus, grouping(o_orderpriority)::INT * 2 + grouping(o_orderstatus)::INT AS level, count(*) AS n, round(sum(round(o_totalprice, 2)), 2) AS total FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def cube_orders(spark, d):
    return orders(spark, d).cube("o_orderpriority", "o_orderstatus").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query(113, sql="SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rollup_orders(spark, d):
    return orders(spark, d).rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(252, sql="""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1997)
SELECT k, 'a' AS only_in FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'b' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""")
def symmetric_difference(spark, d):
    o = orders(spark, d).withColumn("y", F.year("o_orderdate")).withColumnRenamed("o_custkey", "k")
    return R.symmetric_difference(o.where("y = 1996").select("k"), o.where("y = 1997").select("k"))


@query(73, 75, 77, 79, sql="SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars, sum(('0x' || substr(md5(text), 1, 8))::BIGINT)::BIGINT AS digest FROM documents GROUP BY source")
def corpus_signatures(spark, d):
    return R.signature(table(spark, d, "documents"), "source", "text")


@query(176, 77, sql="SELECT source, 'changed' AS change FROM documents WHERE doc_id % 97 = 3 GROUP BY source")
def changed_sources(spark, d):
    docs = table(spark, d, "documents")
    edited = docs.withColumn("text", F.when(F.col("doc_id") % 97 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return R.changed(R.signature(docs, "source", "text"), R.signature(edited, "source", "text"), "source")


@query(76, sql="SELECT o_custkey, max(year(o_orderdate)) AS last_start, min(year(o_orderdate)) AS first_end, count(*) AS n FROM orders GROUP BY 1")
def group_spans(spark, d):
    y = F.year("o_orderdate").cast("long")
    return orders(spark, d).groupBy("o_custkey").agg(F.max(y).alias("last_start"), F.min(y).alias("first_end"), F.count(F.lit(1)).alias("n"))


@query(51, 56, sql="SELECT n_name, r_name, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def dimension_counts(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name", "r_name").agg(F.count("c_custkey").alias("customers"))


@query(67, 101, sql="""SELECT n_name, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1""")
def missing_sources(spark, d):
    present = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    nations = table(spark, d, "nation").join(present, "n_nationkey", "left_anti")
    return orders(spark, d).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"))


@query(62, 192, sql="""WITH s AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS t, round(o_totalprice, 2) AS p FROM orders)
SELECT child, parent FROM (SELECT x.k AS child, y.k AS parent, row_number() OVER (PARTITION BY x.k ORDER BY abs(x.p - y.p), y.k) AS r FROM s x JOIN s y ON x.c = y.c AND y.t < x.t) WHERE r = 1""")
def earlier_parent(spark, d):
    s = orders(spark, d).select("o_custkey", "o_orderkey", "o_orderdate", "price")
    y = s.select("o_custkey", F.col("o_orderkey").alias("parent"), F.col("o_orderdate").alias("t"), F.col("price").alias("p"))
    best = s.join(y, "o_custkey").where("t < o_orderdate").groupBy(F.col("o_orderkey").alias("child")).agg(F.min(F.struct(F.abs(F.col("price") - F.col("p")).alias("gap"), "parent")).alias("m"))
    return best.select("child", "m.parent")


@query(114, sql=None)
def approximate_counts(spark, d):
    """Sketches, for when exact distinct counts and percentiles cost too much: within the stated error."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_quantity", 0.5, 1000).alias("median"))
