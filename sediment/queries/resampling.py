"""Resampling tests, intervals, smoothing and rank tests on customers, orders and labelled documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import resampling as R
from ..registry import query, table

DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def drawn_sql(rounds: int) -> str:
    return f"""x AS (SELECT unit, value, g, r FROM u, (SELECT unnest(range(0, {rounds + 1})) AS r)),
d AS (SELECT unit, value, r, CASE WHEN r = 0 THEN g ELSE row_number() OVER (PARTITION BY r ORDER BY {DRAW.format("unit || '-' || r")}, unit) <= (SELECT count(*) FROM u WHERE g) END AS drawn FROM x)"""


BALANCES = "u AS (SELECT c_custkey AS unit, round(c_acctbal, 2) AS value, c_mktsegment = 'BUILDING' AS g FROM customer)"


def balances(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("unit"), F.round("c_acctbal", 2).alias("value"), (F.col("c_mktsegment") == "BUILDING").alias("g"))


@query(127, sql=f"""WITH {BALANCES}, {drawn_sql(100)}, m AS (SELECT r, avg(value) FILTER (drawn) - avg(value) FILTER (NOT drawn) AS d FROM d GROUP BY r), s AS (SELECT d AS difference FROM m WHERE r = 0)
SELECT round(difference, 6) AS difference, round((count(*) FILTER (abs(d) >= abs(difference) - 1e-9) + 1) / (count(*) + 1)::DOUBLE, 6) AS p FROM m, s WHERE r > 0 GROUP BY difference""")
def permutation_segment(spark, d):
    return R.permutation_test(balances(spark, d), "value", "g", 100).select(*r6("difference", "p"))


@query(128, sql=f"""WITH {BALANCES}, {drawn_sql(60)}, i AS (SELECT DISTINCT o_custkey AS unit, o_orderpriority AS item FROM orders), z AS (SELECT r, count(*) FILTER (drawn) AS n, count(*) FILTER (NOT drawn) AS m FROM d GROUP BY r),
h AS (SELECT r, item, count(*) FILTER (drawn) AS a, count(*) FILTER (NOT drawn) AS b FROM i JOIN d USING (unit) GROUP BY 1, 2), y AS (SELECT r, item, abs(a / n::DOUBLE - b / m::DOUBLE) AS gap FROM h JOIN z USING (r)), t AS (SELECT r, max(gap) AS most FROM y WHERE r > 0 GROUP BY r)
SELECT item, round(gap, 6) AS gap, round((count(*) FILTER (most >= gap - 1e-9) + 1) / (count(*) + 1)::DOUBLE, 6) AS p FROM y, t WHERE y.r = 0 GROUP BY 1, gap""")
def max_statistic_priorities(spark, d):
    items = table(spark, d, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("item"))
    return R.max_statistic(items, balances(spark, d), "g", 60).select("item", *r6("gap", "p"))


def bootstrap_sql(source: str, rounds: int) -> str:
    copies = " + ".join(f"(u >= {p})::INT" for p in R.POISSON)
    return f"""WITH per AS ({source}), b AS (SELECT s, n, r, {DRAW.format("c || '-' || r")} / 4294967296.0::DOUBLE AS u FROM per, (SELECT unnest(range(1, {rounds + 1})) AS r)), m AS (SELECT sum(({copies}) * s) / sum(({copies}) * n) AS m FROM b GROUP BY r)
SELECT (SELECT count(*) FROM per) AS clusters, round((SELECT sum(s) / sum(n) FROM per), 5) AS mean, round(quantile_cont(m, 0.025), 5) AS low, round(quantile_cont(m, 0.975), 5) AS high FROM m"""


@query(129, sql=bootstrap_sql("SELECT c_nationkey AS c, sum(round(c_acctbal, 2)) AS s, count(*) AS n FROM customer GROUP BY 1", 200))
def cluster_bootstrap(spark, d):
    rows = table(spark, d, "customer").withColumn("v", F.round("c_acctbal", 2))
    return R.bootstrap_mean(rows, "v", "c_nationkey", 200).select("clusters", *[F.round(c, 5).alias(c) for c in ("mean", "low", "high")])


@query(sql=bootstrap_sql("SELECT s_suppkey AS c, sum(round(s_acctbal, 2)) AS s, count(*) AS n FROM supplier GROUP BY 1", 100))
def bootstrap_interval(spark, d):
    rows = table(spark, d, "supplier").withColumn("v", F.round("s_acctbal", 2))
    return R.bootstrap_mean(rows, "v", "s_suppkey", 100).select("clusters", *[F.round(c, 5).alias(c) for c in ("mean", "low", "high")])


@query(131, sql="""WITH p AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS x, avg(round(o_totalprice, 2)) AS y FROM orders GROUP BY 1), k AS (SELECT a.x AS x0, a.y AS y0, b.x - a.x AS dx, b.y AS y1, row_number() OVER (PARTITION BY a.x ORDER BY abs(b.x - a.x), b.x) AS r FROM p a CROSS JOIN p b),
w AS (SELECT *, pow(1 - pow(abs(dx) / (max(abs(dx)) OVER (PARTITION BY x0) * 1.000001), 3), 3) AS w FROM k WHERE r <= 15)
SELECT x0::BIGINT AS month, round((sum(w * dx * dx) * sum(w * y1) - sum(w * dx) * sum(w * dx * y1)) / (sum(w) * sum(w * dx * dx) - sum(w * dx) * sum(w * dx)), 3) AS fit FROM w GROUP BY x0""")
def smoothed_prices(spark, d):
    o = table(spark, d, "orders")
    months = o.groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month")).agg(F.avg(F.round("o_totalprice", 2)).alias("price"))
    return R.smoothed(months, "month", "price", 15).select(F.col("month").cast("long").alias("month"), F.round("fit", 3).alias("fit"))


@query(112, sql="""WITH k AS (SELECT lang, quality = 0 AS hit, row_number() OVER (PARTITION BY lang ORDER BY length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) DESC, doc_id) AS r FROM documents JOIN labels USING (doc_id)),
h AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY lang ORDER BY r ROWS UNBOUNDED PRECEDING) AS hits FROM k)
SELECT lang, count(*) AS n, count(*) FILTER (hit) AS relevant, round(sum(CASE WHEN hit THEN hits / r::DOUBLE END) / count(*) FILTER (hit), 6) AS average_precision FROM h GROUP BY 1""")
def ranking_precision(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("marks", F.regexp_count("text", F.lit("[#*$%&|<>]")))
    return R.average_precision(both, "lang", [F.desc("marks"), F.col("doc_id")], F.col("quality") == 0).select("lang", "n", "relevant", *r6("average_precision"))


@query(112, sql="""WITH x AS (SELECT o_custkey, o_orderpriority AS k, round(o_totalprice, 2) AS p, lag(round(o_totalprice, 2)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS q FROM orders),
c AS (SELECT k, count(*) FILTER (p > q) AS more, count(*) FILTER (p < q) AS less FROM x GROUP BY 1)
SELECT k AS priority, more, less, round(least(1, 2 * list_sum(list_transform(range(0, least(more, less) + 1), lambda i: exp(lgamma(more + less + 1.0) - lgamma(i + 1.0) - lgamma(more + less - i + 1.0) - (more + less) * ln(2))))), 6) AS p FROM c""")
def sign_tests(spark, d):
    o = table(spark, d, "orders").withColumn("p", F.round("o_totalprice", 2))
    q = F.lag("p").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    counts = o.withColumn("q", q).groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.when(F.col("p") > F.col("q"), 1)).alias("more"), F.count(F.when(F.col("p") < F.col("q"), 1)).alias("less"))
    return counts.select("priority", "more", "less", F.round(R.sign_test("more", "less"), 6).alias("p"))
