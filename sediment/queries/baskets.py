"""Baskets on the order tables: an order is a basket, the brands of its parts are the items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baskets as B
from ..registry import query, table

BRANDS = "SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey"
PAIRS = f"""
b AS ({BRANDS}), s AS (SELECT item, count(*) AS c FROM b GROUP BY item), t AS (SELECT count(DISTINCT basket) AS n FROM b),
k AS (SELECT x.item AS a, y.item AS b, count(*) AS k FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2),
p AS (SELECT k.a, k.b, k.k, u.c AS na, v.c AS nb, t.n, k.k * 1.0::DOUBLE * t.n / (u.c * v.c) AS lift FROM k JOIN s u ON u.item = k.a JOIN s v ON v.item = k.b, t)"""


def brands(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("item")).distinct()


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query(59, 88, 197, 245, sql=f"""WITH {PAIRS}
SELECT a, b, k, na, nb, n, round(k / na::DOUBLE, 6) AS confidence_ab, round(k / nb::DOUBLE, 6) AS confidence_ba, round(lift, 6) AS lift,
  round(log2(lift), 6) AS pmi, round(log2(lift) / -log2(k / n::DOUBLE), 6) AS npmi,
  round(k::DOUBLE * (n - na - nb + k) / ((na - k)::DOUBLE * (nb - k)), 6) AS odds_ratio FROM p""")
def basket_pairs(spark, d):
    return B.pair_table(brands(spark, d)).select("a", "b", "k", "na", "nb", "n", *r6("confidence_ab", "confidence_ba", "lift", "pmi", "npmi", "odds_ratio"))


@query(120, 126, 88, sql=f"""WITH {PAIRS},
f AS (SELECT a, b, least(1.0, list_sum(list_transform(range(k, least(na, nb) + 1), lambda x: exp(lgamma(na + 1) + lgamma(n - na + 1) + lgamma(nb + 1) + lgamma(n - nb + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(na - x + 1) - lgamma(nb - x + 1) - lgamma(n - na - nb + x + 1))))) AS p FROM p),
r AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM f),
l AS (SELECT max(p) AS limit_p FROM r WHERE p <= 0.05 * i / m)
SELECT a, b, round(p, 6) AS p, coalesce(p <= limit_p, false) AS significant FROM f, l""")
def basket_pairs_fisher_bh(spark, d):
    return B.with_tests(B.pair_table(brands(spark, d))).select("a", "b", *r6("p"), "significant")


@query(196, sql=f"""WITH {PAIRS}
SELECT lhs, rhs, support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM (
  SELECT a AS lhs, b AS rhs, k AS support, k / na::DOUBLE AS confidence, lift FROM p UNION ALL SELECT b, a, k, k / nb::DOUBLE, lift FROM p) WHERE confidence >= 0.16""")
def pair_rules(spark, d):
    return B.rules(B.pair_table(brands(spark, d)), 0.16).select("lhs", "rhs", "support", *r6("confidence", "lift"))


@query(195, 135, sql=f"""WITH b AS ({BRANDS}), t AS (SELECT count(DISTINCT basket) AS n FROM b),
x AS (SELECT basket, item AS lhs, item AS i1, item AS i2 FROM b UNION ALL SELECT u.basket, u.item || '+' || v.item, u.item, v.item FROM b u JOIN b v ON u.basket = v.basket AND u.item < v.item),
sx AS (SELECT lhs, count(*) AS c FROM x GROUP BY lhs), sy AS (SELECT item, count(*) AS c FROM b GROUP BY item),
j AS (SELECT x.lhs, b.item AS rhs, count(*) AS support FROM x JOIN b ON x.basket = b.basket AND b.item <> x.i1 AND b.item <> x.i2 GROUP BY 1, 2)
SELECT j.lhs, rhs, support, round(support / sx.c::DOUBLE, 6) AS confidence, round(support / sx.c::DOUBLE / (sy.c / t.n::DOUBLE), 6) AS lift
FROM j JOIN sx ON sx.lhs = j.lhs JOIN sy ON sy.item = rhs, t WHERE support >= 5 AND sx.c >= 5 AND support / sx.c::DOUBLE >= 0.2""")
def association_rules(spark, d):
    return B.association_rules(brands(spark, d), 5, 0.2).select("lhs", "rhs", "support", *r6("confidence", "lift"))


@query(89, sql=f"""WITH b AS ({BRANDS}), h AS (SELECT basket FROM b WHERE item = 'Brand#5')
SELECT x.item AS a, y.item AS b, count(*) AS k FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item
WHERE x.item <> 'Brand#5' AND y.item <> 'Brand#5' AND x.basket IN (SELECT basket FROM h) GROUP BY 1, 2 HAVING count(*) >= 5""")
def basket_triples(spark, d):
    return B.triples(brands(spark, d), "Brand#5")


@query(197, 246, sql=f"""WITH {PAIRS} SELECT CASE WHEN a = 'Brand#5' THEN b ELSE a END AS partner, k, round(lift, 6) AS lift FROM p
WHERE a = 'Brand#5' OR b = 'Brand#5' ORDER BY k DESC, partner LIMIT 10""")
def pair_partners(spark, d):
    return B.partners(B.pair_table(brands(spark, d)), "Brand#5", 10).select("partner", "k", *r6("lift"))


CORE = ["Brand#5", "Brand#12", "Brand#13", "Brand#21"]


@query(69, 202, sql=f"""WITH b AS ({BRANDS}), c AS (SELECT basket, count(*) FILTER (item IN ('Brand#5', 'Brand#12', 'Brand#13', 'Brand#21')) AS held,
  count(*) FILTER (item NOT IN ('Brand#5', 'Brand#12', 'Brand#13', 'Brand#21')) AS extra FROM b GROUP BY basket)
SELECT basket, held, extra, 4 - held AS missing FROM c WHERE held >= 2 AND extra <= 3""")
def family_containment(spark, d):
    return B.family(brands(spark, d), CORE, 0.5, 3).select("basket", "held", "extra", F.col("missing").cast("long").alias("missing"))


@query(65, 117, sql=f"""WITH b AS ({BRANDS}), z AS (SELECT basket, count(*) AS size FROM b GROUP BY basket),
s AS (SELECT q.basket AS query, o.basket, count(*) AS shared FROM b q JOIN b o ON q.item = o.item AND q.basket <> o.basket GROUP BY 1, 2),
j AS (SELECT s.*, shared / (a.size + c.size - shared)::DOUBLE AS jaccard FROM s JOIN z a ON a.basket = s.basket JOIN z c ON c.basket = s.query)
SELECT query, basket, shared, round(jaccard, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY jaccard DESC, basket) AS r FROM j) WHERE r = 1""")
def nearest_basket(spark, d):
    return B.nearest(brands(spark, d)).select("query", "basket", "shared", *r6("jaccard"))


@query(203, sql=f"""WITH b AS ({BRANDS}) SELECT x.item AS a, y.item AS b, count(*) AS k FROM b x JOIN b y ON x.basket = y.basket
WHERE (x.item, y.item) IN (('Brand#5', 'Brand#1'), ('Brand#21', 'Brand#4'), ('Brand#12', 'Brand#13')) GROUP BY 1, 2""")
def incompatible_pairs(spark, d):
    rules = spark.createDataFrame([("Brand#5", "Brand#1"), ("Brand#21", "Brand#4"), ("Brand#12", "Brand#13")], "a string, b string")
    return B.forbidden_pairs(brands(spark, d), rules)


SHARES = "s AS (SELECT year(o_orderdate)::BIGINT AS period, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS k FROM orders GROUP BY 1)"


@query(80, 90, 118, sql=f"""WITH {SHARES}, w AS (SELECT *, k / n::DOUBLE AS p, 1.96 * 1.96 AS zz FROM s)
SELECT period, n, k, round(p, 6) AS share, round((p + zz / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n))) / (1 + zz / n), 6) AS low,
  round((p + zz / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n))) / (1 + zz / n), 6) AS high FROM w""")
def share_by_period(spark, d):
    orders = table(spark, d, "orders").withColumn("period", F.year("o_orderdate").cast("long"))
    return B.share_by_period(orders, "period", F.col("o_orderpriority") == "1-URGENT").select("period", "n", "k", *r6("share", "low", "high"))


@query(119, sql=f"""WITH {SHARES}, r AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS s FROM s),
t AS (SELECT count(*) AS groups, sum(n)::BIGINT AS N, sum(k)::BIGINT AS K, sum(s * n)::DOUBLE AS ns, sum(s * s * n)::DOUBLE AS nss, sum(s * k)::DOUBLE AS ks FROM r)
SELECT groups, "N", "K", round((ks - K / N::DOUBLE * ns) / sqrt(K / N::DOUBLE * (1 - K / N::DOUBLE) * (nss - ns * ns / N)), 6) AS z FROM t""")
def trend_by_period(spark, d):
    orders = table(spark, d, "orders").withColumn("period", F.year("o_orderdate"))
    return B.trend(B.share_by_period(orders, "period", F.col("o_orderpriority") == "1-URGENT"), "period").select("groups", "N", "K", *r6("z"))


@query(91, 85, sql="""SELECT p_brand, count(*) AS n, round(quantile_cont(l_quantity, 0.5), 6) AS median_quantity, round(avg(l_quantity), 6) AS mean_quantity, max(l_quantity) AS largest
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def usage_profile(spark, d):
    both = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return both.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("l_quantity", F.lit(0.5)), 6).alias("median_quantity"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.max("l_quantity").alias("largest"))


@query(92, 201, sql="""WITH q AS (SELECT p_brand, year(o_orderdate) AS y, sum(l_quantity) AS s FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE p_brand IN ('Brand#5', 'Brand#12') GROUP BY 1, 2),
t AS (SELECT p_brand, y, s / sum(s) OVER (PARTITION BY p_brand) AS share FROM q)
SELECT coalesce(a.y, b.y)::INT AS year, round(coalesce(a.share, 0), 6) AS share_a, round(coalesce(b.share, 0), 6) AS share_b, round(least(coalesce(a.share, 0), coalesce(b.share, 0)), 6) AS overlap
FROM (SELECT * FROM t WHERE p_brand = 'Brand#5') a FULL JOIN (SELECT * FROM t WHERE p_brand = 'Brand#12') b ON a.y = b.y""")
def compare_side_by_side(spark, d):
    both = table(spark, d, "lineitem").join(table(spark, d, "part").where(F.col("p_brand").isin("Brand#5", "Brand#12")), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sums = both.groupBy(F.year("o_orderdate").alias("year")).pivot("p_brand", ["Brand#5", "Brand#12"]).agg(F.sum("l_quantity"))
    totals = sums.agg(F.sum("`Brand#5`").alias("ta"), F.sum("`Brand#12`").alias("tb"))
    share = sums.crossJoin(totals).select("year", (F.coalesce(F.col("`Brand#5`"), F.lit(0.0)) / F.col("ta")).alias("share_a"), (F.coalesce(F.col("`Brand#12`"), F.lit(0.0)) / F.col("tb")).alias("share_b"))
    return share.select("year", *r6("share_a", "share_b"), F.round(F.least("share_a", "share_b"), 6).alias("overlap"))
