"""Periods of the order and event tables: years, days and what changes between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diachronic as D
from ..registry import query, table
from ..sources.records import dealt


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def brand_years(spark, d):
    lines, n = table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "lineitem").count()
    named = dealt(lines, n, "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    both = dealt(named, n, "l_orderkey").join(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(F.year("o_orderdate").alias("year"), F.col("p_brand").alias("brand"), F.col("o_orderkey").alias("unit"), F.col("p_type").alias("type"), F.col("o_custkey").alias("cluster"))


YEARS = "u AS (SELECT year(o_orderdate)::INT AS year, p_brand AS brand, o_orderkey AS unit, p_type AS type, o_custkey AS cluster FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"


@query(80, 233, sql="""WITH c AS (SELECT year(o_orderdate)::INT AS year, o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT y.year, k.key, coalesce(c.n, 0)::BIGINT AS n FROM (SELECT DISTINCT year FROM c) y CROSS JOIN (SELECT DISTINCT key FROM c) k LEFT JOIN c ON c.year = y.year AND c.key = k.key""")
def period_series(spark, d):
    c = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return D.zero_filled(c, c.select("year").distinct(), c.select("key").distinct())


@query(116, 227, sql=f"""WITH {YEARS}, c AS (SELECT year, brand, count(*) AS n FROM u GROUP BY 1, 2), s AS (SELECT year, brand, n / sum(n) OVER (PARTITION BY year)::DOUBLE AS p FROM c),
o AS (SELECT year, lag(year) OVER (ORDER BY year) AS previous FROM (SELECT DISTINCT year FROM c)),
b AS (SELECT o.previous, o.year, coalesce(x.brand, y.brand) AS brand, coalesce(x.p, 0) AS p, coalesce(y.p, 0) AS q FROM o JOIN (SELECT DISTINCT brand FROM c) k ON true LEFT JOIN s x ON x.year = o.year AND x.brand = k.brand LEFT JOIN s y ON y.year = o.previous AND y.brand = k.brand WHERE o.previous IS NOT NULL)
SELECT previous, year, round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END / 2 + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END / 2), 6) AS jsd FROM b GROUP BY 1, 2""")
def adjacent_period_jsd(spark, d):
    c = brand_years(spark, d).groupBy("year", "brand").agg(F.count(F.lit(1)).alias("n"))
    return D.adjacent_divergence(c, "year", "brand").select("previous", "year", *r6("jsd"))


@query(115, sql=f"WITH {YEARS}, c AS (SELECT year, brand, count(*) AS n FROM u GROUP BY 1, 2), s AS (SELECT year, n / sum(n) OVER (PARTITION BY year)::DOUBLE AS p FROM c) SELECT year, round(sum(-p * log2(p)), 6) AS entropy FROM s GROUP BY 1")
def entropy_by_group(spark, d):
    c = brand_years(spark, d).groupBy("year", "brand").agg(F.count(F.lit(1)).alias("n"))
    return D.entropy(c, "year").select("year", *r6("entropy"))


@query(228, 229, sql="""WITH c AS (SELECT (epoch(date_trunc('day', ts)) / 86400)::BIGINT AS day, event_type AS label, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT label, sum(n) AS a FROM c GROUP BY 1), d AS (SELECT DISTINCT day FROM c),
g AS (SELECT d.day, t.label, a, sum(coalesce(n, 0)) OVER (PARTITION BY t.label ORDER BY d.day) AS x FROM d CROSS JOIN t LEFT JOIN c ON c.day = d.day AND c.label = t.label),
s AS (SELECT day, x / sum(x) OVER w::DOUBLE AS p, (a - x) / sum(a - x) OVER w::DOUBLE AS q, sum(x) OVER w AS n1, sum(a - x) OVER w AS n2 FROM g WINDOW w AS (PARTITION BY day)),
r AS (SELECT day, any_value(n1) * any_value(n2) / (any_value(n1) + any_value(n2))::DOUBLE * sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END / 2 + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END / 2) AS score FROM s WHERE n1 >= 10 AND n2 >= 10 GROUP BY day),
f AS (SELECT day, lead(day) OVER (ORDER BY day) AS nxt FROM d)
SELECT (r.day + nxt) / 2.0::DOUBLE AS split, round(score, 6) AS score FROM r JOIN f USING (day) ORDER BY round(score, 9) DESC, r.day LIMIT 1""")
def change_point_binary(spark, d):
    c = table(spark, d, "events").groupBy(F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"), F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return D.change_point(c, "day", "label", 10).select("split", *r6("score"))


@query(239, sql=f"""WITH {YEARS}, c AS (SELECT year, brand, count(DISTINCT unit) AS n FROM u GROUP BY 1, 2), m AS (SELECT year, brand AS raw, n / (sum(n) OVER (PARTITION BY year))::DOUBLE AS share, row_number() OVER (PARTITION BY year ORDER BY n DESC, brand DESC) AS r FROM c),
b AS (SELECT year, raw, share, lag(raw) OVER w AS p, lead(raw) OVER w AS f FROM m WHERE r = 1 WINDOW w AS (ORDER BY year)), s AS (SELECT year, share, CASE WHEN p = f AND p <> raw THEN p ELSE raw END AS preferred FROM b)
SELECT year, preferred, round(share, 6) AS share, coalesce(lag(preferred) OVER w <> preferred AND (lead(preferred) OVER w IS NULL OR lead(preferred) OVER w = preferred), false) AS switched FROM s WINDOW w AS (ORDER BY year)""")
def name_switches(spark, d):
    return D.preferred_names(brand_years(spark, d), "year", "brand", "unit").select("year", "preferred", *r6("share"), "switched")


@query(68, 100, sql="""WITH u AS (SELECT year(o_orderdate)::INT AS year, l_partkey AS part, l_suppkey AS supplier, o_custkey AS cluster FROM lineitem JOIN orders ON l_orderkey = o_orderkey), e AS (SELECT * FROM u WHERE year < 1996), l AS (SELECT * FROM u WHERE year >= 1996),
p AS (SELECT part, supplier, count(DISTINCT cluster) AS support FROM e GROUP BY 1, 2), g AS (SELECT * FROM p WHERE (part, supplier) NOT IN (SELECT part, supplier FROM l)), a AS (SELECT part, count(*) AS x FROM l GROUP BY 1), b AS (SELECT supplier, count(*) AS y FROM l GROUP BY 1)
SELECT g.part, g.supplier, support, round(support / (support + 1)::DOUBLE * least(1, (x + y) / 6.0), 6) AS score FROM g JOIN a ON a.part = g.part JOIN b ON b.supplier = g.supplier""")
def lost_associations(spark, d):
    u = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    u = u.select(F.year("o_orderdate").alias("year"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("o_custkey").alias("cluster"))
    return D.lost_associations(u, "year", "part", "supplier", "cluster", 1996).select("part", "supplier", "support", *r6("score"))


@query(243, sql="""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events""")
def carry_forward(spark, d):
    e = table(spark, d, "events")
    return D.carry_forward(e, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "last_purchase").select("event_id", "user_id", "last_purchase")


@query(170, 235, 244, sql="""WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM m) SELECT user_id, run, event_type, count(*) AS n FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def label_runs(spark, d):
    return D.runs(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").where("n >= 2").select("user_id", "run", "event_type", "n")


@query(232, sql=f"""WITH {YEARS}, c AS (SELECT year, brand, count(*) AS n FROM u GROUP BY 1, 2), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, brand) AS r FROM c) WHERE r <= 12),
o AS (SELECT year, lag(year) OVER (ORDER BY year) AS p FROM (SELECT DISTINCT year FROM t)), i AS (SELECT o.year, count(*) AS both FROM o JOIN t x ON x.year = o.year JOIN t y ON y.year = o.p AND y.brand = x.brand GROUP BY 1),
z AS (SELECT year, count(*) AS n FROM t GROUP BY 1)
SELECT o.year, round(coalesce(i.both, 0) / (a.n + b.n - coalesce(i.both, 0))::DOUBLE, 6) AS jaccard FROM o JOIN z a ON a.year = o.year JOIN z b ON b.year = o.p LEFT JOIN i ON i.year = o.year""")
def neighbourhood_overlap(spark, d):
    c = brand_years(spark, d).groupBy("year", "brand").agg(F.count(F.lit(1)).alias("n"))
    return D.top_overlap(c, "year", "brand", 12).select("year", *r6("jaccard"))


@query(236, sql=f"""WITH {YEARS}, c AS (SELECT type AS unit, brand, count(*) AS n FROM u GROUP BY 1, 2), t AS (SELECT unit, sum(n) AS t FROM c GROUP BY 1), f AS (SELECT brand FROM c GROUP BY 1 ORDER BY sum(n) DESC, brand LIMIT 10),
r AS (SELECT t.unit, f.brand, 1000 * coalesce(c.n, 0) / t.t::DOUBLE AS rate FROM t CROSS JOIN f LEFT JOIN c ON c.unit = t.unit AND c.brand = f.brand), s AS (SELECT brand, avg(rate) AS m, stddev_samp(rate) AS s FROM r GROUP BY 1),
z AS (SELECT unit, r.brand, (rate - m) / s AS z FROM r JOIN s ON s.brand = r.brand WHERE s > 0) SELECT x.unit AS a, y.unit AS b, round(avg(abs(x.z - y.z)), 6) AS delta FROM z x JOIN z y ON x.brand = y.brand AND x.unit < y.unit GROUP BY 1, 2""")
def burrows_delta(spark, d):
    c = brand_years(spark, d).groupBy(F.col("type").alias("unit"), "brand").agg(F.count(F.lit(1)).alias("n"))
    return D.style_distance(c, "unit", "brand", 10).select("a", "b", *r6("delta"))
