"""Description, comparison and de-identification of the customer, part, order and document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles as P
from ..registry import query, table
from ..sources.records import dealt


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query(17, 49, 264, sql="""WITH c AS (SELECT count(*) AS n, count(DISTINCT c_custkey) AS a, count(DISTINCT c_name) AS b, count(DISTINCT c_acctbal) AS c, count(DISTINCT c_mktsegment) AS d FROM customer)
SELECT 'c_custkey' AS "column", n, 0::BIGINT AS missing, a AS "distinct", 'number' AS type FROM c UNION ALL SELECT 'c_name', n, 0, b, 'text' FROM c
UNION ALL SELECT 'c_acctbal', n, 0, c, 'number' FROM c UNION ALL SELECT 'c_mktsegment', n, 0, d, 'category' FROM c""")
def column_types(spark, d):
    rows = table(spark, d, "customer").select(*[F.col(c).cast("string").alias(c) for c in ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")])
    return P.column_types(rows)


@query(85, sql="""WITH s AS (SELECT c_mktsegment, count(c_acctbal) AS n, count(*) FILTER (c_acctbal IS NULL) AS missing, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd, min(c_acctbal) AS least,
quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS median, quantile_cont(c_acctbal, 0.75) AS q3, max(c_acctbal) AS most FROM customer GROUP BY 1)
SELECT s.c_mktsegment, n, missing, round(mean, 6) AS mean, round(sd, 6) AS sd, least, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, most,
(SELECT count(*) FROM customer c WHERE c.c_mktsegment = s.c_mktsegment AND (c_acctbal < q1 - 1.5 * (q3 - q1) OR c_acctbal > q3 + 1.5 * (q3 - q1))) AS outliers FROM s""")
def describe_numeric(spark, d):
    return P.describe_number(table(spark, d, "customer"), "c_acctbal", ["c_mktsegment"]).select("c_mktsegment", "n", "missing", *r6("mean", "sd"), "least", *r6("q1", "median", "q3"), "most", "outliers")


@query(84, sql="SELECT p_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM part)::DOUBLE, 6) AS share FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 4")
def describe_categorical(spark, d):
    return P.frequencies(table(spark, d, "part"), "p_type", 4).select("value", "n", *r6("share"))


@query(86, sql="""WITH w AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part), c AS (SELECT 5.0::DOUBLE AS width)
SELECT floor(lo / width) * width + least(floor((p_size - floor(lo / width) * width) / width), ceil((hi - floor(lo / width) * width) / width) - 1) * width AS bin_start, count(*) AS n FROM part, w, c GROUP BY 1""")
def histogram_bins(spark, d):
    return P.histogram(table(spark, d, "part"), "p_size")


@query(87, sql="""WITH t AS (SELECT o_orderpriority AS value FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)
SELECT o_orderstatus, CASE WHEN o_orderpriority IN (SELECT value FROM t) THEN o_orderpriority ELSE 'other' END AS o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2""")
def crosstab_top(spark, d):
    return P.crosstab(table(spark, d, "orders").select("o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority", 3)


CHI = """t AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(n) AS r FROM t GROUP BY a), c AS (SELECT b, sum(n) AS c FROM t GROUP BY b), s AS (SELECT sum(n) AS total FROM t),
e AS (SELECT coalesce(n, 0) AS n, r * c / total::DOUBLE AS e, total FROM r CROSS JOIN c CROSS JOIN s LEFT JOIN t ON t.a = r.a AND t.b = c.b)"""


@query(122, 137, sql=f"""WITH {CHI} SELECT round(sum((n - e) * (n - e) / e), 6) AS chi2, (((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM c) - 1))::BIGINT AS df,
round(sqrt(sum((n - e) * (n - e) / e) / (max(total) * (least((SELECT count(*) FROM r), (SELECT count(*) FROM c)) - 1))), 6) AS cramer_v, round(min(e), 6) AS least_expected,
round(exp(-sum((n - e) * (n - e) / e) / 2) * list_sum(list_transform(range(0, ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM c) - 1) // 2), lambda k: pow(sum((n - e) * (n - e) / e) / 2, k) / gamma(k + 1))), 6) AS p FROM e""")
def crosstab_chi2(spark, d):
    t = P.crosstab(table(spark, d, "orders").select("o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority")
    return P.chi2(t, "o_orderstatus", "o_orderpriority").select(F.round("chi2", 6).alias("chi2"), F.col("df").cast("long").alias("df"), *r6("cramer_v", "least_expected", "p"))


@query(123, 137, 240, sql="""WITH k AS (SELECT c_mktsegment AS g, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS r FROM customer),
t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS c FROM customer GROUP BY c_acctbal)), p AS (SELECT g, count(*)::DOUBLE AS n, sum(r)::DOUBLE AS s FROM k GROUP BY g),
u AS (SELECT sum(n) AS n, sum(s * s / n) AS s, count(*) AS groups FROM p)
SELECT round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 5) AS h, groups, round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) / (n - 1), 6) AS epsilon2,
round(exp(-(12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) / 2) * (1 + (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) / 2), 6) AS p FROM u, t""")
def kruskal_by_segment(spark, d):
    return P.kruskal_wallis(table(spark, d, "customer").select("c_mktsegment", "c_acctbal"), "c_acctbal", "c_mktsegment").select(F.round("h", 5).alias("h"), "groups", *r6("epsilon2", "p"))


@query(124, 137, 240, sql="""WITH k AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part),
c AS (SELECT count(*) AS n, corr(a, b) AS rho FROM k), h AS (SELECT n, rho, atan(abs(rho) * sqrt((n - 2) / (1 - rho * rho)) / sqrt(n - 2)) AS angle FROM c)
SELECT n, round(rho, 6) AS rho, round(1 - sin(angle) * list_sum(list_transform(range(0, (n - 2) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(cos(angle), 2 * k))), 6) AS p FROM h""")
def spearman_price_size(spark, d):
    return P.spearman(table(spark, d, "part"), "p_size", "p_retailprice").select("n", *r6("rho", "p"))


@query(136, 93, 125, sql="""WITH u AS (SELECT DISTINCT o_orderkey AS unit, o_orderpriority AS g, p_brand AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
z AS (SELECT g, count(DISTINCT unit) AS size FROM u GROUP BY g), n AS (SELECT sum(size) AS n FROM z), i AS (SELECT g, item, count(DISTINCT unit) AS a FROM u GROUP BY 1, 2), k AS (SELECT item, count(DISTINCT unit) AS k FROM u GROUP BY 1),
q AS (SELECT i.g AS grp, i.item, a, round(a / size::DOUBLE, 6) AS share, round((k - a) / (n - size)::DOUBLE, 6) AS elsewhere, round(a::DOUBLE * (n - size - (k - a)) / ((size - a)::DOUBLE * (k - a)), 6) AS odds_ratio, size, k, n
FROM i JOIN z ON z.g = i.g JOIN k ON k.item = i.item, n WHERE a >= 3),
x AS (SELECT grp, item, sum(exp(lgamma(size + 1.0) - lgamma(y + 1.0) - lgamma(size - y + 1.0) + lgamma(n - size + 1.0) - lgamma(k - y + 1.0) - lgamma(n - size - k + y + 1.0) - lgamma(n + 1.0) + lgamma(k + 1.0) + lgamma(n - k + 1.0))) AS p
FROM (SELECT *, unnest(range(a, least(size, k)::BIGINT + 1)) AS y FROM q) GROUP BY 1, 2),
t AS (SELECT grp, q.item, a, share, elsewhere, odds_ratio, CASE WHEN a / size::DOUBLE > (k - a) / (n - size)::DOUBLE THEN least(1.0, p) ELSE 1.0 END AS p FROM q JOIN x USING (grp, item)),
l AS (SELECT max(CASE WHEN p <= 0.05 * i / m THEN p END) AS lim FROM (SELECT p, count(*) OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM t))
SELECT grp, item, a, share, elsewhere, odds_ratio, round(p, 6) AS p, coalesce(p <= lim, false) AS significant FROM t, l""")
def odds_ratio_group_contrast(spark, d):
    lines, n = table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "lineitem").count()
    named = dealt(lines, n, "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    both = dealt(named, n, "l_orderkey").join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.col("o_orderkey") == F.col("l_orderkey"))
    u = both.select(F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("grp"), F.col("p_brand").alias("item"))
    return P.group_contrasts(u, "grp").select("grp", "item", "a", *r6("share", "elsewhere", "odds_ratio", "p"), "significant")


@query(134, sql="""WITH u AS (SELECT DISTINCT user_id AS unit, substr(ts::VARCHAR, 1, 10) AS item FROM events WHERE event_type = 'click'), o AS (SELECT user_id AS unit, bool_or(event_type = 'purchase') AS positive FROM events GROUP BY 1),
t AS (SELECT count(*) AS n_all, count(*) FILTER (positive) AS p FROM o), x AS (SELECT item, count(*) AS n, count(*) FILTER (positive) AS a FROM u JOIN o USING (unit) GROUP BY item),
q AS (SELECT item, n, a, p, n_all, CASE WHEN a = 0 OR n - a = 0 OR p - a = 0 OR n_all - n - p + a = 0 THEN round((a + 0.5) * (n_all - n - p + a + 0.5) / ((n - a + 0.5) * (p - a + 0.5)), 6)
ELSE round(a * (n_all - n - p + a)::DOUBLE / ((n - a) * (p - a)), 6) END AS odds_ratio FROM x, t WHERE n >= 3 AND n < n_all),
y AS (SELECT item, sum(CASE WHEN v >= a THEN e ELSE 0 END) AS over, sum(CASE WHEN v <= a THEN e ELSE 0 END) AS under FROM (SELECT *, exp(lgamma(n + 1.0) - lgamma(v + 1.0) - lgamma(n - v + 1.0) + lgamma(n_all - n + 1.0) - lgamma(p - v + 1.0) - lgamma(n_all - n - p + v + 1.0) - lgamma(n_all + 1.0) + lgamma(p + 1.0) + lgamma(n_all - p + 1.0)) AS e
FROM (SELECT *, unnest(range(greatest(0, n + p - n_all), least(n, p) + 1)) AS v FROM q)) GROUP BY 1),
w AS (SELECT item, n, a, odds_ratio, least(over, under, 1.0) AS p, least(1.0, 2 * least(over, under)) AS p2 FROM q JOIN y USING (item)),
l AS (SELECT max(CASE WHEN p2 <= 0.05 * i / m THEN p2 END) AS lim FROM (SELECT p2, count(*) OVER (ORDER BY p2) AS i, count(*) OVER () AS m FROM w))
SELECT item, n, a, odds_ratio, round(p, 6) AS p, coalesce(p2 <= lim, false) AS significant FROM w, l""")
def outcome_associations(spark, d):
    e = table(spark, d, "events")
    u = e.where("event_type = 'click'").select(F.col("user_id").alias("unit"), F.date_format("ts", "yyyy-MM-dd").alias("item"))
    o = e.groupBy(F.col("user_id").alias("unit")).agg(F.bool_or(F.col("event_type") == "purchase").alias("positive"))
    return P.outcome_association(u, o).select("item", "n", "a", *r6("odds_ratio", "p"), "significant")


@query(265, 267, sql=r"""WITH a AS (SELECT doc_id, text AS t0, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g') AS t1 FROM documents),
b AS (SELECT *, regexp_replace(t1, '\b[0-9]{17}[0-9Xx]\b|\b[0-9]{15,16}\b', '[id]', 'g') AS t2 FROM a), c AS (SELECT *, regexp_replace(t2, '\+?[0-9]{0,2} ?\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}\b', '[phone]', 'g') AS t3 FROM b)
SELECT doc_id, len(regexp_extract_all(t0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))::BIGINT AS email, len(regexp_extract_all(t1, '\b[0-9]{17}[0-9Xx]\b|\b[0-9]{15,16}\b'))::BIGINT AS id,
len(regexp_extract_all(t2, '\+?[0-9]{0,2} ?\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}\b'))::BIGINT AS phone, len(regexp_extract_all(t3, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b'))::BIGINT AS address,
md5(regexp_replace(t3, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', '[address]', 'g')) AS masked_md5 FROM c""")
def mask_identifiers(spark, d):
    docs = P.masked(table(spark, d, "documents").select("doc_id", "text"), "text", "masked")
    return docs.select("doc_id", *[name for name, _ in P.MASKS], F.md5(F.col("masked").cast("binary")).alias("masked_md5"))


@query(266, sql="SELECT s_suppkey, 'P' || lpad(dense_rank() OVER (ORDER BY f, s_nationkey)::VARCHAR, 6, '0') AS pseudonym FROM (SELECT s_suppkey, s_nationkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS f FROM supplier)")
def pseudonymised(spark, d):
    return P.pseudonyms(table(spark, d, "supplier"), "s_nationkey", "s_suppkey", "pseudonym").select("s_suppkey", "pseudonym")
