"""Brands bought together, nations that buy from nations, and graphs made of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import baskets as B
from ..operators import graphs as G
from ..registry import query, table
from .baskets import PAIRS, brands


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


EDGES = f"{PAIRS}, g AS (SELECT a, b FROM p WHERE lift > 1), e AS (SELECT a, b FROM g UNION SELECT b, a FROM g)"


def edges(spark, d):
    return B.pair_table(brands(spark, d)).where("lift > 1").select("a", "b")


LINKS = f"{EDGES}, deg AS (SELECT a AS mid, count(*) AS deg FROM e GROUP BY 1), l AS (SELECT x.a, y.a AS b, count(*) AS common, sum(1 / ln(deg + 1)) AS adamic_adar, sum(1 / deg::DOUBLE) AS allocation FROM e x JOIN e y ON x.b = y.b AND x.a < y.a JOIN deg ON mid = x.b WHERE (x.a, y.a) NOT IN (SELECT a, b FROM e) GROUP BY 1, 2)"


@query(64, 204, 205, sql=f"WITH {LINKS} SELECT a, b, common, round(adamic_adar, 6) AS adamic_adar, round(allocation, 6) AS allocation FROM l")
def link_prediction_aa(spark, d):
    return G.link_prediction(edges(spark, d)).select("a", "b", "common", *r6("adamic_adar", "allocation"))


@query(333, sql=f"WITH {LINKS}, best AS (SELECT a, b FROM l ORDER BY round(adamic_adar, 9) DESC, a, b LIMIT 20) SELECT count(*) AS hits, round(count(*) / 20.0, 6) AS \"precision\" FROM best WHERE (a, b) IN (SELECT a, b FROM p)")
def link_hits(spark, d):
    table_ = B.pair_table(brands(spark, d))
    predicted = G.link_prediction(table_.where("lift > 1").select("a", "b"))
    return G.hits_at(predicted, table_.select("a", "b"), "adamic_adar", 20).select("hits", *r6("precision"))


@query(102, 216, 328, sql="""WITH RECURSIVE f AS (SELECT p_partkey AS b, lag(p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS a FROM part), e AS (SELECT a, b FROM f WHERE a IS NOT NULL UNION SELECT b, a FROM f WHERE a IS NOT NULL),
r AS (SELECT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen) SELECT id, min(seen) AS component FROM r GROUP BY id""")
def components(spark, d):
    p = table(spark, d, "part")
    before = F.lag("p_partkey").over(Window.partitionBy("p_brand", "p_size").orderBy("p_partkey"))
    return G.components(p.select(before.alias("a"), F.col("p_partkey").alias("b")).where("a is not null"))


@query(223, 221, sql="""WITH RECURSIVE t AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey // 3 > 0), r AS (SELECT child, parent AS ancestor, 1 AS steps FROM t UNION ALL SELECT r.child, t.parent, steps + 1 FROM r JOIN t ON t.child = r.ancestor)
SELECT child, ancestor, steps FROM r""")
def ontology_closure(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 3).alias("parent")).where("parent > 0")
    return G.closure(t, "child", "parent")


CITES = """c AS (SELECT c_nationkey AS citing, s_nationkey AS cited, year(o_orderdate) AS period, count(*) AS weight FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2, 3)"""


def citations(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    both = o.join(s, F.col("o_orderkey") == F.col("l_orderkey")).where("c_nationkey <> s_nationkey")
    return both.groupBy(F.col("c_nationkey").alias("citing"), F.col("s_nationkey").alias("cited"), F.year("o_orderdate").alias("period")).agg(F.count(F.lit(1)).alias("weight"))


@query(98, sql=f"WITH {CITES} SELECT cited, count(DISTINCT citing) AS citing, count(DISTINCT period) AS periods, sum(weight)::BIGINT AS volume, round(10 * log2(1 + count(DISTINCT citing)) + 2 * count(DISTINCT period) + 2 * log2(1 + sum(weight)), 6) AS score FROM c GROUP BY cited")
def canon_score(spark, d):
    return G.canon_score(citations(spark, d)).select("cited", "citing", "periods", "volume", *r6("score"))


@query(95, 96, 97, sql=f"WITH {CITES} SELECT period::INT AS period, cited, w FROM (SELECT period, cited, sum(weight)::BIGINT AS w, row_number() OVER (PARTITION BY period ORDER BY sum(weight) DESC, cited) AS r FROM c GROUP BY 1, 2) WHERE r <= 3")
def citations_by_period(spark, d):
    from ..operators.relational import top_k

    w = citations(spark, d).groupBy("period", "cited").agg(F.sum("weight").alias("w"))
    return top_k(w, ["period"], [F.desc("w"), F.col("cited")], 3).select("period", "cited", "w")


@query(206, sql=None)
def communities(spark, d):
    e = B.pair_table(brands(spark, d)).where("lift > 1").select("a", "b", F.col("k").alias("w"))
    return G.label_propagation(e, 5)


@query(63, 218, sql="""WITH a AS (SELECT o_orderpriority AS subject, year(o_orderdate) AS key, o_orderstatus AS source, CASE WHEN avg(round(o_totalprice, 2)) > (SELECT avg(round(o_totalprice, 2)) FROM orders) THEN 1 ELSE -1 END AS sign FROM orders GROUP BY 1, 2, 3)
SELECT x.subject, x.key::INT AS key, x.source AS "left", y.source AS "right" FROM a x JOIN a y ON x.subject = y.subject AND x.key = y.key AND x.source < y.source WHERE x.sign * y.sign < 0""")
def contradictions(spark, d):
    o = table(spark, d, "orders").withColumn("p", F.round("o_totalprice", 2))
    mean = o.agg(F.avg("p").alias("m"))
    a = o.groupBy(F.col("o_orderpriority").alias("subject"), F.year("o_orderdate").alias("key"), F.col("o_orderstatus").alias("source")).agg(F.avg("p").alias("x")).crossJoin(mean).withColumn("sign", F.when(F.col("x") > F.col("m"), 1).otherwise(-1))
    return G.opposed(a)


@query(337, sql="""SELECT o_custkey, CASE min(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 4 END) WHEN 1 THEN 'fail' WHEN 2 THEN 'pending' ELSE 'pass' END AS status FROM orders GROUP BY 1""")
def gate_status(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "P", "pending").otherwise("pass")
    return G.worst_status(table(spark, d, "orders").select("o_custkey", status.alias("status")), "o_custkey")
