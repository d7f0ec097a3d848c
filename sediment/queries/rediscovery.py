"""Parts that come together in orders, foretold from the orders before."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rediscovery as R
from ..registry import query, table
from .text import r6

CUTOFFS = ["1996-01-01", "1997-01-01", "1998-01-01", "1999-01-01"]


def part_links(spark, d):
    """Parts of which one order has many each."""
    line = table(spark, d, "lineitem").where("l_quantity > 35").select("l_orderkey", F.col("l_partkey").alias("p"))
    x, y = (line.select("l_orderkey", F.col("p").alias(n)) for n in "ab")
    pairs = x.join(y, "l_orderkey").where("a < b")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"))
    return pairs.join(o, "l_orderkey").select("a", "b", "at")


def _of(cutoff: str) -> str:
    tag = cutoff[:4]
    return f"""p{tag} AS (SELECT a, b FROM l WHERE day < '{cutoff}'), u{tag} AS (SELECT a AS x, b AS y FROM p{tag} UNION ALL SELECT b, a FROM p{tag}), d{tag} AS (SELECT x, count(*) AS d FROM u{tag} GROUP BY 1),
c{tag} AS (SELECT m.x AS a, n.x AS b, count(*) AS common, round(sum(1 / ln(d + 1)), 9) AS adamic_adar, round(sum(1 / d::DOUBLE), 9) AS allocation FROM u{tag} m JOIN u{tag} n ON m.y = n.y AND m.x < n.x JOIN d{tag} ON d{tag}.x = m.y WHERE NOT EXISTS (SELECT 1 FROM p{tag} q WHERE q.a = m.x AND q.b = n.x) GROUP BY 1, 2),
s{tag} AS MATERIALIZED (SELECT c.*, e.d * f.d AS popularity, ('0x' || substr(md5(c.a || '-' || c.b), 1, 8))::BIGINT AS chance, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.a = c.a AND l.b = c.b AND day >= '{cutoff}') THEN 1 ELSE 0 END AS hit FROM c{tag} c JOIN d{tag} e ON e.x = c.a JOIN d{tag} f ON f.x = c.b)"""


ROWS = " UNION ALL ".join(f"SELECT '{c}' AS cutoff, '{r}' AS ranker, (SELECT count(*) FROM s{c[:4]}) AS candidates, (SELECT coalesce(sum(hit), 0)::BIGINT FROM s{c[:4]}) AS truths, coalesce(sum(hit), 0)::BIGINT AS hits, sum(hit) / nullif(count(*), 0)::DOUBLE AS precision FROM (SELECT * FROM s{c[:4]} ORDER BY {r} DESC, a, b LIMIT 100)" for c in CUTOFFS for r in R.RANKERS)
LINKS = "l AS MATERIALIZED (SELECT x.l_partkey AS a, y.l_partkey AS b, min(strftime(o_orderdate, '%Y-%m-%d')) AS day FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey JOIN orders ON o_orderkey = x.l_orderkey WHERE x.l_quantity > 35 AND y.l_quantity > 35 GROUP BY 1, 2)"
REDISCOVERED = f"{LINKS}, {', '.join(_of(c) for c in CUTOFFS)}, r AS ({ROWS})"


@query(333, 334, 335, sql=f"WITH {REDISCOVERED} SELECT cutoff, ranker, candidates, truths, hits, round(precision, 6) AS precision FROM r")
def rediscovered_links(spark, d):
    return R.rediscovery(part_links(spark, d), CUTOFFS, 100).select("cutoff", "ranker", "candidates", "truths", "hits", *r6("precision"))


@query(335, sql=f"""WITH {REDISCOVERED}, s AS (SELECT ranker, count(*) AS cutoffs, avg(precision) AS mean_precision, count(*) FILTER (precision > base) AS better, count(*) FILTER (precision < base) AS worse FROM r JOIN (SELECT cutoff, precision AS base FROM r WHERE ranker = 'chance') USING (cutoff) WHERE precision IS NOT NULL GROUP BY 1)
SELECT ranker, cutoffs, round(mean_precision, 6) AS mean_precision, better, worse, round(least(1.0, 2 * list_sum(list_transform(range(0, least(better, worse) + 1), lambda i: exp(lgamma(better + worse + 1) - lgamma(i + 1) - lgamma(better + worse - i + 1) - (better + worse) * ln(2))))), 6) AS p FROM s""")
def rankers_compared(spark, d):
    return R.ranker_summary(R.rediscovery(part_links(spark, d), CUTOFFS, 100)).select("ranker", "cutoffs", *r6("mean_precision"), "better", "worse", *r6("p"))
