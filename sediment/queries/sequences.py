"""Events of users: visits are days, items are event types; a cohort of users."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import sequences as S
from ..plans import cohort as C
from ..registry import query, table


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def visits(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("case"), F.col("ts").cast("date").alias("visit"), F.col("event_type").alias("item")).distinct()


V = "v AS (SELECT DISTINCT user_id AS c, ts::DATE AS visit, event_type AS item FROM events), o AS (SELECT c, visit, lead(visit) OVER (PARTITION BY c ORDER BY visit) AS nv FROM (SELECT DISTINCT c, visit FROM v)), s AS (SELECT * FROM o WHERE nv IS NOT NULL)"


@query(208, 210, sql=f"""WITH {V}, h AS (SELECT v.c, nv, item AS a FROM v JOIN s ON s.c = v.c AND s.visit = v.visit), t AS (SELECT v.c, nv, item AS b FROM v JOIN s ON s.c = v.c AND s.nv = v.visit),
n AS (SELECT a, b, count(*) AS n FROM h JOIN t ON t.c = h.c AND t.nv = h.nv GROUP BY 1, 2)
SELECT n.a, n.b, n, round(n / x.c::DOUBLE, 6) AS p, round(y.c / (SELECT count(*) FROM s)::DOUBLE, 6) AS base, round((n / x.c::DOUBLE) / (y.c / (SELECT count(*) FROM s)::DOUBLE), 6) AS lift
FROM n JOIN (SELECT a, count(*) AS c FROM h GROUP BY a) x ON x.a = n.a JOIN (SELECT b, count(*) AS c FROM t GROUP BY b) y ON y.b = n.b""")
def event_transitions(spark, d):
    return S.transitions(visits(spark, d)).select("a", "b", "n", *r6("p", "base", "lift"))


@query(207, sql="""WITH v AS (SELECT DISTINCT user_id AS c, ts::DATE AS d, event_type AS i FROM events), one AS (SELECT i AS pattern, count(DISTINCT c) AS support FROM v GROUP BY 1),
e1 AS (SELECT c, i, min(d) AS d FROM v GROUP BY 1, 2), e2 AS (SELECT e1.c, e1.i || '>' || v.i AS p, min(v.d) AS d FROM e1 JOIN v ON v.c = e1.c AND v.d > e1.d GROUP BY 1, 2),
e3 AS (SELECT e2.c, e2.p || '>' || v.i AS p, min(v.d) AS d FROM e2 JOIN v ON v.c = e2.c AND v.d > e2.d GROUP BY 1, 2)
SELECT * FROM (SELECT * FROM one UNION ALL SELECT p, count(*) FROM e2 GROUP BY 1 UNION ALL SELECT p, count(*) FROM e3 GROUP BY 1) WHERE support >= 20""")
def prefixspan_days(spark, d):
    return S.prefixspan(visits(spark, d), 20, 3).select(F.concat_ws(">", "pattern").alias("pattern"), "support")


@query(211, 325, sql="""WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m) SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def sessionize_30m(spark, d):
    return S.sessions(table(spark, d, "events"), "user_id", "ts", "30 minutes")


@query(316, sql="SELECT event_id, n AS in_window FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n >= 3")
def burst_2h(spark, d):
    return S.bursts(table(spark, d, "events"), "user_id", "ts", 7200, 3).select("event_id", "in_window")


@query(319, sql="SELECT event_id, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) <= 1 AS allowed FROM events")
def rate_limited(spark, d):
    return S.limited(table(spark, d, "events"), "event_type", "ts", ["ts", "event_id"], 1).select("event_id", "allowed")


@query(209, sql="""WITH i AS (SELECT DISTINCT user_id AS c, event_type || extract(hour FROM ts) AS item FROM events), w AS (SELECT item, power(ln(((SELECT count(DISTINCT c) FROM i) + 1) / (count(*) + 1)::DOUBLE) + 1, 2) AS w2 FROM i GROUP BY item),
z AS (SELECT c, sum(w2) AS s FROM i JOIN w USING (item) GROUP BY c), x AS (SELECT q.c AS query, o.c AS c, sum(w2) AS x FROM i q JOIN i o ON q.item = o.item AND q.c <> o.c JOIN w ON w.item = q.item WHERE q.c % 50 = 0 GROUP BY 1, 2),
r AS (SELECT query, x.c, x / sqrt(a.s * b.s) AS similarity FROM x JOIN z a ON a.c = x.c JOIN z b ON b.c = x.query)
SELECT query, c AS "case", round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, c) AS k FROM r) WHERE k <= 5""")
def similar_users(spark, d):
    items = table(spark, d, "events").select(F.col("user_id").alias("case"), F.concat("event_type", F.hour("ts").cast("string")).alias("item")).distinct()
    return S.similar_cases(items, items.where("case % 50 = 0"), 5).select("query", "case", *r6("similarity"))


SPEC = C.Cohort(index="signup", exposure="click", outcome="purchase", washout=30, follow_up=10)
COHORT = """e AS (SELECT user_id AS person, event_type AS kind, ts::DATE AS day FROM events), p AS (SELECT person, min(day) AS i FROM e WHERE kind = 'signup' GROUP BY 1),
x AS (SELECT e.person, min(day) AS x FROM e JOIN p ON p.person = e.person WHERE kind = 'click' AND day >= i GROUP BY 1),
a AS (SELECT p.person, CASE WHEN x IS NOT NULL THEN 'exposed' ELSE 'unexposed' END AS arm, coalesce(x, i) AS t0 FROM p LEFT JOIN x ON x.person = p.person),
c AS (SELECT a.*, (SELECT count(*) FROM e WHERE e.person = a.person AND kind = 'purchase' AND day >= t0 AND day - t0 <= 10) AS events FROM a
 WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.person = a.person AND kind = 'purchase' AND day < t0 AND t0 - day <= 30))"""


def persons(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("person"), F.col("event_type").alias("kind"), F.col("ts").cast("date").alias("day"))


@query(57, 58, 278, 303, sql=f"WITH {COHORT} SELECT person, arm, t0, events FROM c")
def cohort_members(spark, d):
    return C.compiled(persons(spark, d), SPEC)


@query(57, 138, sql=f"WITH {COHORT} SELECT arm, count(*) AS persons, count(*) FILTER (events > 0) AS cases, round(count(*) FILTER (events > 0) / count(*)::DOUBLE, 6) AS risk FROM c GROUP BY arm")
def cohort_risk(spark, d):
    return C.risk(C.compiled(persons(spark, d), SPEC)).select("arm", "persons", "cases", *r6("risk"))


@query(138, sql=f"""WITH {COHORT}, r AS (SELECT count(*) FILTER (arm = 'exposed')::DOUBLE AS n, count(*) FILTER (arm = 'exposed' AND events > 0)::DOUBLE AS a, count(*) FILTER (arm = 'unexposed')::DOUBLE AS m, count(*) FILTER (arm = 'unexposed' AND events > 0)::DOUBLE AS b FROM c),
s AS (SELECT (a / n) / nullif(b / m, 0) AS ratio, {stats.Z95} * sqrt(1 / nullif(a, 0) - 1 / n + 1 / nullif(b, 0) - 1 / m) AS spread FROM r)
SELECT round(ratio, 6) AS ratio, round(exp(ln(ratio) - spread), 6) AS low, round(exp(ln(ratio) + spread), 6) AS high FROM s""")
def cohort_risk_ratio(spark, d):
    return C.risk_ratio(C.risk(C.compiled(persons(spark, d), SPEC))).select(*r6("ratio", "low", "high"))


@query(107, sql="""SELECT count(*) AS conversations, round(avg(turns), 6) AS mean_turns, round(quantile_cont(turns, 0.5), 6) AS median_turns, round(avg(CASE WHEN alternates THEN 1.0 ELSE 0.0 END), 6) AS alternating, round(quantile_cont(chars, 0.5), 6) AS median_chars FROM (
SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars, bool_and(role IS DISTINCT FROM prev) AS alternates FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY 1)""")
def conversation_summary(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations").withColumn("prev", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    per = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"), F.bool_and(~F.col("role").eqNullSafe(F.col("prev"))).alias("alternates"))
    return per.agg(F.count(F.lit(1)).alias("conversations"), F.round(F.avg("turns"), 6).alias("mean_turns"), F.round(F.percentile("turns", F.lit(0.5)), 6).alias("median_turns"), F.round(F.avg(F.when(F.col("alternates"), 1.0).otherwise(0.0)), 6).alias("alternating"), F.round(F.percentile("chars", F.lit(0.5)), 6).alias("median_chars"))


@query(323, sql="SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def latest_per_role(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id", "role").agg(F.max("turn").alias("turn")).select("conv_id", "turn", "role")
