"""Estimates, coverage, rounds, files and passages over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..operators import baskets as B
from ..operators import estimates as E
from ..registry import query, table
from ..sources import records
from .baskets import PAIRS, brands


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query(130, sql="""WITH s AS (SELECT o_orderpriority AS p, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1), a AS (SELECT sum(n) AS n, sum(s) AS s FROM s)
SELECT p AS o_orderpriority, (a.n - s.n)::BIGINT AS n, round((a.s - s.s) / (a.n - s.n), 4) AS mean, round((a.s - s.s) / (a.n - s.n) - a.s / a.n, 4) AS change FROM s, a""")
def leave_one_out(spark, d):
    return E.leave_one_out(table(spark, d, "orders"), "o_orderpriority", "o_totalprice").select("o_orderpriority", "n", F.round("mean", 4).alias("mean"), F.round("change", 4).alias("change"))


@query(140, sql="""WITH c AS (SELECT l_linenumber AS x, l_quantity AS y, count(*) AS n FROM lineitem GROUP BY 1, 2),
p AS (SELECT sum(CASE WHEN b.y > a.y THEN a.n * b.n ELSE 0 END) AS c, sum(CASE WHEN b.y < a.y THEN a.n * b.n ELSE 0 END) AS d FROM c a JOIN c b ON a.x < b.x)
SELECT c::BIGINT AS concordant, d::BIGINT AS discordant, round(c / (c + d)::DOUBLE, 6) AS share FROM p""")
def concordant_pairs(spark, d):
    return E.concordance(table(spark, d, "lineitem"), "l_linenumber", "l_quantity").select("concordant", "discordant", *r6("share"))


@query(81, 163, sql="""SELECT substr(ts::VARCHAR, 1, 10) AS period, count(*) AS rows, count(*) FILTER (event_type = 'purchase') AS hits,
round(count(*) FILTER (event_type = 'purchase') / count(*)::DOUBLE, 6) AS coverage FROM events GROUP BY 1""")
def hit_timeline(spark, d):
    return E.timeline(table(spark, d, "events"), F.date_format("ts", "yyyy-MM-dd"), F.col("event_type") == "purchase").select("period", "rows", "hits", *r6("coverage"))


@query(165, sql="""WITH n AS (SELECT user_id AS entity, event_type AS name, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1, 2), q AS (SELECT * FROM (VALUES ('signup', TIMESTAMP '2024-01-10'), ('error', TIMESTAMP '2024-01-02')) AS q(name, asked)),
e AS (SELECT q.name, asked, entity FROM q JOIN n USING (name) WHERE first <= asked AND asked <= last)
SELECT DISTINCT e.name, e.entity, n.name AS other FROM e JOIN n ON n.entity = e.entity WHERE first <= asked AND asked <= last AND n.name <> e.name""")
def alias_expansion(spark, d):
    names = table(spark, d, "events").groupBy(F.col("user_id").alias("entity"), F.col("event_type").alias("name")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    asked = spark.createDataFrame([("signup", "2024-01-10"), ("error", "2024-01-02")], "name string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    return E.other_names(asked, names)


@query(187, sql="""WITH r AS (SELECT user_id AS unit, event_type AS witness, count(*) AS reading FROM events GROUP BY 1, 2)
SELECT x.witness AS a, y.witness AS b, count(*) AS shared, round(1000.0 * sum(CASE WHEN x.reading <> y.reading THEN 1 ELSE 0 END) / count(*), 6) AS distance FROM r x JOIN r y ON x.unit = y.unit AND x.witness < y.witness GROUP BY 1, 2""")
def witness_distance(spark, d):
    readings = table(spark, d, "events").groupBy(F.col("user_id").alias("unit"), F.col("event_type").alias("witness")).agg(F.count(F.lit(1)).alias("reading")).withColumn("weight", F.lit(1.0))
    return E.witness_distance(readings).select("a", "b", "shared", *r6("distance"))


@query(238, sql="""WITH e AS (SELECT o_custkey AS c, max(o_orderdate) FILTER (o_orderstatus = 'F') AS after, min(o_orderdate) FILTER (o_orderstatus = 'O') AS before FROM orders GROUP BY 1)
SELECT c AS customer, substr(after::VARCHAR, 1, 10) AS after, substr(before::VARCHAR, 1, 10) AS before, coalesce(after <= before, true) AS consistent FROM e""")
def dating_interval(spark, d):
    signs = table(spark, d, "orders").select(F.col("o_custkey").alias("customer"), F.when(F.col("o_orderstatus") == "F", "after").when(F.col("o_orderstatus") == "O", "before").alias("kind"), F.col("o_orderdate").alias("at"))
    return E.dating(signs, "customer").select("customer", F.date_format("after", "yyyy-MM-dd").alias("after"), F.date_format("before", "yyyy-MM-dd").alias("before"), "consistent")


@query(276, sql="SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS coverage FROM lineitem GROUP BY 1")
def weighted_coverage(spark, d):
    return E.weighted_coverage(table(spark, d, "lineitem"), "l_suppkey", F.col("l_quantity"), (F.col("l_returnflag") == "R").cast("double")).select("l_suppkey", *r6("coverage"))


@query(339, sql="""WITH i AS (SELECT r, count(*) AS n FROM (SELECT user_id, min(ts::DATE) AS r FROM events GROUP BY 1) GROUP BY 1), s AS (SELECT r, count(*) AS n FROM (SELECT event_type, min(ts::DATE) AS r FROM events GROUP BY 1) GROUP BY 1),
a AS (SELECT e.r, coalesce(i.n, 0) AS i, coalesce(s.n, 0) AS s FROM (SELECT DISTINCT ts::DATE AS r FROM events) e LEFT JOIN i ON i.r = e.r LEFT JOIN s ON s.r = e.r), t AS (SELECT *, sum(i) OVER (ORDER BY r) AS t FROM a)
SELECT r::VARCHAR AS day, t::BIGINT AS items, i AS new_items, s AS new_sources, i < 0.05 * t AND s <= 0 AS stop FROM t""")
def saturation_rounds(spark, d):
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id", "event_type")
    return E.saturation(e, "day", "user_id", "event_type", 0.05, 0)


@query(340)
def receipt_chain(spark, d):
    return E.hash_chain(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.concat_ws("|", "event_id", "event_type"))


@query(213)
def vector_clusters(spark, d):
    return E.clusters(table(spark, d, "embeddings"), 8, 1)


@query(121, sql=f"""WITH {PAIRS}, c AS (SELECT a, b, k, na, nb, n, greatest(0, na + nb - n) AS lo, least(na, nb) AS hi FROM p),
x AS (SELECT a, b, k, lo, list_transform(range(lo, hi + 1), lambda x: exp(lgamma(na + 1) + lgamma(n - na + 1) + lgamma(nb + 1) + lgamma(n - nb + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(na - x + 1) - lgamma(nb - x + 1) - lgamma(n - na - nb + x + 1))) AS ps FROM c)
SELECT a, b, round(least(1.0, list_sum(list_filter(ps, lambda q: q <= ps[k - lo + 1] * (1 + 1e-7)))), 5) AS p FROM x""")
def pair_tests_two_sided(spark, d):
    t = B.pair_table(brands(spark, d))
    cells = (F.col("k"), F.col("na") - F.col("k"), F.col("nb") - F.col("k"), F.col("n") - F.col("na") - F.col("nb") + F.col("k"))
    return t.select("a", "b", F.round(stats.fisher_two_sided(*[c.cast("double") for c in cells]), 5).alias("p"))


@query(261, sql=r"SELECT doc_id, len(ps)::BIGINT AS passages, coalesce(list_max(list_transform(ps, lambda p: length(p))), 0)::BIGINT AS longest FROM (SELECT doc_id, regexp_extract_all(text, '(?s:.{0,399}[.!?\n]|.{1,400})') AS ps FROM documents)")
def passages(spark, d):
    split = table(spark, d, "documents").select("doc_id", T.passages(F.col("text"), 400).alias("ps"))
    longest = F.array_max(F.transform("ps", F.length))
    return split.select("doc_id", F.size("ps").cast("long").alias("passages"), F.coalesce(longest, F.lit(0)).cast("long").alias("longest"))


@query(256, sql=r"""WITH c AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9\x{80}-\x{10ffff}]+', '', 'g') AS t FROM documents)
SELECT g AS gram, count(*) AS n FROM (SELECT substr(t, i, 2) AS g FROM (SELECT t, unnest(range(1, length(t))) AS i FROM c WHERE length(t) >= 2)) GROUP BY 1 HAVING count(*) >= 500""")
def bare_bigrams(spark, d):
    bare = T.bare(F.col("text"))
    return T.char_ngram_counts(table(spark, d, "documents").select(bare), 2).where("n >= 500")


@query(282, sql="SELECT doc_id, (length(text) - o + ceil(o / 4.0))::BIGINT AS tokens FROM (SELECT doc_id, text, length(regexp_replace(text, '[\\x{3400}-\\x{9fff}]', '', 'g')) AS o FROM documents)")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query(341, sql="""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS ts FROM documents), s AS (SELECT doc_id, len(list_intersect(ts, ['the', 'thing', 'nation', 'people', 'water'])) AS overlap FROM w)
SELECT doc_id, overlap::INT AS overlap FROM s WHERE overlap > 0 ORDER BY overlap DESC, doc_id LIMIT 25""")
def keyword_recall(spark, d):
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))
    asked = F.array(*[F.lit(w) for w in ("the", "thing", "nation", "people", "water")])
    rows = table(spark, d, "documents").select("doc_id", F.size(F.array_intersect(tokens, asked)).alias("overlap"))
    return rows.where("overlap > 0").orderBy(F.desc("overlap"), "doc_id").limit(25)


@query(20, 33, sql="SELECT event_id, event_type, value, props FROM events")
def json_lines_round_trip(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "value", "props")
    path = records.write_json_lines(rows, records.scratch(spark, "records"), ["event_type"])
    return records.read_json_lines(spark, path, "event_id long, event_type string, value double, props string")


@query(16, 35, sql="SELECT p_partkey, list_count(list_distinct(string_split(p_type, ' ')))::INT AS parts FROM part")
def delimited_round_trip(spark, d):
    path = records.scratch(spark, "parts")
    records.write_dataset(table(spark, d, "part").select("p_partkey", F.array_join(F.array_distinct(F.split("p_type", " ")), ";").alias("p_type")), path, "csv")
    return records.read_delimited(spark, path, "p_partkey long, p_type string", several={"p_type": ";"}).select("p_partkey", F.size("p_type").alias("parts"))
