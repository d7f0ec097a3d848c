"""Statements, cases, profiles, witnesses and catalogues on the order and document tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import registered
from ..functions import scalars as X
from ..functions import text as T
from ..operators import evidence as E
from ..registry import query, table
from ..sources.ontology import read_terms
from ..sources.records import shared_folder
from .baskets import BRANDS, brands
from .text import LOW, TOKENS, W, docs, r6

SAID = rf"((?:(?:{'|'.join(E.DENIALS)}) )?[a-z]+ (?:{'|'.join(E.JOINTS)}) [a-z]+)"


@query(283, sql=f"WITH s AS (SELECT doc_id, string_split(unnest(regexp_extract_all({LOW.format('text')}, '{SAID}', 1)), ' ') AS x FROM documents) SELECT x[-2] AS relation, len(x) = 4 AS denied, count(*) AS n, count(DISTINCT x[-3]) AS subjects, count(DISTINCT x[-1]) AS objects, count(DISTINCT doc_id) AS docs FROM s GROUP BY 1, 2")
def statements_by_relation(spark, d):
    s = E.statements(docs(spark, d))
    return s.groupBy("relation", "denied").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject").alias("subjects"), F.countDistinct("object").alias("objects"), F.countDistinct("doc_id").alias("docs"))


SOME = [f"Brand#{i}" for i in range(1, 13)]


@query(47, sql=f"WITH b AS ({BRANDS}) SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AND year(o_orderdate) >= 1996 AND year(o_orderdate) < 2000 AND o_orderkey IN (SELECT basket FROM b WHERE item = 'Brand#13') AND o_orderkey IN (SELECT basket FROM b WHERE item IN ({', '.join(repr(s) for s in SOME)}))")
def claims_by_terms(spark, d):
    terms = brands(spark, d).groupBy("basket").agg(F.collect_set("item").alias("terms"))
    claims = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("relation"), F.year("o_orderdate").alias("year")).join(terms, F.col("o_orderkey") == F.col("basket"))
    return E.stated(claims, ["1-URGENT", "2-HIGH", "5-LOW"], ["Brand#13"], SOME, 1996, 2000).select("o_orderkey", "year")


@query(48, sql="SELECT o_orderkey, 'status=' || o_orderstatus || ';segment=' || c_mktsegment || ';year=' || year(o_orderdate) AS why FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment IN ('FURNITURE', 'BUILDING') AND year(o_orderdate) BETWEEN 1996 AND 1998")
def cases_by_facets(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    year = F.year("o_orderdate")
    facets = {"status": F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")), "segment": F.when(F.col("c_mktsegment").isin("FURNITURE", "BUILDING"), F.col("c_mktsegment")), "year": F.when(year.between(1996, 1998), year)}
    why = F.concat_ws(";", F.transform(F.map_entries("why"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return E.with_facets(o, facets).select("o_orderkey", why.alias("why"))


@query(34, sql="SELECT c_custkey, visit::INT AS visit, l_partkey AS item FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS visit FROM orders) ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def case_rows(spark, d):
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("items"))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    visits = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "items"))).alias("v")).select("o_custkey", F.transform("v", lambda x: x["items"]).alias("visits"))
    cases = table(spark, d, "customer").select("c_custkey").join(visits, F.col("c_custkey") == F.col("o_custkey"), "left")
    return E.nested_rows(cases, "c_custkey")


@query(212, sql=f"""WITH v AS (SELECT o_custkey, o_orderkey, o_orderdate, list(item) AS items FROM ({BRANDS}) JOIN orders ON basket = o_orderkey GROUP BY 1, 2, 3), b AS (SELECT *, lag(items) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM v)
SELECT o_orderkey, len(list_filter(items, lambda i: NOT list_contains(before, i)))::INT AS added, len(list_filter(before, lambda i: NOT list_contains(items, i)))::INT AS removed FROM b WHERE before IS NOT NULL""")
def visit_changes(spark, d):
    items = brands(spark, d).groupBy("basket").agg(F.collect_set("item").alias("items"))
    v = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate").join(items, F.col("o_orderkey") == F.col("basket"))
    return E.changes(v, "o_custkey", ["o_orderdate", "o_orderkey"]).where("before is not null").select("o_orderkey", F.size("added").alias("added"), F.size("removed").alias("removed"))


@query(198, sql=f"""WITH l AS (SELECT DISTINCT basket, item AS a FROM ({BRANDS})), r AS (SELECT DISTINCT l_orderkey AS basket, p_type AS b FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT basket) AS n FROM l),
k AS (SELECT a, b, count(*) AS k FROM l JOIN r USING (basket) GROUP BY 1, 2 HAVING count(*) >= 5), x AS (SELECT a, count(*) AS na FROM l GROUP BY 1), y AS (SELECT b, count(*) AS nb FROM r GROUP BY 1)
SELECT a, b, k, round(k * n / (na * nb)::DOUBLE, 6) AS lift, round(ln(k * n / (na * nb)::DOUBLE) / -ln(k / n::DOUBLE), 6) AS npmi FROM k JOIN x USING (a) JOIN y USING (b), n""")
def item_links(spark, d):
    types = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket"), F.col("p_type").alias("item"))
    return E.cross_links(brands(spark, d), types, "basket", 5).select("a", "b", "k", *r6("lift", "npmi"))


@query(222, sql=f"""WITH p AS (SELECT DISTINCT p_size AS profile, p_brand AS feature FROM part), s AS (SELECT DISTINCT o_custkey, item AS feature FROM ({BRANDS}) JOIN orders ON o_orderkey = basket), w AS (SELECT feature, ln(1 + (SELECT count(DISTINCT profile) FROM p) / count(*)::DOUBLE) AS w FROM p GROUP BY 1),
whole AS (SELECT profile, sum(w) AS whole FROM p JOIN w USING (feature) GROUP BY 1), mass AS (SELECT o_custkey, sum(w) AS mass FROM s JOIN w USING (feature) GROUP BY 1), m AS (SELECT o_custkey, profile, sum(w) AS met FROM s JOIN w USING (feature) JOIN p USING (feature) GROUP BY 1, 2),
f AS (SELECT o_custkey, profile, round((met / whole + met / mass) / 2, 6) AS fit FROM m JOIN whole USING (profile) JOIN mass USING (o_custkey)) SELECT o_custkey, profile, fit, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY fit DESC, profile)::INT AS place FROM f) WHERE place <= 3""")
def best_profiles(spark, d):
    seen = brands(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("basket") == F.col("o_orderkey")).select("o_custkey", F.col("item").alias("feature"))
    profiles = table(spark, d, "part").select(F.col("p_size").alias("profile"), F.col("p_brand").alias("feature"))
    return E.profile_fits(seen, profiles, "o_custkey", 3).select("o_custkey", "profile", "fit", "place")


CUES = {"en": (["the", "of", "and"], ["der", "los"]), "de": (["der", "und", "die"], ["the"]), "fr": (["le", "les", "des"], ["los"]), "es": (["el", "los", "que"], ["les"])}
HELD = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS sense, len(list_filter({yes}, lambda x: list_contains(ts, x))) - 2 * len(list_filter({no}, lambda x: list_contains(ts, x))) AS score FROM w" for k, (yes, no) in CUES.items())


@query(230, sql=f"WITH {W}, h AS ({HELD}), b AS (SELECT doc_id, max(score) AS best FROM h GROUP BY 1), g AS (SELECT doc_id, CASE WHEN any_value(best) > 0 AND count(*) = 1 THEN any_value(sense) END AS sense FROM h JOIN b USING (doc_id) WHERE score = best GROUP BY 1) SELECT doc_id, sense FROM g")
def senses_by_cues(spark, d):
    return docs(spark, d).select("doc_id", E.sense(T.words(F.coalesce("text", F.lit(""))), CUES).alias("sense"))


RULES = [("personal", "[A-Za-z0-9._%+-]+@[A-Za-z0-9]"), ("licensed", "[Ll]icen[sc]e"), ("junk", "[#*$%&|<>]{3}"), ("numbers", "[0-9]{3}")]


@query(297, sql="SELECT source, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in RULES) + " ELSE 'plain' END AS type, count(*) AS n FROM documents GROUP BY 1, 2")
def evidence_types(spark, d):
    return docs(spark, d).groupBy("source", E.first_rule(F.col("text"), RULES, "plain").alias("type")).agg(F.count(F.lit(1)).alias("n"))


SUBSTITUTED = [("r1", "thing", "nation", 1200), ("r2", "heit", "keit", 1300), ("r3", "mente", "ci", 1250), ("r4", "xq", "of", 1400)]
VERDICTS = f"""c AS ({' UNION ALL '.join(f"SELECT source, '{r}' AS rule, {y} AS since, sum((length(text) - length(replace(text, '{a}', ''))) // {len(a)})::BIGINT AS original, sum((length(text) - length(replace(text, '{b}', ''))) // {len(b)})::BIGINT AS substitute FROM documents GROUP BY 1" for r, a, b, y in SUBSTITUTED)}),
v AS (SELECT *, CASE WHEN original + substitute = 0 THEN 'none' WHEN substitute >= 3 AND substitute / (original + substitute)::DOUBLE >= 0.8 THEN 'avoided' WHEN original >= 3 AND substitute / (original + substitute)::DOUBLE <= 0.2 THEN 'kept' ELSE 'mixed' END AS verdict FROM c)"""


@query(99, sql=f"WITH {VERDICTS} SELECT source, rule, since, original, substitute, verdict FROM v")
def substitution_verdicts(spark, d):
    return E.substitutions(docs(spark, d), SUBSTITUTED, "source")


@query(99, sql=f"WITH {VERDICTS} SELECT source, max(CASE WHEN verdict = 'avoided' THEN since END) AS floor FROM v GROUP BY 1")
def dating_floors(spark, d):
    return E.earliest_floor(E.substitutions(docs(spark, d), SUBSTITUTED, "source"), "source")


GROUPS = "g AS (SELECT l_orderkey, l_returnflag, list_sort(list(DISTINCT l_linenumber::VARCHAR)) AS g FROM lineitem GROUP BY 1, 2)"


@query(105, sql=f"WITH {GROUPS} SELECT pattern, count(*) AS n FROM (SELECT l_orderkey, array_to_string(list_sort(list(array_to_string(g, ''))), '|') AS pattern FROM g GROUP BY 1 HAVING count(*) > 1) GROUP BY 1")
def agreement_patterns(spark, d):
    return E.agreement(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag")


@query(106, sql=f"WITH {GROUPS} SELECT array_to_string(g, '') AS witnesses, count(*) AS n FROM (SELECT g, sum(len(g)) OVER (PARTITION BY l_orderkey) AS total FROM g) WHERE len(g) >= 2 AND 2 * len(g) < total GROUP BY 1")
def innovation_groups(spark, d):
    return E.shared_innovations(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag")


@query(346, sql=f"WITH {TOKENS}, n AS (SELECT translate(token, 'äöüáàâéèêíîóôúûñç', 'aouaaaeeeiioouunc') AS folded, token, count(*) AS n FROM t GROUP BY 1, 2), f AS (SELECT *, first_value(token) OVER (PARTITION BY folded ORDER BY n DESC, token) AS common FROM n) SELECT token, common, n FROM f WHERE token <> common")
def equivalent_forms(spark, d):
    words = docs(spark, d).select(F.explode(T.words(F.col("text"))).alias("token"))
    return E.equivalents(words.withColumn("folded", X.folded(F.col("token"))), "folded", "token")


@query(345, sql="""WITH a AS (SELECT s_suppkey AS id, s_nationkey AS nation, floor(s_acctbal / 2500)::INT AS tier FROM supplier), b AS (SELECT c_custkey AS id, c_nationkey AS nation, floor(c_acctbal / 2500)::INT AS tier FROM customer)
SELECT a.id, 'nation' AS field, a.nation::VARCHAR AS "left", b.nation::VARCHAR AS "right" FROM a JOIN b ON a.id = b.id WHERE a.nation IS DISTINCT FROM b.nation UNION ALL SELECT a.id, 'tier', a.tier::VARCHAR, b.tier::VARCHAR FROM a JOIN b ON a.id = b.id WHERE a.tier IS DISTINCT FROM b.tier
UNION ALL SELECT id, 'id', id::VARCHAR, NULL FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'id', NULL, id::VARCHAR FROM b WHERE id NOT IN (SELECT id FROM a)""")
def catalogue_disagreements(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 2500).cast("int").alias("tier"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 2500).cast("int").alias("tier"))
    return E.disagreements(a, b, "id", ["nation", "tier"])


@query(348, sql="SELECT n_name, kind, count(*) AS n FROM (SELECT s_nationkey AS k, 'supplier' AS kind FROM supplier UNION ALL SELECT c_nationkey, 'customer' FROM customer) JOIN nation ON k = n_nationkey GROUP BY 1, 2")
def combined_catalogue(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.lit("supplier").alias("kind"))
    b = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("n_nationkey"))
    counts = a.unionByName(b).groupBy("n_nationkey", "kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(table(spark, d, "nation"), "n_nationkey").select("n_name", "kind", "n")


@query(66, sql="""WITH k AS (SELECT c_custkey, 'Brand#' || c_custkey % 60 AS alias, 0 AS place FROM customer UNION ALL SELECT c_custkey, c_mktsegment, 1 FROM customer UNION ALL SELECT c_custkey, 'ECONOMY', 2 FROM customer), i AS (SELECT alias, min(work) AS work FROM (SELECT p_brand AS alias, p_partkey AS work FROM part UNION ALL SELECT p_type, p_partkey FROM part) GROUP BY 1)
SELECT c_custkey, arg_min(work, place) AS work, min(place) AS place FROM k JOIN i USING (alias) GROUP BY 1""")
def records_to_works(spark, d):
    part = table(spark, d, "part")
    index = part.select(F.col("p_brand").alias("alias"), F.col("p_partkey").alias("work")).union(part.select("p_type", "p_partkey"))
    keys = F.array(F.concat(F.lit("Brand#"), (F.col("c_custkey") % 60).cast("string")), F.col("c_mktsegment"), F.lit("ECONOMY"))
    return E.linked_by_key(table(spark, d, "customer").select("c_custkey", keys.alias("keys")), index, "c_custkey")


PERIODS = {"before 1998": "y < 1998", "after 1995": "y > 1995", "1995 to 1998": "y BETWEEN 1995 AND 1998", "in 1996": "y = 1996"}


@query(44, sql="WITH o AS (SELECT year(o_orderdate) AS y FROM orders) " + " UNION ALL ".join(f"SELECT '{said}' AS said, count(*) FILTER ({c}) AS n FROM o" for said, c in PERIODS.items()))
def period_words(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"))
    counts = F.array(*[F.struct(F.lit(said).alias("said"), F.count(F.when(E.constraint(said, F.col("y")), 1)).alias("n")) for said in PERIODS])
    return o.agg(counts.alias("c")).select(F.explode("c").alias("c")).select("c.*")


@query(342, sql="SELECT conv_id, turn, so_far FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far FROM conversations) WHERE so_far <= 400")
def turns_that_fit(spark, d):
    return E.fitted(table(spark, d, "conversations"), "conv_id", "turn", F.length("text"), 400).select("conv_id", "turn", "so_far")


@query(344, sql="""WITH a AS (SELECT doc_id, regexp_extract_all(text, '(https?://[^ ]+)', 1) AS links, regexp_replace(text, 'https?://[^ ]+', '', 'g') AS rest FROM documents)
SELECT doc_id, len(links)::INT AS links, len(regexp_extract_all(rest, '([0-9]+)', 1))::INT AS numbers, md5(regexp_replace(rest, '[0-9]+', '', 'g')) AS body FROM a""")
def text_layers(spark, d):
    cut = E.layers(docs(spark, d), {"links": "https?://[^ ]+", "numbers": "[0-9]+"})
    return cut.select("doc_id", F.size("links").alias("links"), F.size("numbers").alias("numbers"), F.md5(F.col("body").cast("binary")).alias("body"))


@query(234, sql="""WITH m AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS month, s, count(*) FILTER (o_orderstatus = s)::DOUBLE AS v FROM orders, (VALUES ('F'), ('O'), ('P')) AS f(s) GROUP BY 1, 2),
x AS (SELECT month, s, sum(v) OVER a AS sa, sum(v * v) OVER a AS qa, count(v) OVER a AS na, sum(v) OVER b AS sb, sum(v * v) OVER b AS qb, count(v) OVER b AS nb FROM m WINDOW a AS (PARTITION BY s ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY s ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT month::INT AS month, ss FROM (SELECT month, round(sum(qa - sa * sa / na + qb - sb * sb / nb), 6) AS ss FROM x WHERE na >= 2 AND nb >= 2 GROUP BY 1) ORDER BY ss, month LIMIT 1""")
def change_point_of_several(spark, d):
    counts = [F.struct(F.lit(s).alias("s"), F.count(F.when(F.col("o_orderstatus") == s, 1)).cast("double").alias("v")) for s in "FOP"]
    months = table(spark, d, "orders").groupBy((F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("month")).agg(F.array(*counts).alias("c"))
    return E.best_split(months.select("month", F.explode("c").alias("c")).select("month", "c.*"), "s", "month", "v")


@query(103, sql="SELECT l_suppkey, year(l_shipdate)::INT AS year, " + ", ".join(f"count(*) FILTER (l_returnflag = '{m}') AS n_{m.lower()}, min(l_orderkey) FILTER (l_returnflag = '{m}') AS first_{m.lower()}" for m in "ANR") + " FROM lineitem GROUP BY 1, 2")
def transmission_by_period(spark, d):
    edges = table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), "l_returnflag", "l_orderkey")
    return E.transmission(edges, ["l_suppkey", "year"], "l_returnflag", ["A", "N", "R"], "l_orderkey")


@query(156, 157, 160, sql=f"""WITH b AS ({BRANDS}), h AS (SELECT basket, count(DISTINCT item) AS members FROM b GROUP BY 1 HAVING count(DISTINCT item) FILTER (item IN ('Brand#1', 'Brand#13')) = 2), s AS (SELECT o_orderkey, o_orderdate, o_totalprice / sqrt(members) AS graph FROM h JOIN orders ON basket = o_orderkey),
r AS (SELECT o_orderkey, round(graph, 6) AS graph, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM s) SELECT o_orderkey, graph, round(1 / place::DOUBLE, 6) AS temporal, place <= 3 AS earliest FROM r WHERE place <= 50""")
def graph_and_time_routes(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    hits = E.holding(brands(spark, d), ["Brand#1", "Brand#13"]).join(o, F.col("basket") == F.col("o_orderkey"))
    first = hits.orderBy("o_orderdate", "o_orderkey").limit(50)  # the route's depth
    ranked = first.groupBy().agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice", "members"))).alias("h")).select(F.posexplode("h").alias("at", "h"))
    return ranked.select("h.o_orderkey", F.round(F.col("h.o_totalprice") / F.sqrt("h.members"), 6).alias("graph"), F.round(1 / (F.col("at") + 1), 6).alias("temporal"), (F.col("at") < 3).alias("earliest"))


@query(293, sql=f"SELECT candidate, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all({LOW.format('text')}, '(?:the|der|les|los) ([a-z]+)', 1)) AS candidate FROM documents) GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT doc_id) >= 3")
def harvested_terms(spark, d):
    return E.harvest(docs(spark, d), "(?:the|der|les|los) ([a-z]+)", 5, 3)


@query(285, sql="SELECT page_id, CASE WHEN link LIKE 'http%' THEN 'outside' ELSE 'inside' END AS kind, count(*) AS n, count(DISTINCT link) AS targets FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY 1, 2")
def cited_links(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    kind = F.when(F.col("link").startswith("http"), "outside").otherwise("inside")
    return links.groupBy("page_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("link").alias("targets"))


@query(269, sql="SELECT lang, mark, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z]([.,;:!?]*)', 1)) AS mark FROM documents) WHERE mark <> '' GROUP BY 1, 2")
def punctuation_gaps(spark, d):
    marks = docs(spark, d).select("lang", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]([.,;:!?]*)"), F.lit(1))).alias("mark"))
    return marks.where("mark <> ''").groupBy("lang", "mark").agg(F.count(F.lit(1)).alias("n"))


UNITS = [("liang", 0, 1997, 13.8), ("liang", 1997, 3000, 37.3), ("qian", 0, 3000, 3.73)]


@query(263, sql=f"""WITH x AS (SELECT l_orderkey, l_linenumber, year(l_shipdate) AS y, l_quantity::INT AS q, ['liang', 'qian', 'pinch'][(l_linenumber % 3 + 1)::INT] AS unit FROM lineitem), u(unit, since, until, each) AS (VALUES {', '.join(f"('{u}', {a}, {b}, {g}::DOUBLE)" for u, a, b, g in UNITS)})
SELECT l_orderkey, l_linenumber, x.unit, round(q * each, 6) AS grams FROM x LEFT JOIN u ON u.unit = x.unit AND y >= since AND y < until""")
def doses_in_grams(spark, d):
    unit = F.get(F.array(F.lit("liang"), F.lit("qian"), F.lit("pinch")), F.col("l_linenumber") % 3)
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.year("l_shipdate").alias("year"), F.concat_ws(" ", F.col("l_quantity").cast("int").cast("string"), unit).alias("dose"))
    return E.in_grams(x, UNITS).select("l_orderkey", "l_linenumber", "unit", *r6("grams"))


@query(23, sql="SELECT event_id, event_type, seq FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id)::INT AS seq FROM events WHERE user_id = 13) WHERE seq BETWEEN 3 AND 40")
def session_range(spark, d):
    one = table(spark, d, "events").where("user_id = 13").select("user_id", "event_id", "event_type", "ts")
    return one.selectExpr("event_id", "event_type", "row_number() over (partition by user_id order by ts, event_id) as seq").where("seq between 3 and 40")


@query(109, sql="SELECT count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases, round(avg((event_type = 'error')::INT), 6) AS error_share FROM events")
def log_metrics(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"), F.count(F.when(kind == "error", 1)).alias("errors"), F.count(F.when(kind == "purchase", 1)).alias("purchases"), F.round(F.avg((kind == "error").cast("int")), 6).alias("error_share"))


@query(351, sql="SELECT c_mktsegment AS segment, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS {s.lower()}" for s in "FOP") + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def records_by_design(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus").join(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), F.col("o_custkey") == F.col("c_custkey"))
    wide = o.groupBy("segment").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.select("segment", *[F.coalesce(s, F.lit(0)).alias(s.lower()) for s in "FOP"])


@query(61, sql="SELECT x.n_nationkey AS a, y.n_nationkey AS b, levenshtein(x.n_name, y.n_name)::INT AS distance FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey")
def pairs_of_a_small_group(spark, d):
    n = table(spark, d, "nation")
    y = n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("other"), "n_regionkey")
    return n.join(y, "n_regionkey").where("n_nationkey < b").select(F.col("n_nationkey").alias("a"), "b", F.levenshtein("n_name", "other").alias("distance"))


@query(19, sql="SELECT 'N:' || n_nationkey AS id, n_name AS name, 'R:' || n_regionkey AS parents, n_name || ' land,' || n_name || ' people' AS synonyms FROM nation UNION ALL SELECT 'R:' || r_regionkey, r_name, '', '' FROM region")
def ontology_terms(spark, d):
    nation = table(spark, d, "nation").selectExpr("concat('[Term]\nid: N:', n_nationkey, '\nname: ', n_name, '\nsynonym: \"', n_name, ' land\" EXACT []\nsynonym: \"', n_name, ' people\" EXACT []\nis_a: R:', n_regionkey, ' ! region\n') as value")
    region = table(spark, d, "region").selectExpr("concat('[Term]\nid: R:', r_regionkey, '\nname: ', r_name, '\n\n[Typedef]\nid: part_of\n') as value")
    path = f"{shared_folder(spark)}/terms-{uuid.uuid4().hex}"
    nation.union(region).write.text(path)
    terms = read_terms(spark, path)
    return terms.select("id", "name", F.concat_ws(",", "parents").alias("parents"), F.concat_ws(",", "synonyms").alias("synonyms"))


@query(307, sql="""SELECT (y - y % 3)::INT AS period, count(*) AS n, round((k + 1.9208 - 1.96 * sqrt(k * (count(*) - k) / count(*)::DOUBLE + 0.9604)) / (count(*) + 3.8416), 6) AS low FROM (SELECT year(o_orderdate) AS y, o_orderstatus AS s FROM orders) o
JOIN (SELECT (year(o_orderdate) - year(o_orderdate) % 3) AS p, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS k FROM orders GROUP BY 1) ON p = y - y % 3 GROUP BY 1, k""")
def functions_in_sql(spark, d):
    registered.register(spark)
    counts = table(spark, d, "orders").selectExpr("period_of(year(o_orderdate), 3) as period", "o_orderstatus").groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("k"))
    return counts.selectExpr("period", "n", "round(wilson_low(k, n), 6) as low")


RUNS = "list_distinct(list_transform(range(1, len({0}) - 2), lambda i: array_to_string({0}[i:i + 3], ' ')))"


@query(171, sql=f"WITH {W}, x AS (SELECT doc_id, unnest({RUNS.format('ts')}) AS run FROM w), i AS (SELECT item_id, unnest({RUNS.format('ts')}) AS run FROM (SELECT item_id, regexp_extract_all({LOW.format('text')}, '[a-z\\x{{80}}-\\x{{10ffff}}]+') AS ts FROM benchmark)), h AS (SELECT item_id, doc_id, count(*) AS hits FROM i JOIN x USING (run) GROUP BY 1, 2) SELECT item_id, doc_id, hits, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id)::INT AS place FROM h) WHERE place <= 3")
def located_passages(spark, d):
    return E.located(table(spark, d, "benchmark"), docs(spark, d), 4, 3).select("item_id", "doc_id", "hits", "place")


@query(300, sql="SELECT doc_id, md5(replace(s, ' und ', ' ___ ')) AS card FROM (SELECT doc_id, unnest(string_split_regex(text, '[.!?\n]')) AS s FROM documents) WHERE contains(s, ' und ')")
def cloze_cards(spark, d):
    return E.clozes(docs(spark, d), "und").select("doc_id", F.md5(F.col("card").cast("binary")).alias("card"))


@query(338, sql="""WITH m AS (SELECT source, count(*) AS n, avg(length(text)) AS mean, count(DISTINCT lang) AS langs FROM documents GROUP BY 1), f AS (SELECT source, list_filter([CASE WHEN n < 40 THEN 'enough' END, CASE WHEN mean < 1500 THEN 'long' END, CASE WHEN langs < 4 THEN 'mixed' END], lambda x: x IS NOT NULL) AS failed FROM m)
SELECT source, CASE WHEN len(failed) > 0 THEN 'failed' ELSE 'accepted' END AS verdict, array_to_string(failed, ',') AS failed FROM f""")
def accepted_sources(spark, d):
    m = docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("mean"), F.countDistinct("lang").alias("langs"))
    found = E.accepted(m, "source", {"enough": F.col("n") >= 40, "long": F.col("mean") >= 1500, "mixed": F.col("langs") >= 4})
    return found.select("source", "verdict", F.concat_ws(",", "failed").alias("failed"))


@query(349, sql=f"""WITH {TOKENS}, c AS (SELECT source, token, count(*) AS n FROM t GROUP BY 1, 2), g AS (SELECT source, sum(n) AS own FROM c GROUP BY 1), k AS (SELECT token, sum(n) AS whole FROM c GROUP BY 1), z AS (SELECT sum(n) AS total FROM c),
x AS (SELECT source, coalesce(n, 0) / own::DOUBLE AS p, (whole - coalesce(n, 0)) / (total - own)::DOUBLE AS q FROM g CROSS JOIN k CROSS JOIN z LEFT JOIN c USING (source, token))
SELECT source, round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) / 2 ELSE 0 END), 6) AS jsd FROM x GROUP BY 1""")
def source_divergence(spark, d):
    words = docs(spark, d).select("source", F.explode(T.words(F.col("text"))).alias("token"))
    counts = words.groupBy("source", "token").agg(F.count(F.lit(1)).alias("n"))
    return E.divergence(counts, "source", "token", "n").select("source", *r6("jsd"))
