"""Lexicons, mentions, collocates, reuse types and small scalar functions on documents, names and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import scalars as X
from ..functions import text as T
from ..operators import lexicon as L
from ..registry import query, table
from .text import LOW, WORDS, W, docs, r6

ENTRIES = ["the", "ther", "thertion", "tion", "ion", "er", "ering", "ing", "and", "of the"]
ALTERNATIVES = "|".join(sorted(ENTRIES, key=lambda e: (-len(e), e)))


@query(257, sql=f"SELECT entry, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '({ALTERNATIVES})')) AS entry FROM documents) GROUP BY 1")
def lexicon_longest_match(spark, d):
    found = docs(spark, d).select("doc_id", F.explode(L.matches(F.col("text"), ENTRIES)).alias("entry"))
    return found.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(258, sql="""WITH a AS (SELECT DISTINCT replace(n_name, '_', '-') || 'X' AS asked FROM nation UNION SELECT 'NATON_7' UNION SELECT 'REGION'), e AS (SELECT n_name AS entry FROM nation UNION SELECT r_name FROM region)
SELECT asked, entry, distance FROM (SELECT asked, entry, levenshtein(asked, entry)::INT AS distance, row_number() OVER (PARTITION BY asked ORDER BY levenshtein(asked, entry), entry) AS r FROM a, e WHERE levenshtein(asked, entry) <= 3) WHERE r <= 2""")
def lexicon_nearest(spark, d):
    n = table(spark, d, "nation")
    asked = n.select(F.concat(F.replace("n_name", F.lit("_"), F.lit("-")), F.lit("X")).alias("asked")).union(spark.createDataFrame([("NATON_7",), ("REGION",)], "asked string")).distinct()
    entries = n.select(F.col("n_name").alias("entry")).union(table(spark, d, "region").select("r_name")).distinct()
    return L.nearest(asked, entries, 2).select("asked", "entry", "distance")


MENTIONED = " UNION ALL ".join(f"SELECT '{k}' AS kind, doc_id, unnest(regexp_extract_all(text, '{p}')) AS mention FROM documents" for k, p in L.MENTIONS)


@query(286, sql=f"WITH m AS ({MENTIONED}) SELECT kind, count(*) AS n, count(DISTINCT mention) AS distinct_mentions, count(DISTINCT doc_id) AS docs FROM m GROUP BY 1")
def typed_mentions(spark, d):
    m = L.mentions(docs(spark, d))
    return m.groupBy("kind").agg(F.sum("n").alias("n"), F.countDistinct("mention").alias("distinct_mentions"), F.countDistinct("doc_id").alias("docs"))


@query(72, sql="""WITH s AS (SELECT user_id AS owner, event_id AS id, floor(epoch(ts))::BIGINT AS "start", floor(epoch(ts))::BIGINT + 3600 * (1 + event_id % 5) AS "end" FROM events)
SELECT owner, id, "start", "end" FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.owner = x.owner AND y."start" < x."end" AND x."start" < y."end" AND (y."end" - y."start" > x."end" - x."start" OR (y."end" - y."start" = x."end" - x."start" AND y."start" < x."start")))""")
def overlap_resolution(spark, d):
    e = table(spark, d, "events")
    start = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return L.resolved(e.select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), start.alias("start"), (start + 3600 * (1 + F.col("event_id") % 5)).alias("end")), "owner")


@query(83, sql=f"""WITH {W}, p AS (SELECT doc_id, lang, unnest(ts) AS token, unnest(range(0, len(ts))) AS pos FROM w), n AS (SELECT x.lang, y.token, count(*) AS n FROM p x JOIN p y ON x.doc_id = y.doc_id AND abs(x.pos - y.pos) <= 3 WHERE x.token = 'of' AND y.token <> 'of' GROUP BY 1, 2)
SELECT lang, token, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS r FROM n) WHERE r <= 10""")
def collocates_by_group(spark, d):
    return L.collocates(docs(spark, d), "of", 3, "lang", 10).select("lang", "token", "n")


@query(347, sql=f"""WITH {W}, g AS (SELECT doc_id, ts[i] AS head, ts[i] || ' ' || ts[i + 1] AS pair FROM (SELECT doc_id, ts, unnest(range(1, len(ts))) AS i FROM w)), c AS (SELECT pair, any_value(head) AS head, count(*) AS c FROM g GROUP BY 1), h AS (SELECT head, sum(c) AS h FROM c GROUP BY 1),
v AS (SELECT count(DISTINCT t) AS v FROM (SELECT unnest(ts) AS t FROM w)), l AS (SELECT pair, ln((c + 1) / (h + v)::DOUBLE) AS logp FROM c JOIN h USING (head), v)
SELECT doc_id, count(*) AS pairs, round(avg(logp), 6) AS mean_log FROM g JOIN l USING (pair) GROUP BY 1""")
def bigram_language_model(spark, d):
    return L.bigram_model(docs(spark, d)).select("doc_id", "pairs", *r6("mean_log"))


@query(151, sql=f"""WITH {W}, f AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS token FROM w) GROUP BY 1, 2),
r AS (SELECT doc_id, ('0x' || substr(md5(token), 1, 8))::BIGINT % 32 AS slot, sum(CASE WHEN ('0x' || substr(md5(token), 9, 1))::INT % 2 = 0 THEN 1 + ln(tf) ELSE -1 - ln(tf) END) AS w FROM f GROUP BY 1, 2)
SELECT doc_id, slot, round(w / n, 5) AS weight FROM r JOIN (SELECT doc_id, sqrt(sum(w * w)) AS n FROM r GROUP BY 1) USING (doc_id) WHERE abs(w) > 1e-9""")
def hashed_embedding(spark, d):
    return L.hashed_vectors(docs(spark, d), 32).select("doc_id", "slot", F.round("weight", 5).alias("weight"))


FEATURES = f"""fd AS (SELECT doc_id, g, min(i) AS p FROM (SELECT doc_id, i - 1 AS i, array_to_string(ts[i:i + 2], ' ') AS g FROM (SELECT doc_id, ts, unnest(range(1, len(ts) - 1)) AS i FROM w WHERE len(ts) >= 3)) GROUP BY 1, 2),
wi AS (SELECT item_id, {WORDS.format('text')} AS ts FROM benchmark), fi AS (SELECT item_id, g, min(i) AS q FROM (SELECT item_id, i - 1 AS i, array_to_string(ts[i:i + 2], ' ') AS g FROM (SELECT item_id, ts, unnest(range(1, len(ts) - 1)) AS i FROM wi WHERE len(ts) >= 3)) GROUP BY 1, 2),
b AS (SELECT item_id, doc_id, p, q, lag(q) OVER (PARTITION BY item_id, doc_id ORDER BY p, q) AS before FROM fd JOIN fi USING (g)),
x AS (SELECT item_id, doc_id, count(*) AS shared, max(p) - min(p) + 3 AS span, CASE WHEN count(before) > 0 THEN count(*) FILTER (q > before) / count(before)::DOUBLE ELSE 1.0 END AS in_order FROM b GROUP BY 1, 2), z AS (SELECT item_id, count(*) AS runs FROM fi GROUP BY 1),
y AS (SELECT item_id, doc_id, shared, shared / runs::DOUBLE AS covered, span, in_order FROM x JOIN z USING (item_id))"""


@query(177, 178, sql=f"WITH {W}, {FEATURES} SELECT item_id, doc_id, shared, round(covered, 6) AS covered, span::INT AS span, round(in_order, 6) AS in_order FROM y WHERE shared >= 2")
def reuse_pairs(spark, d):
    f = L.reuse_features(docs(spark, d), table(spark, d, "benchmark"))
    return f.where("shared >= 2").select("item_id", "doc_id", "shared", *r6("covered"), "span", *r6("in_order"))


@query(179, 182, sql=f"WITH {W}, {FEATURES} SELECT CASE WHEN covered >= 0.9 AND in_order >= 0.9 THEN 'verbatim' WHEN covered >= 0.4 AND in_order >= 0.7 THEN 'adapted' WHEN covered >= 0.4 THEN 'reordered' WHEN shared >= 2 THEN 'echo' ELSE 'chance' END AS type, count(*) AS n, count(DISTINCT item_id) AS items FROM y GROUP BY 1")
def reuse_types(spark, d):
    f = L.reuse_features(docs(spark, d), table(spark, d, "benchmark"))
    typed = f.withColumn("type", L.reuse_type(F.col("covered"), F.col("in_order"), F.col("shared")))
    return typed.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("items"))


@query(254, sql="SELECT doc_id, md5(translate(" + LOW.format("text") + ", 'äöüáàâéèêíîóôúûñç', 'aouaaaeeeiioouunc')) AS folded FROM documents")
def folded_letters(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.folded(F.col("text")).cast("binary")).alias("folded"))


@query(255, sql="""SELECT p_partkey, list_aggregate(list_transform(k, lambda i: substr(p_name, i, 1)), 'string_agg', '') AS letters, array_to_string(list_transform(k, lambda i: i - 1), ',') AS places
FROM (SELECT p_partkey, p_name, list_filter(range(1, length(p_name) + 1), lambda i: regexp_matches(substr(p_name, i, 1), '[A-Za-z]')) AS k FROM part)""")
def letters_with_places(spark, d):
    letters, places = X.letters_with_places(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", letters.alias("letters"), F.concat_ws(",", places.cast("array<string>")).alias("places"))


@query(264, sql="""SELECT o_orderkey, CASE WHEN k = 0 THEN o_orderkey::DOUBLE WHEN k = 1 THEN round(o_totalprice, 2) WHEN k = 2 THEN (o_orderkey % 100) / 100.0::DOUBLE ELSE NULL END AS number FROM (SELECT *, o_orderkey % 4 AS k FROM orders)""")
def number_cells(spark, d):
    k = F.col("o_orderkey") % 4
    cell = F.when(k == 0, F.col("o_orderkey").cast("string")).when(k == 1, F.format_number(F.round("o_totalprice", 2), 2)).when(k == 2, F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit("%"))).otherwise("n/a")
    return table(spark, d, "orders").select("o_orderkey", T.parse_number(cell).alias("number"))


@query(270, sql="""SELECT n_nationkey, 'nation-' || substr(sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}'), 1, 16) AS id FROM nation""")
def stable_ids(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.stable_id("nation", F.col("n_nationkey"), F.col("n_name")).alias("id"))


@query(271, sql="SELECT p_partkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(p_name) + 1), lambda i: ascii(substr(p_name, i, 1))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS fnv FROM part")
def fnv_hashes(spark, d):
    return table(spark, d, "part").select("p_partkey", X.fnv1a(F.col("p_name")).alias("fnv"))


@query(273, sql="""SELECT event_id, json_type(props::JSON, '$.k') IN ('UBIGINT', 'BIGINT') AS fits, coalesce(TRY_CAST(json_extract_string(props::JSON, '$.k') AS BIGINT), 0) AS k FROM events""")
def json_fit(spark, d):
    fits, value = X.fitted_long(F.col("props"), "k", 0)
    return table(spark, d, "events").select("event_id", fits.alias("fits"), value.alias("k"))


@query(274, sql="SELECT event_id, props AS found FROM events")
def first_json_value(spark, d):
    wrapped = F.concat(F.lit("note "), F.col("event_type"), F.lit(": see "), F.col("props"), F.lit(" and {more"))
    return table(spark, d, "events").select("event_id", X.first_json(wrapped).alias("found"))


@query(275, sql="""SELECT event_id, (m ->> 'k')::BIGINT AS k, m ->> 'kind' AS kind, m -> 'at' ->> 'user' AS "user", m -> 'at' ->> 'hour' AS "hour" FROM (SELECT event_id, json_merge_patch(json_merge_patch(json_object('k', 0, 'at', json_object('user', user_id::VARCHAR)), props::JSON), json_object('kind', event_type, 'at', json_object('hour', hour(ts)::VARCHAR))) AS m FROM events)""")
def deep_merge(spark, d):
    e = table(spark, d, "events")
    base = F.create_map(F.lit("k"), F.create_map(F.lit(""), F.lit("0")), F.lit("at"), F.create_map(F.lit("user"), F.col("user_id").cast("string")))
    second = F.create_map(F.lit("k"), F.create_map(F.lit(""), F.get_json_object("props", "$.k")))
    third = F.create_map(F.lit("kind"), F.create_map(F.lit(""), F.col("event_type")), F.lit("at"), F.create_map(F.lit("hour"), F.hour("ts").cast("string")))
    m = X.merged(X.merged(base, second), third)
    return e.select("event_id", m["k"][""].cast("long").alias("k"), m["kind"][""].alias("kind"), m["at"]["user"].alias("user"), m["at"]["hour"].alias("hour"))


@query(277, sql="""SELECT user_id, round(1 - exp(sum(ln(1 - least(0.99, value / (value + 50))))), 6) AS combined, round(avg(least(0.99, value / (value + 50))), 6) AS mean, CASE WHEN 1 - exp(sum(ln(1 - least(0.99, value / (value + 50))))) >= 0.999 THEN 'high' WHEN avg(least(0.99, value / (value + 50))) >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM events WHERE value > 0 GROUP BY 1""")
def combined_confidence(spark, d):
    c = F.least(F.lit(0.99), F.col("value") / (F.col("value") + 50))
    both = table(spark, d, "events").where("value > 0").groupBy("user_id").agg(X.any_of(c).alias("combined"), F.avg(c).alias("mean"))
    return both.select("user_id", *r6("combined", "mean"), F.when(F.col("combined") >= 0.999, "high").when(F.col("mean") >= 0.5, "medium").otherwise("low").alias("level"))


@query(279, sql="""SELECT y::INT AS year, ['甲', '乙', '丙', '丁', '戊', '己', '庚', '辛', '壬', '癸'][(y - 4) % 10 + 1] || ['子', '丑', '寅', '卯', '辰', '巳', '午', '未', '申', '酉', '戌', '亥'][(y - 4) % 12 + 1] AS cycle FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)""")
def cycle_years(spark, d):
    return table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct().select("year", X.cycle_name(F.col("year")).alias("cycle"))


@query(262, sql="""SELECT p_partkey, p_size::BIGINT AS read FROM part""")
def numerals_read(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", X.read_numeral(X.numeral(F.col("p_size"))).cast("long").alias("read"))


@query(281, sql="""SELECT p_partkey, CASE WHEN x < 0.001 THEN '<0.001' ELSE printf('%.3f', x) END AS p, printf('%,d', floor(p_retailprice * 10)::BIGINT) AS price FROM (SELECT p_partkey, p_retailprice, p_size / 39989.0::DOUBLE + (p_partkey % 7) / 8.0 AS x FROM part)""")
def formatted_figures(spark, d):
    x = F.col("p_size") / 39989.0 + (F.col("p_partkey") % 7) / 8.0
    return table(spark, d, "part").select("p_partkey", X.p_text(x).alias("p"), F.format_number(F.floor(F.col("p_retailprice") * 10), 0).alias("price"))


@query(332, sql="""WITH t AS (SELECT l_partkey AS p, min(year(o_orderdate)) AS f, max(year(o_orderdate)) AS l FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT p_partkey, CASE WHEN p IS NULL THEN 'open' WHEN l >= 2000 THEN 'confirmed' ELSE 'refuted' END AS outcome FROM part LEFT JOIN t ON p = p_partkey""")
def prediction_check(spark, d):
    seen = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max(F.year("o_orderdate")).alias("last"))
    return table(spark, d, "part").join(seen, "p_partkey", "left").select("p_partkey", X.three_valued(F.col("last") >= 2000).alias("outcome"))


SAFETY = ["stupid", "idiot", "trash", "worthless"]


@query(352, sql=f"SELECT doc_id, len(t)::INT AS n, array_to_string(list_sort(list_distinct(t)), ',') AS terms FROM (SELECT doc_id, regexp_extract_all({LOW.format('text')}, '\\b({'|'.join(SAFETY)})\\b') AS t FROM documents) WHERE len(t) > 0")
def safety_terms(spark, d):
    found = F.regexp_extract_all(T.lower(F.col("text")), F.lit(rf"\b({'|'.join(SAFETY)})\b"), F.lit(1))
    return docs(spark, d).select("doc_id", found.alias("t")).where(F.size("t") > 0).select("doc_id", F.size("t").alias("n"), F.concat_ws(",", F.sort_array(F.array_distinct("t"))).alias("terms"))


@query(49, sql="""SELECT c_custkey, (CASE WHEN contains(lower(c_name), '7') THEN 1 ELSE 0 END + CASE WHEN contains(lower(c_mktsegment), 'build') THEN 1 ELSE 0 END)::INT AS found FROM customer WHERE contains(lower(c_name), '7') OR contains(lower(c_mktsegment), 'build')""")
def row_search(spark, d):
    c = table(spark, d, "customer")
    hits = X.words_found({"c_name": "7", "c_mktsegment": "build"})
    return c.select("c_custkey", hits.alias("found")).where("found > 0")


@query(213, sql="""WITH v AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label AS l, i, avg(x) AS m FROM v GROUP BY 1, 2),
d AS (SELECT vec_id, label, l, sqrt(sum((x - m) * (x - m))) AS d FROM v JOIN c USING (i) GROUP BY 1, 2, 3), s AS (SELECT vec_id, label, min(d) FILTER (l = label) AS a, min(d) FILTER (l <> label) AS b FROM d GROUP BY 1, 2)
SELECT label, count(*) AS n, round(avg((b - a) / greatest(a, b)), 5) AS silhouette FROM s GROUP BY 1""")
def centre_silhouette(spark, d):
    return X.centre_silhouette(table(spark, d, "embeddings"), "vec_id", "label", "embedding").select("label", "n", F.round("silhouette", 5).alias("silhouette"))


SCHEMA = {
    "type": "object",
    "required": ["id", "kind"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 1},
        "kind": {"type": "string", "enum": ["click", "view", "error", "signup"]},
        "tags": {"type": "array", "items": {"type": "integer", "maximum": 90}},
        "level": {"type": "integer", "default": 3},
    },
}


@query(273, sql="""WITH e AS (SELECT event_id, event_type, (json_extract_string(props::JSON, '$.k'))::BIGINT AS k FROM events)
SELECT event_id, '{"id":' || event_id || ',"kind":"' || event_type || '","level":3,"tags":[' || k || ']}' AS fitted, array_to_string(list_filter([CASE WHEN event_id < 1 THEN '$.id: under minimum' END, CASE WHEN event_type = 'purchase' THEN '$.kind: not in enum' END, CASE WHEN k > 90 THEN '$.tags[0]: over maximum' END], lambda p: p IS NOT NULL), '; ') AS problems FROM e""")
def records_fitted(spark, d):
    """Records with numbers as text, a lone value for a list, an unknown field and a missing one."""
    e = table(spark, d, "events")
    raw = F.concat(F.lit('{"id": " '), F.col("event_id").cast("string"), F.lit('", "kind": "'), "event_type", F.lit('", "more": [{}], "tags": "'), F.get_json_object("props", "$.k"), F.lit('"}'))
    return e.select("event_id", D.fit_json(raw, SCHEMA).alias("f")).select("event_id", "f.fitted", F.array_join("f.problems", "; ").alias("problems"))


@query(274, sql="""SELECT event_id, '{"at":[' || event_id || ',{"deep":[' || json_extract_string(props::JSON, '$.k') || ',[]]}],"said":"a } in { quotes \\" ' || event_type || '"}' AS found FROM events""")
def nested_json_in_text(spark, d):
    value = F.concat(F.lit('{"said": "a } in { quotes \\" '), "event_type", F.lit('", "at": ['), F.col("event_id").cast("string"), F.lit(', {"deep": ['), F.get_json_object("props", "$.k"), F.lit(", []]}]}"))
    text = F.concat(F.lit("see [this and {that: "), value, F.lit(" and [1, 2] {"))
    return table(spark, d, "events").select("event_id", D.first_json(text).alias("found"))


@query(275, sql="""WITH e AS (SELECT *, json_extract_string(props::JSON, '$.k') AS k FROM events)
SELECT event_id, '{"a":{"b":{"c":' || k || ',"d":' || user_id || '},"list":[1,' || k || ',"x"]},"kind":"' || event_type || '","new":{"z":[' || event_id || ']},"one":[0,' || k || ']}' AS merged FROM e""")
def documents_merged(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    base = F.concat(F.lit('{"a": {"b": {"c": 0, "d": '), F.col("user_id").cast("string"), F.lit('}, "list": [1]}, "kind": {"old": 1}, "one": 0}'))
    over = F.concat(F.lit('{"a": {"b": {"c": '), "k", F.lit('}, "list+": ['), "k", F.lit(', "x"]}, "kind": "'), "event_type", F.lit('", "new": {"z+": '), F.col("event_id").cast("string"), F.lit('}, "one+": '), "k", F.lit("}"))
    return e.select("event_id", D.merge_json(base, over).alias("merged"))
