"""Search, reuse and description of the document, benchmark, page and vector tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import reuse as R
from ..operators import search as S
from ..registry import query, table

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOW + ", '[a-z\\x{{80}}-\\x{{10ffff}}]+')"
W = "w AS (SELECT doc_id, source, lang, " + WORDS.format("text") + " AS ts FROM documents)"
TOKENS = f"{W}, t AS (SELECT doc_id, source, lang, unnest(ts) AS token FROM w)"


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


@query(143, 149, sql=f"WITH {TOKENS} SELECT token, count(DISTINCT doc_id) AS df FROM t GROUP BY 1 HAVING count(DISTINCT doc_id) >= 20")
def document_frequency(spark, d):
    return S.document_frequency(S.postings(docs(spark, d))).where("df >= 20")


@query(141, 142, sql="SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) AS gram FROM documents) GROUP BY 1 HAVING count(*) >= 500")
def char_bigrams(spark, d):
    return T.char_ngram_counts(docs(spark, d).select("text"), 2).where("n >= 500")


QUERY = ["nation", "the", "thing", "the"]
BM25 = f"""{TOKENS}, l AS (SELECT doc_id, len(ts) AS dl FROM w), s AS (SELECT count(*) AS n, avg(dl) AS mean FROM l), q AS (SELECT * FROM (VALUES ('nation', 1.0), ('the', 2.0), ('thing', 1.0)) AS q(token, times)),
f AS (SELECT doc_id, token, count(*) AS tf FROM t WHERE token IN (SELECT token FROM q) GROUP BY 1, 2), d AS (SELECT token, count(*) AS df FROM f GROUP BY 1),
b AS (SELECT f.doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * dl / mean))) AS score FROM f JOIN d USING (token) JOIN q USING (token) JOIN l USING (doc_id), s GROUP BY 1)"""


@query(55, 147, 150, 155, sql=f"WITH {BM25} SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM b ORDER BY round(score, 9) DESC, doc_id LIMIT 20")
def bm25_top(spark, d):
    return S.ranked(S.bm25(docs(spark, d), QUERY), 20).select("doc_id", *r6("score"), "rank")


@query(144, 145, 146, sql="SELECT doc_id FROM documents WHERE contains(" + LOW.format("text") + ", 'tion') AND contains(" + LOW.format("text") + ", 'of the')")
def contains_search(spark, d):
    return S.containing(docs(spark, d), ["tion", "of the"]).select("doc_id")


@query(71, 148, sql=f"""WITH {W}, p AS (SELECT doc_id, unnest(ts) AS token, unnest(range(0, len(ts))) AS pos FROM w)
SELECT x.doc_id, count(*) AS pairs FROM p x JOIN p y ON x.doc_id = y.doc_id AND abs(x.pos - y.pos) <= 5 WHERE x.token = 'and' AND y.token = 'for' GROUP BY 1""")
def near_search(spark, d):
    return S.near(docs(spark, d), "and", "for", 5)


ROUTES = f"{BM25}, r1 AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b ORDER BY rank LIMIT 60), r2 AS (SELECT doc_id, row_number() OVER (ORDER BY length(text), doc_id) AS rank FROM documents WHERE contains({LOW.format('text')}, 'thing') ORDER BY rank LIMIT 60)"


def routes(spark, d):
    short = S.containing(docs(spark, d), ["thing"]).select("doc_id", (-F.length("text")).alias("score"))
    return S.ranked(S.bm25(docs(spark, d), QUERY), 60), S.ranked(short, 60)


@query(154, 159, 161, 249, sql=f"WITH {ROUTES} SELECT doc_id, round(sum(s), 6) AS score FROM (SELECT doc_id, 1.0 / (60 + rank) AS s FROM r1 UNION ALL SELECT doc_id, 0.5 / (60 + rank) FROM r2) GROUP BY 1")
def rrf_fuse(spark, d):
    a, b = routes(spark, d)
    return S.fused([(a, 1.0), (b, 0.5)]).select("doc_id", *r6("score"))


@query(162, sql=f"WITH {ROUTES} SELECT place::BIGINT AS place, doc_id, queue FROM (SELECT rank + (rank - 1) * 3 // 7 AS place, doc_id, 'main' AS queue FROM r1 UNION ALL SELECT ceil(rank * 10 / 3.0), doc_id, 'side' FROM r2) WHERE place <= 20")
def interleave_slots(spark, d):
    a, b = routes(spark, d)
    return S.interleaved(a.select("doc_id", "rank"), b.select("doc_id", "rank"), 20).select(F.col("place").cast("long").alias("place"), "doc_id", "queue")


@query(152, sql="""WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q WHERE vec_id <> query)
SELECT query, vec_id, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, vec_id)::INT AS rank FROM s WHERE s > 0.05) WHERE rank <= 5""")
def dense_topk(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return S.dense_top_k(v, v.where("vec_id % 50 = 0"), 5).select("query", "vec_id", *r6("similarity"), "rank")


def plain_sql(x: str) -> str:
    return "' ' || array_to_string(" + WORDS.format(x) + ", ' ') || ' '"


def normal_sql(x: str) -> str:
    return "trim(regexp_replace(" + LOW.format(x) + ", '[\\x20\\x09-\\x0D]+', ' ', 'g'))"


@query(168, 169, 350, sql=f"""WITH q AS (SELECT item_id, text AS q, {plain_sql('text')} AS pq, {normal_sql('text')} AS nq FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT -1 - n_nationkey, 'The ' || n_name FROM nation UNION ALL SELECT -100, 'OF  the' UNION ALL SELECT -101, 'of, the')),
d AS (SELECT doc_id, text, {plain_sql('text')} AS pd, {normal_sql('text')} AS nd FROM documents)
SELECT item_id, doc_id, CASE WHEN contains(text, q) THEN 'verbatim' WHEN contains(nd, nq) THEN 'normalised' ELSE 'plain' END AS level FROM q JOIN d ON contains(pd, pq) WHERE length(pq) > 2""")
def verify_quote_levels(spark, d):
    more = spark.createDataFrame([(-100, "OF  the"), (-101, "of, the")], "item_id long, text string")
    nations = table(spark, d, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("item_id"), F.concat(F.lit("The "), "n_name").alias("text"))
    quotes = table(spark, d, "benchmark").select("item_id", "text").union(nations).union(more)
    return S.quote_levels(docs(spark, d), quotes)


SHINGLES = WORDS.format("text")
SAMPLE = f"""s0 AS (SELECT doc_id, {SHINGLES} AS ts FROM documents), s AS (SELECT DISTINCT doc_id, g AS shingle FROM (SELECT doc_id, array_to_string(ts[i:i + 4], ' ') AS g FROM (SELECT doc_id, ts, unnest(range(1, len(ts) - 3)) AS i FROM s0 WHERE len(ts) >= 5)) WHERE ('0x' || substr(md5(g), 1, 4))::INT % 8 = 0)"""
CONTAINED = f"{SAMPLE}, z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT x.doc_id, y.doc_id AS other, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2)"


@query(60, 172, 173, sql=f"WITH {CONTAINED} SELECT c.doc_id, other, shared, round(shared / a.n::DOUBLE, 6) AS of_key, round(shared / b.n::DOUBLE, 6) AS of_other FROM c JOIN z a ON a.doc_id = c.doc_id JOIN z b ON b.doc_id = other WHERE shared / a.n::DOUBLE >= 0.3")
def shingle_containment(spark, d):
    s = R.shingle_sample(docs(spark, d))
    return R.contained(s, 0.3).select("doc_id", "other", "shared", *r6("of_key", "of_other"))


@query(174, sql=f"""WITH {SAMPLE}, f AS (SELECT shingle, count(*) AS df FROM s GROUP BY 1), u AS (SELECT doc_id, count(*) AS n, count(*) FILTER (df > 1) AS elsewhere FROM s JOIN f USING (shingle) GROUP BY 1)
SELECT doc_id, n, elsewhere, round(elsewhere / n::DOUBLE, 6) AS of_union, elsewhere / n::DOUBLE >= 0.9 AS covered FROM u""")
def union_containment(spark, d):
    return R.union_contained(R.shingle_sample(docs(spark, d)), 0.9).select("doc_id", "n", "elsewhere", *r6("of_union"), "covered")


@query(175, 343, sql=f"WITH {CONTAINED}, b AS (SELECT c.doc_id, max(shared / a.n::DOUBLE) AS best FROM c JOIN z a ON a.doc_id = c.doc_id GROUP BY 1) SELECT doc_id, round(best, 6) AS best, CASE WHEN best >= 0.85 THEN 'duplicate' WHEN best >= 0.3 THEN 'overlap' ELSE 'new' END AS verdict FROM b")
def duplicate_verdict(spark, d):
    s = R.shingle_sample(docs(spark, d))
    return R.verdict(R.best_containment(s)).select("doc_id", *r6("best"), "verdict")


@query(253, sql="SELECT min(doc_id) AS first, count(*) AS n, length(text)::INT AS chars FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dups(spark, d):
    return R.exact_groups(docs(spark, d))


COUNTS = f"{TOKENS}, c AS (SELECT source AS unit, token, count(*) AS tf FROM t GROUP BY 1, 2)"


@query(180, sql=f"""WITH {COUNTS}, f AS (SELECT token, count(*) AS df FROM c GROUP BY 1), r AS (SELECT unit, c.token, (1 + ln(tf)) * ln((SELECT count(DISTINCT unit) FROM c) / df::DOUBLE) AS w FROM c JOIN f ON f.token = c.token),
v AS (SELECT unit, token, w / sqrt(sum(w * w) OVER (PARTITION BY unit)) AS w FROM r WHERE w > 0) SELECT x.unit AS a, y.unit AS b, round(sum(x.w * y.w), 6) AS cosine FROM v x JOIN v y ON x.token = y.token AND x.unit < y.unit GROUP BY 1, 2""")
def tfidf_cosine(spark, d):
    counts = docs(spark, d).select(F.col("source").alias("unit"), F.explode(T.words(F.col("text"))).alias("token")).groupBy("unit", "token").agg(F.count(F.lit(1)).alias("tf"))
    return R.cosine(R.tfidf(counts, "unit"), "unit").select("a", "b", *r6("cosine"))


@query(132, 133, 217, sql=f"""WITH {TOKENS}, y AS (SELECT token, count(*) FILTER (source = 'src1') AS ya, count(*) FILTER (source <> 'src1') AS yb FROM t GROUP BY 1), s AS (SELECT sum(ya)::DOUBLE AS na, sum(yb)::DOUBLE AS nb FROM y),
p AS (SELECT *, 10 * (ya + yb) / (na + nb) AS a0 FROM y, s) SELECT token, ya, yb, round((ln((ya + a0) / (na + 10 - ya - a0)) - ln((yb + a0) / (nb + 10 - yb - a0))) / sqrt(1 / (ya + a0) + 1 / (yb + a0)), 6) AS z FROM p WHERE ya >= 5""")
def keyness_log_odds(spark, d):
    tokens = docs(spark, d).select((F.col("source") == "src1").alias("inside"), F.explode(T.words(F.col("text"))).alias("token"))
    n = tokens.groupBy("token", "inside").agg(F.count(F.lit(1)).alias("n"))
    return R.keyness(n.where("inside").select("token", "n"), n.where("not inside").select("token", "n")).where("ya >= 5").select("token", "ya", "yb", *r6("z"))


@query(82, 225, sql="""WITH h AS (SELECT lang, count(*) AS docs, count(*) FILTER (contains(text, 'tion')) AS hits, sum(length(text))::BIGINT AS chars, sum((length(text) - length(replace(text, 'tion', ''))) // 4)::BIGINT AS n FROM documents GROUP BY 1)
SELECT lang, docs, hits, n, round(n * 10000 / chars::DOUBLE, 6) AS per_10k FROM h""")
def term_history(spark, d):
    n = T.occurrences(F.col("text"), "tion")
    out = docs(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count(F.when(F.col("text").contains("tion"), 1)).alias("hits"), F.sum(n).alias("n"), F.sum(F.length("text")).alias("chars"))
    return out.select("lang", "docs", "hits", "n", F.round(F.col("n") * 10000 / F.col("chars"), 6).alias("per_10k"))


@query(52, 164, sql="SELECT doc_id, substr(text, greatest(1, p - 20), p + 4 + 20 - greatest(1, p - 20)) AS snippet FROM (SELECT doc_id, text, strpos(text, 'tion') AS p FROM documents) WHERE p > 0")
def kwic_snippets(spark, d):
    at = F.locate("tion", F.col("text"))
    return docs(spark, d).where(at > 0).select("doc_id", T.snippet(F.col("text"), at, 4, 20).alias("snippet"))


@query(70, sql=r"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\n]+')) AS s FROM documents) WHERE contains(s, ' and ') AND contains(s, ' of ')")
def sentence_comention(spark, d):
    s = docs(spark, d).select("doc_id", F.explode(F.split("text", r"[.!?\n]+")).alias("s"))
    return s.where(F.col("s").contains(" and ") & F.col("s").contains(" of ")).select("doc_id").distinct()


@query(259, 299, sql=r"""WITH c AS (SELECT doc_id, length(text) AS n, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS j, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS g, length(text) - length(regexp_replace(text, '[.,;:!?]', '', 'g')) AS p FROM documents)
SELECT doc_id, round(CASE WHEN n > 0 THEN p * 10000 / n::DOUBLE ELSE 0 END, 6) AS punctuation, CASE WHEN j * 10000 / n::DOUBLE >= 300 THEN 'exclude' WHEN j * 10000 / n::DOUBLE >= 50 OR g * 10000 / n::DOUBLE >= 500 THEN 'review' ELSE 'admit' END AS screen FROM c""")
def quality_densities(spark, d):
    return docs(spark, d).select("doc_id", F.round(T.density(F.col("text"), "[.,;:!?]"), 6).alias("punctuation"), R.admission(F.col("text")).alias("screen"))


@query(110, sql=r"""WITH c AS (SELECT length(text) AS n, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS j, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS g, quality FROM documents JOIN labels USING (doc_id)),
f AS (SELECT quality = 0 AS w, j * 10000 / n::DOUBLE >= 50 OR g * 10000 / n::DOUBLE >= 500 AS p FROM c), k AS (SELECT count(*) FILTER (p AND w) AS tp, count(*) FILTER (p AND NOT w) AS fp, count(*) FILTER (NOT p AND w) AS fn, count(*) FILTER (NOT p AND NOT w) AS tn FROM f)
SELECT tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS "precision", round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy FROM k""")
def label_prf(spark, d):
    both = docs(spark, d).join(table(spark, d, "labels"), "doc_id")
    return both.agg(*R.scores(R.admission(F.col("text")) != "admit", F.col("quality") == 0)).select("tp", "fp", "fn", "tn", *r6("precision", "recall", "f1", "accuracy"))


@query(111, sql="""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query, q.label AS ql, v.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.e, q.e), 9) DESC, v.vec_id) AS r
FROM v JOIN v q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id WHERE list_cosine_similarity(v.e, q.e) > 0.05), g AS (SELECT query, sum(CASE WHEN label = ql THEN 1.0 / log2(r + 1) ELSE 0 END) AS dcg, list_sum(list_transform(range(1, least(10, any_value(c)) + 1), lambda i: 1.0 / log2(i + 1))) AS best, avg(CASE WHEN label = ql THEN 1.0 ELSE 0.0 END) AS p FROM s JOIN (SELECT label AS ql, count(*) - 1 AS c FROM v GROUP BY 1) USING (ql) WHERE r <= 10 GROUP BY 1)
SELECT query, round(p, 6) AS precision_10, round(dcg, 6) AS dcg_10, round(dcg / best, 6) AS ndcg_10 FROM g""")
def retrieval_metrics(spark, d):
    v = table(spark, d, "embeddings")
    hits = S.dense_top_k(v.select("vec_id", "embedding"), v.where("vec_id % 50 = 0").select("vec_id", "embedding"), 10)
    both = hits.join(v.select("vec_id", "label"), "vec_id").join(v.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query")
    same = F.when(F.col("label") == F.col("ql"), 1.0).otherwise(0.0)
    like = v.groupBy(F.col("label").alias("ql")).agg((F.count(F.lit(1)) - 1).cast("int").alias("c"))
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("c"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = both.join(like, "ql").groupBy("query").agg(F.avg(same).alias("p"), F.sum(same / F.log2(F.col("rank") + 1)).alias("dcg"), F.first(best).alias("best"))
    return out.select("query", F.round("p", 6).alias("precision_10"), F.round("dcg", 6).alias("dcg_10"), F.round(F.col("dcg") / F.col("best"), 6).alias("ndcg_10"))


@query(13, sql=r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a [^>]*href='))::BIGINT AS links, length(regexp_replace(html, '<[^>]*>', '', 'g'))::BIGINT AS text_chars FROM pages")
def html_extract(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count(h, F.lit("<a [^>]*href=")).cast("long").alias("links"), F.length(F.regexp_replace(h, "<[^>]*>", "")).cast("long").alias("text_chars"))


@query(272, sql="SELECT event_type, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def json_extract(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))


@query(194, 268, sql="SELECT x.p_partkey AS a, y.p_partkey AS b, levenshtein(x.p_name, y.p_name)::INT AS distance FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1")
def edit_distance(spark, d):
    p = table(spark, d, "part")
    x, y = p.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x")), p.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y"))
    return x.join(y, F.col("b") == F.col("a") + 1).select("a", "b", F.levenshtein("x", "y").alias("distance"))
