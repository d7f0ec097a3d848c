"""Copies, alignment, units of variation, trees and contamination on the document, order and line tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collation as C
from ..operators import trees as R
from ..registry import query, table
from .text import LOW, WORDS, r6

PAIRS = "k AS (SELECT doc_id, list_min(list_transform(range(1, len(ts) - 3), lambda i: array_to_string(ts[i:i + 4], ' '))) AS key FROM (SELECT doc_id, " + WORDS.format("text") + " AS ts FROM documents) WHERE len(ts) >= 5), pairs AS (SELECT DISTINCT a, doc_id AS b FROM k JOIN (SELECT key, min(doc_id) AS a FROM k GROUP BY key) USING (key) WHERE doc_id <> a)"
UNITS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|^[\x20\x09-\x0D]+')"


def texts(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query(169, 192, sql=f"WITH {PAIRS} SELECT a, b FROM pairs")
def copies_of_a_base(spark, d):
    return C.copy_pairs(texts(spark, d))


@query(184, sql=f"""WITH {PAIRS}, u AS (SELECT doc_id, {UNITS} AS u FROM documents WHERE doc_id IN (SELECT a FROM pairs UNION SELECT b FROM pairs)),
g AS (SELECT doc_id, i - 1 AS i, array_to_string(u[i:i + 7], '') AS run FROM (SELECT doc_id, u, unnest(range(1, len(u) - 6)) AS i FROM u WHERE len(u) >= 8)), o AS (SELECT doc_id, run, min(i)::INT AS i FROM g GROUP BY 1, 2 HAVING count(*) = 1)
SELECT a, b, count(*) AS anchors, sum(x.i)::BIGINT AS i, sum(y.i)::BIGINT AS j, sum(x.i::BIGINT * y.i)::BIGINT AS ij FROM pairs JOIN o x ON x.doc_id = a JOIN o y ON y.doc_id = b AND y.run = x.run GROUP BY 1, 2""")
def alignment_anchors(spark, d):
    found = C.anchors(texts(spark, d), C.copy_pairs(texts(spark, d)))
    return found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("anchors"), F.sum("i").alias("i"), F.sum("j").alias("j"), F.sum(F.col("i").cast("long") * F.col("j")).alias("ij"))


@query(183, 184, sql=f"WITH {PAIRS} SELECT a, b, length(text)::INT AS chars, md5(text) AS digest FROM pairs JOIN documents ON doc_id = b")
def rebuilt_copies(spark, d):
    made = C.rebuilt(texts(spark, d), C.opcodes(texts(spark, d), C.copy_pairs(texts(spark, d))))
    return made.select("a", "b", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(183)
def alignment_summary(spark, d):
    ops = C.opcodes(texts(spark, d), C.copy_pairs(texts(spark, d)))
    size = F.greatest(F.col("a_to") - F.col("a_from"), F.col("b_to") - F.col("b_from"))
    return ops.groupBy("a", "b", "op").agg(F.count(F.lit(1)).alias("operations"), F.sum(size).alias("units"))


@query(185)
def variants_of_bases(spark, d):
    ops = C.opcodes(texts(spark, d), C.copy_pairs(texts(spark, d)))
    units, readings = C.variant_units(texts(spark, d), ops)
    both = readings.join(units, ["base", "long", "unit"])
    return both.select("base", "long", "unit", "lo", "hi", "lemma", "reading", "n", "witnesses", C.impact(F.col("lemma"), F.col("reading"), ["the", "and"], F.col("long")).alias("impact"))


@query(185, sql="""WITH s AS (SELECT DISTINCT l_suppkey AS supplier, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::INT AS lo, (date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + l_linenumber - 1)::INT AS hi FROM lineitem),
m AS (SELECT *, max(hi) OVER (PARTITION BY supplier ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, lag(lo) OVER w AS l, lag(hi) OVER w AS h FROM s WINDOW w AS (PARTITION BY supplier ORDER BY lo, hi)),
u AS (SELECT *, (sum(CASE WHEN reach IS NULL OR lo > reach OR (lo = reach AND hi > lo AND NOT (l = lo AND h = lo)) THEN 1 ELSE 0 END) OVER (PARTITION BY supplier ORDER BY lo, hi) - 1)::INT AS unit FROM m)
SELECT supplier, unit, min(lo) AS unit_lo, max(hi) AS unit_hi, count(*) AS spans FROM u GROUP BY 1, 2""")
def spans_in_units(spark, d):
    day = F.datediff(F.col("l_shipdate"), F.lit("1992-01-01").cast("date"))
    spans = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), day.alias("lo"), (day + F.col("l_linenumber") - 1).alias("hi"))
    return C.merged_spans(spans, "supplier").groupBy("supplier", "unit", "unit_lo", "unit_hi").agg(F.count(F.lit(1)).alias("spans"))


HEADS = f"{PAIRS}, h AS (SELECT a, b, array_to_string(({UNITS.replace('text', 'x.text')})[1:6], '') AS lemma, array_to_string(({UNITS.replace('text', 'y.text')})[1:6], '') AS reading FROM pairs JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b)"
BARE = "regexp_replace(translate(" + LOW + ", '" + C.T.MARKED + "', '" + C.T.PLAIN + "'), '[^a-z0-9\\x{{80}}-\\x{{10ffff}}]', '', 'g')"


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(186, sql=f"""WITH {HEADS}, w AS (SELECT *, {WORDS.format('lemma')} AS wa, {WORDS.format('reading')} AS wb, regexp_extract_all(lemma, '[0-9]+') AS da, regexp_extract_all(reading, '[0-9]+') AS db FROM h),
x AS (SELECT *, list_concat(list_filter(wa, lambda t: NOT list_contains(wb, t)), list_filter(wb, lambda t: NOT list_contains(wa, t))) AS diff FROM w)
SELECT a, b, CASE WHEN lemma = reading THEN 'none' WHEN {BARE.format('lemma')} = {BARE.format('reading')} AND da = db THEN 'orthographic' WHEN list_sort(wa) = list_sort(wb) AND len(wa) > 1 AND da = db THEN 'order'
WHEN da <> db OR list_has_any(diff, {_listed(C.MEASURES)}) THEN 'quantity' WHEN list_has_any(diff, {_listed(C.NEGATIONS)}) THEN 'negation' WHEN list_has_any(diff, ['the', 'la', 'der', 'el']) THEN 'term'
WHEN trim(reading) = '' THEN 'omission' WHEN trim(lemma) = '' THEN 'addition' ELSE 'wording' END AS impact FROM x""")
def impact_of_openings(spark, d):
    head = texts(spark, d).select("doc_id", F.array_join(F.slice(C.units(F.col("text")), 1, 6), "").alias("head"))
    both = C.copy_pairs(texts(spark, d)).join(head.select(F.col("doc_id").alias("a"), F.col("head").alias("lemma")), "a").join(head.select(F.col("doc_id").alias("b"), F.col("head").alias("reading")), "b")
    return both.select("a", "b", C.impact(F.col("lemma"), F.col("reading"), ["the", "la", "der", "el"]).alias("impact"))


def orders_of_nations(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"), "n_regionkey")
    return o.join(c, "o_custkey").join(n, "c_nationkey")


def brand_profiles(spark, d):
    """(tree, leaf, feature, n): what brands (of lines of each priority) nations order."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    rows = line.join(part, "p_partkey").join(orders_of_nations(spark, d), "o_orderkey")
    return rows.groupBy(F.col("o_orderpriority").alias("tree"), F.col("nation").alias("leaf"), F.col("p_brand").alias("feature")).agg(F.count(F.lit(1)).alias("n"))


@query(187, 188, sql="""WITH c AS (SELECT o_orderpriority AS tree, n_name AS leaf, p_brand AS f, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
s AS (SELECT tree, leaf, f, n / sum(n) OVER (PARTITION BY tree, leaf) AS p FROM c), l AS (SELECT DISTINCT tree, leaf FROM c)
SELECT x.tree, x.leaf AS a, y.leaf AS b, round(1 - coalesce(sum(CASE WHEN q.p IS NOT NULL THEN least(p.p, q.p) END), 0) + 1e-10, 6) AS distance FROM l x JOIN l y ON x.tree = y.tree AND x.leaf < y.leaf LEFT JOIN s p ON p.tree = x.tree AND p.leaf = x.leaf LEFT JOIN s q ON q.tree = y.tree AND q.leaf = y.leaf AND q.f = p.f GROUP BY 1, 2, 3""")
def profile_distances(spark, d):
    far = R.profile_distances(brand_profiles(spark, d))
    return far.select("tree", "a", "b", F.round(F.col("distance") + 1e-10, 6).alias("distance"))  # halves of a last place go up everywhere


@query(188, 190)
def neighbour_trees(spark, d):
    edges = R.neighbour_trees(R.profile_distances(brand_profiles(spark, d)))
    return R.written_trees(edges)


@query(188)
def trees_compared(spark, d):
    """Neighbour joining against average linkage, split by split."""
    far = R.profile_distances(brand_profiles(spark, d))
    return R.split_distance(R.splits(R.neighbour_trees(far)), R.splits(R.linkage_edges(R.average_linkage(far))))


@query(215)
def linkage_groups(spark, d):
    merges = R.average_linkage(R.profile_distances(brand_profiles(spark, d)))
    cuts = R.cut_trees(merges)
    return cuts.select("tree", "leaf", "place", "group", "groups", *r6("height"))


@query(189, sql="""WITH r AS (SELECT unit, witness, clade, arg_min(reading, (-n, reading)) AS reading FROM (SELECT l_partkey AS unit, n_name AS witness, n_regionkey AS clade, l_returnflag AS reading, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
c AS (SELECT unit, clade, reading, count(*) AS n FROM r GROUP BY 1, 2, 3), h AS (SELECT unit, clade, arg_max(reading, n) AS home FROM c GROUP BY 1, 2 HAVING 2 * max(n) > sum(n)),
o AS (SELECT r.witness, r.clade, f.clade AS other, f.home = r.reading AS taken, count(*) FILTER (f.home = r.reading) OVER (PARTITION BY r.unit, r.witness) AS rivals FROM r JOIN h ON h.unit = r.unit AND h.clade = r.clade JOIN h f ON f.unit = r.unit AND f.clade <> r.clade AND f.home <> h.home),
t AS (SELECT witness, clade, other, count(*) AS chances, count(*) FILTER (taken) AS taken, sum(CASE WHEN taken THEN 1.0 / rivals ELSE 0 END) AS support FROM o GROUP BY 1, 2, 3)
SELECT x.witness, x.other, x.chances, x.taken, round(x.support, 6) AS support, round(coalesce(max(y.support), 0), 6) AS back, x.support >= 5 AND x.support >= 0.2 * x.chances AND x.support >= 2 * coalesce(max(y.support), 0) AS mixed
FROM t x LEFT JOIN t y ON y.clade = x.other AND y.other = x.clade GROUP BY x.witness, x.clade, x.other, x.chances, x.taken, x.support""")
def mixed_witnesses(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")).join(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag").join(s, "l_suppkey").groupBy(F.col("l_partkey").alias("unit"), F.col("n_name").alias("witness"), F.col("n_regionkey").alias("clade"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    read = rows.groupBy("unit", "witness", "clade").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("l_returnflag").alias("reading"))).alias("r")).select("unit", "witness", "clade", "r.reading")
    return R.contamination(read, least=5, share=0.2, margin=2).select("witness", "other", "chances", "taken", *r6("support", "back"), "mixed")
