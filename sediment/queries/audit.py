"""Claims of benchmark items held against documents, and equations of terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import evidence as E
from ..registry import query, table
from .evidence import SAID
from .text import LOW, WORDS, docs

PARTS = "x[-3] AS subject, x[-2] AS relation, x[-1] AS object, len(x) = 4 AS denied"
AUDITED = f"""e AS (SELECT DISTINCT doc_id AS source, {PARTS} FROM (SELECT doc_id, string_split(unnest(regexp_extract_all({LOW.format('text')}, '{SAID}', 1)), ' ') AS x FROM documents)),
c AS (SELECT item_id, {PARTS} FROM (SELECT item_id, string_split(unnest(regexp_extract_all({LOW.format('text')}, '{SAID}', 1)), ' ') AS x FROM benchmark)),
k AS (SELECT DISTINCT * FROM c), f AS (SELECT k.item_id, k.subject, k.relation, k.object, k.denied, count(DISTINCT source) FILTER (e.object = k.object AND e.denied = k.denied) AS pro, count(DISTINCT source) FILTER (e.object = k.object AND e.denied <> k.denied) AS contra, count(DISTINCT source) FILTER (e.object <> k.object) AS related FROM k JOIN e ON e.subject = k.subject AND e.relation = k.relation GROUP BY 1, 2, 3, 4, 5),
v AS (SELECT c.*, coalesce(pro, 0) AS pro, coalesce(contra, 0) AS contra, coalesce(related, 0) AS related, CASE WHEN pro > 0 AND contra > 0 THEN 'contested' WHEN pro > 0 THEN 'supported' WHEN contra > 0 THEN 'contradicted' WHEN related > 0 THEN 'related' ELSE 'unsupported' END AS verdict FROM c LEFT JOIN f USING (item_id, subject, relation, object, denied))"""


def verdicts(spark, d):
    none = F.lit(None).cast("int")
    claims = E.statements(table(spark, d, "benchmark"), key="item_id").withColumn("at", none)
    evidence = E.statements(docs(spark, d)).select(F.col("doc_id").alias("source"), "subject", "relation", "object", "denied", none.alias("at"))
    return A.audited(claims, evidence, "item_id")


@query(296, 284, sql=f"WITH {AUDITED} SELECT item_id, subject, relation, object, denied, pro, contra, related, verdict FROM v")
def audited_claims(spark, d):
    return verdicts(spark, d).drop("at")


@query(296, sql=f"WITH {AUDITED} SELECT item_id, count(*) AS claims, count(*) FILTER (verdict = 'supported') AS supported, ['contradicted', 'contested', 'unsupported', 'related', 'supported'][min(CASE verdict WHEN 'contradicted' THEN 1 WHEN 'contested' THEN 2 WHEN 'unsupported' THEN 3 WHEN 'related' THEN 4 ELSE 5 END)] AS verdict FROM v GROUP BY 1")
def audited_items(spark, d):
    return A.overall(verdicts(spark, d), "item_id")


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(295, sql=f"""WITH m AS (SELECT DISTINCT term FROM (SELECT unnest({WORDS.format('text')}) AS term FROM benchmark) WHERE length(term) >= 4), k AS (SELECT term, length(term) % 2 = 0 AS modern FROM m),
s AS (SELECT doc_id, i - 1 AS sentence, {WORDS.format('ss[i]')} AS w FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: length(x) > 0) AS ss FROM documents WHERE text IS NOT NULL))),
g AS (SELECT *, row_number() OVER () AS r FROM s WHERE list_has_any(w, {_listed(A.JOINTS)}) AND NOT list_has_any(w, {_listed(A.HEDGES)})),
p AS (SELECT doc_id, sentence, r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS term FROM g), h AS (SELECT p.*, modern FROM p JOIN k USING (term)), j AS (SELECT r, i FROM p WHERE list_contains({_listed(A.JOINTS)}, term))
SELECT a.doc_id, a.sentence::INT AS sentence, a.term AS old, b.term AS modern, count(*) AS n FROM h a JOIN h b ON a.r = b.r AND NOT a.modern AND b.modern AND abs(a.i - b.i) <= 6 WHERE EXISTS (SELECT 1 FROM j WHERE j.r = a.r AND j.i > least(a.i, b.i) AND j.i < greatest(a.i, b.i)) GROUP BY 1, 2, 3, 4""")
def equated_terms(spark, d):
    from .matching import lexicon

    terms = lexicon(spark, d).select(F.col("entry").alias("term"), (F.length("entry") % 2 == 0).alias("modern"))
    return A.equations(docs(spark, d), terms)
