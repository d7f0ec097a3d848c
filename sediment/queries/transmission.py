"""Quotations, transmission and fragments in the document table, where the number of a document is its time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transmission as X
from ..registry import query, table
from .text import WORDS


def passages(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("work"), F.col("doc_id").alias("passage"), F.col("doc_id").alias("at"), "text").where("work is not null")


GRAMS = "w AS (SELECT source AS work, doc_id AS p, " + WORDS.format("text") + " AS ts FROM documents WHERE source IS NOT NULL), g AS (SELECT work, p, i - 1 AS pos, array_to_string(ts[i:i + 5], ' ') AS run FROM (SELECT *, unnest(range(1, len(ts) - 4)) AS i FROM w WHERE len(ts) >= 6))"
QUOTED = f"""{GRAMS}, f AS (SELECT run, arg_min({{'work': work, 'p': p, 'pos': pos}}, (p, work, pos)) AS f FROM g GROUP BY 1 HAVING count(*) > 1),
m AS (SELECT g.work, g.p, g.pos, f.work AS sw, f.p AS sp, g.pos - f.pos AS d FROM g JOIN f USING (run) WHERE g.p > f.p AND g.work <> f.work),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY p, sp, d ORDER BY pos) AS i FROM m),
s AS (SELECT work, p AS passage, min(pos)::INT AS start, (max(pos) + 6)::INT AS "end", sw AS source_work, sp AS source, (min(pos) - d)::INT AS source_start FROM i GROUP BY work, p, sw, sp, d, i HAVING max(pos) + 6 - min(pos) >= 8)"""


@query(181, 169, sql=f'WITH {QUOTED} SELECT work, passage, start, "end", source_work, source, source_start FROM s')
def quoted_spans(spark, d):
    return X.quotations(passages(spark, d))


@query(181, 182, 103, sql=f'WITH {QUOTED} SELECT source_work, work, count(*) AS spans, sum("end" - start)::BIGINT AS words, count(DISTINCT passage) AS passages FROM s GROUP BY 1, 2')
def works_that_pass_on(spark, d):
    return X.passed_on(X.quotations(passages(spark, d)))


@query(181, sql=f"""WITH {QUOTED}, c AS (SELECT passage, unnest(range(start, "end")) AS place FROM s), u AS (SELECT DISTINCT passage, place FROM c)
SELECT passage, count(*) AS places, count(*) FILTER (NOT EXISTS (SELECT 1 FROM u v WHERE v.passage = u.passage AND v.place = u.place - 1)) AS stretches FROM u GROUP BY 1""")
def quoted_share(spark, d):
    return X.covered(X.quotations(passages(spark, d)), ["passage"])


@query(193, sql=f"""WITH {GRAMS}, l AS (SELECT p, pos, run FROM g WHERE work = 'src1'), h AS (SELECT run, work, min(p) AS witness FROM g WHERE work <> 'src1' GROUP BY 1, 2),
k AS (SELECT l.*, (SELECT min(witness) FROM h WHERE h.run = l.run) AS witness FROM l WHERE run IN (SELECT run FROM h)),
n AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY p ORDER BY pos) + 6 THEN 0 ELSE 1 END AS new FROM k), f AS (SELECT *, (sum(new) OVER (PARTITION BY p ORDER BY pos) - 1)::INT AS fragment FROM n)
SELECT p AS passage, fragment, min(f.pos)::INT AS start, (max(f.pos) + 6)::INT AS "end", count(DISTINCT h.work) AS witnesses, arg_min(f.witness, f.pos) AS first_witness FROM f JOIN h USING (run) GROUP BY 1, 2""")
def fragments_of_a_lost_source(spark, d):
    p = passages(spark, d)
    return X.fragments(p.where("work = 'src1'"), p.where("work <> 'src1'"))
