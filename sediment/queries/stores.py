"""The collection store and exports, held against the same change in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query, table
from ..sources import eventlog, records, store
from .graphs import CITES, citations
from .text import WORDS


def filled(spark, d, buckets: int = 8) -> store.Store:
    """Works are sources with their documents as passages."""
    docs = table(spark, d, "documents").select(F.col("source").alias("work"), F.col("doc_id").alias("seq"), "text")
    out = store.Store(spark, records.scratch(spark, "store"), "work string, lang string", "work string, seq long, text string", buckets)
    works = table(spark, d, "documents").groupBy(F.col("source").alias("work")).agg(F.min("lang").alias("lang"))
    out.upsert(works, docs.where("seq % 2 = 0"))
    return out


COUNTED = f"""t AS (SELECT work, unnest({WORDS.format('text')}) AS token FROM p), c AS (SELECT work, count(*) AS n FROM t GROUP BY 1)
SELECT work, count(*) AS passages, any_value(coalesce(n, 0))::BIGINT AS words FROM p LEFT JOIN c USING (work) GROUP BY 1"""


def counted(s: store.Store):
    words = s.read("postings").groupBy("work").agg(F.sum("n").alias("words"))
    return s.read("passages").groupBy("work").agg(F.count(F.lit(1)).alias("passages")).join(words, "work", "left").select("work", "passages", F.coalesce("words", F.lit(0)).cast("long").alias("words"))


@query(25, 28, sql=f"WITH p AS (SELECT source AS work, doc_id AS seq, text FROM documents WHERE CASE WHEN source IN ('src1', 'src2') THEN doc_id % 3 = 0 ELSE doc_id % 2 = 0 END), {COUNTED}")
def store_upsert(spark, d):
    """Two works are replaced, and the index is built anew."""
    s = filled(spark, d)
    docs = table(spark, d, "documents").select(F.col("source").alias("work"), F.col("doc_id").alias("seq"), "text").where("work in ('src1', 'src2') and seq % 3 = 0")
    s.upsert(docs.select("work").distinct().withColumn("lang", F.lit("en")), docs)
    s.reindex()
    return counted(s)


@query(26, sql=f"WITH p AS (SELECT source AS work, doc_id AS seq, text FROM documents WHERE doc_id % 2 = 0 OR (source IN ('src3', 'src4') AND doc_id % 2 = 1)), {COUNTED}")
def store_append(spark, d):
    s = filled(spark, d)
    more = table(spark, d, "documents").where("source in ('src3', 'src4') and doc_id % 2 = 1").select(F.col("source").alias("work"), F.col("doc_id").alias("seq"), "text")
    s.append(more.unionByName(more.limit(1).withColumn("work", F.lit("unknown"))))
    return counted(s)


@query(27, sql=f"WITH p AS (SELECT source AS work, doc_id AS seq, text FROM documents WHERE doc_id % 2 = 0 AND source NOT IN ('src0', 'src5')), {COUNTED}")
def store_delete(spark, d):
    s = filled(spark, d)
    s.delete(spark.createDataFrame([("src0",), ("src5",), ("none",)], "work string"))
    return counted(s)


@query(32, sql=f"""WITH {CITES} SELECT '{{"id":' || n_nationkey || ',"label":"' || n_name || '"}}' AS line FROM nation UNION ALL SELECT '{{"from":' || citing || ',"to":' || cited || ',"weight":' || sum(weight)::BIGINT || '}}' FROM c GROUP BY citing, cited""")
def graph_export(spark, d):
    edges = citations(spark, d).groupBy(F.col("citing").alias("from"), F.col("cited").alias("to")).agg(F.sum("weight").alias("weight"))
    path = records.scratch(spark, "graph")
    store.graph_lines(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label")), edges).write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(38, sql="""SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || n_nationkey || ',' || n_regionkey || ']},"properties":{"n_name":"' || n_name || '"}}' AS line FROM nation""")
def geojson_export(spark, d):
    return store.features(table(spark, d, "nation"), "n_nationkey", "n_regionkey", ["n_name"])


@query(36, sql="""SELECT '"' || doc_id || '","' || coalesce(lang, '') || '","' || replace(left(text, 60), '"', '""') || '"' AS line FROM documents""")
def ledger_export(spark, d):
    return store.ledger_lines(table(spark, d, "documents").withColumn("start", F.left("text", F.lit(60))), ["doc_id", "lang", "start"])


@query(37, sql="SELECT o_orderkey // 500 AS chunk, count(*) AS n, md5(string_agg(o_orderkey || '|' || o_custkey || '|' || o_orderstatus, chr(10) ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1")
def chunked_export(spark, d):
    return store.chunks(table(spark, d, "orders"), "o_orderkey", 500, ["o_orderkey", "o_custkey", "o_orderstatus"])


@query(15, sql="SELECT p_partkey, p_brand AS heading, p_name AS text FROM part")
def text_set_tab(spark, d):
    path = records.scratch(spark, "tab")
    table(spark, d, "part").select(F.concat_ws("\t", F.concat_ws("~", "p_brand", "p_partkey"), "p_name")).write.text(path)
    rows = store.read_text_sets(spark, path, "tab")
    return rows.select(F.substring_index("heading", "~", -1).cast("long").alias("p_partkey"), F.substring_index("heading", "~", 1).alias("heading"), "text")


@query(15, sql="SELECT p_type AS heading, count(*) AS paragraphs, sum(length(p_name) + length(p_brand) + 1)::BIGINT AS chars FROM part GROUP BY 1")
def text_set_markdown(spark, d):
    path = records.scratch(spark, "markdown")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", F.concat_ws("\n", "p_brand", "p_name").alias("t")))), lambda x: x["t"]), "\n\n")
    table(spark, d, "part").groupBy("p_type").agg(body.alias("b")).select(F.concat(F.lit("## "), "p_type", F.lit("\n\n"), "b", F.lit("\n"))).repartition(3).write.text(path)
    rows = store.read_text_sets(spark, path, "markdown")
    return rows.groupBy("heading").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(29, sql="SELECT source AS work, count(*) AS passages FROM documents GROUP BY 1")
def resumed_indexing(spark, d):
    """Documents are taken in as a file stream, a bounded number of files a batch, in two runs over one checkpoint: the
    second run takes up what the first one had not seen."""
    base = records.scratch(spark, "indexing")
    docs = table(spark, d, "documents").select(F.col("source").alias("work"), F.col("doc_id").alias("seq"))
    for turn, part in enumerate(("seq % 2 = 0", "seq % 2 = 1")):
        docs.where(part).repartition(3).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
        run = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(docs.schema).parquet(f"{base}/out").groupBy("work").agg(F.count(F.lit(1)).alias("passages"))


@query(104, sql=f"""WITH {CITES}, e AS (SELECT citing, cited, sum(weight) AS w FROM c WHERE period = 1997 GROUP BY 1, 2 HAVING sum(weight) >= 2) SELECT x.cited AS middle, count(*) AS paths FROM e x JOIN e y ON x.cited = y.citing AND x.citing <> y.cited
WHERE (x.citing, y.cited) NOT IN (SELECT citing, cited FROM e) GROUP BY 1""")
def intermediaries(spark, d):
    from ..operators.graphs import intermediaries as between

    e = citations(spark, d).where("period = 1997").groupBy("citing", "cited").agg(F.sum("weight").alias("w")).where("w >= 2").select("citing", "cited")
    return between(e)


@query(31, sql="SELECT event_type, user_id % 10 AS part, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1, 2")
def log_appends(spark, d):
    """Events come in four batches; each is sent twice, and one is sent after a write that was never committed."""
    log = eventlog.EventLog(spark, records.scratch(spark, "log"), "event_id long, user_id long, event_type string")
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    log._write(events, "lost")
    for turn in range(2):
        for part in range(4):
            log.append(events.where(F.col("event_id") % 4 == part), f"part-{part}")
    return log.read().groupBy("event_type", (F.col("user_id") % 10).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
