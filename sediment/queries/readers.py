"""Dumps written from the document table and read again, and pages of boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from ..registry import query, table
from ..sources import dumps, records


def dumped(spark, d, markup: bool):
    """A dump of all documents as one would get it, read again: records of title, id and text."""
    docs = table(spark, d, "documents").where("text is not null")
    text = F.col("text")
    if markup:
        text = F.concat(F.lit("== "), "lang", F.lit(" ==\n{{note|from [[File|"), "source", F.lit("]] {{small|"), F.col("doc_id").cast("string"), F.lit("}}}}\n=== body ===\n"), text)
    record = F.concat(F.lit("<page>\n<title>"), dumps.escaped(F.concat("source", F.lit(" & "), "lang")), F.lit("</title><id>"), F.col("doc_id").cast("string"), F.lit('</id>\n<text xml:space="preserve">'), dumps.escaped(text), F.lit("</text></page>"))
    path = records.scratch(spark, "dump")
    docs.select(record.alias("value")).write.text(path)
    return dumps.read_records(spark, path).select(dumps.field(F.col("record"), "title").alias("title"), dumps.field(F.col("record"), "id").cast("long").alias("doc_id"), dumps.field(F.col("record"), "text").alias("text"))


@query(12, sql="SELECT doc_id, source || ' & ' || lang AS title, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def dump_round_trip(spark, d):
    return dumped(spark, d, False).select("doc_id", "title", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(11, sql="""SELECT doc_id, unnest([0, 1, 2]) AS seq, unnest([lang, lang, lang || ' / body']) AS path, unnest(['text/note', 'text/note/small', 'text']) AS layer, unnest([md5('from ' || source || ' '), md5(doc_id::VARCHAR), md5(chr(10) || text)]) AS digest FROM documents WHERE text IS NOT NULL AND trim(text, ' ' || chr(10)) <> ''""")
def dump_segments(spark, d):
    pages = dumped(spark, d, True).select(F.col("doc_id").alias("page"), F.col("text").alias("markup"))
    return dumps.segments(pages).select(F.col("page").alias("doc_id"), "seq", "path", "layer", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(298, sql=r"""WITH w AS (SELECT page_id, regexp_extract_all(html, '[^\x20\x09-\x0D]+') AS ws FROM pages) SELECT page_id, len(ws)::INT AS words, md5(array_to_string(ws, ' ')) AS digest FROM w WHERE len(ws) > 0""")
def pages_in_reading_order(spark, d):
    """Words of a page set as a heading of eight words across and two columns of six words a line below it, then shuffled."""
    words = F.regexp_extract_all("html", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    each = table(spark, d, "pages").select("page_id", words.alias("ws")).select("page_id", F.size("ws").alias("n"), F.posexplode("ws").alias("i", "word"))
    half = F.ceil((F.col("n") - 8) / 12) * 6  # whole lines on the left
    k = F.col("i") - 8
    right = (k >= half).cast("int")
    line = F.floor((k - right * half) / 6)
    x = F.when(F.col("i") < 8, F.col("i") * 56.0).otherwise(right * 240 + F.pmod(k, F.lit(6)) * 36.0)
    wide = F.when(F.col("i") < 8, 50.0).otherwise(30.0)
    y = F.when(F.col("i") < 8, 0.0).otherwise(20.0 + line * 12)
    tilt = F.pmod(F.xxhash64("page_id", "i"), F.lit(3)) - 1.0  # scans are never straight
    boxes = each.select(F.col("page_id").alias("page"), F.xxhash64("page_id", "i").alias("box"), x.alias("x0"), (y + tilt).alias("y0"), (x + wide).alias("x1"), (y + tilt + 10).alias("y1"), "word")
    found = L.reading_order(boxes)
    said = F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda w: w["word"])
    return found.groupBy(F.col("page").alias("page_id")).agg(said.alias("ws")).select("page_id", F.size("ws").alias("words"), F.md5(F.array_join("ws", " ").cast("binary")).alias("digest"))
