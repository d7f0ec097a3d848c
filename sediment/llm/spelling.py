"""Spelling variants of frequent words: the three rarest positional bigrams of a word as keys, then the exact test."""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, fresh, freed, small, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: One edit touches two bigrams at most, so of a word's three rarest one is left.
RAREST = 3
#: Words behind one key that are compared pair by pair; behind larger keys they meet by what one deletion leaves.
PAIRS = 256
#: Different words that a task counts before it hands them on.
_HELD = 200_000


def slipped(doc_id: int | None, word: str, divisor: int) -> str:
    """``word``, or with one letter gone if ``divisor`` divides the crc32 of ``<doc_id>:<word>`` (null id: nothing
    before the colon)."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % divisor:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def corpus_words(docs: DataFrame, divisor: int | None = None, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): the runs of letters in the texts, only A-Z lower-cased, with their count over all documents, where
    they have ``least_length`` code points and ``least_count`` occurrences. With ``divisor`` letters are lost as
    ``slipped`` says, before counting. Counted inside tasks first, so a word in every text is a row a task. Null and
    empty texts have no words, repeated rows count each, no rows give none, other columns are not read."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            rows = [(w, n) for w, n in held.items() if len(w) >= least_length]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = Counter(RUN.findall((text.as_py() or "").translate(_LOWER)))
                if divisor is None:
                    held.update(words)
                else:
                    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in words.items():
                        if zlib.crc32(word.encode(), before) % divisor == 0:
                            word = slipped(doc_id, word, divisor)
                        held[word] += n
                if len(held) >= _HELD:
                    yield out()
        yield out()

    return base.mapInArrow(freed(counted), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def near_words(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, n_a, b, n_b): every two of ``words`` (word, n; a written table of different words of three letters or more)
    that differ by exactly one inserted, deleted or replaced code point, once each: a is the shorter one, or
    the smaller one of equal length.

    Bigrams are ordered by the number of words they are in, the rarest first (then by their text, then by place). Words
    one edit apart match in all bigrams but two, in order, so one of the ``RAREST`` first of either is the same, at the
    same place or one further in the longer word. Words are joined on (length, bigram, place) and compared. A key
    with more than ``pairs`` words is joined by what is left of a word without one letter instead, so no key gives the
    square of its words.
    """
    spark = words.sparkSession
    kind = T.StructType([T.StructField("word", words.schema["word"].dataType), T.StructField("n", T.LongType())])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["gram", "n"])
            held.clear()
            return got

        for batch in batches:
            for word in batch.column(0).to_pylist():
                held.update({word[i : i + 2] for i in range(len(word) - 1)})
            if len(held) >= _HELD:
                yield out()
        yield out()

    counts = words.select("word").mapInArrow(freed(grams), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "grams")
    # two letters of an alphabet: 8,100 rows for the runs above; a larger alphabet is looked up by a join of the same meaning
    order = {g: (n, g) for g, n in counts.collect()} if counts.count() <= _HELD else None

    def keys(probe: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: list[tuple] = []
                for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    size = len(word)
                    first = heapq.nsmallest(RAREST, ((*order[word[i : i + 2]], i) for i in range(size - 1)))
                    for _, gram, i in first:
                        rows.append((size, gram, i, word, n, size))
                        if probe:
                            rows.append((size + 1, gram, i, word, n, size))
                            rows.append((size + 1, gram, i + 1, word, n, size))
                cols = list(zip(*rows)) or [()] * 6
                types = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        return freed(run)

    names = ["size", "gram", "place", "word", "n", "own"]
    kinds = "size int, gram string, place int, word string, n long, own int"
    if order is None:
        ranked = _ranked_by_join(words, counts)
        index = written(ranked.select(F.col("own").alias("size"), "gram", "place", "word", "n", "own"), "index")
        ways = F.explode(F.array(F.struct(F.col("own").alias("size"), F.col("place").alias("at")), F.struct((F.col("own") + 1).alias("size"), F.col("place").alias("at")), F.struct((F.col("own") + 1).alias("size"), (F.col("place") + 1).alias("at"))))
        probes = written(ranked.select("gram", "word", "n", "own", ways.alias("_w")).select("_w.size", "gram", F.col("_w.at").alias("place"), "word", "n", "own"), "probes")
    else:
        base = words.select("word", "n").to(kind)
        index = written(base.mapInArrow(keys(False), kinds), "index")
        probes = written(base.mapInArrow(keys(True), kinds), "probes")
    key = ["size", "gram", "place"]
    hot = written(index.groupBy(*key).agg(F.count(F.lit(1)).alias("_many")).where(F.col("_many") > pairs).select(*key), "hot")
    left = probes.select(*key, F.col("word").alias("a"), F.col("n").alias("n_a"), "own")
    right = index.select(*key, F.col("word").alias("b"), F.col("n").alias("n_b"))
    if hot.isEmpty():
        met = left.join(right, key)
    else:
        few = small(hot)
        met = left.join(few, key, "left_anti").join(right.join(few, key, "left_anti"), key)
        met = met.select("a", "n_a", "b", "n_b", "own", "size").unionByName(_by_deletion(left.join(few, key, "left_semi"), right.join(few, key, "left_semi"), key).select("a", "n_a", "b", "n_b", "own", "size"))
    one = (F.col("a") != F.col("b")) & ((F.col("size") > F.col("own")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    found = written(met.where(one).select("a", "n_a", "b", "n_b").distinct(), "near")
    discard(counts, index, probes, hot)
    return found


def _ranked_by_join(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, n, own, gram, place): the rarest bigrams of each word, for alphabets whose bigrams no task can hold."""
    each = words.select("word", "n", F.char_length("word").alias("own"), F.posexplode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))).alias("place", "gram"))
    seen = each.join(counts.select("gram", F.col("n").alias("_f")), "gram")
    first = F.slice(F.array_sort(F.collect_list(F.struct("_f", "gram", "place"))), 1, RAREST)  # at most a word's length
    return seen.groupBy("word", "n", "own").agg(first.alias("_g")).select("word", "n", "own", F.explode("_g").alias("_g")).select("word", "n", "own", "_g.gram", "_g.place")


def _by_deletion(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Pairs behind large keys: words of equal length that are the same without the letter at one place, and words that
    are another one without a letter. As many keys as letters, whatever the number of words behind ``key``."""

    def without(word: str) -> F.Column:
        return F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.struct(i.alias("at"), F.xxhash64(F.substr(word, F.lit(1), i - 1), F.lit("\n"), F.expr(f"substr({word}, 1)").substr(i + 1, F.char_length(word))).alias("rest"), F.xxhash64(F.concat(F.substr(word, F.lit(1), i - 1), F.col(word).substr(i + 1, F.char_length(word)))).alias("whole")))

    same = left.where("size = own").withColumn("_d", F.explode(without("a"))).select("*", F.col("_d.at").alias("_at"), F.col("_d.rest").alias("_rest")).drop("_d")
    other = right.withColumn("_d", F.explode(without("b"))).select(*key, "b", "n_b", F.col("_d.at").alias("_at"), F.col("_d.rest").alias("_rest"), F.col("_d.whole").alias("_whole"))
    replaced = same.join(other.drop("_whole"), [*key, "_at", "_rest"]).drop("_at", "_rest")
    shorter = left.where("size > own").withColumn("_whole", F.xxhash64("a"))
    inserted = shorter.join(other.drop("_at", "_rest"), [*key, "_whole"]).drop("_whole")
    return replaced.unionByName(inserted)


def spelling_variants(words: DataFrame, factor: int = 5, pairs: int = PAIRS) -> DataFrame:
    """(word, form, root, n, n_near, form_n), and the other columns of ``words`` (word, n; different words; columns with
    the names of results are replaced), for every word.

    Two words are near if they differ by one code point inserted, deleted or replaced. A word's form is its near word
    of largest n (ties: the smallest in code-point order), if that n is ``factor`` times its own or more; root follows
    forms to the last. Rows whose word or n is null have no form and are near nothing; words under three code points
    are near nothing. Repeated rows of one word must not be given. An empty table gives no rows.
    """
    base = written(words.withColumns({"word": F.col("word").cast("string"), "n": F.col("n").cast("long")}), "words")
    able = written(base.where("word is not null and n is not null and char_length(word) >= 3").select("word", "n"), "able")
    near = near_words(able, pairs)
    both = near.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m"))
    both = both.unionByName(near.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("_best"))
    takes = -F.col("_best.m") >= factor * F.col("n")
    best = written(best.select("word", "n_near", F.when(takes, F.col("_best.other")).alias("form"), F.when(takes, -F.col("_best.m")).alias("form_n")), "best")
    roots = written(best.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:  # n grows by the factor at every step, so chains are short, and each round halves them
        up = roots.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        moved = written(roots.join(up, roots.root == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")), "roots")
        discard(roots)
        roots = moved.drop("_moved")
        if not moved.where("_moved").limit(1).count():
            break
    rest = [c for c in base.columns if c.lower() not in ("form", "root", "n_near", "form_n")]
    key, key2 = fresh(base.columns, "_best_word", "_root_word")
    out = base.select(*[F.col("`" + c.replace("`", "``") + "`") for c in rest])
    out = out.join(best.withColumnRenamed("word", key), F.col("word") == F.col(key), "left").drop(key)
    out = out.join(roots.withColumnRenamed("word", key2), F.col("word") == F.col(key2), "left").drop(key2)
    out = out.withColumns({"root": F.coalesce("root", "word"), "n_near": F.coalesce("n_near", F.lit(0).cast("long"))})
    discard(able, near)
    return out


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_variants(corpus_words(docs, divisor=199)).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 is spelled out over the bytes of each (document, run): its table is one row a byte, made by eight halvings.
OP11_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i AS b, i::UBIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents WHERE text IS NOT NULL),
each AS (SELECT doc_id, run, count(*) AS k, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs GROUP BY doc_id, run),
hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, octet_length(encode(s)) + 1),
      lambda i: ('0x' || hex(encode(s))[2 * i - 1:2 * i])::UBIGINT)),
    lambda c, x: xor(c >> 8, t[CAST(xor(c & 255, x) AS BIGINT) + 1])), 4294967295::UBIGINT) AS h
  FROM each, tab),
spelled AS (
  SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelled GROUP BY word HAVING sum(k) >= 5 AND length(word) >= 6),
cut AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i - 1) AS head, substring(word, i + 1) AS tail FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION
  SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.head || a.tail = b.word
  UNION
  SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.head || a.tail = b.word),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
form AS MATERIALIZED (
  SELECT best.word, n_near, CASE WHEN best.m >= 5 * best.n THEN min(other) END AS form, CASE WHEN best.m >= 5 * best.n THEN best.m END AS form_n
  FROM best JOIN near ON best.word = near.word AND best.m = near.m GROUP BY best.word, best.n, best.m, n_near),
up AS (
  SELECT word, word AS root, 0 AS k FROM words
  UNION ALL
  SELECT up.word, form.form, k + 1 FROM up JOIN form ON form.word = up.root WHERE form.form IS NOT NULL)
SELECT words.word, form.form, r.root, words.n, coalesce(form.n_near, 0) AS n_near, form.form_n
FROM words LEFT JOIN form ON form.word = words.word JOIN (SELECT word, arg_max(root, k) AS root FROM up GROUP BY word) r ON r.word = words.word
"""
