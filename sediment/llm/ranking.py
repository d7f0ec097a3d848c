"""The best documents for each item by impact-ordered, score-at-a-time ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, freed, written
from .words import ALNUM, U, Words, pieces

#: Bytes of item text that one index of queries is made of; more items are taken in several passes.
SLICE_BYTES = 8 << 20
#: Postings that a task holds at a time: documents are ranked in blocks of about so many.
BLOCK = 1 << 20
#: Postings that an item takes before it first looks whether it may stop; then twice as many each time.
FIRST = 1 << 12
_EXACT = 1 << 53


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words): maximal runs of ASCII letters and digits and all characters beyond
    ASCII, A-Z lower-cased. NUL parts words, as all other ASCII does."""
    for first, last, data, offsets in pieces(texts):
        yield first, last, Words(data, offsets, ALNUM)


class Queries:
    """Items as (term number, times) and the sorted hashes of all their terms."""

    def __init__(self, texts: list[str]):
        each: list[np.ndarray] = []
        for _, _, words in word_hashes(pa.array(texts, pa.string())):
            each += [words.hash[a:b] for a, b in zip(words.row[:-1], words.row[1:])]
        self.terms = np.unique(np.concatenate([np.zeros(0, U), *each]))
        self.items = [tuple(np.unique(np.searchsorted(self.terms, h), return_counts=True)) for h in each]


def postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, times) for every row of ``docs`` (doc_id, text): how many terms the text has, and which
    of ``terms`` (sorted hashes) it holds how often. Terms are told apart by hashes of 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = max(1, len(terms))
        for batch in batches:
            for first, last, words in word_hashes(batch.column(1)):
                at = np.searchsorted(terms, words.hash)
                known = np.flatnonzero(at < len(terms))
                known = known[terms[at[known]] == words.hash[known]]
                row = np.repeat(np.arange(last - first), np.diff(words.row))[known]
                key, times = np.unique(row * wide + at[known], return_counts=True)
                offsets = pa.array(np.searchsorted(key, np.arange(last - first + 1) * wide).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key % wide, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(np.diff(words.row).astype(np.int64)), *lists], names=["doc_id", "n", "terms", "times"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(freed(run), "doc_id long, n long, terms array<int>, times array<int>")


def impacts(times: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What one occurrence of a term in an item is worth in a document, for a weight of 1."""
    sizes, which = np.unique(n, return_inverse=True)
    m = np.array([100 - 25 + 25 * int(x) * documents // words for x in sizes], np.int64)[which]  # whole numbers of any size
    return 1_000_000_000 * times // (1000 * times + 12 * m)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] numbers), start[1], ..."""
    end = np.cumsum(size)
    return np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)


class Block:
    """Postings of some documents: by document, and by term with the impacts of a term descending and documents of equal
    impact together (a segment)."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, terms: np.ndarray, impact: np.ndarray):
        self.ids, self.offsets, self.terms, self.impact = ids, offsets, terms, impact
        row = np.repeat(np.arange(len(ids)), np.diff(offsets))
        order = np.lexsort((-impact, terms))
        self.rows = row[order]
        term, value = terms[order], impact[order]
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (value[1:] != value[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.start, self.size = new, np.diff(np.append(new, len(term)))
        self.value = value[new]
        self.term = term[new]

    def best(self, item: np.ndarray, weight: np.ndarray, worth: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of documents that may be among the ``k`` best and score ``floor`` or more; scores are
        whole. ``item``: term numbers; ``weight``: of each, times its occurrences in the item; ``worth``: the same for
        all terms (0 for others).

        Segments are taken by what they add, the most first. What no segment left can add to is bounded by the
        next segment of each term; when the bound is under the k-th best sum so far, no document unseen can come
        in, and those seen that still may are scored whole."""
        low, high = np.searchsorted(self.term, item), np.searchsorted(self.term, item, "right")
        count = high - low
        segment = _ranges(low, count)
        owner = np.repeat(np.arange(len(item)), count)
        adds = weight[owner] * self.value[segment]
        order = np.argsort(-adds, kind="stable")
        segment, owner, adds = segment[order], owner[order], adds[order]
        total = np.cumsum(self.size[segment])
        scores = np.zeros(len(self.ids), np.int64)
        exact = int(weight.sum()) * 1_000_000 < _EXACT
        taken, at, step = np.zeros(len(item), np.int64), 0, FIRST
        while at < len(segment):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step, "right")))
            part = segment[at:end]
            rows = self.rows[_ranges(self.start[part], self.size[part])]
            gains = np.repeat(adds[at:end], self.size[part])
            if exact:  # sums of whole numbers under 2^53 are whole in doubles
                scores += np.bincount(rows, gains, len(scores)).astype(np.int64)
            else:
                np.add.at(scores, rows, gains)
            taken += np.bincount(owner[at:end], minlength=len(item))
            at, step = end, step * 2
            if at == len(segment):
                break
            left = taken < count
            bound = int((weight[left] * self.value[(low + taken)[left]]).sum())
            sure = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0)
            if bound < sure:
                seen = np.flatnonzero(scores + bound >= sure)
                return seen, self.whole(seen, worth)
        seen = np.flatnonzero(scores >= max(1, floor))
        return seen, scores[seen]

    def whole(self, rows: np.ndarray, worth: np.ndarray) -> np.ndarray:
        """Complete scores of some documents."""
        size = np.diff(self.offsets)[rows]
        at = _ranges(self.offsets[rows], size)
        gained = np.concatenate([[0], np.cumsum(worth[self.terms[at]] * self.impact[at])])
        end = np.cumsum(size)
        return gained[end] - gained[end - size]


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring rows of ``docs`` (doc_id, text) for each row of ``items``
    (item_id, text), rank 1 first, equal scores by doc_id (null last).

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, only A-Z lower-cased. With N
    documents of one term or more, L terms in all, n in a document and df documents holding a term, its weight is
    floor(1000 ln((2N + 2) / (2 df + 1))), a document's m is 75 + (25 n N) div L, and a term that occurs tf times adds weight
    * ((10^9 tf) div (1000 tf + 12 m)), as often as the item has it.

    One pass over the texts writes the postings of the items' terms; Spark counts N, L and df from them. Tasks then
    rank blocks of documents: postings of a term lie in segments of equal impact, segments are taken from the largest
    gain down until the bounds of what is left prove the best ``k``, and what may be among them is scored whole. A task
    keeps k rows an item, which later blocks must reach; the k best of all tasks are few rows. Items of more than
    ``slice_bytes`` of text are taken slice by slice, each with a pass of its own, so what the driver and a task hold is
    bounded.

    Null and empty texts have no terms and are found by nothing; items without terms, or with terms that no document
    has, find nothing. Repeated rows of ``docs`` are rows of their own; so are repeated rows of ``items``, each with all
    ranks under its item_id. Long texts are read whole. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-size // slice_bytes))
    sliced = asked.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)))
    out = []
    for s in range(slices):
        rows = sorted(map(tuple, sliced.where(F.col("slice") == s).select("item_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        best = _ranked(docs, Queries([t for _, t in rows]), [i for i, _ in rows], k)
        if best is not None:
            out.append(best)
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _ranked(docs: DataFrame, queries: Queries, names: list[int | None], k: int) -> DataFrame | None:
    lists = written(postings(docs, queries.terms), "postings")
    documents, words = lists.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    if not documents:
        discard(lists)
        return None
    df = np.zeros(len(queries.terms), np.int64)
    held = lists.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    for t, n in held.collect():  # no more rows than a slice of items has terms
        df[t] = n
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    asked = [(i, terms, weight[terms] * times) for i, (terms, times) in enumerate(queries.items) if len(terms)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, list[tuple]] = {}
        worth = np.zeros(len(weight), np.int64)
        for block in blocks(batches, documents, words):
            for i, terms, values in asked:
                top = have.get(i, [])
                worth[terms] = values
                rows, scores = block.best(terms, values, worth, k, top[-1][0] if len(top) == k else 1)
                worth[terms] = 0
                if len(rows) > k:
                    least = max(1, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                    rows, scores = rows[scores >= least], scores[scores >= least]
                elif len(rows):
                    rows, scores = rows[scores > 0], scores[scores > 0]
                if len(rows):
                    new = [(int(v), block.ids[r]) for v, r in zip(scores, rows)]
                    have[i] = sorted(top + new, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        flat = [(i, d, v) for i, top in have.items() for v, d in top]
        cols = list(zip(*flat)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["item", "doc_id", "score"])

    best = written(lists.where("n > 0").mapInArrow(freed(run), "item int, doc_id long, score long"), "best")
    discard(lists)
    known = docs.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "item int, item_id long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(F.broadcast(known), "item").select("item_id", "rank", "doc_id", "score")


def blocks(batches: Iterator[pa.RecordBatch], documents: int, words: int, size: int = BLOCK) -> Iterator[Block]:
    """Blocks of about ``size`` postings (one document is never cut)."""
    held: list[tuple] = []
    count = 0
    for batch in batches:
        lists, times = batch.column(2), batch.column(3)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        n = batch.column(1).to_numpy()
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size - count, "right")) - 1)
            sizes = np.diff(offsets[first : last + 1])
            term, time = (x.slice(first, last - first).flatten().to_numpy().astype(np.int64) for x in (lists, times))
            ids = np.array(batch.column(0).slice(first, last - first).to_pylist(), object)
            held.append((ids, sizes, term, impacts(time, np.repeat(n[first:last], sizes), documents, words)))
            count += len(term)
            first = last
            if count >= size:
                yield _block(held)
                held, count = [], 0
    if held:
        yield _block(held)


def _block(held: list[tuple]) -> Block:
    ids, sizes, terms, impact = (np.concatenate(x) for x in zip(*held))
    return Block(ids, np.concatenate([[0], np.cumsum(sizes)]), terms, impact)


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ranked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


OP13_SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents WHERE text IS NOT NULL),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
len AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
tot AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM len),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, tot GROUP BY term),
asked AS (
  SELECT item_id, term, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL)
  GROUP BY item_id, term),
scored AS (
  SELECT item_id, tf.doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN len ON len.doc_id = tf.doc_id, tot
  GROUP BY item_id, tf.doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 20
"""
