"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming blocks, exact check."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_place, discard, fresh, freed, small, written
from .words import ALNUM, U, Words, pieces, shingled

#: Words of a window, for items from that many words on; items under the first have windows of their own length.
WINDOWS = (8, 12, 16, 24, 40, 64, 96, 128, 192, 256, 384, 512, 768, 1024)
#: All fingerprints within this Hamming distance of an item's are found: in one of 4 blocks of 16 bits they
#: differ in at most one bit.
RADIUS = 7
BLOCKS = 4
#: Bytes of benchmark text in one index; a larger benchmark is taken in several passes.
SLICE_BYTES = 8 << 20
_PIECE = 1 << 15
#: Bits of the filter that says whether a shingle may be in the benchmark.
_FILTER = 20


def window_sums(signs: np.ndarray, width: int, kept: dict[int, np.ndarray]) -> np.ndarray:
    """Sums of ``width`` rows from every row on, from sums of powers of two in ``kept``."""
    kind = np.int8 if width < 128 else np.int32
    n = len(signs)
    out, at, m = None, 0, n - width + 1
    for p in range(width.bit_length()):
        if (p, kind) not in kept:
            if p == 0:
                kept[p, kind] = signs.astype(kind, copy=False)
            else:
                last = kept[p - 1, kind]
                half = 1 << (p - 1)
                kept[p, kind] = last[: max(0, len(last) - half)] + last[half:]
        if width >> p & 1:
            part = kept[p, kind][at : at + m]
            out = part if out is None else out + part
            at += 1 << p
    return out


def fingerprints(h: np.ndarray, width: int, kept: dict) -> np.ndarray:
    """SimHash of the window from every word on (as far as windows fit)."""
    if len(h) < width:
        return np.zeros(0, U)
    if "signs" not in kept:
        bits = np.unpackbits(h.view(np.uint8)).reshape(len(h), 64)
        signs = bits.view(np.int8)
        signs <<= 1
        signs -= 1
        kept["signs"] = signs
    return np.packbits(window_sums(kept["signs"], width, kept) > 0, axis=1).view(U).reshape(-1)


def window_for(words: int) -> int:
    fitting = [w for w in WINDOWS if w <= words]
    return fitting[-1] if fitting else words


class Index:
    """Items of a benchmark (item id, text), or a slice of one.

    A shingle weighs 1 + log(n / df) for the ``n`` items and ``df`` of them that hold it; ``n`` and ``df`` (shingles,
    ascending, and their counts) are those of the whole benchmark and are counted here where they are not given. All
    is kept in arrays: words, and for each item its distinct shingles with counts and weights.
    """

    def __init__(self, items: list[tuple[int | None, str]], shingle: int = 5, percent: int = 80, n: int | None = None, df: tuple[np.ndarray, np.ndarray] | None = None):
        self.k, self.percent = shingle, percent
        found = Words(*_laid([t for _, t in items]), ALNUM)
        worded = np.flatnonzero(np.diff(found.row))
        self.ids = [items[i][0] for i in worded]
        self.sizes = np.diff(found.row)[worded].astype(np.int64)
        self.words, self.at = found.hash, np.concatenate([found.row[worded], found.row[-1:]]).astype(np.int64)
        bags = [np.unique(shingled(self._item(i), shingle), return_counts=True) for i in range(len(self.ids))]
        self.bag_at = np.concatenate([[0], np.cumsum([len(b[0]) for b in bags])]).astype(np.int64)
        self.keys = np.concatenate([np.zeros(0, U), *(b[0] for b in bags)])
        self.counts = np.concatenate([np.zeros(0, np.int32), *(b[1].astype(np.int32) for b in bags)])
        n = max(1, len(self.ids) if n is None else n)
        known, held = np.unique(self.keys, return_counts=True) if df is None else df
        self.rare = 1 + math.log(n)
        self.weights = 1 + np.log(n / held[np.searchsorted(known, self.keys)]) if len(self.keys) else np.zeros(0)
        probes: dict[int, list[tuple[int, int, int]]] = {}
        for i, size in enumerate(self.sizes.tolist()):
            width = window_for(size)
            prints = fingerprints(self._item(i), width, {})
            for place in sorted({0, size - width}):
                probes.setdefault(width, []).append((int(prints[place]), i, place))
        self.widths = {w: self._blocks(p) for w, p in probes.items()}
        self.filter = np.zeros(1 << _FILTER, bool)
        self.filter[self.keys >> U(64 - _FILTER)] = True

    def _item(self, i: int) -> np.ndarray:
        return self.words[self.at[i] : self.at[i] + self.sizes[i]]

    @staticmethod
    def _blocks(probes: list[tuple[int, int, int]]):
        prints = np.array([p[0] for p in probes], U)
        near = np.concatenate([[0], 1 << np.arange(16)]).astype(np.uint16)
        tables = []
        for block in prints.view(np.uint16).reshape(-1, BLOCKS).T:
            value = (block[:, None] ^ near[None, :]).reshape(-1)
            probe = np.repeat(np.arange(len(prints)), len(near))
            order = np.argsort(value, kind="stable")
            begin = np.searchsorted(value[order], np.arange(65537))
            tables.append((begin.astype(np.int32), np.diff(begin).astype(np.int32), np.diff(begin) > 0, probe[order].astype(np.int32)))
        return prints, np.array([p[1] for p in probes]), np.array([p[2] for p in probes]), tables

    def similarity(self, item: int, found: np.ndarray) -> float:
        """Weighted Jaccard of shingle counts of an item with those of the shingles ``found``. Rare shingles of the
        benchmark weigh more; one that the item does not hold weighs as much as the rarest."""
        a, b = self.bag_at[item], self.bag_at[item + 1]
        keys, counts, weights = self.keys[a:b], self.counts[a:b], self.weights[a:b]
        other, many = np.unique(found, return_counts=True)
        place = np.minimum(np.searchsorted(keys, other), len(keys) - 1)
        same = keys[place] == other
        theirs = np.zeros(len(keys), np.int64)
        theirs[place[same]] = many[same]
        low = float((weights * np.minimum(counts, theirs)).sum())
        high = float((weights * np.maximum(counts, theirs)).sum()) + self.rare * int(many[~same].sum())
        return low / high if high else 0.0

    def _verified(self, item: int, start: int, h: np.ndarray) -> float:
        """Best similarity of the item with a span that starts and ends within a word of where ``start`` puts it."""
        best, size = 0.0, int(self.sizes[item])
        low = max(0, start - 1)
        near = shingled(h[low : start + size + 2], self.k)
        for shift in (0, -1, 1):
            for more in (0, -1, 1):
                a, b = max(0, start + shift), min(len(h), start + shift + size + more)
                if b > a:
                    best = max(best, self.similarity(item, near[a - low : b - low - self.k + 1] if b - a >= self.k else shingled(h[a:b], self.k)))
        return best

    def search(self, column: pa.Array) -> list[tuple[int, int, int, float]]:
        """(row, item id, first word, similarity), one for each item that a row holds: its most similar span, the
        earliest of these."""
        hits: dict[tuple[int, int], tuple[int, float]] = {}
        for first, _, data, offsets in pieces(column, _PIECE):
            words = Words(data, offsets, ALNUM)
            n = len(words.hash)
            if not n:
                continue
            rows = np.repeat(np.arange(len(offsets) - 1), np.diff(words.row))
            left = words.row[1:][rows] - np.arange(n)
            kept: dict = {}
            shared = begins = None
            tried = set()
            for width, (prints, items, places, tables) in self.widths.items():
                found = fingerprints(words.hash, width, kept)
                if not len(found):
                    continue
                value = found.view(np.uint16).reshape(-1, BLOCKS)
                fits = left[: len(found)] >= width
                pairs = []
                for b, (begin, count, has, probe) in enumerate(tables):
                    at = np.flatnonzero(has[value[:, b]] & fits)
                    own = value[at, b]
                    many = count[own]
                    to = np.cumsum(many) - many
                    which = probe[np.repeat(begin[own] - to, many) + np.arange(many.sum())]
                    at = np.repeat(at, many)
                    close = np.bitwise_count(found[at] ^ prints[which]) <= RADIUS
                    pairs.append(np.stack([at[close], which[close]]))
                at, which = np.concatenate(pairs, axis=1)
                if not len(at):
                    continue
                if shared is None:
                    keys, begin = words.shingles(self.k)
                    shared, begins = np.concatenate([[0], np.cumsum(self.filter[keys >> U(64 - _FILTER)])]), begin
                # a span without a shingle of the benchmark can't be similar
                row, size = rows[at], self.sizes[items[which]]
                start = at - words.row[row] - places[which]
                low = np.clip(start - 1, 0, None) + begins[row]
                high = np.minimum(np.maximum(start + size + 2, 1) + begins[row], begins[row + 1])
                may = shared[high] > shared[np.minimum(low, high)]
                for at, which in sorted(set(zip(at[may].tolist(), which[may].tolist()))):
                    row, item = int(rows[at]), int(items[which])
                    start = at - int(words.row[row]) - int(places[which])
                    if (row, item, start) in tried:
                        continue
                    tried.add((row, item, start))
                    score = self._verified(item, start, words.hash[words.row[row] : words.row[row + 1]])
                    old = hits.get((first + row, item))
                    if 100 * score >= self.percent and (old is None or (score, -max(0, start)) > (old[1], -old[0])):
                        hits[first + row, item] = (max(0, start), score)
        return [(row, self.ids[item], start, score) for (row, item), (start, score) in sorted(hits.items())]


def _laid(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def indexes(benchmark: DataFrame, shingle: int = 5, percent: int = 80, slice_bytes: int = SLICE_BYTES) -> Iterator[Index]:
    """Indexes over all items, each of about ``slice_bytes`` of text, so what the driver and a task hold is bounded.
    Weights are those of the whole benchmark: with several slices Spark counts the items of every shingle, and the
    driver gets the counts of one slice's shingles at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = -(-size // slice_bytes) or 1
    if slices == 1:
        yield Index(sorted(map(tuple, items.collect()), key=_first_null), shingle, percent)
        return

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in pieces(batch.column(1)):
                words = Words(data, offsets, ALNUM)
                each = [np.unique(shingled(words.hash[a:b], shingle)) for a, b in zip(words.row[:-1], words.row[1:])]
                part = np.repeat(batch.column(0).slice(first, last - first).to_numpy(), [len(x) for x in each])
                first_one = np.concatenate([np.zeros(0, bool), *(np.arange(len(x)) == 0 for x in each)])
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.concatenate([np.zeros(0, U), *each]).view(np.int64)), pa.array(first_one)], names=["slice", "shingle", "new_item"])

    sliced = written(items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices))), "items")
    rows = written(sliced.select("slice", "text").mapInArrow(held, "slice long, shingle long, new_item boolean"), "shingles")
    n = rows.where("new_item").count()
    df = written(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "counts")
    for s in range(slices):
        got = rows.where(F.col("slice") == s).select("shingle").distinct().join(df, "shingle").toArrow()
        keys, counts = got["shingle"].to_numpy().view(U), got["n"].to_numpy()
        order = np.argsort(keys)
        part = sliced.where(F.col("slice") == s).select("item_id", "text").collect()
        yield Index(sorted(map(tuple, part), key=_first_null), shingle, percent, n, (keys[order], counts[order]))
    discard(sliced, rows, df)


def _first_null(item: tuple[int | None, str]) -> tuple:
    return item[0] is not None, item[0] or 0, item[1]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, percent: int = 80, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, item_id, first_word, similarity): the items that each document holds, with the most similar span of
    those that the index proposes.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Every window of every document
    as long as an item's window class is fingerprinted; the index finds all within ``RADIUS`` of one of an item's
    windows (first and last), and the weighted similarity of the item's shingles with the document's span
    there must be ``percent`` or more. It depends on the whole benchmark, the item and the document, and not on
    how the benchmark is cut into slices; each slice is a pass over ``docs``. Null and empty texts hold nothing,
    empty items are in no document, items under ``shingle`` words count as one shingle. With several slices the hits of
    each are written before the next index is made, so the driver holds one at a time. Repeated rows each give
    their hits, repeated items too; null ids stay null; other columns are not read; empty tables give no hits.
    """
    schema = "doc_id long, item_id long, first_word long, similarity double"
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = index.search(batch.column(1))
                rows, items, starts, scores = zip(*found) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), pa.array(starts, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "item_id", "first_word", "similarity"])

        return freed(run)

    return _of_slices(base, indexes(benchmark, shingle, percent, slice_bytes), scan, schema)


def _of_slices(base: DataFrame, found: Iterator[Index], scan, schema: str) -> DataFrame:
    """Rows that ``scan`` gives for every index; of several indexes, each one's rows are written before the next is made."""
    index, out = next(found), None
    for following in found:
        part = written(base.mapInArrow(scan(index), schema), "slice")
        out = part if out is None else out.unionByName(part)
        index = following
    last = base.mapInArrow(scan(index), schema)
    return last if out is None else out.unionByName(written(last, "slice"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, percent: int = 80, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows of ``docs`` that hold no item; their columns, of any names, stay as they are. Null and empty texts hold no
    item and stay; repeated rows are judged alike; an empty table or an empty benchmark takes nothing away. With
    several slices of the benchmark the texts that each slice finds are written as digests, and one join takes their
    rows away; ``docs`` itself is never copied."""
    at = docs.columns.index("text")
    found = indexes(benchmark, shingle, percent, slice_bytes)
    index = next(found)
    following = next(found, None)
    if following is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[h[0] for h in index.search(batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        base = by_place(docs)
        return base.mapInArrow(freed(run), base.schema).toDF(*docs.columns)

    def scan(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = sorted({h[0] for h in index.search(batch.column(0))})
                yield batch.take(pa.array(rows, pa.int64())).select(["one", "two"])

        return freed(run)

    (mark,) = fresh(docs.columns, "_digest")
    text = F.col("text").cast("string")
    digest = (F.xxhash64(text), F.xxhash64(F.concat(F.lit("2"), text)))  # 128 bits tell texts apart
    base = docs.select(text.alias("text"), digest[0].alias("one"), digest[1].alias("two"))
    gone = written(_of_slices(base, chain([index, following], found), scan, "one long, two long").distinct(), "gone")
    gone = small(gone.select(F.struct("one", "two").alias(mark)))
    return docs.join(gone, F.struct(digest[0].alias("one"), digest[1].alias("two")) == F.col(mark), "left_anti")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = written(benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "hits")
    per = hits.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("_items"), F.round(F.max("similarity"), 6).alias("similarity"))
    return per.select("doc_id", "n_items", F.concat_ws(",", F.col("_items").cast("array<string>")).alias("item_ids"), "similarity")
