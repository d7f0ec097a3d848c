"""The most similar sets of items, by tiles of queries against rows, or of those that have an item in common."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.records import dealt, kept

#: Queries and rows of a tile, and how many rows and items of it are multiplied at a time.
ASKED, HELD = 4000, 1 << 14
ROWS, ITEMS = 1 << 11, 1 << 11
#: Sets of a tile of those that have an item in common.
ASKING, HOLDING = 1 << 13, 1 << 15


def _shared(asked: pa.Array, held: pa.Array, weights: np.ndarray, items: pa.Array) -> np.ndarray:
    """The sum of weights that each query shares with each row, some items at a time."""
    out = np.zeros((len(asked), len(held)))
    sides = []
    for lists in (asked, held):
        code = pc.index_in(pc.list_flatten(lists), value_set=items)
        sides.append((pc.list_parent_indices(lists).to_numpy(), pc.fill_null(code, -1).to_numpy()))
    (q, a), (h, b) = sides
    for lo in range(0, len(items), ITEMS):
        n = min(ITEMS, len(items) - lo)
        x, y = np.zeros((len(asked), n)), np.zeros((len(held), n))
        here, there = (a >= lo) & (a < lo + n), (b >= lo) & (b < lo + n)
        x[q[here], a[here] - lo] = 1.0
        y[h[there], b[there] - lo] = weights[there]
        out += x @ y.T
    return out


def _first(row: np.ndarray, rank: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest ranks of each row, equal ones by ``place``."""
    order = np.lexsort((place, -rank, row))
    some = row[order]
    return order[np.arange(len(some)) - np.searchsorted(some, some) < k]


def best(asked: DataFrame, held: DataFrame, k: int, jaccard: bool) -> DataFrame:
    """(query, case, shared, score): for each query the ``k`` rows of the highest score in each tile, and so the ``k`` best of all among
    them; ties to the smallest case. A query is not held against itself, and nothing is said of pairs without a shared item.

    ``asked``: query (each once), items (array of distinct strings), size; ``held``: case (each once), items, weights (array of
    doubles), size. ``shared`` is the weight of the items in common; the score is shared / (both sizes less shared), or
    else shared / root of the product of sizes, told apart to nine places. Every query meets every row, in tiles of about
    ``ASKED`` x ``HELD`` that are multiplied as matrices; only a tile's best are passed on."""
    asked, held = kept(asked.where("query is not null"), "asked"), kept(held.where("case is not null"), "held")
    across, down = max(1, -(-asked.count() // ASKED)), max(1, -(-held.count() // HELD))
    left = asked.withColumn("_x", F.pmod(F.xxhash64("query"), F.lit(across))).withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(down - 1)).cast("array<long>")))
    right = held.withColumn("_y", F.pmod(F.xxhash64("case"), F.lit(down))).withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(across - 1)).cast("array<long>")))

    def run(q: pa.Table, h: pa.Table) -> pa.Table:
        h = h.sort_by("case")
        names, lists = q["query"].combine_chunks(), q["items"].combine_chunks()
        items, size = pc.unique(pc.list_flatten(lists)), q["size"].to_numpy().astype(float)
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), *(np.zeros(0) for _ in range(3)))]
        for lo in range(0, h.num_rows if q.num_rows else 0, ROWS):
            some = h.slice(lo, ROWS).combine_chunks()
            shared = _shared(lists, some["items"].combine_chunks(), pc.list_flatten(some["weights"].combine_chunks()).to_numpy(), items)
            sizes = some["size"].to_numpy().astype(float)
            score = shared / (sizes[None] + size[:, None] - shared) if jaccard else shared / np.sqrt(sizes[None] * size[:, None])
            rank = score if jaccard else np.round(score, 9)
            rank = np.where(shared > 0, rank, -1.0)
            own = pc.fill_null(pc.index_in(names, value_set=some["case"].combine_chunks()), -1).to_numpy()
            rank[own >= 0, own[own >= 0]] = -1.0
            if k == 1:
                row, at = np.arange(len(rank)), rank.argmax(1)  # the first of equal ones
            else:
                least = np.partition(rank, max(0, rank.shape[1] - k), 1)[:, max(0, rank.shape[1] - k)]
                row, at = np.nonzero(rank >= np.maximum(least, 0)[:, None])
            taken = rank[row, at] >= 0
            row, at = row[taken], at[taken]
            keep = _first(row, rank[row, at], at, k)
            row, at = row[keep], at[keep]
            found.append((row, at + lo, shared[row, at], score[row, at], rank[row, at]))
        row, at, shared, score, rank = (np.concatenate(x) for x in zip(*found))
        keep = _first(row, rank, at, k)
        return pa.table({"query": names.take(pa.array(row[keep])), "case": h["case"].take(pa.array(at[keep])), "shared": shared[keep], "score": score[keep]})

    kinds = dict(asked.dtypes) | dict(held.dtypes)
    return left.groupBy("_x", "_y").cogroup(right.groupBy("_x", "_y")).applyInArrow(run, f"query {kinds['query']}, case {kinds['case']}, shared double, score double")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Held, pa.RecordBatch]]:
    """What is held in each tile, with the rows that ask there, a batch at a time. Rows come sorted by tile, held ones first."""
    tile, some, held = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shingle", "_x", "_y", "asks")])
        ends = [*(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip([0, *ends], ends):
            if lo == hi:
                continue
            if tuple(keys[:3, lo]) != tile:
                tile, some, held = tuple(keys[:3, lo]), [], None
            if not keys[3, lo]:
                some.append(batch.slice(lo, hi - lo))
                continue
            if some:
                some, held = [], Held(pa.Table.from_batches(some).combine_chunks())
            if held:  # nothing may be held in a small part
                yield held, batch.slice(lo, hi - lo)


class Held:
    """The sets of a tile, found by their items."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        lists = rows["x"].chunk(0)
        flat, of = pc.list_flatten(lists).to_numpy(), pc.list_parent_indices(lists).to_numpy()
        order = np.argsort(flat, kind="stable")
        self.of = of[order]
        self.items, first = np.unique(flat[order], return_index=True)
        self.ends = np.append(first, len(flat))
        self.answers: dict[bytes, list[int]] = {}  # for who asks the same again

    def own(self, cases: pa.Array) -> np.ndarray:
        """The place of each case among those held, or -1."""
        return pc.fill_null(pc.index_in(cases, value_set=self.rows["case"].chunk(0)), -1).to_numpy()

    def having(self, items: np.ndarray) -> np.ndarray:
        """Places of the sets that have each item, one after the other."""
        at = np.searchsorted(self.items, items)
        at = at[self.items[np.minimum(at, len(self.items) - 1)] == items]
        return np.concatenate([self.of[self.ends[i] : self.ends[i + 1]] for i in at.tolist()]) if len(at) else np.zeros(0, np.int64)


def by_items(sets: DataFrame, answer: Callable[[Held, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``answer`` says of the rows of ``sets`` that ask, and of the sets that have the same shingle.

    ``sets``: a row for each set and each shingle under which it is held: shingle (a long), asks (whether it also asks there), case
    (one of each set), x (an array of longs, the set) and what else ``answer`` reads. The rows of a shingle make tiles of about
    ``ASKING`` x ``HOLDING``, so that a common one is spread over tasks; those held lie in memory, those that ask go by."""
    rows = kept(sets, "held")
    sizes = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("_held"), F.count(F.when(F.col("asks"), 1)).alias("_asked")).where("_asked > 0")
    across, down = F.ceil(F.col("_asked") / ASKING), F.ceil(F.col("_held") / HOLDING)
    sizes = kept(sizes.select("shingle", across.alias("_across"), down.alias("_down"), (F.col("_asked") * F.col("_held")).alias("_met")), "sizes")
    met = sizes.agg(F.coalesce(F.sum("_met"), F.lit(0))).first()[0]  # one number
    both = rows.join(sizes.drop("_met"), "shingle")

    def all_of(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def part_of(n: str) -> Column:
        return F.pmod(F.xxhash64("case"), F.col(n))

    left = both.withColumns({"asks": F.lit(False), "_y": part_of("_down")}).withColumn("_x", all_of("_across"))
    right = both.where("asks").withColumn("_x", part_of("_across")).withColumn("_y", all_of("_down"))
    every = left.unionByName(right).drop("_across", "_down")
    tiles = dealt(every, max(8 * rows.count(), met // 64), "shingle", "_x", "_y").sortWithinPartitions("shingle", "_x", "_y", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, asked in _tiles(batches):
            yield from answer(held, asked)

    return tiles.mapInArrow(run, schema)
