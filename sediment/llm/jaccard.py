"""Exact Jaccard join of shingle sets: blocks deal the work out, signature trees join each block.

1. Every set is cut into buckets by token hash. Two sets at the threshold differ in at most d tokens, so with
   more than d buckets they agree in one: (space, bucket, content) is a key, and linked sets share a key. Sets
   are grouped in size bands as wide as the threshold allows, so a partner is in the same or the next band.
2. Keys that two or more different sets share make blocks; equal blocks become one.
3. Each block (in tiles of bounded size) is joined by a signature tree: leaves are sets with a token bitmap,
   nodes hold the OR of their bitmaps, size ranges and the least distinct bits; a dual traversal prunes pairs
   of nodes whose largest possible overlap is below what the threshold needs.
4. Pairs that are left are verified on the sets themselves. A first traversal names a spanning forest of each
   block, so that big groups need a pair a member; a second one names every pair that verified links have
   not joined yet. Classes are the connected components of verified links.

Tokens are 64-bit hashes; equal hashes count as equal tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SMALL, components, discard, freed, fresh, partitions, small, written
from .words import LOWER, U, Words, mix, pieces

BITS = 2048
FAN = 8
#: Sets of a block that one task joins with themselves or with as many others.
TILE = 4096
_PAIRS = 16384
#: Keys that a task compares at once.
PORTION = 1 << 18
#: Rows whose keys are held at once before they are handed on.
SLICE_ROWS = 2048


# sets


def token_sets(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, ascending, and the offsets of rows."""
    out = h.copy()
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[rows[:-1][rows[:-1] < len(out)]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[rows]


def set_ids(tokens: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One number for each set, whatever the order of its tokens; 0 for empty ones."""
    n = np.diff(rows)
    out = np.zeros(len(n), U)
    full = n > 0
    if full.any():
        out[full] = mix(np.add.reduceat(mix(tokens ^ U(0x5851F42D4C957F2D)), rows[:-1][full]) + n[full].astype(U))
    return out


class Bands:
    """Size bands and the number of buckets in each for a threshold in percent."""

    def __init__(self, percent: int):
        self.percent = percent
        self.edges, self.spaces = [1], []

    def reach(self, size: int) -> None:
        while self.edges[-1] <= size:
            low = self.edges[-1]
            high = max(low + 1, (low - 1) * 100 // self.percent + 1)
            self.edges.append(high)
            x = high - 1
            d = (100 - self.percent) * (x + x * 100 // self.percent) // (100 + self.percent)
            # empty buckets agree without saying much: with `spare` more buckets, a set with no more empty ones
            # than that agrees with every partner in a bucket that isn't empty
            spare = 0
            for _ in range(6):
                m = d + 1 + spare
                mean = m * (1 - 1 / m) ** low
                spare = int(mean + 4 * mean**0.5) if d else 0
            self.spaces.append((d + 1 + spare, spare))

    def keys(self, tokens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of all rows with tokens."""
        n = np.diff(rows)
        if not len(tokens):
            return np.zeros(0, np.int64), np.zeros(0, U)
        self.reach(int(n.max()))
        band = np.searchsorted(np.array(self.edges), n, "right") - 1
        weights, of = mix(tokens + U(0x14057B7EF767814F)), np.repeat(np.arange(len(n)), n)
        buckets, spares = np.array([s[0] for s in self.spaces]), np.array([s[1] for s in self.spaces])
        out_rows, out_keys = [], []
        for step in (0, 1):  # own band, and the one below
            space = band - step
            use = (n > 0) & (space >= 0)
            m = np.where(use, buckets[np.maximum(space, 0)], 0)
            base = np.concatenate([[0], np.cumsum(m)])
            here = use[of]
            at = base[:-1][of[here]] + (tokens[here] % m[of[here]].astype(U)).astype(np.int64)
            sums = np.zeros(base[-1], U)
            np.add.at(sums, at, weights[here])
            row = np.repeat(np.arange(len(n)), m)
            bucket = np.arange(base[-1]) - base[:-1][row]
            empty = np.bincount(row[sums == 0], minlength=len(n))
            keep = (sums != 0) | (empty[row] > spares[np.maximum(space, 0)][row])
            out_rows.append(row[keep])
            out_keys.append(mix(sums[keep] + mix((space[row[keep]].astype(U) << U(32)) + bucket[keep].astype(U) + U(1))))
        return np.concatenate(out_rows), np.concatenate(out_keys)


def bitmaps(tokens: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows) - 1, BITS), bool)
    out[np.repeat(np.arange(len(rows) - 1), np.diff(rows)), (tokens >> U(40)) % U(BITS)] = True
    return np.packbits(out, axis=1)


# the tree


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of sets of these sizes at the threshold: overlap * (100 + percent) >= percent * (a + b)."""
    return -(-percent * (a + b) // (100 + percent))


class SignatureTree:
    """Sets as leaves; ``bits``: a bitmap for each (n x BITS/64 words), ``size``: tokens, ``order``: a sort key
    that puts like sets side by side."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, order: np.ndarray, percent: int):
        self.percent = percent
        self.leaf = np.lexsort((size, order))
        b, s = bits[self.leaf], size[self.leaf]
        count = np.bitwise_count(b).sum(1).astype(np.int64)
        self.levels = [(b, s, s, s - count)]  # OR of bitmaps, least and largest size, most tokens that share a bit
        while len(self.levels[-1][1]) > 1:
            b, low, high, slack = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        bits, low, high, slack = self.levels[level]
        need = needed(low[a], low[b], self.percent)
        ok = np.minimum(high[a], high[b]) >= need
        at = np.flatnonzero(ok)
        common = np.bitwise_count(bits[a[at]] & bits[b[at]]).sum(1).astype(np.int64)
        ok[at] = common + np.minimum(slack[a[at]], slack[b[at]]) >= need[at]
        return ok

    def join(self, label: np.ndarray, side: np.ndarray | None = None, spanning: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (in the caller's numbering) that may reach the threshold and have different labels.

        ``side``: 0 or 1 for each set; only pairs over both sides are named. ``spanning``: labels merge as
        pairs are named, so only a forest comes out."""
        label = label[self.leaf].copy()
        side = None if side is None else side[self.leaf]
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        same = self._uniform(label)
        while stack:
            level, a, b = stack.pop()
            if len(a) > _PAIRS:
                stack.append((level, a[_PAIRS:], b[_PAIRS:]))
                a, b = a[:_PAIRS], b[:_PAIRS]
            one = same[level]
            open_ = (one[a] < 0) | (one[a] != one[b])
            if level == 0:
                open_ = a < b
                open_ &= label[a] != label[b]
                if side is not None:
                    open_ &= side[a] != side[b]
            a, b = a[open_], b[open_]
            ok = self._possible(level, a, b)
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            if level == 0:
                if spanning:
                    a, b = self._forest(label, a, b)
                    same = self._uniform(label)
                yield self.leaf[a], self.leaf[b]
                continue
            below = len(self.levels[level - 1][1])
            ca = (a[:, None] * FAN + np.arange(FAN))[:, :, None] + np.zeros(FAN, np.int64)
            cb = (b[:, None] * FAN + np.arange(FAN))[:, None, :] + np.zeros((FAN, 1), np.int64)
            ca, cb = ca.reshape(-1), cb.reshape(-1)
            real = (ca < below) & (cb < below) & (ca <= cb)
            stack.append((level - 1, ca[real], cb[real]))

    def _uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For every node the label that all its leaves have, or -1."""
        out, low, high = [], label, label
        for level in range(len(self.levels)):
            if level:
                at = np.arange(0, len(low), FAN)
                low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append(np.where(low == high, low, -1))
        return out

    @staticmethod
    def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parent = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        keep = []
        for i, (x, y) in enumerate(zip(label[a].tolist(), label[b].tolist())):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                keep.append(i)
        if parent:
            known, back = np.unique(label, return_inverse=True)
            label[:] = np.array([root(x) for x in known.tolist()])[back]
        return a[keep], b[keep]


# the join


def _blocks(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(kind 0: doc_id, n, set) for every row, (kind 1: block, members, set) for every block of sets; one pass
    over the texts and one shuffle of packed keys. There are two partitions of keys for every one that the texts are
    read in, so a task holds the keys of half a partition of texts, however large the input."""
    spark = docs.sparkSession
    n_parts = max(partitions(spark), 2 * docs.rdd.getNumPartitions())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bands, task = Bands(percent), TaskContext.get().partitionId()
        for batch in (whole.slice(at, SLICE_ROWS) for whole in batches for at in range(0, whole.num_rows, SLICE_ROWS)):
            seen: set[int] = set()
            infos, keys, owners = [], [], []
            for first, last, data, offsets in pieces(batch.column(1)):
                words = Words(data, offsets, LOWER)
                tokens, rows = token_sets(*words.shingles(k))
                ids = set_ids(tokens, rows)
                infos.append((np.diff(rows), ids))
                new = np.zeros(len(ids), bool)
                for i, x in enumerate(ids.tolist()):
                    if x and x not in seen:
                        seen.add(x)
                        new[i] = True
                take = new[np.repeat(np.arange(len(ids)), np.diff(rows))]
                row, key = bands.keys(tokens[take], np.concatenate([[0], np.cumsum(np.where(new, np.diff(rows), 0))]))
                keys.append(key)
                owners.append(ids[row])
            if not infos:
                continue
            ids = np.concatenate([x[1] for x in infos])
            # rows only pass through: dealt in turn, so copies of one text do not meet
            turn = (np.arange(len(ids)) + task * 7919) % n_parts
            yield _row_batch(0, turn, batch.column(0), np.concatenate([x[0] for x in infos]), ids)
            key, owner = np.concatenate(keys), np.concatenate(owners)
            part = (key % U(n_parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            key, owner = key[order], owner[order]
            cut = np.searchsorted(part[order], np.arange(n_parts + 1))
            blobs = []
            for p in range(n_parts):
                a, b = cut[p], cut[p + 1]
                if a < b:
                    known, index = np.unique(owner[a:b], return_inverse=True)
                    short = key[a:b] >> U(20)  # 44 bits tell keys of a part apart
                    blobs.append((p, len(known), known.tobytes() + (short & U(0xFFFFFFFF)).astype(np.uint32).tobytes() + (short >> U(32)).astype(np.uint16).tobytes() + index.astype(np.uint16 if len(known) < 65536 else np.uint32).tobytes(), b - a))
            if blobs:
                n = len(blobs)
                yield pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.array([x[0] for x in blobs], pa.int32()), pa.nulls(n, pa.int64()), pa.array([x[1] for x in blobs], pa.int64()), pa.array([x[3] for x in blobs], pa.int64()), pa.array([x[2] for x in blobs], pa.binary())], names=["kind", "part", "doc_id", "n", "set", "blob"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            info = np.flatnonzero(kinds == 0)
            if len(info):
                some = batch.take(pa.array(info))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), some.column(3), some.column(4)], names=["kind", "id", "n", "set"])
            for i in np.flatnonzero(kinds == 1).tolist():
                blob, m, n = batch.column(5)[i].as_py(), batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
                held.append([blob, m, n])
        # blobs stay packed (8 to 10 bytes a key); keys are compared portion by portion
        portions = max(1, sum(n for *_, n in held) // PORTION)
        seen = [np.zeros(0, U)]
        for portion in range(portions):
            keys, owners = [np.zeros(0, U)], [np.zeros(0, U)]
            for blob, m, n in held:
                low = np.frombuffer(blob, np.uint32, n, 8 * m)
                at = np.flatnonzero(low % np.uint32(portions) == portion)
                key = low[at].astype(U) | np.frombuffer(blob, np.uint16, n, 8 * m + 4 * n)[at].astype(U) << U(32)
                index = np.frombuffer(blob, np.uint16 if m < 65536 else np.uint32, n, 8 * m + 6 * n)[at]
                keys.append(key)
                owners.append(np.frombuffer(blob, U, m)[index])
            yield from _shared(np.concatenate(keys), np.concatenate(owners), seen)

    dealt = docs.mapInArrow(freed(deal), "kind int, part int, doc_id long, n long, set long, blob binary")
    return written(dealt.repartitionById(n_parts, F.col("part")).mapInArrow(freed(gather), "kind int, id long, n long, set long"), "blocks", by=["kind"])


def _shared(key: np.ndarray, owner: np.ndarray, seen: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(kind 1, block, members, set) of keys with two owners or more; ``seen``: one array, of blocks already given."""
    order = np.argsort(key)
    key, owner = key[order], owner[order]
    twin = np.zeros(len(key), bool)
    twin[1:] = key[1:] == key[:-1]
    twin[:-1] |= twin[1:]
    key, owner = key[twin], owner[twin]
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    if not len(key):
        return
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    block = mix(np.add.reduceat(mix(owner), begin) + size.astype(U))
    _, one = np.unique(block, return_index=True)
    good = np.zeros(len(begin), bool)
    good[one] = True
    good &= size > 1
    good &= ~np.isin(block, seen[0])
    seen[0] = np.union1d(seen[0], block[good])
    member = np.repeat(good, size)
    out = np.repeat(block, size)[member], np.repeat(size, size)[member], owner[member]
    for at in range(0, len(out[0]), 65536):
        some = [x[at : at + 65536].astype(np.int64) for x in out]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(some[0]), np.int32)), *(pa.array(x) for x in some)], names=["kind", "id", "n", "set"])


def _row_batch(kind: int, part: np.ndarray, doc_ids: pa.Array, n: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    rows = len(ids)
    return pa.RecordBatch.from_arrays([pa.array(np.full(rows, kind, np.int32)), pa.array(part.astype(np.int32)), doc_ids, pa.array(n.astype(np.int64)), pa.array(ids.view(np.int64)), pa.nulls(rows, pa.binary())], names=["kind", "part", "doc_id", "n", "set", "blob"])


#: Bytes of a token that verification compares: 48 bits, as 2**48 is far over the square of any set's size.
TOKEN_BYTES = 6


def packed(tokens: np.ndarray) -> bytes:
    """The low 48 bits of each token."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]).tobytes()


def unpacked(raw) -> np.ndarray:
    out = np.zeros((len(raw) // TOKEN_BYTES, 8), np.uint8)
    out[:, :TOKEN_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, TOKEN_BYTES)
    return out.view(U).reshape(-1)


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(set, n, order, bits, tokens) of the sets in ``wanted`` (set, doc_id, and whether several rows are that set's
    ``doc_id``, as only these have to be told apart by a shuffle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(0).to_numpy().view(U)
            for first, last, data, offsets in pieces(batch.column(1)):
                tokens, rows = token_sets(*Words(data, offsets, LOWER).shingles(k))
                ids = set_ids(tokens, rows)
                at = np.flatnonzero((ids == want[first:last]) & (np.diff(rows) > 0))
                bits = bitmaps(tokens, rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at].view(np.int64)), pa.array(np.diff(rows)[at]), pa.array(tokens[rows[at]].view(np.int64)) if len(at) else pa.array([], pa.int64()), pa.array([bits[i].tobytes() for i in at], pa.binary()), pa.array([packed(tokens[rows[i] : rows[i + 1]]) for i in at], pa.binary()), batch.column(2).slice(first, last - first).take(pa.array(at))], names=["set", "n", "order", "bits", "tokens", "several"])

    both = docs.join(wanted.withColumnRenamed("doc_id", "_d"), docs.doc_id.eqNullSafe(F.col("_d"))).select("set", "text", "several")
    made = written(both.mapInArrow(freed(run), "set long, n long, order long, bits binary, tokens binary, several boolean"), "sets")
    if made.where("several").isEmpty():
        return made.drop("several")
    one = made.where("several").dropDuplicates(["set"])
    return written(made.where("not several").unionByName(one).drop("several"), "sets")


def _candidates(members: DataFrame, percent: int, spanning: bool) -> DataFrame:
    """(a, b): pairs of sets that a block's tree can't rule out. ``members``: block, members, set, label, n, order, bits."""
    chunks = F.ceil(F.col("members") / TILE).cast("int")
    own = F.pmod(F.xxhash64("set"), chunks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    tiles = members.withColumn("chunks", chunks).withColumn("own", own).withColumn("other", other)
    tiles = tiles.select("block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "set", "label", "n", "order", "bits")
    schema = "a long, b long"

    def join(group: tuple, table: pa.Table) -> pa.Table:
        low, high = group[1].as_py(), group[2].as_py()
        ids = table["set"].to_numpy()
        bits = np.frombuffer(b"".join(table["bits"].to_pylist()), U).reshape(len(ids), -1)
        tree = SignatureTree(bits, table["n"].to_numpy(), table["order"].to_numpy(), percent)
        _, label = np.unique(table["label"].to_numpy(), return_inverse=True)
        side = None if low == high else (table["own"].to_numpy() == high).astype(np.int8)
        a, b = [], []
        for x, y in tree.join(label.astype(np.int64), side, spanning):
            a.append(ids[x])
            b.append(ids[y])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return tiles.groupBy("block", "low", "high").applyInArrow(join, schema).distinct()


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are at the threshold or over it. ``pairs`` is a written table; where it names few sets, only
    their tokens are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (unpacked(batch.column(c)[i].as_buffer()) for c in (2, 3))
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    wanted = written(pairs.select(F.col("a").alias("_s")).union(pairs.select(F.col("b").alias("_s"))).distinct(), "wanted")
    if wanted.count() <= SMALL:
        sets = sets.join(F.broadcast(wanted), F.col("set") == F.col("_s"), "left_semi")
    x, y = sets.select(F.col("set").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("set").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(freed(run), "a long, b long")


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Words are [^\\x20\\x09-\\x0D]+ of the whole text with A-Z lower-cased; a set holds the distinct shingles of
    ``k`` words, or the whole sequence where there are fewer words. Rows link when their sets' Jaccard
    similarity is ``percent`` or more; component_id is the smallest doc_id that links reach. Null texts and
    texts without words have an empty set, link with nothing and are their own component. A null doc_id
    is no smallest id unless it is alone. Repeated rows each give a row; an empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = _blocks(docs, k, percent)
    rows = both.where("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "set")
    held = rows.where("n_shingles > 0").groupBy("set", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rows"))
    owners = held.groupBy("set").agg(first_row.alias("o")).select("set", "o.doc_id", (F.col("o.rows") > 1).alias("several"))
    blocks = written(both.where("kind = 1").select(F.col("id").alias("block"), F.col("n").alias("members"), "set").distinct(), "members")
    sets = _sets(docs, blocks.select("set").distinct().join(owners, "set").select("set", "doc_id", "several"), k)
    light = sets.select("set", "n", "order", "bits")

    # first traversal: a forest of each block
    first = written(_candidates(blocks.join(light, "set").withColumn("label", F.col("set")), percent, spanning=True), "pairs")
    links = written(_links(first, sets, percent), "links")
    label = components(links)

    # second traversal: pairs that verified links have not joined
    named = blocks.join(label.withColumnsRenamed({"id": "set"}), "set", "left").withColumn("label", F.coalesce("component", "set")).drop("component")
    mixed = written(named.groupBy("block").agg(F.min("label").alias("_least"), F.max("label").alias("_most")).where("_least <> _most").select("block"), "mixed")
    second = _candidates(named.join(mixed, "block").join(light, "set"), percent, spanning=False)
    second = written(second.join(first, ["a", "b"], "left_anti"), "pairs")
    more = written(_links(second, sets, percent), "links")
    label = components(links.union(more))

    # classes of sets first, then of rows: both joins have a written side, so that Spark can split a large group of copies
    named = owners.join(label.withColumnRenamed("id", "_s"), F.col("set") == F.col("_s"), "left").select(F.col("set").alias("_s"), "doc_id", F.coalesce("component", "set").alias("_class"))
    named = written(named, "classes")
    smallest = written(named.groupBy(F.col("_class").alias("_c")).agg(F.min("doc_id").alias("_id")), "smallest")
    named = written(named.join(smallest, F.col("_class") == F.col("_c")).select("_s", "_id"), "classes")
    full = rows.where("n_shingles > 0").join(named, F.col("set") == F.col("_s"), "left")
    out = full.select("doc_id", "n_shingles", F.coalesce("_id", "doc_id").alias("component_id"))
    discard(blocks, sets, first, links, more)
    return out.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` (doc_id, text and any other columns, which stay as they are) without those that another row of
    their class stands for: the smallest doc_id stays (rows that share it stay together). Rows with a null
    doc_id, null or wordless text stay; an empty table gives no rows."""
    (gone,) = fresh(docs.columns, "_gone")
    classes = jaccard_classes(docs.select("doc_id", "text"), k, percent)
    out = classes.where("doc_id is not null").groupBy(F.col("doc_id").alias(gone)).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays")).where("not stays")
    return docs.join(small(written(out.select(gone), "gone")), docs.doc_id == F.col(gone), "left_anti")


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_classes(docs, k=3, percent=90)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
    UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS seen FROM w UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.seen) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.id = w.doc_id GROUP BY w.doc_id, n.n
"""
