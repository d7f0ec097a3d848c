"""Where marks of punctuation stand between bare words: counts of what is around, weighed by a logistic model."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.records import kept

_WORD = re.compile("[A-Za-z0-9\u0080-\U0010ffff]+")
_PARTS = re.compile(f"({_WORD.pattern})")
MARKS = re.compile("[.,;:!?]")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: What a gap is looked at through: words before and after, pairs, word ends and beginnings, lengths.
VIEWS = 9
#: Hashed values of each view.
BUCKETS = 1 << 16
#: Gaps that are added up at a time.
TAKEN = 1 << 16
#: Words that open a clause, for the rule that the model is held against.
OPENERS = frozenset("and but or for that which when where if because und aber oder denn dass der die das wenn weil et mais ou car que qui quand si y pero o porque cuando donde".split())


@dataclass(frozen=True)
class Model:
    """Log-odds of a mark by view and bucket, the weights of the views (the last: of nothing), and the score from which on a mark is set."""

    odds: np.ndarray
    weights: np.ndarray
    threshold: float

    def scores(self, views: np.ndarray) -> np.ndarray:
        return np.take_along_axis(self.odds, views.T, axis=1).T @ self.weights[:-1] + self.weights[-1]


#: Checksums go on from those of the number of the view, and lengths from 12 on are one.
_FOURTH, _FIFTH = zlib.crc32(b"4 "), zlib.crc32(b"5 ")
_LENGTHS = np.array([[zlib.crc32(f"8 {a} {b}".encode()) % BUCKETS for b in range(13)] for a in range(13)], np.int64)
#: Words that a task knows at once, and the longest (in bytes) that checksums go on over by table.
KNOWN, SHORT = 1 << 18, 48


class _Words(dict):
    """Numbers of words; the columns of ``seen`` are what the views see of each: buckets as the first to fourth word, of its end and of its
    beginning, its length, the checksums that the fifth and sixth view go on from, its own checksum and bytes, and whether it opens a clause."""

    def __init__(self):
        super().__init__()
        self.new: list[int] = []
        self.parts: dict[str, int] = {}
        self.columns = np.zeros((12, 0), np.int64)
        self[""]  # has number 0

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        spelled = word.encode()
        self.new += (zlib.crc32(spelled), len(spelled), len(word), self.part(f"6 {word[-3:]}"), self.part(f"7 {word[:3]}"), word in OPENERS)
        return n

    def part(self, name: str) -> int:
        found = self.parts.get(name)
        if found is None:
            found = self.parts[name] = zlib.crc32(name.encode()) % BUCKETS
        return found

    def seen(self) -> np.ndarray:
        if self.new:
            crc, size, length, end, beginning, opens = np.array(self.new, np.int64).reshape(-1, 6).T
            fresh = np.empty((12, len(crc)), np.int64)
            for v in range(4):
                fresh[v] = _followed(np.full(len(crc), zlib.crc32(f"{v} ".encode())), crc, size) % BUCKETS
            fresh[4:7] = end, beginning, np.minimum(length, 12)
            space = np.full(len(crc), zlib.crc32(b" "))
            for v, first in ((7, _FOURTH), (8, _FIFTH)):
                fresh[v] = _followed(_followed(np.full(len(crc), first), crc, size), space, np.ones(len(crc), np.int64))
            fresh[9:] = crc, size, opens
            self.columns, self.new = np.concatenate([self.columns, fresh], 1), []
        return self.columns


class _Marked(dict):
    """Whether what stands between two words has a mark."""

    def __missing__(self, between: str) -> bool:
        found = bool(MARKS.search(between))
        if len(self) < KNOWN:
            self[between] = found
        return found


def _over(crc: int, n: int) -> int:
    """What a checksum becomes over ``n`` zeros, less theirs: it is linear in ``crc``."""
    return zlib.crc32(bytes(n), crc) ^ zlib.crc32(bytes(n))


@cache
def _steps() -> np.ndarray:
    return np.array([[[_over(v << 8 * k, n) for v in range(256)] for k in range(4)] for n in range(SHORT + 1)], np.int64)


def _followed(crc: np.ndarray, after: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums that go on over words with the checksums ``after`` and so many bytes."""
    steps, n = _steps(), np.minimum(size, SHORT)
    out = after.copy()
    for k in range(4):
        out ^= steps[n, k, crc >> 8 * k & 255]
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = _over(int(crc[i]), int(size[i])) ^ int(after[i])
    return out


def _several(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(views, marked, rule) of the gaps of all texts in order, those of ``TAKEN`` gaps or a little more at a time."""
    words, between = _Words(), _Marked()
    ids, marks, sizes = [], [], []

    def seen() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array(sizes)
        at = np.arange(n.sum()) + np.repeat(4 * np.arange(len(n)), n)  # a text has one word more than gaps, and three empty ones around
        a, b, c, d = (np.array(ids)[at + v] for v in range(4))
        of = words.seen()
        views = np.empty((len(at), VIEWS), np.int64)
        for v, x in enumerate((a, b, c, d)):  # the words around a gap
            views[:, v] = of[v][x]
        views[:, 4] = _followed(of[7][b], of[9][c], of[10][c]) % BUCKETS
        views[:, 5] = _followed(of[8][a], of[9][b], of[10][b]) % BUCKETS
        views[:, 6], views[:, 7], views[:, 8] = of[4][b], of[5][c], _LENGTHS[of[6][b], of[6][c]]
        return views, np.array(marks, bool), of[11][c].astype(bool)

    for text in texts:
        text = text or ""
        parts = _PARTS.split(text.lower() if text.isascii() else text.translate(_LOWER))
        if len(parts) < 5:
            continue
        ids += (0, *map(words.__getitem__, parts[1::2]), 0, 0)
        marks += map(between.__getitem__, parts[2:-1:2])
        sizes.append(len(parts) // 2 - 1)
        if len(marks) >= TAKEN:
            yield seen()
            ids, marks, sizes = [], [], []
            if len(words) > KNOWN:
                words = _Words()
    if sizes:
        yield seen()


def gaps(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(views, marked, rule) of the gaps between a text's words; nothing but lower-cased words is looked at."""
    none = np.zeros(0, bool)
    found = list(_several([text]))
    return found[0] if found else (np.zeros((0, VIEWS), np.int64), none, none)


def _part(key: str, dev: int, test: int) -> Column:
    """train, dev or test by the hash of a document's key: ``dev`` and ``test`` in a hundred."""
    h = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("part")), F.lit(100))
    return F.when(h < test, "test").when(h < test + dev, "dev").otherwise("train")


def _pieces(docs: DataFrame, part: str, key: str, dev: int, test: int) -> DataFrame:
    return docs.where(_part(key, dev, test) == part).select("text")


def _viewed(texts: DataFrame) -> DataFrame:
    """(views, marked): the gaps of the texts, some at a time, written once for those who go over them again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for views, marked, _ in _several(text.as_py() for batch in batches for text in batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array([views.astype(np.uint16).tobytes()]), pa.array([marked.tobytes()])], names=["views", "marked"])

    return kept(texts.mapInArrow(run, "views binary, marked binary"), "views")


def _unpacked(views: pa.Scalar, marked: pa.Scalar) -> tuple[np.ndarray, np.ndarray, None]:
    return np.frombuffer(views.as_py(), np.uint16).reshape(-1, VIEWS).astype(np.int64), np.frombuffer(marked.as_py(), bool), None


def _totals(texts: DataFrame, size: int, add) -> np.ndarray:
    """Sum over all texts (or rows of ``_viewed``) of what ``add(views, marked, rule)`` gives: an array of ``size`` numbers, summed inside tasks
    first. ``add`` is given the gaps of many texts at a time, as it may take as long as ``size`` numbers do."""

    packed = len(texts.columns) > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        rows = (row for batch in batches for row in zip(*batch.columns))
        for found in _several(row[0].as_py() for row in rows) if not packed else (_unpacked(*row) for row in rows):
            total += add(*found)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "amount"])

    found = texts.mapInArrow(run, "at long, amount double").groupBy("at").agg(F.sum("amount").alias("amount")).toArrow()  # ``size`` rows at most
    out = np.zeros(size)
    out[found["at"].to_numpy()] = found["amount"].to_numpy()
    return out


def fitted(docs: DataFrame, key: str = "doc_id", dev: int = 10, test: int = 20, rounds: int = 8) -> Model:
    """A model from documents (key, text) that are neither dev nor test.

    Gaps are counted by view and bucket over all training texts, in one aggregation; each view says its smoothed log-odds.
    How far each is to be believed is a logistic regression on the dev texts, which the counts haven't seen: Newton
    steps, whose gradient and curvature are sums over partitions of ``VIEWS`` + 1 squared numbers. The threshold is the one
    with the best F1 there. Null, empty and one-word texts have no gaps; without gaps or marks nothing is ever set."""
    cells = VIEWS * BUCKETS

    def count(views, marked, _):
        at = views + np.arange(VIEWS) * BUCKETS
        return np.concatenate([np.bincount(at.ravel(), minlength=cells), np.bincount(at[marked].ravel(), minlength=cells)])

    counted = _totals(_pieces(docs, "train", key, dev, test), 2 * cells, count)
    n, hits = counted[:cells].reshape(VIEWS, BUCKETS), counted[cells:].reshape(VIEWS, BUCKETS)
    share = hits[0].sum() / max(1.0, n[0].sum())
    if not 0 < share < 1:
        return Model(np.zeros((VIEWS, BUCKETS)), np.zeros(VIEWS + 1), np.inf)
    odds = np.log((hits + 4 * share) / (n - hits + 4 * (1 - share))) - np.log(share / (1 - share))
    weights = np.concatenate([np.full(VIEWS, 1 / VIEWS), [np.log(share / (1 - share))]])
    texts = _viewed(_pieces(docs, "dev", key, dev, test))
    k = VIEWS + 1
    for _ in range(rounds):
        model = Model(odds, weights, 0.0)

        def slope(views, marked, _, model=model):
            x = np.hstack([np.take_along_axis(model.odds, views.T, axis=1).T, np.ones((len(views), 1))])
            p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
            return np.concatenate([x.T @ (marked - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])

        sums = _totals(texts, k + k * k, slope)
        step = np.linalg.solve(sums[k:].reshape(k, k) + np.eye(k), sums[:k] - (weights - np.concatenate([np.full(VIEWS, 1 / VIEWS), weights[-1:]])))
        weights = weights + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-4:
            break
    model = Model(odds, weights, 0.0)
    edges = np.linspace(-12, 12, 1001)

    def spread(views, marked, _):
        bin_ = np.clip(np.searchsorted(edges, model.scores(views), "right") - 1, 0, 999)
        return np.concatenate([np.bincount(bin_, minlength=1000), np.bincount(bin_, marked, 1000)])

    bins = _totals(texts, 2000, spread)
    set_, right = bins[:1000][::-1].cumsum()[::-1], bins[1000:][::-1].cumsum()[::-1]
    f1 = 2 * right / np.maximum(1.0, set_ + bins[1000:].sum())
    best = int(f1.argmax())
    return Model(odds, weights, -np.inf if best == 0 else float(edges[best]))


def scored(docs: DataFrame, model: Model, key: str = "doc_id", dev: int = 10, test: int = 20) -> DataFrame:
    """(method, gaps, marks, predicted, hits, precision, recall, f1) on the test documents: of the model and of the rule that a mark
    stands before a word that opens a clause."""

    def add(views, marked, rule):
        said = model.scores(views) >= model.threshold
        return np.array([len(marked), marked.sum(), said.sum(), (said & marked).sum(), rule.sum(), (rule & marked).sum()], float)

    n, marks, *rest = _totals(_pieces(docs, "test", key, dev, test), 6, add).tolist()
    rows = []
    for method, said, hits in (("model", *rest[:2]), ("rule", *rest[2:])):
        rows.append((method, int(n), int(marks), int(said), int(hits), hits / said if said else None, hits / marks if marks else None, 2 * hits / (said + marks) if said + marks else None))
    return docs.sparkSession.createDataFrame(rows, "method string, gaps long, marks long, predicted long, hits long, precision double, recall double, f1 double")


def restored_marks(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, n_words, marks): after which words (from 0) of every text the model sets a mark. Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, marks = [], []
            for text in batch.column(1):
                views, _, _ = gaps(text.as_py())
                n.append(len(views) + 1 if len(views) else len(_WORD.findall(text.as_py() or "")))
                marks.append(np.flatnonzero(model.scores(views) >= model.threshold).tolist() if len(views) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(marks, pa.list_(pa.int32()))], names=[key, "n_words", "marks"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, n_words long, marks array<int>")
