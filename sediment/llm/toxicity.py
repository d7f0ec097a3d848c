"""Toxicity by compression distance: two zstandard dictionaries, windows compressed with each.

Not quite the plain method: with a dictionary trained on whole toxic texts, one on whole ordinary texts and windows
of 2 to 24 words, held-out AUC was 0.52 to 0.80 on the tables here (README), as a toxic text is mostly ordinary prose
and the prose of the two dictionaries differs by more bytes than a toxic word saves. So the toxic dictionary is
trained on the stretches that set toxic texts apart, the second compressor holds ordinary content before it,
and a window is a word; scores are still differences of compressed lengths, and thresholds are calibrated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import freed

#: Labelled rows of each class that training takes (those with the smallest hashes), and the largest text among them.
TRAIN_ROWS = 2000
TRAIN_BYTES = 32 << 10
#: Bytes of each dictionary's content.
ORDINARY_BYTES, TOXIC_BYTES = 1024, 8192
#: Windows whose lengths a worker remembers.
KEPT_WINDOWS = 1_000_000
GRAM = 6
CUTS = (2, 3, 4, 5, 6, 7)
#: Both dictionaries end with it and every window begins with it, so that even a window of one word has a match and
#: a further match shows in its length.
ANCHOR = b"\x01\x02window-of-text\x03\x04"

#: The last field before a dictionary's content: the offsets 1, 4 and 8.
_REPEATS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(window_log=14, hash_log=14, chain_log=14, search_log=6, min_match=5, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False, write_checksum=False)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(content + ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


def windows(text: str | None) -> list[bytes]:
    """A text's windows: its words, A-Z lower-cased."""
    return (text or "").encode().lower().split()


class Distance:
    """How much shorter a window is with the toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.marked = _compressor(ordinary), _compressor(ordinary + toxic)
        self.known: dict[bytes, int] = {}

    def gains(self, parts: list[bytes]) -> np.ndarray:
        known = self.known
        found = [known.get(p) for p in parts]
        for i, gain in enumerate(found):
            if gain is None:
                part = parts[i]
                gain = known.get(part)
                if gain is None:
                    window = ANCHOR + b" " + part + b" "
                    gain = len(self.plain.compress(window)) - len(self.marked.compress(window))
                    if len(known) >= KEPT_WINDOWS:
                        known.clear()
                    known[part] = gain
                found[i] = gain
        return np.array(found, np.int64)


def features(gains: np.ndarray) -> np.ndarray:
    n = max(1, len(gains))
    over = np.array([(gains >= c).sum() for c in CUTS], float)
    return np.concatenate([np.log1p(over), np.log1p(1000 * over / n) / 3, [min(8, gains.max() if len(gains) else 0) / 4]])


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray  # the last is the intercept

    def score(self, distance: Distance, text: str | None) -> float:
        z = float(features(distance.gains(windows(text))) @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))


def _grams(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(data) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        out = (out << np.uint64(8)) | data[i : len(out) + i]
    return out


def _content(samples: list[bytes], size: int) -> bytes:
    """The text part of a trained dictionary; with too few samples to train, the samples themselves."""
    try:
        whole = zstandard.train_dictionary(size + 400, samples, k=200, d=8).as_bytes()
        return whole[whole.index(_REPEATS) + len(_REPEATS) :][-size:]
    except (zstandard.ZstdError, ValueError):
        return b" ".join(dict.fromkeys(samples))[-size:]


def dictionaries(ordinary: list[bytes], toxic: list[bytes]) -> tuple[bytes, bytes]:
    """Contents for ordinary and toxic text (lower-cased texts with single spaces).

    The toxic dictionary is trained on the stretches of toxic texts whose substrings of six bytes are in at
    least 1.5 % of these and twenty times more frequent there than in ordinary texts.
    """
    counts = []
    for texts in (toxic, ordinary):
        each = [np.unique(_grams(t)) for t in texts]
        counts.append(np.unique(np.concatenate([*each, np.zeros(0, np.uint64)]), return_counts=True))
    (grams, n), (others, m) = counts
    elsewhere = np.zeros(len(grams))
    if len(others):
        at = np.minimum(np.searchsorted(others, grams), len(others) - 1)
        elsewhere = np.where(others[at] == grams, m[at], 0)
    marked = grams[(n >= max(4, 0.015 * len(toxic))) & (n / max(1, len(toxic)) > 20 * (elsewhere + 0.5) / max(1, len(ordinary)))]
    seeds = []
    for text in toxic:
        hit = np.isin(_grams(text), marked)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        own = set()
        for a, b in zip(edges[::2], edges[1::2]):
            own.update(b" " + w for w in text[a : b + GRAM - 1].split() if len(w) >= 4)
        seeds.append(b"".join(sorted(own)) + b" ")
    plain = [t[i : i + 64] for t in ordinary for i in range(0, len(t), 64)][:20000]
    return _content(plain, ORDINARY_BYTES), _content(seeds * (1 + 3000 // max(1, len(seeds))), TOXIC_BYTES)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from labelled rows that are not held out: at most ``rows`` of each class, whose ids have the
    smallest hashes, with texts up to TRAIN_BYTES. Ids with contrary labels are left out, and of several texts of
    an id the one with the smallest hash is taken, so reruns agree and the driver gets 2 * ``rows`` texts at most. Null
    texts and labels don't train; with no toxic or no ordinary text the score is a constant. Two thirds of them train the dictionaries, one third the
    thresholds; the intercept is moved to the share of toxic rows among all labelled ones."""
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most").select("doc_id", "toxic")
    share = usable.agg(F.avg("toxic")).first()[0]
    ids = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    sample = ids[0].union(ids[1])  # two times `rows` ids at most
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= TRAIN_BYTES).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    texts = sorted({(r["doc_id"], r["toxic"], r["text"]) for r in texts})
    clean = [(zlib.crc32(b"part%d" % i) % 3, y, b" " + b" ".join(windows(t)) + b" ") for i, y, t in texts]
    toxic, ordinary = ([t for part, y, t in clean if part < 2 and y == k] for k in (1, 0))
    if not toxic or not ordinary:
        weights = np.zeros(2 * len(CUTS) + 2)
        weights[-1] = -4.0 if not toxic else 4.0
        return Model(b"", b"", weights)
    model = Model(*dictionaries(ordinary, toxic), np.zeros(0))
    distance = Distance(model.ordinary, model.toxic)
    rest = [(y, t) for part, y, t in clean if part == 2] or [(y, t) for _, y, t in clean]
    x, y = np.array([features(distance.gains(t.split())) for _, t in rest]), np.array([y for y, _ in rest], float)
    weights = _logistic(x, y)
    if 0 < share < 1 and 0 < y.mean() < 1:
        weights[-1] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return Model(model.ordinary, model.toxic, weights)


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    The score is the calibrated probability of label 1 from the gains of all windows of the whole text. Null and
    empty texts have no windows and get the score of such a text. Repeated rows get equal scores; a null
    doc_id is not held out; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model.ordinary, model.toxic)
        for batch in batches:
            scores = [model.score(distance, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = base.mapInArrow(freed(run), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
