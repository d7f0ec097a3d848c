"""Quality rules as a short-circuit cascade, cheapest rejection first."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_place, freed, named
from .words import PLAIN, U, Words, mix, pieces, powers

#: Rows on which costs and selectivity are estimated (the order of rules never changes what is kept).
SAMPLE_ROWS = 2000

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1
_HEAD = np.ones(256, np.uint8)
_HEAD[0x80:0xC0] = 0  # bytes that go on with a code point
_UPPER, _LOWER, _DIGIT = (np.zeros(256, np.uint8) for _ in range(3))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = 1, 1, 1


def _taken(values: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``values`` that belong to rows ``at``, end to end, and their offsets."""
    size = offsets[at + 1] - offsets[at]
    to = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(offsets[at] - to[:-1], size) + np.arange(to[-1])], to


class Page:
    """The rows of one piece. Measures are computed when first asked for and kept; ``rows_of`` gives the page of some
    of its rows, which takes over what this one knows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: Words | None = None):
        self.data, self.offsets = data, offsets
        self.words = words or Words(data, offsets, PLAIN)
        self.row = self.words.row
        self.n_words = np.diff(self.row)
        self.rows = len(offsets) - 1
        self.known: dict[str, np.ndarray] = {}

    def get(self, measure: str) -> np.ndarray:
        if measure not in self.known:
            self.known[measure] = getattr(self, measure)()
        return self.known[measure]

    def rows_of(self, at: np.ndarray) -> Page:
        data, offsets = _taken(self.data, self.offsets, at)
        words = object.__new__(Words)
        own, words.row = _taken(np.arange(len(self.words.start)), self.row, at)
        shift = np.repeat(offsets[:-1] - self.offsets[at], np.diff(words.row))
        words.start, words.end, words.hash = self.words.start[own] + shift, self.words.end[own] + shift, self.words.hash[own]
        out = Page(data, offsets, words)
        out.known = {name: values[at] for name, values in self.known.items()}
        return out

    def per_row(self, of_byte: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(of_byte[self.data], dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def word_chars(self) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(_HEAD[self.data], dtype=np.int64)])
        each = np.concatenate([[0], np.cumsum(sums[self.words.end] - sums[self.words.start])])
        return each[self.row[1:]] - each[self.row[:-1]]

    def symbols(self) -> np.ndarray:
        return self.per_row(_SYMBOL)

    def _again(self, keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of keys within rows, and which (in that order) equal the one before."""
        order = np.lexsort((keys, rows))
        same = np.zeros(len(keys), bool)
        same[1:] = (keys[order][1:] == keys[order][:-1]) & (rows[order][1:] == rows[order][:-1])
        return order, same

    def dup_lines(self) -> np.ndarray:
        """Lines (between line feeds) that hold a word and equal an earlier one of the row."""
        feeds = np.flatnonzero(self.data == 10)
        starts = np.unique(np.concatenate([self.offsets[:-1], feeds + 1]))
        starts = starts[starts < len(self.data)]
        if not len(starts):
            return np.zeros(self.rows, np.int64)
        ends = np.minimum(np.append(starts[1:], len(self.data)), len(self.data))
        closed = (ends > starts) & (self.data[ends - 1] == 10)
        ends = ends - closed
        worded = np.searchsorted(self.words.start, ends) > np.searchsorted(self.words.start, starts)
        raw = self.data
        base = 0x2545F4914F6CDD1D
        inverse = pow(base, -1, 2**64)
        values = (raw.astype(U) + U(1)) * powers(len(raw), base)
        values[feeds] = 0
        sums = np.add.reduceat(values, starts) * powers(len(raw), inverse)[starts]
        keys = mix(sums + (ends - starts).astype(U))[worded]
        rows = (np.searchsorted(self.offsets, starts, "right") - 1)[worded]
        order, same = self._again(keys, rows)
        return np.bincount(rows[order][same], minlength=self.rows)

    def repeat_words(self, k: int = 5) -> np.ndarray:
        """Words inside windows of k words that the row holds twice or more."""
        h, rows = self.words.shingles(k)
        count = np.diff(rows)
        short = self.n_words < k
        row = np.repeat(np.arange(self.rows), count)
        full = ~short[row]
        order, same = self._again(h[full], row[full])
        twice = np.zeros(len(order), bool)
        twice[same] = True
        twice[:-1] |= same[1:]
        hit = np.zeros(len(h), bool)
        hit[np.flatnonzero(full)[order[twice]]] = True
        at = np.flatnonzero(hit)
        first = self.row[row[at]] + (at - rows[row[at]])
        marks = np.zeros(len(self.words.hash) + 1, np.int64)
        np.add.at(marks, first, 1)
        np.add.at(marks, first + k, -1)
        inside = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
        return inside[self.row[1:]] - inside[self.row[:-1]]

    def shouted(self) -> np.ndarray:
        """Share of A-Z among ASCII letters."""
        up = self.per_row(_UPPER)
        return up / np.maximum(up + self.per_row(_LOWER), 1)

    def digits(self) -> np.ndarray:
        return self.per_row(_DIGIT) / np.maximum(self.per_row(_HEAD), 1)

    def bars(self) -> np.ndarray:
        return (self.per_row(_BAR)) / np.maximum(self.n_words, 1)

    def lines(self) -> np.ndarray:
        return self.per_row(_FEED) + 1


_BAR, _FEED = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
_BAR[ord("|")] = 1
_FEED[10] = 1


@dataclass(frozen=True)
class Rule:
    """``rejects(page)``: a boolean for each row, from measures that the page keeps."""

    name: str
    rejects: Callable[[Page], np.ndarray]


RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda p: p.get("symbols") > 0.3 * np.maximum(p.n_words, 1)),
    Rule("shouting", lambda p: (p.get("shouted") > 0.6) & (p.n_words >= 10)),
    Rule("table", lambda p: p.get("bars") > 0.2),
    Rule("digits", lambda p: p.get("digits") > 0.3),
    Rule("word_length", lambda p: (p.get("word_chars") > 25 * np.maximum(p.n_words, 1)) | (p.get("word_chars") < 2 * p.n_words)),
    Rule("repeated_lines", lambda p: p.get("dup_lines") > 0.3 * p.get("lines")),
)
#: What the operator reports of every row; rules find these measures computed.
MEASURES = {"word_chars": "word_chars", "n_symbols": "symbols", "n_dup_lines": "dup_lines", "n_repeat_words": "repeat_words"}
_ADDED = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("rejected_by", "string"), ("kept", "boolean")]


def base_test(page: Page) -> np.ndarray:
    """Rows with under 10 words, or with over a fifth of their words in repeated windows of five; the second part is
    only worked out for rows that pass the first."""
    failed = page.n_words < 10
    at = np.flatnonzero(~failed)
    if "repeat_words" in page.known:
        return failed | (100 * page.known["repeat_words"] > 20 * page.n_words)
    if len(at):
        part = page.rows_of(at)
        failed[at] = 100 * part.get("repeat_words") > 20 * part.n_words
    return failed


def cascade(page: Page, alive: np.ndarray, rules: list[Rule]) -> np.ndarray:
    """The rows of ``alive`` that every rule passes; a rule sees only the rows that the rules before it passed."""
    at = np.flatnonzero(alive)
    part = page if len(at) == page.rows else None
    for rule in rules:
        if not len(at):
            break
        part = page.rows_of(at) if part is None else part
        bad = rule.rejects(part)
        if bad.any():
            keep = np.flatnonzero(~bad)
            at = at[keep]
            part = part.rows_of(keep)
    out = np.zeros(page.rows, bool)
    out[at] = True
    return out


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, measured: bool = True) -> list[tuple[str, float, float]]:
    """(rule, seconds a row, share rejected) in the order of the cascade: each time the rule with the most rejections
    per second among rows that the base test and the rules chosen before it pass.

    Costs and joint rejections come from a sample of about ``rows`` rows that pass the base test, drawn inside the
    tasks by a hash of the text; what leaves a task is a count for each set of rules that reject a row together.
    ``measured``: whether the operator's own measures are there already when a rule runs. The sample only sets the
    order, which never changes what is kept.
    """
    total = docs.count()
    one_in = max(1, total // rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, hits, seen = np.zeros(len(rules)), np.zeros(1 << len(rules), np.int64), 0
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                page = Page(data, offsets)
                at = np.flatnonzero(~base_test(page))
                if not len(at):
                    continue
                page = page.rows_of(at)
                if measured:
                    for name in MEASURES.values():
                        page.get(name)
                pattern = np.zeros(page.rows, np.int64)
                for i, rule in enumerate(rules):
                    own = page.rows_of(np.arange(page.rows))
                    began = time.perf_counter()
                    bad = rule.rejects(own)
                    seconds[i] += time.perf_counter() - began
                    pattern |= bad.astype(np.int64) << i
                hits += np.bincount(pattern, minlength=len(hits))
                seen += page.rows
        at = np.flatnonzero(hits)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([-1 - np.arange(len(rules)), at])), pa.array(np.concatenate([seconds, hits[at].astype(float)]))], names=["what", "amount"])

    sample = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)
    sums = sample.mapInArrow(freed(measure), "what long, amount double").groupBy("what").agg(F.sum("amount").alias("amount"))
    found = {r["what"]: r["amount"] for r in sums.collect()}  # a row a rule and a row a set of rules
    left = {k: n for k, n in found.items() if k >= 0}
    seen = max(1.0, sum(left.values()))
    cost = {i: max(found.get(-1 - i, 0.0) / seen, 1e-9) for i in range(len(rules))}
    out = []
    while len(out) < len(rules):
        alive = max(1.0, sum(left.values()))
        share = {i: sum(n for k, n in left.items() if k >> i & 1) / alive for i in cost}
        best = min(cost, key=lambda i: (-share[i] / cost[i], cost[i], rules[i].name))
        out.append((rules[best].name, cost.pop(best), share[best]))
        left = {k: n for k, n in left.items() if not k >> best & 1}
    return out


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` (any columns, ``text`` among them; clashing names are replaced) with n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by and kept.

    The base test (under 10 words, or over a fifth of the words in repeated windows of five) comes first; rules then
    run on the rows that all rules before them passed and use the measures that are reported anyway.
    ``rejected_by`` is "base", "rules" or null. Null and empty texts have no words and fail the base test. Every text
    is read whole; repeated rows get equal results; an empty table gives no rows.
    """
    by_name = {r.name: r for r in rules}
    ordered = [by_name[name] for name, *_ in cascade_order(docs, rules)]
    kept_columns = [c for c in docs.columns if c.lower() not in dict(_ADDED)]
    base = by_place(docs.select(*named(kept_columns)))
    schema = T.StructType([*base.schema.fields])
    for name, kind in _ADDED:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(kept_columns.index("text"))
            for first, last, data, offsets in pieces(text):
                page = Page(data, offsets)
                for name in MEASURES.values():
                    page.get(name)
                failed = base_test(page)
                alive = cascade(page, ~failed, ordered)
                why = np.where(failed, "base", np.where(alive, None, "rules")).tolist()
                cols = [page.n_words, *(page.get(name) for name in MEASURES.values())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, last - first) for i in range(batch.num_columns)), *(pa.array(c, pa.int64()) for c in cols), pa.array(failed), pa.array(why, pa.string()), pa.array(alive)], names=schema.names)

    return base.mapInArrow(freed(run), schema).toDF(*kept_columns, *dict(_ADDED))


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of ``docs`` that are kept, with their own columns, of any names. Here nothing is reported, so the cascade
    saves what it can: a measure is worked out for the rows that still live when a rule asks for it. Null and empty texts
    go; repeated rows go or stay together; an empty table gives no rows."""
    by_name = {r.name: r for r in rules}
    ordered = [by_name[name] for name, *_ in cascade_order(docs, rules, measured=False)]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for _, _, data, offsets in pieces(batch.column(at)):
                page = Page(data, offsets)
                keep.append(cascade(page, ~base_test(page), ordered))
            yield batch.filter(pa.array(np.concatenate(keep)))

    base = by_place(docs)
    return base.mapInArrow(freed(run), base.schema).toDF(*docs.columns)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n >= 2),
rw AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(ls) AS l FROM w),
dup AS (
  SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS n FROM (
    SELECT doc_id, l, count(*) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS up,
    length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS low,
    length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS dig,
    length(text) - length(replace(text, '|', '')) AS bars, length(text) AS chars, len(ls) AS n_lines
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rw USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR n_symbols > 0.3 * greatest(n_words, 1)
    OR (CAST(up AS DOUBLE) / greatest(up + low, 1) > 0.6 AND n_words >= 10)
    OR CAST(bars AS DOUBLE) / greatest(n_words, 1) > 0.2
    OR CAST(dig AS DOUBLE) / greatest(chars, 1) > 0.3
    OR word_chars > 25 * greatest(n_words, 1) OR word_chars < 2 * n_words
    OR n_dup_lines > 0.3 * n_lines
    OR n_repeat_words > 0.2 * n_words) AS kept
FROM b
"""
