"""Token counts of fields and sections, from one encoding of the whole document."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder, vocabulary

RULES = ("first", "last", "most")


def token_spans(text: str, ids: np.ndarray, byte_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First code point and the one after the last that each token has bytes of."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    ends = np.cumsum(byte_lengths[ids].astype(np.int64))
    begins = ends - byte_lengths[ids]
    if len(points) == (ends[-1] if len(ends) else 0):
        return begins, ends
    of_byte = np.repeat(np.arange(len(points)), width)
    return of_byte[begins], of_byte[ends - 1] + 1


def attribute(begins: np.ndarray, ends: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, tokens that cross into it or out of it and are given to it).

    Sections lie end to end from cuts[i] to cuts[i+1]. Both sides are sorted, so the interval join is two
    binary searches. A token over several sections goes to the ``first`` or ``last`` of them, or to the one
    that holds ``most`` of its characters (the earliest in a tie).
    """
    n = len(cuts) - 1
    first = np.searchsorted(cuts, begins, "right") - 1
    last = np.searchsorted(cuts, ends, "left") - 1
    own = first.copy()
    crossing = first != last
    if rule == "last":
        own = last
    elif rule == "most":
        for i in np.flatnonzero(crossing):
            parts = np.arange(first[i], last[i] + 1)
            held = np.minimum(cuts[parts + 1], ends[i]) - np.maximum(cuts[parts], begins[i])
            own[i] = parts[int(np.argmax(held))]
    return np.bincount(own, minlength=n), np.bincount(own[crossing], minlength=n)


def section_tokens(docs: DataFrame, fields: Sequence[str] = ("source", "lang", "text"), by_line: str | None = "text", rule: str = "most", path: str | None = None, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row for each section of each document: keys, section, field, char_start, char_end, n_tokens, n_crossing,
    doc_tokens.

    A document is its ``fields`` joined by line feeds and encoded once, whole. Every field is a section, but
    field ``by_line`` has one for each of its lines; a section holds its trailing line feed, so sections
    cover the document and their tokens add up to ``doc_tokens``. ``rule`` says where a token goes
    that crosses a boundary (see ``attribute``).

    A special token that a text spells out is one token (see ``tokens``), so it counts once, for one section.
    Null fields are empty: a section of the line feed alone (the last one of nothing). Repeated rows each
    give their sections; an empty table gives none.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    path = path or vocabulary()
    base = docs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    key_schema = ", ".join(f"k{i} {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    schema = f"{key_schema}, section int, field string, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        lengths = tool.byte_lengths()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                parts = [[x or "" for x in some.column(len(keys) + i).to_pylist()] for i in range(len(fields))]
                texts = ["\n".join(p) for p in zip(*parts)]
                ids, begin = tool.encode(texts)
                out: list[list] = [[], [], [], [], [], [], []]
                rows: list[int] = []
                for i, text in enumerate(texts):
                    own = ids[begin[i] : begin[i + 1]]
                    b, e = token_spans(text, own, lengths)
                    cuts, names = [0], []
                    place = 0
                    for k, field in enumerate(fields):
                        body = parts[k][i] + ("\n" if k < len(fields) - 1 else "")
                        if field == by_line:
                            feeds = np.flatnonzero(np.frombuffer(body.encode("utf-32-le"), np.uint32) == 10) + 1
                            stops = feeds.tolist() if len(feeds) and feeds[-1] == len(body) else [*feeds.tolist(), len(body)]
                        else:
                            stops = [len(body)]
                        cuts += [place + s for s in stops]
                        names += [field] * len(stops)
                        place += len(body)
                    edges = np.array(cuts, np.int64)
                    tokens, crossing = attribute(b, e, edges, rule)
                    rows += [i] * len(names)
                    for column, values in zip(out, (range(len(names)), names, cuts[:-1], cuts[1:], tokens.tolist(), crossing.tolist(), [len(own)] * len(names))):
                        column.extend(values)
                kept = some.take(pa.array(rows, pa.int64()))
                kinds = (pa.int32(), pa.string(), *[pa.int64()] * 5)
                yield pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(len(keys))), *(pa.array(c, k) for c, k in zip(out, kinds))], names=[*(f"k{i}" for i in range(len(keys))), "section", "field", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"])

    found = base.mapInArrow(run, schema)
    return found.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "section", "field", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens")


def op6_section_tokens(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    return section_tokens(docs)
