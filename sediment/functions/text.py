"""Text functions as column expressions; they run in the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters from which on grams are counted, and most of a text that are taken at once.
PIECE = 1 << 20
#: Letters of a word in the Latin collections: ASCII letters and all letters beyond ASCII.
WORD = r"[A-Za-z\u0080-\u{10ffff}]+"


def words(text: Column) -> Column:
    """Lower-cased words as an array (A-Z only are lower-cased, so lengths and engines agree)."""
    return F.regexp_extract_all(lower(text), F.lit("([a-z\u0080-\U0010ffff]+)"), F.lit(1))


def lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Letters with marks and the letters under them.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaaaaceeeeiiiinooooouuuuy"


def bare_letters(text: Column) -> Column:
    """Letters and digits alone, without marks, lower-cased."""
    return F.regexp_replace(F.translate(lower(text), MARKED, PLAIN), "[^a-z0-9\u0080-\U0010ffff]", "")


def _runs(items: Column, n: int, joint: str) -> Column:
    """Overlapping runs of n items, joined. The array is bound once, so that no run evaluates it again."""

    def of(x: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(x) - (n - 1)), lambda i: F.concat_ws(joint, *[F.get(x, i + (j - 1)) for j in range(n)]))
        return F.when(F.size(x) >= n, some).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(items), of).getItem(0)


def word_ngrams(tokens: Column, n: int) -> Column:
    """Overlapping runs of n words, joined by spaces; none where there are fewer."""
    return _runs(tokens, n, " ")


def char_ngrams(text: Column, n: int) -> Column:
    """Overlapping runs of n characters."""
    return _runs(F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1)), n, "")


def char_ngram_counts(texts: DataFrame, n: int) -> DataFrame:
    """(gram, n) over the one text column of ``texts``, for grams of up to three characters. Pieces of a batch are counted as
    code points before anything is shuffled; grams never cross texts. Pieces of a long text share n - 1 characters, so that
    each gram lies in one of them."""
    if not 1 <= n <= 3:
        raise ValueError("grams of one to three characters")

    def counted(texts: list[str]) -> pa.RecordBatch:
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum([len(t) for t in texts])
        keys = points[: len(points) - n + 1].copy()
        for i in range(1, n):
            keys = (keys << 21) | points[i : len(points) - n + 1 + i]
        inside = np.ones(len(keys), bool)
        for i in range(1, n):
            inside[ends[:-1] - i] = False
        grams, counts = np.unique(keys[inside], return_counts=True)
        spelled = ["".join(chr(g >> (21 * (n - 1 - i)) & 0x1FFFFF) for i in range(n)) for g in grams.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(spelled, pa.string()), pa.array(counts)], names=["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, held = [], 0
            for value in batch.column(0):
                text = value.as_py()
                for at in range(0, len(text or "") - n + 1, PIECE):
                    some.append(text[at : at + PIECE + n - 1])
                    held += len(some[-1])
                    if held >= PIECE:
                        yield counted(some)
                        some, held = [], 0
            if some:
                yield counted(some)

    return texts.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a phrase."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase)))) / len(phrase)).cast("long")


def snippet(text: Column, at: Column, length: int, width: int) -> Column:
    """The characters around a match that starts at 1-based ``at``."""
    start = F.greatest(F.lit(1), at - width)
    return F.substring(text, start, at + length + width - start)


def sentences(text: Column) -> Column:
    # F.trim itself takes a second argument, which would be the place of the sentence
    return F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def passages(text: Column, most: int) -> Column:
    """Pieces of at most ``most`` characters that together are the text: each ends at the last sentence end that fits, or is cut."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{0,{most - 1}}}[.!?\n]|.{{1,{most}}})"), F.lit(1))


def bare(text: Column) -> Column:
    """Letters, digits and characters beyond ASCII only."""
    return F.regexp_replace(text, "[^A-Za-z0-9\u0080-\U0010ffff]+", "")


def density(text: Column, pattern: str, per: int = 10_000) -> Column:
    """Matches per ``per`` characters; 0 for an empty text."""
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(pattern)) * per / F.length(text)).otherwise(0.0)


def token_estimate(text: Column) -> Column:
    """One for each CJK character and a quarter for each other one."""
    other = F.length(F.regexp_replace(text, "[㐀-鿿]", ""))
    return (F.length(text) - other) + F.ceil(other / 4)


def parse_number(cell: Column) -> Column:
    """A number from a cell with thousands separators or a percent sign; null where it isn't one."""
    plain = F.regexp_replace(F.trim(cell), "[,%]", "")
    value = plain.try_cast("double")
    return F.when(F.trim(cell).endswith("%"), value / 100).otherwise(value)


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 16))
