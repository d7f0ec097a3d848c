from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from compare import differences
from fixtures import SMALL, edges, edge_rows, empty

from sediment.llm.shared import written
from sediment.llm.spelling import OP11_SQL, corpus_words, near_words, op11_spelling_variants, spelling_variants


def one_apart(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words: dict[str, int], factor: int = 5) -> set[tuple]:
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def made(seed: int, letters: str, n: int) -> dict[str, int]:
    r = random.Random(seed)
    out: dict[str, int] = {}
    while len(out) < n:
        w = "".join(r.choice(letters) for _ in range(r.randint(6, 9)))
        out[w] = int(5 ** (5 * r.random()) + 5)
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(w))
            w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice(letters) + w[at:], w[:at] + r.choice(letters) + w[at + 1 :]])
            if len(w) >= 6:
                out[w] = r.randint(5, 200)
    return out


@pytest.mark.parametrize("letters, pairs", [("ab", 256), ("ab", 2), ("abcé", 256), ("abcé", 1), ("abcdefghijklmnopqrstuvwxyzéß", 256), ("aé", 3)])
def test_against_all_pairs(spark, letters, pairs):
    words = made(len(letters) + pairs, letters, 150 if letters in ("ab", "aé") else 400)
    words |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 7}
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert set(map(tuple, spelling_variants(table, pairs=pairs).select("word", "form", "root", "n", "n_near", "form_n").collect())) == brute(words)


def test_pairs_come_once(spark):
    words = made(5, "abc", 200)
    near = near_words(written(spark.createDataFrame(list(words.items()), "word string, n long"))).collect()
    assert len({(r["a"], r["b"]) for r in near}) == len(near)
    assert {frozenset((r["a"], r["b"])) for r in near} == {frozenset((a, b)) for a in words for b in words if one_apart(a, b)}


def test_table_against_sql(spark):
    assert differences(spark, op11_spelling_variants, OP11_SQL, SMALL) == []


def counted(rows, divisor=None, length=6, count=5) -> dict[str, int]:
    words: Counter[str] = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if divisor:
                h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
                if h % divisor == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
            words[w] += 1
    return {w: n for w, n in words.items() if len(w) >= length and n >= count}


@pytest.mark.parametrize("divisor", [None, 3])
def test_words_of_edge_rows(spark, divisor):
    assert dict(corpus_words(edges(spark), divisor).collect()) == counted(edge_rows(), divisor)
    assert corpus_words(empty(spark), divisor).collect() == []


def test_edges_of_tables(spark):
    schema = "word string, n long, root string, form int, `a.b` string"
    assert spelling_variants(spark.createDataFrame([], schema)).collect() == []
    rows = [("abcdef", 50, "x", 1, "p"), ("abcdeg", 10, "x", 1, "q"), (None, 4, "x", 1, None), ("zz", 7, None, None, "r"), ("", 7, None, None, "r"), ("abcdeh", None, "x", 1, "s"), ("y" * 5000, 9, None, 1, "t"), ("y" * 5001, 90, None, 1, "u")]
    found = spelling_variants(spark.createDataFrame(rows, schema)).collect()
    got = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"], r["a.b"]) for r in found}
    assert got == {
        ("abcdef", None, "abcdef", 50, 1, None, "p"),
        ("abcdeg", "abcdef", "abcdef", 10, 1, 50, "q"),
        (None, None, None, 4, 0, None, None),
        ("zz", None, "zz", 7, 0, None, "r"),
        ("", None, "", 7, 0, None, "r"),
        ("abcdeh", None, "abcdeh", None, 0, None, "s"),
        ("y" * 5000, "y" * 5001, "y" * 5001, 9, 1, 90, "t"),
        ("y" * 5001, None, "y" * 5001, 90, 1, None, "u"),
    }
