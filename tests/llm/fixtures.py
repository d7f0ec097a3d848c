"""Small tables that the tests of the numbered operators share."""

from __future__ import annotations

import random
import re
import string

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = re.compile(r"[\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"

rng = random.Random(11)
VOCABULARY = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9))) for _ in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edge_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, size): nulls, empty and long texts, repeats, columns with clashing names."""
    return [
        (1, None, "en", "a", None, "x"),
        (2, "", None, "a", 0, "x"),
        (3, " \t\n\x0b\x0c\r ", "en", None, 7, None),
        (4, prose(1, 60), "en", "a", 1, "x"),
        (4, prose(1, 60), "en", "a", 1, "x"),
        (5, prose(1, 60).upper(), "en", "b", 1, "x"),
        (6, prose(2, 30000), "fr", "b", 1, "x"),
        (7, "one", "en", "c", 1, "x"),
        (8, "one", "en", "c", 1, "x"),
        (9, "ein Wort été \U0001f600 naïve\n\n\n" * 20, "de", "c", 1, "x"),
        (None, prose(3, 50), "en", "c", 1, "x"),
        (11, "same line here\n" * 30 + prose(4, 20), "en", None, 1, "x"),
        (-12, prose(5, 120), "en", None, 1, "x"),
        (13, prose(5, 119) + " other", "en", "d", 1, "x"),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
