from __future__ import annotations

import random
import zlib

import numpy as np

from sediment.catalog import QUERIES
from sediment.operators import boundaries as B

SCHEMA = "doc_id long, text string"


def lawful(seed: int, n: int):
    """Texts where a mark stands after words in -end, before "but", and otherwise rarely."""
    r = random.Random(seed)
    stems = ["".join(r.choice("bcdfgaeiou") for _ in range(5)) for _ in range(60)]
    rows = []
    for i in range(n):
        out = []
        for _ in range(r.randint(0, 120)):
            word = r.choice(stems) + r.choice(["", "", "", "end"])
            out.append(r.choice(["but", word, word, word, word, word]))
        text = ""
        for a, b in zip(out, [*out[1:], ""]):
            text += a + (r.choice([", ", ". "]) if a.endswith("end") or b == "but" or r.random() < 0.01 else " ")
        rows.append((i, text.title() if i % 2 else text))
    return [*rows, (None, "a b, c"), (-1, None), (-2, ""), (-3, "one"), (-4, "?!.")]


def test_gaps():
    views, marked, rule = B.gaps("One, two three: und (four).")
    assert views.shape == (4, B.VIEWS) and marked.tolist() == [True, False, True, False] and rule.tolist() == [False, False, True, False]
    assert (B.gaps("ONE two")[0] == B.gaps("one, TWO!")[0]).all()  # marks and case are not looked at
    for text in (None, "", "one", " .,"):
        assert len(B.gaps(text)[1]) == 0


def test_a_law_is_learned_and_holds_on_texts_not_seen(spark):
    docs = spark.createDataFrame(lawful(1, 400), SCHEMA).repartition(4)
    model = B.fitted(docs)
    found = {r["method"]: r for r in B.scored(docs, model).collect()}
    assert found["model"]["f1"] > 0.95 > 0.7 > found["rule"]["f1"]
    other = lawful(1, 420)[400:]
    marks = {r["doc_id"]: (r["n_words"], r["marks"]) for r in B.restored_marks(spark.createDataFrame(other, SCHEMA), model).collect()}
    right = wrong = 0
    for i, text in other:
        law = set(B.gaps(text)[1].nonzero()[0].tolist())
        assert marks[i][0] == len(B._WORD.findall(text or ""))
        right, wrong = right + len(law & set(marks[i][1])), wrong + len(law ^ set(marks[i][1]))
    assert 2 * right / (2 * right + wrong) > 0.95 and right > 100
    assert marks[-1] == marks[-2] == marks[-4] == (0, []) and marks[-3] == (1, [])


def test_the_same_sums_by_hand(spark):
    docs = spark.createDataFrame(lawful(2, 40), SCHEMA).repartition(3)
    total = B._totals(docs.select("text"), 3, lambda views, marked, rule: [len(marked), marked.sum(), rule.sum()])
    wanted = [0, 0, 0]
    for _, text in lawful(2, 40):
        _, marked, rule = B.gaps(text)
        wanted = [a + b for a, b in zip(wanted, (len(marked), marked.sum(), rule.sum()))]
    assert total.tolist() == wanted


def test_nothing_to_learn(spark):
    for rows in ([], [(1, None)], [(i, "no marks at all") for i in range(50)]):
        docs = spark.createDataFrame(rows, SCHEMA)
        model = B.fitted(docs)
        assert all(r["predicted"] == 0 or r["method"] == "rule" for r in B.scored(docs, model).collect())
        assert all(r["marks"] == [] for r in B.restored_marks(docs, model).collect())


def test_query(spark):
    found = {r["method"]: r for r in QUERIES["punctuation_model"].run(spark, "/root/testdata/sf0.001").collect()}
    assert found["model"]["f1"] > found["rule"]["f1"] and found["model"]["gaps"] == found["rule"]["gaps"] > 1000


def test_gaps_are_hashed_as_their_words_are_spelled_and_written_once(spark):
    import zlib

    words = ["a", "é", "abcdefghijklmnop", "and", "x1"]
    views, marked, rule = B.gaps("A é, abcdefghijklmnop; and X1")
    padded = ["", *words, "", ""]
    for i, row in enumerate(views.tolist(), 1):
        a, b, c, d = padded[i - 1 : i + 3]
        seen = (a, b, c, d, f"{b} {c}", f"{a} {b}", b[-3:], c[:3], f"{min(len(b), 12)} {min(len(c), 12)}")
        assert row == [zlib.crc32(f"{v} {x}".encode()) % B.BUCKETS for v, x in enumerate(seen)]
    back = B._viewed(spark.createDataFrame([("A é, abcdefghijklmnop; and X1",), (None,), ("one",)], "text string")).collect()
    assert len(back) == 1
    assert bytes(back[0]["views"]) == views.astype("uint16").tobytes() and bytes(back[0]["marked"]) == marked.tobytes()


def test_gaps_of_many_texts_are_added_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(" ".join(["a b, c"] * 4),)] * 30 + [(None,), ("one",)], "text string").coalesce(1)
    calls = B._totals(docs, 3, lambda views, marked, rule: [1, len(marked), len(views)]).tolist()
    assert calls == [1, 330, 330]
    assert B._totals(B._viewed(docs), 2, lambda views, marked, rule: [1, len(marked) if rule is None else -1]).tolist() == [1, 330]
    texts = [r["text"] for r in docs.collect()] + ["x" * 60 + " " + "é" * 40 + "; b " + "😀" * 30 + " c"]
    whole = [B.gaps(x) for x in texts]
    monkeypatch.setattr(B, "TAKEN", 40)
    monkeypatch.setattr(B, "KNOWN", 1)
    some = list(B._several(texts))
    assert [len(x[1]) for x in some] == [44] * 7 + [26]
    for together, alone in zip(zip(*some), zip(*whole)):
        assert (np.concatenate(together) == np.concatenate(alone)).all()
    for i, (a, b) in enumerate(zip(texts[-1].replace(";", "").split(), texts[-1].replace(";", "").split()[1:])):
        assert whole[-1][0][i][4] == zlib.crc32(f"4 {a} {b}".encode()) % B.BUCKETS
