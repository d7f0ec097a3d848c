from __future__ import annotations

import random
import re

from sediment.operators import audit as A

CLAIMS = "claim int, subject string, relation string, object string, denied boolean, at int"
EVIDENCE = "source int, subject string, relation string, object string, denied boolean, at int"


def test_verdicts_against_a_plain_search(spark):
    r = random.Random(1)

    def row(i):
        return (i, r.choice("ab"), r.choice("xy"), r.choice("kl"), r.random() < 0.4, r.choice([None, 1, 2, 3]))

    claims, evidence = [row(i // 2) for i in range(60)], [row(r.randint(0, 5)) for _ in range(9)]
    claims += [(90, None, "x", "k", False, 1), (91, "a", "x", "k", None, 1), claims[0]]
    found = A.audited(spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(evidence, EVIDENCE)).collect()
    assert len(found) == len(claims)
    for c in found:
        near = [e for e in evidence if (e[1], e[2]) == (c["subject"], c["relation"]) and (c["at"] is None or (e[5] is not None and e[5] <= c["at"]))]
        pro = {e[0] for e in near if e[3] == c["object"] and c["denied"] is not None and e[4] == c["denied"]}
        contra = {e[0] for e in near if e[3] == c["object"] and c["denied"] is not None and e[4] != c["denied"]}
        related = {e[0] for e in near if e[3] != c["object"]}
        assert (c["pro"], c["contra"], c["related"]) == (len(pro), len(contra), len(related)), c
        assert c["verdict"] == ("contested" if pro and contra else "supported" if pro else "contradicted" if contra else "related" if related else "unsupported")
    worst = {o["claim"]: (o["claims"], o["verdict"]) for o in A.overall(spark.createDataFrame([(1, "supported"), (1, "related"), (2, "supported"), (3, "contested"), (3, "contradicted")], "claim int, verdict string"), "claim").collect()}
    assert worst == {1: (2, "related"), 2: (1, "supported"), 3: (2, "contradicted")}
    assert A.audited(spark.createDataFrame([], CLAIMS), spark.createDataFrame(evidence, EVIDENCE)).collect() == []


def test_equations_against_a_plain_search(spark):
    r = random.Random(2)
    words = ["humour", "phlegm", "virus", "cell", "is", "means", "perhaps", "the", "a"]
    docs = [(i, ". ".join(" ".join(r.choices(words, [3, 3, 3, 3, 2, 1, 1, 6, 6], k=r.randint(0, 12))) for _ in range(4)).title()) for i in range(60)] + [(100, None), (101, "")]
    terms = [("humour", False), ("phlegm", False), ("virus", True), ("cell", True), ("cell", False), (None, True), ("the", None)]
    wanted = {}
    for d, text in docs:
        for s, sentence in enumerate(x for x in (y.strip() for y in re.split(r"[.!?\n]+", text or "")) if x):
            w = sentence.lower().split()
            if "perhaps" in w:
                continue
            for i, a in enumerate(w):
                for j, b in enumerate(w):
                    if a in ("humour", "phlegm") and b in ("virus", "cell") and abs(i - j) <= 6 and {"is", "means"} & set(w[min(i, j) + 1 : max(i, j)]):
                        wanted[d, s, a, b] = wanted.get((d, s, a, b), 0) + 1
    found = A.equations(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(terms, "term string, modern boolean")).collect()
    assert {(x["doc_id"], x["sentence"], x["old"], x["modern"]): x["n"] for x in found} == wanted and wanted


def test_sentences_are_trimmed_of_spaces_alone(spark):
    from pyspark.sql import functions as F

    from sediment.functions import text as T

    texts = [("One.  . Two !   ",), ("0 is none. 1 is one. 2",), (" . ",)]
    found = [r[0] for r in spark.createDataFrame(texts, "text string").select(T.sentences(F.col("text"))).collect()]
    assert found == [["One", "Two"], ["0 is none", "1 is one", "2"], []]
    terms = spark.createDataFrame([("humour", False), ("virus", True)], "term string, modern boolean")
    docs = spark.createDataFrame([(1, "One.  . Humour means virus.")], "doc_id long, text string")
    assert [r["sentence"] for r in A.equations(docs, terms).collect()] == [1]


def test_cells_of_many_values_are_trimmed_of_spaces_alone(spark, tmp_path):
    from sediment.sources import records

    (tmp_path / "cells.csv").write_text("id,values\n1,0 a; 1 b ; ;2\n")
    found = records.read_delimited(spark, str(tmp_path / "cells.csv"), "id long, values string", several={"values": ";"}).collect()
    assert found[0]["values"] == ["0 a", "1 b", "2"]
