from __future__ import annotations

from collections import Counter

import pytest
from compare import differences
from fixtures import SMALL, WORD, edge_rows, edges, empty, prose

from sediment.llm import quality
from sediment.llm.decontamination import _laid as laid
from sediment.llm.quality import OP2_SQL, RULES, Page, base_test, cascade_order, op2_quality_rules, passing, quality_rules


def base(text: str | None) -> tuple:
    text = text or ""
    ws = WORD.findall(text)
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    n = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(ws) < 10 or 100 * len(inside) > 20 * len(ws)


def test_agrees_with_sql(spark):
    assert differences(spark, op2_quality_rules, OP2_SQL, SMALL) == []


def test_base_measures_on_edges(spark):
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in quality_rules(edges(spark)).collect())
    assert found == sorted((i is None, i or 0, *base(t)) for i, t, *_ in edge_rows())
    assert quality_rules(empty(spark)).collect() == []


def test_order_of_rules_changes_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one = sorted(tuple(r) for r in quality_rules(docs).select("doc_id", "kept").collect())
    order = [name for name, *_ in cascade_order(docs)]
    monkeypatch.setattr(quality, "cascade_order", lambda *a, **k: [(n, 1.0, 0.0) for n in reversed(order)])
    assert sorted(tuple(r) for r in quality_rules(docs).select("doc_id", "kept").collect()) == one


def test_order_is_by_rejection_per_cost(spark):
    scored = cascade_order(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert sorted(n for n, *_ in scored) == sorted(r.name for r in RULES)
    assert scored[0][2] / scored[0][1] == max(hit / cost for _, cost, hit in scored[:1])
    assert all(0 <= hit <= 1 and cost > 0 for _, cost, hit in scored)


def test_shares_are_of_rows_that_came_so_far(spark):
    shout = "AAAA BBBB CCCC DDDD EEEE FFFF GGGG HHHH IIII JJJJ KKKK LLLL"
    texts = ["few words"] * 30 + [f"{shout} {i}" for i in range(20)] + [f"{shout} # # # # # # # {i}" for i in range(20)] + [" ".join(f"w{chr(97 + i % 26)}{chr(97 + k)}{chr(97 + i // 26)}o" for k in range(12)) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    scored = {name: hit for name, _, hit in cascade_order(docs)}
    assert scored["shouting"] in (pytest.approx(0.5), pytest.approx(20 / 60))  # the base test's 30 rows do not count
    assert scored["symbols"] in (0, pytest.approx(0.25))


def test_every_rule_rejects_what_the_base_test_passes():
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    texts = {"symbols": long.replace(" ", "# "), "shouting": long.upper(), "table": long.replace(" ", " | "), "digits": " ".join(str(10**9 + 7919 * i) for i in range(40)), "word_length": " ".join(chr(97 + i % 26) for i in range(26)), "repeated_lines": "\n".join([f"line {c}" for c in "abcdefghijklmnop"] + ["same", "other", "same", "one", "same", "two", "same", "three", "same", "four", "same"] + ["same"] * 3 + ["five", "same", "six", "same", "seven", "same", "eight", "same"])}
    for rule in RULES:
        page = Page(*laid([texts[rule.name]]))
        assert rule.rejects(page)[0], rule.name
        if rule.name != "repeated_lines":
            assert not base_test(page)[0], rule.name


def test_passing_is_what_the_rules_keep(spark):
    for docs in (spark.read.parquet(f"{SMALL}/documents.parquet"), edges(spark)):
        kept = sorted(r["text"] for r in quality_rules(docs).where("kept").collect())
        assert sorted(r["text"] for r in passing(docs).collect()) == kept
    assert passing(empty(spark)).collect() == []


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "plain words that stand in a line of some length here", "mine")], "doc_id long, text string, kept string")
    out = passing(docs)
    assert out.columns == docs.columns
    assert out.first()["kept"] == "mine"


def test_any_column_names(spark):
    rows = [(1, prose(1, 60), "x", 1.5, "y"), (2, "one two", "x", None, None)]
    names = ["doc_id", "text", "a.b", "n`w", "c.d.e"]
    docs = spark.createDataFrame(rows, "a long, b string, c string, d double, e string").toDF(*names)
    kept = passing(docs)
    assert kept.columns == names and [tuple(r) for r in kept.collect()] == rows[:1]
    ruled = quality_rules(docs)
    assert ruled.columns[:5] == names and {r["doc_id"]: (r["a.b"], r["kept"]) for r in ruled.collect()} == {1: ("x", True), 2: ("x", False)}
