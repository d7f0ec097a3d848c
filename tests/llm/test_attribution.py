from __future__ import annotations

import pytest
from fixtures import SMALL, edge_rows, edges, empty

from sediment.llm.attribution import op6_section_tokens, section_tokens
from sediment.llm.tokens import vocabulary


def expected(doc_id, parts: list[tuple[str, str]], rule: str) -> list[tuple]:
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(vocabulary())
    names = [n for n, _ in parts]
    text = "\n".join(t for _, t in parts)
    spans, at = [], 0
    for i, (name, body) in enumerate(parts):
        body += "\n" * (i < len(parts) - 1)
        lines = body.splitlines(keepends=True) if False else ([x + "\n" for x in body.split("\n")[:-1]] + ([body.split("\n")[-1]] if body.split("\n")[-1] or not body else [])) if name == "text" else [body]
        for line in lines:
            spans.append((name, at, at + len(line)))
            at += len(line)
    assert names and at == len(text)
    got = tool.encode(text, add_special_tokens=False)
    counts, crossing = [0] * len(spans), [0] * len(spans)
    # the library's offsets drop a leading space; the token's own bytes are laid end to end instead
    raw, place = text.encode(), 0
    first_point = [len(raw[:i].decode("utf-8", "ignore")) for i in range(len(raw) + 1)]
    size = {i: len(t) for t, i in tool.get_vocab().items()}
    point = []
    for n, c in enumerate(text):
        point += [n] * len(c.encode())
    assert first_point
    for i in got.ids:
        a, b = point[place], point[place + size[i] - 1] + 1
        place += size[i]
        touching = [k for k, (_, x, y) in enumerate(spans) if x < b and a < y]
        own = touching[0] if rule == "first" else touching[-1] if rule == "last" else max(touching, key=lambda k: (min(b, spans[k][2]) - max(a, spans[k][1]), -k))
        counts[own] += 1
        crossing[own] += len(touching) > 1
    return [(doc_id, k, n, a, b, counts[k], crossing[k], len(got.ids)) for k, (n, a, b) in enumerate(spans)]


@pytest.mark.parametrize("rule", ["most", "first", "last"])
def test_agrees_with_the_whole_encoding(spark, rule):
    rows = [r for r in edge_rows() if r[0] != 6]
    docs = spark.createDataFrame(rows, edges(spark).schema)
    found = sorted((tuple(r) for r in section_tokens(docs, rule=rule).collect()), key=str)
    wanted = sorted((x for i, t, lang, source, *_ in rows for x in expected(i, [("source", source or ""), ("lang", lang or ""), ("text", t or "")], rule)), key=str)
    assert found == wanted


def test_tokens_add_up(spark):
    from pyspark.sql import functions as F

    sums = op6_section_tokens(spark, SMALL).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.first("doc_tokens").alias("m"), F.count("*").alias("s")).collect()
    assert len(sums) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert all(r["n"] == r["m"] for r in sums)
    assert section_tokens(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        section_tokens(empty(spark), rule="any")
