from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

from fixtures import SMALL, edges, empty
from test_jaccard import expected as classes
from test_packing import expected as packed
from test_packing import sizes

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import corpus_pipeline  # noqa: E402

from sediment.llm.decontamination import Index  # noqa: E402
from sediment.llm.mixing import mix_sources  # noqa: E402
from sediment.llm.quality import quality_rules  # noqa: E402


def staged(spark, docs, folder: str, tmp_path) -> list:
    """Rows after every stage, each written and read again."""
    out = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"file://{tmp_path}/{i}")
        docs = spark.read.parquet(f"file://{tmp_path}/{i}")
        out.append(docs)
    return out


def test_every_stage_on_its_own_input(spark, tmp_path):
    start = spark.read.parquet(f"{SMALL}/documents.parquet")
    good, single, clean, mix, files = staged(spark, start, SMALL, tmp_path)
    assert good.columns == single.columns == clean.columns == mix.columns == start.columns
    kept = {r["doc_id"] for r in quality_rules(start).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for *_, c in classes(rows, 5, 80)})
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    import pyarrow as pa

    texts = [(r["doc_id"], r["text"]) for r in single.collect()]
    hit = {texts[h[0]][0] for h in Index(items).search(pa.array([t for _, t in texts]))}
    verbatim = {d for d, t in texts if any(x and x in t for _, x in items)}
    assert verbatim <= hit
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, _ in texts if d not in hit)
    copies = {r["doc_id"]: r["copies"] for r in mix_sources(clean).collect() if r["copies"]}
    taken = mix.collect()
    assert Counter(r["doc_id"] for r in taken) == Counter(copies)
    assert sizes(map(tuple, files.collect())) == sizes(packed([(r["doc_id"], r["text"]) for r in taken]))


def test_run_is_all_stages(spark):
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing", "token files"]


def test_edges(spark, tmp_path):
    assert staged(spark, empty(spark), SMALL, tmp_path)[-1].collect() == []
    last = staged(spark, edges(spark), SMALL, tmp_path / "more")
    assert last[0].columns == edges(spark).columns
