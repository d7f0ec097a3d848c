from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

from sediment.catalog import QUERIES
from sediment.operators import senses as S

FOLDER = "/root/testdata/sf0.001"


def groups(seed: int, k: int, each: int, spread: float, width: int = 8):
    r = np.random.default_rng(seed)
    centres = np.linalg.qr(r.normal(size=(width, width)))[0][:k]
    rows = [(g * each + i, (centres[g] * r.uniform(0.2, 5) + spread * r.normal(size=width)).tolist(), g) for g in range(k) for i in range(each)]
    return rows


def test_planted_directions(spark):
    rows = groups(1, 4, 60, 0.02)
    found = {r["id"]: r["cluster"] for r in S.spherical_kmeans(spark.createDataFrame([r[:2] for r in rows], "id long, vector array<double>").repartition(5), 4, restarts=8).collect()}
    met = Counter((g, found[i]) for i, _, g in rows)
    assert len(met) == 4 and set(met.values()) == {60}


def test_small_groups_are_dropped_and_edges(spark):
    rows = [(i, [1.0, 0.01 * i]) for i in range(20)] + [(100 + i, [0.01 * i, 1.0]) for i in range(10)] + [(200, [-1.0, -1.0])]
    rows += [(300, None), (301, [0.0, 0.0]), (302, [float("nan"), 1.0]), (303, [None, 1.0]), (0, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "id long, vector array<double>")
    for least, clusters in ((1, {0: 21, 1: 10, 2: 1}), (2, {0: 21, 1: 10 + 1}), (1000, {0: 32})):
        found = S.spherical_kmeans(table, 3, restarts=6, least=least).collect()
        assert len(found) == len(rows) and {r["id"] for r in found if r["cluster"] is None} == {300, 301, 302, 303}
        sizes = Counter(r["cluster"] for r in found if r["cluster"] is not None)
        assert sizes == clusters or (least == 2 and sum(sizes.values()) == 32 and len(sizes) == 2)
    assert S.spherical_kmeans(table.limit(0), 3).collect() == []
    assert [r["cluster"] for r in S.spherical_kmeans(table.where("id = 300"), 3).collect()] == [None]
    few = S.spherical_kmeans(table.where("id in (1, 101)"), 5).collect()
    assert {r["cluster"] for r in few} == {0, 1}


def test_no_vector_is_nearer_to_another_mean(spark):
    """What k-means ends in: every vector is with the direction of the sum it is nearest to."""
    found = QUERIES["vectors_by_direction"].run(spark, FOLDER).collect()
    of = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    assert len(found) == len(of)
    held = defaultdict(list)
    for r in found:
        held[r["cluster"]].append(of[r["vec_id"]] / np.linalg.norm(of[r["vec_id"]]))
    sums = np.stack([np.sum(held[c], axis=0) for c in sorted(held)])
    centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    for c in held:
        like = np.stack(held[c]) @ centres.T
        assert (like.argmax(1) == sorted(held).index(c)).mean() > 0.98
    assert [len(held[c]) for c in sorted(held)] == sorted((len(v) for v in held.values()), reverse=True)


def test_shuffles_keep_columns(spark):
    rows = [(i, [float(i), float(i * i), 1.0]) for i in range(40)]
    runs = defaultdict(list)
    for r in S.shuffled(spark.createDataFrame(rows, "id long, vector array<double>").repartition(3), 5, 3).collect():
        runs[r["run"]].append(tuple(r["vector"]))
    assert sorted(runs) == list(range(6)) and sorted(runs[0]) == sorted(tuple(v) for _, v in rows)
    for run, vectors in runs.items():
        assert all(sorted(v[f] for v in vectors) == sorted(v[f] for _, v in rows) for f in range(3))
        assert run == 0 or any(v[1] != v[0] ** 2 for v in vectors)


@pytest.mark.parametrize("seed", [1, 2])
def test_layers(spark, seed):
    r = np.random.default_rng(seed)
    planted = [(i, (np.array([3.0, -3.0, 3.0]) * (i % 2) + r.normal(size=3)).tolist()) for i in range(80)]
    found = S.layers(spark.createDataFrame(planted, "id long, vector array<double>"), 2, shuffles=19).first()
    assert found["r2"] > 0.6 and found["p"] == 0.05 and found["null_max"] < found["r2"]
    plain = [(i, r.normal(size=3).tolist()) for i in range(80)]
    assert S.layers(spark.createDataFrame(plain, "id long, vector array<double>"), 2, shuffles=19, seed=seed).first()["p"] > 0.05


def test_layers_without_anything_to_say(spark):
    schema = "id long, vector array<double>"
    assert tuple(S.layers(spark.createDataFrame([], schema), 2).first()) == (0, 2, None, None, None, None)
    assert tuple(S.layers(spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, [None]), (4, None)], schema), 2).first()) == (2, 2, None, None, None, None)
    row = QUERIES["layers_of_suppliers"].run(spark, FOLDER).first()
    assert row["units"] == 10 and 0 < row["p"] <= 1 and 0 < row["r2"] < 1
