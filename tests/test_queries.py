from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from compare import differences

from sediment.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_agrees_with_sql(spark, name):
    query = QUERIES[name]
    assert differences(spark, query.run, query.sql, FOLDER) == []


#: Queries that SQL can't say, and the tests that hold them against plain versions.
ELSEWHERE = {"punctuation_model", "alignment_summary", "variants_of_bases", "neighbour_trees", "trees_compared", "linkage_groups", "lexicon_longest_mentions", "alias_groups", "vectors_by_direction", "layers_of_suppliers"}
HERE = {"receipt_chain", "vector_clusters", "communities", "approximate_counts"}


def test_every_query_has_sql_or_a_test():
    assert {n for n, q in QUERIES.items() if not q.sql} == ELSEWHERE | HERE


def rows(spark, name, table):
    return spark.read.parquet(f"{FOLDER}/{table}.parquet").collect(), QUERIES[name].run(spark, FOLDER).collect()


def test_receipt_chain(spark):
    events, found = rows(spark, "receipt_chain", "events")
    chains = defaultdict(lambda: [0, "0" * 64])
    for e in sorted(events, key=lambda e: (e["ts"], e["event_id"])):
        n, digest = chains[str(e["user_id"])]
        chains[str(e["user_id"])] = [n + 1, hashlib.sha256((digest + f"{e['event_id']}|{e['event_type']}").encode()).hexdigest()]
    assert {r[0]: [r[1], r[2]] for r in found} == dict(chains)


def test_vector_clusters(spark):
    vectors, found = rows(spark, "vector_clusters", "embeddings")
    of = {v["vec_id"]: np.array(v["embedding"], float) for v in vectors}
    assert {r["vec_id"] for r in found} == set(of) and len({r["cluster"] for r in found}) == 8
    means = np.stack([np.mean([of[r["vec_id"]] for r in found if r["cluster"] == c], axis=0) for c in range(8)])
    own = sum(((of[r["vec_id"]] - means) ** 2).sum(1).argmin() == r["cluster"] for r in found)
    assert own >= 0.95 * len(found)  # k-means may end by its number of rounds


def test_communities(spark):
    from sediment.operators import baskets
    from sediment.queries.baskets import brands

    edges = [(r["a"], r["b"], r["k"]) for r in baskets.pair_table(brands(spark, FOLDER)).where("lift > 1").collect()]
    near = defaultdict(list)
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    label = {n: n for n in near}
    for _ in range(5):
        votes = {n: defaultdict(int) for n in near}
        for n in near:
            for m, w in near[n]:
                votes[n][label[m]] += w
        label = {n: min(v, key=lambda x: (-v[x], x)) for n, v in votes.items()}
    assert {r["id"]: r["label"] for r in QUERIES["communities"].run(spark, FOLDER).collect()} == label


def test_approximate_counts(spark):
    lines, found = rows(spark, "approximate_counts", "lineitem")
    for r in found:
        some = [x for x in lines if x["l_returnflag"] == r["l_returnflag"]]
        exact = len({x["l_partkey"] for x in some})
        assert abs(r["parts"] - exact) <= 0.1 * exact
        below = sum(x["l_quantity"] <= r["median"] for x in some) / len(some)
        assert 0.45 <= below <= 0.58
