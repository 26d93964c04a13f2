"""Recall of the registered index queries on the embeddings table."""

import pytest

from knnspark import queries
from knnspark.operators.exact import brute_force
from knnspark.operators.index import VectorIndex

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["ann_query_l2", "ann_query_cosine", "ann_query_sharded", "ann_store_load"])
def test_recall(spark, name, monkeypatch):
    built, build = [], VectorIndex.build

    def spy(self, *args, **options):
        out = build(self, *args, **options)
        built.append(args[2] if len(args) > 2 else options.get("refinement_iterations", "default"))
        return out

    monkeypatch.setattr(VectorIndex, "build", spy)
    best, truth = {}, {}
    for r in queries.QUERIES[name](spark, SF_DIR).collect():
        best.setdefault(r["q_id"], set()).add((r["dist"], r["vec_id"]))
    b = queries.base(spark, SF_DIR)
    for r in brute_force(b, queries.asked(b), queries.K, "cosine" if "cosine" in name else "euclidean").collect():
        truth.setdefault(r["q_id"], set()).add(r["vec_id"])
    found = sum(len({v for _, v in sorted(best.get(q, ()))[: queries.K]} & t) for q, t in truth.items())
    assert found >= 0.9 * sum(map(len, truth.values()))
    assert built == ["default"]
