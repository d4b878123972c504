"""The vector index against the exact search of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import similarity, vector_index
from lexiloom.plans.queries import vectors_of


@pytest.mark.parametrize(("folder", "kind"), [("sf0.001", None), ("sf0.1", None), ("sf0.1", "tradition")])
def test_recall(spark, folder, kind):
    """At two sizes, and of each tradition; every row is in the index."""
    v = vectors_of(spark, f"/root/testdata/{folder}").persist()
    asked, k = v.filter("verse_id % 20 = 0"), 3 if kind else 20
    index = vector_index.build(v, kind)
    assert index.rows.count() == v.count()
    exact = similarity.search_all(v, asked, k, -1.0, kind).persist()
    probes = index.probes_for(asked, k)
    assert vector_index.recall_of(index.search(asked, k, -1.0, probes), exact, kind) >= 0.9
    assert probes <= len(index.centres)
    every = index.search(asked, k, -1.0, len(index.centres))
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))


def test_odd_vectors(spark, monkeypatch):
    """Nulls, equal vectors in a list that is split, nothing at all, and mixed dimensions."""
    monkeypatch.setattr(vector_index, "PART", 16)
    rng = np.random.default_rng(1)
    rows = [(k, [1.0, 0.0] if k % 3 == 0 else rng.normal(size=2).tolist()) for k in range(300)] + [(None, [1.0, 1.0]), (900, None), (901, [float("nan"), 1.0]), (902, [None, 1.0]), (903, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "verse_id long, vector array<double>")
    index = vector_index.build(v, lists=5)
    asked = v.filter("verse_id % 10 = 0")
    got = index.search(asked, 4, -9.0, 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, similarity.search_all(v, asked, 4, -9.0).collect()))
    nothing = vector_index.build(v.limit(0))
    assert nothing.search(asked.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        vector_index.build(v.unionByName(spark.createDataFrame([(7, [1.0])], v.schema)))


def test_kinds_leave_their_own_out(spark):
    v = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "x", [1.0, 0.1]), (3, "y", [0.9, 0.1]), (4, "z", [0.0, 1.0]), (5, None, [0.5, 0.5])], "verse_id long, tradition string, vector array<double>")
    got = similarity.search_all(v, v.filter(F.col("verse_id") == 1), 1, -1.0, "tradition").select("tradition", "verse_id", "rank").collect()
    assert sorted(map(tuple, got)) == [("", 5, 1), ("y", 3, 1), ("z", 4, 1)]


def test_queries_are_spread_in_pieces():
    """What a task holds of its queries' copies doesn't grow with queries times lists."""
    rng = np.random.default_rng(4)
    asked, centres = pd.DataFrame({"verse_id": range(900), "vector": list(rng.normal(size=(900, 8))), "kind": ""}), rng.normal(size=(300, 8))
    frames = list(vector_index.spread(asked, centres, 200))
    whole = pd.concat(frames)
    assert max(map(len, frames)) <= vector_index.ROWS and len(whole) == 900 * 200
    want = np.argsort(-(np.stack(asked["vector"].to_list()) @ centres.T), axis=1, kind="stable")[:, :200]
    assert (whole["list"].to_numpy().reshape(900, 200) == want).all() and (whole["verse_id"].to_numpy() == np.repeat(np.arange(900), 200)).all()
    assert not list(vector_index.spread(asked[:0], centres, 200))
