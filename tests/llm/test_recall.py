"""Recall of the forest against brute force on an index of 50,000 vectors, and the share of it looked at."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from larder.llm import neighbours


def test_recall_at_fifty_thousand(spark, tmp_path):
    r = np.random.default_rng(8)
    plain = r.standard_normal((40_000, 64))
    centres = r.standard_normal((500, 64))
    grouped = centres[np.arange(10_000) % 500] + 0.4 * r.standard_normal((10_000, 64))
    x = np.concatenate((plain, grouped)).astype(np.float32)
    x = x[r.permutation(len(x))]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    column = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": column}), tmp_path / "x.parquet", row_group_size=5000)
    vectors = spark.read.parquet(str(tmp_path))
    forest, _ = neighbours.forest_of(neighbours.usable(vectors), 64, 5, "vec_id % 50 = 0")
    looked = forest.ascents.groupBy("asker").agg({"gained": "max"}).toPandas()["max(gained)"]
    in_blocks = forest.blocks_wanted().join(forest.entries, "block").count()
    assert len(looked) == 1000 and looked.max() <= forest.budget
    share = (looked.sum() + in_blocks) / (1000 * len(x))  # entries that several trees give are counted each time
    print("share looked at", share)
    assert share < 0.13
    got = {}
    for row in neighbours.nearest(vectors).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    asked = np.arange(0, len(x), 50)
    assert set(got) == set(asked.tolist())
    hits = 0
    for q in asked.tolist():
        scores = unit @ unit[q]
        scores[q] = -2
        hits += len(set(np.argpartition(-scores, 5)[:5].tolist()) & got[q])
    print("recall", hits / (5 * len(asked)))
    assert hits / (5 * len(asked)) >= 0.9
