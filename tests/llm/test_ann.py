"""op8: recall against brute force, exact scores and ties, odd vectors."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from outletiq.llm import ann
from outletiq.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_table(spark, sf):
    path = f"/root/testdata/{sf}"
    table = spark.read.parquet(f"{path}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in table]), np.array([r.vec_id for r in table])
    want = ann.exact(x, ids, [i for i in ids.tolist() if i % 50 == 0])
    got = {q: {} for q in want}
    for r in QUERIES["op8_nearest_vectors"](spark, path).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    assert all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({v for v, _ in got[q].values()} & set(want[q])) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    for q, g in got.items():
        a = x[ids == q][0]
        for v, score in g.values():
            b = x[ids == v][0]
            assert math.isclose(score, a @ b / math.sqrt((a @ a) * (b @ b)), rel_tol=1e-12)
        assert [s for _, s in sorted(g.values(), key=lambda t: -t[1])] == [g[i][1] for i in range(1, 6)]


def test_copies_and_ties(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)], 0) for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0], 0) for i in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = ann.search(df, ann.F.col("vec_id").isin(1000, 1003, 4000)).collect()
    nearest = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (1000, 1003, 4000)}
    assert nearest == {1000: [1001, 1002, 1003, 1004, 1005], 1003: [1000, 1001, 1002, 1004, 1005],
                       4000: [1000, 1001, 1002, 1003, 1004]}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0], 1), (50, [0.0, 1.0, 0.0], 1), (1, [2.0, 0.0, 0.0], 1), (2, [1.0, 1.0, 0.0], None),
            (100, None, 1), (150, [0.0, 0.0, 0.0], 1), (200, [1.0, nan, 0.0], 1), (250, [1.0, None, 0.0], 1),
            (3, [inf, 0.0, 0.0], 1), (4, [1.0, 2.0], 1), (300, [2.0, 1.0], 1), (5, [], 1), (None, [1.0, 0.0, 0.0], 1), (2, [1.0, 1.0, 0.0], 7)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("block", ann.F.lit("x")).withColumn("score", ann.F.lit("y"))
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in
                 ann.search(df, ann.F.col("vec_id") % 50 == 0).collect())
    half = round(math.sqrt(0.5), 6)
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, half), (0, 3, 2, half), (0, 4, 50, 0.0),
                   (50, 1, 2, half), (50, 2, 2, half), (50, 3, 0, 0.0), (50, 4, 1, 0.0), (300, 1, 4, 0.8)]
    assert ann.search(df.limit(0), ann.F.col("vec_id") % 50 == 0).count() == 0
    assert ann.search(df.where("vec_id = 1"), ann.F.col("vec_id") == 1).count() == 0


def test_lengths_and_very_large_components(spark):
    rnd = random.Random(6)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(100 + i, [float(i), 1.0]) for i in range(11)]
    rows += [(150, [3.0, 4.0]), (1000, [1e200, 0.0, 0.0, 0.0]), (1001, [3e200, 4e200, 0.0, 0.0]), (1050, [1e-200, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    got = {}
    for r in ann.search(df, ann.F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [0, 50, 100, 150, 1000, 1050] and all(len(g) == 5 for g in got.values())
    assert all(100 <= v <= 150 for q in (100, 150) for _, v, _ in got[q])
    assert sorted(got[1000])[0][1:] == (1050, 1.0) and all(np.isfinite(s) for g in got.values() for *_, s in g)
