"""op13: exact against brute force over many shapes of data, blocks and ties."""

from __future__ import annotations

import random

import numpy as np
import pytest

from outletiq.llm import inner_product as ip
from outletiq.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, is_query, k=5, scale=256):
    fine = [(i, [max(-ip.LIMIT, min(ip.LIMIT, int(np.floor(scale * c)))) for c in v]) for i, v in rows
            if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    asked = {}
    for i, v in fine:
        if is_query(i):
            mine = asked.setdefault((i, len(v)), v)
            asked[i, len(v)] = min(mine, v)
    out = []
    for (q, n), a in asked.items():
        found = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in fine if i != q and len(v) == n)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_against_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    assert rows_of(QUERIES["op13_exact_top_k"](spark, path)) == brute(rows, lambda i: i % 50 == 0)


@pytest.mark.parametrize("shape", ["skewed lengths", "low rank", "ties", "large"])
def test_many_blocks(spark, shape):
    rnd = np.random.default_rng(5)
    x = rnd.standard_normal((900, 12))
    if shape == "skewed lengths":
        x *= np.exp(rnd.standard_normal((900, 1)) * 2)
    if shape == "low rank":
        x = rnd.standard_normal((900, 2)) @ rnd.standard_normal((2, 12)) + 0.01 * x
    if shape == "ties":
        x = np.floor(x) / 64
    if shape == "large":
        x *= 1e6
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = rows_of(ip.search(df, ip.F.col("vec_id") % 20 == 0, block=64, query_part=16))
    assert got == brute([r[:2] for r in rows], lambda i: i % 20 == 0)


def test_copies_and_odd_vectors(spark):
    rnd = random.Random(2)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(40)] + [(1000 + i, [1.0, -1.0, 0.5, 0.0]) for i in range(300)]
    rows += [(50, None), (100, []), (150, [1.0, nan, 0.0, 1.0]), (200, [1.0, None, 0.0, 1.0]), (250, [inf, 0.0, 0.0, 0.0]),
             (None, [1.0] * 4), (300, [0.0] * 4), (350, [1e300, -1e300, 0.0, 1.0]), (7, [0.1, 0.2]), (400, [0.3, -0.2]),
             (400, [0.1, 9.0]), (450, [1.0, 2.0, 3.0]), (0, [0.5, 0.5, 0.5, 0.5]), (0, [0.5, 0.5, 0.5, 0.5])]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)
    df = df.withColumn("block", ip.F.lit("x")).withColumn("norm", ip.F.lit("y"))
    asked = ip.F.col("vec_id") % 50 == 0
    assert rows_of(ip.search(df, asked, block=50)) == brute(rows, lambda i: i % 50 == 0)
    assert rows_of(ip.search(df.limit(0), asked)) == []
    assert rows_of(ip.search(df.where("vec_id = 1"), ip.F.lit(True))) == []


def test_bounds_prune_and_keep_the_best():
    rnd = np.random.default_rng(1)
    ints = np.floor(rnd.standard_normal((2000, 16)) * np.geomspace(400, 2, 16)).astype(np.int32)
    norm = np.sqrt((ints.astype(float) ** 2).sum(axis=1))
    ints = ints[np.argsort(-norm, kind="stable")]
    turn = np.linalg.svd(ints.astype(float), full_matrices=False)[2].T
    q = ints[::100]
    got = ip.search_block(np.arange(2000), ints, ints @ turn, np.arange(len(q)) + 5000, q, q @ turn, np.full(len(q), -np.inf), 5)
    full = q.astype(np.int64) @ ints.T.astype(np.int64)
    for i in range(len(q)):
        want = np.lexsort((np.arange(2000), -full[i]))[:5]
        mine = got[0] == 5000 + i
        assert got[1][mine].tolist() == want.tolist() and got[2][mine].tolist() == full[i][want].tolist()
    # with the fifth best score known, nothing below it comes back
    least = np.sort(full, axis=1)[:, -5].astype(float)
    got = ip.search_block(np.arange(2000), ints, ints @ turn, np.arange(len(q)) + 5000, q, q @ turn, least, 5)
    assert (np.bincount(got[0] - 5000) == 5).all()
