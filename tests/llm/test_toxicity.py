"""op5: the update against a plain loop, held-out quality, odd rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa

from outletiq.llm import common, toxicity
from outletiq.llm.queries import QUERIES


def plain_ftrl(rows):
    z, n = {}, {}
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2

    def weight(i):
        if abs(z.get(i, 0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((b + math.sqrt(n[i])) / a + l2)
    for at, y in rows:
        w = {i: weight(i) for i in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in at:
            sigma = (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / a
            z[i] = z.get(i, 0) + g - sigma * w[i]
            n[i] = n.get(i, 0) + g * g
    return z, n


def test_update_matches_plain_loop():
    rnd = random.Random(1)
    rows = [(sorted({rnd.randrange(30) for _ in range(8)}), rnd.randrange(2)) for _ in range(300)]
    z, n = np.zeros(30), np.zeros(30)
    toxicity.one_pass([(np.array(at), y) for at, y in rows], z, n)
    z2, n2 = plain_ftrl(rows)
    assert np.allclose(z, [z2.get(i, 0) for i in range(30)]) and np.allclose(n, [n2.get(i, 0) for i in range(30)])


def test_calibration_fits_the_labels():
    rnd = np.random.default_rng(0)
    margin = rnd.normal(size=4000)
    label = (rnd.random(4000) < 1 / (1 + np.exp(-(3 * margin - 1)))).astype(int)
    a, b = toxicity.calibrate(margin, label)
    assert abs(a - 3) < 0.4 and abs(b + 1) < 0.2
    assert toxicity.calibrate(margin, np.zeros(4000, int)) == (1.0, 0.0)
    assert toxicity.calibrate(np.zeros(0), np.zeros(0)) == (1.0, 0.0)


def test_features_are_words_pairs_and_skip_pairs():
    doc, at = toxicity.features(pa.array(["a b c d", None, "", "Foo*** foo", "a b"]))
    assert np.bincount(doc, minlength=5).tolist() == [4 + 3 + 2, 0, 0, 2 + 1, 2 + 1]
    foo = at[doc == 3]
    assert foo[0] == foo[1]
    assert set(at[doc == 4].tolist()) < set(at[doc == 0].tolist())


def test_learns_and_handles_odd_rows(spark, make_docs):
    rnd = random.Random(2)
    vocab = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(["vile", "Vile,", "nasty***"])
        rows.append((i, " ".join(words)))
        labels.append((i, None, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "vile " * 40_000), (None, "word1"), (0, rows[0][1])]
    labels += [(1000, 1, None), (1001, 1, 0), (5555, 1, 1)]
    docs = make_docs(rows).withColumn("toxic", toxicity.F.lit(9)).withColumn("score", toxicity.F.lit("x"))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.learn_and_score(docs, table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held) > 100
    by = {r.doc_id: r for r in got}
    assert by[1002].predicted == 1 and by[1001].score == by[1000].score < 0.7
    assert toxicity.learn_and_score(make_docs([]), table).count() == 0
    none = toxicity.learn_and_score(docs, table.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_changes_travel_in_blocks(spark, make_docs, monkeypatch):
    """A round's change is a row per block of coordinates, not a row per coordinate, and is the average of the shards'."""
    rnd = np.random.default_rng(3)
    parts, size = [], 3 << toxicity.BLOCK_BITS
    for _ in range(3):
        z0, n0 = np.zeros(size, np.float32), rnd.random(size).astype(np.float32)
        z, n = z0.copy(), n0.copy()
        at = rnd.choice(size, 500, replace=False)
        z[at], n[at] = rnd.normal(size=500), n0[at] + 1
        parts.append((z - z0, n - n0, toxicity.change_blocks(z0, n0, z, n)))
    together = pa.concat_tables(p[2] for p in parts)
    for k in range(3):
        b = toxicity.sum_blocks(together.filter(pa.compute.equal(together["block"], k))).to_pylist()[0]
        at, z, n = (np.frombuffer(b[c], t) for c, t in (("at", np.int32), ("z", np.float64), ("n", np.float64)))
        assert b["block"] == k and (at >> toxicity.BLOCK_BITS == k).all() and (np.diff(at) > 0).all()
        assert np.allclose(z, sum(p[0] for p in parts)[at]) and np.allclose(n, sum(p[1] for p in parts)[at])
    counts = []

    def counted(df, name):
        out = common.save(df, name)
        if name == "change":
            counts.append(out.count())
        return out

    monkeypatch.setattr(toxicity, "save", counted)
    rows = [(i, " ".join(f"w{rnd.integers(3000)}" for _ in range(40))) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    assert (toxicity.train(make_docs(rows), labels) != 0).any()
    assert len(counts) == toxicity.ROUNDS and max(counts) <= 1 << toxicity.BITS - toxicity.BLOCK_BITS


def test_held_out_precision(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op5_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    flagged = [r for r in got if r.predicted]
    assert flagged and sum(r.toxic for r in flagged) >= 0.8 * len(flagged)
