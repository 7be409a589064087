"""op12: whole query against plain Python, quickselect with ties, odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from outletiq.llm import importance as im
from outletiq.llm.queries import QUERIES

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
BENCH = "item_id long, text string"


def buckets(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def plain(docs, bench, percent=25, least=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text)[1])
    for text in bench:
        t.update(buckets(text)[1])
    big_s, big_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    out, keys = [], []
    for place, (doc_id, text) in enumerate(docs):
        n, b = buckets(text)
        weight = sum(math.floor(1000 * math.log((t[x] + 1) * big_s / ((s[x] + 1) * big_t))) for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(b), weight, score, None])
        if n >= least:
            keys.append((-score, doc_id is None, doc_id or 0, place))
    for rank, key in enumerate(sorted(keys)[:percent * len(keys) // 100], 1):
        out[key[-1]][4] = rank
    return sorted(map(tuple, out), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_plain_python(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    bench = [r.text for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    assert rows_of(QUERIES["op12_importance_resampling"](spark, path)) == plain(docs, bench)


def test_odd_rows(spark, make_docs):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["Alpha", "béta", "x1", "Ünder_score", "日本", "don't", "\x00", "A\tB", "-", "é"])
    docs = [(i, " ".join(word() for _ in range(rnd.choice([0, 1, 5, 19, 25, 60])))) for i in range(150)]
    docs += [(None, None), (None, "one two " * 30), (7, None), (8, ""), (9, "..."), (500, "word " * 400_000)]
    docs += [(900, "same text " * 15)] * 40  # rows that repeat an id tie in everything
    bench = ["x1 béta béta", None, "", "日本 Alpha don't"]
    df = make_docs(docs, 6).withColumn("uid", im.F.lit("mine")).withColumn("bucket", im.F.lit(0))
    target = spark.createDataFrame(list(enumerate(bench)), BENCH)
    assert rows_of(im.resample(df, target)) == plain(docs, bench)
    got = im.drawn(df, target).collect()
    want = [r for r in plain(docs, bench) if r[4] is not None]
    assert sorted((r["rank"], r["row"]["doc_id"], r["row"]["uid"]) for r in got) == sorted((r[4], r[0], "mine") for r in want)
    assert im.resample(df.limit(0), target).count() == 0
    assert rows_of(im.resample(df, target.limit(0))) == plain(docs, [])
    short = make_docs([(1, "a b"), (2, None)])
    assert rows_of(im.resample(short, target)) == plain([(1, "a b"), (2, None)], bench)


def test_features_cross_no_text():
    single, double, off = im.feature_buckets(pa.array(["A b", None, "", "c"]))
    assert off.tolist() == [0, 2, 2, 2, 3]
    crc = lambda s: zlib.crc32(s.encode()) % 10000
    assert single.tolist() == [crc("a"), crc("b"), crc("c")] and double.tolist() == [crc("a b"), -1, -1]
    sliced = pa.array(["zz", "A b", "c"]).slice(1)
    assert im.plain(sliced).to_pylist() == ["a b", "c"]


@pytest.mark.parametrize("pivots", [2, 64])
def test_quickselect_finds_every_place(spark, pivots):
    rnd = random.Random(9)
    rows = [(u, rnd.choice([None, u % 7, u]), rnd.randrange(5)) for u in range(300)]
    df = spark.createDataFrame(rows, "uid long, doc_id long, score long").repartition(5)
    keys = sorted((-s, d is None, d or 0, u) for u, d, s in rows)
    for k in (1, 2, 77, 150, 299, 300):
        assert im.kth_key(df, k, pivots) == keys[k - 1]
    assert im.kth_key(df, 301, pivots) is None
