"""op9: every piece is placed once, sequences are gapless, counts near the lower bound, steps by brute force."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from outletiq.llm import packing

WORD = P.path("word_bpe_49k.json")


def fills(bins, lengths):
    return [sum(lengths[i] for i in b) for b in bins]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(40, 60))
def test_search_keeps_items_and_never_gets_worse(lengths, capacity):
    first = packing.best_fit(lengths, capacity)
    square = sum(f * f for f in fills(first, lengths))
    last = packing.local_search([list(b) for b in first], lengths, capacity)
    assert sorted(i for b in last for i in b) == list(range(len(lengths)))
    assert all(0 < f <= capacity for f in fills(last, lengths))
    assert len(last) <= len(first) and sum(f * f for f in fills(last, lengths)) >= square


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=5), st.lists(st.integers(1, 20), min_size=1, max_size=5))
def test_best_step_is_the_best_of_all_steps(a, b):
    lengths, capacity = a + b, 60
    ia, ib = list(range(len(a))), list(range(len(a), len(lengths)))
    fa, fb = sum(a), sum(b)
    if not (fb <= fa < capacity):
        return
    best = 0
    for out in [(), *((i,) for i in ia), *combinations(ia, 2)]:
        for back in [*((j,) for j in ib), *(combinations(ib, 2) if len(out) < 2 else ())]:
            d = sum(lengths[j] for j in back) - sum(lengths[i] for i in out)
            if 0 < d <= capacity - fa and (fa + d) ** 2 + (fb - d) ** 2 > fa * fa + fb * fb:
                best = max(best, d)
    under = packing._Underfull([ia, ib], lengths)
    under.add(1)
    step = packing._step(0, under, capacity - fa)
    assert (step[0] if step else 0) == best
    if step:
        d, out, b, back = step
        assert b == 1 and d == sum(lengths[j] for j in back) - sum(lengths[i] for i in out)
        assert set(out) <= set(ia) and set(back) <= set(ib)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=60), st.integers(30, 50))
def test_search_ends_where_no_step_is_left(lengths, capacity):
    last = packing.local_search(packing.best_fit(lengths, capacity), lengths, capacity)
    fill = fills(last, lengths)
    assert sum(f <= capacity // 2 for f in fill) <= 1
    for a, fa in zip(last, fill):
        for b, fb in zip(last, fill):
            if a is b or not fb <= fa < capacity:
                continue
            for out in [(), *((i,) for i in a), *combinations(a, 2)]:
                for back in [*((j,) for j in b), *(combinations(b, 2) if len(out) < 2 else ())]:
                    d = sum(lengths[j] for j in back) - sum(lengths[i] for i in out)
                    assert not 0 < d <= capacity - fa


def test_lengths_that_best_fit_packs_badly():
    rnd = random.Random(1)
    lengths = [rnd.randint(500, 900) for _ in range(6000)]
    first = packing.best_fit(lengths, 2048)
    last = packing.pack(lengths, 2048)
    assert len(first) > 2290 and len(last) <= 2175  # a search cut to 64 partners and 8 passes ends at 2183


def test_bins_of_very_many_items():
    rnd = random.Random(3)
    lengths = [rnd.randint(1, 40) for _ in range(3000)] + [2030] * 20
    last = packing.pack(lengths, 2048)
    assert len(last) <= -(-sum(lengths) // 2048) + 1 and sorted(i for b in last for i in b) == list(range(3020))


def test_swaps_empty_a_bin():
    # two thirds-full bins and a small one: only exchanges make room for its item
    bins = [[0, 1], [2, 3], [4]]
    lengths = [6, 2, 5, 3, 3]
    out = packing.local_search(bins, lengths, 10)
    assert len(out) == 2 and sorted(i for b in out for i in b) == [0, 1, 2, 3, 4]


def test_documents(spark, make_docs):
    tk = Tokenizer.from_file(WORD)
    rows = [(i, f"word{i} " * (i % 37)) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "long text " * 3000), (None, "no id"), (203, "twice"), (203, "twice")]
    docs = make_docs(rows).withColumn("length", packing.F.lit("x")).withColumn("group", packing.F.lit("y"))
    got = packing.pack_documents(docs, WORD, 0, 64).collect()
    ids = {(d, t): [*tk.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows}
    want = sorted((d is not None, d or 0, a // 64, a, len(ids[d, t][a:a + 64]),
                   zlib.crc32(np.array(ids[d, t][a:a + 64], "<u4").tobytes()))
                  for d, t in rows for a in range(0, len(ids[d, t]), 64))
    assert want == sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= -(-sum(r.length for r in got) // 64) + 2
    assert packing.pack_documents(make_docs([]), WORD).count() == 0


def test_groups(spark):
    pieces = spark.range(1000).selectExpr("id as uid", "id as doc_id", "0 as piece", "id % 97 + 1 as length")
    got = packing.pack_pieces(pieces, 128, group_rows=100)
    total = pieces.agg({"length": "sum"}).first()[0]
    assert got.count() == 1000
    fill = got.groupBy("sequence_id").agg(packing.F.sum("length").alias("n")).collect()
    assert len(fill) <= -(-total // 128) + 2  # the groups' leftovers share their bins
    assert sum(r.n <= 64 for r in fill) <= 1
    small = spark.range(3000).selectExpr("id as uid", "id as doc_id", "0 as piece", "1L as length")
    assert packing.pack_pieces(small, 2048, group_rows=100).select("sequence_id").distinct().count() == 2
