"""op2 against brute force over all pairs."""

from __future__ import annotations

import random
import re

import pytest
import xxhash

from outletiq.llm import simhash
from outletiq.llm.components import connected


def brute_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, d):
    """fps: list of (id, fp); the smallest id that each id reaches."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= d:
                parent[find(i)] = find(j)
    least = {}
    for i, (x, _) in enumerate(fps):
        r = find(i)
        if x is not None:
            least[r] = min(least.get(r, x), x)
    return [least.get(find(i)) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("d", [1, 2])
def test_links_connect_as_all_pairs_do(spark, d):
    rnd = random.Random(d)
    centre = rnd.getrandbits(64)
    fps = {0, centre}
    for i in range(12):  # a dense ball: hundreds of numbers that differ in a few low bits
        fps |= {centre ^ (1 << i), centre ^ (1 << i) ^ (1 << rnd.randrange(64)), centre ^ rnd.getrandbits(9)}
    fps |= {centre ^ x for x in range(256)}
    for _ in range(60):
        x = rnd.getrandbits(64)
        fps |= {x, x ^ (1 << rnd.randrange(64)), x ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)),
                x ^ 7 << rnd.randrange(60)}
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    edges = simhash.links(df, d)
    for e in edges.collect():
        assert ((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= d
    roots = {r.node: r.root for r in connected(edges).collect()}
    want = brute_components([(signed(x), x) for x in fps], d)
    assert [roots.get(signed(x), signed(x)) for x in fps] == want


def test_chain_and_star_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (3, 900), (900, 3)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(1000, 1300)} == {1000}
    assert got[3] == got[900] == 3 and 7 not in got
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_against_brute_force(spark, make_docs):
    rnd = random.Random(5)
    vocab = [f"w{i}é" for i in range(300)]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 2, 5, 80, 300]))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40, 160):
        words = rnd.choice(base).split()
        if words and rnd.random() < 0.7:
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        rows.append((i, "\n".join(words).upper() if i % 3 else " ".join(words)))
    rows += [(500, None), (501, " \t\x0b"), (None, None), (600, "A b"), (600, "A b"), (601, "x " * 70_000)]
    docs = make_docs(rows).withColumn("fp", simhash.F.lit("clash"))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.h, r.component_id) for r in
                 simhash.near_duplicates(docs).withColumn("h", simhash.hex_digits()).collect())
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    want = sorted((i if i is not None else -1, f"{fp:016x}", c) for (i, fp), c in zip(fps, brute_components(fps, 2)))
    assert got == want
    kept = simhash.keep_first(docs, 3, 2)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for i, _, c in want if i == c}


def test_first_row_of_each_component_stays(spark, make_docs):
    rnd = random.Random(8)
    a, b, c, e, f, g, h = (" ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(30)) for _ in range(7))
    rows = [(1, a), (None, a), (None, b), (None, c), (None, c), (None, c.upper()), (None, e),
            (7, a), (7, f), (3, f.upper()), (7, g), (8, h), (8, h), (9, h)]
    docs = make_docs(rows).withColumn("fp", simhash.F.lit("clash"))
    kept = simhash.keep_first(docs, 3, 2)
    assert kept.dtypes == docs.dtypes
    got = sorted((r.doc_id or 0, r.text.lower()) for r in kept.collect())
    assert got == sorted([(1, a), (0, b), (0, c), (0, e), (3, f), (7, g), (8, h), (8, h)])
    only = simhash.keep_first(make_docs([(None, a), (None, a), (None, "")]), 3, 2)
    assert sorted(r.text for r in only.collect()) == ["", a]


def test_one_id_names_two_components(spark, make_docs):
    a, b = "one two three four five six", "ten nine eight seven six five"
    got = simhash.keep_first(make_docs([(4, a), (4, b), (5, a), (5, b), (6, b), (6, "else " * 9)]), 3, 2).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(4, a), (4, b), (6, "else " * 9)])


def test_empty_table(spark, make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0
