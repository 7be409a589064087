"""op3 against a brute-force dictionary of windows."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
import pytest

from outletiq.llm import substring_dedup as sd
from outletiq.llm.queries import QUERIES


def brute(rows, k=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for a in range(len(w) - k + 1):
                g = tuple(w[a:a + k])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for a in range(len(w) - k + 1):
                if first[tuple(w[a:a + k])] < i:
                    gone |= set(range(a, a + k))
        kept = " ".join(x for a, x in enumerate(w) if a not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps(spark, make_docs, seed):
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(3 if seed == 2 else 40)]  # a tiny vocabulary repeats everywhere
    pool = [[rnd.choice(vocab) for _ in range(rnd.choice([12, 13, 14, 20, 60]))] for _ in range(12)]
    rows = []
    for i in rnd.sample(range(1000), 90):
        words = []
        for _ in range(rnd.randrange(6)):
            p = rnd.choice(pool)
            a = rnd.randrange(len(p))
            words += p[a:] if rnd.random() < 0.5 else p
            words += [f"own{rnd.randrange(10 ** 6)}" for _ in range(rnd.randrange(4))]
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(words)))
    assert rows_of(sd.summary(make_docs(rows))) == brute(rows)


def test_odd_rows(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, None), (6, ""), (7, "a b c"), (None, long), (10, long), (11, long), (9, "x " * 40), (8, "x " * 25),
            (12, long), (12, long), (3, "start " + long[500:900]), (20, "é ü " * 13), (21, "q é ü é ü é ü é ü é ü é ü é")]
    docs = make_docs(rows).withColumn("start", sd.F.lit("x")).withColumn("n", sd.F.lit(0))
    assert rows_of(sd.summary(docs)) == brute(rows)
    cut = sd.drop_repeats(docs)
    assert cut.schema == docs.schema and cut.count() == len(rows)
    by = {r.doc_id: r.text for r in cut.collect()}
    assert by[10] != by[None] == long and by[11] == by[12] == "" and by[5] is None and by[8] == "x " * 25
    assert sd.summary(make_docs([])).count() == 0


def test_ids_with_several_texts_and_any_column_names(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long), (1, "three short words"), (2, long), (2, "own words " + long[:300]), (2, "three short words"), (3, long)]
    docs = make_docs(rows)
    clash = ("__id", "__spans", "spans", "row", "variant", "many_id", "of_id", "a.b")
    for name in clash:
        docs = docs.withColumn(name, sd.F.lit(name))
    got = rows_of(sd.summary(docs))
    want = {t: r for (i, t), r in zip(sorted(rows), brute_by_row(sorted(rows)))}
    assert got == sorted(brute_by_row(rows), key=str) and want
    cut = sd.drop_repeats(docs)
    assert cut.schema == docs.schema
    cut = cut.collect()
    assert all(r[n] == n for r in cut for n in clash)
    texts = sorted((r.doc_id, r.text) for r in cut)
    assert texts[:2] == [(1, "three short words"), (1, long)] and texts[-1] == (3, "")
    assert texts[2] == (2, "") and texts[4] == (2, "three short words") and texts[3][1].startswith("own words")


def brute_by_row(rows, k=13):
    """As ``brute``, each row of an id on its own."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for a in range(len(w) - k + 1):
            first[tuple(w[a:a + k])] = min(first.get(tuple(w[a:a + k]), i), i)
    out = []
    for i, w in words:
        gone = {a + x for a in range(len(w) - k + 1) if first[tuple(w[a:a + k])] < i for x in range(k)}
        kept = " ".join(x for a, x in enumerate(w) if a not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_a_source_that_very_many_copy(spark, make_docs, monkeypatch):
    monkeypatch.setattr(sd, "ASKED", 20)
    source = [f"w{i}" for i in range(2000)]
    rnd = random.Random(4)
    rows = [(0, " ".join(source))]
    for i in range(1, 200):
        a = rnd.randrange(1900)
        rows.append((i, f"o{i} p{i} " + " ".join(source[a:a + rnd.randrange(13, 60)]) + f" q{i}"))
    assert rows_of(sd.summary(make_docs(rows))) == brute(rows)


def test_other_windows(spark, make_docs):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(40)))) for i in range(40)]
    assert rows_of(sd.summary(make_docs(rows), window=6)) == brute(rows, 6)


def test_paths_cover_all_windows():
    texts = pa.array(["a b c d e f g h i j k l m n o p", None, "one two", " ".join("xy") * 30])
    owner, _, _, start, n = sd.paths_of(texts, 13, 5)
    got = sorted((o, s + i) for o, s, m in zip(owner, start, n) for i in range(m))
    assert got == [(i, a) for i, t in enumerate(texts.to_pylist()) for a in range(len((t or "").split()) - 12)]


def test_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op3_substring_dedup"](spark, sf)) == brute(rows)
