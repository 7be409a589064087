"""op7: the model against a dictionary implementation, accuracy on held-out rows, odd texts."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from outletiq.llm import lang_id
from outletiq.llm.queries import QUERIES


def brute_probability(texts, order, symbols):
    """P(symbol | context) of interpolated Kneser-Ney over boundary-padded words of one language."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            s = "^" * (order - 1) + w + "^"
            for i in range(order - 1, len(s)):
                for n in range(1, order + 1):
                    counts[n][s[i - n + 1:i + 1]] += 1
    use = [None] * (order + 1)
    use[order] = dict(counts[order])
    for n in range(1, order):
        left = defaultdict(set)
        for g in counts[n + 1]:
            left[g[1:]].add(g[0])
        # '^' ahead of the last symbol is the opening boundary
        use[n] = {g: c if "^" in g[:-1] else len(left[g]) for g, c in counts[n].items()}
    tables = [None]
    for n in range(1, order + 1):
        values = list(use[n].values())
        once, twice = values.count(1), values.count(2)
        d = once / (once + 2 * twice) if once and twice else 0.5
        total, followers = Counter(), Counter()
        for g, c in use[n].items():
            total[g[:-1]] += c
            followers[g[:-1]] += 1
        tables.append((use[n], d, total, followers))

    def p(gram, n=order):
        if n == 0:
            return 1 / symbols
        gram = gram[-n:]
        table, d, total, followers = tables[n]
        lower = p(gram, n - 1)
        if not total[gram[:-1]]:
            return lower
        return max(table.get(gram, 0) - d, 0) / total[gram[:-1]] + d * followers[gram[:-1]] / total[gram[:-1]] * lower
    return p


def test_model_is_kneser_ney():
    texts = {"x": ["abba baab abab", "abc cab", "bab ab"], "y": ["äöß ab! Äö", "zzz ab"]}
    order = 3
    rows = [b for lang, t in texts.items() for b in lang_id._gram_rows(pa.array(t), [lang] * len(t), order)]
    flat = pa.Table.from_batches(rows).group_by(["lang", "n", "gram", "context", "suffix", "opens"]).aggregate(
        [("count", "sum")]).rename_columns(["lang", "n", "gram", "context", "suffix", "opens", "count"])
    model = lang_id.build_model(flat, order)
    assert model.langs == ["x", "y"]
    tests = ["abba", "cc äö", "zab a", "q"]
    entropy, symbols = model.score(pa.array(tests))
    for i, lang in enumerate(model.langs):
        p = brute_probability(texts[lang], order, model.symbols)
        for k, t in enumerate(tests):
            logs = []
            for w in t.split():
                s = "^" * (order - 1) + w + "^"
                logs += [math.log(p(s[j - order + 1:j + 1])) for j in range(order - 1, len(s))]
            assert symbols[k] == len(logs)
            assert math.isclose(entropy[k, i], -sum(logs) / len(logs), rel_tol=1e-4)
    # every context's probabilities add up to one
    p = brute_probability(texts["x"], order, model.symbols)
    seen = set("abc^")
    assert math.isclose(sum(p("^a" + c) for c in seen) + (model.symbols - len(seen)) * p("^a?"), 1, rel_tol=1e-9)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op7_language_id"](spark, sf).join(docs, "doc_id").collect()
    assert len(got) == 1000
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) > 100
    assert sum(r.rejected for r in got) <= 0.01 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark, make_docs):
    english, german = "the thing of her was this and that " * 20, "der schöne Baum über das größere Haus und " * 20
    rows = [(i, english, "en") for i in range(30)] + [(30 + i, german, "de") for i in range(30)]
    model = lang_id.train(make_docs(rows + [(90, None, "en"), (91, "no label", None)]))
    odd = [(100, None), (101, ""), (102, "12 -- !! \u0301 \u0301\u0302"), (103, "THE THING OF HER"), (104, "größere"), (None, english),
           (105, "xqzj kkvw pqfx zzxq " * 50), (106, english * 3000), (107, german), (107, german)]
    docs = make_docs(odd).withColumn("score", lang_id.F.lit("old"))
    got = lang_id.predict(docs, model).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[101].score == 0 and by[102].rejected
    assert [by[i].lang_pred for i in (103, 104, None, 106, 107)] == ["en", "de", "en", "en", "de"]
    assert by[105].rejected and not by[106].rejected and not by[103].rejected
    kept = lang_id.keep_recognised(docs, model)
    assert kept.schema == docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["103", "104", "106", "107", "107", "None"]
    nothing = lang_id.train(make_docs([]))
    assert {(r.lang_pred, r.score, r.rejected) for r in lang_id.predict(docs, nothing).collect()} == {("und", 0.0, True)}
    assert lang_id.predict(make_docs([]), model).count() == 0
    assert not [r for r in lang_id.learn_and_predict(make_docs(rows + [(None, english)])).collect() if r.held_out is None]


def test_left_out_language_beside_a_large_script(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rnd = random.Random(3)
    han = [chr(0x4E00 + i) for i in range(5000)]
    script = [(10_000_000 + i, " ".join("".join(rnd.choices(han, k=6)) for _ in range(40)), "zh") for i in range(150)]
    mixed = [(20_000_000 + r.doc_id, f"{r.text} {''.join(rnd.choices(han, k=3))}", "en")  # letters of another script
             for r in docs.where("lang = 'en'").collect()]
    for extra in ([], script, script + mixed):
        learned = docs.where("lang <> 'es'")
        learned = learned.union(spark.createDataFrame(extra, docs.schema)) if extra else learned
        got = lang_id.predict(docs, lang_id.train(learned)).join(docs.select("doc_id", "lang"), "doc_id").collect()
        strange = [r.rejected for r in got if r.lang == "es"]
        assert sum(strange) >= 0.95 * len(strange) > 90
        assert sum(r.rejected for r in got if r.lang != "es") <= 0.01 * len(got)


def test_sample_is_reached_whatever_the_lengths(spark, make_docs, monkeypatch):
    words = {"en": "the thing of her was this and that", "de": "der schöne baum über das größere haus", "x": "kaku tiri momo",
             "y": "vuvu sasa lelo pirri"}
    rows = [(i * 100 + k, f"{w} " * (40_000 // len(w)), lang) for i, (lang, w) in enumerate(words.items()) for k in range(10)]
    rows += [(1000 + k, f"{words['en']} " * 2, "en") for k in range(100)]  # short ones beside long ones
    rows += [(None, f"{words['x']} {k}", "x") for k in range(100)]
    rows += [(2000 + k, "12 -- " * 9000 + ("nonono rere " * 4 if k == 7 else ""), "rare") for k in range(10)]
    rows += [(3000 + k, "12 -- " * 9000, "none") for k in range(3)]
    learned, build = {}, lang_id.build_model

    def spy(grams, order):
        for r in grams.filter(pa.compute.equal(grams["n"], 1)).group_by("lang").aggregate([("count", "sum")]).to_pylist():
            learned[r["lang"]] = r["count_sum"]
        return build(grams, order)

    monkeypatch.setattr(lang_id, "build_model", spy)
    model = lang_id.train(make_docs(rows), sample_chars=20_000)
    assert model.langs == ["de", "en", "rare", "x", "y"]
    assert all(0.85 * 20_000 < learned[lang] < 1.15 * 20_000 for lang in words) and learned["rare"] == 48
    tests = [(i, w, None) for i, w in enumerate([*words.values(), "rere nonono"])]
    assert [r.lang_pred for r in lang_id.predict(make_docs(tests), model).orderBy("doc_id").collect()] == [*words, "rare"]


def test_pieces_make_up_the_text_and_cut_no_word():
    rnd = random.Random(9)
    for text in ["", "ab", "größe und so " * 90, "x" * 3000, "a" * 700 + " " + "äb c" * 200 + "z" * 400,
                 "".join(rnd.choices("ab \u0301ß.\n漢", k=2000))]:
        for size in (1, 7, 100, 1000):
            cuts = [lang_id._cut(text, k * size) for k in range(len(text) // size + 2)]
            assert cuts == sorted(cuts) and cuts[0] == 0 and cuts[-1] == len(text)
            pieces = [text[a:z] for a, z in zip(cuts, cuts[1:])]
            assert "".join(pieces) == text
            if "x" * 300 not in text and "a" * 300 not in text:
                assert [w for p in pieces for w in re.findall(r"[^\W\d_]+", p)] == re.findall(r"[^\W\d_]+", text)


def test_rows_of_missing_keys():
    got = lang_id._rows(np.array([3, 5], np.uint64), np.array([[1.0], [2.0]], np.float32), np.array([5, 4, 9], np.uint64), 0)
    assert got.ravel().tolist() == [2, 0, 0]
