"""The pipeline's stages against a brute-force version on a small fixture, and odd inputs."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from outletiq.llm.queries import PACK_TOKENS, WORD_BPE, tokenizer_file
from tests.llm.test_simhash import brute_components, brute_fingerprint


def fixture_rows():
    rnd = random.Random(12)
    english = ["the", "thing", "other", "and", "with", "house", "water", "again", "morning", "letter"]
    german = ["der", "schöne", "über", "größe", "und", "nicht", "fenster", "straße", "zwischen", "wasser"]
    rows = []
    for i in range(120):
        lang, vocab = ("en", english) if i % 3 else ("de", german)
        lines = [" ".join(rnd.choice(vocab) + rnd.choice(["", "s", "er", "en"]) for _ in range(12)) for _ in range(8)]
        if i % 2:
            lines.append("copyright of the house")
        rows.append((i, "\n".join(lines), lang, f"src{i % 4}"))
    passage = " ".join(rnd.choice(english) + str(k) for k in range(30))
    rows += [(200 + i, f"{rows[i][1]}\n{passage}", "en" if i % 3 else "de", "src0") for i in range(0, 12, 2)]
    rows += [(300 + i, rows[i][1], rows[i][2], "src1") for i in range(5)]  # exact copies
    return rows


ODD = [(900, None, "en", "src0"), (901, "", "en", None), (902, "123 456", None, "src9")]


def brute_lines(rows):
    totals, pages = Counter(r[3] for r in rows), Counter()
    for _, t, _, s in rows:
        pages.update({(s, x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")} - {(s, "")})
    bad = {k for k, n in pages.items() if n >= 5 and n > 0.05 * totals[k[0]]}
    return [(i, "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\n\x0b\x0c\r")) not in bad), lang, s)
            for i, t, lang, s in rows]


def brute_substrings(rows, k=13):
    first, out = {}, []
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t, _, _ in rows}
    for i, w in split.items():
        for a in range(len(w) - k + 1):
            g = tuple(w[a:a + k])
            first[g] = min(first.get(g, i), i)
    for i, t, lang, s in rows:
        w = split[i]
        gone = {a + x for a in range(len(w) - k + 1) if first[tuple(w[a:a + k])] < i for x in range(k)}
        out.append((i, " ".join(x for a, x in enumerate(w) if a not in gone) if gone else t, lang, s))
    return out


def test_stages_against_brute_force(spark, make_docs):
    rows = fixture_rows()
    docs = make_docs(rows + ODD)
    want = rows
    for name, stage in corpus_pipeline.STAGES:
        if name == "line_dedup":
            want = brute_lines(want)
        elif name == "simhash":
            groups = brute_components([(i, brute_fingerprint(t)) for i, t, _, _ in want], 2)
            want = [r for r, g in zip(want, groups) if r[0] == g]
        elif name == "substring_dedup":
            want = brute_substrings(want)
        out = corpus_pipeline.save(stage(spark, docs, ""), name)
        if name == "best_fit_packing":
            break
        assert out.columns == docs.columns
        assert sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in out.collect()) == sorted(
            (*r, len(r[1])) for r in want)
        docs = out
    assert len(want) < len(rows)
    from tokenizers import Tokenizer
    tk = Tokenizer.from_file(tokenizer_file(WORD_BPE))
    tokens, fill = Counter(), defaultdict(int)
    for r in out.collect():
        tokens[r.doc_id] += r.length
        fill[r.sequence_id] += r.length
    assert tokens == {i: len(tk.encode(t, add_special_tokens=False).ids) + 1 for i, t, _, _ in want}
    assert max(fill.values()) <= PACK_TOKENS and len(fill) <= -(-sum(tokens.values()) // PACK_TOKENS) + 1


def test_empty_table(spark, make_docs):
    docs = make_docs([])
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.save(stage(spark, docs, ""), name)
        assert docs.count() == 0
