"""op4 against the tokenizers library, text by text."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from outletiq.llm import chunk_bpe
from outletiq.llm.bpe import encoder
from outletiq.llm.queries import QUERIES

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def brute(rows, path):
    tk = Tokenizer.from_file(path)
    out = []
    for i, t in rows:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        text = tk.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()), key=str)


def make_texts(seed):
    rnd = random.Random(seed)
    vocab = ["the", "Straße", "naïve", "x1", "école", "☃☃", "It's", "<|endoftext|>", "end.", "longer" * 9, "　", "a\x85b"]
    passages = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(50, 1500))) for _ in range(5)]
    passages.append("".join(rnd.choice("abcdé☃") for _ in range(9000)))  # no white space at all
    texts = []
    for _ in range(50):
        parts = [rnd.choice(passages)[rnd.randrange(40):] for _ in range(rnd.randrange(4))]
        texts.append(rnd.choice([" ", "", "\n"]).join([f"own{rnd.random()}", *parts, rnd.choice(["", "tail"])]))
    return texts


def test_cuts_follow_the_content():
    texts = [t.encode() for t in make_texts(1)]
    alone = [chunk_bpe.cut([t])[0] for t in texts]
    assert chunk_bpe.cut(texts) == alone  # neighbours do not matter
    for t, ends in zip(texts, alone):
        assert ends[-1] == len(t) and all(a < b for a, b in zip(ends, ends[1:]))
        assert all(b - a <= chunk_bpe.MOST + 3 for a, b in zip([0, *ends], ends))
        for a, b in zip([0, *ends], ends):
            t[a:b].decode()
    assert chunk_bpe.cut([b"", b"ab"]) == [[0], [2]]
    body = texts[0] * 30
    a, b = set(np.array(chunk_bpe.cut([b"some new words before " + body])[0]) - 22), set(chunk_bpe.cut([body])[0])
    assert len(a & b) > 0.5 * len(b)


@pytest.mark.parametrize("path", [WORD])
@pytest.mark.parametrize("seed", range(4))
def test_joins_are_repaired(path, seed, monkeypatch):
    monkeypatch.setattr(chunk_bpe, "LEAST", 34)
    monkeypatch.setattr(chunk_bpe, "MASK_BITS", 3)
    enc, tk, rnd = encoder(path), Tokenizer.from_file(path), random.Random(seed)
    texts = [t.encode()[:2500].decode(errors="ignore").encode() for t in make_texts(seed)] + [b"", b"a" * 900, b"ab " * 300]
    known = []
    for t, ends in zip(texts, chunk_bpe.cut(texts)):
        own = {}
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            if rnd.random() < 0.6:
                ids = tk.encode(t[a:b].decode(), add_special_tokens=False).ids
                own[k] = np.array(ids, enc.dtype).tobytes()
        known.append(own)
    got, again = chunk_bpe.assemble(enc, texts, known)
    assert [g.tolist() for g in got] == [tk.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    assert again <= len(texts) // 4  # repair, not encoding again, is the rule


def test_a_wrong_join_is_noticed():
    enc = encoder(WORD)
    text = ("word " * 400 + "split" * 3 + " more" * 400).encode()
    got, again = chunk_bpe.assemble(enc, [text], [{0: np.array([5, 6, 7], enc.dtype).tobytes()}])
    ends = chunk_bpe.cut([text])[0]
    if text[ends[0] - 1:ends[0]] not in b" " and text[ends[0]:ends[0] + 1] not in b" ":
        assert again == 1 and got[0].tolist() == enc.encode(chunk_bpe._strings([text]))[0].tolist()


def test_documents(spark, make_docs):
    texts = make_texts(7)
    rows = list(enumerate(texts + texts[:10]))
    rows += [(500, None), (501, ""), (None, texts[3]), (502, "word " * 40_000), (503, "word " * 40_000), (504, "twice"),
             (504, "twice"), (505, "same id"), (505, "other text")]
    docs = make_docs(rows).withColumn("tid", chunk_bpe.F.lit(1)).withColumn("k", chunk_bpe.F.lit("x"))
    assert rows_of(chunk_bpe.encode_and_decode(docs, WORD)) == brute(rows, WORD)
    assert chunk_bpe.encode_and_decode(make_docs([]), WORD).count() == 0


def test_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op4_chunk_bpe"](spark, sf)) == brute(rows, WORD)
