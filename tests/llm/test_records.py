"""op1: ids match the tokenizers library, files round-trip, damage is seen."""

from __future__ import annotations

import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from outletiq.llm import records
from outletiq.llm.bpe import BatchEncoder, encoder

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = [None, "", " ", "  a", "a  b   c ", "Hello, World’s  ﬁ\n\n Straße J̌ x<|endoftext|>y <|ENDOFTEXT|> a  b ",
       "İI it's IT'S don't 'sfoo x'sfoo\x0b \x85 q", "J̌ ̈ ̈a K̀", "<|endoftext|> <|startoftext|>x", "a \n b\n \nc\t d", "a. b.\nC, d\n\ne\n", "é é\u2003 x\xa0 y \u3000z \x85q",
       "a<|endoftext|>b. c", "x.y'll 'LL l'", "\n", "a\n", "\na", ".\u0301 a.\u0301"]


def expected(path, texts):
    tk = Tokenizer.from_file(path)
    return [e.ids for e in tk.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_matches_library(path):
    enc = encoder(path)
    for texts in (ODD, [None, None], [], pa.array(ODD, pa.string()).slice(5, 9)):
        ids, off = enc.encode(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == expected(
            path, texts.to_pylist() if isinstance(texts, pa.Array) else texts)
    ids, off = enc.encode(pa.array(ODD, pa.string()))
    tk = Tokenizer.from_file(path)
    assert [d.decode() for d in enc.decode(ids, off)] == [tk.decode(x, skip_special_tokens=False)
                                                          for x in expected(path, ODD)]


class Counting:
    """The library's tokenizer, with the texts that it was given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_pieces_go_to_the_library_in_few_texts():
    enc = BatchEncoder(BYTE)
    enc.tokenizer = Counting(enc.tokenizer)
    words = [f"w{i:x}ord" + "é" * (i % 2) + "." * (i % 3) for i in range(8000)]
    texts = [" ".join(words[i:i + 100]) for i in range(0, 8000, 100)]
    ids, off = enc.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == expected(BYTE, texts)
    assert len(enc.tokenizer.texts) < 200


@pytest.mark.parametrize("seed", range(6))
def test_joined_pieces_have_their_own_ids(seed):
    enc, rnd = BatchEncoder(BYTE), random.Random(seed)
    pieces = ODD[2:] + [" a", " b", ".", "'s", "'", "s", "<", "|x", "|endoftext|>", "\nOne", " é", "é", "\u3000", "\u3000 x", " \u3000", " 1", "23",
                        " ", "\n", " a\x85", "a ", "J̌", " ̈"] + [f" w{i}" for i in range(60)]
    rnd.shuffle(pieces)
    ids, lengths = enc._joined(pieces)
    at = np.cumsum(lengths)
    assert [ids[b - n:b].tolist() for n, b in zip(lengths, at)] == expected(BYTE, pieces)
    enc.widths = enc.widths + 1  # tokens that do not end where the pieces end: encoded one by one
    again = enc._joined(pieces)
    assert again[0].tolist() == ids.tolist() and again[1].tolist() == lengths.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\n\t'sAaé̈.,<|>1\xa0\x85\u2003"), st.characters(codec="utf-8")),
                        max_size=30), min_size=1, max_size=4))
def test_encoder_matches_library_on_any_text(texts):
    for path in (BYTE, WORD):
        ids, off = encoder(path).encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == expected(path, texts)


def test_records_round_trip(spark, make_docs):
    rows = [(5 - i if i != 3 else None, t) for i, t in enumerate(ODD)] + [(7, "word " * 30000), (7, "again"), (7, "again")]
    got = records.token_records(make_docs(rows).withColumn("start", records.F.lit("x")), BYTE, 2).collect()
    one = lambda text: (lambda ids: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))(expected(BYTE, [text])[0] + [2])
    place = lambda d: (d is not None, d or 0)
    assert sorted((place(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((place(d), *one(t)) for d, t in rows)
    at = 0  # in order of ids; rows of one id in any order
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [place(r.doc_id) for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids)
    assert records.token_records(make_docs([]), BYTE, 2).count() == 0


def test_small_files_and_shuffled_read(spark, make_docs):
    rows = [(i, f"text number {i} " * (i % 5)) for i in range(60)]
    path = records.new_path(spark, "records")
    index = records.write_records(make_docs(rows), path, BYTE, 2, file_bytes=300)
    assert index.select("file").distinct().count() > 5
    plain = records.with_starts(records.read_records(spark, path), index).orderBy("start").collect()
    assert [r.doc_id for r in plain] == list(range(60))
    a, b, c = (records.read_token_ids(spark, path, s).collect() for s in (1, 1, 2))
    assert [r.doc_id for r in a] == [r.doc_id for r in b] != [r.doc_id for r in c]
    want = {i: expected(BYTE, [t])[0] + [2] for i, t in rows}
    assert {r.doc_id: r.ids for r in a} == want


def test_damage_is_noticed():
    good = records.frame(b"payload")
    assert records.read_frame(io.BytesIO(good)) == b"payload"
    for at in (0, 9, 14, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.read_frame(io.BytesIO(bytes(bad)))
    with pytest.raises(ValueError):
        records.read_frame(io.BytesIO(good[:-2]))


def test_a_folder_without_a_scheme_is_the_default_file_systems(spark, tmp_path):
    assert records.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    assert records.qualified(spark, f"file://{tmp_path}/x") == f"file:{tmp_path}/x"
    for uri in (f"file:{tmp_path}", f"file://{tmp_path}"):
        fs, root = records._store(uri)
        assert root == str(tmp_path)
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://shared/")
    conf.set("fs.viewfs.mounttable.shared.link./data", f"file://{tmp_path}")
    try:
        assert records.qualified(spark, "/data/x") == "viewfs://shared/data/x"
    finally:
        conf.set("fs.defaultFS", before)


def test_one_id_is_spread_over_tasks(spark, make_docs):
    rows = [(7, f"text {i}") for i in range(3000)] + [(7, "the same")] * 3000 + [(None, "n")] * 500
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = records.new_path(spark, "spread")
        index = records.write_records(make_docs(rows, 8), path, BYTE, 2)
        sizes = [r["count"] for r in index.groupBy("part").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 6500 and len(sizes) >= 6 and max(sizes) < 2500
