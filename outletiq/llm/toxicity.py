"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, of neighbouring
pairs and of pairs with one word between, in ``1 << BITS`` coordinates. Training
takes a sample of ``SAMPLE_ROWS`` labelled documents at most, dealt to
``SHARDS`` tasks; in every round each task makes one pass from the common state
and the tasks' changes are averaged per coordinate, summed in blocks of
``1 << BLOCK_BITS`` coordinates. L1 leaves few weights; the dense weight array
has a fixed size and is what tasks receive for scoring. Coordinates and changes
travel as the bytes of whole arrays, not as a row or list element each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletiq.llm.common import discard, give_back, mix, pick, save, slices, split_words
from outletiq.llm.lang_id import fold

BITS = 20
BLOCK_BITS = 16
PART_BYTES = 1 << 20  # text that is split into words at once
SAMPLE_ROWS = 16_000
SHARDS, ROUNDS = 4, 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
THRESHOLD = 0.7
BIAS = 0  # this coordinate is in every document
BLOCKS = pa.schema([("block", pa.int32()), ("at", pa.binary()), ("z", pa.binary()), ("n", pa.binary())])


def _word_hash(word: str) -> int:
    """Lower-cased and without characters that are no letter or digit, so decoration does not hide a word."""
    return xxhash.xxh64_intdigest(re.sub(r"[\W_]+", "", word.lower()), 7)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document number, coordinate) of every word, pair and skip pair, with repeats; null has none."""
    flat, off = split_words(texts)
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    coded = flat.dictionary_encode()
    table = np.fromiter(map(_word_hash, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    codes = table[np.asarray(coded.indices)]
    doc = np.repeat(np.arange(len(texts)), np.diff(off))
    docs, grams = [doc], [codes]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xD6E8FEB86659FD93)):
        same = doc[:-gap] == doc[gap:]
        docs.append(doc[:-gap][same])
        grams.append((codes[:-gap] * np.uint64(salt) + codes[gap:])[same])
    at = mix(np.concatenate(grams)) >> np.uint64(64 - BITS)
    return np.concatenate(docs), np.maximum(at, 1).astype(np.int64)  # coordinate 0 is the bias


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that a state stands for; L1 sets those with little evidence to zero."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def one_pass(rows: Iterable[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """FTRL-proximal updates in place, one document after another."""
    for at, label in rows:
        w = weights(z[at], n[at])
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
        n[at] += g * g


def change_blocks(z0: np.ndarray, n0: np.ndarray, z: np.ndarray, n: np.ndarray) -> pa.Table:
    """The changed coordinates and by how much, one row per block: block, at (int32), z and n (float32) as bytes."""
    at = np.flatnonzero((z != z0) | (n != n0)).astype(np.int32)
    cuts = np.searchsorted(at, np.arange((len(z) >> BLOCK_BITS) + 2) << BLOCK_BITS)
    rows = [(k, own.tobytes(), (z[own] - z0[own]).tobytes(), (n[own] - n0[own]).tobytes())
            for k, own in enumerate(at[a:b] for a, b in zip(cuts, cuts[1:])) if len(own)]
    return pa.Table.from_pylist([dict(zip(BLOCKS.names, r)) for r in rows], BLOCKS)


def sum_blocks(table: pa.Table) -> pa.Table:
    """One block's changes of all shards added up: block, at (int32), z and n (float64) as bytes."""
    at = np.frombuffer(b"".join(table.column("at").to_pylist()), np.int32)
    own, place = np.unique(at, return_inverse=True)
    z, n = (np.bincount(place, np.frombuffer(b"".join(table.column(c).to_pylist()), np.float32)) for c in ("z", "n"))
    return pa.table([table.column("block").slice(0, 1), pa.array([own.tobytes()]), pa.array([z.tobytes()]),
                     pa.array([n.tobytes()])], schema=BLOCKS)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """The weight array learned from ``labels`` (doc_id, toxic), null labels and unknown documents left out.

    The sample is the ``sample_rows`` labels with the smallest hash of their id,
    the documents are whole. No usable label gives zero weights.
    """
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic is not null")
    rows = rows.withColumn("order", F.xxhash64(F.lit(11), "doc_id")).orderBy("order", "doc_id", "toxic").limit(sample_rows)
    rows = save(rows, "label-sample")
    picked = pick(docs, doc_id="doc_id", text="text").join(F.broadcast(rows), "doc_id")  # at most sample_rows rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "text", PART_BYTES):
                doc, at = features(b.column("text"))
                pairs = np.unique((doc << BITS) | at)
                cuts = np.searchsorted(pairs >> BITS, np.arange(b.num_rows + 1)).tolist()
                own = (pairs & ((1 << BITS) - 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("order"), b.column("toxic"), pa.array([own[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())],
                    names=["order", "toxic", "at"])

    sample = save(picked.select("text", "toxic", "order").mapInArrow(extract, "order long, toxic int, at binary"),
                  "features")
    dealt = sample.withColumn("shard", F.pmod("order", F.lit(SHARDS)))
    context = docs.sparkSession.sparkContext
    z, n = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    for _ in range(ROUNDS):
        seen = (z != 0) | (n != 0)
        state = context.broadcast((np.packbits(seen), z[seen], n[seen]))  # 1 << BITS numbers at most

        def step(table: pa.Table) -> pa.Table:
            bits, values, squares = state.value
            seen = np.unpackbits(bits).astype(bool)
            z0, n0 = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
            z0[seen], n0[seen] = values, squares
            z, n = z0.copy(), n0.copy()
            one_pass(((np.append(np.frombuffer(at.as_buffer(), np.int32), np.int32(BIAS)), label.as_py())
                      for b in table.select(["order", "at", "toxic"]).sort_by("order").to_batches()
                      for at, label in zip(b.column("at"), b.column("toxic"))), z, n)
            del table
            change = change_blocks(z0, n0, z, n)
            give_back()
            return change

        change = dealt.groupBy("shard").applyInArrow(step, "block int, at binary, z binary, n binary")
        written = save(change.groupBy("block").applyInArrow(sum_blocks, "block int, at binary, z binary, n binary"), "change")
        change = written.toArrow()  # 1 << BITS coordinates at most
        discard(written)
        for b in change.to_batches():
            for at, by, squares in zip(b.column("at"), b.column("z"), b.column("n")):
                own = np.frombuffer(at.as_buffer(), np.int32)
                z[own] += np.frombuffer(by.as_buffer(), np.float64) / SHARDS
                n[own] += np.frombuffer(squares.as_buffer(), np.float64) / SHARDS
        state.destroy()
    w = weights(z, n).astype(np.float32)
    shared = context.broadcast(w)

    def margin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [shared.value[np.frombuffer(at.as_buffer(), np.int32)].sum(dtype=np.float64) for at in b.column("at")]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(np.array(sums, np.float64) + shared.value[BIAS])],
                                             names=["toxic", "margin"])

    judged = sample.select("toxic", "at").mapInArrow(margin, "toxic int, margin double").toArrow()  # sample_rows at most
    a, b = calibrate(np.asarray(judged.column("margin")), np.asarray(judged.column("toxic")))
    shared.destroy()
    discard(rows, sample)
    w *= np.float32(a)
    w[BIAS] += np.float32(b)
    return w


def calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make the sigmoid of the margins fit the labels: the averaged
    weights rank well but stay cautious. Smoothed targets keep a separable sample from
    pushing the slope up without end; a sample of one class is left as it is."""
    ones, zeros = int((label == 1).sum()), int((label == 0).sum())
    if not ones or not zeros:
        return 1.0, 0.0
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method on the log loss, drawn weakly towards slope 1
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        s = p * (1 - p)
        slope = np.array([((p - target) * margin).sum() + 1e-3 * (a - 1), (p - target).sum()])
        curve = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(curve, slope)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (float(a), float(b)) if np.isfinite([a, b]).all() and a > 0 else (1.0, 0.0)


def score(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row from its text alone; a text without words scores by the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for big in batches:
            for b in slices(big, "text", PART_BYTES):
                doc, at = features(b.column("text"))
                matter = w[at] != 0
                pairs = np.unique((doc[matter] << BITS) | at[matter])  # a feature counts once per document
                total = np.bincount(pairs >> BITS, w[pairs & ((1 << BITS) - 1)], b.num_rows) + w[BIAS]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))],
                                                 names=["doc_id", "score"])

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, score double")


def learn_and_score(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Learns from labels outside the held-out fold, scores all rows: doc_id, held_out, score, predicted.

    Repeated rows are scored alike, a row without an id has no label and is not held out, an empty
    table gives none, and other columns of the input are never read.
    """
    w = train(docs, labels.where(fold("doc_id", folds) != held_out))
    return score(docs, w).select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score",
                                 (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
