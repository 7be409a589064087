"""Importance resampling to a target distribution: array-scored weights, then distributed quickselect.

Word uni- and bigrams fall into ``BUCKETS`` hash buckets. One array of integer
gains, log ratios of the target's and the corpus's smoothed bucket shares, gives
each document the mean gain of its features; Gumbel noise from a hash of the id
turns the weights into keys, whose highest are a draw without replacement.

Counting: each task adds its documents into one array of ``BUCKETS`` counts, so
what is shuffled is a few thousand rows a task. The array of gains (80 KB, whatever
the data) goes to the scoring tasks. The k-th highest key is found by quickselect:
each round draws ``PIVOTS`` random pivot keys from the rows still in question and
counts exactly the rows before, at and after every pivot, which narrows the range
about ``PIVOTS``-fold; no row leaves its place. Winners alone are range-partitioned, sorted and ranked.

Null texts have no words; a null id hashes as an empty one and comes after equal
scores of other ids; rows that repeat an id are rows of their own.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outletiq.llm.common import pick, save, slices, split_words

BUCKETS = 10_000
PIVOTS = 64
#: Bytes of a lower-cased text: A-Z become a-z, other ASCII that is no letter or digit becomes a space.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
               for b in range(256))


def plain(texts: pa.Array) -> pa.Array:
    """Texts of the same byte lengths with words lower-cased and everything between them as spaces."""
    texts = texts.cast(pa.large_string()).fill_null("")
    off = np.asarray(pa.Array.from_buffers(pa.int64(), len(texts) + 1, [None, texts.buffers()[1]], offset=texts.offset))
    data = texts.buffers()[2]
    body = data[int(off[0]):int(off[-1])].to_pybytes().translate(_PLAIN) if data is not None and len(texts) else b""
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(off - off[0]), pa.py_buffer(body)])


def feature_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and of all pairs of neighbours (-1 where a pair would cross texts), and each
    text's offsets into both."""
    flat, off = split_words(plain(texts))
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), off
    coded = flat.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    at = np.asarray(coded.indices).astype(np.int64)
    crc = zlib.crc32
    alone = [crc(w) for w in names]
    opened = [crc(b" ", c) for c in alone]
    single = (np.array(alone, np.int64) % BUCKETS)[at]
    pairs, back = np.unique(at[:-1] * len(names) + at[1:], return_inverse=True)  # each distinct pair is hashed once
    left, right = np.divmod(pairs, len(names))
    hashed = np.fromiter((crc(names[b], opened[a]) for a, b in zip(left.tolist(), right.tolist())), np.int64, len(pairs))
    double = np.append((hashed % BUCKETS)[back], -1)
    ends = off[1:][np.diff(off) > 0] - 1
    double[ends] = -1
    return single, double, off


def bucket_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n) of all features of all texts; one array of counts a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for big in batches:
            for batch in slices(big, "text"):
                single, double, _ = feature_buckets(batch.column("text"))
                total += np.bincount(single, minlength=BUCKETS)
                total += np.bincount(double[double >= 0], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    parts = pick(docs, text=text_col).mapInArrow(run, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """The integer gain of each bucket, from two tables of bucket counts (``BUCKETS`` rows at most)."""
    both = [np.zeros(BUCKETS, np.int64) for _ in range(2)]
    for side, table in zip(both, (corpus, target)):
        for row in table.collect():
            side[row["bucket"]] = row["n"]
    s, t = both
    big_s, big_t = int(s.sum()) + BUCKETS, int(t.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((int(a) + 1) * big_s / ((int(b) + 1) * big_t)))
                     for a, b in zip(t, s)], np.int64)


def noise(doc_id: Column) -> Column:
    """Gumbel noise of an id in thousandths, from the first 8 hex digits of sha256(``7:<id>``)."""
    key = F.concat(F.lit("7:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def score(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          keep_rows: bool = False) -> DataFrame:
    """uid, doc_id, n_words, n_features, weight and score of every row; with ``keep_rows`` also the row as a struct."""
    cols = pick(docs, doc_id=id_col, text=text_col)
    extra = ""
    if keep_rows:
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        cols = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), row.alias("whole"))
        extra = f", whole {cols.schema['whole'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for big in batches:
            for batch in slices(big, "text"):
                single, double, off = feature_buckets(batch.column("text"))
                words = np.diff(off)
                value = np.concatenate([[0], np.cumsum(gain[single] + np.where(double >= 0, gain[double], 0))])
                features = words + np.maximum(words - 1, 0)
                weight = (value[off[1:]] - value[off[:-1]]) // np.maximum(features, 1)
                ids = np.arange(uid, uid + len(words))
                uid += len(words)
                out = [pa.array(ids), batch.column("doc_id"), pa.array(words), pa.array(features), pa.array(weight)]
                if keep_rows:
                    out.append(batch.column("whole"))
                yield pa.RecordBatch.from_arrays(out, names=["uid", "doc_id", "n_words", "n_features", "weight",
                                                             *(["whole"] if keep_rows else [])])

    scored = cols.mapInArrow(run, "uid long, doc_id long, n_words long, n_features long, weight long" + extra)
    return scored.withColumn("score", F.col("weight") + noise(F.col("doc_id")))


def order_key() -> Column:
    """Composite key of a scored row, least first: higher score, smaller id (null last), place."""
    return F.struct((-F.col("score")).alias("a"), F.col("doc_id").isNull().alias("b"),
                    F.coalesce("doc_id", F.lit(0)).cast("long").alias("c"), F.col("uid").alias("d"))


def _literal(key: tuple) -> Column:
    a, b, c, d = key
    return F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).alias("b"), F.lit(c).cast("long").alias("c"),
                    F.lit(d).cast("long").alias("d"))


def kth_key(rows: DataFrame, k: int, pivots: int = PIVOTS, seed: int = 12) -> tuple | None:
    """The ``k``-th least composite key (from 1) of a written table with distinct keys; None where there is none.

    A round reads the rows between the bounds, draws pivots by a hash of their
    place, and counts the rows in front of, at and behind each pivot. The range
    that holds the k-th key is the next round's.
    """
    keys = rows.select(order_key().alias("key"), "uid")
    low = high = None
    for turn in range(10_000):
        inside = keys
        if low is not None:
            inside = inside.where(F.col("key") > _literal(low))
        if high is not None:
            inside = inside.where(F.col("key") < _literal(high))
        drawn = inside.orderBy(F.xxhash64(F.lit(seed + turn), "uid"), "uid").limit(pivots)
        marks = sorted(tuple(r["key"]) for r in drawn.select("key").collect())
        if not marks:
            return None
        ahead = F.lit(0)
        for m in marks:  # twice the number of pivots in front of the key, plus one if the key is a pivot
            ahead = ahead + F.when(F.col("key") > _literal(m), 2).when(F.col("key") == _literal(m), 1).otherwise(0)
        counts = {r["part"]: r["n"] for r in
                  inside.groupBy(ahead.alias("part")).agg(F.count("*").alias("n")).collect()}
        for part in range(2 * len(marks) + 1):
            n = counts.get(part, 0)
            if k > n:
                k -= n
                continue
            if part % 2:  # the k-th key is a pivot
                return marks[part // 2]
            if part:
                low = marks[part // 2 - 1]
            if part < 2 * len(marks):
                high = marks[part // 2]
            break
        else:
            return None
    raise RuntimeError("quickselect did not end")


def ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with their rank in key order: range-partitioned, sorted, and numbered by one sum a partition."""
    dealt = winners.withColumn("__key", order_key()).repartitionByRange("__key").sortWithinPartitions("__key")
    place = F.monotonically_increasing_id()  # partition number and row number within it
    placed = save(dealt.drop("__key").withColumn("__place", place), "winners")
    part = F.shiftright("__place", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
             .select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base")))
    own = placed.withColumn("__part", part).join(parts, "__part")
    rank = F.col("__base") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return own.withColumn("rank", rank.cast("long")).drop("__part", "__base", "__place")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, id_col: str = "doc_id",
             text_col: str = "text", target_text_col: str = "text", keep_rows: bool = False) -> DataFrame:
    """Every row of ``docs`` with n_features, weight, score, and rank (null for rows that are not drawn).

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred
    (rounded down) are drawn. An empty target leaves only the corpus in the weights;
    an empty table gives no rows.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    scored = save(score(docs, gain, id_col, text_col, keep_rows), "scored")
    enough = F.col("n_words") >= least_words
    k = percent * scored.where(enough).count() // 100
    last = kth_key(scored.where(enough), k) if k else None
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return scored.select("*", none)
    won = enough & (order_key() <= _literal(last))
    return scored.where(~won).select("*", none).unionByName(ranked(scored.where(won)))


def drawn(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, id_col: str = "doc_id",
          text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """The drawn rows of ``docs``, all their columns unchanged, as struct ``row`` with weight, score and rank."""
    out = resample(docs, target, percent, least_words, id_col, text_col, target_text_col, keep_rows=True)
    return out.where(F.col("rank").isNotNull()).select(F.col("whole").alias("row"), "weight", "score", "rank")
