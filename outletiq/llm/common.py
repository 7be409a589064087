"""Helpers shared by the operators: shared scratch tables, word splitting, hashing.

Every operator writes its intermediate tables under the cluster's shared
``spark.checkpoint.dir``. A written table cuts lineage: a lost executor later on
costs a re-read, never a rerun of the steps before it.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outletiq.session import shared_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Java pattern of the whitespace that separates words: space and 0x09-0x0D.
SPACE = "[\\x20\\x09-\\x0D]+"
M64 = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """Within this block Spark deletes the shuffle files of each query when it has
    ended, and hands texts to Python in batches of 2,000 rows and about 16 MB at most."""
    before = {CLEANUP: spark.conf.get(CLEANUP, "false"), BATCH: spark.conf.get(BATCH, "10000"),
              BATCH_BYTES: spark.conf.get(BATCH_BYTES)}
    rows = int(before[BATCH])
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, str(min(rows, 2000) if rows > 0 else 2000))
    spark.conf.set(BATCH_BYTES, str(16 << 20))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def save(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with _settings(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``save`` that no later step reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._llm_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator reads, under the names it uses inside.

    Selecting first keeps other columns of the input, whatever their names,
    from clashing with columns that the operator adds.
    """
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in columns.items()])


def words(c: Column) -> Column:
    """Array of words ``[^\\x20\\x09-\\x0D]+``; empty for null or blank text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of many texts at once: the flat word array and each text's offsets into it."""
    texts = texts.cast(pa.large_string()).fill_null("")
    lists = pc.ascii_split_whitespace(texts)
    flat, off = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    off = off - off[0]
    keep = pc.not_equal(flat, "")  # leading and trailing whitespace leaves empty parts
    if not pc.all(keep).as_py() and len(flat):
        kept = np.concatenate([[0], np.cumsum(np.asarray(keep))])
        flat, off = flat.filter(keep), kept[off]
    return flat, off


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_codes(flat: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit hash of each word; every distinct word of the batch is hashed once."""
    import xxhash

    if not len(flat):
        return np.zeros(0, np.uint64)
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    h = xxhash.xxh64_intdigest
    table = np.fromiter((h(w, seed) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()),
                        np.uint64, len(coded.dictionary))
    return table[np.asarray(coded.indices)]


def gram_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` consecutive codes that start at each position (positions past the end are left out)."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i:i + m]
        h ^= h >> np.uint64(29)
    return mix(h)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``concatenate([arange(s, s + n) for s, n in zip(starts, lengths)])`` without a loop."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def give_back() -> None:
    """Return freed memory to the system: a worker is reused, and what it merely keeps counts as its executor's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, column: str | int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most about ``most_bytes`` of text each, whatever the lengths of its rows."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
            give_back()
