"""Token ids as length-delimited binary records with an offset index.

A record file is a run of frames::

    uint64  payload length            uint32  masked CRC-32 of those 8 bytes
    bytes   payload                   uint32  masked CRC-32 of the payload

all little-endian; a masked checksum is the CRC rotated right by 15 bits plus
0xa282ead8. A payload is ``int64 doc_id, uint8 flags (1: doc_id is null),
uint8 bytes per id, ids``. The index is a Parquet table with one row per record
(file, offset, length ...), so a shuffled read seeks straight to its records.

Files are written through ``pyarrow.fs`` to the shared folder under names that
are unique per task attempt. Only the files that the index names belong to the
data set, so a task that is lost and run again leaves no double records.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outletiq.llm.bpe import encoder
from outletiq.llm.common import new_path, pick, save, slices

MASK = 0xA282EAD8
MOST_READERS = 20_000
HEAD, BODY = "<QI", "<qBB"  # length and its checksum; doc_id, flags, bytes per id
INDEX = ("part int, seq int, row int, file string, offset long, length long, doc_id long, "
         "start_in_file long, n_tokens long")
RECORD = "part int, seq int, file string, row int, doc_id long, start_in_file long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def read_frame(f) -> bytes | None:
    """The next payload, None at the end; a damaged frame raises."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack(HEAD, head)[1]:
        raise ValueError("damaged record length")
    n = struct.unpack(HEAD, head)[0]
    rest = f.read(n + 4)
    if len(rest) < n + 4 or masked(rest[:n]) != struct.unpack("<I", rest[n:])[0]:
        raise ValueError("damaged record payload")
    return rest[:n]


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags, width = struct.unpack_from(BODY, payload)
    return (None if flags & 1 else doc_id), np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(BODY))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that the cluster gives it: without one, that of its default file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _store(uri: str):
    """File system and path of a qualified folder, on the driver and in tasks alike."""
    from pyarrow.fs import FileSystem

    if uri.startswith("file:"):
        uri = "file://" + uri[5:].removeprefix("//")
    return FileSystem.from_uri(uri)


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, *, id_col: str = "doc_id",
                  text_col: str = "text", file_bytes: int = 64 << 20) -> DataFrame:
    """Encode every text and write one record per row, in ascending ``id_col`` order; returns the index.

    Rows are range-partitioned by id and their place in the input, so file order
    is id order at any size and no id, however many rows it has, fills one task.
    A null text is empty (its record holds the end id only); a null id sorts
    first; rows with equal ids stay in the order in which they are read. Other input columns are ignored. An empty table gives an empty index.
    """
    path = qualified(docs.sparkSession, path)
    data = f"{path}/data"
    fs, root = _store(path)
    fs.create_dir(f"{root}/data", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (fs, root) = encoder(tokenizer), _store(data)
        part, attempt, seq = TaskContext.get().partitionId(), uuid.uuid4().hex[:8], 0
        out, name, at, row, start = None, "", 0, 0, 0
        for big in batches:
            for batch in slices(big, "text"):
                ids, off = enc.encode(batch.column("text"))
                rows = []
                for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    if out is None:
                        name = f"part-{part:06d}-{seq:04d}-{attempt}.rec"
                        out, at, row, start = fs.open_output_stream(f"{root}/{name}"), 0, 0, 0
                    own = np.append(ids[off[i]:off[i + 1]], enc.dtype.type(end_id))
                    f = frame(struct.pack(BODY, doc_id or 0, doc_id is None, enc.dtype.itemsize) + own.tobytes())
                    out.write(f)
                    rows.append((part, seq, row, name, at, len(f), doc_id, start, len(own)))
                    at, row, start = at + len(f), row + 1, start + len(own)
                    if at >= file_bytes:
                        out.close()
                        out, seq = None, seq + 1
                yield _rows(rows, INDEX_TYPES)
        if out is not None:
            out.close()

    keys = ["doc_id", "place"]
    ordered = (pick(docs, doc_id=id_col, text=text_col).withColumn("place", F.monotonically_increasing_id())
               .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("place"))
    return save(ordered.mapInArrow(write, INDEX), "index", f"{path}/index")


def read_records(spark: SparkSession, path: str, shuffle_seed: int | None = None) -> DataFrame:
    """One row per record of the files that the index names, every checksum verified.

    Whole files are read in sequence, one file after another; with
    ``shuffle_seed`` records are dealt out in a random order that depends on the
    seed only, and each task seeks to its own through the index.
    """
    index = spark.read.parquet(f"{path}/index")
    return _read(index, path, shuffle_seed).drop("ids")


def read_token_ids(spark: SparkSession, path: str, shuffle_seed: int | None = None) -> DataFrame:
    """As ``read_records``, with the ids themselves."""
    return _read(spark.read.parquet(f"{path}/index"), path, shuffle_seed, True)


def _read(index: DataFrame, path: str, shuffle_seed: int | None, with_ids: bool = False) -> DataFrame:
    data = f"{qualified(index.sparkSession, path)}/data"

    def record(payload: bytes, *at) -> tuple:
        doc_id, ids = unpack(payload)
        ids = ids.astype("<u4")
        part, seq, file, row, start = at
        return (part, seq, file, row, doc_id, start, len(ids), zlib.crc32(ids.tobytes()),
                *([ids.astype(np.int32)] if with_ids else []))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(data)
        for batch in batches:
            for x in batch.to_pylist():
                with fs.open_input_stream(f"{root}/{x['file']}", buffer_size=1 << 20) as f:
                    rows, row, start = [], 0, 0
                    while (payload := read_frame(f)) is not None:
                        rows.append(record(payload, x["part"], x["seq"], x["file"], row, start))
                        row, start = row + 1, start + rows[-1][6]
                        if len(rows) >= 512:
                            yield _rows(rows, types)
                            rows = []
                    if row != x["n"]:
                        raise ValueError(f"{x['file']} has {row} records, its index {x['n']}")
                    yield _rows(rows, types)

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        fs, root = _store(data)
        name, f = None, None
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if x["file"] != name:
                    if f is not None:
                        f.close()
                    name, f = x["file"], fs.open_input_file(f"{root}/{x['file']}")
                payload = read_frame(io.BytesIO(f.read_at(x["length"], x["offset"])))
                rows.append(record(payload, x["part"], x["seq"], name, x["row"], x["start_in_file"]))
            yield _rows(rows, types)
        if f is not None:
            f.close()

    schema, types = RECORD, RECORD_TYPES
    if with_ids:
        schema, types = f"{RECORD}, ids array<int>", [*RECORD_TYPES, ("ids", pa.list_(pa.int32()))]
    if shuffle_seed is None:
        files = index.groupBy("part", "seq", "file").agg(F.count("*").alias("n"))
        tasks = min(max(1, files.count()), MOST_READERS)  # a stated number: small rows that stand for large files
        return files.repartition(tasks, "file").mapInArrow(whole, schema)
    dealt = (index.withColumn("at", F.xxhash64(F.lit(shuffle_seed), "file", "row"))
             .repartitionByRange("at").sortWithinPartitions("at").drop("at"))
    return dealt.mapInArrow(seek, schema)


def _rows(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, types)],
                                      names=[n for n, _ in types])


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
INDEX_TYPES = [(n, _ARROW[t]) for n, t in (x.split() for x in INDEX.split(", "))]
RECORD_TYPES = [(n, _ARROW[t]) for n, t in (x.split() for x in RECORD.split(", "))]


def with_starts(records: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``start``: tokens of all records before this one.

    Running sums within a file come with the record; only one row per file
    (64 MB of data) goes through the single ordered window.
    """
    files = index.groupBy("part", "seq", "file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return records.join(base, "file").withColumn("start", F.col("base") + F.col("start_in_file"))


def token_records(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write all documents as records and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = new_path(spark, "records")
    index = write_records(docs, path, tokenizer, end_id)
    return with_starts(read_records(spark, path), index).select("doc_id", "start", "n_tokens", "ids_crc32")
