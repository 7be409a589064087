"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts every text into chunks, so documents that
share a passage share the chunks inside it. Texts are told apart by a 128-bit
digest and equal texts are encoded once. A chunk that occurs more than once in
the distinct texts is encoded once, by the first text that has it; the ids are
joined to the others. Each text is then put together from shared chunks and
from what lies between them, which is encoded in place.

Chunk ends ignore words, so joins are repaired: the word across a join is
encoded again as a whole, and what both sides had for their parts of it is taken
off after checking that it is there exactly. A text with a join that does not
agree is encoded again as a whole.

Texts move between machines compressed, at most twice, and ids only for shared chunks.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletiq.llm.bpe import BatchEncoder, encoder
from outletiq.llm.common import discard, pick, save, slices

LEAST, MOST, MASK_BITS = 256, 8192, 10  # bytes of a chunk; on average LEAST + 1024
REACH = 32  # bytes that the rolling hash sees; less than LEAST, so it never sees another text
SPACES = b" \t\n\x0b\x0c\r"


def _gear() -> np.ndarray:
    return np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)


def candidates(buf: np.ndarray) -> np.ndarray:
    """Places where the rolling hash of the ``REACH`` bytes before is zero in its top bits."""
    h = _gear()[buf]
    width = 1
    while width < REACH:  # hash of twice as many bytes: the older half weighs 2 ** width more
        h[width:] += h[:-width] << np.uint32(width) if len(h) > width else 0
        width *= 2
    return np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1


def cut(texts: list[bytes]) -> list[list[int]]:
    """Chunk ends of each text, always between characters; an empty text has one empty chunk."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    at = candidates(buf.copy()).tolist() if len(buf) else []
    out, start = [], 0
    for t in texts:
        ends, pos, n = [], 0, len(t)
        while n - pos > LEAST:
            i = bisect_left(at, start + pos + LEAST)
            end = min(at[i] - start if i < len(at) else n, pos + MOST, n)
            while end < n and 0x80 <= t[end] < 0xC0:
                end += 1
            ends.append(end)
            pos = end
        if pos < n or not ends:
            ends.append(n)
        out.append(ends)
        start += n
    return out


def _digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


def _binaries(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def _strings(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.large_binary()).cast(pa.large_string())


def _word_start(t: bytes, p: int) -> int:
    return max(t.rfind(bytes([s]), 0, p) for s in SPACES) + 1


def _word_end(t: bytes, p: int) -> int:
    return min((i for i in (t.find(bytes([s]), p) for s in SPACES) if i >= 0), default=len(t))


def assemble(enc: BatchEncoder, texts: list[bytes], known: list[dict[int, bytes]]) -> tuple[list[np.ndarray], int]:
    """Ids of every text; ``known[i]`` has the ids of some of its chunks. Also how many texts had to be encoded again."""
    plans, parts = [], []

    def ask(data: bytes) -> int:
        parts.append(data)
        return len(parts) - 1

    ends = cut(texts)
    for t, own, shared in zip(texts, ends, known):
        segments, start, open_at = [], 0, None  # (start, end, ids or None)
        for k, end in enumerate(own):
            if k in shared:
                if open_at is not None:
                    segments.append((open_at, start, None))
                    open_at = None
                segments.append((start, end, np.frombuffer(shared[k], enc.dtype)))
            elif open_at is None:
                open_at = start
            start = end
        if open_at is not None:
            segments.append((open_at, start, None))
        plan, done = [], 0  # done: end of the last word that was encoded across a join
        for k, (a, b, ids) in enumerate(segments):
            across = k + 1 < len(segments) and t[b - 1] not in SPACES and t[b] not in SPACES
            tail = _word_start(t, b) if across else b
            head = min(max(a, done), b)
            ids = ids if ids is not None else ask(t[a:b])
            inside = tail <= head and (across or head >= b) and (head > a or tail <= a)
            if inside:  # nothing of this segment is left beside words that cross joins
                plan.append((None, None, None))
            else:
                plan.append((ids, ask(t[a:head]) if head > a else None, ask(t[tail:b]) if tail < b else None))
            if across and _word_end(t, b) > done:
                first = max(tail, done)
                done = _word_end(t, b)
                plan.append((ask(t[first:done]), None, None))
        plans.append(plan)
    ids, off = enc.encode(_strings(parts))
    of = lambda i: ids[off[i]:off[i + 1]]
    out, again = [], 0
    for t, plan in zip(texts, plans):
        pieces, agree = [], True
        for body, head, tail in plan:
            if body is None:
                continue
            body = body if isinstance(body, np.ndarray) else of(body)
            h, e = (of(head) if head is not None else body[:0]), (of(tail) if tail is not None else body[:0])
            agree &= (len(h) + len(e) <= len(body) and np.array_equal(body[:len(h)], h)
                      and np.array_equal(body[len(body) - len(e):], e))
            pieces.append(body[len(h):len(body) - len(e)])
        if not agree:
            again += 1
            pieces = [enc.encode(_strings([t]))[0]]
        out.append(np.concatenate([ids[:0], *pieces]))
    return out, again


def _chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk: text digest, doc_id, chunk number, chunk digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "text", 2 << 20):
                texts, rows = _binaries(b.column("text")), ([], [], [], [])
                for doc_id, t, ends in zip(b.column("doc_id").to_pylist(), texts, cut(texts)):
                    tid, a = _digest(t), 0
                    for k, end in enumerate(ends):
                        for column, x in zip(rows, (tid, doc_id, k, _digest(t[a:end]))):
                            column.append(x)
                        a = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(rows, (pa.binary(), pa.int64(), pa.int32(), pa.binary()))],
                    names=["tid", "doc_id", "k", "chunk"])

    return docs.mapInArrow(run, "tid binary, doc_id long, k int, chunk binary")


def _packed(docs: DataFrame) -> DataFrame:
    """Every text compressed, under its digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for big in batches:
            for b in slices(big, "text", 4 << 20):
                texts = _binaries(b.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(t) for t in texts], pa.binary()), b.column("doc_id"),
                     pa.array([squeeze.compress(t) for t in texts], pa.binary())], names=["tid", "doc_id", "packed"])

    return docs.mapInArrow(run, "tid binary, doc_id long, packed binary")


def _for_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts named by ``wanted`` (tid, first, ...): of equal texts only the rows of the first document.

    Always a merge join: the plan, and what it moves, is the same at every size."""
    texts = _packed(docs).withColumnRenamed("tid", "t").hint("merge")
    return wanted.join(texts, (F.col("tid") == F.col("t")) & F.col("first").eqNullSafe(F.col("doc_id"))).drop("t", "doc_id")


def _unpacked(b: pa.RecordBatch, most_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for part in slices(b, "packed", most_bytes):
        expand = zstandard.ZstdDecompressor()
        yield part, [expand.decompress(x) for x in part.column("packed").to_pylist()]


def encode_and_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row.

    A null text is an empty one; repeated rows come out alike; other columns are
    ignored; an empty table gives none. Ids are those of the tokenizers library
    without special tokens, the decoded text keeps special tokens.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    chunks = save(_chunks(docs), "chunks")
    first = save(chunks.where("k = 0").groupBy("tid").agg(F.min("doc_id").alias("first")), "texts")
    places = save(chunks.select("tid", "k", "chunk").distinct(), "places")
    shared = places.groupBy("chunk").agg(F.count("*").alias("n"), F.min(F.struct("tid", "k")).alias("o")).where("n > 1")
    asked = shared.groupBy(F.col("o.tid").alias("tid")).agg(F.collect_list(F.struct(F.col("o.k").alias("k"), "chunk")).alias("asked"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for big in batches:
            for b, texts in _unpacked(big):
                keys, parts = [], []
                for t, ends, asked in zip(texts, cut(texts), b.column("asked").to_pylist()):
                    for x in asked:
                        keys.append(x["chunk"])
                        parts.append(t[ends[x["k"] - 1] if x["k"] else 0:ends[x["k"]]])
                ids, off = enc.encode(_strings(parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array([ids[a:z].tobytes() for a, z in zip(off, off[1:])], pa.binary())],
                    names=["chunk", "ids"])

    once = _for_texts(docs, save(asked.join(first, "tid"), "asked")).select("packed", "asked")
    encoded = save(once.mapInArrow(encode, "chunk binary, ids binary").dropDuplicates(["chunk"]), "chunk-ids")
    known = places.join(encoded, "chunk").groupBy("tid").agg(F.collect_list(F.struct("k", "ids")).alias("known"))
    wanted = save(first.join(known, "tid", "left"), "known")
    discard(places, encoded)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for big in batches:
            for b, texts in _unpacked(big):
                known = [{x["k"]: x["ids"] for x in xs or ()} for xs in b.column("known").to_pylist()]
                ids, _ = assemble(enc, texts, known)
                off = np.cumsum([0, *map(len, ids)])
                decoded = enc.decode(np.concatenate([np.zeros(0, enc.dtype), *ids]), off)
                yield pa.RecordBatch.from_arrays(
                    [b.column("tid"), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())],
                    names=["tid", "n_tokens", "ids_sha256", "decoded_sha256"])

    done = _for_texts(docs, wanted).select("tid", "packed", "known").mapInArrow(
        finish, "tid binary, n_tokens long, ids_sha256 string, decoded_sha256 string")
    done = save(done.dropDuplicates(["tid"]), "results")
    discard(wanted)
    return chunks.where("k = 0").select("tid", "doc_id").join(done, "tid").drop("tid")
