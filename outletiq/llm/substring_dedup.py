"""Substring dedup on a compacted de Bruijn graph of words.

Edges are windows of ``WINDOW`` consecutive words; neighbouring windows share
all words but one. The graph is never built edge by edge. It is compacted where
it is read, bucket by bucket:

1. Every window belongs to the bucket of its smallest ``PART``-word hash (its
   minimizer). Consecutive windows of one bucket are one *path*, stored as one
   row: bucket, content hash, document, first word, number of windows.
2. Buckets seen in one document only hold no repeated edge and go. In the
   others, paths of equal content are joined to their first source. All their
   edges are repeated, so the path stays compact; joined paths that are
   consecutive both in the document and in its source compact on to long spans.
3. A bucket with several contents branches. There each content's paths in its
   first document are opened to their edges, and edges are joined by their words' hash.
4. Source coordinates verify: a digest of the words of every long span is taken
   from both documents' texts, and a span counts only if they agree. Edges of
   branching buckets are compared by 128 bits.

A window is a repeat if it also starts in a document with a smaller id. In the
first document of its path's content its edge decides that, in later documents the path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outletiq.llm.common import discard, gram_codes, mix, pick, ranges, save, slices, split_words, word_codes

WINDOW, PART = 13, 5
MULTIPLIER, MULTIPLIER_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
PATHS = "bucket long, content long, doc_id long, variant long, start int, n int"
SEEN = "kind int, h1 long, h2 long, doc_id long, variant long, start int, n int"
#: Look-ups asked of a document at once; a document that is asked for more is dealt out as several rows.
ASKED = 20_000


def _powers(multiplier: int, n: int) -> np.ndarray:
    """1, m, m ** 2 ... modulo 2 ** 64."""
    out = np.full(n, multiplier, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of the ``width`` values from each place on."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def _run_codes(codes: np.ndarray, multiplier: int, start: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Hash of the ``n`` words from each ``start`` on: a difference of prefix sums, shifted to the same power."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers(multiplier, len(codes)))])
    back = _powers(pow(multiplier, -1, 1 << 64), len(codes))
    return mix((sums[start + n] - sums[start]) * back[start] + np.asarray(n).astype(np.uint64))


def _lists(column: pa.Array, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """A column of lists of structs as offsets and flat field arrays; a null list is empty."""
    off = np.asarray(column.offsets).astype(np.int64)
    flat = column.flatten()
    return off - off[0], [np.asarray(flat.field(f)).astype(np.int64) for f in fields]


def paths_of(texts: pa.Array, window: int, part: int) -> tuple[np.ndarray, ...]:
    """(text number, bucket, content, first word, windows) of every path of every text."""
    flat, off = split_words(texts)
    codes = word_codes(flat, 3)
    owner = np.repeat(np.arange(len(texts)), np.diff(off))
    if len(codes) < window:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64),
                np.zeros(0, np.int64), np.zeros(0, np.int64))
    bucket = _least(gram_codes(codes, part), window - part + 1)
    inside = owner[:len(bucket)] == owner[window - 1:]
    first = inside.copy()
    first[1:] &= (bucket[1:] != bucket[:-1]) | ~inside[:-1] | (owner[1:len(bucket)] != owner[:len(bucket) - 1])
    start = np.flatnonzero(first)
    at = np.flatnonzero(inside)
    n = np.diff(np.append(np.searchsorted(at, start), len(at)))
    content = _run_codes(codes, MULTIPLIER, start, n + window - 1)
    return owner[start], bucket[start], content, start - off[owner[start]], n


def variants(docs: DataFrame) -> DataFrame:
    """``docs`` with ``variant``, which tells different texts of one id apart: a hash of the text where an
    id has several, else 0."""
    code = F.xxhash64("text")
    several = (docs.groupBy("doc_id").agg(F.min(code).alias("low"), F.max(code).alias("high"))
               .where("low <> high").select(F.col("doc_id").alias("many_id")))
    several = save(several, "repeated-ids")
    j = docs.join(several, F.col("doc_id") == F.col("many_id"), "left")
    return j.withColumn("variant", F.when(F.col("many_id").isNull(), F.lit(0)).otherwise(code)).drop("many_id")


def paths(docs: DataFrame, window: int, part: int) -> DataFrame:
    """One row per path; rows without an id have none, as they are neither source nor copy of anything."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "text", 4 << 20):
                owner, bucket, content, start, n = paths_of(b.column("text"), window, part)
                ids, variant = (np.asarray(b.column(c))[owner] for c in ("doc_id", "variant"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids), pa.array(variant),
                     pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["bucket", "content", "doc_id", "variant", "start", "n"])

    return docs.where("doc_id is not null").mapInArrow(run, PATHS)


def _look_up(docs: DataFrame, requests: DataFrame, window: int) -> DataFrame:
    """What the texts hold at the requested places: edges of opened paths (kind 0), digests of spans (kind 1).

    ``requests`` has doc_id, variant, kind, start, n. A document's are gathered
    in parts of about ``ASKED``, each with the text, so a source that a
    great many documents copy from is spread over many rows.
    """
    requests = save(requests, "requests")
    many = requests.groupBy("doc_id", "variant").agg(F.ceil(F.count("*") / ASKED).alias("parts")).where("parts > 1")
    many = save(many, "much-asked")
    dealt = requests.join(many, ["doc_id", "variant"], "left").withColumn(
        "part", F.pmod(F.xxhash64("kind", "start", "n"), F.coalesce("parts", F.lit(1))))
    asked = dealt.groupBy("doc_id", "variant", "part").agg(F.collect_list(F.struct("kind", "start", "n")).alias("asked"))
    joined = docs.join(asked, ["doc_id", "variant"]).select("doc_id", "variant", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "text", 4 << 20):
                flat, off = split_words(b.column("text"))
                codes = word_codes(flat, 3)
                of, (kind, start, n) = _lists(b.column("asked"), "kind", "start", "n")
                ids, variant = (np.repeat(np.asarray(b.column(c)), np.diff(of)) for c in ("doc_id", "variant"))
                at = np.repeat(off[:-1], np.diff(of)) + start
                edge = kind == 0
                place, own = ranges(at[edge], n[edge]), np.repeat(np.flatnonzero(edge), n[edge])
                first = start[own] + place - at[own]
                # a span's words without the space between them, and their lengths
                ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1]
                data, lengths = memoryview(flat.buffers()[2] or b""), np.diff(ends).astype("<u4")
                digests = b"".join(
                    hashlib.blake2b(lengths[a:z].tobytes() + data[ends[a]:ends[z]], digest_size=16).digest()
                    for a, z in zip(at[~edge].tolist(), (at[~edge] + n[~edge]).tolist()))
                sides = np.frombuffer(digests, "<i8").reshape(-1, 2)
                h1, h2 = (_run_codes(codes, m, place, window).view(np.int64) for m in (MULTIPLIER, MULTIPLIER_2))
                columns = (np.concatenate([np.zeros(len(place)), np.ones(len(sides))]),
                           np.concatenate([h1, sides[:, 0]]), np.concatenate([h2, sides[:, 1]]),
                           np.concatenate([ids[own], ids[~edge]]), np.concatenate([variant[own], variant[~edge]]),
                           np.concatenate([first, start[~edge]]), np.concatenate([np.ones(len(place)), n[~edge]]))
                kinds = (np.int32, np.int64, np.int64, np.int64, np.int64, np.int32, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, kinds)],
                                                 names=["kind", "h1", "h2", "doc_id", "variant", "start", "n"])

    return joined.mapInArrow(run, SEEN)


def repeated_spans(docs: DataFrame, window: int = WINDOW, part: int = PART) -> DataFrame:
    """(doc_id, variant, start, n) word spans to remove: all windows that also start in a document with a smaller id.

    Spans of a document may touch or overlap. ``docs`` has doc_id, text and
    variant (see ``variants``): texts of one id are one document in the order of ids, and each is cut on its own.
    """
    every = save(paths(docs, window, part), "paths")
    shared = every.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"),
                                         (F.min("content") != F.max("content")).alias("branches")).where("a <> b")
    shared = save(shared.select("bucket", "branches"), "buckets")
    found = save(every.join(shared, "bucket"), "repeated-paths")
    discard(every, shared)
    source = save(found.groupBy("bucket", "content").agg(F.min(F.struct("doc_id", "variant", "start")).alias("s")), "sources")
    of = source.select("bucket", "content", F.col("s.doc_id").alias("source_id"), F.col("s.variant").alias("source_variant"),
                       F.col("s.start").alias("source_start"))
    placed = save(found.join(of, ["bucket", "content"]).where("doc_id > source_id or branches")
                  .select("doc_id", "variant", "start", "n", "source_id", "source_variant", "source_start"), "placed")
    discard(found, source)
    copies = placed.where("doc_id > source_id")

    # paths that go on in the document and in its source are one span
    order = Window.partitionBy("doc_id", "variant").orderBy("start")
    apart = F.col("start") - F.col("source_start")
    goes_on = ((F.lag("source_id").over(order) == F.col("source_id"))
               & (F.lag("source_variant").over(order) == F.col("source_variant")) & (F.lag("apart").over(order) == apart)
               & (F.lag("start").over(order) + F.lag("n").over(order) == F.col("start")))
    copies = copies.dropDuplicates(["doc_id", "variant", "start"]).withColumn("apart", apart)
    islands = copies.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    spans = islands.groupBy("doc_id", "variant", "island").agg(
        F.min("start").alias("start"), (F.sum("n") + F.lit(window - 1)).cast("int").alias("n"),
        F.first("source_id").alias("source_id"), F.first("source_variant").alias("source_variant"),
        F.first("apart").alias("apart"))
    spans = save(spans.withColumn("source_start", F.col("start") - F.col("apart")).drop("island", "apart"), "spans")

    opened = placed.where("doc_id = source_id").select("doc_id", "variant", F.lit(0).alias("kind"), "start", "n").distinct()
    ends = spans.select("doc_id", "variant", F.lit(1).alias("kind"), "start", "n").union(
        spans.select(F.col("source_id").alias("doc_id"), F.col("source_variant").alias("variant"), F.lit(1).alias("kind"),
                     F.col("source_start").alias("start"), "n")).distinct()
    seen = save(_look_up(docs, opened.union(ends), window), "seen")
    discard(placed)

    edges = seen.where("kind = 0").select("h1", "h2", "doc_id", "variant", "start")
    first = save(edges.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                 .where("least <> most").drop("most"), "edges")
    single = edges.join(first, ["h1", "h2"]).where("doc_id > least").select(
        "doc_id", "variant", "start", F.lit(window).alias("n"))

    digest = seen.where("kind = 1").select("doc_id", "variant", "start", "n", "h1", "h2").distinct()
    there = digest.select(F.col("doc_id").alias("source_id"), F.col("variant").alias("source_variant"),
                          F.col("start").alias("source_start"), "n", F.col("h1").alias("s1"), F.col("h2").alias("s2"))
    verified = spans.join(save(digest, "digests"), ["doc_id", "variant", "start", "n"])
    verified = verified.join(save(there, "source-digests"), ["source_id", "source_variant", "source_start", "n"])
    return verified.where("h1 = s1 and h2 = s2").select("doc_id", "variant", "start", "n").union(single)


def _cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with all spans of a document gathered, a few per word of it at most."""
    per_doc = spans.groupBy(F.col("doc_id").alias("of_id"), F.col("variant").alias("of_variant")).agg(
        F.collect_list(F.struct("start", "n")).alias("spans"))
    same = (F.col("doc_id") == F.col("of_id")) & (F.col("variant") == F.col("of_variant"))
    return docs.join(per_doc, same, "left").drop("of_id", "of_variant")


def _kept(texts: list[bytes], spans: pa.Array) -> Iterator[tuple[int, list[bytes], bool]]:
    """Of each text the number of words, the words kept, and whether that is fewer."""
    off, (start, n) = _lists(spans, "start", "n")
    for text, a, z in zip(texts, off.tolist(), off[1:].tolist()):
        words = text.split()
        if a == z:
            yield len(words), words, False
            continue
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, start[a:z], 1)
        np.add.at(steps, start[a:z] + n[a:z], -1)
        gone = np.cumsum(steps)[:-1] > 0
        yield len(words), [w for w, g in zip(words, gone.tolist()) if not g], True


def summary(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row.

    A null text has no words; a row without id keeps all its words; rows of one
    id are no copies of each other, and equal ones come out alike. An empty table gives none.
    """
    d = variants(pick(docs, doc_id=id_col, text=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha = [], [], []
            texts = b.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
            for total, kept, _ in _kept(texts, b.column("spans")):
                n.append(total)
                gone.append(total - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _cut(d, repeated_spans(d, window)).mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the same rows and columns; texts that lose words become the kept words joined by one space."""
    names = docs.columns
    others = [c for c in names if c != "text"]
    # all but the text is one struct, so no column of it can clash with one that is added here
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("doc_id"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "text", 4 << 20):
                texts = b.column("text").to_pylist()
                plain = b.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
                for i, (_, kept, fewer) in enumerate(_kept(plain, b.column("spans"))):
                    if fewer:
                        texts[i] = b" ".join(kept).decode()
                fields = dict(zip(others, b.column("row").flatten()), text=pa.array(texts, b.column("text").type))
                yield pa.RecordBatch.from_arrays([fields[c] for c in names], names=names)

    known = variants(inside)
    spans = repeated_spans(known.select("doc_id", "text", "variant"), window)
    return _cut(known, spans).select("row", "text", "spans").mapInArrow(run, docs.schema)
