"""SimHash near-duplicates: pigeonhole blocks over 64-bit fingerprints.

Fingerprints at ``d`` or fewer differing bits agree in at least two of ``d + 2``
blocks. So each distinct fingerprint gets one key per pair of blocks, keys are
joined, and the Hamming distance decides. A key that many fingerprints share is
split again in the same way over its remaining bits; where even that leaves a
dense key, its members meet at one-bit neighbours instead of pair by pair, which
is exact (for ``d`` 2) and linear in the members. No pair is lost and no group is expanded into all
its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outletiq.llm.common import discard, pick, save
from outletiq.llm.components import connected

SEED = 42
#: Members of a key that are compared pair by pair; keys with more are split further.
PAIRWISE = 16


def fingerprint(text: bytes, n: int) -> int:
    """64-bit SimHash (as a signed integer) of the lower-cased ``n``-word shingles of one text."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, and split at 0x09-0x0D and 0x20 only
    if not words:
        return 0
    count = max(1, len(words) - n + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = (ends - [len(w) + 1 for w in words]).tolist(), (ends - 1).tolist()
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for a in range(0, count, 1 << 16):
        part = range(a, min(a + (1 << 16), count))
        hashes = np.array([h(joined[starts[i]:stops[min(i + n, len(words)) - 1]], SEED) for i in part], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row; null and blank texts have fingerprint 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            fps = [fingerprint(t.as_py() or b"", n) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _block_masks(bits: list[int], d: int) -> list[int]:
    """Masks over ``bits``: any two numbers that differ in at most ``d`` of these bits agree on one mask."""
    blocks = [bits[i * len(bits) // (d + 2):(i + 1) * len(bits) // (d + 2)] for i in range(d + 2)]
    return [sum(1 << b for b in x + y) for x, y in combinations(blocks, 2)]


def _shared(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose key occurs more than once, with the number of its members ``n``."""
    keys = save(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-keys")
    out = save(rows.join(keys, ["mask", "key"]), name)
    discard(keys)
    return out


def _pairs(members: DataFrame, d: int) -> DataFrame:
    x = members.where(F.col("n") <= PAIRWISE)
    y = x.select("mask", "key", F.col("fp").alias("b"))
    return (x.join(y, ["mask", "key"]).where((F.col("fp") < F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= d))
            .select(F.col("fp").alias("a"), "b"))


def links(fps: DataFrame, d: int) -> DataFrame:
    """Edges (a, b) that connect any two distinct fingerprints at ``d`` or fewer bits, directly or through others.

    Every edge but those of dense keys is one verified pair; a dense key links
    its members to the smallest one at each shared neighbour, again at most
    ``d`` bits away.
    """
    if d not in (1, 2):
        raise ValueError("the distance must be 1 or 2")
    tops = _block_masks(list(range(64)), d)
    first = [(i, _signed(m)) for i, m in enumerate(tops)]
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in first])).alias("k"))
    one = _shared(keyed.select("k.mask", "k.key", "fp"), "blocks")
    subs = {i: [m | s for s in _block_masks([b for b in range(64) if not m >> b & 1], d)] for i, m in enumerate(tops)}
    split = F.create_map(*[x for i, ms in subs.items() for x in (F.lit(i), F.array(*[
        F.struct(F.lit(i * len(ms) + j).alias("mask"), F.lit(_signed(m)).alias("bits")) for j, m in enumerate(ms)]))])
    again = (one.where(F.col("n") > PAIRWISE).select("fp", F.explode(split[F.col("mask")]).alias("s"))
             .select("s.mask", F.col("fp").bitwiseAND(F.col("s.bits")).alias("key"), "fp"))
    two = _shared(again, "subblocks")
    every = [m for ms in subs.values() for m in ms]
    free = F.array(*[F.array(*[F.lit(_signed(1 << b)) for b in range(64) if not m >> b & 1]) for m in every])
    flips = F.transform(free[F.col("mask")], lambda b: F.col("fp").bitwiseXOR(b))
    near = two.where(F.col("n") > PAIRWISE).select("mask", "fp", F.explode(F.concat(F.array("fp"), flips)).alias("at"))
    if d == 1:  # a pair at one bit: one of them is the other's neighbour
        star = near.join(two.select("mask", F.col("fp").alias("at")), ["mask", "at"]).where("fp > at")
        star = star.select(F.col("at").alias("a"), F.col("fp").alias("b"))
    else:  # a pair at two bits or fewer: both have a neighbour in common
        meet = near.groupBy("mask", "at").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
        star = near.join(save(meet.drop("n"), "meeting"), ["mask", "at"]).where("fp <> least").select(
            F.col("least").alias("a"), F.col("fp").alias("b"))
    return _pairs(one, d).union(_pairs(two, d)).union(star).distinct()


def _groups(of_docs: DataFrame, d: int) -> DataFrame:
    """(fp, component_id, leads) of every distinct fingerprint of (doc_id, fp) rows.

    ``leads`` marks one fingerprint of each component: the smallest of those that
    rows with the smallest id have."""
    fps = save(of_docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = save(connected(links(fps.select("fp"), d)), "roots")
    linked = fps.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = F.min(F.struct(F.col("first").isNull().alias("unnamed"), "first", "fp")).alias("least")
    smallest = save(linked.groupBy("root").agg(least).select("root", "least.first", "least.fp"), "smallest")
    named = roots.join(smallest.withColumnRenamed("fp", "lead"), "root").select(
        F.col("node").alias("fp"), F.col("first").alias("component_id"), "lead")
    every = fps.join(named, "fp", "left")
    return save(every.select("fp", F.coalesce("component_id", "first").alias("component_id"),
                             F.coalesce(F.col("lead") == F.col("fp"), F.lit(True)).alias("leads")), "groups")


def near_duplicates(docs: DataFrame, n: int = 3, d: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id) of every row; ``component_id`` is the smallest id reachable.

    Rows without words share fingerprint 0 and are linked like any other. Exact
    copies are one fingerprint before any key is made. A null id has its row but
    is never a component's name unless all ids of it are null; rows that share an
    id are one document. Other columns of the input are ignored.
    """
    of_docs = save(fingerprints(docs, n, id_col, text_col), "fingerprints")
    return of_docs.join(_groups(of_docs, d), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _with_fingerprint(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (row, doc_id, text) with the fingerprint of the text as ``fp``, without the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py() or b"", n) for t in b.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(fps, pa.int64())],
                                             names=["row", "doc_id", "fp"])

    out = T.StructType([rows.schema["row"], rows.schema["doc_id"], T.StructField("fp", T.LongType())])
    return rows.select("row", "doc_id", "text").mapInArrow(run, out)


def keep_first(docs: DataFrame, n: int, d: int) -> DataFrame:
    """The first row of each component, with all its columns.

    First is the smallest id, then the smallest fingerprint, so rows that share
    an id but not the text are judged apart. Rows that repeat both are one document
    and stay together. Rows without an id come after all others, and where a
    component has no id at all one of them stays.
    """
    of_docs = save(fingerprints(docs, n), "fingerprints")
    groups = _groups(of_docs, d)
    stays = F.col("leads") & F.col("doc_id").eqNullSafe(F.col("component_id"))
    judged = of_docs.join(groups, "fp").groupBy("doc_id").agg(F.bool_or(stays).alias("any"), F.bool_and(stays).alias("all"))
    # ids with a row that goes, and null: an id's rows all go unless ``any`` stays
    touched = save(judged.where("doc_id is null or not all").select(F.col("doc_id").alias("id"), "any"), "touched")
    # the whole row is one struct, so no column of it can clash with one that is added here
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row).select("row", F.col("row")["doc_id"].alias("doc_id"), F.col("row")["text"].alias("text"))
    out = rows.join(touched, F.col("doc_id") == F.col("id"), "left_anti").where("doc_id is not null").select("row")
    odd = touched.where("any").select("id", F.col("id").isNull().alias("none")).groupBy().agg(
        F.bool_or("none").alias("none"), F.bool_or(~F.col("none")).alias("mixed")).first()
    leads = groups.where("leads").select(F.col("fp").alias("lead"), F.col("component_id").alias("component"))
    if odd["mixed"]:
        ids = touched.where("any and id is not null")
        some = _with_fingerprint(rows.join(ids, F.col("doc_id") == F.col("id"), "left_semi"), n)
        first = (F.col("fp") == F.col("lead")) & (F.col("doc_id") == F.col("component"))
        out = out.union(some.join(leads, first, "left_semi").select("row"))
    if odd["none"]:
        some = _with_fingerprint(rows.where("doc_id is null"), n)
        some = some.join(leads.where("component is null"), F.col("fp") == F.col("lead"), "left_semi")
        out = out.union(some.groupBy("fp").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
