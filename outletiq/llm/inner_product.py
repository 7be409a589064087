"""Exact top-k inner products over norm-sorted vectors with SVD-rotated partial sums.

Components become integers ``floor(scale * x)``; scores are exact integer inner
products. A rotation from the singular vectors of a bounded sample puts most of
the length into the first coordinates. Vectors are range-partitioned by
descending length into blocks, and blocks are searched in rounds, longest first,
each round four times as many blocks as the one before. A query goes on to a block
only if (longest vector of the block) x (its own length) can reach its k-th best
score so far; inside, partial sums over the first coordinates plus the
Cauchy-Schwarz bound of the rest drop candidates, and the others are verified in
integers. Bounds carry a margin above the rounding error, so no result is lost.

The rotation changes the speed only, never a result. Queries are a stated set
that meets the blocks in parts of bounded size. A query searches vectors of its
own length (number of components). Left out are null ids and vectors that are null or empty or
hold a null or non-finite component; scaled components are held within ±2^24,
so that products of up to 2^14 components fit a long. Where an id repeats, its
rows are candidates one by one (none of them for a query of that id), and the
least vector asks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outletiq.llm.common import save

BLOCK = 8192
QUERY_PART = 8192
#: Queries of a part that are scored at once; the partial sums of a tile are ``TILE * BLOCK`` doubles.
TILE = 256
GROWTH = 4
#: Components of all vectors that the rotation is fitted on, 8 MB.
SAMPLE_VALUES = 1 << 20
LIMIT = 1 << 24
#: Margin of the bounds, as a share of the product of both lengths.
MARGIN = 1e-9
INDEX = "block long, n int, top double, ids binary, ints binary, turned binary"
FOUND = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, scale: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<int>, norm) of the rows that take part."""
    x = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                       F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    x = x.where(F.col("vec_id").isNotNull() & fine & (F.size("v") > 0))
    held = F.transform("v", lambda e: F.floor(F.greatest(F.least(e * F.lit(float(scale)), F.lit(float(LIMIT))),
                                                         F.lit(float(-LIMIT)))).cast("int"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e)
    return x.select("vec_id", held.alias("v")).withColumn("norm", F.sqrt(squares))


def rotation(x: DataFrame, dim: int) -> np.ndarray:
    """(dim, dim) orthogonal columns in the order of falling singular values of a sample of the vectors."""
    rows = max(dim, min(1 << 14, SAMPLE_VALUES // dim))
    sample = x.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(rows).select("v").toArrow()
    a = np.asarray(sample.column("v").combine_chunks().flatten(), np.float64).reshape(-1, dim)
    return np.linalg.svd(np.concatenate([a, np.zeros((max(0, dim - len(a)), dim))]), full_matrices=False)[2].T


def build_index(x: DataFrame, dim: int, turn: np.ndarray, block: int = BLOCK) -> DataFrame:
    """One row per block of about ``block`` vectors; block numbers rise as lengths fall."""
    wanted = max(1, -(-x.count() // block))
    longest_first = [F.desc("norm"), F.xxhash64("vec_id", "v"), F.col("vec_id")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, ints = TaskContext.get().partitionId() << 32, [], []
        for batch in batches:
            if batch.num_rows:
                ids.append(np.asarray(batch.column("vec_id")))
                ints.append(np.asarray(batch.column("v").flatten()).astype(np.int32).reshape(-1, dim))
            while sum(map(len, ids)) >= 2 * block:
                i, v = np.concatenate(ids), np.concatenate(ints)
                yield one(number, i[:block], v[:block])
                number, ids, ints = number + 1, [i[block:]], [v[block:]]
        if ids:
            yield one(number, np.concatenate(ids), np.concatenate(ints))

    def one(number: int, ids: np.ndarray, ints: np.ndarray) -> pa.RecordBatch:
        norm = np.sqrt((ints.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-norm, kind="stable")
        ids, ints = ids[order], ints[order]
        data = [ids.tobytes(), ints.tobytes(), (ints @ turn).tobytes()]
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([float(norm.max())]),
             *[pa.array([d], pa.binary()) for d in data]], names=["block", "n", "top", "ids", "ints", "turned"])

    dealt = x.repartitionByRange(wanted, *longest_first).sortWithinPartitions(*longest_first)
    return dealt.select("vec_id", "v").mapInArrow(build, INDEX)


def _tails(y: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Lengths of what is left of each row behind each cut."""
    squares = np.concatenate([np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(y), 1))], axis=1)
    return np.sqrt(squares[:, cuts])


def search_block(ids: np.ndarray, ints: np.ndarray, turned: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
                 asked: np.ndarray, least: np.ndarray, k: int) -> list[np.ndarray]:
    """Columns query_id, vec_id, score: each query's best ``k`` of one block among those that reach ``least``.

    Vectors are in the order of falling length. ``least`` is the query's k-th
    best score so far, or minus infinity.
    """
    dim = ints.shape[1]
    cuts = sorted({max(1, dim * i // 4) for i in range(1, 5)})
    norm, q_norm = np.sqrt((turned * turned).sum(axis=1)), np.sqrt((asked * asked).sum(axis=1))
    tails, q_tails = _tails(turned, cuts), _tails(asked, cuts)
    found = []
    for a in range(0, len(query_ids), TILE):
        tile = slice(a, a + TILE)
        floor = least[tile] - MARGIN * (q_norm[tile] * norm[0] + 1)
        # lengths fall, so the vectors that can reach any query's floor come first
        reach = norm[:, None] * q_norm[tile] >= floor if np.isfinite(floor).all() else np.ones((len(norm), 1), bool)
        n = int(np.flatnonzero(reach.any(axis=1))[-1]) + 1 if reach.any() else 0
        if not n:
            continue
        part, live, start = np.zeros((len(floor), n)), None, 0
        for c, cut in enumerate(cuts):
            if live is None:
                part += asked[tile, start:cut] @ turned[:n, start:cut].T
                up = part + q_tails[tile, c][:, None] * tails[:n, c] >= floor[:, None]
                if up.mean() < 0.1 or cut == dim:
                    live = np.nonzero(up)
                    sums = part[live]
            else:
                sums = sums + np.einsum("ij,ij->i", asked[tile][live[0], start:cut], turned[live[1], start:cut])
                up = sums + q_tails[tile, c][live[0]] * tails[live[1], c] >= floor[live[0]]
                live, sums = (live[0][up], live[1][up]), sums[up]
            start = cut
        qi, vi = live
        own = ids[vi] != query_ids[tile][qi]
        qi, vi, sums = qi[own], vi[own], sums[own]
        # the k best by the rounded sum bound the k-th exact score from below, less the margin
        order = np.lexsort((-sums, qi))
        qi, vi, sums = qi[order], vi[order], sums[order]
        first = np.searchsorted(qi, np.arange(len(floor)))
        count = np.diff(np.append(first, len(qi)))
        kth = np.where(count >= k, sums[np.minimum(first + k - 1, max(len(sums) - 1, 0))], -np.inf) if len(sums) else floor
        near = sums >= (kth - 2 * MARGIN * (q_norm[tile] * norm[0] + 1))[qi]
        qi, vi = qi[near], vi[near]
        for b in range(0, len(qi), 1 << 16):  # verified in integers, a bounded number at once
            q, v = qi[b:b + (1 << 16)], vi[b:b + (1 << 16)]
            exact = np.einsum("ij,ij->i", queries[tile][q].astype(np.int64), ints[v].astype(np.int64))
            found.append((query_ids[tile][q], ids[v], exact))
    if not found:
        return [np.zeros(0, np.int64)] * 3
    query, vec, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return [x[place < k] for x in (query, vec, score)]


def _round(index: DataFrame, queries: DataFrame, turn: np.ndarray, parts: int, k: int) -> DataFrame:
    """Best ``k`` of each block for each query that can find something in it; ``queries`` has least."""
    dim = len(turn)
    tops = index.select("block", "top")
    numbers = [r["block"] for r in tops.select("block").collect()]  # one number per block of thousands of rows

    def answer(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            row = left.slice(0, 1).to_pylist()[0]
            ids = np.frombuffer(row["ids"], np.int64)
            ints = np.frombuffer(row["ints"], np.int32).reshape(-1, dim)
            turned = np.frombuffer(row["turned"], np.float64).reshape(-1, dim)
            right = right.sort_by("vec_id").combine_chunks()
            q = np.asarray(right.column("v").combine_chunks().flatten()).astype(np.int32).reshape(-1, dim)
            least = np.asarray(right.column("least").cast(pa.float64()).fill_null(-np.inf))
            out = search_block(ids, ints, turned, np.asarray(right.column("vec_id")), q, q @ turn, least, k)
        return pa.table({c.split()[0]: pa.array(x) for c, x in zip(FOUND.split(", "), out)})

    every = F.explode(F.lit(numbers).cast("array<long>") if numbers else F.array().cast("array<long>"))
    asked = queries.withColumn("block", every).join(tops, "block")
    # a part in a million more than the bound, far above its rounding error
    asked = asked.where(F.col("least").isNull() | (F.col("top") * F.col("norm") * 1.000001 + 1 >= F.col("least")))
    asked = asked.select("block", "part", "vec_id", "v", "least")
    dealt = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return (dealt.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(answer, FOUND))


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _search(x: DataFrame, dim: int, is_query, k: int, block: int, query_part: int) -> DataFrame:
    turn = rotation(x, dim)
    index = save(build_index(x, dim, turn, block), "products")
    queries = x.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"), F.min_by("norm", "v").alias("norm"))
    parts = max(1, -(-queries.count() // query_part))
    queries = save(queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")), "asked")
    order = index.select("block", F.row_number().over(Window.orderBy("block")).alias("place"))
    total = index.count()
    index = save(index.join(order, "block"), "ordered") if total > 1 else index.withColumn("place", F.lit(1))
    best, done, width = None, 0, 1
    while done < total:
        now = queries.withColumn("least", F.lit(None).cast("long"))
        if best is not None:
            known = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
            now = queries.join(known, queries["vec_id"] == known["query_id"], "left").drop("query_id")
        here = index.where((F.col("place") > done) & (F.col("place") <= done + width)).drop("place")
        found = _round(here, now, turn, parts, k)
        best = save(_best(found if best is None else found.unionByName(best.drop("rank")), k), "best")
        done, width = done + width, width * GROWTH
    return best


def search(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id",
           vector_col: str = "embedding", block: int = BLOCK, query_part: int = QUERY_PART) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products for the rows where ``is_query`` holds.

    ``is_query`` is a condition on vec_id. Ties go to the smaller id; a query
    with fewer candidates returns all of them; no usable vector gives no rows.
    """
    x = save(integers(vectors, scale, id_col, vector_col), "integers")
    lengths = [r["n"] for r in x.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()]
    out = x.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for dim in lengths:
        mine = x if len(lengths) == 1 else x.where(F.size("v") == dim)
        best = _search(mine, dim, is_query, k, block, query_part)
        out = out.unionByName(best.select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
    return out
