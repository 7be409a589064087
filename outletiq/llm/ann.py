"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

The index deals all vectors to blocks of about ``BLOCK`` rows by a hash of their
id. A block keeps, for each of ``m`` projections, its vectors in the order of
their projected value. A query opens a window around its own value in every
array and widens all windows step by step (virtual rehashing); a vector that is
inside at least ``ALPHA * m`` windows has collided. The windows stop when
``SHARE`` of the block has collided, and all collided vectors are verified by
their exact cosine. Projections are rows of random rotations, drawn from a seed.

Queries are a stated set and meet the blocks in parts of bounded size; a query
keeps its best ``k`` of each block, and the best ``k`` of those are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outletiq.llm.common import ranges, save

PROJECTIONS = 64
BLOCK = 4096
QUERY_PART = 4096
ALPHA, SHARE = 0.7, 0.1
#: Half-widths of the windows, in standard deviations of a unit vector's projection.
FIRST_WIDTH, GROWTH = 0.8, 1.12
INDEX = "block int, rows int, ids binary, vectors binary, order binary, sorted binary"


def projections(dim: int, m: int, seed: int = 20) -> np.ndarray:
    """(dim, m) unit columns: random rotations side by side, so those of one rotation do not overlap."""
    rng = np.random.default_rng(seed)
    parts = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-m // dim))]
    return np.concatenate(parts, axis=1)[:, :m]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part.

    Left out are null ids, null, empty or zero vectors, and vectors with a null or non-finite component.
    """
    x = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                       F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return x.where(F.col("vec_id").isNotNull() & fine & F.exists("v", lambda e: e != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of components, each row scaled by a power of two to a largest component of 0.5 to 1: that
    changes no bit of a cosine, and squares neither overflow nor vanish."""
    x = np.asarray(column.flatten()).reshape(-1, dim).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def build_index(vectors: DataFrame, dim: int, m: int = PROJECTIONS, block: int = BLOCK) -> DataFrame:
    """One row per block: ids, vectors, and per projection the sorted values and their order."""
    blocks = max(1, -(-vectors.count() // block))
    matrix = projections(dim, m)

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id").combine_chunks()
        x = _matrix(table.column("v").combine_chunks(), dim)
        values = (_unit(x) @ matrix).T
        order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        ids = np.asarray(table.column("vec_id"))
        data = [ids.tobytes(), x.tobytes(), order.tobytes(), np.take_along_axis(values, order, 1).tobytes()]
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()),
                         "rows": pa.array([len(ids)], pa.int32()),
                         **{n: pa.array([d], pa.binary()) for n, d in zip(("ids", "vectors", "order", "sorted"), data)}})

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(build, INDEX)


class Block:
    """One block of the index, ready for queries."""

    def __init__(self, rows: int, ids: bytes, vectors: bytes, order: bytes, values: bytes, dim: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.x = np.frombuffer(vectors, np.float64).reshape(rows, dim)
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        self.order = np.frombuffer(order, np.int32)
        self.m = len(self.order) // rows
        self.rows, self.dim = rows, dim
        # all arrays one after another, 8 apart (projections of unit vectors lie within -1 and 1)
        self.shift = 8.0 * np.arange(self.m)
        self.flat = (np.frombuffer(values, np.float64).reshape(self.m, rows) + self.shift[:, None]).ravel()
        self.base = rows * np.arange(self.m)

    def collided(self, q: np.ndarray, wanted: int) -> np.ndarray:
        """Positions in at least ``ALPHA * m`` windows, widened until ``wanted`` have collided."""
        least = int(np.ceil(ALPHA * self.m))
        centre = q + self.shift
        width = FIRST_WIDTH / np.sqrt(self.dim)
        lo = hi = np.searchsorted(self.flat, centre)
        lo, hi = np.clip(lo, self.base, self.base + self.rows), np.clip(hi, self.base, self.base + self.rows)
        count = np.zeros(self.rows, np.int64)
        while True:
            new_lo = np.maximum(np.searchsorted(self.flat, centre - width), self.base)
            new_hi = np.minimum(np.searchsorted(self.flat, centre + width, "right"), self.base + self.rows)
            ring = ranges(np.concatenate([new_lo, hi]), np.concatenate([lo - new_lo, new_hi - hi]))
            count += np.bincount(self.order[ring], minlength=self.rows)
            lo, hi = new_lo, new_hi
            found = np.flatnonzero(count >= least)
            if len(found) >= min(wanted, self.rows) or width > 2:
                return found
            width *= GROWTH

    def nearest(self, query_id: int, v: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the best ``k`` collided vectors but the query's own id; ties to smaller ids."""
        at = self.collided(q, k + 1 + int(SHARE * self.rows))
        at = at[self.ids[at] != query_id]
        cosine = (self.x[at] * v).sum(axis=1) / (self.norm[at] * np.sqrt((v * v).sum()))
        best = np.lexsort((self.ids[at], -cosine))[:k]
        return self.ids[at][best], cosine[best]


def search(vectors: DataFrame, is_query, k: int = 5, m: int = PROJECTIONS, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found, for the rows where ``is_query`` holds.

    ``is_query`` is a condition on vec_id. A query searches the vectors of its own
    length (number of components), each length with an index of its own. One with fewer candidates returns
    all of them; no usable vector gives no rows. Rows that repeat an id are
    candidates one by one, and none of them for a query of that id.
    """
    x = save(usable(vectors, id_col, vector_col), "vectors")
    lengths = [r["n"] for r in x.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()]
    out = x.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim in lengths:
        mine = x if len(lengths) == 1 else x.where(F.size("v") == dim)
        out = out.unionByName(_search(mine, dim, is_query, k, m))
    return out


def _search(x: DataFrame, dim: int, is_query, k: int, m: int) -> DataFrame:
    """``search`` among usable vectors of one length."""
    index = save(build_index(x, dim, m), "index")
    queries = x.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))  # of rows that repeat an id, one asks
    parts = max(1, -(-queries.count() // QUERY_PART))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    matrix = projections(dim, m)

    def answer(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            row = left.to_pylist()[0]
            block = Block(row["rows"], row["ids"], row["vectors"], row["order"], row["sorted"], dim)
            v = _matrix(right.column("v").combine_chunks(), dim)
            q = _unit(v) @ matrix
            for i, query_id in enumerate(right.column("vec_id").to_pylist()):
                ids, cosine = block.nearest(query_id, v[i], q[i], k)
                out["query_id"].append(np.full(len(ids), query_id, np.int64))
                out["vec_id"].append(ids)
                out["score"].append(cosine)
        types = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table({n: pa.array(np.concatenate([np.zeros(0, t), *out[n]])) for n, t in types.items()})

    numbers = index.select(F.max("block")).first()[0] + 1
    every = F.explode(F.sequence(F.lit(0), F.lit(numbers - 1)))
    spread = queries.select("part", "vec_id", "v", every.alias("block"))
    dealt = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = (dealt.groupBy("block", "part").cogroup(spread.groupBy("block", "part"))
             .applyInArrow(answer, "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def exact(vectors: np.ndarray, ids: np.ndarray, queries: Iterator[int], k: int = 5) -> dict[int, list[int]]:
    """Brute force on arrays in memory, for recall measurements in tests."""
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        cosine = (vectors * vectors[i]).sum(axis=1) / (norm * norm[i])
        order = np.lexsort((ids, -cosine))
        out[q] = [int(ids[j]) for j in order if ids[j] != q][:k]
    return out
