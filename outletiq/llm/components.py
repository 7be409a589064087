"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outletiq.llm.common import discard, save


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; ``root`` is the smallest node reachable.

    An edge is kept from its larger end ``u`` to its smaller end ``v``. Large-star
    moves ``u`` to the smallest neighbour of ``v``; small-star links all smaller
    neighbours of ``u`` to the smallest one. Both keep components, and the table
    ends as stars after about log rounds. The parents ``p`` are a written table
    of their own, so the join on ``v``, which can be one centre for most rows, is
    between two plain shuffles that adaptive execution may split. Self loops,
    repeated edges and both directions of an edge are fine; an empty table gives none.
    """
    e = save(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
             "edges")
    state = _state(e)
    while state[0]:
        p = save(e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m"), "parents")
        large = e.join(p, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        m = F.min("v").over(Window.partitionBy("u"))
        small = large.select("u", "v", m.alias("m"))
        pairs = F.when(F.col("v") == F.col("m"), F.array(F.struct("u", F.col("m").alias("v")))).otherwise(
            F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        after = save(small.select(F.explode(pairs).alias("x")).select("x.u", "x.v").distinct(), "edges")
        now = _state(after)
        discard(p, e)
        e, done, state = after, now == state, now
        if done:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
