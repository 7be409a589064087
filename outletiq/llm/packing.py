"""Best-fit packing of token sequences, improved by swap-based local search.

Only lengths are packed, so what moves between machines is one short row per
piece. Pieces are dealt by a hash to groups of about ``group_rows``, and a group is
packed on its own. Its local search ends with at most one bin that is half full
or less; that one and the group's emptiest bin are dealt and packed again with those of the other
groups, level by level, until one group holds them.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletiq.llm.bpe import encoder
from outletiq.llm.common import pick, save, slices

GROUP_ROWS = 10_000
PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: item numbers by bin. A bit set of the free spaces finds the tightest bin."""
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = defaultdict(list)
    free_set = 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = free_set >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                free_set &= ~(1 << free)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if free - n:
            by_free[free - n].append(b)
            free_set |= 1 << (free - n)
    return bins


class _Underfull:
    """Items of the bins that are neither empty nor full, found by length, and pairs of one bin by their sum.

    Bit sets of the lengths and sums in use find the longest that fits. A bin has
    at most about sqrt(2 * capacity) different lengths, so few sums.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int]):
        self.bins, self.lengths = bins, lengths
        self.items: dict[int, dict[int, int]] = defaultdict(dict)  # length -> item -> bin
        self.pairs: dict[int, dict[int, None]] = defaultdict(dict)  # sum -> bins
        self.singles = self.sums = 0

    def pair_sums(self, b: int) -> set[int]:
        count: dict[int, int] = defaultdict(int)
        for i in self.bins[b]:
            count[self.lengths[i]] += 1
        have = sorted(count)
        return {x + y for k, x in enumerate(have) for y in have[k:] if x < y or count[x] > 1}

    def add(self, b: int) -> None:
        for i in self.bins[b]:
            n = self.lengths[i]
            self.items[n][i] = b
            self.singles |= 1 << n
        for s in self.pair_sums(b):
            self.pairs[s][b] = None
            self.sums |= 1 << s

    def remove(self, b: int) -> None:
        for i in self.bins[b]:
            n = self.lengths[i]
            del self.items[n][i]
            if not self.items[n]:
                self.singles &= ~(1 << n)
        for s in self.pair_sums(b):
            del self.pairs[s][b]
            if not self.pairs[s]:
                self.sums &= ~(1 << s)

    def pair(self, b: int, total: int) -> list[int]:
        """Two items of a bin with this sum of lengths."""
        seen: dict[int, int] = {}
        for i in self.bins[b]:
            other = seen.get(total - self.lengths[i])
            if other is not None:
                return [other, i]
            seen[self.lengths[i]] = i
        raise KeyError(total)


def _step(a: int, under: _Underfull, room: int):
    """The exchange that moves most into bin ``a``: (gain, items leaving a, bin, its items) or None.

    A move of one or two, one for one, two of a's for one, or one of a's for two of another
    bin's; every fitting exchange with a bin in ``under`` is considered.
    """
    best, way = 0, None
    singles = {under.lengths[i]: i for i in under.bins[a]}
    outs = [(0, 0), *((n, 1) for n in singles), *((s, 2) for s in under.pair_sums(a))]
    for gone, k in outs:
        for two, bits in ((0, under.singles), (1, under.sums)):
            if two and k == 2:  # two for two is none of this search's
                continue
            fits = (bits & ((1 << (gone + room + 1)) - 1)).bit_length() - 1
            if fits - gone > best:
                best, way = fits - gone, (gone, k, two, fits)
                if best == room:
                    break
        if best == room:
            break
    if way is None:
        return None
    gone, k, two, fits = way
    out = [] if k == 0 else [singles[gone]] if k == 1 else under.pair(a, gone)
    if two:
        b = next(reversed(under.pairs[fits]))
        return best, out, b, under.pair(b, fits)
    item, b = next(reversed(under.items[fits].items()))
    return best, out, b, [item]


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Exchange or move items between underfull bins while the sum of squared fills grows; emptied bins go.

    The fullest bin takes from all that are less full, until nothing fits it any
    better; then the next. With ``d`` the tokens that change bins, the sum grows by
    ``2 d (fill_a - fill_b + d)``. The search ends when a whole pass over the bins finds no step.
    """
    bins = [list(b) for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    changed = True
    while changed:
        changed = False
        under = _Underfull(bins, lengths)
        queue = [(-f, b) for b, f in enumerate(fill) if 0 < f < capacity]
        for _, b in queue:
            under.add(b)
        heapq.heapify(queue)
        while queue:
            f, a = heapq.heappop(queue)
            if f != -fill[a] or not fill[a]:  # it has changed since, and waits at another place
                continue
            under.remove(a)
            while fill[a] < capacity and (step := _step(a, under, capacity - fill[a])):
                d, out, b, back = step
                under.remove(b)
                bins[a] = [i for i in bins[a] if i not in out] + back
                bins[b] = [i for i in bins[b] if i not in back] + out
                fill[a], fill[b], changed = fill[a] + d, fill[b] - d, True
                if bins[b]:
                    under.add(b)
                    heapq.heappush(queue, (-fill[b], b))
    return [b for b in bins if b]


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Item numbers by bin. Every length is from 1 to ``capacity``."""
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per piece: documents longer than ``capacity`` ids are cut, the last piece may be shorter.

    A null text is empty and has the end id alone. ``uid`` numbers the rows, so
    repeated documents stay apart.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, uid = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for big in batches:
            for batch in slices(big, "text"):
                ids, off = enc.encode(batch.column("text"))
                out = []
                for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    own = np.append(ids[off[i]:off[i + 1]], enc.dtype.type(end_id)).astype("<u4")
                    for piece, a in enumerate(range(0, len(own), capacity)):
                        part = own[a:a + capacity]
                        out.append((uid, doc_id, piece, a, len(part), zlib.crc32(part.tobytes())))
                        uid += 1
                cols = list(zip(*out))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)],
                                                 names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, PIECES)


def _pack_groups(pieces: DataFrame, capacity: int, groups: int, level: int) -> DataFrame:
    """``pieces`` with sequence_id, offset, and whether their sequence may be packed again with other groups'."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        lengths = table.column("length").to_pylist()
        group = table.column("group")[0].as_py()
        sequence, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
        bins = pack(lengths, capacity)
        for number, items in enumerate(bins):
            at = 0
            for i in items:
                sequence[i], offset[i] = (level << 58) + (group << 32) + number, at
                at += lengths[i]
            fill[items] = at
        spare = (fill <= capacity // 2) | (sequence == sequence[fill.argmin()])  # two sequences at most
        table = table.drop_columns(["group"])
        for name, column in (("sequence_id", sequence), ("offset", offset), ("spare", spare)):
            table = table.append_column(name, pa.array(column))
        return table

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(run, f"{schema}, sequence_id long, offset long, spare boolean")


def pack_pieces(pieces: DataFrame, capacity: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` (uid, length, ...) with sequence_id and offset, gapless from 0 in every sequence."""
    rest, done, level, groups = pieces, None, 0, None
    while True:
        wanted = max(1, -(-rest.count() // group_rows))
        groups = wanted if groups is None else min(wanted, groups // 2)
        packed = _pack_groups(rest, capacity, groups, level)
        if groups == 1:
            settled = packed.drop("uid", "spare")
            return settled if done is None else done.unionByName(settled)
        packed = save(packed, f"packed-{level}")
        settled = packed.where("not spare").drop("uid", "spare")
        rest = packed.where("spare").drop("sequence_id", "offset", "spare")
        done, level = settled if done is None else done.unionByName(settled), level + 1


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Cut and pack all documents; an empty table gives no rows, other columns are ignored."""
    pieces = save(token_pieces(docs, tokenizer, end_id, capacity), "pieces")
    return pack_pieces(pieces, capacity)
