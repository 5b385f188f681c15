"""Best-fit packing by bin completion over the histogram of lengths.

Lengths are at most the capacity, so their histogram is bounded whatever the size of the corpus. The search runs on it, from the packing of best
fit as the first one known: around the largest length left it enumerates the undominated fillings of the rest of the sequence, those with the
least waste first, takes one of them as often as the counts allow or once, and goes on as long as the waste so far and the lower bound of
what is left can beat the best packing known (branch and bound).
The plan then says which sequence the r-th piece of each length goes to; ranks come from grouped counts, so no
task sees all pieces of a common length.

Cases: null and empty texts are one piece of one token; repeated rows are packed each; rows with a null id are packed too; an
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import neg

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, load, parallelism
from .tokens import encode_documents, little_endian

CAPACITY = 2048

Pattern = tuple[tuple[int, ...], int]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The larger of the bound by volume and Martello and Toth's L2."""
    size = np.arange(capacity + 1)
    number, volume = np.concatenate(([0], counts.cumsum())), np.concatenate(([0], (counts * size).cumsum()))
    half = capacity // 2
    a = np.arange(half + 1)
    big, middle = number[-1] - number[capacity - a + 1], number[capacity - a + 1] - number[half + 1]
    room = middle * capacity - (volume[capacity - a + 1] - volume[half + 1])
    rest = np.maximum(0, -(-(volume[half + 1] - volume[a] - room) // capacity))
    return max(-(-int(volume[-1]) // capacity), int((big + middle + rest).max()))


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """The packing that gives each length, the largest first, to the sequence where it leaves the least room."""
    open_, rooms = {}, 0  # sequences by their room: (pattern, how many), and the rooms there are as bits

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        nonlocal rooms
        if times:
            open_.setdefault(room, []).append((pattern, times))
            rooms |= 1 << room

    for s in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[s])
        while left:
            above = rooms >> s
            room = s + (above & -above).bit_length() - 1 if above else capacity
            pattern, times = open_[room].pop() if above else ((), left)
            if above and not open_[room]:
                rooms ^= 1 << room
            fits = room // s
            full = min(times, left // fits)
            put(room - fits * s, pattern + (s,) * fits, full)
            times, left = times - full, left - full * fits
            if times and left and left < fits:  # what is left goes into one more
                put(room - left * s, pattern + (s,) * left, 1)
                times, left = times - 1, 0
            if above:
                put(room, pattern, times)
    return [x for group in open_.values() for x in group]


def _undominated(filling: tuple[int, ...], slack: int, free: int) -> bool:
    """Whether no free length (a bit of `free`) can take the place of some of the filling, or of nothing, without being shorter than these or too long.

    A free length that equals a single one of the filling changes nothing.
    """
    one, more = 1, 0  # sums of at most one of the filling, and of several
    for s in filling:
        more |= (more | (one & ~1)) << s
        one |= 1 << s
    return not more & free and not any((one | more) << d & free for d in range(1, slack + 1))


def fillings(counts: np.ndarray, room: int) -> Iterator[tuple[int, ...]]:
    """The undominated fillings of `room` with the lengths there are, those with the least waste first.

    One length that fits exactly dominates every other filling. Otherwise sums that can be reached (as bits of an integer, over
    suffixes of the lengths in descending order) lead the way, and larger lengths are tried first.
    """
    if room <= 0 or not counts[1 : room + 1].any():
        yield ()
        return
    if counts[room]:
        yield (room,)
        return
    sizes = [int(s) for s in np.flatnonzero(counts[: room + 1])[::-1] if s]
    reach, mask = [1], (1 << (room + 1)) - 1
    for s in reversed(sizes):
        bits, left, step = reach[-1], min(int(counts[s]), room // s), 1
        while left:
            bits |= bits << (s * min(step, left)) & mask
            left -= min(step, left)
            step *= 2
        reach.append(bits)
    reach.reverse()
    for total in range(reach[0].bit_length() - 1, 0, -1):
        if not reach[0] >> total & 1:
            continue
        todo = [(0, total, (), room)]  # from the i-th length on: the rest to fill, what is taken, how often the next length is at most
        while todo:
            i, rest, taken, limit = todo.pop()
            if not rest:
                used = Counter(taken)
                free = sum(1 << s for s in sizes if counts[s] > used[s])
                if _undominated(taken, room - total, free):
                    yield taken
                continue
            i = bisect_left(sizes, -rest, i, key=neg)  # lengths over the rest are passed at once
            if i < len(sizes) and reach[i] >> rest & 1:
                s = sizes[i]
                n = min(int(counts[s]), rest // s, limit)
                if n:
                    todo.append((i, rest, taken, n - 1))
                todo.append((i + 1, rest - n * s, taken + (s,) * n, room))


class _State:
    """A node of the search: what is left, what was used and wasted on the way, and how many of its branches were taken."""

    def __init__(self, counts: np.ndarray, before: _State | None = None, use: Pattern | None = None, number: int = 0, waste: int = 0):
        self.counts, self.before, self.use, self.number, self.waste = counts, before, use, number, waste
        self.taken, self.branches = 0, None

    def _all(self, capacity: int) -> Iterator[tuple[Pattern, np.ndarray]]:
        counts, top = self.counts.copy(), int(np.flatnonzero(self.counts)[-1])
        counts[top] -= 1
        for filling in fillings(counts, capacity - top):
            pattern = (top, *filling)
            sizes, uses = np.unique(pattern, return_counts=True)
            most = int((self.counts[sizes] // uses).min())
            exact = len(filling) < 2 and sum(pattern) == capacity  # dominates all others, as often as it can be had
            for times in dict.fromkeys([most] if exact else [most, 1]):
                left = self.counts.copy()
                left[sizes] -= uses * times
                yield (pattern, times), left

    def next(self, capacity: int) -> _State | None:
        """The next branch, if there is one. Nodes that aren't the last of a path keep no enumeration, only their place in it."""
        if self.branches is None:
            self.branches = islice(self._all(capacity), self.taken, None)
        found = next(self.branches, None)
        if found is None:
            return None
        self.taken += 1
        (pattern, times), left = found
        return _State(left, self, found[0], self.number + times, self.waste + times * (capacity - sum(pattern)))

    def plan(self) -> list[Pattern]:
        out, state = [], self
        while state.use:
            out.append(state.use)
            state = state.before
        return out[::-1]


def pack(counts: np.ndarray, capacity: int = CAPACITY, effort: int = 10_000) -> list[Pattern]:
    """(lengths of one sequence, how many such sequences): uses counts[s] pieces of every length s exactly.

    Without the limit of `effort` nodes the packing has as few sequences as there can be. Deep branches come first; what lies below a
    node whose waste, or whose sequences and lower bound, leave no hope to beat the best packing known is left out.
    """
    best, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    fewest, volume = sum(times for _, times in best), int((counts * np.arange(capacity + 1)).sum())
    path, nodes = [_State(counts.astype(np.int64))] if fewest > bound else [], 0
    while path and fewest > bound and nodes < effort + len(best):
        state, nodes = path[-1].next(capacity), nodes + 1
        if state is None:
            path.pop()
        elif not state.counts.any():
            if state.number < fewest:
                best, fewest = state.plan(), state.number
        elif state.waste <= (fewest - 1) * capacity - volume and state.number + lower_bound(state.counts, capacity) < fewest:
            path[-1].branches = None
            path.append(state)
    return best


def places(plan: list[Pattern]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted keys (length << 40 | first rank): the sequence of that rank, and the offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan:
        at = 0
        for size in pattern:
            rank = used.get(size, 0)
            rows.append((size << 40 | rank, sequence, at))
            used[size] = rank + times
            at += size
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    first = n - (-(-n // capacity) - 1) * capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(capacity: int):
    def finish(keys: pa.Array, rows: list[list[int]]) -> pa.RecordBatch:
        owner, number, start, length, crc = [], [], [], [], []
        for k, ids in enumerate(rows):
            raw = little_endian([*ids, 0])
            for p, (s, n) in enumerate(cut(len(ids) + 1, capacity)):
                owner.append(k), number.append(p), start.append(s), length.append(n), crc.append(zlib.crc32(raw[4 * s : 4 * (s + n)]))
        arrays = [keys.take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return finish


def _assign(plan: list[Pattern]):
    keys, sequences, offsets = places(plan)

    def run(batches):
        for batch in batches:
            key = (batch.column("length").to_numpy() << 40) | batch.column("rank").to_numpy()
            at = np.searchsorted(keys, key, "right") - 1
            found = [pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])] if len(key) else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *found], [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    spark = docs.sparkSession
    stage = Stage(spark, "packing")
    pieces = stage.keep(encode_documents(docs, _pieces(capacity), "piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[row[0]] = row[1]
    plan = pack(counts, capacity)
    groups = 8 * parallelism(spark)
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("length", "group").count().select("length", "group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("length", "group").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(first, ["length", "group"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("r") - 1).alias("rank"))
    return ranked.mapInArrow(_assign(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6(spark, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))
