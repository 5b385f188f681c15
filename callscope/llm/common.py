"""Shared pieces of the training-data operators: staging, word hashing on Arrow buffers, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import archive

CHUNK_BYTES = 1 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Stage:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    ``keep`` writes a frame and reads it back; ``drop`` deletes tables whose readers are done.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, archive.shared_dir(spark, name)
        self.tables: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_bucketed(self, df: DataFrame, name: str, by: str) -> DataFrame:
        """The same as a table of the warehouse, bucketed by a column: joins on it don't shuffle this side."""
        table = f"{self.root.rpartition('/')[2].replace('-', '_')}_{name}"
        df.write.bucketBy(parallelism(self.spark), by).format("parquet").saveAsTable(table)
        self.tables[name] = table
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
                continue
            archive.remove(self.spark, f"{self.root}/{name}")


#: Rows of a staged side that is broadcast.
SMALL = 1 << 18


def small(staged: DataFrame, limit: int = SMALL) -> DataFrame:
    """A staged frame, to be broadcast if its rows are few; else joins on it shuffle both of their sides."""
    return F.broadcast(staged) if staged.count() <= limit else staged


def unused(df: DataFrame, name: str) -> str:
    """A name that df has no column of."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- hashing

U = np.uint64
BASE, Q = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, U), np.full(size, inverse(base), U)
        up[0] = down[0] = 1
        _POWERS[base] = (np.cumprod(up), np.cumprod(down))
    up, down = _POWERS[base]
    return up[:n], down[:n]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A polynomial hash of values[start:end] for each span, independent of where the span lies. Good for counts; spans of equal hash needn't be equal."""
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + U(0x632BE59BD9B4E019) * (ends - starts).astype(U))


_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int) -> np.ndarray:
    """A hash of the bytes of each span, eight at a time, each mixed into what came before; spans of up to eight bytes and one length never share one."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    blocks = np.ndarray((len(data) + 1,), "<u8", padded.tobytes(), strides=(1,))
    left = ends - starts
    h, at, who = mix(left.astype(U) * U(BASE) + U(key)), starts, None
    while len(at):
        block = blocks[at] & _LOW_BYTES[np.minimum(left, 8)]
        if who is None:
            h = mix((h ^ block) * U(Q))
        else:
            h[who] = mix((h[who] ^ block) * U(Q))
        more = np.flatnonzero(left > 8)
        at, left, who = at[more] + 8, left[more] - 8, more if who is None else who[more]
    return h


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] = np.arange(97, 123)
#: Keys of the two hashes that words have: what must be equal, not only alike, is compared by both.
KEYS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of several texts: byte spans, 64-bit hashes, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool, white: np.ndarray = WHITE):
        self.data, self.offsets = data, offsets
        solid = ~white[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        before[:1], before[1:] = True, ~solid[:-1]
        after = np.empty(len(data), bool)
        after[-1:], after[:-1] = True, ~solid[1:]
        self.starts = np.flatnonzero(solid & (before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.folded = _FOLDED[data] if fold else data
        self.hashes = byte_hashes(self.folded, self.starts, self.ends, KEYS[0])

    def second_hashes(self) -> np.ndarray:
        """Independent of the first."""
        return byte_hashes(self.folded, self.starts, self.ends, KEYS[1])


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of a string column as (from, to, bytes, offsets), at most about CHUNK_BYTES each; null texts are empty.

    A single text longer than that is a run of its own.
    """
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values (len - k + 1 of them), each value mixed into what came before."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h = words[:n]
    for i in range(1, k):
        h = mix(h * U(Q) + words[i : i + n])
    return h


def shingle_sets(words: Words, k: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the sorted distinct hashes of its k-word shingles, and their second hashes; with fewer words, the whole sequence as one."""
    first = words.first
    both = words.hashes, words.second_hashes()
    grams, others = (gram_hashes(h, k) for h in both)
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            order = np.argsort(grams[a : b - k + 1])
            found, other = grams[a : b - k + 1][order], others[a : b - k + 1][order]
            new = np.concatenate(([True], (found[1:] != found[:-1]) | (other[1:] != other[:-1])))
            yield found[new], other[new]
        elif b > a:
            yield tuple(mix(gram_hashes(h[a:b], b - a) ^ U(b - a)) for h in both)
        else:
            yield np.zeros(0, U), np.zeros(0, U)


def cuts(bucket: np.ndarray, order: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The buckets that occur, and the places of each, for an order by bucket: as many as there are entries at most, however many buckets there are."""
    at = bucket[order]
    edges = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
    return at[edges].tolist(), np.split(order, edges[1:]) if len(at) else []


def runs_of(rows: np.ndarray, starts: np.ndarray, numbers: np.ndarray):
    """(row, starts, numbers) lists: for each owner its runs of windows, joined where they touch."""
    order = np.lexsort((starts, rows))
    rows, starts, ends = rows[order], starts[order], (starts + numbers)[order]
    if not len(rows):
        return [], [], []
    # Ends so far, of one owner: an owner's ends are lifted above all ends of the owners before.
    own = np.concatenate(([True], rows[1:] != rows[:-1]))
    lift = (own.cumsum() - 1) * (int(ends.max()) + 1)
    reach = np.maximum.accumulate(ends + lift) - lift
    new = np.flatnonzero(own | np.concatenate(([True], starts[1:] > reach[:-1])))
    first, number = starts[new], reach[np.append(new[1:], len(rows)) - 1] - starts[new]
    edges = np.flatnonzero(own[new])
    cut = lambda x: [part.tolist() for part in np.split(x, edges[1:])]
    return rows[new][edges].tolist(), cut(first), cut(number)


# ---------------------------------------------------------------- components


def forest(pairs: np.ndarray) -> np.ndarray:
    """A star forest with the components of the given (n, 2) pairs: rows (larger, smallest)."""
    ids, flat = np.unique(pairs, return_inverse=True)
    flat = flat.reshape(-1, 2)
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[flat[:, 0]], label[flat[:, 1]])
        new = label.copy()
        np.minimum.at(new, label[flat[:, 0]], low)
        np.minimum.at(new, label[flat[:, 1]], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    keep = label != np.arange(len(ids))
    return np.column_stack((ids[keep], ids[label[keep]]))


def _forests(batches):
    for batch in batches:
        pairs = np.column_stack((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if len(pairs):
            out = forest(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["u", "v"])


def fresh(name: str) -> Column:
    """The same integer, as an expression: a join on it deals out both of its sides anew, which adaptive execution can split.

    (A side that keeps an aggregate's partitioning can't be split where a key is hot.)
    """
    return F.col(name).bitwiseOR(F.lit(0).cast("long")).alias(name)


def components(stage: Stage, edges: DataFrame, name: str) -> DataFrame:
    """(node, component): for every node of the undirected edges (u, v: long) the smallest node that it reaches.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) over staged tables, after each task
    has reduced its own edges to a forest. Group minima are combined before their shuffle, and hot nodes only meet
    their minima in equi-joins that adaptive execution splits. Nodes without edges don't appear.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = stage.keep(pairs.mapInArrow(_forests, "u long, v long").distinct(), f"{name}-0")
    state, n = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first(), 0
    while state[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(fresh("u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(fresh("u"), "m")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        n += 1
        now = stage.keep(small.where("u <> v").distinct(), f"{name}-{n}")
        stage.drop(f"{name}-{n - 1}")
        last, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(last) == tuple(state):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
