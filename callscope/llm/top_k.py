"""Exact top-k search by pivot-table elimination.

Vectors are turned into integers. Distances of every vector to a fixed table of pivots are computed once; for a query q and a candidate x the
largest |d(q, p) - d(x, p)| over pivots p is a lower bound of d(q, x), and as q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2, an upper bound of the
inner product. Each query takes the candidates of a stripe in the order of that bound and stops, exactly, once the k-th best product is above the next bound.

Queries are a stated set: blocks of queries meet blocks of candidates. Vectors near the same pivot share blocks, so the ranges of a block's distances bound all
of its products: blocks that can't reach the k-th best product that each query has within the sample of the pivots are left out before anything is shuffled.
Only the k best of each query and stripe go on, and the k best of these are the answer.
Pivots come from a sample of bounded size (`SAMPLE` vectors, by a hash of vec_id); they decide how much is skipped, never what is found.

Cases: vectors that are null, empty or hold null or non-finite components take no part, however large finite ones may be; products beyond 64 bits are
the nearest 64-bit integer; only vectors of the query's length are candidates; ties go to the smaller vec_id; repeated rows are queries and candidates
each, but none is a candidate of a query with its own vec_id; rows with a null vec_id take no part; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, load
from .vectors import blobs, matrix_of, slices, usable

K, EVERY, SCALE = 5, 50, 256
SAMPLE, PIVOTS, QUERIES, CANDIDATES, STRIPE = 1024, 32, 256, 4096, 8
#: The largest finite double.
MOST = np.finfo(np.float64).max
#: Shares of squared lengths, and of distances, that rounding errors stay below.
SHARE, GAP = 1e-9, 1e-12


def _integers(batches):
    for batch in slices(batches):
        named = np.asarray(batch.column(0).is_valid())
        for rows, matrix in usable(batch.column(1)):
            rows, matrix = rows[named[rows]], matrix[named[rows]]
            if len(rows):
                with np.errstate(over="ignore"):
                    whole = np.clip(np.floor(matrix * SCALE), -MOST, MOST)
                width = pa.array(np.full(len(rows), matrix.shape[1], np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), width, blobs(whole + 0.0)], ["vec_id", "width", "raw"])


def pivots(sample: np.ndarray, number: int = PIVOTS) -> np.ndarray:
    """Vectors of the sample that lie far from each other (farthest first)."""
    sample = np.unique(sample, axis=0).astype(np.float64)
    chosen = [0]
    with np.errstate(over="ignore"):
        far = np.linalg.norm(sample - sample[0], axis=1)
        while len(chosen) < min(number, len(sample)):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _small(*matrices: np.ndarray) -> bool:
    """Whether all sums of products are integers that doubles hold exactly, squared distances, too."""
    most = max(float(np.abs(m).max(initial=0)) for m in matrices)
    return most < (2.0**50 / max(m.shape[1] for m in matrices)) ** 0.5


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Euclidean distances, with a rounding error of far less than GAP of them."""
    if _small(x, p):
        return np.sqrt((x**2).sum(1)[:, None] + (p**2).sum(1) - 2 * x @ p.T)
    with np.errstate(over="ignore", invalid="ignore"):
        return np.column_stack([np.linalg.norm(x - one, axis=1) for one in p])


def _exact(*matrices: np.ndarray) -> list[np.ndarray]:
    """Matrices whose products are exact: doubles, 64-bit integers or, beyond, integers of any size."""
    if _small(*matrices):
        return list(matrices)
    most = [float(np.abs(m).max(initial=0)) for m in matrices]
    if max(most) < 2.0**62 and max(most) * min(most) * matrices[0].shape[1] < 2.0**62:
        return [m.astype(np.int64) for m in matrices]
    return [np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape) for m in matrices]


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers, the nearest there is for larger ones."""
    scores = x @ q
    if scores.dtype == object:
        scores = np.array([max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in scores], np.int64)
    return scores.astype(np.int64)


def bounds(squares, own, low) -> np.ndarray:
    """Upper bounds of inner products from squared lengths and least distances; what can't be told is no bound."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num((own + squares - low**2) / 2 + SHARE * (own + squares) + 1, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores in descending order, ties by smaller id."""
    if len(scores) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, ~scores))[:k]  # ~x falls as x rises, and stays in the range
    return scores[order], ids[order]


class Table:
    """The sample by length of vector, with its pivots; goes along with the tasks (at most SAMPLE vectors)."""

    def __init__(self, ids: np.ndarray, raw: list[bytes], k: int):
        self.k, self.sample, self.points = k, {}, {}
        widths = np.array([len(r) // 8 for r in raw], np.int64)
        for width in np.unique(widths).tolist():
            own = np.flatnonzero(widths == width)
            self.sample[width] = ids[own], matrix_of([raw[i] for i in own], np.float64, width)
            self.points[width] = pivots(self.sample[width][1])

    def far(self, x: np.ndarray) -> np.ndarray:
        """Distances to the pivots (to the origin where the sample has no vector of this length)."""
        return distances(x, self.points.get(x.shape[1], np.zeros((1, x.shape[1]))))

    def reached(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For each query what its k-th best product is at least: the k-th best in the sample."""
        others, x = self.sample.get(q.shape[1], (np.zeros(0, np.int64), np.zeros((0, q.shape[1]))))
        if len(x) < self.k:
            return np.full(len(q), -np.inf)
        with np.errstate(over="ignore", invalid="ignore"):
            scores = q @ x.T - SHARE * ((q**2).sum(1)[:, None] + (x**2).sum(1)) - 1
            scores[(ids[:, None] == others) | np.isnan(scores)] = -np.inf
        return np.minimum(np.partition(scores, len(x) - self.k, axis=1)[:, len(x) - self.k], 2.0**63 - 1024)  # what ties at the end of the range must be met


def _near(table: Table):
    """Adds the number of the nearest pivot."""

    def run(batches):
        for batch in batches:
            widths, raw = batch.column("width").to_numpy(), batch.column("raw").to_pylist()
            near = np.zeros(batch.num_rows, np.int32)
            for width in np.unique(widths).tolist():
                own = np.flatnonzero(widths == width)
                near[own] = np.nan_to_num(table.far(matrix_of([raw[i] for i in own], np.float64, width)), nan=np.inf).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], [*batch.schema.names, "near"])

    return run


_BLOCK = "width int, block long, kind string, rows binary, ids binary, raw binary, far binary, low array<double>, high array<double>, most double, need double"


def _block(table: Table, queries: bool):
    """The rows of one block as one row, with the ranges of its distances and the most that any of its squared lengths is."""

    def run(rows: pa.Table) -> pa.Table:
        width, ids = rows["width"][0].as_py(), rows["vec_id"].to_numpy()
        x = matrix_of(rows["raw"].to_pylist(), np.float64, width)
        far = table.far(x)
        kind = "<i4" if np.abs(x).max(initial=0) < 1 << 31 else "<f8"
        known = np.nan_to_num(far, nan=np.inf)  # a distance that can't be told bounds nothing
        low, high = np.where(np.isfinite(known), known, 0.0).min(0), known.max(0)
        with np.errstate(over="ignore"):
            most = float((x**2).sum(1).max())
        need = float(table.reached(x, ids).min()) if queries else None
        values = [width, rows["block"][0].as_py(), kind, rows["row"].to_numpy().tobytes(), ids.tobytes(), x.astype(kind).tobytes(), far.tobytes(), low.tolist(), high.tolist(), most, need]
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
        columns = [c.split() for c in _BLOCK.split(", ")]
        return pa.table([pa.array([v], kinds[t]) for v, (_, t) in zip(values, columns, strict=True)], [c for c, _ in columns])

    return run


def _matrices(blocks: pa.Table):
    """vectors, distances, vec_ids and row numbers of several blocks."""
    rows = blocks.select(["width", "kind", "rows", "ids", "raw", "far"]).to_pylist()
    x = np.concatenate([matrix_of([r["raw"]], r["kind"], r["width"]).astype(np.float64) for r in rows])
    ids, numbers = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("ids", "rows"))
    return x, np.concatenate([np.frombuffer(r["far"], np.float64) for r in rows]).reshape(len(x), -1), ids, numbers


def _search(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if queries.num_rows and candidates.num_rows:
            (q, qd, qi, qn), (x, xd, xi, _) = _matrices(queries), _matrices(candidates)
            with np.errstate(over="ignore"):
                squares, own_squares = ((v**2).sum(1) for v in (x, q))
            x, q = _exact(x, q)
            xd = np.ascontiguousarray(xd.T)
            for i in range(len(q)):
                low = np.zeros(len(x))
                with np.errstate(invalid="ignore"):
                    for far, d in zip(xd, qd[i], strict=True):
                        np.fmax(low, np.abs(far - d) - GAP * (far + d), out=low)
                bound = bounds(squares, own_squares[i], low)
                order = np.argsort(-bound)
                scores, ids, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 256
                while at < len(order) and (len(scores) < k or bound[order[at]] >= float(scores[-1])):
                    part = order[at : at + step]
                    part = part[xi[part] != qi[i]]
                    scores, ids = _best(np.concatenate((scores, _products(x[part], q[i]))), np.concatenate((ids, xi[part])), k)
                    at, step = at + step, 2 * step
                out += zip([int(qn[i])] * len(ids), [int(qi[i])] * len(ids), ids.tolist(), scores.tolist(), strict=True)
        return pa.table([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], ["row", "query_id", "vec_id", "score"])

    return run


def block_pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(width, q, block): blocks whose products may reach what the queries of a block need."""
    side = lambda df, s: df.select("width", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "low", "high", "most", "need")))
    met = side(queries, "q").join(side(candidates, "x"), "width")
    apart = lambda r: F.greatest(r["low_q"] - r["high_x"], r["low_x"] - r["high_q"]) - GAP * (r["high_q"] + r["high_x"])
    gap = F.greatest(F.array_max(F.transform(F.arrays_zip("low_q", "high_q", "low_x", "high_x"), apart)), F.lit(0.0))
    both = F.col("most_q") + F.col("most_x")
    bound = (both - gap * gap) / 2 + SHARE * both + 1
    return met.where(F.isnan(bound) | (bound >= F.col("need_q"))).select("width", F.col("block_q").alias("q"), F.col("block_x").alias("block"))


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """rows with the number of their block: about `size` rows of one length, whose nearest pivots are the same or have neighbouring numbers."""
    order = Window.partitionBy("width").orderBy("near").rowsBetween(Window.unboundedPreceding, -1)
    shares = rows.groupBy("width", "near").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0)))
    met = rows.join(F.broadcast(shares), ["width", "near"])  # a row for each pivot and length
    return met.withColumn("block", F.expr(f"(first + pmod(xxhash64(row), n)) div {size}"))


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each row for which `is_query` holds, against all other rows."""
    stage = Stage(vectors.sparkSession, "top_k")
    whole = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_integers, "vec_id long, width int, raw binary")
    sample = whole.orderBy(F.xxhash64("vec_id"), "vec_id", "raw").limit(SAMPLE).collect()
    table = Table(np.array([r["vec_id"] for r in sample], np.int64), [r["raw"] for r in sample], k)
    near = whole.mapInArrow(_near(table), "vec_id long, width int, raw binary, near int")
    rows = stage.keep(near.select("*", F.monotonically_increasing_id().alias("row")), "rows")
    blocked = lambda df, size, queries: _dealt(df, size).groupBy("width", "block").applyInArrow(_block(table, queries), _BLOCK)
    asked = stage.keep(blocked(rows.where(is_query), QUERIES, True), "queries")
    given = stage.keep(blocked(rows, CANDIDATES, False), "candidates")
    pairs = stage.keep(block_pairs(asked, given).withColumn("stripe", F.expr(f"block div {STRIPE}")), "pairs")
    blobs_of = lambda df, name: df.select("width", F.col("block").alias(name), "kind", "rows", "ids", "raw", "far")
    left = blobs_of(asked, "q").join(pairs.select("width", "q", F.col("stripe").alias("part")).distinct(), ["width", "q"])
    right = blobs_of(given, "block").join(pairs, ["width", "block"])
    found = left.groupBy("width", "q", "part").cogroup(right.groupBy("width", "q", "stripe")).applyInArrow(_search(k), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9(spark, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
