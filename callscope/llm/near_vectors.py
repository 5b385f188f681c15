"""Embedding near-dedup: int8 quantised tile products with rigorous error bounds, exact recomputation of what may link.

Equal vectors of a label are one class. Classes are dealt by ranges of (label, projection) and cut into tiles of at most `TILE` neighbouring vectors, with
the box of their projections on a few orthonormal directions; boxes that are too far apart for any link are never multiplied.
A unit vector u is s * c + e with an int8 code c, so |u.v - s t c.d| <= |s c| |f| + |e| for v = t d + f; only pairs whose bound
reaches the threshold are recomputed in double precision. Code products are exact integers in float32 (float64 for long vectors).

A pair of tiles yields the number of links of each vector and a spanning forest of them, never the links of a dense group one by one.
Classes and tiles go by numbers of their own, so that rows may share a vec_id.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and null labels, link with nothing; vectors of different
lengths don't link; labels of any type are compared as text; repeated rows are vectors that link with each other; rows that share a vec_id but no
vector link as any other two; rows with a null vec_id link with nothing (component null); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, components, forest, fresh, load, parallelism
from .vectors import matrix_of, slices, usable

THRESHOLD, TILE, DIRECTIONS = 0.98, 1024, 8
SLACK = 1e-9


def _directions(width: int) -> np.ndarray:
    """Fixed orthonormal directions (columns)."""
    return np.linalg.qr(np.random.default_rng(width).standard_normal((width, min(width, DIRECTIONS))))[0]


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Rows whose squares would over- or underflow, multiplied by a power of two: angles stay as they are."""
    exponent = np.frexp(np.abs(matrix).max(1))[1]
    far = np.abs(exponent) > 400
    return np.where(far[:, None], np.ldexp(matrix, -exponent[:, None]), matrix) if far.any() else matrix


def _keys(batches):
    """vec_id, label, width, key, first projection and raw components of every row; width is null where the row can't link."""
    for batch in slices(batches):
        n = batch.num_rows
        width, key, place, raw = [None] * n, [None] * n, [None] * n, [None] * n
        named = np.asarray(batch.column(0).is_valid()) & np.asarray(batch.column(1).is_valid())
        for rows, matrix in usable(batch.column(2)):
            matrix = scaled(matrix)
            length = np.linalg.norm(matrix, axis=1)
            matrix = matrix + 0.0  # one zero
            fine = named[rows] & (length > 0) & np.isfinite(length)
            first = (matrix[fine] @ _directions(matrix.shape[1])[:, :1])[:, 0] / length[fine]
            for i, p, vector in zip(rows[fine].tolist(), first.tolist(), matrix[fine], strict=True):
                width[i], place[i], raw[i] = len(vector), p, vector.tobytes()
                key[i] = hashlib.md5(raw[i]).hexdigest()
        arrays = pa.array(width, pa.int32()), pa.array(key, pa.string()), pa.array(place, pa.float64()), pa.array(raw, pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["vec_id", "label", "width", "key", "place", "raw"])


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, lengths of scale * code, and lengths of the error (rounded up)."""
    scale = np.abs(unit).max(1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    near = code * scale[:, None]
    return code, scale, np.linalg.norm(near, axis=1) * (1 + SLACK), np.linalg.norm(unit - near, axis=1) * (1 + SLACK) + 1e-15


def _split(points: np.ndarray, rows: np.ndarray):
    """Rows in groups of at most TILE, by halving at the median of the widest projection."""
    if len(rows) <= TILE:
        yield rows
        return
    own = points[rows]
    order = rows[np.argsort(own[:, np.ptp(own, axis=0).argmax()], kind="stable")]
    yield from _split(points, order[: len(order) // 2])
    yield from _split(points, order[len(order) // 2 :])


_TILE_COLUMNS = "label string, width int, tile long, low array<double>, high array<double>, ids binary, copies binary, codes binary, bounds binary, raw binary"

_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
_TILE = pa.schema([(name, _KINDS[kind]) for name, kind in (column.split() for column in _TILE_COLUMNS.split(", "))])


def _tile_rows(label: str, width: int, ids: list[int], copies: list[int], raw: list[bytes]):
    ids, copies, raw = np.array(ids, np.int64), np.array(copies, np.int64), matrix_of(raw, np.float64, width)
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    points = unit @ _directions(width)
    code, scale, near, error = quantised(unit)
    bounds = np.column_stack((scale, near, error))
    for rows in _split(points, np.arange(len(ids))):
        yield {
            "label": label, "width": width, "tile": int(ids[rows].min()), "low": points[rows].min(0).tolist(), "high": points[rows].max(0).tolist(), "ids": ids[rows].tobytes(),
            "copies": copies[rows].tobytes(), "codes": code[rows].tobytes(), "bounds": bounds[rows].tobytes(), "raw": raw[rows].tobytes(),
        }


def _tiles(batches):
    held: dict[tuple[str, int], tuple[list, list, list]] = {}
    for batch in slices(batches):
        for label, width, number, copies, raw in zip(*(batch.column(c).to_pylist() for c in ("label", "width", "number", "copies", "raw")), strict=True):
            if (label, width) not in held:  # rows come sorted by label and width: what is held before is complete
                for key, lists in held.items():
                    yield from (pa.RecordBatch.from_pylist([x], _TILE) for x in _tile_rows(*key, *lists))
                held = {(label, width): ([], [], [])}
            lists = held[label, width]
            for values, value in zip(lists, (number, copies, raw), strict=True):
                values.append(value)
            if len(lists[0]) >= 32 * TILE:
                yield from (pa.RecordBatch.from_pylist([x], _TILE) for x in _tile_rows(label, width, *lists))
                held = {}
    for key, lists in held.items():
        yield from (pa.RecordBatch.from_pylist([x], _TILE) for x in _tile_rows(*key, *lists))


def _linked(a: dict, b: dict, width: int, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of the pairs that link."""
    kind = np.float32 if width * 127 * 127 < 1 << 24 else np.float64
    (sa, na, ea), (sb, nb, eb) = a["bounds"].T, b["bounds"].T
    i, j = [], []
    for at in range(0, len(sa), 256):
        part = slice(at, at + 256)
        product = (a["codes"][part].astype(kind) @ b["codes"].astype(kind).T).astype(np.float64)
        most = product * sa[part, None] * sb + na[part, None] * eb + ea[part, None]
        x, y = np.nonzero(most >= threshold - SLACK)
        x += at
        if same:
            x, y = x[x < y], y[x < y]
        for k in range(0, len(x), 1 << 14):
            p, q = x[k : k + (1 << 14)], y[k : k + (1 << 14)]
            u, v = a["raw"][p], b["raw"][q]
            cosine = np.einsum("ij,ij->i", u, v) / (np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1))
            i.append(p[cosine >= threshold]), j.append(q[cosine >= threshold])
    return (np.concatenate(i), np.concatenate(j)) if i else (np.zeros(0, np.int64),) * 2


def _products(threshold: float):
    """(u, null, links): links that this pair of tiles adds to u; (u, v, null): an edge of the forest."""

    def run(batches):
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            width = row["width"]
            a, b = (
                {
                    "ids": np.frombuffer(row[f"ids_{s}"], np.int64), "copies": np.frombuffer(row[f"copies_{s}"], np.int64), "codes": matrix_of([row[f"codes_{s}"]], np.int8, width),
                    "bounds": matrix_of([row[f"bounds_{s}"]], np.float64, 3), "raw": matrix_of([row[f"raw_{s}"]], np.float64, width),
                }
                for s in "ab"
            )
            i, j = _linked(a, b, width, row["tile_a"] == row["tile_b"], threshold)
            if not len(i):
                continue
            left, right = np.bincount(i, b["copies"][j], len(a["ids"])).astype(np.int64), np.bincount(j, a["copies"][i], len(b["ids"])).astype(np.int64)
            u, links = np.concatenate((a["ids"][left > 0], b["ids"][right > 0])), np.concatenate((left[left > 0], right[right > 0]))
            edges = forest(np.column_stack((a["ids"][i], b["ids"][j])))
            none = lambda n: pa.nulls(n, pa.int64())
            columns = (pa.array(u), pa.array(edges[:, 0])), (none(len(u)), pa.array(edges[:, 1])), (pa.array(links), none(len(edges)))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["u", "v", "links"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    stage, parts = Stage(spark, "vectors"), parallelism(spark)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    keyed = stage.keep(rows.mapInArrow(_keys, "vec_id long, label string, width int, key string, place double, raw binary"), "rows")
    own = keyed.where("width is not null").groupBy("label", "width", "key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("place").alias("place"), F.first("raw").alias("raw"))
    classes = stage.keep(own.select("*", F.monotonically_increasing_id().alias("number")), "classes")
    dealt = classes.repartitionByRange(parts, "label", "width", "place").sortWithinPartitions("label", "width", "place", "number")
    tiles = stage.keep(dealt.mapInArrow(_tiles, _TILE_COLUMNS), "tiles")
    side = lambda s: tiles.select("label", "width", *(F.col(c).alias(f"{c}_{s}") for c in ("tile", "low", "high")))
    gap = F.aggregate(F.arrays_zip("low_a", "high_a", "low_b", "high_b"), F.lit(0.0), lambda s, x: s + F.pow(F.greatest(x["low_a"] - x["high_b"], x["low_b"] - x["high_a"], F.lit(0.0)), 2))
    met = side("a").join(side("b"), ["label", "width"]).where("tile_a <= tile_b").where(gap <= 2 - 2 * threshold + 1e-6).select("label", "width", "tile_a", "tile_b")
    blob = lambda s: tiles.select("label", "width", *(F.col(c).alias(f"{c}_{s}") for c in ("tile", "ids", "copies", "codes", "bounds", "raw")))
    pairs = met.repartition(4 * parts, "tile_a", "tile_b").join(blob("a"), ["label", "width", "tile_a"]).join(blob("b"), ["label", "width", "tile_b"])
    found = stage.keep(pairs.mapInArrow(_products(threshold), "u long, v long, links long"), "found")
    linked = components(stage, found.where("v is not null").select("u", "v"), "components").select(F.col("node").alias("number"), "component")
    placed = stage.keep(linked.join(classes.select("number", "least"), "number"), "placed")
    named = placed.select("number", "component").join(placed.groupBy("component").agg(F.min("least").alias("component_id")).select(fresh("component"), "component_id"), "component").drop("component")
    links = found.where("v is null").groupBy("u").agg(F.sum("links").alias("links")).select(fresh("u").alias("number"), "links")
    known = classes.select("label", "width", "key", "number", "least", "copies").join(links, "number", "left").join(named, "number", "left")
    known = stage.keep(known.select("label", "width", "key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "known")
    stage.drop("tiles", "found", "classes", "placed")
    out = keyed.select("vec_id", "label", "width", "key").join(known, ["label", "width", "key"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op2(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "embeddings"))
