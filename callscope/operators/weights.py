"""The node weight machine as a segmented associative scan.

An attempt is a map of a node's state: affine for its mean success and mean latency, a shift between two bounds for its weight, and a reset or a step for its failures in a
row. Maps compose, so attempts are sorted into segments that lie anywhere in a node's history, each segment's composed map is found by itself, a
fold over one row for each segment gives every segment the state that it begins in, and the states inside it follow from there. Only a successful
probe at a weight of zero or less breaks the family of maps: it sets the weight. A segment's weight is therefore a few pieces, by the weight it begins with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import archive

#: Fixed values of the two rules that weigh nodes.
RULES = {
    1: {"bonus": 0.45, "divisor": 2500.0, "cap": 0.6, "gain": None, "base": 0.9, "step": 0.35, "first": 0, "most": None, "low": -12.0, "high": 12.0, "probe": 0.4, "floor": 0.6, "to": 0.3},
    2: {"bonus": 0.55, "divisor": 9000.0, "cap": 0.35, "gain": 0.08, "base": 0.5, "step": 0.18, "first": 1, "most": 1.2, "low": -8.0, "high": 8.0, "probe": 0.55, "floor": 0.25, "to": 0.25},
}
#: Weight, failures in a row, mean success, mean latency of a new node.
START = (0.7, 0, None, None)
#: Attempts of a segment.
SEGMENT = 2048
RATE, MEAN = (0.9, 0.1), (0.8, 0.2)


def weigh(state: tuple, success: bool, latency: float | None, probe: bool, rule: int = 2) -> tuple:
    """The rule itself: the next state of a node after one attempt, as a live node takes it."""
    weight, failures, rate, mean = state
    r = RULES[rule]
    rate = float(success) if rate is None else RATE[0] * rate + RATE[1] * success
    if success:
        if latency is not None and latency == latency:
            mean = latency if mean is None else MEAN[0] * mean + MEAN[1] * latency
        penalty = 0.0 if mean is None else min(mean / r["divisor"], r["cap"])
        weight += r["bonus"] - penalty if r["gain"] is None else max(r["bonus"] - penalty, r["gain"])
        failures = 0
        if probe and weight <= 0:
            weight = r["probe"]
    else:
        failures += 1
        loss = r["base"] + r["step"] * (failures - 1 + r["first"])
        weight -= loss if r["most"] is None else min(loss, r["most"])
    weight = min(max(weight, r["low"]), r["high"])
    return (max(weight, r["to"]) if success and weight < r["floor"] else weight), failures, rate, mean


# ---------------------------------------------------------------- scans of one segment


def affine(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Composed maps x -> a x + b of each prefix, in log(n) steps."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a):
        b[step:] += a[step:] * b[:-step]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return a, b


def clamped(d: np.ndarray, low: np.ndarray, high: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Composed maps w -> min(max(w + d, low), high) of each prefix that begins where `new` is true."""
    d, low, high, new, step = d.copy(), low.copy(), high.copy(), new.copy(), 1
    while step < len(d):
        go = np.flatnonzero(~new[step:]) + step
        before = go - step
        bounds = low[go], high[go]
        low_, high_ = (np.clip(x[before] + d[go], *bounds) for x in (low, high))
        d_, new_ = d[before] + d[go], new[before]
        d[go], low[go], high[go], new[go] = d_, low_, high_, new_
        step *= 2
    return d, low, high


def _running(keep: float, gain: float, values: np.ndarray, at: np.ndarray, seed: float | None) -> np.ndarray:
    """The moving mean after each row: values count where `at`; NaN before the first of all."""
    a, b = np.where(at, keep, 1.0), np.where(at, gain * values, 0.0)
    first = np.flatnonzero(at)[:1]
    if seed is None and len(first):
        a[first], b[first] = 0.0, values[first]
    a, b = affine(a, b)
    known = b if seed is None else a * seed + b
    if seed is None:
        known[: first[0] if len(first) else len(known)] = np.nan
    return known


def _failures(ok: np.ndarray, seed: int) -> np.ndarray:
    """Failures in a row after each row."""
    at = np.arange(len(ok))
    last = np.maximum.accumulate(np.where(ok, at, -1))
    return np.where(last >= 0, at - last, at + 1 + seed)


class Segment:
    """Attempts of a node, in order, and what they do to a state."""

    def __init__(self, ok, latency, probe, rule: int):
        self.ok, self.probe, self.r = np.array(ok, bool), np.array(probe, bool), RULES[rule]
        self.latency = np.array([np.nan if x is None else x for x in latency], float)
        self.timed = self.ok & ~np.isnan(self.latency)

    def first_summary(self) -> dict:
        """Maps of the means and the failures: with a state before, and without one."""
        rate, mean, timed = self.ok.astype(float), np.nan_to_num(self.latency), self.timed
        out = {"tail": int(_failures(self.ok, 0)[-1]), "any": bool(self.ok.any()), "timed": bool(timed.any())}
        for name, (keep, gain), values, at in (("rate", RATE, rate, np.ones(len(rate), bool)), ("mean", MEAN, mean, timed)):
            a, b = affine(np.where(at, keep, 1.0), np.where(at, gain * values, 0.0))
            out |= {f"{name}_a": float(a[-1]), f"{name}_b": float(b[-1]), f"{name}_0": float(np.nan_to_num(_running(keep, gain, values, at, None)[-1]))}
        return out

    def set_seeds(self, failures: int, rate: float | None, mean: float | None) -> None:
        """Means and failures after each row, and the maps of the weight."""
        r = self.r
        self.failures = _failures(self.ok, failures)
        self.rate = _running(*RATE, self.ok.astype(float), np.ones(len(self.ok), bool), rate)
        self.mean = _running(*MEAN, np.nan_to_num(self.latency), self.timed, mean)
        gain = r["bonus"] - np.minimum(np.nan_to_num(self.mean) / r["divisor"], r["cap"])
        gain = gain if r["gain"] is None else np.maximum(gain, r["gain"])
        loss = r["base"] + r["step"] * (self.failures - 1 + r["first"])
        loss = loss if r["most"] is None else np.minimum(loss, r["most"])
        self.d = np.where(self.ok, gain, -loss)
        self.low, self.high = np.where(self.ok, max(r["to"], r["low"]), r["low"]), np.full(len(self.ok), r["high"])
        saved = min(max(r["probe"], r["low"]), r["high"])
        self.saved = max(saved, r["to"]) if saved < r["floor"] else saved

    def pieces(self) -> list[tuple[float, float, float, float]]:
        """The weight after the segment by the weight w before: (up to, d, low, high) for w up to a bound, the last for all above."""
        tests = np.flatnonzero(self.ok & self.probe)
        new = np.zeros(len(self.d), bool)
        new[0], new[tests] = True, True
        d, low, high = clamped(self.d, self.low, self.high, new)
        ends = np.append(np.flatnonzero(new)[1:], len(new)) - 1
        begins = np.flatnonzero(new)
        out = [(np.inf, 0.0, -np.inf, np.inf)]
        for i, end in zip(begins.tolist(), ends.tolist(), strict=True):
            if self.ok[i] and self.probe[i]:
                out = self._tested(out, float(self.d[i]))
            # A row that sets the weight is the first of its run: what follows it is composed with it, or with what it is otherwise.
            out = [self._then(p, i, end, d, low, high) for p in out]
            out = [p for p, q in zip(out, [*out[1:], None], strict=True) if q is None or p[1:] != q[1:]]
        return [p[:4] for p in out]

    def _tested(self, pieces: list[tuple], gain: float) -> list[tuple]:
        """Pieces cut where the weight is such that a successful probe sets it; those carry a fifth entry."""
        out, since = [], -np.inf
        for up, d, low, high in (p[:4] for p in pieces):
            cut = -gain - d
            if high + gain <= 0 or low + gain <= 0 and up <= cut:
                out.append((up, d, low, high, True))
            elif low + gain > 0 or since >= cut:
                out.append((up, d, low, high))
            else:
                out += [(cut, d, low, high, True), (up, d, low, high)]
            since = up
        return out

    def _then(self, piece: tuple, i: int, end: int, d: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
        if len(piece) == 5:
            if end == i:
                return (piece[0], 0.0, self.saved, self.saved)
            x, y, z = clamped(self.d[i + 1 : end + 1], self.low[i + 1 : end + 1], self.high[i + 1 : end + 1], np.arange(end - i) == 0)
            value = float(np.clip(self.saved + x[-1], y[-1], z[-1]))
            return (piece[0], 0.0, value, value)
        up, d0, low0, high0 = piece
        low1, high1 = (float(np.clip(v + d[end], low[end], high[end])) for v in (low0, high0))
        return (up, d0 + float(d[end]), low1, high1)

    def weights(self, seed: float) -> np.ndarray:
        """The weight after each row. Rows that set it are few: the scan begins anew at each."""
        d, low, high, since = self.d.copy(), self.low.copy(), self.high.copy(), 0
        out = np.empty(len(d))
        tests = np.flatnonzero(self.ok & self.probe)
        while since < len(d):
            x, y, z = clamped(d[since:], low[since:], high[since:], np.arange(len(d) - since) == 0)
            out[since:] = np.clip(seed + x, y, z)
            own = tests[tests >= since]
            before = np.concatenate(([seed], out[since:]))[own - since]
            bad = own[before + self.d[own] <= 0]
            if not len(bad):
                break
            since = int(bad[0]) + 1
            out[since - 1] = seed = self.saved
        return out


# ---------------------------------------------------------------- over segments


def _cut(batches):
    """Segments of rows that come by node and time: arrays of at most SEGMENT attempts."""
    base, n = TaskContext.get().partitionId() << 32, 0
    names = ("id", "ok", "latency", "probe")
    for batch in batches:
        nodes = batch.column("proxy_key").to_pylist()
        edges = [0, *(i for i in range(1, len(nodes)) if nodes[i] != nodes[i - 1]), len(nodes)]
        cuts = [(a, min(a + SEGMENT, end)) for begin, end in zip(edges[:-1], edges[1:], strict=True) for a in range(begin, end, SEGMENT)]
        offsets = pa.array([a for a, _ in cuts] + [len(nodes)], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.concat_arrays([batch.column(c)])) for c in names]
        yield pa.RecordBatch.from_arrays([pa.array(range(base + n, base + n + len(cuts)), pa.int64()), pa.array([nodes[a] for a, _ in cuts], pa.string()), *lists], ["segment", "proxy_key", *names])
        n += len(cuts)


def _of(row: dict, rule: int) -> Segment:
    return Segment(row["ok"], row["latency"], row["probe"], rule)


def _mapped(function, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # rows hold whole segments
                yield pa.RecordBatch.from_pylist([x for row in batch.slice(at, 64).to_pylist() for x in function(row)], schema)

    return run


_FIRST = pa.schema([("segment", pa.int64()), ("proxy_key", pa.string()), ("tail", pa.int64()), ("any", pa.bool_()), ("timed", pa.bool_()), *((f"{n}_{x}", pa.float64()) for n in ("rate", "mean") for x in "ab0")])
_SEEDS = pa.schema([("segment", pa.int64()), ("failures", pa.int64()), ("rate", pa.float64()), ("mean", pa.float64())])
_PIECES = pa.schema([("segment", pa.int64()), ("proxy_key", pa.string()), ("pieces", pa.list_(pa.list_(pa.float64())))])
_WEIGHT = pa.schema([("segment", pa.int64()), ("weight", pa.float64())])
_OUT = pa.schema([("id", pa.int64()), ("proxy_key", pa.string()), ("weight", pa.float64()), ("failures", pa.int64()), ("success_rate", pa.float64()), ("latency_mean", pa.float64())])
_SQL = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double", pa.list_(pa.list_(pa.float64())): "array<array<double>>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def _folded(schema: pa.Schema, start, step):
    """The state before each segment, of rows that come by node and segment: one state is held."""

    def run(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if state is None or row["proxy_key"] != node:
                    node, state = row["proxy_key"], start
                out.append(dict(zip(schema.names, (row["segment"], *state), strict=True)))
                state = step(state, row)
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _first_step(state: tuple, row: dict) -> tuple:
    failures, rate, mean = state
    after = lambda x, name: row[f"{name}_0"] if x is None else row[f"{name}_a"] * x + row[f"{name}_b"]
    return row["tail"] + (0 if row["any"] else failures), after(rate, "rate"), after(mean, "mean") if row["timed"] else mean


def _weight_step(state: tuple, row: dict) -> tuple:
    w = state[0]
    _, d, low, high = next(p for p in row["pieces"] if w <= p[0])
    return (min(max(w + d, low), high),)


def node_weights(attempts: DataFrame, rule: int = 2) -> DataFrame:
    """H8: weight, failures in a row and moving means of a node after each of its attempts, in order of time and id.

    attempts: id, proxy_key, epoch, is_success, latency_ms, is_probe. A node may have any share of them: its history is cut over tasks.
    """
    spark, root = attempts.sparkSession, archive.shared_dir(attempts.sparkSession, "weights")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = attempts.select("id", "proxy_key", "epoch", F.col("is_success").alias("ok"), F.col("latency_ms").cast("double").alias("latency"), F.col("is_probe").alias("probe"))
    dealt = rows.repartitionByRange(parts, "proxy_key", "epoch", "id").sortWithinPartitions("proxy_key", "epoch", "id")
    segments = keep(dealt.mapInArrow(_cut, "segment long, proxy_key string, id array<long>, ok array<boolean>, latency array<double>, probe array<boolean>"), "segments")
    first = segments.mapInArrow(_mapped(lambda row: [{"segment": row["segment"], "proxy_key": row["proxy_key"], **_of(row, rule).first_summary()}], _FIRST), _ddl(_FIRST))
    ordered = lambda df: df.repartition("proxy_key").sortWithinPartitions("proxy_key", "segment")  # noqa: E731  # one row for a segment
    seeds = keep(ordered(first).mapInArrow(_folded(_SEEDS, START[1:], _first_step), _ddl(_SEEDS)), "seeds")

    def seeded(row: dict) -> Segment:
        own = _of(row, rule)
        own.set_seeds(row["failures"], row["rate"], row["mean"])
        return own

    pieces = segments.join(seeds, "segment").mapInArrow(_mapped(lambda row: [{"segment": row["segment"], "proxy_key": row["proxy_key"], "pieces": seeded(row).pieces()}], _PIECES), _ddl(_PIECES))
    weights = keep(ordered(pieces).mapInArrow(_folded(_WEIGHT, START[:1], _weight_step), _ddl(_WEIGHT)), "weights")

    def states(row: dict):
        own = seeded(row)
        mean = [None if x != x else x for x in own.mean.tolist()]
        for x in zip(row["id"], own.weights(row["weight"]).tolist(), own.failures.tolist(), own.rate.tolist(), mean, strict=True):
            yield dict(zip(_OUT.names, (x[0], row["proxy_key"], *x[1:]), strict=True))

    return segments.join(seeds, "segment").join(weights, "segment").mapInArrow(_mapped(states, _OUT), _ddl(_OUT))
