"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text come from one pass of numpy over Arrow buffers and are staged, so that fitting and scoring
never read a text again. Trees are fitted on a bounded, deterministic sample of labelled rows and flattened into
arrays (complete binary trees), which all rows of a batch walk at once.

Cases: null and empty texts get the statistics of an empty text and a score like any other; repeated rows are scored
each; labels that are null or contradict each other for a document aren't learned; without two classes to learn from, every score is the
share of label 1 (0.5 without labels); rows with a null id are scored and never learned; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, Words, gram_hashes, load, small, span_hash, texts_of, unused

CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "comma", "pipe", "junk", "other", "lead", "tail")
NAMES = (
    *CLASSES, "log_bytes", "log_words", "word_mean", "word_sd", "word_max", "short", "long", "distinct", "top", "grams_repeated",
    "lines_repeated", "words_per_line", "words_per_stop", "junk_per_word", "pipe_per_word",
)

_CLASS = np.full(256, CLASSES.index("other"), np.int64)
for _name, _bytes in (
    ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("blank", b" \t\r\x0b\x0c"), ("line", b"\n"), ("stop", b".?"),
    ("comma", b",;:"), ("pipe", b"|<>{}[]\\"), ("junk", b"!#$%&*@^~_=+"), ("tail", range(0x80, 0xC0)), ("lead", range(0xC0, 0x100)),
):
    _CLASS[list(_bytes)] = CLASSES.index(_name)


def _repeated(x: np.ndarray) -> float:
    if len(x) < 2:
        return 0.0
    s = np.sort(x)
    return float((s[1:] == s[:-1]).mean())


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, sizes, k = len(offsets) - 1, np.diff(offsets), len(CLASSES)
    out = np.zeros((n, len(NAMES)), np.float32)
    counts = np.bincount(_CLASS[data] + np.repeat(np.arange(n) * k, sizes), minlength=n * k).reshape(n, k)
    out[:, :k] = counts / np.maximum(sizes, 1)[:, None]
    words = Words(data, offsets, True)
    breaks = np.flatnonzero(data == 10)
    line_ends = np.unique(np.concatenate((breaks, offsets[1:]))) if len(data) else np.zeros(0, np.int64)
    line_starts = np.concatenate(([0], line_ends[:-1])) if len(line_ends) else line_ends
    lengths, grams = words.ends - words.starts, gram_hashes(words.hashes, 5)
    word_of_line = np.searchsorted(words.starts, line_starts), np.searchsorted(words.starts, line_ends)
    full = word_of_line[1] > word_of_line[0]
    lines = span_hash(words.hashes, word_of_line[0][full], word_of_line[1][full], 0xA0761D6478BD642F) if len(words.hashes) else np.zeros(0, np.uint64)
    line_doc = np.searchsorted(line_starts[full], offsets)
    at = {x: NAMES.index(x) for x in NAMES}
    for i in range(n):
        a, b = words.first[i], words.first[i + 1]
        m, size, row = b - a, lengths[a:b], out[i]
        row[at["log_bytes"]], row[at["log_words"]] = np.log1p(sizes[i]), np.log1p(m)
        own = lines[line_doc[i] : line_doc[i + 1]]
        row[at["lines_repeated"]], row[at["words_per_line"]] = _repeated(own), m / max(1, len(own))
        row[at["words_per_stop"]] = m / (1 + counts[i, CLASSES.index("stop")])
        row[at["junk_per_word"]] = counts[i, CLASSES.index("junk")] / max(1, m)
        row[at["pipe_per_word"]] = counts[i, CLASSES.index("pipe")] / max(1, m)
        if m:
            row[at["word_mean"]], row[at["word_sd"]], row[at["word_max"]] = size.mean(), size.std(), np.log1p(size.max())
            row[at["short"]], row[at["long"]] = (size <= 3).mean(), (size > 12).mean()
            s = np.sort(words.hashes[a:b])
            runs = np.diff(np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True]))))
            row[at["distinct"]], row[at["top"]] = len(runs) / m, runs.max() / m
            row[at["grams_repeated"]] = _repeated(grams[a : max(a, b - 4)])
    return out


def _features(batches):
    for batch in batches:
        found = [_statistics(data, offsets) for _, _, data, offsets in texts_of(batch.column(1))]
        if found:
            flat = pa.array(np.concatenate(found).ravel())
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(NAMES), np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], ["doc_id", "features", "row"])


def row_key() -> Column:
    """A hash of doc_id and text: rows that share it are equal."""
    return F.xxhash64("doc_id", "text")


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, features array<float>, row), one row per row of docs; the order of features is NAMES."""
    return docs.select(F.col("doc_id").cast("long"), "text", row_key().alias("row")).mapInArrow(_features, "doc_id long, features array<float>, row long")


@dataclass
class Trees:
    """Complete binary trees of one depth: at node i of tree t, x[feature[t, i]] > cut[t, i] goes to 2 i + 2, else to 2 i + 1."""

    prior: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: int = 10) -> Trees:
    """Newton boosting of the logistic loss; splits come from histograms of gradients over quantile bins."""
    inner, (n, k) = 2**depth - 1, x.shape
    share = (y.sum() + 0.5) / (n + 1) if n else 0.5
    model = Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if n == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.column_stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(k)])
    raw, features, limits, leaves = np.full(n, model.prior), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node, feature, cut = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            chosen = np.full((width, 2), -1)
            for j in range(k):
                key = (node - first) * bins + binned[:, j]
                sums = [np.bincount(key, w, width * bins).reshape(width, bins).cumsum(1) for w in (g, h, np.ones(n))]
                (gl, hl, nl), (gt, ht, nt) = [s[:, :-1] for s in sums], [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(nl < least) | (nt - nl < least)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                chosen[better] = np.column_stack((np.full(width, j), top))[better]
            for w in np.flatnonzero(chosen[:, 0] >= 0):
                j, b = chosen[w]
                if b < len(cuts[j]):
                    feature[first + w], cut[first + w] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        at = node - inner
        value = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        raw = raw + value[at]
        features.append(feature), limits.append(cut), leaves.append(value)
    return Trees(model.prior, np.array(features), np.array(limits), np.array(leaves))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(features: DataFrame, labels: DataFrame, sample: int = 40_000) -> Trees:
    """Trees from at most `sample` labelled rows that aren't held out, the first by a hash of doc_id."""
    known = (
        labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z").where(~held_out())
    )
    rows = features.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").select("features", "y").limit(sample).toArrow()
    x = rows["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
    return fit_trees(x, rows["y"].to_numpy().astype(np.float64))


def _scores(model: Trees):
    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x)), batch.column(2)], ["doc_id", "score", "row"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 40_000) -> DataFrame:
    """doc_id, held_out, score, predicted, row: one row per row of docs. Labels teach, and nothing but statistics of the text is scored."""
    stage = Stage(docs.sparkSession, "quality")
    features = stage.keep(statistics(docs), "features")
    scored = features.mapInArrow(_scores(fit(features, labels, sample)), "doc_id long, score double, row long")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "row")


def without_rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without the rows that score below the threshold, each judged by its own text."""
    stage, row = Stage(docs.sparkSession, "rejected"), unused(docs, "__row")
    bad = stage.keep(quality_scores(docs, labels, threshold).where("predicted = 0").select(F.col("row").alias(row)).distinct(), "bad")
    return docs.withColumn(row, row_key()).join(small(bad), row, "left_anti").select(docs.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    return quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")).drop("row")
