"""Substring dedup: words covered by a passage of `window` words that also occurs elsewhere, by compaction of a sparse de Bruijn graph.

The k-mers are windows of 35 words. Each falls to the least 8-word hash inside it (its anchor), which depends on nothing but the window's words, so
equal windows have equal anchors. Neighbouring windows with the same anchor form one path, which is one edge of the graph: a row of
anchor, content and coordinates, about one for every 14 windows. Contents, and single windows, are known by 128 bits of BLAKE2 over their words.

1. Anchors that occur once are no repeats. Where all paths of an anchor have one content, they don't branch, and every window of
   them repeats; these are settled by grouping and one join, whole paths at a time.
2. Where contents differ (ends of passages, edits), a path whose content occurs again repeats as a whole, too. One source
   coordinate of every differing content leads back to its text, whose windows are compared one by one; the hits give the exact
   borders. Both kinds of occurrences meet in buckets by their hashes; of a hash that many texts share, a task sends one entry.

Nothing is grouped by document but its own spans, and no join makes the occurrences of a hot passage anew.

Cases: null texts have no words; texts of fewer words than a window lose nothing; all occurrences of a passage are removed, the first as
well; rows that repeat a text remove each other; rows with a null id are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Stage, Words, cuts, fresh, gram_hashes, load, mix, parallelism, runs_of, texts_of, unused

WINDOW, ANCHOR = 35, 8
NOBODY = np.iinfo(np.int64).min
FLUSH = 1 << 19
#: Bytes of an entry on its way to a bucket, and about how many of them one bucket gets.
ENTRY, BUCKET_BYTES = 32, 32 << 20


def least_at(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of the least, the leftmost of equals."""
    at, w = np.arange(len(values)), 1
    while w < width:
        step = min(w, width - w)
        if len(at) <= step:
            return np.zeros(0, np.int64)
        left, right = at[:-step], at[step:]
        at, w = np.where(values[left] <= values[right], left, right), w + step
    return at


def spaced(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of several texts, each with one blank behind it, and where each begins and ends there."""
    sizes = words.ends - words.starts
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(starts, sizes) + inside] = words.data[np.repeat(words.starts, sizes) + inside]
    return out.tobytes(), starts, ends


def digests(words: Words, first: np.ndarray, last: np.ndarray, kind: bytes) -> list[bytes]:
    """128 bits of the words from `first` up to, but without, `last`, for each pair: the same for all blanks between them. Those of two kinds never meet."""
    raw, starts, ends = spaced(words)
    return [hashlib.blake2b(raw[a:b], digest_size=16, person=kind).digest() for a, b in zip(starts[first].tolist(), ends[last - 1].tolist(), strict=True)]


def halves(found: list[bytes]) -> np.ndarray:
    """Digests as rows of two 64-bit numbers."""
    return np.frombuffer(b"".join(found), U).reshape(-1, 2)


def _paths(batches):
    for batch in batches:
        rows = batch.column(0).to_numpy()
        for at, _, data, offsets in texts_of(batch.column(1)):
            words = Words(data, offsets, False)
            h, first = words.hashes, words.first
            if len(h) < WINDOW:
                continue
            grams, text = gram_hashes(h, ANCHOR), np.repeat(np.arange(len(first) - 1), np.diff(first))
            least = least_at(grams, WINDOW - ANCHOR + 1)
            s = np.flatnonzero(text[: len(h) - WINDOW + 1] == text[WINDOW - 1 :])
            if not len(s):
                continue
            anchor, d = least[s], text[s]
            new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (d[1:] != d[:-1])))
            a, last = s[new], s[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]
            p, d = anchor[new], d[new]
            contents = pa.array(digests(words, a, last + WINDOW, b"path"), pa.binary())
            arrays = rows[at:][d], grams[p].astype(np.int64), contents, (a - first[d]).astype(np.int32), (last - a + 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["row", "anchor", "content", "start", "number"])


def _equal(hashes: np.ndarray) -> np.ndarray:
    """For digests in order, whether each equals the one before."""
    return np.concatenate(([False], (hashes[1:] == hashes[:-1]).all(1))) if len(hashes) else np.zeros(0, bool)


def _packed(buckets: int, hashes: np.ndarray, rows: np.ndarray, starts: np.ndarray, numbers: np.ndarray):
    """What one task hands on: for each bucket distinct digests and the owner of each; and the owners that are settled here.

    However many owners a digest has in a task, one entry leaves it, without an owner: that it occurs here is all that others need to know.
    """
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))
    hashes, rows, starts, numbers = hashes[order], rows[order], starts[order], numbers[order]
    first = np.flatnonzero(~_equal(hashes))
    times = np.diff(np.append(first, len(hashes)))
    shared = np.repeat(times > 1, times) & (rows != NOBODY)
    settled = runs_of(rows[shared], starts[shared], numbers[shared])
    hashes, rows, starts, numbers = hashes[first], np.where(times > 1, NOBODY, rows[first]), starts[first].astype(np.int32), numbers[first].astype(np.int32)
    bucket = (mix(hashes[:, 0]) % U(buckets)).astype(np.int64)
    occurring, cut = cuts(bucket, np.argsort(bucket, kind="stable"))
    n, m = len(cut), len(settled[0])
    lists, none = pa.list_(pa.int64()), [None] * n
    blobs = [pa.array([x[c].tobytes() for c in cut] + [None] * m, pa.binary()) for x in (hashes, rows, starts, numbers)]
    tail = [pa.array(none + settled[0], pa.int64()), pa.array(none + settled[1], lists), pa.array(none + settled[2], lists)]
    homes = (mix(np.array(settled[0], np.int64).astype(U)) % U(buckets)).astype(np.int64).tolist()
    return pa.RecordBatch.from_arrays([pa.array(occurring + homes, pa.int32()), *blobs, *tail], ["bucket", "hashes", "rows", "at", "width", "row", "starts", "numbers"])


_SENT = "bucket int, hashes binary, rows binary, at binary, width binary, row long, starts array<long>, numbers array<long>"


class _Held:
    """Occurrences that a task has met, handed on FLUSH at a time."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.size = buckets, [], 0

    def add(self, *columns: np.ndarray) -> bool:
        """Whether it is time to hand on."""
        self.parts.append(columns)
        self.size += len(columns[0])
        return self.size >= FLUSH

    def out(self):
        if self.size:
            yield _packed(self.buckets, *(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        self.parts, self.size = [], 0


def _occurrences(buckets: int):
    """Whole paths, by what they hold."""

    def run(batches):
        held = _Held(buckets)
        for batch in batches:
            row, start, number = (batch.column(c).to_numpy() for c in ("row", "start", "number"))
            if held.add(halves(batch.column("content").to_pylist()), row, start.astype(np.int64), number.astype(np.int64)):
                yield from held.out()
        yield from held.out()

    return run


def _windows(buckets: int):
    """Single windows, by what they hold."""

    def run(batches):
        held = _Held(buckets)
        for batch in batches:
            rows, wanted = batch.column("row").to_numpy(), batch.column("wanted").to_pylist()
            for at, _, data, offsets in texts_of(batch.column("text")):
                words = Words(data, offsets, False)
                asked = [(i, w["start"], w["number"], w["alone"]) for i in range(len(offsets) - 1) for w in wanted[at + i]]
                for low in range(0, len(asked), 1024):
                    text, start, number, alone = (np.array(x) for x in zip(*asked[low : low + 1024], strict=True))
                    own = np.repeat(np.arange(len(number)), number)
                    s = start[own] + np.arange(len(own)) - np.repeat(np.cumsum(number) - number, number)
                    a = words.first[text][own] + s
                    if held.add(halves(digests(words, a, a + WINDOW, b"window")), np.where(alone[own], rows[at + text[own]], NOBODY), s, np.ones(len(s), np.int64)):
                        yield from held.out()
        yield from held.out()

    return run


def _met(table: pa.Table) -> pa.Table:
    """Owners of what came to this bucket more than once; what was settled before passes through."""
    kinds = {"hashes": U, "rows": np.int64, "at": np.int32, "width": np.int32}
    hashes, rows, starts, numbers = (np.frombuffer(b"".join(table[c].drop_null().to_pylist()), kind) for c, kind in kinds.items())
    hashes = hashes.reshape(-1, 2)
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))
    hashes, rows, starts, numbers = hashes[order], rows[order], starts[order].astype(np.int64), numbers[order]
    again = _equal(hashes)
    shared = (again | np.append(again[1:], False)) & (rows != NOBODY) if len(hashes) else np.zeros(0, bool)
    found, lists = runs_of(rows[shared], starts[shared], numbers[shared]), pa.list_(pa.int64())
    old = table.filter(table["row"].is_valid()).select(["row", "starts", "numbers"])
    return pa.concat_tables([old, pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], lists), pa.array(found[2], lists)], ["row", "starts", "numbers"])])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """row, spans (start: number of the first window, number: of windows): for texts (row long, text) all windows that also start elsewhere."""
    spark = texts.sparkSession
    stage = Stage(spark, "repeats")
    paths = stage.keep(texts.mapInArrow(_paths, "row long, anchor long, content binary, start int, number int"), "paths")
    anchors = paths.groupBy("anchor").agg(F.count("*").alias("times"), F.min("content").alias("a"), F.max("content").alias("b")).where("times > 1")
    again = stage.keep(paths.join(anchors.select(fresh("anchor"), (F.col("a") == F.col("b")).alias("straight")), "anchor"), "again")
    stage.drop("paths")
    branching = again.where("not straight")
    contents = stage.keep(branching.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.min(F.struct("row", "start", "number")).alias("at")), "contents")
    # What comes to one bucket is held by one task: their number grows with what is sent at most.
    sent = contents.agg(F.sum("times"), F.sum("at.number")).first()
    buckets = max(parallelism(spark), sum(n or 0 for n in sent) * ENTRY // BUCKET_BYTES)
    wanted = contents.groupBy("at.row").agg(F.collect_list(F.struct("at.start", "at.number", (F.col("times") == 1).alias("alone"))).alias("wanted"))
    # Rows of equal key have equal texts: one of them is enough here.
    asked = texts.join(stage.keep(wanted, "wanted"), "row").select("row", "text", "wanted").mapInArrow(_windows(buckets), _SENT)
    met = branching.mapInArrow(_occurrences(buckets), _SENT).union(asked).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_met, "row long, starts array<long>, numbers array<long>")
    parts = stage.keep(met, "parts")
    stage.drop("contents", "wanted")
    windows = parts.select("row", F.explode(F.arrays_zip("starts", "numbers")).alias("s")).select("row", F.col("s.starts").cast("int").alias("start"), F.col("s.numbers").cast("int").alias("number"))
    spans = again.where("straight").select("row", "start", "number").union(windows).groupBy("row").agg(F.collect_list(F.struct("start", "number")).alias("spans"))
    spans = stage.keep(spans, "spans")
    stage.drop("again", "parts")
    return spans


def with_spans(docs: DataFrame) -> DataFrame:
    """docs and, as the last column, the spans of each row. Rows are known by a hash of doc_id and text: those that share it are equal."""
    row, name = unused(docs, "__row"), unused(docs, "__spans")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    spans = repeated_spans(keyed.select(F.col(row).alias("row"), "text"))
    found = spans.select(F.col("row").alias(row), F.col("spans").alias(name))
    return keyed.join(found, row, "left").select(*docs.columns, name)


def kept_words(raw: bytes, spans: list[dict] | None) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = raw.split()
    if not spans:
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [s["start"] for s in spans], 1)
    np.add.at(edge, [s["start"] + s["number"] - 1 + WINDOW for s in spans], -1)
    return [words[i] for i in np.flatnonzero(edge.cumsum()[:-1] == 0)], len(words)


def _digest(batches):
    for batch in batches:
        total, removed, digests = [], [], []
        for text, spans in zip(batch.column("text"), batch.columns[-1], strict=True):
            words, n = kept_words((text.as_py() or "").encode(), spans.as_py())
            total.append(n), removed.append(n - len(words)), digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _rewrite(batches):
    for batch in batches:
        out = pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1])
        texts, changed = batch.column("text").to_pylist(), {}
        for i, spans in enumerate(batch.columns[-1]):
            if spans.as_py():
                changed[i] = b" ".join(kept_words(texts[i].encode(), spans.as_py())[0]).decode()
        for name, value in (("text", lambda t: t), ("n_chars", len)):
            if changed and name in out.schema.names:
                at = out.schema.names.index(name)
                old = out.column(at).to_pylist()
                out = out.set_column(at, name, pa.array([value(changed[i]) if i in changed else x for i, x in enumerate(old)], out.column(at).type))
        yield out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut from text (what is left of a cut text is joined by one blank, and n_chars set anew)."""
    return with_spans(docs).mapInArrow(_rewrite, docs.schema)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return with_spans(docs).mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
