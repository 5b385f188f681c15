"""Suffix-array dedup: bytes covered by a string of 400 bytes that also starts anywhere else, by bucket-pointer refinement.

A suffix for every byte of the corpus would be many times its size, so the suffixes that are sorted are sparse, and only of what can repeat:

1. Each window of 400 bytes falls to the least 64-gram inside it (its anchor), which depends on nothing but the window's bytes, so equal
   windows have equal anchors at one offset. Neighbouring windows with the same anchor form a path: a row of anchor, content
   and coordinates, about one for every 170 bytes. Anchors that occur once are no repeats; a content that occurs again repeats as a whole.
2. Of contents that differ under one anchor (ends of copies, edits), one occurrence each is cut out at its source coordinates. Their
   bytes meet by anchor, aligned on it, and their suffixes are sorted: the initial buckets are the 8-grams; each round refines the buckets
   that still have several members by the bucket identifiers of later offsets (8, 16, ... 256 bytes on), as the rounds before left them, so the
   depth doubles. After 392 bytes, the eight bytes at the ends settle every window. Nothing but bytes is compared here.
3. Where an anchor has more contents than a task should hold, its windows are split by their offset to the anchor, again and again: windows of one
   class share all bytes that lie in each of them, and meet by those. The last classes are single windows, which need no sort.

Contents, shared bytes and rows are known by 128 bits of BLAKE2 or SHA-256; equal digests are taken as equal bytes.

Cases: null texts have no bytes; texts shorter than a window lose nothing; all occurrences are removed, the first as well; rows that repeat a text remove each
other; rows with a null id are kept; bytes are removed even inside a character (the kept bytes are binary); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, U, Stage, load, mix, parallelism, runs_of, small, texts_of, unused

WINDOW, GRAM = 400, 64
#: Offsets of an anchor in a window.
PLACES = WINDOW - GRAM + 1
#: Windows that are hashed at a time: places in a slice fit 16 bits.
SLICE = 1 << 15
#: Bytes of the contents of one anchor that are sorted in one task, bytes that a task sorts at a time, and bytes in a partition of them.
GROUP_BYTES, BLOCK_BYTES, PART_BYTES = 1 << 20, 2 << 20, 32 << 20
WORD = 8
#: Words that lie inside every window, whatever its offset to the grid of words.
DEPTH = WINDOW // WORD - 1
_PLACE = U(0xFFFF)


def digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 64 bytes from each place on: pairs of 8, 16 and 32 bytes, each from those before."""
    n = len(data) - WORD + 1
    h, width = mix(np.ndarray((n,), "<u8", data.tobytes(), strides=(1,)) + U(BASE)), WORD
    while width < GRAM:
        h = mix(h[:-width] * U(BASE) + h[width:])
        width *= 2
    return h


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the place of its anchor (the leftmost of equals), and its hash."""
    h = _gram_hashes(data)
    least, width = (h & ~_PLACE) | np.arange(len(h), dtype=U), 1
    while width < PLACES:
        step = min(width, PLACES - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    place = (least & _PLACE).astype(np.int64)
    return place, h[place]


def paths(data: np.ndarray, offsets: np.ndarray):
    """(text, anchor, place of the anchor, first window, last window) arrays of all paths of several texts."""
    total = len(data) - WINDOW + 1
    for low in range(0, max(total, 0), SLICE):
        begin, end = max(0, low - 1), min(total, low + SLICE + PLACES)
        stop = end + WINDOW - 1
        place, anchor = _anchors(data[begin:stop])
        place += begin
        i, j = np.searchsorted(offsets, [begin, stop - 1], "right") - 1
        owner = np.repeat(np.arange(i, j + 1), np.diff(np.clip(offsets[i : j + 2], begin, stop)))
        text, inside = owner[: end - begin], owner[: end - begin] == owner[WINDOW - 1 :]
        new = np.ones(end - begin, bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new & inside)
        # A path ends before the next one, or before a window that isn't inside a text.
        stops = np.flatnonzero(np.append(new | ~inside, True))
        last = stops[np.searchsorted(stops, first, "right")] - 1
        own = (first + begin >= low) & (first + begin < low + SLICE)
        first, last = first[own], last[own]
        yield text[first], anchor[first], place[first], first + begin, last + begin


def _scan(batches):
    """Paths of each text. A content that repeats within a run of texts is settled here, and one entry tells others that it occurs."""
    for batch in batches:
        rows = batch.column(0)
        for at, _, data, offsets in texts_of(batch.column(1)):
            raw = data.tobytes()
            for text, anchor, place, first, last in _merged(paths(data, offsets)):
                contents = [digest(raw[a : b + WINDOW]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                times = Counter(contents)
                often = np.array([times[c] > 1 for c in contents], bool)
                start, number = first - offsets[text], last - first + 1
                sent = np.array([times.pop(c, 0) > 0 for c in contents], bool)  # the first of each
                keep = np.flatnonzero(sent)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.take(pa.array(at + text[keep])), pa.array(anchor[keep].astype(np.int64)), pa.array([contents[i] for i in keep.tolist()], pa.binary()), pa.array(start[keep].astype(np.int32)),
                        pa.array(number[keep].astype(np.int32)), pa.array((place - first)[keep].astype(np.int16)), pa.array(often[keep]),
                    ],
                    ["row", "anchor", "content", "start", "number", "lead", "settled"],
                )
                owners, starts, numbers = runs_of(text[often], start[often], number[often])
                if owners:
                    count = [len(s) for s in starts]
                    flat = lambda x: np.concatenate(x).astype(np.int32)
                    n, nothing = sum(count), lambda kind: pa.nulls(sum(count), kind)
                    where = rows.take(pa.array(np.repeat(np.array(owners) + at, count)))
                    yield pa.RecordBatch.from_arrays([where, nothing(pa.int64()), nothing(pa.binary()), pa.array(flat(starts)), pa.array(flat(numbers)), nothing(pa.int16()), pa.array(np.ones(n, bool))], ["row", "anchor", "content", "start", "number", "lead", "settled"])


def _merged(found, most: int = 1 << 15):
    """The arrays of `found`, joined up to about `most` entries."""
    held, size = [], 0
    for x in found:
        held, size = [*held, x], size + len(x[0])
        if size >= most:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, size = [], 0
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _cut_out(batches):
    """The bytes of wanted paths at their source coordinates."""
    for batch in batches:
        out: list[tuple] = []
        for row, wanted, text in zip(*(batch.column(c) for c in ("row", "wanted", "text")), strict=True):
            raw, name = text.as_py().encode(), row.as_py()
            for w in wanted.as_py():
                out.append((w["key"], w["hull"], name, w["start"], w["number"], w["lead"], w["alone"], raw[w["start"] : w["start"] + w["number"] - 1 + WINDOW]))
                if len(out) * WINDOW > BLOCK_BYTES:
                    yield _pieces(out)
                    out = []
        yield _pieces(out)


_PIECES = "key binary, hull binary, row binary, start int, number int, lead int, alone boolean, bytes binary"
_KINDS = (pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_KINDS)], ["key", "hull", "row", "start", "number", "lead", "alone", "bytes"])


# ---------------------------------------------------------------- bucket-pointer refinement


def _ranks(*keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the distinct keys, in their order, and how many there are."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = new.cumsum()
    return out, int(new.sum()) + 1


def refined(words: np.ndarray, depth: int) -> np.ndarray:
    """Bucket identifiers of the suffixes of words: equal for suffixes that agree in their first `depth` words, and for no others.

    Words behind the end count as ones that differ from all others.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    bucket, used = _ranks(words)
    alive, have = np.arange(n), 1
    while have < depth:
        several = np.bincount(bucket[alive], minlength=used)[bucket[alive]] > 1
        alive = alive[several]
        if not len(alive):
            break
        step = min(have, depth - have)
        later = np.where(alive + step < n, bucket[np.minimum(alive + step, n - 1)], -1 - alive)
        new, number = _ranks(bucket[alive], later)
        bucket[alive] = used + new  # what is read in the next round
        used, have = used + number, have + step
    return bucket


def repeated_windows(pieces: list[bytes], leads: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window) of all windows that start more than once in the pieces, where equal windows lie at one offset to the leads."""
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    front = [-lead % WORD for lead in leads]  # so that each lead begins a word
    sizes = np.array([-(-(f + len(p)) // WORD) + 1 for f, p in zip(front, pieces, strict=True)], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    buffer = np.zeros((int(first[-1]) + DEPTH + 2) * WORD, np.uint8)
    for at, f, p in zip(first[:-1].tolist(), front, pieces, strict=True):
        buffer[at * WORD + f : at * WORD + f + len(p)] = np.frombuffer(p, np.uint8)
    words = buffer.view("<u8")
    bucket = refined(words, DEPTH)
    count = np.array([len(p) - WINDOW + 1 for p in pieces])
    piece = np.repeat(np.arange(len(pieces)), count)
    window = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    s = (first[:-1] * WORD + front)[piece] + window
    g = -(-s // WORD)
    several = np.bincount(bucket)[bucket[g]] > 1
    piece, window, s, g = piece[several], window[several], s[several], g[several]
    # The bytes of the window before its first whole word, and after the last of DEPTH words: eight in all.
    before = (8 * (g * WORD - s)).astype(U)
    left = np.where(before > 0, words[np.maximum(g - 1, 0)] >> ((U(64) - before) & U(63)), U(0))
    right = (words[g + DEPTH] << before)
    ends, _ = _ranks(left | right)
    same, number = _ranks(bucket[g], ends, before)
    hit = np.bincount(same, minlength=number)[same] > 1 if len(same) else np.zeros(0, bool)
    return piece[hit], window[hit]


def _sorted_blocks(batches):
    """Whole groups of pieces, which come in the order of their keys, sorted about BLOCK_BYTES at a time."""
    rows, held, key = [], 0, None
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("key", "row", "start", "lead", "alone", "bytes")), strict=True):
            if held >= BLOCK_BYTES and r[0] != key:
                yield _found(rows)
                rows, held = [], 0
            key = r[0]
            rows.append(r)
            held += len(r[5])
    if rows:
        yield _found(rows)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    times = Counter(r[0] for r in rows)
    rows = [r for r in rows if times[r[0]] > 1]
    piece, window = repeated_windows([r[5] for r in rows], [r[3] for r in rows])
    alone = np.array([r[4] for r in rows], bool)[piece] if len(rows) else np.zeros(0, bool)
    owners, starts, numbers = runs_of(piece[alone], window[alone], np.ones(int(alone.sum()), np.int64))
    flat = [(rows[i][1], rows[i][2] + s, n) for i, ss, nn in zip(owners, starts, numbers, strict=True) for s, n in zip(ss, nn, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], kind) for i, kind in enumerate((pa.binary(), pa.int32(), pa.int32()))], ["row", "start", "number"])


def _classes(width: int):
    """Pieces cut by the offset of their windows to the anchor, `width` offsets to a class; keyed by the bytes in all windows of the class."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                lead, number, raw = r["lead"], r["number"], r["bytes"]
                for c in range((lead - number + 1) // width, lead // width + 1):
                    a, b = max(0, lead - (c + 1) * width + 1), min(number - 1, lead - c * width)  # windows of the class
                    low, high = lead - c * width, lead - (c + 1) * width + 1 + WINDOW  # bytes of all its windows
                    hull = raw[a : b + WINDOW]
                    out.append((digest(r["key"], b"%d/%d:" % (c, width), raw[max(0, low) : high]), digest(hull), r["row"], r["start"] + a, b - a + 1, lead - a, r["alone"], hull))
            yield _pieces(out)

    return run


# ---------------------------------------------------------------- the operator


def repeated_spans(texts: DataFrame) -> DataFrame:
    """row, spans (start: number of the first window, number: of windows): for texts (row binary, text) all windows that also start elsewhere.

    Rows that share a key have equal texts.
    """
    spark, stage = texts.sparkSession, Stage(texts.sparkSession, "suffixes")
    scanned = stage.keep(texts.mapInArrow(_scan, "row binary, anchor long, content binary, start int, number int, lead short, settled boolean"), "paths")
    done, found = [scanned.where("anchor is null").select("row", "start", "number")], scanned.where("anchor is not null")
    times = F.sum(F.when(F.col("settled"), 2).otherwise(1)).alias("times")
    anchors = found.groupBy("anchor").agg(times, F.min("content").alias("a"), F.max("content").alias("b")).where("times > 1").select("anchor", (F.col("a") == F.col("b")).alias("straight"))
    again = stage.keep(found.join(stage.keep(anchors, "anchors"), "anchor"), "again")
    done.append(again.where("straight and not settled").select("row", "start", "number"))
    branching = again.where("not straight")
    contents = stage.keep(branching.groupBy("anchor", "content").agg(times, F.min(F.struct("row", "start", "number", "lead")).alias("at")), "contents")
    often = contents.where("times > 1").select("content")
    done.append(branching.where("not settled").join(often, "content", "left_semi").select("row", "start", "number"))
    key = F.unhex(F.lpad(F.hex("anchor"), 16, "0")).alias("key")
    asked = F.struct(key, F.col("content").alias("hull"), "at.start", "at.number", F.col("at.lead").cast("int").alias("lead"), (F.col("times") == 1).alias("alone"))
    wanted = stage.keep(contents.groupBy("at.row").agg(F.collect_list(asked).alias("wanted")), "wanted")
    cut = texts.join(wanted, "row").select("row", "wanted", "text").mapInArrow(_cut_out, _PIECES)
    pieces, width, n = stage.keep(cut, "pieces-0"), 1 << PLACES.bit_length(), 0
    while True:
        sizes = stage.keep(pieces.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(F.length("bytes")).alias("size")).where("kinds > 1"), f"sizes-{n}")
        hot = stage.keep(sizes.where(F.col("size") > GROUP_BYTES).select("key"), f"hot-{n}")
        cold = sizes.where(F.col("size") <= GROUP_BYTES)
        buckets = max(parallelism(spark), (cold.agg(F.sum("size")).first()[0] or 0) // PART_BYTES)
        few = small(hot)
        sent = pieces.join(few, "key", "left_anti").select("key", "row", "start", "lead", "alone", "bytes").repartition(buckets, "key").sortWithinPartitions("key")
        done.append(stage.keep(sent.mapInArrow(_sorted_blocks, "row binary, start int, number int"), f"found-{n}"))
        if hot.isEmpty() or width == 1:
            break
        width, n = width // 2, n + 1
        classes = stage.keep(pieces.join(few, "key", "left_semi").mapInArrow(_classes(width), _PIECES), f"classes-{n}")
        one = F.min(F.struct("row", "start", "number", "lead", "alone", "bytes")).alias("one")
        hulls = stage.keep(classes.groupBy("key", "hull").agg(F.count("*").alias("times"), one), f"hulls-{n}")
        done.append(classes.where("alone").join(hulls.where("times > 1").select("key", "hull"), ["key", "hull"], "left_semi").select("row", "start", "number"))
        alone = (F.col("one.alone") & (F.col("times") == 1)).alias("alone")
        pieces = stage.keep(hulls.select("key", "hull", "one.row", "one.start", "one.number", "one.lead", alone, "one.bytes"), f"pieces-{n}")
        stage.drop(f"pieces-{n - 1}")
    spans = done[0]
    for more in done[1:]:
        spans = spans.union(more)
    return stage.keep(spans.groupBy("row").agg(F.collect_list(F.struct("start", "number")).alias("spans")), "spans")


def with_spans(docs: DataFrame) -> DataFrame:
    """docs and, as the last column, the runs of repeated windows of each row."""
    row, name = unused(docs, "__row"), unused(docs, "__spans")
    both = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    keyed = docs.withColumn(row, F.unhex(F.substring(F.sha2(both, 256), 1, 32)))
    spans = repeated_spans(keyed.select(F.col(row).alias("row"), "text"))
    return keyed.join(spans.select(F.col("row").alias(row), F.col("spans").alias(name)), row, "left").select(*docs.columns, name)


def removed_ranges(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal runs of bytes (start, end) that runs of windows cover."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["start"] + s["number"] - 1 + WINDOW) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def kept_bytes(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for start, end in ranges:
        out.append(raw[at:start])
        at = end
    return b"".join((*out, raw[at:]))


def _kept(batches):
    for batch in batches:
        texts, ranges = batch.column("text").to_pylist(), [removed_ranges(s.as_py()) for s in batch.columns[-1]]
        kept = [None if t is None else kept_bytes(t.encode(), r) for t, r in zip(texts, ranges, strict=True)]
        spans = [[{"start": a, "end": b} for a, b in r] for r in ranges]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, kind), pa.array(kept, pa.binary())], [*batch.schema.names[:-1], "removed", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text, and what is left of it: removed (byte ranges, in order) and kept (its other bytes, null for a null text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_spans(docs.select("doc_id", "text")).mapInArrow(_kept, f"doc_id {kind}, text string, removed array<struct<start:bigint,end:bigint>>, kept binary")


def op12(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    return found.select(
        "doc_id", size("text").alias("n_bytes"), (size("text") - size("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"),
    )
