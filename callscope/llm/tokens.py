"""Byte-level BPE encoding and decoding, by tree concatenation for long unsplit text.

A text is first cut where the split pattern surely has a border (before white space that follows a solid character), so its
pieces encode independently. A word that is still longer than `unsplit` characters is halved again and again; the
leaves are encoded on their own, and at each join a growing window around it is encoded anew until its outer tokens agree with both
sides. Adjacent tokens of a merge sequence decide its correctness, so the joined sequence is exactly the encoding of the whole.

Pieces of texts longer than `long_text` characters are rows of their own, spread over the cluster; short texts are encoded
where they are read.

Cases: null and empty texts have no tokens; the string of a special token in a text is that token, as the tokenizers library reads it by
default; repeated rows are encoded each; rows with a null id are kept.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load

RANKS, SPECIAL, SPECIAL_ID = "byte_bpe_50k.tiktoken", "<|endoftext|>", 50256
#: Texts of more characters are spread over rows; words of more characters are encoded by tree concatenation.
LONG_TEXT, UNSPLIT = 1 << 16, 1 << 12
_ROWS = 64


@functools.cache
def coder(name: str = RANKS) -> tiktoken.Encoding:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _units() -> regex.Pattern:
    """The pattern that splits a text into units of merging."""
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


def join(left: list[int], right: list[int], window: int = 8) -> list[int]:
    """The encoding of two neighbouring parts of one unit of merging, from the encodings of the parts.

    Encodes a window around the join anew, and a larger one, until its first and last tokens are those of the sides.
    """
    if not left or not right:
        return left + right
    while True:
        a, b = left[-window:], right[:window]
        middle = coder()._encode_single_piece(coder().decode_bytes(a + b))
        if (len(a) == len(left) or middle[0] == a[0]) and (len(b) == len(right) or middle[-1] == b[-1]):
            return left[: len(left) - len(a)] + middle + right[len(b) :]
        window *= 2


def join_all(sides: list[list[int]]) -> list[int]:
    """The encoding of neighbouring parts of one unit of merging, joined by halves."""
    if len(sides) < 2:
        return sides[0] if sides else []
    return join(join_all(sides[: len(sides) // 2]), join_all(sides[len(sides) // 2 :]))


def tree(raw: bytes, leaf: int = UNSPLIT) -> list[int]:
    """Token ids of one unit of merging, by halves."""
    if len(raw) <= leaf:
        return coder()._encode_single_piece(raw)
    return join(tree(raw[: len(raw) // 2], leaf), tree(raw[len(raw) // 2 :], leaf))


@functools.cache
def _long_run(n: int) -> re.Pattern:
    """Solid text or white space of more than n characters: only there can a unit be longer."""
    return re.compile(rf"\S{{{n + 1}}}|\s{{{n + 1}}}")


def encode_plain(text: str, unsplit: int = UNSPLIT) -> list[int]:
    """Token ids of a text that holds no special token."""
    if len(text) <= unsplit or not _long_run(unsplit).search(text):
        return coder().encode_ordinary(text)
    return [i for unit in _units().findall(text) for i in tree(unit.encode(), unsplit)]


def encode(text: str, unsplit: int = UNSPLIT) -> list[int]:
    """Token ids of a whole text."""
    first, *rest = text.split(SPECIAL)
    out = encode_plain(first, unsplit)
    for part in rest:
        out.append(SPECIAL_ID)
        out += encode_plain(part, unsplit)
    return out


def decode(ids: list[int]) -> str:
    """The text of ids; bytes that are no UTF-8 become replacement characters."""
    if SPECIAL_ID not in ids:
        return coder().decode_bytes(ids).decode("utf-8", "replace")
    parts, at = [], 0
    for i in [*(k for k, x in enumerate(ids) if x == SPECIAL_ID), len(ids)]:
        parts.append(coder().decode_bytes(ids[at:i]))
        at = i + 1
    return SPECIAL.encode().join(parts).decode("utf-8", "replace")


#: Solid for every reading of white space, before white space for every reading.
_BORDER = re.compile(r"(?<=\S)(?=[ \n\t])")


def parts(text: str, size: int):
    """(glued, part) in order: cuts where the split pattern has a border, or, where there is none, inside units (glued)."""
    at = 0
    while at < len(text):
        cut = _BORDER.search(text, at + size) if len(text) - at > size else None
        end = cut.start() if cut else len(text)
        if end - at <= 2 * size:
            yield False, text[at:end]
        else:
            yield from _solid(text[at:end], size)
        at = end


def _solid(text: str, size: int):
    for k, plain in enumerate(text.split(SPECIAL)):
        if k:
            yield False, SPECIAL
        held: list[str] = []
        for unit in _units().findall(plain):
            if len(unit) > size:
                if held:
                    yield False, "".join(held)
                    held = []
                for i in range(0, len(unit), size):
                    yield i > 0, unit[i : i + size]
            else:
                held.append(unit)
                if sum(map(len, held[-64:])) > size or len(held) >= size:
                    yield False, "".join(held)
                    held = []
        if held:
            yield False, "".join(held)


def encode_part(glued: bool, part: str, unsplit: int) -> list[int]:
    return tree(part.encode(), unsplit) if glued else encode(part, unsplit)


def little_endian(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _short(unsplit: int, finish):
    def run(batches):
        for batch in _slices(batches):
            yield finish(batch.column(0), [encode(text or "", unsplit) for text in batch.column(1).to_pylist()])

    return run


def _cut(size: int):
    def run(batches):
        for batch in _slices(batches):
            rows = [(key, k, glued, part) for key, text in zip(*map(pa.Array.to_pylist, batch.columns), strict=True) for k, (glued, part) in enumerate(parts(text, size))]
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["row", "part", "glued", "text"])

    return run


def _spread(unsplit: int):
    def run(batches):
        for batch in _slices(batches):
            ids = [little_endian(encode_part(g, t, unsplit)) for g, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], ["row", "part", "glued", "ids"])

    return run


def _whole(finish):
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                units: list[list[list[int]]] = []
                for part in one.column(1).to_pylist()[0]:
                    if not part["glued"]:
                        units.append([])
                    units[-1].append(np.frombuffer(part["ids"], "<u4").tolist())
                yield finish(one.column(0), [[i for unit in units for i in join_all(unit)]])

    return run


def as_binary(keys: pa.Array, rows: list[list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys, pa.array(map(little_endian, rows), pa.binary())], ["doc_id", "ids"])


def encode_documents(docs: DataFrame, finish=as_binary, columns: str = "ids binary", long_text: int = LONG_TEXT, unsplit: int = UNSPLIT) -> DataFrame:
    """doc_id and the columns that `finish(doc_ids, lists of token ids)` makes of whole texts; by default ids, as
    little-endian unsigned 32-bit integers.

    The parts of one long text meet in one row at the end; nothing else is grouped.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    schema = f"doc_id long, {columns}"
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= long_text).mapInArrow(_short(unsplit, finish), schema)
    # Contents, not ids, tell long texts apart: ids may repeat or be null.
    long = docs.where(F.length("text") > long_text).withColumn("row", F.xxhash64("doc_id", "text"))
    copies = long.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n"))
    cut = long.dropDuplicates(["row"]).select("row", "text").mapInArrow(_cut(long_text), "row long, part int, glued boolean, text string")
    spread = cut.repartition("row", "part").mapInArrow(_spread(unsplit), "row long, part int, glued boolean, ids binary")
    whole = spread.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("part", "glued", "ids"))).alias("parts"))
    again = copies.join(whole, "row").select("doc_id", "parts", F.explode(F.expr("sequence(1L, n)"))).select("doc_id", "parts")
    return short.unionByName(again.mapInArrow(_whole(finish), schema))


def _digests(keys: pa.Array, rows: list[list[int]]) -> pa.RecordBatch:
    ids = [hashlib.sha256(little_endian(r)).hexdigest() for r in rows]
    text = [hashlib.sha256(decode(r).encode()).hexdigest() for r in rows]
    return pa.RecordBatch.from_arrays([keys, pa.array(map(len, rows), pa.int64()), pa.array(ids), pa.array(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op5(spark, sf_dir: str) -> DataFrame:
    return encode_documents(load(spark, sf_dir, "documents"), _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
