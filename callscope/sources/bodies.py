"""Stored bodies: JSON, event streams or text, plain or gzip of one or several members, whole or cut off.

What a cut file still gives is kept, with a flag: a body that ends before its gzip trailer, or inside a character. Files are read by Spark (`binaryFile`), so any
store that Spark reads will do, and decoded in the tasks.
"""

from __future__ import annotations

import codecs
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b"


def decoded(raw: bytes) -> tuple[str, bool, bool]:
    """The text, whether it was packed, and whether it is cut off."""
    packed, cut, parts = raw[:2] == MAGIC, False, [raw]
    if packed:
        parts, rest = [], raw
        while rest[:2] == MAGIC:
            member = zlib.decompressobj(31)
            try:
                parts.append(member.decompress(rest))
                parts.append(member.flush())
            except zlib.error:
                # What comes before the damage, byte by byte.
                parts.append(_before_damage(rest))
                cut = True
                break
            if not member.eof:
                cut = True
                break
            rest = member.unused_data
        else:
            cut = bool(rest.strip(b"\0"))  # padding is none
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    text = reader.decode(b"".join(parts), False)
    return text, packed, cut or bool(reader.getstate()[0])


def _before_damage(raw: bytes) -> bytes:
    member, out = zlib.decompressobj(31), []
    for i in range(len(raw)):
        try:
            out.append(member.decompress(raw[i : i + 1]))
        except zlib.error:
            break
    return b"".join(out)


def kind_of(text: str) -> str:
    """json, stream (lines of fields of events) or text."""
    head = text.lstrip()
    if head[:1] in ("{", "["):
        return "json"
    return "stream" if head.startswith(("data:", "event:", "id:", "retry:", ":")) else "text"


_NEW = pa.schema([("body", pa.string()), ("kind", pa.string()), ("packed", pa.bool_()), ("truncated", pa.bool_())])


def _decode(batches):
    for batch in batches:
        kept = [c for c in batch.schema.names if c != "content"]
        found = [(None, None, None, None) if raw is None else (*(x := decoded(raw))[:1], kind_of(x[0]), *x[1:]) for raw in batch.column("content").to_pylist()]
        columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(_NEW.types)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, *_NEW.names])


def with_bodies(contents: DataFrame) -> DataFrame:
    """contents (..., content) with body, kind, packed and truncated in place of the bytes; all null where content is."""
    kept = [f for f in contents.schema.fields if f.name != "content"]
    return contents.mapInArrow(_decode, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "body string, kind string, packed boolean, truncated boolean"]))


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, size, body, kind, packed, truncated: a row for each file below a path that isn't empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return with_bodies(files.select(F.col("path").alias("file"), F.col("length").alias("size"), "content"))
