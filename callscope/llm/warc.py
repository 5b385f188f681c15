"""WARC archives: a deterministic sharded writer, and a reader of what it wrote.

Records are sorted by ranges of page_id whose borders come from sums of payload bytes over at most `BLOCKS` equal blocks of ids, so the same pages
give the same shards whatever the cluster. A block of more than a shard's bytes is cut into `FINER` equal blocks again, and one that holds a single
page_id, or none, by the digests of its payloads. A shard rolls to a new file once its compressed size reaches `roll_bytes`. Headers and digests are
made anew from the payload. Files are written under temporary names that carry the attempt; the manifest, a table that Spark commits, names the
attempt that counts, and only its files get their final names. A lost or repeated attempt leaves nothing but a temporary file. The reader holds every file to
the number of records, the bytes and the digest of the manifest: a file that was cut short or changed is an error.

Of records with equal payloads of at least `least_revisit` bytes, the one with the smallest page_id is a response, the others revisit it.

Cases: a null html is an empty payload; a null url is left out as urn:page; rows with a null page_id are written (and revisit a named page with the same payload);
rows that repeat the smallest page_id are responses each; an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, load, parallelism

BLOCKS, FINER, SHARD_BYTES, ROLL_BYTES, DATE = 1 << 14, 1 << 10, 64 << 20, 16 << 20, "2024-01-01T00:00:00Z"
_ROWS = 256


def digest32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _header(lines: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, number: int, date: str = DATE) -> bytes:
    """One gzip member: a response with the payload, or a revisit without it. `number` tells apart records of one page."""
    digest, kind = digest32(payload), "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if refers_to is None else b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    lines = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {number}')}>"), ("WARC-Date", date), ("WARC-Target-URI", target),
        ("WARC-Profile", None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"), ("X-Payload-Length", len(payload)), ("X-Page-Id", page_id), ("X-Refers-To-Page-Id", refers_to), ("Content-Type", "application/http; msgtype=response"),
    ]
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as member:
        member.write(_header(lines, block))
    return out.getvalue()


class _File:
    """One archive file that is being written under a temporary name."""

    def __init__(self, root: str, shard: int, number: int, attempt: str):
        self.fs, path = pa.fs.FileSystem.from_uri(root)
        self.row = {"shard": shard, "number": number, "name": f"{path}/shard-{shard:06d}-{number:05d}.warc.gz", "temporary": f"{path}/_temporary/{shard:06d}-{number:05d}-{attempt}", "records": 0, "bytes": 0, "first_id": None, "last_id": None}
        self.fs.create_dir(f"{path}/_temporary", recursive=True)
        self.out, self.sum = self.fs.open_output_stream(self.row["temporary"], compression=None), hashlib.sha256()

    def add(self, page_id: int | None, raw: bytes) -> None:
        self.out.write(raw)
        self.sum.update(raw)
        r = self.row
        r["records"], r["bytes"], r["last_id"] = r["records"] + 1, r["bytes"] + len(raw), page_id
        r["first_id"] = page_id if r["records"] == 1 else r["first_id"]

    def close(self) -> dict:
        self.out.close()
        return self.row | {"sha256": self.sum.hexdigest()}


_MANIFEST = "shard int, number int, name string, temporary string, records long, bytes long, first_id long, last_id long, sha256 string"
_MANIFEST_ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[k]) for n, k in (c.split() for c in _MANIFEST.split(", "))])


def _write(root: str, roll_bytes: int, date: str):
    def run(batches):
        attempt, now, same = uuid.uuid4().hex, None, (None, 0)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                for r in batch.slice(at, _ROWS).to_pylist():
                    if now and (now.row["shard"] != r["shard"] or now.row["bytes"] >= roll_bytes):
                        yield pa.RecordBatch.from_pylist([now.close()], _MANIFEST_ARROW)
                        now = _File(root, r["shard"], now.row["number"] + 1 if now.row["shard"] == r["shard"] else 0, attempt)
                    now = now or _File(root, r["shard"], 0, attempt)
                    same = (r["page_id"], same[1] + 1 if r["page_id"] == same[0] else 0)
                    now.add(r["page_id"], record(r["page_id"], r["url"], r["html"].encode(), r["refers_to"], same[1], date))
        if now:
            yield pa.RecordBatch.from_pylist([now.close()], _MANIFEST_ARROW)

    return run


def _commit(batches):
    """Gives the files of the manifest their final names; done again, it finds them there."""
    for batch in batches:
        for r in batch.to_pylist():
            fs, _ = pa.fs.FileSystem.from_uri(r["root"])
            if fs.get_file_info(r["temporary"]).type != pa.fs.FileType.NotFound:
                fs.move(r["temporary"], r["name"])
            elif fs.get_file_info(r["name"]).type == pa.fs.FileType.NotFound:
                raise FileNotFoundError(r["name"])
        yield batch.drop_columns(["root"])


def sharded(keyed: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """keyed (page_id, sha, size) with the shard of each row, which grows with page_id, and how many shards there are.

    Blocks are named by paths that sort like their pages. Only sums by block come to the driver: BLOCKS + 1 at first, then FINER (256
    by digests) for each block that is larger than a shard, as long as there are such that hold different pages.
    """
    spark = keyed.sparkSession

    def sums(rows: DataFrame) -> dict[str, tuple[int, bool]]:
        many = (F.min("sha") != F.max("sha")) | F.coalesce(F.min("page_id") != F.max("page_id"), F.lit(False))
        return {path: (size, some) for path, size, some in rows.groupBy("path").agg(F.sum("size"), many).collect()}

    name = lambda number: F.lpad(F.hex(F.expr(number)), 16, "0")
    low, high = (x or 0 for x in keyed.agg(F.min("page_id"), F.max("page_id")).first())
    step, turn = max(1, -(-(high - low + 1) // BLOCKS)), 0
    floor = f"page_id div {step}L - cast(page_id < 0 and page_id % {step}L <> 0 as bigint)"
    now = keyed.withColumn("path", F.coalesce(name(f"{floor} - ({low // step}L)"), F.lit("-")))
    sizes = sums(now)
    while (heavy := [path for path, (size, many) in sizes.items() if size > shard_bytes and many]) and turn < 20:
        finer, digits = max(1, -(-step // FINER)), F.substring("sha", 1 + 2 * turn, 2)
        inside = F.coalesce(name(f"pmod(page_id, {step}L) div {finer}L"), digits) if step > 1 else digits
        now = now.join(F.broadcast(spark.createDataFrame([(path, True) for path in heavy], "path string, cut boolean")), "path", "left")
        now = now.withColumn("path", F.when(F.col("cut"), F.concat_ws("/", "path", inside)).otherwise(F.col("path")))
        sizes = {path: x for path, x in sizes.items() if path not in set(heavy)} | sums(now.where("cut"))
        now, step, turn = now.drop("cut"), finer, turn + 1
    total, shard, rows = 0, 0, []
    for path, (size, _) in sorted(sizes.items()):
        rows.append((path, shard))
        total += size
        if total >= shard_bytes:
            total, shard = 0, shard + 1
    return now.join(F.broadcast(spark.createDataFrame(rows, "path string, shard int")), "path").drop("path"), rows[-1][1] + 1 if rows else 1


def write_archives(pages: DataFrame, root: str, least_revisit: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE, stage: Stage | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) as archives below `root` (a URI that all executors reach) and returns the committed manifest."""
    spark = pages.sparkSession
    stage = stage or Stage(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = pages.withColumns({"sha": F.sha1("html"), "size": F.octet_length("html")})
    firsts = stage.keep(keyed.where(F.col("size") >= least_revisit).groupBy("sha", "size").agg(F.min("page_id").alias("first")), "firsts")
    placed, shards = sharded(keyed, shard_bytes)
    placed = placed.withColumn("place", F.expr("coalesce(page_id, -9223372036854775808L)"))
    keys = ["shard", "place", "sha", "size"]
    refers = F.when(~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False)), F.col("first")).alias("refers_to")
    types = placed.select(*keys, "page_id").join(firsts, ["sha", "size"], "left").select(*keys, refers).distinct()
    # Payloads are shuffled once, by shard; record types come to them there.
    parts, setting = max(shards, parallelism(spark)), "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        met = placed.select(*keys, "page_id", "url", "html").repartition(parts, "shard").hint("merge").join(types.repartition(parts, "shard"), keys)
        sorted_ = met.sortWithinPartitions(*keys).select("shard", "page_id", "url", "html", "refers_to")
        manifest = stage.keep(sorted_.mapInArrow(_write(root, roll_bytes, date), _MANIFEST), "manifest")
    finally:
        spark.conf.set(setting, before)
    final = stage.keep(manifest.withColumn("root", F.lit(root)).repartition(parallelism(spark), "name").mapInArrow(_commit, _MANIFEST), "committed")
    stage.drop("firsts")
    return final


class _Summed:
    """A stream that adds up what is read from it."""

    def __init__(self, source):
        self.source, self.size, self.sum = source, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        raw = self.source.read(n)
        self.size += len(raw)
        self.sum.update(raw)
        return raw


def _members(source):
    """The decompressed records of an archive, one gzip member at a time."""
    raw = b""
    while True:
        out, member = [], zlib.decompressobj(31)
        while not member.eof:
            if not raw and not (raw := source.read(1 << 20)):
                if out:
                    raise EOFError("the archive ends inside a record")
                return
            out.append(member.decompress(raw))
            raw = member.unused_data
        yield b"".join(out)


def parse(raw: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of one record; digests that don't match what is stored are errors."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda name: int(fields[name]) if name in fields else None
    if fields["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if digest32(payload) != digest or len(payload) != number("X-Payload-Length"):
            raise ValueError(f"payload of {fields['WARC-Record-ID']}")
    return {"page_id": number("X-Page-Id"), "payload_bytes": number("X-Payload-Length"), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id")}


_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _read(batches):
    for batch in batches:
        for root, name, records, size, sha in zip(*(batch.column(c).to_pylist() for c in ("root", "name", "records", "bytes", "sha256")), strict=True):
            fs, _ = pa.fs.FileSystem.from_uri(root)
            held, n = [], 0
            with fs.open_input_stream(name, compression=None) as source:
                source = _Summed(source)
                for raw in _members(source):
                    held.append(parse(raw))
                    n += 1
                    if len(held) == _ROWS:
                        yield pa.RecordBatch.from_pylist(held, _RECORD)
                        held = []
            if (n, source.size, source.sum.hexdigest()) != (records, size, sha):
                raise ValueError(f"{name} isn't what the manifest names: {n} of {records} records, {source.size} of {size} bytes")
            yield pa.RecordBatch.from_pylist(held, _RECORD)


def read_archives(manifest: DataFrame, root: str) -> DataFrame:
    """The records of the archives that a manifest names."""
    files = manifest.select(F.lit(root).alias("root"), "name", "records", "bytes", "sha256").repartition(parallelism(manifest.sparkSession), "name")
    return files.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8(spark, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "warc")
    root = f"{stage.root}/archives"
    return read_archives(write_archives(load(spark, sf_dir, "pages"), root, stage=stage), root)
