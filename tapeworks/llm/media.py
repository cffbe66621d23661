"""Media columns: content-addressed payloads in tar shards, addressed by digest, shard, offset and length.

A text's payload is its UTF-8 bytes with bytes 0 up to a positive multiple of 64, stored losslessly as an 8-bit grey
PNG picture 64 samples wide. Each map task streams its members into tar shards in shared storage, a digest once per
shard, and returns only the rows' addresses; a retried task writes shards of its own, and no row points to those of the
failed one. One shard's copy of each digest is the digest's address for all rows. Metadata columns come from range
reads of the two headers (tar member, PNG IHDR); the body is read only where the payload itself is asked for.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import shared_dir, written

WIDTH = 64
_PNG = b"\x89PNG\r\n\x1a\n"
_HEAD = 512 + 33


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, level: int = 3) -> bytes:
    """An 8-bit grey PNG of the payload, 64 samples a row, no row filter."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of such a picture."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, body, height = 8, b"", 0
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            height = struct.unpack(">II", data[:8])[1]
        elif kind == b"IDAT":
            body += data
        at += 12 + size
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, WIDTH + 1)[:, 1:].tobytes()


def member(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.USTAR_FORMAT)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 64 << 20) -> DataFrame:
    """id, n_bytes, payload_bytes, digest, shard, offset, length of every row; offset is that of the member's header."""
    root = f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = pafs.FileSystem.from_uri(root)
        where.create_dir(folder, recursive=True)
        out, name, at = None, "", 0
        seen: dict[str, tuple[int, int]] = {}

        def close() -> None:
            if out is not None:
                out.write(bytes(1024))
                out.close()

        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for body in batch.column(1):
                raw = body.as_buffer().to_pybytes() if body.is_valid else b""
                payload = pad(raw)
                digest = hashlib.sha256(payload).hexdigest()
                if out is None or at >= shard_bytes:
                    close()
                    name, at, seen = f"{folder}/{uuid.uuid4().hex}.tar", 0, {}
                    out = where.open_output_stream(name)
                if digest not in seen:
                    media = encode(payload)
                    out.write(member(digest, len(media)) + media + bytes(-len(media) % 512))
                    seen[digest] = (at, len(media))
                    at += 512 + len(media) + -len(media) % 512
                for col, x in zip(cols, (len(raw), len(payload), digest, name, *seen[digest]), strict=True):
                    col.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "n_bytes", "payload_bytes", "digest", "shard", "offset", "length"])
        close()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, digest string, shard string, offset long, length long"), "media-index").withColumn("root", F.lit(root))


def describe(payload: bytes, height: int) -> str:
    """Shape and sample statistics, as text."""
    x = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, v = len(payload), np.arange(256)
    mean = float((x * v).sum()) / n
    var = float((x * v * v).sum()) / n - mean * mean
    p = x[x > 0] / n
    return f"{WIDTH}x{height};mean={mean:.6f};sd={max(var, 0.0) ** 0.5:.6f};entropy={float(-(p * np.log2(p)).sum()):.6f}"


def read_members(index: DataFrame, bodies: bool) -> DataFrame:
    """One row per digest: digest, width, height, depth, media_bytes from the headers alone; with bodies also
    payload_sha256, tail_crc32, media_sha256 and feature of what is stored."""
    spark = index.sparkSession
    bulk = index.agg(F.sum("length")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + bulk // (64 << 20))  # reads are dealt by place, not by shard
    at = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"), F.first("root").alias("root"))
    rows = at.select("root", "digest", "at.*").repartitionByRange(parts, "shard", "offset").sortWithinPartitions("shard", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, name, file = None, None, None
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for row in batch.to_pylist():
                where = where or pafs.FileSystem.from_uri(row["root"])[0]
                if row["shard"] != name:
                    name, file = row["shard"], where.open_input_file(row["shard"])
                head = file.read_at(_HEAD, row["offset"])
                info = tarfile.TarInfo.frombuf(head[:512], "utf-8", "strict")
                width, height, depth = struct.unpack(">IIB", head[512 + 16 : 512 + 25])
                if info.name != row["digest"] or info.size != row["length"]:
                    raise ValueError(f"{name} at {row['offset']}: another member")
                found = [row["digest"], width, height, depth, info.size, None, None, None, None]
                if bodies:
                    media = file.read_at(info.size, row["offset"] + 512)
                    payload = decode(media)
                    found[5:] = [hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), hashlib.sha256(media).hexdigest(), describe(payload, height)]
                for col, x in zip(cols, found, strict=True):
                    col.append(x)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["digest", "width", "height", "depth", "media_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature"])

    return rows.mapInArrow(run, "digest string, width long, height long, depth long, media_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its payload's address, header metadata and features.

    A null text is an empty one (64 bytes 0). Equal texts share a digest and have equal features; which of their stored
    copies is read makes no difference. A very long text is one member of its shard. Rows without an id and repeated
    rows are kept; an empty table gives an empty table; other columns play no part.
    """
    index = store(docs, id_col, text_col)
    return index.join(read_members(index, bodies=True), "digest").withColumnRenamed("id", id_col)


def unpack(shard: bytes) -> dict[str, bytes]:
    """Members of a whole shard, by name."""
    with tarfile.open(fileobj=io.BytesIO(shard)) as tar:
        return {x.name: tar.extractfile(x).read() for x in tar.getmembers()}
