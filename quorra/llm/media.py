"""Media columns: payloads in content-addressed tar shards; rows carry digest, shard, offset and length.

A text's payload is stored as a PNG of 8-bit grey samples, WIDTH a row. Each task writes one shard and stores a
payload once; the index then names one place for each digest, so a digest has one address whoever wrote it (copies in
other shards, at most one a task, are not referred to). Metadata columns are filled by range reads of the
header bytes at the offset; only features read whole payloads.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorra.llm.common import as_long, fresh_dir, open_shared, publish, saved

WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and first chunk: all that the metadata columns need.
HEADER_BYTES = 33
_TAR = 512


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 bytes with bytes 255 up to a positive multiple of WIDTH, bytes before that)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data)), len(data)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lined = np.concatenate([np.zeros((len(rows), 1), dtype=np.uint8), rows], axis=1)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lined, 4)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits of a sample) from the first HEADER_BYTES bytes, checked."""
    if len(head) < HEADER_BYTES or head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    width, height, bits, color, *rest = struct.unpack(">IIBBBBB", head[16:29])
    if color or any(rest):
        raise ValueError("not a plain grey image")
    return width, height, bits


def from_png(media: bytes) -> bytes:
    """The samples, all chunk checksums checked."""
    width, height, _ = png_header(media[:HEADER_BYTES])
    at, packed = 8, []
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        if zlib.crc32(media[at + 4 : at + 8 + size]) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        if media[at + 4 : at + 8] == b"IDAT":
            packed.append(media[at + 8 : at + 8 + size])
        at += 12 + size
    lined = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    if lined[:, 0].any():
        raise ValueError("filtered rows")
    return lined[:, 1:].tobytes()


def feature(payload: bytes, width: int = WIDTH) -> str:
    """Size, mean sample, and which of 8 x 8 cells are brighter than the mean, as 16 hex digits."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    total = int(rows.sum(dtype=np.int64))
    cuts = [len(rows) * k // 8 for k in range(9)]
    bits = 0
    for k in range(8):
        top = min(cuts[k], len(rows) - 1)
        cells = rows[top : max(cuts[k + 1], top + 1)].sum(axis=0, dtype=np.int64).reshape(8, -1).sum(axis=1)
        n = (max(cuts[k + 1], top + 1) - top) * (width // 8)
        for c in cells.tolist():
            bits = bits << 1 | (c * rows.size > total * n)
    return f"{width}x{len(rows)} {total / rows.size:.3f} {bits:016x}"


def _tar_header(name: str, size: int) -> bytes:
    field = bytearray(_TAR)
    field[0 : len(name)] = name.encode()
    field[100:108], field[108:116], field[116:124] = b"0000644\0", b"0000000\0", b"0000000\0"
    # sizes of 8 GiB and more do not fit the octal field; they are stored in base 256
    field[124:136] = b"%011o\0" % size if size < 8**11 else b"\x80" + size.to_bytes(11, "big")
    field[136:148], field[156:157], field[257:265] = b"00000000000\0", b"0", b"ustar\x0000"
    field[148:156] = b" " * 8
    field[148:156] = b"%06o\0 " % sum(field)
    return bytes(field)


def store_media(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs without text, with n_bytes, digest, shard, offset, length: each payload is in a shard below path.

    digest is the SHA-256 of the stored form. Equal payloads have one address. Null and empty texts are one row of
    bytes 255. Rows that repeat a doc_id are rows of their own; result names replace clashing columns.
    """
    made = ("n_bytes", "digest", "shard", "offset", "length")
    keep = [c for c in docs.columns if c != text and c not in made]

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard = f"{TaskContext.get().partitionId():08d}.tar"
        known: dict[bytes, tuple[str, int, int]] = {}
        out_batches = []

        def fill(out) -> None:
            at = 0
            for batch in batches:
                rows = []
                for t in batch.column(len(keep)):
                    payload, n_bytes = payload_of(t.as_py())
                    key = hashlib.sha256(payload).digest()
                    if key not in known:
                        media = to_png(payload)
                        digest = hashlib.sha256(media).hexdigest()
                        out.write(_tar_header(f"{digest}.png", len(media)))
                        out.write(media + b"\0" * (-len(media) % _TAR))
                        known[key] = (digest, at + _TAR, len(media))
                        at += _TAR + len(media) + -len(media) % _TAR
                    rows.append((n_bytes, *known[key]))
                n, digest, offset, length = zip(*rows, strict=True) if rows else ((),) * 4
                more = [pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array([shard] * len(rows), pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())]
                out_batches.append(pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*keep, *made]))
            out.write(b"\0" * (2 * _TAR))

        publish(path, shard, fill)
        yield from out_batches  # addresses only, handed on after the shard is in place

    schema = docs.select(*keep).withColumns({"n_bytes": F.lit(0).cast("long"), "digest": F.lit(""), "shard": F.lit(""), "offset": F.lit(0).cast("long"), "length": F.lit(0).cast("long")}).schema
    rows = saved(docs.select(*keep, text).mapInArrow(write, schema), "media-rows")
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    index = rows.groupBy(F.col("digest").alias("d")).agg(place)
    return rows.drop("shard", "offset", "length").join(index, F.col("digest") == F.col("d")).select(*keep, "n_bytes", "digest", "place.shard", "place.offset", "place.length")


def _by_shard(index: DataFrame, path: str, read, schema: str) -> DataFrame:
    """read(source, rows of one shard) for each shard of index(digest, shard, offset, length), in order of offset."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, rows in batch.groupby("shard", sort=True):
                store, at = open_shared(f"{path}/{shard}")
                with store.open_input_file(at) as source:
                    for k in range(0, len(rows), 2000):
                        yield pd.DataFrame(read(source, rows.sort_values("offset").iloc[k : k + 2000]), columns=[x.split()[0] for x in schema.split(", ")])

    dealt = index.select("digest", "shard", "offset", "length").repartition("shard")
    return dealt.mapInPandas(run, schema)


def addresses(rows: DataFrame) -> DataFrame:
    """One row a digest."""
    return rows.groupBy("digest").agg(F.min("shard").alias("shard"), F.min("offset").alias("offset"), F.min("length").alias("length"))


def media_columns(index: DataFrame, path: str) -> DataFrame:
    """(digest, width, height, sample_bits) by range reads of HEADER_BYTES at each offset."""

    def read(source, rows):
        out = []
        for digest, offset in zip(rows["digest"], rows["offset"], strict=True):
            out.append((digest, *png_header(source.read_at(HEADER_BYTES, offset))))
        return out

    return _by_shard(index, path, read, "digest string, width long, height long, sample_bits long")


def media_features(index: DataFrame, path: str) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from the stored bytes."""

    def read(source, rows):
        out = []
        for digest, offset, length in zip(rows["digest"], rows["offset"], rows["length"], strict=True):
            media = source.read_at(length, offset)
            payload = from_png(media)
            stored = hashlib.sha256(media).hexdigest()
            if stored != digest:
                raise ValueError(f"{digest} is stored damaged")
            out.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), stored, feature(payload)))
        return out

    return _by_shard(index, path, read, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10(docs: DataFrame) -> DataFrame:
    path = fresh_dir(docs.sparkSession, "media")
    rows = saved(store_media(docs.select(as_long(F.col("doc_id")).alias("doc_id"), "text"), path), "media-index")
    index = saved(addresses(rows), "media-addresses")
    known = media_columns(index, path).join(media_features(index, path), "digest")
    out = rows.join(saved(known, "media-known"), "digest")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "shard", "offset", "length")
