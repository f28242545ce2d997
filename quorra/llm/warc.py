"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame for each record."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorra.llm.common import as_long, fresh_dir, open_shared, parts, publish, saved

#: Skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: Payloads below this are never revisits.
LEAST = 1000
#: Pages that the dictionary is trained on at most, characters of each, and the dictionary's bytes.
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 8192, 65536
#: Payload bytes of a file, about.
FILE_BYTES = 24_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page_id: int | None, digest: str, again: int = 0) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}{f':{again}' if again else ''}>"


def _page(urn: str) -> int | None:
    value = urn[1:-1].split(":")[2]
    return None if value == "none" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, again: int = 0) -> bytes:
    """One WARC record: a response holds the payload, a revisit names the record that does and keeps digest and size.

    again: how many records of the same page and payload came before it; it keeps record ids apart.
    """
    sha1 = hashlib.sha1(payload).digest()
    digest = base64.b32encode(sha1).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id, digest, again)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join(c for c in url or 'about:blank' if c not in '\r\n')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {_urn(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    body = b"" if revisit else payload
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record, checked: version, required headers, lengths, payload digest."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not gap or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    missing = {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Payload-Digest", "WARC-Payload-Length"} - headers.keys()
    if missing:
        raise ValueError(f"record without {sorted(missing)}")
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record of {len(rest) - 4} bytes says {size}")
    block = rest[:size]
    if headers["WARC-Type"] == "response":
        if int(headers["WARC-Payload-Length"]) != size:
            raise ValueError("payload length differs")
        if headers["WARC-Payload-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
            raise ValueError("payload digest differs")
    elif headers["WARC-Type"] == "revisit":
        if size or "WARC-Refers-To" not in headers:
            raise ValueError("revisit with a block or without its target")
    else:
        raise ValueError(f"unknown type {headers['WARC-Type']}")
    return headers, block


def train_dictionary(pages: DataFrame) -> bytes:
    """Dictionary from at most SAMPLE different pages, those smallest by a hash of their content; empty if there is too little.

    The hashes alone are gathered first, then the heads of the pages that they name, each once.
    """
    import zstandard

    keyed = pages.where(F.length("html") > 0).select(F.xxhash64("html").alias("k"), F.substring("html", 1, SAMPLE_CHARS).alias("html"))
    smallest = [r["k"] for r in keyed.select("k").distinct().orderBy("k").limit(SAMPLE).collect()]
    if len(smallest) < 20:
        return b""
    heads = keyed.where((F.col("k") <= smallest[-1])).groupBy("k").agg(F.min("html").alias("html"))  # SAMPLE rows
    texts = [r["html"].encode("utf-8", "surrogatepass") for r in heads.orderBy("k").collect()]
    try:
        size = min(DICTIONARY_BYTES, sum(map(len, texts)) // 10)
        return zstandard.train_dictionary(size, texts).as_bytes() if size >= 1024 else b""
    except zstandard.ZstdError:  # too uniform or too small to train on
        return b""


def frames(source) -> Iterator[tuple[int, bytes]]:
    """(magic, whole frame) of each frame of a stream, by walking block headers; skippable frames without their header."""

    def need(n: int) -> bytes:
        got = source.read(n)
        if len(got) != n:
            raise ValueError("archive is cut short")
        return got

    while first := source.read(4):
        magic = int.from_bytes(first, "little")
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            yield magic, need(int.from_bytes(need(4), "little"))
            continue
        if magic != FRAME_MAGIC:
            raise ValueError("not a Zstandard frame")
        got = [first, need(1)]
        flags = got[1][0]
        single, checksum = flags >> 5 & 1, flags >> 2 & 1
        size = (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        got.append(need(size))
        last = False
        while not last:
            head = need(3)
            block = int.from_bytes(head, "little")
            last, kind, length = block & 1 == 1, block >> 1 & 3, block >> 3
            got += [head, need(1 if kind == 1 else length)]
        got.append(need(4 * checksum))
        yield magic, b"".join(got)


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Checked records of one archive; a leading skippable frame gives the dictionary."""
    import zstandard

    reader = zstandard.ZstdDecompressor()
    for n, (magic, body) in enumerate(frames(source)):
        if magic == DICTIONARY_MAGIC:
            if n:
                raise ValueError("the dictionary must come first")
            if body[:4] == FRAME_MAGIC.to_bytes(4, "little"):
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
        elif magic == FRAME_MAGIC:
            whole = reader.decompressobj()
            yield parse(whole.decompress(body))


def write_archives(pages: DataFrame, path: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of pages(page_id, url, html) below path; returns the files: (file, records).

    Of rows with equal payloads of at least ``least`` bytes the one with the largest page_id is the response and the
    others are revisits of it; equal rows of that page_id are all responses. Null html is an empty payload, a null
    page_id never is the largest unless all are null (then all are responses), a null url is about:blank.
    """
    import zstandard

    spark = pages.sparkSession
    base = pages.select(as_long(F.col("page_id")).alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("size", F.octet_length("html"))
    trained = train_dictionary(base)
    meta = base.where(F.col("size") >= least).select(F.sha1(F.col("html").cast("binary")).alias("digest"), "page_id")
    first = meta.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = saved(first, "warc-first")
    large = base.where(F.col("size") >= least).withColumn("digest", F.sha1(F.col("html").cast("binary"))).join(first, "digest", "left")
    # small payloads are never revisits: they have no part in the join, where they would share one null key
    small = base.where(F.col("size") < least).select(F.lit(None).cast("string").alias("digest"), *base.columns, F.lit(None).cast("long").alias("first_id"))
    marked = large.unionByName(small)
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    count = max(parts(total[0], file_bytes), parts(total[1], 200_000))
    # a task a file, dealt by a hash of the row: files are even whatever groups of copies there are, and a lost task rewrites its file alone
    rows = marked.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("first_id")).alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        done = [0]

        def fill(out) -> None:
            book = zstandard.ZstdCompressionDict(trained) if trained else None
            writer = zstandard.ZstdCompressor(level=3, dict_data=book, write_checksum=True)
            if trained:
                packed = zstandard.ZstdCompressor(level=9).compress(trained)
                out.write(DICTIONARY_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed)
            seen: dict[tuple, int] = {}  # rows of a file: those that repeat page and payload are all in one
            for batch in batches:
                for page_id, url, html, revisited, target in zip(batch["page_id"], batch["url"], batch["html"], batch["revisit"], batch["refers_to"], strict=True):
                    page = None if page_id is None or page_id != page_id else int(page_id)
                    before = seen.get(key := (page, hash(html)), 0)
                    seen[key] = before + 1
                    out.write(writer.compress(record(page, url, html.encode("utf-8", "surrogatepass"), int(target) if revisited else None, bool(revisited), before)))
                    done[0] += 1

        publish(path, f"{part:08d}.warc.zst", fill)
        yield pd.DataFrame({"file": [part], "records": [done[0]]})

    # ids travel as decimal text: pandas would turn longs with nulls into doubles
    rows = rows.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    dealt = rows.repartition(count, "page_id", F.xxhash64("html"))
    return saved(dealt.mapInPandas(write, "file int, records long").where("records > 0"), "warc-files")


def read_archives(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, html) of all records; html null for revisits."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for file in (int(x) for batch in batches for x in batch["id"]):
            store, at = open_shared(f"{path}/{file:08d}.warc.zst")
            if store.get_file_info(at).type.name == "NotFound":  # its task had no rows
                continue
            rows, held = [], 0
            with store.open_input_stream(at, compression=None, buffer_size=1 << 20) as source:
                for headers, block in read_archive(source):
                    revisit = headers["WARC-Type"] == "revisit"
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    rows.append((_page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), int(headers["WARC-Payload-Length"]), digest, headers["WARC-Type"], _page(headers["WARC-Refers-To"]) if revisit else None, None if revisit else block.decode("utf-8", "surrogatepass")))
                    held += len(block)
                    if held > 1 << 23 or len(rows) >= 20_000:
                        yield _typed(rows, names)
                        rows, held = [], 0
            yield _typed(rows, names)

    top = (files.agg(F.max("file")).first()[0] or 0) + 1
    return spark.range(0, top, 1, top).mapInPandas(run, schema)  # a task a file


def _typed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names, dtype=object)
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": np.int64})


def op6(pages: DataFrame) -> DataFrame:
    path = fresh_dir(pages.sparkSession, "warc")
    files = write_archives(pages, path)
    return read_archives(pages.sparkSession, path, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same rows in DuckDB.
OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM q)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""
