"""Token-id files: canonical, length-limited Huffman codes from global counts, decoded by table in independent blocks.

File (little-endian but for the code bits): the code bits, most significant first; then a footer with the code
lengths of all ids, the bit offset at which every block of BLOCK ids starts, and doc ids and sizes; then the footer's
length and a magic word. A block is decoded from its checkpoint alone, so many are decoded side by side.

Files hold documents in ascending doc_id order (null first; rows with one doc_id by a hash of the text), and file
numbers ascend with doc_id.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorra.llm.common import as_long, fresh_dir, open_shared, parts, publish, saved

MAGIC = b"QHUFFID1"
BLOCK = 1024
#: Ids that are coded at a time: whole blocks, few enough for the processor's cache.
PART = 128 * BLOCK
#: No code is longer; 2 ** LIMIT entries make the decoding table.
LIMIT = 18
END = 2
#: UTF-8 bytes of text for a file, about.
FILE_BYTES = 12_000_000
#: Rows of counts that a task adds up.
FAN = 32
#: Files whose documents' rows come in one partition.
GATHER = 8


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most limit bits (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    row, leaf_at = leaves, []
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        row = both[by]
        leaf_at.append(by < len(leaves))
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(leaf_at):
        chosen = int(is_leaf[:take].sum())
        out[order[:chosen]] += 1
        take = 2 * (take - chosen)
    out[order[:take]] += 1
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code, before = 0, 0
    for size in range(1, int(lengths.max(initial=0)) + 1):
        code <<= size - before
        ids = np.flatnonzero(lengths == size)
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
        code, before = code + len(ids), size
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For every value of the next limit bits: id * 32 + length of its code."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    table = np.repeat(order.astype(np.uint32) * 32 + lengths[order], 1 << (limit - lengths[order].astype(np.int64)))
    return np.concatenate([table, np.zeros((1 << limit) - len(table), dtype=np.uint32)])


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits padded to whole bytes, bit offset of each block of BLOCK ids).

    Two neighbours become one code first (BLOCK is even, codes have at most 31 bits), so that half as many are placed.
    """
    if not len(ids):
        return b"", np.zeros(0, dtype=np.int64)
    both = (codes.astype(np.uint64) << np.uint64(6) | lengths.astype(np.uint64))[ids]
    size, code = (both & np.uint64(63)).astype(np.int64), both >> np.uint64(6)
    if len(ids) % 2:
        size, code = np.append(size, 0), np.append(code, np.uint64(0))
    code = code[::2] << size[1::2].astype(np.uint64) | code[1::2]
    size = size[::2] + size[1::2]
    stop = np.cumsum(size)
    start = stop - size
    word, room = start >> 6, 64 - (start & 63) - size
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    spill = np.flatnonzero(room < 0)
    here = code << np.maximum(room, 0).astype(np.uint64)
    here[spill] = code[spill] >> (-room[spill]).astype(np.uint64)
    words = np.zeros(int(stop[-1] >> 6) + 1, dtype=np.uint64)
    words[word[first]] = np.bitwise_or.reduceat(here, first)
    words[word[spill] + 1] |= code[spill] << (64 + room[spill]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: int(stop[-1] + 7) >> 3], start[:: BLOCK // 2]


def decode(bits: bytes, offsets: np.ndarray, sizes: np.ndarray, table: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Ids of blocks that start at the bit offsets and hold sizes ids each; all blocks advance together."""
    if not len(offsets):
        return np.zeros(0, dtype=np.uint16)
    raw = np.frombuffer(bits + b"\0" * 4, dtype=np.uint8)
    view = np.ndarray((len(raw) - 3,), dtype=">u4", buffer=raw.data, strides=(1,))
    at, out = offsets.astype(np.int64).copy(), np.zeros((int(sizes.max()), len(offsets)), dtype=np.uint16)
    full = int(sizes.min())
    for step in range(out.shape[0]):
        now = at if step < full else np.minimum(at, 8 * len(bits))
        entry = table[(view[now >> 3].astype(np.int64) >> (32 - limit - (now & 7))) & ((1 << limit) - 1)]
        out[step] = entry >> 5
        at += entry & 31
    return out.T[np.arange(out.shape[0])[None, :] < sizes[:, None]]


def _footer(lengths: np.ndarray, offsets: np.ndarray, doc_id: np.ndarray, known: np.ndarray, sizes: np.ndarray) -> bytes:
    sections = [lengths.astype(np.uint8), np.diff(offsets, prepend=0).astype("<i4"), doc_id.astype("<i8"), known.astype(np.uint8), sizes.astype("<i8")]
    packed = [zlib.compress(x.tobytes(), 3) for x in sections]
    head = json.dumps({"block": BLOCK, "limit": LIMIT, "docs": len(doc_id), "ids": int(sizes.sum()), "sections": [len(x) for x in packed]}).encode()
    body = len(head).to_bytes(4, "little") + head + b"".join(packed)
    return body + len(body).to_bytes(8, "little") + MAGIC


def _added(counts: DataFrame, fan: int = FAN) -> DataFrame:
    """counts(id array<int>, n array<long>) added up FAN rows a task, level by level, until no more than FAN are left."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for ids, n in zip(batch["id"], batch["n"], strict=True):
                total[ids] += n
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": [seen.astype(np.int32)], "n": [total[seen]]})

    rows = counts.count()
    while rows > fan:
        rows = parts(rows, fan)
        counts = saved(counts.repartition(rows).mapInPandas(add, "id array<int>, n array<long>"), "ids-added")
    return counts


def write_ids(docs: DataFrame, path: str, vocabulary: str, end: int = END, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode docs(doc_id, text) into files below path (a shared folder); returns the files: (file, docs, ids).

    Texts are encoded whole with the vocabulary file's tokenizer, and ``end`` is appended to each document. Null and
    empty texts have that id only. Rows that repeat a doc_id are all written, null doc_ids come first. Columns besides
    doc_id and text are left out, whatever their names. An empty table writes no file.
    """
    from quorra.llm import tokens

    spark = docs.sparkSession
    rough = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    if not rough[1]:
        return spark.createDataFrame([], "file int, docs long, ids long")
    count = max(parts(rough[0], file_bytes), parts(rough[1], 100_000))
    scratch = fresh_dir(spark, "ids")

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        table = tokens.words(vocabulary)
        counts = np.zeros(1 << 16, dtype=np.int64)
        stop = np.array([end], dtype="<u2").tobytes()
        file = TaskContext.get().partitionId()
        done = [0, 0]

        def write(out) -> None:
            schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.large_binary())])
            with pq.ParquetWriter(out, schema, compression="zstd", use_dictionary=False) as to:
                for batch in batches:
                    ids = [table.raw(t) + stop for t in batch["text"]]
                    flat = np.frombuffer(b"".join(ids), dtype="<u2")
                    counts[:] += np.bincount(flat, minlength=1 << 16)
                    done[0] += len(ids)
                    done[1] += len(flat)
                    doc_id = [None if x is None else int(x) for x in batch["doc_id"]]
                    to.write_table(pa.table([pa.array(doc_id, pa.int64()), pa.array(ids, pa.large_binary())], schema=schema))

        publish(scratch, f"{file}.parquet", write)
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"file": file, "docs": done[0], "ids": done[1], "id": [seen.astype(np.int32)], "n": [counts[seen]]})

    rows = docs.select(as_long(F.col("doc_id")).alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(count, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # text: pandas makes longs with nulls doubles
    made = rows.mapInPandas(tokenize, "file int, docs long, ids long, id array<int>, n array<long>")
    made = saved(made.repartition(parts(count, FAN)), "ids-made")  # a file for FAN rows: each costs processes of its own
    counts = np.zeros(1 << 16, dtype=np.int64)
    for r in _added(made.select("id", "n")).collect():  # at most FAN rows of at most 65,536 ids
        counts[r["id"]] += np.array(r["n"], dtype=np.int64)
    lengths = code_lengths(counts)

    def recode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        codes = canonical_codes(lengths)
        for file in (int(x) for batch in batches for x in batch["id"]):
            store, at = open_shared(f"{scratch}/{file}.parquet")
            if store.get_file_info(at).type.name == "NotFound":  # a task before this one has published the file
                continue
            doc_id, known, sizes, offsets = [], [], [], []

            def write(out, at=at, store=store, doc_id=doc_id, known=known, sizes=sizes, offsets=offsets) -> None:
                base, waiting = 0, []
                with store.open_input_file(at) as source:
                    for batch in pq.ParquetFile(source).iter_batches(batch_size=2048, use_threads=False):
                        column = batch.column(0)
                        known.append(np.array(column.is_valid()))
                        doc_id.append(column.fill_null(0).to_numpy(zero_copy_only=False))
                        body = [np.frombuffer(x, dtype="<u2") for x in batch.column(1).to_pylist()]
                        sizes.append(np.array([len(x) for x in body], dtype=np.int64))
                        flat = np.concatenate([*waiting, *body])
                        whole = len(flat) // BLOCK * BLOCK
                        waiting = [flat[whole:]]
                        for part in (flat[k : min(whole, k + PART)] for k in range(0, whole, PART)):
                            bits, starts = encode(part, codes, lengths)
                            offsets.append(starts + base)
                            base += 8 * len(bits)
                            out.write(bits)
                if waiting and len(waiting[0]):
                    bits, starts = encode(waiting[0], codes, lengths)
                    offsets.append(starts + base)
                    out.write(bits)
                join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, dtype=kind)
                out.write(_footer(lengths, join(offsets, np.int64), join(doc_id, np.int64), join(known, bool), join(sizes, np.int64)))

            publish(path, f"{file:08d}.ids", write)
            store.delete_file(at)
            yield pd.DataFrame({"file": [file]})

    # every file that a task has made: their number is that of the partitions, which need not be the one asked for
    top = made.agg(F.max("file")).first()[0] + 1
    spark.range(0, top, 1, top).mapInPandas(recode, "file int").count()
    return made.select("file", "docs", "ids").orderBy("file")


def _open(store, at: str):
    source = store.open_input_file(at)
    size = source.size()
    source.seek(size - 16)
    tail = source.read(16)
    if tail[8:] != MAGIC:
        raise ValueError(f"{at} is not an id file")
    length = int.from_bytes(tail[:8], "little")
    source.seek(size - 16 - length)
    body = source.read(length)
    head_end = 4 + int.from_bytes(body[:4], "little")
    head, at, found = json.loads(body[4:head_end]), head_end, []
    for n, kind in zip(head["sections"], (np.uint8, "<i4", "<i8", np.uint8, "<i8"), strict=True):
        found.append(np.frombuffer(zlib.decompress(body[at : at + n]), dtype=kind))
        at += n
    return source, head, size - 16 - length, found


def read_file(store, at: str, lanes: int = 512) -> Iterator[tuple[int | None, list[np.ndarray]]]:
    """(doc_id, its ids in pieces) for each document of a file; lanes blocks are decoded at a time."""
    source, head, end, (lengths, steps, doc_id, known, sizes) = _open(store, at)
    block, offsets = head["block"], np.cumsum(steps.astype(np.int64))
    table = decoding_table(lengths, head["limit"])
    held, have, doc, need = [], 0, 0, int(sizes[0]) if len(sizes) else 0
    with source:
        for k in range(0, len(offsets), lanes):
            some = offsets[k : k + lanes]
            low = int(some[0]) >> 3
            high = (int(offsets[k + lanes]) + 7) >> 3 if k + lanes < len(offsets) else end
            source.seek(low)
            each = np.full(len(some), block, dtype=np.int64)
            if k + lanes >= len(offsets):
                each[-1] = head["ids"] - block * (len(offsets) - 1)
            ids, at_id = decode(source.read(high - low), some - 8 * low, each, table, head["limit"]), 0
            while at_id < len(ids):
                part = ids[at_id : at_id + need - have]
                held.append(part)
                have += len(part)
                at_id += len(part)
                if have == need:
                    yield (int(doc_id[doc]) if known[doc] else None), held
                    doc, held, have = doc + 1, [], 0
                    need = int(sizes[doc]) if doc < len(sizes) else 0


def file_starts(files: DataFrame) -> DataFrame:
    """(file, start): the ids of all files before each, by sums over groups of files and then within a group."""
    grouped = files.select("file", "ids", F.floor(F.col("file") / 4096).cast("long").alias("part"))
    sums = grouped.groupBy("part").agg(F.sum("ids").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for 4096 files
    inside = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return grouped.withColumn("inside", inside).join(sums.select("part", before.alias("before")), "part").select("file", (F.col("before") + F.col("inside")).alias("start"))


def read_ids(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; start counts the ids of all documents before.

    files is what write_ids returned: a row a file, each read by a task of its own as far as the range partitioning goes.
    The rows, a few bytes a document, come in a partition for GATHER files, so that whoever writes them makes few files.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    count = files.count()
    if not count:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for file, start in ((int(f), int(s)) for batch in batches for f, s in zip(batch["file"], batch["start"], strict=True)):
            store, at = open_shared(f"{path}/{file:08d}.ids")
            rows = []
            for doc_id, pieces in read_file(store, at):
                crc, n = 0, 0
                for ids in pieces:
                    crc, n = zlib.crc32(ids.astype("<u4").tobytes(), crc), n + len(ids)
                rows.append((doc_id, start, n, crc))
                start += n
                if len(rows) == 10_000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)

    return file_starts(files).repartitionByRange(count, "file").mapInPandas(run, schema).repartition(parts(count, GATHER))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return out.astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})


def op3(docs: DataFrame, vocabulary: str) -> DataFrame:
    path = fresh_dir(docs.sparkSession, "huffman")
    files = write_ids(docs, path, vocabulary)
    return read_ids(docs.sparkSession, path, files)
