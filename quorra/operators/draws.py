"""Multinomial resamples without a row a draw: draws travel as packed differences and are counted block by block of rows.

A replicate draws hash(seed, replicate, row) % rows for each row. Units of (replicate, CHUNK rows) hash their draws in NumPy,
sort them and send a piece to each block of 2 ** SHIFT rows that it meets: a byte a draw, less once compressed. The
block's rows, packed in the same way, are met there once for all replicates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import sin

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorra.plans.sql import run
from quorra.sources.shared import fresh_dir, remove, saved

#: Rows whose draws a unit makes, at most; the more, the closer its sorted draws lie and the fewer bytes they take.
CHUNK = 1 << 25
#: Rows of a block, as a power of two.
SHIFT = 20
#: Hashes that are made side by side, so that they stay in the processor's cache.
LANES = 16_384
#: Draws that a task makes, about.
TASK = 1 << 24
#: Draws that are on their way at a time, about: all replicates of small tables, one or more of large ones.
WAVE = 1 << 30
#: Rows that are packed at a time.
PACK = 500_000

_K = [int(abs(sin(k + 1)) * 2**32) for k in range(64)]
_TURN = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_WORD = [lambda k: k, lambda k: (5 * k + 1) % 16, lambda k: (3 * k + 5) % 16, lambda k: 7 * k % 16]


def _heads(prefix: bytes, low: int, high: int, width: int) -> np.ndarray:
    """The first 32 bits of md5(prefix + decimal) for the numbers low to high - 1, all of width digits."""
    n = high - low
    size = len(prefix) + width
    if size > 55:
        raise ValueError("the hashed text must fit one block")
    block = bytearray(64)
    block[: len(prefix)] = prefix
    block[size] = 0x80
    block[56:64] = (8 * size).to_bytes(8, "little")
    words: list = [int(x) for x in np.frombuffer(bytes(block), dtype="<u4")]
    rest = np.arange(low, high, dtype=np.int64)
    for place in range(size - 1, len(prefix) - 1, -1):
        tens = rest // 10
        digit = ((rest - 10 * tens + 48) << (8 * (place % 4))).astype(np.uint32)
        words[place // 4] = digit + np.uint32(words[place // 4]) if isinstance(words[place // 4], int) else words[place // 4] + digit
        rest = tens
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(n, x, dtype=np.uint32) for x in start)
    f, g = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    for k in range(61):  # the last three steps do not reach the first word
        turn = k // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        word = words[_WORD[turn](k)]
        if isinstance(word, int):
            f += np.uint32((_K[k] + word) & 0xFFFFFFFF)
        else:
            f += np.uint32(_K[k])
            f += word
        by = _TURN[turn][k % 4]
        np.left_shift(f, np.uint32(by), out=g)
        f >>= np.uint32(32 - by)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += np.uint32(start[0])
    return b.byteswap()


def heads(prefix: str, low: int, high: int) -> np.ndarray:
    """First 32 bits of md5 of prefix and number, for the numbers low to high - 1: dialect.hashed in NumPy."""
    out, at = np.empty(high - low, dtype=np.uint32), low
    while at < high:
        width = len(str(at))
        stop = min(high, at + LANES, 10**width)
        out[at - low : stop - low] = _heads(prefix.encode(), at, stop, width)
        at = stop
    return out


def pack(steps: np.ndarray) -> bytes:
    """Non-negative differences as bytes, 255 for each 255 to go on, compressed."""
    import pyarrow as pa

    more, last = np.divmod(steps, 255)
    if more.any():
        at = np.cumsum(more + 1) - 1
        flat = np.full(int(at[-1]) + 1, 255, dtype=np.uint8)
        flat[at] = last
    else:
        flat = last.astype(np.uint8)
    return len(flat).to_bytes(4, "little") + pa.compress(flat.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    """The sums of the differences so far: sorted places."""
    import pyarrow as pa

    flat = np.frombuffer(pa.decompress(data[4:], int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True), dtype=np.uint8)
    return np.cumsum(flat, dtype=np.int64)[flat != 255]


def _pieces(rows: int, replicates: int, seed: int, unit: int, chunk: int, shift: int) -> Iterator[tuple[int, int, bytes]]:
    """(r, block, packed places in the block) of a unit's draws."""
    part, r = divmod(unit, replicates)
    drawn = heads(f"{seed}:{r}:", part * chunk, min(rows, (part + 1) * chunk))
    if rows < 1 << 32:
        drawn %= np.uint32(rows)
    drawn.sort()
    blocks = np.arange(int(drawn[0]) >> shift, (int(drawn[-1]) >> shift) + 1)
    cuts = [0, *np.searchsorted(drawn, (blocks[1:] << shift).astype(np.uint32)), len(drawn)]
    for block, low, high in zip(blocks.tolist(), cuts, cuts[1:]):
        if low < high:
            yield r, block, pack(np.diff(drawn[low:high], prepend=np.uint32(block << shift)))


def _numbered(lines: DataFrame, shift: int) -> DataFrame:
    """sid in the order that it has, from 0 without gaps."""
    return run(lines.sparkSession, [
        ("sizes", f"SELECT shiftright(sid, {shift}) AS part, count(*) AS n FROM {{lines}} GROUP BY 1"),
        ("starts", "SELECT part, coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM sizes"),
        ("numbered", f"SELECT cast(o + row_number() OVER (PARTITION BY part ORDER BY sid) - 1 AS bigint) AS sid, i, j, w FROM {{lines}} JOIN starts ON part = shiftright(sid, {shift})"),
    ], lines=lines)


def _packed(lines: DataFrame, shift: int, path: str) -> DataFrame:
    """(block, rows, first, last, data): lines(sid, i, j, w) as compressed Arrow tables that lie in one block each."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def flush(held):
            table = pa.Table.from_batches(held)
            table = table.take(pc.sort_indices(table["sid"])).combine_chunks()
            sid = table["sid"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(sid >> shift)) + 1, [len(sid)]])
            for low, high in zip(cuts.tolist(), cuts[1:].tolist()):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(table.slice(low, high - low))
                yield pa.RecordBatch.from_pydict({"block": [int(sid[low]) >> shift], "rows": [high - low], "first": [int(sid[low])], "last": [int(sid[high - 1])], "data": [sink.getvalue().to_pybytes()]})

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= PACK:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return saved(lines.mapInArrow(work, "block long, rows long, first long, last long, data binary"), "lines-packed", tidy=True, path=path)


def multinomial(streamlines: DataFrame, replicates: int, seed: int = 42, chunk: int = CHUNK, shift: int = SHIFT, wave: int = WAVE) -> DataFrame:
    """(r, i, j, w) of streamlines(sid, a, b, w): summed weights of each edge in each replicate; r is -1 for the graph itself.

    Replicates draw as many rows as there are, with replacement, by hashes of (seed, replicate, row). Rows are told by
    sid, which counts from 0 without gaps; if its range is not that of so many rows, its order counts. Self-loops are
    drawn, but have no edge. Replicates are made in waves of about ``wave`` draws, whose shuffle files go after each.
    """
    spark = streamlines.sparkSession
    whole = isinstance(streamlines.schema["w"].dataType, T.IntegralType)
    weight = F.col("w").cast("long" if whole else "double")
    lines = streamlines.select(F.col("sid").cast("long").alias("sid"), F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), weight.alias("w"))
    paths = [fresh_dir(spark, "lines-packed")]
    packed = _packed(lines, shift, paths[0])
    span = "coalesce(sum(rows), 0) AS n", "min(first) AS low", "max(last) AS high"
    rows, low, high = packed.selectExpr(*span).first()
    if rows and (low, high) != (0, rows - 1):
        paths.append(fresh_dir(spark, "lines-packed"))
        packed = _packed(_numbered(lines, shift), shift, paths[1])
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    schema = f"r long, i {kinds['i']}, j {kinds['j']}, w {kinds['w']}"
    if not rows:
        remove(spark, *paths)
        return spark.createDataFrame([], schema)

    def drawing(first: int, count: int):
        def draw(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for unit in (x for batch in batches for x in batch.column(0).to_pylist()):
                part, k = divmod(unit, count)
                r, block, data = zip(*_pieces(rows, replicates, seed, part * replicates + first + k, chunk, shift))
                yield pa.RecordBatch.from_pydict({"block": pa.array(block, pa.int64()), "r": pa.array(r, pa.int64()), "data": pa.array(data, pa.binary())})

        return draw

    def add(draws: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        import pyarrow as pa

        table = pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in parts["data"])
        start, size = int(parts["block"].iloc[0]) << shift, 1 << shift
        place = table["sid"].to_numpy() - start
        ends = table.select(["i", "j"]).to_pandas()
        code, names = ends.groupby(["i", "j"], sort=False).ngroup().to_numpy(), ends.drop_duplicates()
        edges = names[(names["i"] != names["j"]) & names.notna().all(axis=1)]
        loop = np.ones(code.max() + 2, dtype=bool)
        loop[code[edges.index]] = False
        use = np.flatnonzero(~loop[code])  # a code of -1 (a null end) falls on the last, which stays a loop
        use = use[np.argsort(code[use], kind="stable")]
        if not len(use):
            return pd.DataFrame({"r": [], "i": [], "j": [], "w": []})
        place, w = place[use], table["w"].fill_null(0).to_numpy()[use]
        first = np.flatnonzero(np.diff(code[use], prepend=-1))
        at = use[first]
        i, j = (ends[c].to_numpy()[at] for c in "ij")
        out = [pd.DataFrame({"r": -1, "i": i, "j": j, "w": np.add.reduceat(w, first)})]
        for r, data in draws.groupby("r")["data"]:
            times = np.zeros(size, dtype=np.int64)
            for piece in data:
                times += np.bincount(unpack(piece), minlength=size)
            times = times[place]
            seen = np.add.reduceat(times, first) > 0
            summed = np.add.reduceat(np.where(times > 0, times * w, 0), first)
            out.append(pd.DataFrame({"r": r, "i": i[seen], "j": j[seen], "w": summed[seen]}))
        return pd.concat(out)

    chunk = -(-rows // -(-rows // chunk))  # units of equal size
    each, out = max(1, wave // rows), []
    for first in range(0, replicates, each):
        count = min(each, replicates - first)
        units = -(-rows // chunk) * count
        tasks = max(1, min(units, rows * count // TASK))
        draws = spark.range(0, units, 1, tasks).mapInArrow(drawing(first, count), "block long, r long, data binary")
        made = draws.groupBy("block").cogroup(packed.select("block", "data").groupBy("block")).applyInPandas(add, schema)
        made = made.groupBy("r", "i", "j").agg(F.sum("w").alias("w"))
        out.append(saved(made if not first else made.where("r >= 0"), "edge-samples", tidy=True))  # the graph itself comes in every wave
    remove(spark, *paths)
    return reduce(DataFrame.unionByName, out)
