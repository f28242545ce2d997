"""Best-fit packing planned on the histogram of lengths; documents take planned slots by their rank within a length.

The plan packs counts, not documents. Lengths come in descending order; open sequences are held as groups of
equal free space, and the items of a length go to the group with the least space that fits, one a sequence, whole
groups at a time. A group is a range of sequence numbers, so a plan row says: the items of this length with ranks from r
on take the sequences from s on, at this offset. The plan has at most a row for each pair of length and free space,
however many documents there are.
"""

from __future__ import annotations

import zlib
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorra.llm.common import as_long, parts, saved

CAPACITY = 1024
END = 2
#: Pieces of one slice of a length, about; ranks are counted within slices.
SLICE = 50_000


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, items, first sequence, offset) that pack the histogram by best fit, longest first."""
    open_by: dict[int, list[tuple[int, int]]] = {}  # free space -> ranges of sequences (first, count)
    rows, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"no sequence holds {length}")
        rank, left = 0, histogram[length]
        # a sequence that took one item is a better fit for the next one than any emptier one
        for free in sorted(f for f in open_by if f >= length):
            groups = open_by.pop(free)
            full = free // length
            while groups and left:
                first, count = groups.pop()
                used, each = min(count, left // full), full
                if not used:  # the last items share one sequence
                    used, each = 1, left
                if count > used:
                    groups.append((first + used, count - used))
                for k in range(each):
                    rows.append((length, rank, used, first, capacity - free + k * length))
                    rank += used
                left -= each * used
                if free > each * length:
                    open_by.setdefault(free - each * length, []).append((first, used))
            if groups:
                open_by.setdefault(free, []).extend(groups)
            if not left:
                break
        per = capacity // length
        for count, each in ((left // per, per), (1, left % per)):
            if left and count and each:
                for k in range(each):
                    rows.append((length, rank, count, sequences, k * length))
                    rank += count
                if capacity > each * length:
                    open_by.setdefault(capacity - each * length, []).append((sequences, count))
                sequences += count
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, vocabulary: str, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, row_key, piece, start, length, ids_crc32): documents as pieces of at most capacity ids.

    Texts are encoded whole, ``end`` is appended; null and empty texts are that id alone. Documents of more ids are
    cut into pieces of capacity, the first of which takes what is over. Null and repeated doc_ids pass through, each
    row is a document of its own; columns besides doc_id and text are left out, whatever their names.
    """
    from quorra.llm import tokens

    def run(batches):
        import pyarrow as pa

        table, stop = tokens.words(vocabulary), np.array([end], dtype="<u2").tobytes()
        for batch in batches:
            count, length, crc = [], [], []
            for text in batch.column(2):
                wide = memoryview(np.frombuffer(table.raw(text.as_py()) + stop, dtype="<u2").astype("<u4").view(np.uint8))
                first = (len(wide) // 4 - 1) % capacity + 1
                cuts = [0, *range(4 * first, len(wide) + 1, 4 * capacity)]
                crc += [zlib.crc32(wide[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
                count.append(len(cuts) - 1)
                length.append(first)
            n = np.array(count, dtype=np.int64)
            doc, at = np.repeat(np.arange(len(n)), n), np.concatenate([[0], np.cumsum(n)])
            piece = np.arange(len(doc)) - at[doc]
            head = np.array(length, dtype=np.int64)[doc]
            start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
            size = np.where(piece == 0, head, capacity)
            rows = [batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, names=["doc_id", "row_key", "piece", "start", "length", "ids_crc32"])

    schema = "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long"
    return docs.select(as_long(F.col("doc_id")).alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(run, schema)


def pack(cut: DataFrame, capacity: int = CAPACITY, files: int | None = None) -> DataFrame:
    """cut with sequence_id and offset: pieces of length 1 to capacity packed into few sequences without gaps.

    Ranks within a length follow row_key, doc_id and piece; pieces equal in these are interchangeable. A length
    that holds most pieces is ranked slice by slice. Columns of cut that clash with a result or a step of the plan
    (slice, rank, ahead, sequence_id, offset) are replaced or left out; its other columns pass through. Null length:
    an error. Empty table: empty result. The table of slices has at most ``files`` files, if given.
    """
    cut = cut.drop("slice", "rank", "ahead", "sequence_id", "offset")
    names = cut.columns
    counts = cut.groupBy("length").count().collect()  # at most capacity rows
    total = sum(r["count"] for r in counts)
    table = plan({r["length"]: r["count"] for r in counts}, capacity)
    slices = parts(total, SLICE)
    sliced = cut.withColumn("slice", F.pmod(F.xxhash64("row_key", "piece"), F.lit(slices)).cast("int"))
    per = saved(sliced.groupBy("length", "slice").agg(F.count("*").alias("n")), "pack-slices", files=files)
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("length").alias("l"), F.col("slice").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("length", "slice").orderBy("row_key", "doc_id", "piece"))
    ranked = sliced.withColumn("rank", rank - 1).join(per, (F.col("length") == F.col("l")) & (F.col("slice") == F.col("s")))
    ranked = ranked.withColumn("rank", (F.col("rank") + F.col("ahead")).cast("long")).select(*names, "rank")

    order = np.lexsort((table[:, 1], table[:, 0]))
    table = table[order]
    key = table[:, 0] << 44 | table[:, 1]

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            rank, length = batch.column("rank").to_numpy(), batch.column("length").to_numpy()
            row = np.searchsorted(key, length << 44 | rank, side="right") - 1
            rows = [*batch.columns[:-1], pa.array(table[row, 3] + rank - table[row, 1]), pa.array(table[row, 4])]
            yield pa.RecordBatch.from_arrays(rows, names=[*names, "sequence_id", "offset"])

    schema = cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return ranked.mapInArrow(place, schema)


def op7(docs: DataFrame, vocabulary: str, files: int | None = None) -> DataFrame:
    cut = saved(pieces(docs, vocabulary), "pieces")
    return pack(cut, files=files).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
