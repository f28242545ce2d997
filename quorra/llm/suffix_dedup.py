"""Removal of repeated strings by prefix-free parsing.

A rolling hash over eight bytes marks triggers: a fixed set, about one position in ``every``. A trigger ends one phrase
and begins the next, so a text is a parse of dictionary phrases. Where a window of starts has no trigger in reach, its
smallest hash stands in. The starts from one trigger to the next are a run: every string of ``length`` bytes that begins
in it reaches the trigger, so it is a phrase tail (from its start to the trigger) and then a piece of the parse
(from the trigger on), and two strings are equal exactly if both are.

Corpus order comes in two steps. First all runs are range-sorted by the head of their parse suffix (the bytes after the
trigger that every string of the run holds) and then by their whole span, and each is held against its two neighbours:
a run whose head no neighbour has is unique; one whose span a neighbour has is repeated throughout; the others,
which lie at the ends of repeated passages, go on with the bytes around them. Second, the members of one head are cut
into phrases again. Their sorted dictionary gives every phrase a rank, the suffix array of the parse is the order of the
rank sequences, and the order of the phrases read backwards is that of the tails. With the common lengths of
neighbours in both orders, strings that start i bytes before their triggers are equal exactly if the tails agree on
i bytes and the parse suffixes on length - i.

A head that very many runs share (a passage in a third of all texts) is not ordered in one task: its starts are halved
by their distance to the trigger, and the halves, which have longer heads, are sorted and held against their
neighbours as before, until what is left of a head fits a task or is one string.

Passages of words are the same with words for bytes: a text is then the sequence of its words' 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorra.llm.common import WORD, as_long, parts, saved

LENGTH = 400
#: The corpus stage also cuts passages of so many words (more than 50) that occur elsewhere, however few bytes they have.
PASSAGE = 51
#: Members of one head that are ordered in one task; larger groups are halved first.
CROWD = 50_000
#: Rows of runs in a task of the sort, and members of all heads in a task of the second step, about.
SORTED, ORDERED = 250_000, 5_000
_GRAM = 8
_PIECE = 1 << 22
_LOW = np.uint64(0xFFFFFFFF)

_digest = xxhash.xxh3_64_intdigest


class Scale:
    """Strings of ``length`` symbols (bytes, or words of 8 hashed bytes); starts and lengths count symbols.

    window: starts' distance to their trigger stays below it. every: one symbol in so many is a trigger.
    head: symbols from the trigger on that every string of a run holds.
    """

    def __init__(self, length: int, words: bool = False):
        self.length, self.words, self.unit = length, words, 8 if words else 1
        self.gram = _GRAM // self.unit
        if length < 2 * self.gram:
            raise ValueError(f"length must be at least {2 * self.gram}")
        self.window = max(1, min(16 * length // 25, length - self.gram))
        self.every = max(2, self.window // 4)
        self.head = length - self.window + 1

    def symbols(self, text: str | None) -> bytes:
        data = (text or "").encode("utf-8", "surrogatepass")
        if not self.words:
            return data
        found = data.split()
        return np.fromiter(map(_digest, found), dtype="<u8", count=len(found)).tobytes()

    def size(self, data: bytes) -> int:
        return len(data) // self.unit

    def part(self, data, start: int, stop: int):
        return data[start * self.unit : stop * self.unit]


def _hashes(data, count: int, at: int, unit: int) -> np.ndarray:
    h = np.ndarray((count,), dtype="<u8", buffer=data, offset=at * unit, strides=(unit,)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def _triggers(h: np.ndarray, scale: Scale) -> np.ndarray:
    return (h >> np.uint64(32)) % np.uint64(scale.every) == 0


def runs(data: bytes, scale: Scale) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first start, last start) of every run of starts, ascending; long texts by pieces."""
    total, width = scale.size(data) - scale.length + 1, scale.window
    out = []
    for at in range(0, total, _PIECE):
        starts = min(_PIECE, total - at)
        spots = starts + width - 1
        h = _hashes(data, spots, at, scale.unit)
        place = np.arange(spots, dtype=np.int64)
        nearest = np.where(_triggers(h, scale), place, np.int64(1) << 60)
        nearest = np.minimum.accumulate(nearest[::-1])[::-1][:starts]
        spot = nearest
        far = nearest - place[:starts] >= width
        if far.any():
            h = (h & ~_LOW) | place.astype(np.uint64)
            whole = -(-spots // width) * width
            h = np.concatenate([h, np.full(whole - spots, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
            ahead = np.minimum.accumulate(h, axis=1).ravel()
            behind = np.minimum.accumulate(h[:, ::-1], axis=1)[:, ::-1].ravel()
            least = np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts])
            spot = np.where(far, (least & _LOW).astype(np.int64), nearest)
        cut = np.flatnonzero(spot[1:] != spot[:-1])
        first = np.concatenate([[0], cut + 1])
        out.append((spot[first] + at, first + at, np.concatenate([cut, [starts - 1]]) + at))
    if not out:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _i64(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _parsed(texts: DataFrame, scale: Scale) -> DataFrame:
    """(key, check, n, copies, at, hi, lo, after, span) of each distinct text of texts(key, text); the last five are arrays, a run each."""

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = scale.symbols(text.as_py())
                spot, first, last = runs(data, scale)
                view = memoryview(data)
                after = [_digest(scale.part(view, t, t + scale.head)) for t in spot.tolist()]
                span = [_digest(scale.part(view, a, b + scale.length)) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                rows.append((key, _i64([_digest(data)])[0], scale.size(data), spot, (spot - first).astype(np.int32), (spot - last).astype(np.int32), _i64(after), _i64(span)))
            key, check, n, *lists = zip(*rows, strict=True) if rows else ((),) * 8
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists[0]])]).astype(np.int32))
            flat = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else [], kind)) for x, kind in zip(lists, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(check, pa.int64()), pa.array(n, pa.int64()), *flat], names=["key", "check", "n", "at", "hi", "lo", "after", "span"])

    made = texts.mapInArrow(parse, "key long, check long, n long, at array<long>, hi array<int>, lo array<int>, after array<long>, span array<long>")
    lists = [F.first(c).alias(c) for c in ("n", "at", "hi", "lo", "after", "span")]
    # copies are one text from here on; they are added up before the shuffle
    return made.where("n >= " + str(scale.length)).groupBy("key", "check").agg(*lists, F.count("*").alias("copies"))


def marked(rows: DataFrame, name: str) -> DataFrame:
    """rows(after, span, key, at, ...) that share after with another, with kind: 1 span is shared too, 2 it is not, 4 stands for its span.

    Rows are range-sorted, so that one value of after may fill many tasks, and held against their neighbours. The rows
    at the borders of tasks, two a task, are held against one another afterwards. A span that is shared, in a group
    of more than one span, has a row or two of kind 5, which stand for it.
    """
    import pyarrow as pa

    order = ["after", "span", "key", "at"]
    more = [c for c in rows.columns if c not in order]
    rows = rows.select(*order, *more)
    schema = rows.withColumns({c: F.lit(0) for c in ("kind", "part", "side", "inner")}).schema
    names = schema.names

    def kinds(pa_, ps, na, ns):
        whole = ps | ns
        return np.where(whole, 1 + 4 * ((pa_ & ~ps) | (na & ~ns)), np.where(pa_ | na, 2, 0)).astype(np.int32)

    def border(batch: pa.RecordBatch, part: int, side: int, inner: int) -> pa.RecordBatch:
        fill = [pa.array([x], pa.int32()) for x in (0, part, side, inner)]
        return pa.RecordBatch.from_arrays([*batch.columns, *fill], names=names)

    def mark(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, known = None, None  # the last row so far, and its bits (same after, same span) with the row before it
        for batch in batches:
            if not batch.num_rows:
                continue
            both = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            after, span = both.column(0).to_numpy(), both.column(1).to_numpy()
            same = after[1:] == after[:-1]
            equal = same & (span[1:] == span[:-1])
            if known is None and both.num_rows > 1:  # the first row of the task
                yield border(both.slice(0, 1), part, 0, int(same[0]) + 2 * int(equal[0]))
            elif both.num_rows > 1:
                kind = kinds(np.array([known & 1 > 0]), np.array([known & 2 > 0]), same[:1], equal[:1])
                if kind[0]:
                    yield pa.RecordBatch.from_arrays([*both.slice(0, 1).columns, pa.array(kind), *[pa.array([x], pa.int32()) for x in (-1, 0, 0)]], names=names)
            if both.num_rows > 2:
                kind = kinds(same[:-1], equal[:-1], same[1:], equal[1:])
                some = np.flatnonzero(kind)
                if len(some):
                    taken = both.slice(1, len(kind)).take(pa.array(some))
                    fill = [pa.array(np.full(len(some), x, dtype=np.int32)) for x in (-1, 0, 0)]
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(kind[some]), *fill], names=names)
            if both.num_rows > 1:
                known = int(same[-1]) + 2 * int(equal[-1])
            held = both.slice(both.num_rows - 1, 1)
        if held is not None:
            yield border(held, part, 1, -1 if known is None else known)

    count = rows.count()
    dealt = rows.repartitionByRange(parts(count, SORTED), *order).sortWithinPartitions(*order)
    made = saved(dealt.mapInArrow(mark, schema), name)
    line = Window.orderBy("part", "side")  # two rows a task
    near = lambda f: [(f("after", 1).over(line) == F.col("after")), (f("span", 1).over(line) == F.col("span"))]
    pa_, ps = (F.coalesce(x, F.lit(False)) for x in near(F.lag))
    na, ns = (F.coalesce(x, F.lit(False)) for x in near(F.lead))
    alone, first = F.col("inner") < 0, F.col("side") == 0
    bit = lambda k: F.col("inner").bitwiseAND(k) > 0
    ends = made.where("part >= 0").withColumns({"pa": F.when(alone | first, pa_).otherwise(bit(1)), "ps": F.when(alone | first, pa_ & ps).otherwise(bit(2)), "na": F.when(alone | ~first, na).otherwise(bit(1)), "ns": F.when(alone | ~first, na & ns).otherwise(bit(2))})
    stands = ((F.col("pa") & ~F.col("ps")) | (F.col("na") & ~F.col("ns"))).cast("int")
    ends = ends.withColumn("kind", F.when(F.col("ps") | F.col("ns"), 1 + 4 * stands).when(F.col("pa") | F.col("na"), 2).otherwise(0))
    return made.where("part < 0").select(*names[:-3]).unionByName(ends.where("kind > 0").select(*names[:-3]))


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, dtype=np.uint8, count=n) != np.frombuffer(b, dtype=np.uint8, count=n)))


def suffix_order(group: np.ndarray, parses: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each parse in the order by (group, phrases), and each sorted one's common bytes with the one before; -1 across groups.

    Neighbouring phrases of a parse overlap by a trigger, so that no phrase but a last one begins another, and
    the order of phrase ranks is that of the bytes.
    """
    phrases = sorted({w for p in parses for w in p})
    rank_of = {w: r for r, w in enumerate(phrases)}
    ranks = [[rank_of[w] for w in p] for p in parses]
    order = np.array(sorted(range(len(parses)), key=lambda k: (group[k], ranks[k])), dtype=np.int64)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    common = np.full(len(order), -1, dtype=np.int64)
    for k in range(1, len(order)):
        if group[order[k]] != group[order[k - 1]]:
            continue
        at = 0
        for x, y in zip(ranks[order[k - 1]], ranks[order[k]], strict=False):
            if x != y:
                common[k] = at + _common(phrases[x], phrases[y])
                break
            at += len(phrases[x]) - _GRAM
        else:
            common[k] = at + _GRAM  # one is the whole beginning of the other
    return place, common


def phrases_of(strings: list[bytes], scale: Scale) -> list[list[bytes]]:
    """Each string's phrases: from a trigger, or the start, through the next trigger, or to the end."""
    out = []
    for s in strings:
        spots = scale.size(s) - scale.gram + 1
        cuts = (np.flatnonzero(_triggers(_hashes(s, spots, 0, scale.unit), scale)) * scale.unit).tolist() if spots > 0 else []
        at, mine = 0, []
        for c in cuts:
            if c > 0:
                mine.append(s[at : c + _GRAM])
                at = c
        mine.append(s[at:])
        out.append(mine)
    return out


def repeated_starts(group: np.ndarray, tails: list[bytes], suffixes: list[bytes], hi: np.ndarray, lo: np.ndarray, scale: Scale) -> list[tuple[int, int, int]]:
    """(member, i, j): starts from i down to j symbols before the member's trigger repeat in its group.

    tails: symbols from the first start to the trigger; suffixes: from the trigger to the end of the last
    string. Combines the order of the dictionary's tails with that of the parse's suffixes.
    """
    unit = scale.unit
    if unit > 1:
        back = [np.frombuffer(t, dtype="<u8")[::-1].tobytes() for t in tails]
    else:
        back = [t[::-1] for t in tails]
    tail_rank, tail_common = suffix_order(group, [[b] for b in back])
    rank, common = suffix_order(group, phrases_of(suffixes, scale))
    open_at, found = np.full(len(group), -1, dtype=np.int64), []
    for i in range(int(hi.max(initial=-1)), int(lo.min(initial=0)) - 2, -1):
        live = np.flatnonzero((lo <= i) & (i <= hi)) if i >= 0 else np.zeros(0, dtype=np.int64)
        twice = np.zeros(len(group), dtype=bool)
        if len(live) > 1:
            pair = np.cumsum(tail_common < i * unit)[tail_rank[live]] * (len(group) + 1) + np.cumsum(common < (scale.length - i) * unit)[rank[live]]
            order = np.argsort(pair, kind="stable")
            equal = pair[order][1:] == pair[order][:-1]
            twice[live[order[1:][equal]]] = True
            twice[live[order[:-1][equal]]] = True
        ended = np.flatnonzero(~twice & (open_at >= 0))
        found += [(int(c), int(open_at[c]), i + 1) for c in ended]
        open_at[ended] = -1
        open_at[twice & (open_at < 0)] = i
    return found


_SPAN = "key long, at long, after long, start long, stop long"


def repeated_spans(texts: DataFrame, scale: Scale, crowd: int = CROWD, files: int | None = None) -> DataFrame:
    """(key, at, after, start, stop) of texts(key, text): symbols that strings found elsewhere cover.

    key must be a hash of the text, the same for equal texts. A span is backed by the hash ``after`` of the head at symbol
    ``at``, or of the whole text if at is -1 (a text that has a copy), which tells texts apart whose keys collide. The tables of
    the parse and of the contexts have at most ``files`` files each, if given.
    """
    length = scale.length
    parsed = saved(_parsed(texts, scale), "parse", files=files)
    each = parsed.select("key", F.explode(F.arrays_zip("at", "hi", "lo", "after", "span")).alias("x")).select("key", "x.*")
    marks = saved(marked(each, "parse-sorted"), "parse-marked")
    span = ["key", "at", "after", (F.col("at") - F.col("hi")).alias("start"), (F.col("at") - F.col("lo") + length).alias("stop")]
    spans = marks.where(F.col("kind").bitwiseAND(1) > 0).select(*span)
    spans = spans.unionByName(parsed.where("copies > 1").selectExpr("key", "-1L AS at", "check AS after", "0L AS start", "n AS stop"))

    own = (F.col("kind") == 2).alias("own")
    lists = marks.where("kind >= 2").groupBy("key").agg(F.collect_set(F.struct("at", "hi", "lo", "after", own)).alias("wanted"))

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for batch in batches:
            rows = []
            for key, text, asked in zip(batch["key"], batch["text"], batch["wanted"], strict=True):
                if before == (key, text):  # copies stand together after the join
                    continue
                before, data = (key, text), scale.symbols(text)
                for x in asked:
                    t, hi, lo, after = x["at"], x["hi"], x["lo"], x["after"]
                    if t - lo + length <= scale.size(data) and _i64([_digest(scale.part(data, t, t + scale.head))])[0] == after:
                        rows.append((key, t, hi, lo, after, x["own"], scale.part(data, t - hi, t - lo + length)))
            yield pd.DataFrame(rows, columns=["key", "at", "hi", "lo", "after", "own", "body"])

    made = texts.join(lists, "key").mapInPandas(contexts, "key long, at long, hi int, lo int, after long, own boolean, body binary")
    waiting = saved(made.dropDuplicates(["key", "at", "hi", "lo", "after", "own"]).withColumn("grp", F.col("after")), "contexts", files=files)
    width = scale.window
    while True:
        # at most one row for every ``crowd`` members
        large = saved(waiting.groupBy("grp").count().where(F.col("count") > crowd).select("grp"), "contexts-crowds")
        if large.isEmpty():
            return spans.unionByName(_ordered(waiting, scale))
        width = -(-width // 2)
        spans = spans.unionByName(_ordered(waiting.join(F.broadcast(large), "grp", "left_anti"), scale))
        halves = saved(_halved(waiting.join(F.broadcast(large), "grp", "left_semi"), scale, width), "contexts-halves")
        named = halves.withColumnsRenamed({"after": "text_after", "grp": "after"})
        marks = saved(marked(named, "contexts-sorted"), "contexts-marked").withColumnsRenamed({"after": "grp", "text_after": "after"})
        spans = spans.unionByName(marks.where((F.col("kind").bitwiseAND(1) > 0) & F.col("own")).select(*span))
        waiting = marks.where("kind >= 2").withColumn("own", F.col("own") & (F.col("kind") == 2)).select("key", "at", "hi", "lo", "after", "own", "body", "grp")


def _halved(contexts: DataFrame, scale: Scale, width: int) -> DataFrame:
    """Members with their starts dealt to blocks of ``width`` distances; grp is the hash of what all strings of the block hold, span that of the member's part."""
    unit, length = scale.unit, scale.length
    names = ["key", "at", "hi", "lo", "after", "own", "body", "grp", "span"]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, at, hi, lo, after, own, body, grp in batch[names[:-1]].itertuples(index=False):
                for block in range(lo // width, hi // width + 1):
                    low, high = max(lo, block * width), min(hi, (block + 1) * width - 1)
                    part = body[(hi - high) * unit : (hi - low + length) * unit]
                    core = body[max(0, hi - block * width) * unit : (hi - (block + 1) * width + 1 + length) * unit]
                    head = b"%d:%d:" % (grp, block) + core
                    rows.append((key, at, high, low, after, own, part, *_i64([_digest(head), _digest(b"%d:%d:" % (low, high) + part)])))
            yield pd.DataFrame(rows, columns=names)

    return contexts.mapInPandas(split, "key long, at long, hi int, lo int, after long, own boolean, body binary, grp long, span long")


def _ordered(contexts: DataFrame, scale: Scale) -> DataFrame:
    """Spans of the members' repeated starts; the members of a group are in one task, of about ORDERED or the group's."""
    slots = parts(contexts.count(), ORDERED)
    unit = scale.unit

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        hi, lo = pdf["hi"].to_numpy().astype(np.int64), pdf["lo"].to_numpy().astype(np.int64)
        tails = [bytes(x[: k * unit]) for x, k in zip(pdf["body"], hi.tolist(), strict=True)]
        suffixes = [bytes(x[k * unit :]) for x, k in zip(pdf["body"], hi.tolist(), strict=True)]
        found = repeated_starts(pdf["grp"].to_numpy(), tails, suffixes, hi, lo, scale)
        key, at, own, after = (pdf[c].to_numpy() for c in ("key", "at", "own", "after"))
        rows = [(key[c], at[c], after[c], at[c] - i, at[c] - j + scale.length) for c, i, j in found if own[c]]
        return pd.DataFrame(rows, columns=["key", "at", "after", "start", "stop"])

    slot = F.pmod(F.xxhash64("grp"), F.lit(slots)).cast("int")
    return contexts.withColumn("slot", slot).groupBy("slot").applyInPandas(order, _SPAN)


def word_offsets(data: bytes) -> np.ndarray:
    """(start, stop) of each of data.split()."""
    raw = np.frombuffer(data, dtype=np.uint8)
    solid = np.concatenate([[False], (raw != 32) & ((raw < 9) | (raw > 13)), [False]])
    return np.flatnonzero(solid[1:] != solid[:-1]).reshape(-1, 2)


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(kept bytes, bytes removed, maximal removed runs)."""
    kept, at, removed, count, end = [], 0, 0, 0, -1
    for start, stop in sorted(spans):
        if start > end or count == 0:
            kept.append(data[at:start])
            count += 1
            removed += stop - start
            at = end = stop
        elif stop > end:
            removed += stop - end
            at = end = stop
    kept.append(data[at:])
    return b"".join(kept), removed, count


def _backed(data: bytes, scale: Scale, spans: list[dict]) -> list[tuple[int, int]]:
    """Spans as byte positions, but for those of another text with the same key."""
    symbols = scale.symbols(data.decode("utf-8", "surrogatepass")) if scale.words else data
    size, out = scale.size(symbols), []
    for x in spans:
        t = x["at"]
        body = symbols if t < 0 else scale.part(symbols, t, t + scale.head)
        if x["stop"] <= size and _i64([_digest(body)])[0] == x["after"]:
            out.append((x["start"], x["stop"]))
    if scale.words and out:
        place = word_offsets(data)
        out = [(int(place[a, 0]), int(place[b - 1, 1])) for a, b in out]
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", crowd: int = CROWD, decode: bool = False, words: int = 0, files: int | None = None) -> DataFrame:
    """docs with columns kept_text (binary), n_bytes, n_removed, n_spans (long) in place of its text column.

    Texts are UTF-8 bytes; null is empty. Every byte covered by a string of ``length`` bytes that also starts
    elsewhere, in the same or any other row, is removed; strings never cross rows and are judged on the
    input. Rows with equal texts are repeats of each other and lose all of a text of length bytes or more; shorter
    texts are kept whole. Removal may split a character, so kept_text is binary; with decode it is a string without the
    bytes of split characters. With words, passages of so many words that also start elsewhere go too, whatever
    their length in bytes; passages are equal if their words are, white space between them does not count. Columns whose
    names clash with a result are replaced, all others pass through, nulls included. files: see repeated_spans. Empty
    table: empty result.
    """
    if length < 16:
        raise ValueError("length must be at least 16 bytes")
    names = [c for c in docs.columns if c != text and c not in ("kept_text", "n_bytes", "n_removed", "n_spans")]
    row = F.struct(*[F.col(c) for c in names]) if names else F.struct(F.lit(0).alias("none"))
    base = docs.select(row.alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    scales = [Scale(length), *([Scale(words, True)] if words else [])]
    spans = None
    for n, scale in enumerate(scales):
        least = words * 2 - 1 if scale.words else length  # bytes of a text that can hold such a string
        one = repeated_spans(base.select("key", "text").where(F.octet_length("text") >= least), scale, crowd, files).withColumn("scale", F.lit(n))
        spans = one if spans is None else spans.unionByName(one)
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("scale", "at", "after", "start", "stop")).alias("spans"))

    def apply(batches):
        import pyarrow as pa

        for batch in batches:
            made = []
            for body, found in zip(batch.column(1), batch.column(2), strict=True):
                data = (body.as_py() or "").encode("utf-8", "surrogatepass")
                mine = []
                if found.is_valid:
                    each = found.as_py()
                    for n, scale in enumerate(scales):
                        if some := [x for x in each if x["scale"] == n]:
                            mine += _backed(data, scale, some)
                kept, removed, count = cut(data, mine)
                made.append((kept.decode("utf-8", "ignore") if decode else kept, len(data), removed, count))
            more = [pa.array(x, kind) for x, kind in zip(zip(*made, strict=True) if made else [()] * 4, (pa.string() if decode else pa.binary(), *[pa.int64()] * 3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *more], names=["row", "kept_text", "n_bytes", "n_removed", "n_spans"])

    joined = base.join(spans, "key", "left").select("row", "text", "spans")
    schema = joined.select("row").withColumns({"kept_text": F.lit("" if decode else b""), "n_bytes": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long")}).schema
    out = joined.mapInArrow(apply, schema)
    return out.select("row.*", "kept_text", "n_bytes", "n_removed", "n_spans") if names else out.drop("row")


def op2(docs: DataFrame) -> DataFrame:
    done = remove_repeats(docs.select(as_long(F.col("doc_id")).alias("doc_id"), "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


def deduped_text(docs: DataFrame, length: int = LENGTH, words: int = PASSAGE, emptied: bool = True, files: int | None = None) -> DataFrame:
    """docs with repeated strings and passages cut from text; null texts stay null, n_chars (if there) follows the text.

    Every row stays, if only with an empty text; without ``emptied``, rows go that lost something and have no word left.
    Other columns pass through, whatever their names and nulls. files: see repeated_spans.
    """
    rest = F.struct(*[F.col(c) for c in docs.columns if c != "text"], F.col("text").isNull().alias("no text"))
    done = remove_repeats(docs.select(rest.alias("rest"), "text"), length, decode=True, words=words, files=files)
    if not emptied:
        done = done.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(WORD))
    done = done.select("rest.*", F.when(~F.col("rest")["no text"], F.col("kept_text")).alias("text"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast("long"))
    return done.select(*docs.columns)


#: The same rows in DuckDB: every string of 400 bytes by its hash.
OP2_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, encode(coalesce(text, '')) AS body FROM documents),
s AS MATERIALIZED (SELECT row, p, md5(body[p + 1 : p + 400]) AS h FROM (SELECT row, body, unnest(range(octet_length(body) - 399)) AS p FROM d WHERE octet_length(body) >= 400)),
t AS (SELECT row, p, lag(p) OVER (PARTITION BY row ORDER BY p) AS before FROM s SEMI JOIN (SELECT h FROM s GROUP BY h HAVING count(*) > 1) m USING (h)),
i AS (SELECT row, p, count(*) FILTER (before IS NULL OR p > before + 400) OVER (PARTITION BY row ORDER BY p) AS island FROM t),
r AS MATERIALIZED (SELECT row, min(p) AS a, max(p) + 400 AS z FROM i GROUP BY row, island),
k AS (SELECT d.row, any_value(doc_id) AS doc_id, any_value(hex(body)) AS body, coalesce(sum(z - a), 0) AS removed, count(a) AS spans,
        list(a ORDER BY a) AS starts, list(z ORDER BY a) AS stops FROM d LEFT JOIN r USING (row) GROUP BY d.row)
SELECT doc_id, CAST(length(body) // 2 AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, spans AS n_spans,
  sha256(unhex(CASE WHEN spans = 0 THEN body ELSE array_to_string([body[2 * (CASE WHEN q = 1 THEN 0 ELSE stops[q - 1] END) + 1 : 2 * (CASE WHEN q > spans THEN length(body) // 2 ELSE starts[q] END)] for q in range(1, spans + 2)], '') END)) AS kept_sha256
FROM k
"""


__all__ = ["OP2_SQL", "PASSAGE", "Scale", "cut", "deduped_text", "marked", "op2", "remove_repeats", "repeated_spans", "repeated_starts", "runs", "suffix_order"]
