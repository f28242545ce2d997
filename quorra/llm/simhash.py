"""SimHash near-duplicate classes through tables of distances to reference fingerprints (pivots).

How links are found. Every distinct fingerprint gets a row of the pivot table: its Hamming distances to about
ninety fixed reference fingerprints. By the triangle inequality two fingerprints at most r apart differ by at most r in
each of these coordinates, so a pair whose largest coordinate difference exceeds r is discarded, and survivors are
verified with XOR and bit count. The references come in families: family g holds the staircase 0, 1, 3, 7, ...
within block g of the 64 bits, so the steps between neighbouring coordinates of a family (each +1 or -1) are the same
for two fingerprints exactly if they agree on the block. r differing bits cannot touch more than r blocks, so with r + k
blocks at least k families have the same steps: pairs are only formed among rows of the table that agree on the steps
of k whole families, which is an equi-join on the table's coordinates. The other coordinates, and the loose references
(random fingerprints), then discard within the bucket. Nothing is lost: no cap on partners, candidates or buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorra.llm.common import as_long, file_count, parts, saved
from quorra.llm.components import connected_components

SEED = 42
#: A bucket of more fingerprints is split into blocks of this size that are compared two by two in separate tasks.
BLOCK = 4096
#: Rows of the pivot table that a task compares, about.
DEALT = 10_000
#: Loose references, besides the families.
LOOSE = 16
#: Sampled fingerprints of a text in the similarity search, and shingles that each is made of.
SAMPLES, SAMPLE_SIZE = 16, 4
_CHUNK = 1 << 20


def word_chunks(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a bounded number of bytes at a time, cut at white space."""
    at = 0
    while at < len(data):
        end = at + _CHUNK
        if end < len(data):
            while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
                end += 1
        yield data[at:end].split()
        at = end


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of all shingles, repeats included; fewer words than width make one shingle, none make none."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() folds A-Z only
    digest, out, tail = xxhash.xxh64_intdigest, [], []
    for words in word_chunks(data):
        words = tail + words
        rows = zip(*(words[k:] for k in range(width)), strict=False)
        out.append(np.fromiter((digest(b" ".join(x), SEED) for x in rows), dtype=np.uint64))
        tail = words[max(0, len(words) - width + 1) :]
    if sum(map(len, out)):
        return np.concatenate(out)
    return np.array([digest(b" ".join(tail), SEED)] if tail else [], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; no hashes: 0."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        block = np.ascontiguousarray(hashes[k : k + 65536], dtype="<u8").view(np.uint8)
        ones += np.add.reduce(np.unpackbits(block, bitorder="little").reshape(-1, 64), axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def sampled_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """SAMPLES fingerprints, each of the SAMPLE_SIZE shingles that are smallest under as many fixed orders.

    Two texts share one of them with probability J ** SAMPLE_SIZE (J: Jaccard similarity of their shingles).
    """
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, SAMPLES * SAMPLE_SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(len(odd), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(hashes), 16384):
        low = np.minimum(low, _mixed(hashes[None, k : k + 16384] * odd[:, None]).min(axis=1))
    out = np.zeros(SAMPLES, dtype=np.uint64)
    for column in low.reshape(SAMPLES, SAMPLE_SIZE).T:
        out = _mixed(out * np.uint64(31) + column)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """docs with a column fp (long: the 64 bits), its other columns kept but for text. Null text: no words, fp 0."""
    keep = [c for c in docs.columns if c not in (text, "fp")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = [_signed(fingerprint(shingle_hashes(t.as_py(), shingle))) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp, pa.int64())], names=[*keep, "fp"])

    schema = docs.select(*keep).withColumn("fp", F.lit(0).cast("long")).schema
    return docs.select(*keep, text).mapInArrow(run, schema)


def references(cuts: list[int]) -> list[int]:
    """The reference fingerprints: a staircase for each block between cuts, then LOOSE fixed random ones."""
    stairs = [((1 << k) - 1) << low for low, high in zip(cuts, cuts[1:], strict=False) for k in range(high - low + 1)]
    return stairs + [int(x) for x in np.random.default_rng(SEED).integers(0, 1 << 64, LOOSE, dtype=np.uint64, endpoint=False)]


def pivot_table(distinct: DataFrame, cuts: list[int]) -> DataFrame:
    """(fp, far): each fingerprint's Hamming distances to the references, in their order."""
    return distinct.select("fp", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(x)))).cast("byte") for x in references(cuts)]).alias("far"))


def _blocks(rows: int, radius: int) -> list[int]:
    """Borders of the families' blocks: more rows, more families, so that a bucket keeps few chance members."""
    whole = 1
    while whole < 3 and rows > (1 << (64 * whole // (radius + whole) + 4)):
        whole += 1
    return [64 * k // (radius + whole) for k in range(radius + whole + 1)]


def _within(fp: np.ndarray, far: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the links inside each group, as index pairs (row, first row of its class); far: rows of the pivot table."""
    order = np.lexsort((far[:, -1], group))  # inside a group ascending by the last coordinate
    fp, group, far, label = fp[order], group[order], far[order], np.arange(len(fp))
    left = np.arange(len(fp) - 1)
    step = 1
    while len(left):
        left = left[left + step < len(fp)]
        left = left[(group[left] == group[left + step]) & (far[left + step, -1] - far[left, -1] <= radius)]  # sorted: later rows are farther
        near = left[np.abs(far[left] - far[left + step]).max(axis=1) <= radius] if len(left) else left
        near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= radius]
        label = _joined(label, near, near + step)
        step += 1
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return order[moved], order[label[moved]]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining rows a and b; labels are roots (label[label] == label)."""
    a, b = label[a], label[b]
    differ = a != b
    a, b = a[differ], b[differ]
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        a, b = label[a], label[b]
        differ = a != b
        a, b = a[differ], b[differ]
    return label


def fingerprint_links(distinct: DataFrame, radius: int = 3, files: int | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of all links of at most radius bits between values of the column fp.

    distinct has no repeats. In each bucket a value gets one edge, to the first value of its class there, which
    other links of the bucket may lie between. The pivot table has at most ``files`` files, if given.
    """
    rows = distinct.count()
    cuts = _blocks(rows, radius)
    families = len(cuts) - 1
    table = saved(pivot_table(distinct, cuts), "simhash-pivots", files=files)
    # family g's coordinates start at cuts[g] + g; its steps are their differences
    steps = [F.transform(F.sequence(F.lit(low + g), F.lit(high + g - 1)), lambda k: F.get("far", k + 1) - F.get("far", k)) for g, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False))]
    keys = [F.struct(F.lit(n).alias("family"), F.xxhash64(*[steps[g] for g in chosen]).alias("same")) for n, chosen in enumerate(combinations(range(families), families - radius))]
    spread = table.select("fp", "far", F.explode(F.array(*keys)).alias("k")).select("fp", "far", "k.family", "k.same")
    crowd = spread.groupBy("family", "same").count().where(F.col("count") > BLOCK).select("family", "same", F.ceil(F.col("count") / BLOCK).cast("int").alias("n"))
    crowd = saved(crowd, "simhash-crowds")
    if crowd.isEmpty():
        dealt = spread.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(0)).withColumn("mine", F.lit(0))
    else:
        dealt = spread.join(crowd, ["family", "same"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
        dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        dealt = dealt.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    slots = parts(rows * len(keys), DEALT)
    dealt = dealt.withColumn("slot", F.pmod(F.xxhash64("family", "same", "lo", "hi"), F.lit(slots)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy().view(np.uint64)
        far = np.stack(pdf["far"].to_list()).astype(np.int8)
        group = pdf.groupby(["family", "same", "lo", "hi"], sort=False).ngroup().to_numpy()
        a, b = _within(fp, far, group, radius)
        return pd.DataFrame({"a": fp[a].view(np.int64), "b": fp[b].view(np.int64)})

    return dealt.select("slot", "fp", "far", "family", "same", "lo", "hi").groupBy("slot").applyInPandas(run, "a long, b long")


def simhash_classes(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs(doc_id, text).

    Fingerprints of shingles of that many words link at radius or fewer differing bits; component_id is the
    smallest doc_id reachable. Null and empty texts have fingerprint zero, which links like any other. Repeated
    rows each get a row; a null doc_id takes part but is never the smallest unless all are null. Other columns
    are left out, whatever their names. Empty table: empty result.
    """
    rows = saved(fingerprints(docs.select(as_long(F.col("doc_id")).alias("doc_id"), "text"), shingle), "simhash-rows")
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = connected_components(fingerprint_links(nodes.select("fp"), radius), "simhash-components")
    linked = nodes.join(roots, nodes.fp == roots.node).select("fp", "root", "first_id")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = nodes.join(linked.select("fp", "root").join(smallest, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_classes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """(doc_id, text_key, class_id): classes of texts whose shingle sets reach a Jaccard similarity, transitively.

    A 64-bit SimHash within three bits only sees pairs that are nearly the same, so candidates come from the
    whole-text fingerprints through the pivot tables and from sampled fingerprints (SimHash of a few shingles
    that are smallest under fixed orders), and candidates are verified on the whole shingle sets. Equal texts are one
    node. The candidates are not complete: a pair of similarity J shares no sampled fingerprint with probability
    (1 - J ** 4) ** 16, 1 in 4,600 at J = 0.8 and 1 in 130,000 at 0.85, and is then found only by its whole-text
    fingerprints or through a third text. Candidates form components; within one, every pair that is not yet connected
    by verified links is verified, so none of a component's is lost: members of a large component are first held against a few of its members in turn, and what is not
    connected with the component's largest class after that is held against all its members, block by block.
    class_id is the smallest doc_id of the class. Null text equals empty text.
    """
    return _keyed_classes(docs, shingle, similarity, radius).drop("class_key")


def _keyed_classes(docs: DataFrame, shingle: int, similarity: float, radius: int = 3) -> DataFrame:
    """similar_classes with class_key, which tells classes apart whatever their ids: nulls and repeats included."""
    base = docs.select(as_long(F.col("doc_id")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("text_key", F.sha2("text", 256)).withColumn("node", F.xxhash64("text_key"))
    ids = saved(base.select("doc_id", "text_key"), "similar-ids")
    files = file_count(ids)
    nodes = ids.groupBy("text_key").agg(F.min("doc_id").alias("first_id")).select("text_key", "first_id", F.xxhash64("text_key").alias("node"))
    nodes = saved(nodes, "similar-nodes", files=files)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = [shingle_hashes(t, shingle) for t in batch["text"]]
            whole = [_signed(fingerprint(h)) for h in hashes]
            yield pd.DataFrame({"node": batch["node"], "fp": whole, "sampled": [sampled_fingerprints(h).view(np.int64) for h in hashes]})

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in batch["text"]]
            yield pd.DataFrame({"node": batch["node"], "shingles": sets})

    marks = base.select("node", "text").mapInPandas(mark, "node long, fp long, sampled array<long>")
    marks = saved(marks.dropDuplicates(["node"]), "similar-marks", files=files)
    points = marks.groupBy("fp").agg(F.min("node").alias("low"))
    close = connected_components(fingerprint_links(points.select("fp"), radius, files), "similar-close", files)
    bucket = marks.join(close, marks.fp == close.node, "left").select(marks.node, F.lit(-1).alias("kind"), F.coalesce("root", "fp").alias("value"))
    bucket = bucket.unionByName(marks.select("node", F.posexplode("sampled").alias("kind", "value")))
    bucket = saved(bucket, "similar-buckets", files=files)
    first = bucket.groupBy("kind", "value").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    stars = bucket.join(first, ["kind", "value"]).select(F.col("node").alias("a"), F.col("head").alias("b")).where("a != b").distinct()
    groups = saved(connected_components(stars, "similar-groups", files).withColumnRenamed("root", "comp"), "similar-members")
    one = nodes.join(groups, "node", "left_semi").select(F.col("node").alias("n"), "first_id")  # one row a text
    one = base.join(one, (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    sets = saved(one.select("node", "text").mapInPandas(shingles, "node long, shingles array<long>").dropDuplicates(["node"]), "similar-sets", files=files)
    found = verified_links(groups, sets, similarity, files=files)
    roots = connected_components(found, "similar-components", files)
    linked = nodes.join(roots, "node").select("text_key", "root", "first_id")
    low = linked.groupBy("root").agg(F.min("first_id").alias("class_id"))
    linked = linked.join(low, "root").select("text_key", "class_id", F.col("root").cast("string").alias("class_key"))
    labels = nodes.join(linked, "text_key", "left").select("text_key", F.coalesce("class_id", "first_id").alias("class_id"), F.coalesce("class_key", "text_key").alias("class_key"))
    return ids.join(labels, "text_key").select("doc_id", "text_key", "class_id", "class_key")


def _similar(of_a: F.Column, of_b: F.Column, similarity: float) -> F.Column:
    shared = F.size(F.array_intersect(of_a, of_b))
    return (shared > 0) & (shared >= F.lit(similarity) * (F.size(of_a) + F.size(of_b) - shared))


def _apart(groups: DataFrame, links: DataFrame | None, files: int | None = None) -> DataFrame:
    """Members (comp, node) outside the largest verified class of their component; all, if nothing is verified yet."""
    if links is None:
        return groups
    roots = connected_components(links, "similar-verified", files)
    placed = groups.join(roots, "node", "left").select("comp", "node", F.coalesce("root", "node").alias("class"))
    placed = saved(placed, "similar-placed")
    largest = placed.groupBy("comp", "class").count().groupBy("comp").agg(F.max_by("class", F.struct("count", "class")).alias("main"))
    return placed.join(largest, "comp").where("class != main").select("comp", "node")


def verified_links(groups: DataFrame, sets: DataFrame, similarity: float, few: int = 512, rounds: int = 6, files: int | None = None) -> DataFrame:
    """(a, b): links of the given similarity within the components of groups(node, comp); their classes are exact.

    sets is (node, shingles: distinct hashes). Components of up to ``few`` members are compared within one block. Larger
    ones are narrowed down first: in each round what is apart is held against one more member. Its larger tables have at most
    ``files`` files each, if given.
    """
    sizes = groups.groupBy("comp").agg(F.count("*").alias("n"))
    large = saved(sizes.where(F.col("n") > few).select("comp"), "similar-large")
    links = None
    rest = groups
    if not large.isEmpty():
        mine = saved(groups.join(large, "comp", "left_semi").select("comp", "node"), "similar-crowd")
        rest = mine
        for k in range(rounds):
            heads = mine.groupBy("comp").agg(F.min_by("node", F.xxhash64("node", F.lit(k))).alias("a"))
            heads = heads.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
            pairs = rest.join(heads, "comp").where("node != a").join(sets, "node")
            good = saved(pairs.where(_similar(F.col("of_a"), F.col("shingles"), similarity)).select("a", F.col("node").alias("b")), "similar-good", files=files)
            links = good if links is None else links.unionByName(good)
            rest = saved(_apart(mine, links, files), "similar-rest", files=files)
            if rest.isEmpty():
                break
        rest = rest.unionByName(groups.join(large, "comp", "left_anti").select("comp", "node"))
    count = rest.groupBy("comp").agg(F.count("*").alias("m"))
    wanted = sizes.join(count, "comp").select("comp", F.ceil(F.col("m") / few).cast("int").alias("nc"), F.ceil(F.col("n") / (4 * few)).cast("int").alias("nd"), (F.col("n") <= few).alias("whole"))
    wanted = saved(wanted, "similar-blocks", files=files)
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rest.join(wanted, "comp").select("comp", "node", spot("nc").alias("c"), span("nd").alias("d"), F.when(F.col("whole"), 2).otherwise(0).alias("side"))
    right = groups.join(wanted.where("not whole"), "comp").select("comp", "node", spot("nd").alias("d"), span("nc").alias("c"), F.lit(1).alias("side"))
    dealt = left.unionByName(right)
    slots = parts(dealt.count(), 2000)
    dealt = dealt.withColumn("slot", F.pmod(F.xxhash64("comp", "c", "d"), F.lit(slots)).cast("int")).join(sets, "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, block in pdf.groupby(["comp", "c", "d"], sort=False):
            side, node = block["side"].to_numpy(), block["node"].to_numpy()
            a, b = _alike([x for x in block["shingles"]], np.flatnonzero(side != 1), np.flatnonzero(side != 0), similarity)
            label = _joined(np.arange(len(node)), a, b)
            moved = np.flatnonzero(label != np.arange(len(node)))
            out.append(pd.DataFrame({"a": node[moved], "b": node[label[moved]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype=np.int64)

    blocks = dealt.select("slot", "comp", "c", "d", "side", "node", "shingles").groupBy("slot").applyInPandas(compare, "a long, b long")
    return blocks if links is None else blocks.unionByName(links)


def _alike(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (of left, of right) whose sets reach the similarity: shared shingles by products of 0/1 matrices."""
    size = np.array([len(x) for x in sets])
    value, at = np.unique(np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    twice = np.flatnonzero(np.bincount(at, minlength=len(value)) > 1)  # a shingle of one set is shared with none
    place = np.full(len(value), -1)
    place[twice] = np.arange(len(twice))
    column = place[at]
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    for k in range(0, len(twice), 8192):
        some = (column >= k) & (column < k + 8192)
        table = np.zeros((len(sets), min(8192, len(twice) - k)), dtype=np.float32)
        table[owner[some], column[some] - k] = 1
        shared += table[left] @ table[right].T
    ok = (shared > 0) & (shared >= similarity * (size[left][:, None] + size[right][None, :] - shared) - 1e-6)
    a, b = np.nonzero(ok)
    return left[a], right[b]


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without all but one row (that of the smallest doc_id, nulls last) of each near-duplicate class; columns as given.

    Null and empty texts are one class. Rows that repeat both doc_id and text are one row, whichever of them it is:
    the one whose columns are smallest as JSON text, so a rerun keeps the same. Extra columns pass through, a null
    stays a null, and no name of theirs can clash. Empty table: empty result.
    """
    classes = _keyed_classes(docs, shingle, similarity)
    # one key for id and text: the join deals rows by it, and rows that repeat both then fall together
    key = lambda i, k: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), k)
    chosen = classes.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("x"))
    chosen = chosen.select(key(F.col("x.doc_id"), F.col("x.text_key")).alias("wanted"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(whole.alias("row"), key(as_long(F.col("doc_id")), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key"))
    kept = keyed.join(chosen, F.col("key") == F.col("wanted"), "left_semi")
    one = kept.groupBy("key").agg(F.min_by("row", F.to_json(F.col("row").dropFields("text"))).alias("row"))
    return one.select("row.*")
