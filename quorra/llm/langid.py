"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors after
rotating them by their place, a text's vector bundles (adds) those of its trigrams, and a language's prototype bundles
the normalized vectors of its training texts. Texts are compared with prototypes by cosine, after the mean
prototype, which all languages share, is taken off both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorra.llm.common import as_long, saved

DIMENSIONS = 1024
SEED = 42
UNKNOWN = "und"
#: Letters of a text that are turned into trigrams at a time.
_STEP = 1 << 18
_GAP = 32


class Trigrams:
    """Trigram -> vector, filled as trigrams come; at most LIMIT are held."""

    LIMIT = 60_000

    def __init__(self, dimensions: int):
        self.dimensions, self.letters, self.rows = dimensions, {}, {}
        self.table = np.zeros((1024, dimensions), dtype=np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 5000:
                self.letters.clear()
            bits = np.random.default_rng([SEED, code]).integers(0, 2, self.dimensions, dtype=np.int8)
            self.letters[code] = (2 * bits - 1).astype(np.int8)
        return self.letters[code]

    def of(self, grams: np.ndarray) -> np.ndarray:
        """One row for each gram (three code points in 21 bits each)."""
        if len(self.rows) + len(grams) > self.LIMIT:
            self.rows.clear()
        at = []
        for g in grams.tolist():
            row = self.rows.get(g)
            if row is None:
                row = self.rows[g] = len(self.rows)
                if row >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                a, b, c = g >> 42, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF
                self.table[row] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
            at.append(row)
        return self.table[at]


def letters_of(text: str | None) -> str:
    """Lower-case letters, each run of anything else as one space; empty if there is no letter."""
    if not text:
        return ""
    kept = "".join([c if c.isalpha() else " " for c in text.lower()]) if not text.isascii() else text.lower().translate(_ASCII)
    return " ".join(kept.split())


_ASCII = {c: 32 for c in range(128) if not chr(c).isalpha()}


def encode(texts: list[str | None], trigrams: Trigrams) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, whether the text has a letter): one bundle for each text; long texts are added up piece by piece."""
    out = np.zeros((len(texts), trigrams.dimensions), dtype=np.float32)
    known = np.zeros(len(texts), dtype=bool)
    grams, owner, held = [], [], 0

    def flush() -> None:
        nonlocal held
        if grams:
            gram, who = np.concatenate(grams), np.concatenate(owner)
            distinct, index = np.unique(gram, return_inverse=True)
            docs, row = np.unique(who, return_inverse=True)
            for k in range(0, len(distinct), 8192):  # few distinct trigrams at a time keep the matrices small
                mine = (index >= k) & (index < k + 8192)
                wide = min(8192, len(distinct) - k)
                counts = np.bincount(row[mine] * wide + index[mine] - k, minlength=len(docs) * wide).reshape(len(docs), wide)
                out[docs] += counts.astype(np.float32) @ trigrams.of(distinct[k : k + wide]).astype(np.float32)
            grams.clear()
            owner.clear()
        held = 0

    for n, text in enumerate(texts):
        body = letters_of(text)
        if not body:
            continue
        known[n] = True
        codes = np.frombuffer(f" {body} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        for k in range(0, len(codes) - 2, _STEP):
            part = codes[k : k + _STEP + 2]
            grams.append(part[:-2] << 42 | part[1:-1] << 21 | part[2:])
            owner.append(np.full(len(grams[-1]), n))
            held += len(grams[-1])
            if held >= _STEP or len(grams) >= 128:
                flush()
    flush()
    return out, known


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


_cached: dict[int, Trigrams] = {}


def _trigrams(dimensions: int) -> Trigrams:
    return _cached.setdefault(dimensions, Trigrams(dimensions))


def train(labelled: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(lang, prototype: array<double>, texts) from labelled(text, lang): one row for each non-null lang.

    All rows take part; texts without letters and null langs are skipped. Every task adds up its own rows per
    language, so a hot language is a row a task before the shuffle.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        count: dict[str, int] = {}
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.iloc[k : k + 256]
                vectors, known = encode(list(part["text"]), _trigrams(dimensions))
                vectors = _unit(vectors)
                lang = part["lang"].to_numpy()
                for name in set(lang[known]):
                    mine = known & (lang == name)
                    sums[name] = sums.get(name, 0) + vectors[mine].astype(np.float64).sum(axis=0)
                    count[name] = count.get(name, 0) + int(mine.sum())
        if sums:
            yield pd.DataFrame({"lang": list(sums), "prototype": [sums[x] for x in sums], "texts": [count[x] for x in sums]})

    made = labelled.where(F.col("lang").isNotNull()).select("text", "lang").mapInPandas(add, "lang string, prototype array<double>, texts long")
    each = made.select("lang", "texts", F.posexplode("prototype").alias("k", "x"))
    # rounded, so that the order of addition leaves no trace
    each = each.groupBy("lang", "k").agg(F.round(F.sum("x"), 6).alias("x"), F.sum("texts").alias("texts"))
    rows = each.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("p"), F.max("texts").alias("texts"))
    return rows.select("lang", F.col("p.x").alias("prototype"), "texts")


def predict(docs: DataFrame, prototypes: DataFrame, dimensions: int = DIMENSIONS, text: str = "text") -> DataFrame:
    """docs with lang_pred and score instead of its text column; only the text is looked at.

    score is the cosine with the nearest prototype, cut to 0..1. Texts without a letter, null and empty ones included,
    are ``und`` with score 0, and so is every text if nothing was learned. Ties go to the first lang by code point.
    The prototypes, one short row a language, go to every task; their number is that of the languages labelled.
    """
    learned = sorted((r["lang"], r["prototype"]) for r in prototypes.collect())
    if len(learned) > 10_000:
        raise ValueError("more than 10,000 languages: is lang a language column?")
    names = np.array([x[0] for x in learned], dtype=object)
    table = _unit(np.array([x[1] for x in learned], dtype=np.float64)) if learned else np.zeros((0, dimensions))
    mean = table.mean(axis=0) if len(table) > 1 else np.zeros(dimensions)
    table = _unit(table - mean).astype(np.float32)
    mean = mean.astype(np.float32)
    keep = [c for c in docs.columns if c not in (text, "lang_pred", "score")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            lang, score = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
            for k in range(0, n if len(names) else 0, 256):
                vectors, known = encode(batch.column(len(keep)).slice(k, 256).to_pylist(), _trigrams(dimensions))
                cosine = _unit(_unit(vectors) - mean) @ table.T
                best = cosine.argmax(axis=1)
                lang[k : k + 256] = np.where(known, names[best], UNKNOWN)
                score[k : k + 256] = np.where(known, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0)
            more = [pa.array(lang.tolist(), pa.string()), pa.array(np.round(score, 4), pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*keep, "lang_pred", "score"])

    schema = docs.select(*keep).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return docs.select(*keep, text).mapInArrow(run, schema)


def op5(docs: DataFrame) -> DataFrame:
    held_out = (F.crc32(F.coalesce(as_long(F.col("doc_id")).cast("string"), F.lit("")).cast("binary")) % 3) == 1
    rows = docs.select(as_long(F.col("doc_id")).alias("doc_id"), held_out.alias("held_out"), "text", "lang")
    prototypes = saved(train(rows.where("not held_out")), "languages")
    return predict(rows.drop("lang"), prototypes)
