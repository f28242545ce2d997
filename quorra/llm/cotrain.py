"""Quality classifier by co-training: a text view and a page-metadata view teach each other.

The text view sees mixes of character classes, pairs of classes and word statistics; the metadata view sees source,
language and recorded length. Each is a logistic regression, first fitted on a bounded sample of labelled rows. In every
round each view scores all other documents and hands those that it is sure of, as pseudo-labels, to the other, which
takes a few descent steps on the labelled sample and on all of them. The steps need sums over the documents only:
every task adds up its own gradient, of a few hundred numbers, and the sums are exact decimals, so that the order of
tasks leaves no trace. Afterwards each view is calibrated (Platt) on labelled rows that took no part, and the two
calibrated views are combined by a regression on those rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorra.llm.common import as_long, saved

#: Bound of the labelled sample (rows with the smallest hashes of their ids), and its seed.
LABELLED, SEED = 6000, 42
#: Rounds, descent steps in each, the probability from which a view is sure, and the weight of all pseudo-labels of a
#: class against the labelled rows of that class.
ROUNDS, STEPS, SURE, SHARE = 4, 3, 0.95, 0.5
#: A document stays if its combined probability of good quality reaches this.
KEEP = 0.5
_CLASSES = 9
_SOURCES, _LANGS = 64, 32
_STEP = 1 << 22


def _class_table() -> np.ndarray:
    table = np.full(256, 8, dtype=np.int64)  # bytes of characters outside ASCII
    for b in range(128):
        c = chr(b)
        table[b] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in "\n\r" else 4 if c.isspace() or b < 32 else 5 if c in ".,;:'\"-()" else 6 if c in "!?" else 7
    return table


_TABLE = _class_table()


def text_features(text: str | None) -> np.ndarray:
    """Shares of pairs of neighbouring character classes, and word statistics, of a whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    pairs = np.zeros(_CLASSES * _CLASSES)
    raw = np.frombuffer(data, dtype=np.uint8)
    for k in range(0, max(0, len(raw) - 1), _STEP):
        kind = _TABLE[raw[k : k + _STEP + 1]]
        pairs += np.bincount(kind[:-1] * _CLASSES + kind[1:], minlength=_CLASSES * _CLASSES)
    words = data.split()
    n = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    more = [
        np.log1p(len(words)), len(set(words)) / n, again / n, sum(map(len, words)) / n / 10,
        1 - len(set(lines)) / max(1, len(lines)), sum(x.isupper() for x in words) / n, sum(not x[-1:].isalnum() and x[-1:] < b"\x80" for x in words) / n,
        sum(len(x) <= 3 for x in words) / n, float(not words),
    ]
    return np.concatenate([np.sqrt(pairs / max(1, pairs.sum())), more]).astype(np.float32)


def meta_features(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    """Hashed source and language, recorded length; nulls have a place of their own."""
    out = np.zeros(_SOURCES + _LANGS + 4, dtype=np.float32)
    out[0 if source is None else 1 + zlib.crc32(str(source).encode("utf-8", "surrogatepass")) % (_SOURCES - 1)] = 1
    out[_SOURCES + (0 if lang is None else 1 + zlib.crc32(str(lang).encode("utf-8", "surrogatepass")) % (_LANGS - 1))] = 1
    if n_chars is None or n_chars != n_chars or n_chars < 0:
        out[-1] = 1
    else:
        size = np.log1p(n_chars) / 10
        out[-4:-1] = size, size * size, float(n_chars < 500)
    return out


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression with a ridge, by Newton steps; the last coefficient is the intercept."""
    x = np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1).astype(np.float64)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + penalty * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class View:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    platt: np.ndarray | None = None

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.center) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return z if self.platt is None else z * self.platt[0] + self.platt[1]


def _view(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> View:
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    return View(center, scale, _fit((x - center) / scale, y, weight))


@dataclass
class Model:
    text: View
    meta: View
    mix: np.ndarray

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logit(text), self.meta.logit(meta)
        return _sigmoid(a), _sigmoid(b), _sigmoid(np.stack([a, b], axis=1) @ self.mix[:2] + self.mix[2])


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def pseudo_sums(x: tuple[np.ndarray, np.ndarray], teachers: tuple[View, View], students: tuple[View, View]) -> np.ndarray:
    """For each student: gradients over the rows that the other view is sure are bad, then good, and their numbers."""
    out = []
    for k in (0, 1):
        p = _sigmoid(teachers[1 - k].logit(x[1 - k]))
        mine = _with_one((x[k] - students[k].center) / students[k].scale)
        q = _sigmoid(mine @ students[k].weights)
        for sure, y in ((p <= 1 - SURE, 0.0), (p >= SURE, 1.0)):
            out += [mine[sure].T @ (q[sure] - y), [float(sure.sum())]]
    return np.concatenate(out)


def descended(view: View, x: np.ndarray, y: np.ndarray, sums: np.ndarray, ridge: float = 1.0) -> View:
    """The view after a step on labelled rows and pseudo-labels; the curvature is bounded by the labelled rows' (p (1 - p) <= 1/4)."""
    z = _with_one((x - view.center) / view.scale)
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    slope = z.T @ (_sigmoid(z @ view.weights) - y) + penalty * view.weights
    for label, part in enumerate(np.split(sums, 2)):
        if part[-1]:
            slope += part[:-1] * SHARE * (y == label).sum() / part[-1]
    curve = (1 + SHARE) * z.T @ z / 4 + np.diag(penalty)
    return View(view.center, view.scale, view.weights - np.linalg.solve(curve, slope))


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, calibrate: np.ndarray, gathered, rounds: int = ROUNDS, steps: int = STEPS) -> Model | None:
    """Views fitted on labelled rows (those marked calibrate are kept for calibration) and on what the other view hands over.

    gathered(teachers, students) gives pseudo_sums over all rows without a label. None if a class is missing.
    """
    fit = ~calibrate
    if min(y[fit].sum(), (1 - y[fit]).sum()) < 2 or min(y[calibrate].sum(), (1 - y[calibrate]).sum()) < 2:
        return None
    seen = (text, meta)
    views = tuple(_view(x[fit], y[fit], np.ones(fit.sum())) for x in seen)
    for _ in range(rounds):
        teachers = views
        for _ in range(steps):
            sums = gathered(teachers, views)
            edge = 2 * (text.shape[1] + 2)
            views = tuple(descended(v, x[fit], y[fit], part) for v, x, part in zip(views, seen, (sums[:edge], sums[edge:]), strict=True))
    held = y[calibrate]
    logits = []
    for view, x in zip(views, seen, strict=True):
        z = view.logit(x[calibrate])
        view.platt = _fit(z[:, None], held, np.ones(len(z)), ridge=1e-2)
        logits.append(view.logit(x[calibrate]))
    return Model(*views, _fit(np.stack(logits, axis=1), held, np.ones(len(held)), ridge=1e-2))


def _featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            text = [text_features(t.as_py()).tolist() for t in batch.column("text")]
            meta = [meta_features(*x).tolist() for x in zip(batch.column("source").to_pylist(), batch.column("lang").to_pylist(), batch.column("n_chars").to_pylist(), strict=True)]
            kind = pa.list_(pa.float32())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(text, kind), pa.array(meta, kind)], names=[*keep, "f_text", "f_meta"])

    schema = docs.select(*keep).withColumns({"f_text": F.array().cast("array<float>"), "f_meta": F.array().cast("array<float>")}).schema
    return docs.select(*dict.fromkeys([*keep, "text", "source", "lang", "n_chars"])).mapInArrow(run, schema)


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | None:
    """Fit on at most ``labelled`` labelled rows of docs, a fifth of which calibrate, and on all other rows without their labels.

    labels(doc_id, quality): null ids and qualities are skipped, repeated ids vote. Of rows of docs that repeat a
    sampled doc_id the one with the smallest features counts. None if there are too few labels of either class. Only
    the sample, whose size is bounded, comes to the driver, and sums of a few hundred numbers.
    """
    spark = docs.sparkSession
    place = lambda c: F.xxhash64(c.cast("string"), F.lit(SEED))
    votes = labels.select(as_long(F.col("doc_id")).alias("doc_id"), "quality").dropna().groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    marked = votes.orderBy(place(F.col("doc_id")), "doc_id").limit(labelled).collect()
    if not marked:
        return None
    chosen = F.broadcast(spark.createDataFrame([(r["doc_id"], r["y"]) for r in marked], "id long, y int"))  # at most ``labelled`` rows
    rows = docs.join(chosen, as_long(F.col("doc_id")) == F.col("id"), "left").select("id", "y", "text", "source", "lang", "n_chars")
    rows = saved(_featured(rows, ["id", "y"]), "features")
    sample = rows.where("id IS NOT NULL").groupBy("id", "y").agg(F.min(F.struct("f_text", "f_meta")).alias("f")).select("id", "y", "f.*")
    got = sample.toPandas().sort_values("id", kind="stable")
    if not len(got):
        return None
    text, meta = (np.stack(got[c].to_list()).astype(np.float64) for c in ("f_text", "f_meta"))
    calibrate = np.array([zlib.crc32(str(k).encode()) % 5 == 0 for k in got["id"]], dtype=bool)
    loose = rows.where("id IS NULL").select("f_text", "f_meta")

    def gathered(teachers, students) -> np.ndarray:
        size = 2 * (text.shape[1] + meta.shape[1] + 4)

        def add(batches):
            import pyarrow as pa

            total = np.zeros(size)
            for batch in batches:
                for k in range(0, batch.num_rows, 4096):
                    part = batch.slice(k, 4096)
                    total += pseudo_sums((_matrix(part.column(0), text.shape[1]), _matrix(part.column(1), meta.shape[1])), teachers, students)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

        each = loose.mapInArrow(add, "sums array<double>").select(F.posexplode("sums").alias("k", "x"))
        out = np.zeros(size)
        for r in each.groupBy("k").agg(F.sum(F.col("x").cast("decimal(30,9)")).alias("x")).collect():
            out[r["k"]] = float(r["x"])
        return out

    return co_train(text, meta, got["y"].to_numpy().astype(np.float64), calibrate, gathered)


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """docs with text_score, meta_score, score (probabilities of good quality) and kept.

    docs has doc_id, text, source, lang, n_chars; other columns pass through, clashing result names are replaced. Nulls
    in any of them are features of their own; a null text is an empty one. Where labels do not allow a model,
    scores are 1 and every document is kept. Empty table: empty result.
    """
    model = train(docs, labels, labelled)
    keep = [c for c in docs.columns if c not in ("text_score", "meta_score", "score", "kept")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            scores = (np.ones(n),) * 3
            if model is not None and n:
                text = np.stack([text_features(t.as_py()) for t in batch.column("text")]).astype(np.float64)
                meta = np.stack([meta_features(*x) for x in zip(batch.column("source").to_pylist(), batch.column("lang").to_pylist(), batch.column("n_chars").to_pylist(), strict=True)]).astype(np.float64)
                scores = model.score(text, meta)
            more = [pa.array(np.round(s, 6), pa.float64()) for s in scores]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more, pa.array(np.round(scores[2], 6) >= KEEP, pa.bool_())], names=[*keep, "text_score", "meta_score", "score", "kept"])

    more = {c: F.lit(0.0) for c in ("text_score", "meta_score", "score")}
    return docs.select(*keep).mapInArrow(run, docs.select(*keep).withColumns({**more, "kept": F.lit(True)}).schema)


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels).select(as_long(F.col("doc_id")).alias("doc_id"), "text_score", "meta_score", "score", "kept")


