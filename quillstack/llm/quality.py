"""Quality classifier: a generalised additive model with pairwise interactions.

Features are plain statistics of a whole text. Each is cut into bins at quantiles of the training rows. Boosting goes round the
features, one after another: a shallow tree (two splits at most) is fitted to the gradients in the bins of one feature and its
leaves are added to that feature's lookup table. Then the pairs of features with the largest gain over the residuals get tables of
their own, by trees with one split on either feature. A score is the sum of a row's table entries, through the logistic function.

Training uses at most `sample` labelled rows, those with the smallest hash of doc_id, and never the held-out ones. That bound is the
one place where rows are left out; every row is scored. The model is a few kilobytes and goes to the tasks with the function.

Nulls and odd rows: a null text counts as empty and is scored. Labels without doc_id or quality aren't used; of repeated labels of one
doc_id each is a training row. Where a doc_id comes with several texts, the least of them is the one that is labelled. A null doc_id isn't held out. With no labels, or of one kind only, every score is their smoothed mean.
Empty tables give empty results. Columns other than those named are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_parts, table, written

FEATURES = (
    "log_bytes", "letters", "upper", "digits", "blank", "stops", "marks", "bars", "feeds", "log_words", "word_bytes", "long_words", "words_a_stop",
    "distinct_words", "repeated_lines", "packed", "marked_words", "top_byte",
)
SAMPLE, BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, RIDGE = 20_000, 32, 120, 6, 40, 0.15, 2.0
_KIND = np.zeros(256, dtype=np.uint8)  # 0 other marks, 1 letters, 2 capital letters, 3 digits, 4 blanks, 5 stops
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[33, 44, 46, 58, 59, 63]] = 5


def features(text: str) -> list[float]:
    """FEATURES of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(raw, dtype=np.uint8)
    kinds = _KIND[data]
    by_byte = np.bincount(data, minlength=256)
    kind = np.bincount(kinds, minlength=6)
    blank = kinds == 4
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    lengths = edges[1::2] - edges[::2]
    n_words = max(1, len(lengths))
    last = kinds[edges[1::2] - 1] if len(lengths) else kinds[:0]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(1, kind[1] + kind[2])
    return [
        np.log1p(n), (kind[1] + kind[2]) / n, kind[2] / letters, kind[3] / n, kind[4] / n, kind[5] / n, kind[0] / n, by_byte[124] / n, by_byte[10] / n,
        np.log1p(n_words), float(lengths.mean()) if len(lengths) else 0.0, float((lengths > 20).mean()) if len(lengths) else 0.0, n_words / (1 + by_byte[46] + by_byte[33] + by_byte[63]),
        len(set(raw.split())) / n_words, 1 - len(set(lines)) / max(1, len(lines)), len(zlib.compress(raw, 1)) / n, float(((last == 0) | (last == 5)).mean()) if len(last) else 0.0,
        by_byte.max() / n,
    ]


@dataclass
class AdditiveModel:
    """Lookup tables: one for each feature over its bins, and one for each chosen pair over both features' bins."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1 for each row."""
        total = np.full(len(x), self.intercept)
        b = self.bins(x) if self.edges else []
        for k, t in enumerate(self.tables):
            total += t[b[k]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            total += t[b[i], b[j]]
        return 1 / (1 + np.exp(-total))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain of the best border between bins, and the border."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Step values of each bin, by a tree of at most three leaves."""
    gain, cut = _split(g, h)
    if gain <= 1e-12:
        return np.zeros(len(g))
    (gain_l, cut_l), (gain_r, cut_r) = _split(g[:cut], h[:cut]), _split(g[cut:], h[cut:])
    cuts = [0, cut, len(g)] + ([cut_l] if gain_l >= gain_r and gain_l > 1e-12 else [cut + cut_r] if gain_r > 1e-12 else [])
    cuts = sorted(set(cuts))
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best tree on a pair's grid with one border on either axis: gain and step values."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, ha = gs[:-1, :-1], hs[:-1, :-1]
    b, hb = gs[:-1, -1:] - a, hs[:-1, -1:] - ha
    c, hc = gs[-1:, :-1] - a, hs[-1:, :-1] - ha
    d, hd = gs[-1, -1] - a - b - c, hs[-1, -1] - ha - hb - hc
    if not a.size:
        return 0.0, np.zeros(g.shape)
    gain = a**2 / (ha + RIDGE) + b**2 / (hb + RIDGE) + c**2 / (hc + RIDGE) + d**2 / (hd + RIDGE)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty(g.shape)
    for rows, cols, x, hx in ((slice(0, i + 1), slice(0, j + 1), a, ha), (slice(0, i + 1), slice(j + 1, None), b, hb), (slice(i + 1, None), slice(0, j + 1), c, hc), (slice(i + 1, None), slice(j + 1, None), d, hd)):
        out[rows, cols] = -x[i, j] / (hx[i, j] + RIDGE)
    return float(gain[i, j] - g.sum() ** 2 / (h.sum() + RIDGE)), out


def train(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """x: rows by features; y: 0 or 1."""
    mean = (float(y.sum()) + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(mean / (1 - mean))))
    if not len(y) or y.min() == y.max():
        return model
    q = np.linspace(0, 1, BINS + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, k], q)) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    b, total = model.bins(x), np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for k, t in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b[k], g, len(t)), np.bincount(b[k], h, len(t)))
            t += step
            total += step[b[k]]
    g, h = slopes()
    sizes = [len(t) for t in model.tables]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(b[i] * sizes[j] + b[j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    gains = sorted(((_quadrants(grid(i, j, g), grid(i, j, h))[0], (i, j)) for i in range(len(sizes)) for j in range(i)), reverse=True)
    model.pairs = [p for gain, p in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            t += step
            total += step[b[i], b[j]]
    return model


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """Trains on at most `sample` labelled rows that aren't held out. Their ids are broadcast: at most `sample` of them."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id")).select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("label"))
    rows = rows.orderBy(F.xxhash64("label_id"), "label").limit(sample)

    def compute(batches):
        import pyarrow as pa

        for batch in in_parts(batches, 256, 1):
            values = [features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], names=["label", "x"])

    rows = written(rows, "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    # one text for each doc_id, the least one: no more than `sample` rows reach the driver however often a doc_id is repeated
    texts = texts.join(F.broadcast(rows.select("label_id").distinct()), "label_id", "left_semi").groupBy("label_id").agg(F.min("body").alias("body"))
    got = texts.join(F.broadcast(rows), "label_id").select("label", "body").mapInArrow(compute, "label int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    y = np.array(got.column("label").to_pylist(), dtype=np.float64)
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows arrive in
    return train(x[order], y[order])


def scored(docs: DataFrame, model: AdditiveModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """All columns of docs, with score and predicted, in one pass over the texts."""
    clash = {"score", "predicted"} & set(docs.columns)
    if clash:
        raise ValueError(f"docs has columns of the result: {sorted(clash)}")
    names = docs.columns
    at = names.index(text_col)

    def add(batches):
        import pyarrow as pa

        for batch in in_parts(batches, 512, at):
            x = np.array([features(t or "") for t in batch.column(at).to_pylist()])
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(add, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the classifier accepts, with their columns."""
    model = fit(docs, labels, sample)
    names, at = docs.columns, docs.columns.index("text")

    def accept(batches):
        import pyarrow as pa

        for batch in in_parts(batches, 512, at):
            x = np.array([features(t or "") for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.select(names).mapInArrow(accept, docs.schema)


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all of `documents`, learned from `labels`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
