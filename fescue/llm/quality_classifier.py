"""A kernel classifier of document quality: random Fourier features, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Random features, the kernel's width in standard deviations of all statistics together, and the ridge.
FEATURES, WIDTH, RIDGE, SEED = 128, 4.0, 1e-3, 20
#: Steps of raw scores that the calibration counts.
BINS = 500
FOLDS = 5

STATISTICS = (
    "log_words log_bytes word_bytes lines_per_word upper digits symbols exclaim other_punct non_ascii space capitals "
    "marked_words distinct_words top_word repeated_triples repeated_lines short_lines"
).split()

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_PUNCT = np.isin(np.arange(256), list(b".,;:?'\"()-/_=+@[]{}~^`\\"))
_SPACES = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def statistics(text: bytes) -> list[float]:
    """The STATISTICS of one text; all 0 but for the logarithms where there are no words."""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, size = len(words), max(len(text), 1)
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    share = lambda m: float(byte[m].sum()) / size
    d = max(n, 1)
    triples = list(zip(words, words[1:], words[2:]))
    return [
        np.log1p(n), np.log1p(len(text)), sum(map(len, words)) / d, len(lines) / d, share(_UPPER), share(_DIGIT), share(_SYMBOL), byte[33] / size, share(_PUNCT),
        float(byte[128:].sum()) / size, share(_SPACES), sum(map(bytes.isupper, words)) / d, sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / d,
        len(set(words)) / d, max(Counter(words).values(), default=0) / d, 1 - len(set(triples)) / max(len(triples), 1) if triples else 0.0,
        1 - len(set(lines)) / max(len(lines), 1) if lines else 0.0, sum(len(x) < 40 for x in lines) / max(len(lines), 1),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the STATISTICS of every row's whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, i]) for i in range(len(STATISTICS))]], names=["id", *STATISTICS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


def fold(id_: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


class Model:
    """Scale, random features, weights and calibration; a few kilobytes that travel with the tasks."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-12, spread, 1.0)
        self.w = rng.standard_normal((len(mean), FEATURES)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta = np.zeros(FEATURES + 1)
        self.x, self.y = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.beta, -1, 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(np.interp(self.raw(x), self.x, self.y), 6)


def isotonic(x: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing means of total / n over x by pooling adjacent violators; one knot for each end of a pool."""
    pools: list[list[float]] = []
    for at, t, m in zip(x, total, n):
        pools.append([t, m, at, at])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t2, m2, _, end = pools.pop()
            pools[-1] = [pools[-1][0] + t2, pools[-1][1] + m2, pools[-1][2], end]
    knots = [(at, p[0] / p[1]) for p in pools for at in sorted({p[2], p[3]})]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Folds 2 to 4 of the labelled rows fit the ridge scores, fold 1 the calibration; fold 0 is never used. Every task sums
    its normal equations, Spark adds them up, and FEATURES squared sums reach the driver. Without labels of both kinds
    every score is their mean, or 0.5."""
    moments = stats.agg(*[f(s).alias(f"{n}_{s}") for s in STATISTICS for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    model = Model(*[np.array([moments[f"{n}_{s}"] or 0.0 for s in STATISTICS]) for n in "ms"])
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where(fold(F.col("id")) != 0)
    rows = stats.join(known, "id").withColumn("fold", fold(F.col("id")))
    cols = list(STATISTICS)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if len(batch):
                z = model.features(batch[cols].to_numpy())
                total[:, :-1] += z.T @ z
                total[:, -1] += z.T @ batch["label"].to_numpy()
        if total[-1, -2]:
            r, c = np.indices(total.shape)
            yield pd.DataFrame({"r": r.ravel(), "c": c.ravel(), "v": total.ravel()}).astype({"r": "int32", "c": "int32"})

    a = np.zeros((FEATURES + 1, FEATURES + 2))
    for r, c, v in rows.where("fold <> 1").select(*cols, "label").mapInPandas(sums, "r int, c int, v double").groupBy("r", "c").agg(F.sum("v")).collect():
        a[r, c] = v
    n = a[-1, -2]
    if not n:
        return model
    model.x, model.y = np.array([0.0]), np.array([a[-1, -1] / n])
    if a[-1, -1] in (0, n):
        return model
    model.beta = np.linalg.solve(a[:, :-1] + RIDGE * n * np.diag([1.0] * FEATURES + [0.0]) / FEATURES, a[:, -1])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"bin": np.round(model.raw(batch[cols].to_numpy()) * BINS).astype(np.int32), "label": batch["label"]})

    found = rows.where("fold = 1").select(*cols, "label").mapInPandas(binned, "bin int, label double").groupBy("bin").agg(F.sum("label"), F.count("*")).collect()
    if found:  # 3 * BINS + 1 rows at most
        x, t, m = np.array(sorted(found), float).T
        model.x, model.y = isotonic(x / BINS, t, m)
    return model


def classify(stats: DataFrame, model: Model, id_col: str = "doc_id", least: float = 0.3) -> DataFrame:
    kind, cols = stats.schema["id"].dataType.simpleString(), list(STATISTICS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "score": model.score(batch[cols].to_numpy())})

    out = stats.mapInPandas(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), (fold(F.col("id")) == 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id_col, held_out, score (0 to 1) and predicted for every row of docs.

    Only statistics of the text enter a score. Rows with a label count once for each label row of their id; a null id
    has no label. Null and empty texts get the score of their statistics, repeated rows the same score."""
    from ._common import cut

    stats = cut(document_statistics(docs, id_col, text_col), "statistics")
    return classify(stats, fit(stats, labels, id_col, label_col), id_col)
