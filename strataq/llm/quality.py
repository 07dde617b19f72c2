"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, map_arrow, texts_of

FEATURES = ("log_chars", "word_mean", "word_sd", "upper_words", "capital_words", "digits", "symbols", "bangs", "stops",
            "new_words", "new_lines", "line_mean", "top_word", "ends_marked", "letters", "spaces", "top_pair", "long_words")
SYMBOLS = np.frombuffer(b"#$%&*|@~^<>=_+{}[]\\/", np.uint8)
MARKS = re.compile(r"[^\w\s]$")


def statistics(text: str) -> list[float]:
    """Document statistics, transformed to be nearer to normal: logs of sizes, arcsines of root shares."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    chars, words = max(1, len(text)), text.split()
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:])) if len(words) > 1 else Counter({(): 0})
    lines = [x for x in text.split("\n") if x.strip()]
    letters = raw[65:91].sum() + raw[97:123].sum() + raw[0xC2:0xF5].sum()
    share = [
        sum(map(str.isupper, words)) / n, sum(w[0].isupper() for w in words) / n, raw[48:58].sum() / chars,
        raw[SYMBOLS].sum() / chars, raw[33] / chars, (raw[46] + raw[44]) / chars, len(counts) / n,
        len(set(lines)) / max(1, len(lines)), max(counts.values(), default=0) / n,
        sum(not w[-1].isalnum() for w in words) / n, min(1, letters / chars), (raw[32] + raw[10]) / chars,
        max(pairs.values()) / n, float((sizes > 20).mean()),
    ]
    s = [float(np.arcsin(np.sqrt(min(1.0, max(0.0, x))))) for x in share]
    line_mean = sum(map(len, lines)) / max(1, len(lines))
    return [float(np.log1p(len(text))), float(np.log1p(sizes.mean())), float(np.log1p(sizes.std())), s[0], s[1], s[2], s[3],
            s[4], s[5], s[6], s[7], float(np.log1p(line_mean)), s[8], s[9], s[10], s[11], s[12], s[13]]


@dataclass
class Discriminant:
    """Two normal densities on standardised statistics; chol holds the inverse Cholesky factors."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    chol: np.ndarray
    logdet: np.ndarray
    slope: float
    intercept: float

    def ratio(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = np.clip((x - self.centre) / self.scale, -30, 30)
        d = [((z - self.means[k]) @ self.chol[k].T) for k in (0, 1)]
        m = [np.einsum("ij,ij->i", v, v) for v in d]
        return 0.5 * (m[0] + self.logdet[0]) - 0.5 * (m[1] + self.logdet[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.ratio(x) + self.intercept, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, shrinkage: float = 0.15) -> Discriminant:
    """Class covariances, shrunk towards the pooled one and towards a multiple of the identity.

    The two calibration figures turn the log-density difference into a probability; they are fitted by Newton steps.
    With one class only, or none, the score is that class' share, or a half.
    """
    p = x.shape[1]
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 4 or min((y == 0).sum(), (y == 1).sum()) < 2:
        odds = np.log((share * len(y) + 0.5) / ((1 - share) * len(y) + 0.5))
        eye = np.eye(p)
        return Discriminant(np.zeros(p), np.ones(p), np.zeros((2, p)), np.stack([eye, eye]), np.zeros(2), 0.0, float(odds))
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.clip((x - centre) / scale, -30, 30)
    means = np.stack([z[y == k].mean(0) for k in (0, 1)])
    covs = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum(c * (y == k).mean() for k, c in enumerate(covs))
    chol, logdet = [], []
    for k, c in enumerate(covs):
        lam = min(1.0, shrinkage + p / max(1, (y == k).sum()))
        c = (1 - lam) * c + lam * (0.5 * pooled + 0.5 * np.eye(p) * np.trace(pooled) / p) + 1e-3 * np.eye(p)
        low = np.linalg.cholesky(c)
        chol.append(np.linalg.inv(low))
        logdet.append(2 * np.log(np.diag(low)).sum())
    model = Discriminant(centre, scale, means, np.stack(chol), np.array(logdet), 1.0, 0.0)
    r = np.clip(model.ratio(x), -60, 60)
    w = np.array([0.1, np.log(share / (1 - share))])
    a = np.stack([r, np.ones_like(r)], 1)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (q - y) + np.array([1e-3 * w[0], 1e-3 * w[1]])
        hess = (a * (q * (1 - q))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -1, 1)
    model.slope, model.intercept = float(max(w[0], 1e-4)), float(w[1])
    return model


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in texts_of(batch)], np.float64).reshape(-1, len(FEATURES))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([column(batch, "id"), flat], ["id", "x"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(picked, run, f"id {picked.schema['id'].dataType.simpleString()}, x array<double>")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", folds: int = 5, held_fold: int = 0, cut_at: float = 0.3,
                  max_fit_rows: int = 20_000, shrinkage: float = 0.15) -> DataFrame:
    """id_col, held_out, score (0 to 1) and predicted for every document, whole texts.

    The model is fitted on at most `max_fit_rows` labelled rows outside the held-out fold, those with the smallest hash
    of the id, whatever the size of the table; hashes are even, so labels beyond twice their share are left out
    before the join, and no task sends more than is asked for in all. Null texts count as empty and get a score too;
    null labels teach nothing; a document with several labels teaches by each, and so does each of its repeated rows,
    which are kept; without labels every score is a half; an empty table gives an empty result. Extra columns are not read.
    The statistics of all texts are computed once and written to the shared folder, where both steps read them.
    """
    spark = docs.sparkSession
    stats = cut(document_statistics(docs, id_col, text_col))
    held = lambda c: F.pmod(F.crc32(F.col(c).cast("string")), F.lit(folds)) == held_fold
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    known = known.where(F.col("y").isNotNull() & ~held("id"))
    mix = F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    share = min(1.0, 2.0 * max_fit_rows / max(1, known.count()))
    known = known.where(mix < int(share * (1 << 32)))
    rows = stats.join(known, "id").orderBy(mix, "id", "y").limit(max_fit_rows).select("x", "y").toPandas()
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    model = spark.sparkContext.broadcast(fit(x, rows["y"].to_numpy(np.float64), shrinkage))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = column(batch, "x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
        return pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(model.value.score(x))], ["id", "score"])

    out = map_arrow(stats, run, f"id {stats.schema['id'].dataType.simpleString()}, score double", rows=8192)
    return out.select(F.col("id").alias(id_col), F.coalesce(held("id"), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= cut_at).cast("int").alias("predicted"))
