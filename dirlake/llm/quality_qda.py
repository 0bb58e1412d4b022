"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlake.llm.common import fold, packed, pieces, scratch, work_table
from dirlake.llm.textstats import CLASSES, Texts, class_counts, repeated_lines, repeated_words

FEATURES = ("log_words", "word_length", "lower", "upper", "digit", "stop", "shout", "symbol", "pipe", "bracket_quote_dash", "newline", "wide_latin", "dup_lines", "repeats", "distinct_words", "class_entropy")
N = len(FEATURES)


def _features(texts: pa.Array) -> np.ndarray:
    t = Texts.of(texts)
    words = t.words()
    counts = class_counts(t).astype(float)
    total = counts.sum(1)
    share = counts / np.maximum(total, 1)[:, None]
    part = {c: share[:, i] for i, c in enumerate(CLASSES)}
    n = t.n_words.astype(float)
    lines = np.maximum(counts[:, CLASSES.index("newline")] + 1, 1)
    distinct = _distinct(words, t.doc, len(n))
    entropy = -np.where(share > 0, share * np.log2(np.maximum(share, 1e-12)), 0).sum(1)
    length = (total - counts[:, CLASSES.index("space")] - counts[:, CLASSES.index("newline")]) / np.maximum(n, 1)
    root = np.sqrt
    return np.column_stack([
        np.log1p(n), np.log1p(length), root(part["lower"]), root(part["upper"]), root(part["digit"]), root(part["stop"]), root(part["shout"]), root(part["symbol"]), root(part["pipe"]),
        root(part["bracket"] + part["quote"] + part["dash"]), root(part["newline"]), root(part["wide"] + part["latin"]), root(repeated_lines(t) / lines), root(repeated_words(t, words) / np.maximum(n, 1)),
        np.log1p(distinct) / np.log1p(np.maximum(n, 1)), entropy,
    ])


def _distinct(words: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct words of each text."""
    order = np.lexsort((words, doc)) if len(words) else np.zeros(0, int)
    w, d = words[order], doc[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n)


def features(text: Column) -> Column:
    """An array of len(FEATURES) transformed statistics of each whole text; a null text counts as empty."""

    @F.arrow_udf("array<double>")
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = np.concatenate([np.zeros((0, N)), *(_features(p) for p in pieces(texts))])
            yield pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N).cast(pa.list_(pa.float64()))

    return stats(text.cast("string"))


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors, log determinants and log priors of classes 0 and 1."""

    means: np.ndarray
    whiten: np.ndarray
    logdet: np.ndarray
    prior: np.ndarray
    temper: float = 1.0

    @classmethod
    def of(cls, n: np.ndarray, sums: np.ndarray, outer: np.ndarray, shrink: float, ridge: float) -> Discriminant:
        """From the moments of both classes. Each covariance is shrunk towards the pooled one and its diagonal."""
        n = np.maximum(n, 1e-9)
        means = sums / n[:, None]
        cov = np.array([outer[k] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)])
        pooled = (cov * n[:, None, None]).sum(0) / n.sum()
        target = 0.5 * pooled + 0.5 * np.diag(np.diag(pooled))
        floor = ridge * np.eye(N)
        lower = np.linalg.cholesky(np.array([(1 - shrink) * cov[k] + shrink * target + floor for k in (0, 1)]))
        return cls(means, np.linalg.inv(lower), 2 * np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(1), np.log(n / n.sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1: the logistic of the tempered difference of the log densities."""
        z = np.array([((x - self.means[k]) @ self.whiten[k].T) ** 2 for k in (0, 1)]).sum(2)
        log = -0.5 * (z + self.logdet[:, None]) + self.prior[:, None]
        return 1 / (1 + np.exp(-np.clip(self.temper * (log[1] - log[0]), -700, 700)))


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", columns: Sequence[str] | None = None) -> DataFrame:
    """Work table (own, id, x), a row for each row of `docs`: its `columns` (all where None) as a struct, its id, and the features of its whole text. All that follows reads the features from here."""
    return work_table(docs.select(packed(docs, columns).alias("own"), F.col(doc_id).alias("id"), features(F.col(text)).alias("x")))


def fit(rows: DataFrame, labels: DataFrame, shrink: float = 0.2, ridge: float = 1e-4) -> Discriminant | None:
    """Class moments of all labelled rows (id, x) of `rows` whose crc32(id as text) mod 3 is not 1, summed by Spark.

    `labels` has (doc_id, quality). A document with several labels counts once for each; labels other than 0 and 1, and null ids, count for
    nothing. None if either class has no row.
    """
    known = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), 3) != 1)).select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y"))
    both = rows.where(fold(F.col("id"), 3) != 1).select("id", "x").join(known, "id").select("y", "x")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, outer = np.zeros(2), np.zeros((2, N)), np.zeros((2, N, N))
        for batch in batches:
            x = _matrix(batch.column("x"))
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                n[k] += len(own)
                sums[k] += own.sum(0)
                outer[k] += own.T @ own
        yield pa.record_batch([pa.array([0, 1], pa.int32()), pa.array([[n[k], *sums[k], *outer[k].ravel()] for k in (0, 1)], pa.list_(pa.float64()))], names=["y", "m"])

    width = 1 + N + N * N
    got_rows = both.mapInArrow(moments, "y int, m array<double>").groupBy("y").agg(F.array(*(F.sum(F.col("m")[i]) for i in range(width))).alias("m")).collect()
    got = {r["y"]: np.array(r["m"]) for r in got_rows}
    if any(k not in got or got[k][0] == 0 for k in (0, 1)):
        return None
    m = np.array([got[0], got[1]])
    return Discriminant.of(m[:, 0], m[:, 1 : 1 + N], m[:, 1 + N :].reshape(2, N, N), shrink, ridge)


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, N)


def score(x: Column, model: Discriminant | None) -> Column:
    """Probability that a text with the features `x` is of quality 1; 0.5 for all without a model. Empty and null texts have features too."""

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield pa.array(model.score(_matrix(rows)) if model else np.full(len(rows), 0.5))

    return probability(x)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", model: Discriminant | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """(own, held_out, score, predicted), one row for each row of `docs`: its `columns` (all where None) as a struct and the verdict.

    Null and empty texts are scored by the features of an empty text. Repeated rows are scored one by one, alike, and rows of one id by their own
    texts; a null id is never held out by a label, since none names it. A score of exactly 0.5 is predicted 1, so that without labels of both classes all rows are.
    """
    rows = measured(docs, text, doc_id, columns)
    model = fit(rows, labels) if model is None else model
    scored = rows.select("own", (fold(F.col("id"), 3) == 1).alias("held_out"), score(F.col("x"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows and columns of `docs` that the classifier, fitted on these rows, takes for quality 1; ties at 0.5, and all rows without a model, stay.

    Only features are stored, for the fit; texts are measured again where they pass by, rather than written once more.
    """
    with scratch():
        model = fit(measured(docs, columns=[]), labels)
    return docs.select(packed(docs).alias("own"), score(features(F.col("text")), model).alias("score")).where("score >= 0.5").select("own.*")
