"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, words_col

#: Share of the pooled covariance in each class's, then of a multiple of the identity.
POOLED, RIDGE = 0.1, 0.05
#: The least multiple of the identity, for statistics that are all constant.
FLOOR = 1e-6
THRESHOLD = 0.3


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, x array<double>): transformed statistics of each whole text. Counts go through log1p, shares
    through the square root. Nothing but the text is read."""
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda p: F.length(t) - F.length(F.regexp_replace(t, p, ""))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("t"), words_col(F.col(text)).alias("w"), F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "").alias("l"))
    t, w, l = F.col("t"), F.col("w"), F.col("l")  # noqa: E741
    n, chars, lines = F.greatest(F.size(w), F.lit(1)), F.greatest(F.length(t), F.lit(1)), F.greatest(F.size(l), F.lit(1))
    same_next = F.size(F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: a == b), lambda x: x))
    share = lambda a, b: F.sqrt(a / b)
    x = F.array(
        F.log1p(F.size(w)),
        F.log1p(F.length(t) / n),
        share(count(r"[#*$%&|<>]"), chars),
        share(count("!"), chars),
        share(count(r"\p{Lu}"), chars),
        share(count(r"\p{N}"), chars),
        share(count(r"[.,]"), chars),
        share(same_next, n),
        share(F.size(F.filter(w, lambda v: v.rlike(r"[#*$%&|<>!]$"))), n),
        share(n - F.greatest(F.size(F.array_distinct(w)), F.lit(1)), n),
        F.log1p(F.size(l)),
        share(lines - F.greatest(F.size(F.array_distinct(l)), F.lit(1)), lines),
    )
    return d.select("doc_id", F.transform(x, lambda v: F.coalesce(v.cast("double"), F.lit(0.0))).alias("x"))


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors of the class covariances, and log terms; standardised inputs."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the difference of the classes' log-densities and priors."""
        z = (x - self.center) / self.scale
        log = [o - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -30, 30)))


def fit(training: DataFrame, pooled: float = POOLED, ridge: float = RIDGE) -> Discriminant | None:
    """Discriminant of all rows (y 0 or 1, x); None where a class has fewer than two rows. Only sums, squares and
    products reach the driver: one row for each class."""
    first = training.select("x").limit(1).collect()
    if not first:
        return None
    d = len(first[0][0])
    cols = [F.col("x")[i] for i in range(d)]
    total = training.agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    center, scale = np.array(total[:d]), np.array(total[d:])
    scale[scale < 1e-9] = 1.0
    std = [(c - float(m)) / float(s) for c, m, s in zip(cols, center, scale, strict=True)]
    wide = training.select("y", *[c.alias(f"z{i}") for i, c in enumerate(std)])
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    rows = wide.groupBy("y").agg(F.count("*"), *[F.sum(f"z{i}") for i in range(d)], *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i, j in pairs]).collect()
    by = {r[0]: r for r in rows}
    if any(y not in by or by[y][1] < 2 for y in (0, 1)):
        return None
    n = np.array([by[y][1] for y in (0, 1)], float)
    means = np.array([by[y][2 : 2 + d] for y in (0, 1)]) / n[:, None]
    covariances = np.zeros((2, d, d))
    for y in (0, 1):
        for (i, j), v in zip(pairs, by[y][2 + d :], strict=True):
            covariances[y, i, j] = covariances[y, j, i] = v / n[y] - means[y, i] * means[y, j]
    shared = np.average(covariances, axis=0, weights=n)
    factors, offsets = [], []
    for y in (0, 1):
        c = (1 - pooled) * covariances[y] + pooled * shared
        c = (1 - ridge) * c + max(ridge * np.trace(c) / d, FLOOR) * np.eye(d)
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(n[y] / n.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(center, scale, means, np.array(factors), np.array(offsets))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each document: the probability of label 1, from a
    regularised quadratic discriminant fitted on all labelled documents that are not held out.

    The statistics are computed once, where texts are read, and written as a narrow table; labels join that, not the
    texts. Each class covariance is shrunk towards the pooled one and then the identity, so constant statistics do
    no harm; the Cholesky factors are inverted once and sent to the tasks. Null and empty texts get the score of
    their all-zero statistics; labels other than 0 and 1 or without an id are ignored, and of several labels of one document the
    highest counts; without rows of both classes every score is 0.5; repeated rows score alike; other columns
    are ignored."""
    stats = materialize(statistics(docs, doc_id, text), "statistics")
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    training = materialize(stats.where(~held_out(F.col("doc_id"))).join(known, "doc_id").select("y", "x"), "training")
    model = fit(training)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        score = model.score(x) if model else np.full(batch.num_rows, 0.5)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = map_batches(stats, run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
