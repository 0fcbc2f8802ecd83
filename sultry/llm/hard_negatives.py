"""Hard-negative mining: exact searches over length buckets with coordinate pruning."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A hard negative's score lies between these percentages of its positive's.
LEAST, MOST = 50, 95
#: Rows of a length bucket, whose coordinates are sorted; coordinates of an anchor whose lists are intersected.
BUCKET, FOCUS = 2048, 3
#: Lists that would leave more than this share of a bucket, if coordinates were independent, are not intersected; the bucket's rows are all verified at once instead.
WORTH = 0.2
#: A cell of a search holds at most about so many anchors at a time and streams about so many other rows.
ANCHORS, PROBES = 32_768, 65_536
#: Groups of other rows at least, so that a search has tasks enough; labels are dealt to so many groups in the search for positives.
GROUPS, LABELS = 16, 64
#: Components are held within this range, so that sums of products stay exact in 64 bits.
LARGEST = 1 << 26
_LOW = np.iinfo(np.int64).min


def usable(vectors: DataFrame, vec_id: str, label: str, vector: str, scale: int) -> DataFrame:
    """Rows (vec_id, label, v, norm, row_): v has floor(scale * x) of each component. Rows without an id, a label or a vector, or with a null or
    non-finite component, take no part; rows that agree in all three are one."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform("x", lambda c: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), scale * c))).cast("long"))
    df = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), x.alias("x"))
    df = df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    df = df.select("vec_id", "label", whole.alias("v")).dropDuplicates()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c))
    return df.withColumn("norm", norm).withColumn("row_", F.xxhash64("vec_id", "label", "v"))


def _matrix(lists: list[np.ndarray]) -> np.ndarray:
    """The vectors as rows; where lengths differ, missing components are zero."""
    width = max(map(len, lists))
    out = np.zeros((len(lists), width))
    for row, v in zip(out, lists, strict=True):
        row[: len(v)] = v
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exact: in floats where every sum fits their 53 bits, else in 64-bit integers."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(d, 1) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def feasible(q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range that coordinate values of unit vectors have whose cosine with a unit vector is at least t, where that vector has q in this
    coordinate: cosines of the angles that differ by at most arccos(t)."""
    a, p = np.arccos(np.clip(q, -1, 1)), np.arccos(np.clip(t, -1, 1))
    low = np.where(a + p >= np.pi, -1.0, np.cos(np.minimum(a + p, np.pi)))
    high = np.where(a <= p, 1.0, np.cos(np.maximum(a - p, 0)))
    return low - 1e-9, high + 1e-9


class Bucket:
    """Vectors of similar length with, for each coordinate asked for, their order by its value in the unit vector."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, norms: np.ndarray):
        self.ids, self.labels, self.v, self.norms = ids, labels, v, norms
        self.longest, self.shortest = norms.max(), norms.min()
        self._lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of coordinate f in order, the rows in that order, and each row's place in it."""
        if f not in self._lists:
            x = self.v[:, f] / np.maximum(self.norms, 1e-300) if f < self.v.shape[1] else np.zeros(len(self.ids))
            order = np.argsort(x, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            self._lists[f] = (x[order], order, place)
        return self._lists[f]

    def candidates(self, anchors: Anchors, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, rows, scores) for every anchor that can score `least` or more in this bucket; rows that cannot are left out where lists show it."""
        reach = np.where(least >= 0, self.longest, self.shortest) * anchors.norms
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(reach > 0, least / reach - 1e-12, np.where(least > 0, 2.0, -1.0))  # less than rounding can add
        live = np.flatnonzero(t <= 1 + 1e-9)
        if not len(live):
            return
        n = len(self.ids)
        start, end = np.zeros((len(live), anchors.focus.shape[1]), np.int64), np.full((len(live), anchors.focus.shape[1]), n)
        focus = anchors.focus[live]
        for f in np.unique(focus[t[live] > 0]):  # a threshold of zero or less rules out next to nothing
            values = self.sorted_list(int(f))[0]
            i, j = np.nonzero((focus == f) & (t[live] > 0)[:, None])
            low, high = feasible(anchors.unit[live[i], f], t[live[i]])
            start[i, j], end[i, j] = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
        some = ((end - start) / n).prod(axis=1) <= WORTH
        for i in np.flatnonzero(some):
            a, (s, e) = live[i], (start[i], end[i])
            k = int(np.argmin(e - s))
            rows = self.sorted_list(int(focus[i, k]))[1][s[k] : e[k]]
            for j in range(len(s)):
                if j != k and e[j] - s[j] < n:
                    place = self.sorted_list(int(focus[i, j]))[2][rows]
                    rows = rows[(place >= s[j]) & (place < e[j])]
            if len(rows):
                yield a, rows, exact_products(anchors.v[a : a + 1], self.v[rows])[0]
        rest, every = live[~some], np.arange(n)
        for at in range(0, len(rest), 1024):
            part = rest[at : at + 1024]
            for a, scores in zip(part, exact_products(anchors.v[part], self.v), strict=True):
                yield a, every, scores


@dataclass
class Anchors:
    """Anchors of a cell, with the best rows found so far for each of their windows of scores (low, high)."""

    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    norms: np.ndarray
    windows: list[list[tuple[int, int]]]
    keep: int
    found: list[list[list[tuple[int, int]]]] = field(init=False)

    def __post_init__(self) -> None:
        self.unit = self.v / np.maximum(self.norms, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]
        self.found = [[[] for _ in w] for w in self.windows]
        self.low = [[low for low, _ in w] for w in self.windows]
        self.least = np.array([min(low, default=np.inf) for low in self.low], float)

    def offer(self, a: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Keep the best `keep` of each window: higher scores first, ties by smaller id. A full window's low end rises to its last score."""
        for w, (_, high) in enumerate(self.windows[a]):
            at = np.flatnonzero((scores >= self.low[a][w]) & (scores <= high))
            if not len(at):
                continue
            at = at[np.lexsort((ids[at], -scores[at]))[: self.keep]]
            best = sorted([*self.found[a][w], *zip((-scores[at]).tolist(), ids[at].tolist(), strict=True)])[: self.keep]
            self.found[a][w] = best
            if len(best) == self.keep:
                self.low[a][w] = max(self.low[a][w], -best[-1][0])
        self.least[a] = min(self.low[a])


def _search(cells: DataFrame, parts: int, keep: int, same: bool) -> DataFrame:
    """Rows (vec_id, row_, window, other_id, score): for each anchor (side 0) of a cell and each of its windows, the best `keep` among the cell's
    other rows (side 1) of the same label or of different ones. The anchors of a cell are held; the rest streams by in order of length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, anchors, probes = None, [], None, []

        def settle() -> None:
            nonlocal anchors, waiting
            if waiting:
                ids, rows, labels, norms, lists, windows = (list(c) for c in zip(*waiting, strict=True))
                anchors = Anchors(np.array(ids), np.array(rows), np.array(labels), _matrix(lists), np.array(norms), windows, keep)
                waiting = []

        def scan() -> None:
            nonlocal probes
            settle()
            if probes and anchors is not None:
                ids, labels, norms, lists = (list(c) for c in zip(*probes, strict=True))
                bucket = Bucket(np.array(ids), np.array(labels), _matrix(lists), np.array(norms))
                for a, rows, scores in bucket.candidates(anchors, anchors.least):
                    fit = bucket.labels[rows] == anchors.labels[a]
                    fit = fit & (bucket.ids[rows] != anchors.ids[a]) if same else ~fit
                    fit &= scores >= anchors.least[a]
                    if fit.any():
                        anchors.offer(a, bucket.ids[rows[fit]], scores[fit])
            probes = []

        def results() -> Iterator[pa.RecordBatch]:
            nonlocal anchors
            scan()
            if anchors is not None:
                out = [(i, r, w, o, -s) for i, r, ws in zip(anchors.ids.tolist(), anchors.rows.tolist(), anchors.found, strict=True) for w, best in enumerate(ws) for s, o in best]
                for at in range(0, len(out), 10_000):
                    columns = zip(*out[at : at + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["vec_id", "row_", "window", "other_id", "score"])
            anchors = None

        for batch in batches:
            numbers, side, ids, rows, labels, norms = (batch.column(i).to_pylist() for i in range(6))
            ends = batch.column(6).offsets.to_numpy()
            values = batch.column(6).values.to_numpy(zero_copy_only=False)
            windows = batch.column(7).to_pylist()
            for i in range(batch.num_rows):
                if numbers[i] != cell:
                    yield from results()
                    cell = numbers[i]
                v = values[ends[i] : ends[i + 1]]
                if side[i] == 0:
                    waiting.append((ids[i], rows[i], labels[i], norms[i], v, [(w["low"], w["high"]) for w in windows[i]]))
                else:
                    probes.append((ids[i], labels[i], norms[i], v))
                    if len(probes) == BUCKET:
                        scan()
        yield from results()

    dealt = cells.repartition(parts, "cell").sortWithinPartitions("cell", "side", F.desc("norm"), "vec_id")
    return dealt.select("cell", "side", "vec_id", "row_", "label", "norm", "v", "windows").mapInArrow(run, "vec_id long, row_ long, window int, other_id long, score long")


def _cells(anchors: DataFrame, rows: DataFrame, blocks: int, groups: int, labels: Column) -> DataFrame:
    """Both sides dealt so that each anchor meets each row of its label group once: a cell for each label group, block of anchors and group of rows.
    Anchors go to all groups, rows to all blocks."""
    number = lambda block, group: ((labels * blocks + block) * groups + group).cast("long").alias("cell")
    hashed = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n))
    left = anchors.withColumn("g_", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("b_", hashed(blocks))
    right = rows.withColumn("b_", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("g_", hashed(groups))
    none = F.lit(None).cast("array<struct<low:bigint,high:bigint>>").alias("windows")
    columns = ["vec_id", "row_", "label", "norm", "v"]
    return left.select(number(F.col("b_"), F.col("g_")), F.lit(0).alias("side"), *columns, "windows").union(right.select(number(F.col("b_"), F.col("g_")), F.lit(1).alias("side"), *columns, none))


def mine_hard_negatives(
    vectors: DataFrame,
    anchor: Callable[[Column], Column],
    vec_id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    scale: int = SCALE,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that anchor(vec_id) marks, its first `positives`
    other rows of the same label, and for each of these the first `negatives` rows of other labels whose score lies between LEAST and MOST percent of
    the positive's. A score is the integer inner product of vectors of floor(scale * x); higher scores come first, ties by smaller id.

    The anchors, a stated share of the rows, are searched against all rows in cells of bounded size: a block of anchors is held while a group of rows
    streams by in order of decreasing length, cut into buckets. In a bucket, an anchor's threshold (the last of its best so far) bounds the
    cosine, and so the values that its largest coordinates allow; the coordinates' sorted lists give the rows within these ranges, their intersection
    is verified by exact products. Buckets too short to reach the threshold are passed over. A positive has the anchor's label, so
    the first search deals rows by label; a hot label is dealt over groups as any other. Each cell gives a few rows for each anchor and window, which
    windowed ranks merge.

    Rows without an id, a label or a vector, or with a null or non-finite component, take no part, nor do rows of the anchor's own id as positives;
    rows that agree in id, label and vector count once; a vector's missing components count as zero, an empty or zero vector scores 0; components are held
    within LARGEST after scaling. Anchors without positives, and positives without negatives, have no rows. An empty table gives none; other columns
    are ignored."""
    rows = materialize(usable(vectors, vec_id, label, vector, scale), "vectors")
    anchors = materialize(rows.where(anchor(F.col("vec_id"))), "anchors")
    n, m = rows.count(), anchors.count()
    blocks, groups = max(1, -(-m // ANCHORS)), max(1, -(-n // PROBES))
    any_score = F.array(F.struct(F.lit(_LOW).cast("long").alias("low"), F.lit(-_LOW - 1).cast("long").alias("high")))
    by_label = F.pmod(F.xxhash64("label"), F.lit(LABELS))
    parts = min(LABELS * blocks * groups, 4096)
    met = _search(_cells(anchors.withColumn("windows", any_score), rows, blocks, groups, by_label), parts, positives, same=True)
    key = ["vec_id", "row_"]
    order = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    near = met.withColumn("rank", F.row_number().over(order(*key))).where(F.col("rank") <= positives)
    near = materialize(near.select(*key, F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # LEAST * p <= 100 * n <= MOST * p in whole numbers; of a negative score nothing lies between.
    low, high = F.expr(f"-((-{LEAST} * positive_score - pmod(-{LEAST} * positive_score, 100)) div 100)"), F.expr(f"({MOST} * positive_score - pmod({MOST} * positive_score, 100)) div 100")
    spans = near.select(*key, low.alias("low"), high.alias("high")).where("low <= high").distinct()
    spans = spans.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("windows"))
    searched = materialize(anchors.join(spans, key), "searched")
    groups = max(GROUPS, groups)
    found = _search(_cells(searched, rows, blocks, groups, F.lit(0)), min(blocks * groups, 4096), negatives, same=False)
    best = found.withColumn("rank", F.row_number().over(order(*key, "window"))).where(F.col("rank") <= negatives)
    placed = searched.select(*key, F.posexplode("windows").alias("window", "w")).select(*key, "window", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    best = best.join(placed, [*key, "window"])
    out = near.withColumn("low", low).withColumn("high", high).join(best, [*key, "low", "high"])
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
