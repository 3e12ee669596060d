"""Hard negatives by inner products in an orthogonal PCA rotation.

All vectors' second moments are summed over the cluster; the eigenvectors of that matrix are a rotation that keeps inner
products and puts most of a vector's length into its leading components. A block of anchors, of bounded number, meets all
rows: products of the leading components are accumulated step by step, what is missing is at most the product of both
residual norms (and a slack for rounding), and pairs that cannot reach the limits any more are discarded. Those that
survive all steps are verified with integer products, so results don't depend on the rotation or on rounding.

Rows are taken in levels, each sixteen times the one before: the best of a small level are limits for the next, so that
tasks over large levels give few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, release_memory, work_table

SCALE = 256
ANCHOR_EVERY = 100
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these shares (in hundredths) of the positive's.
LOW, HIGH = 30, 90
#: Anchors that are sent to tasks at once, at most.
BLOCK = 4096
#: Rows of the first level, about, and how many times as many each next one has.
LEVEL_ROWS, LEVEL_GROWTH = 1 << 16, 16
#: Products held at once by a task.
CELLS = 1 << 21
STEPS = (1 / 4, 1 / 2, 1)
SLACK = 1e-10
NONE = np.iinfo(np.int64).min


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """(key, id, label, v): rows that have a label and a vector of finite numbers, components as floor(scale * x); ``key`` tells
    rows with one id apart."""
    vector = df[vector_col].cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = df.where(df[label_col].isNotNull() & vector.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    whole = F.transform(vector, lambda x: F.floor(x * scale))
    return rows.select(F.monotonically_increasing_id().alias("key"), df[id_col].cast("long").alias("id"), df[label_col].cast("long").alias("label"), whole.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows; shorter ones end in zeros."""
    size = np.asarray(pc.list_value_length(column).to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def rotation(vectors: DataFrame, width: int, scale: int = SCALE) -> np.ndarray:
    """width x width: eigenvectors of the second moments of all rows, largest first. What reaches the driver is one matrix."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(0), width) / scale
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["at", "x"])

    found = vectors.select("v").mapInArrow(sums, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    moments = np.zeros(width * width)
    for r in found:
        moments[r["at"]] = r["x"]
    return np.linalg.eigh(moments.reshape(width, width))[1][:, ::-1]


class Rotated:
    """Integer vectors, their rotated forms and what their norms are beyond each step."""

    def __init__(self, whole: np.ndarray, turn: np.ndarray):
        self.whole, self.turned = whole, whole.astype(float) @ turn
        width = whole.shape[1]
        self.steps = sorted({max(1, int(width * s)) for s in STEPS}) if width else [0]
        squares = np.cumsum(self.turned[:, ::-1] ** 2, axis=1)[:, ::-1]
        self.norm = np.sqrt(squares[:, 0]) if width else np.zeros(len(whole))
        self.rest = {k: np.sqrt(squares[:, k]) if k < width else np.zeros(len(whole)) for k in self.steps}


def surviving(a: Rotated, b: Rotated, open_: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, integer product) of the pairs in ``open_`` whose product is from low to high (of a's row)."""
    first = a.steps[0]
    part = a.turned[:, :first] @ b.turned[:, :first].T
    reach = np.outer(a.rest[first], b.rest[first])
    reach += np.outer(a.norm * SLACK, b.norm) + SLACK
    i, j = np.nonzero(open_ & (part + reach >= low[:, None]) & (part - reach <= high[:, None]))
    part = part[i, j]
    for before, step in zip(a.steps, a.steps[1:]):
        part = part + np.einsum("ij,ij->i", a.turned[i, before:step], b.turned[j, before:step])
        reach = a.rest[step][i] * b.rest[step][j] + a.norm[i] * b.norm[j] * SLACK + SLACK
        keep = (part + reach >= low[i]) & (part - reach <= high[i])
        i, j, part = i[keep], j[keep], part[keep]
    exact = np.einsum("ij,ij->i", a.whole[i], b.whole[j])
    keep = (exact >= low[i]) & (exact <= high[i])
    return i[keep], j[keep], exact[keep]


class Best:
    """The first ``k`` rows of each group, by score downwards, then id (none last), then key."""

    def __init__(self, k: int, groups: int):
        self.k, self.groups = k, groups
        self.rows = np.zeros((0, 5), np.int64)  # group, score, no id, id, key

    def add(self, group: np.ndarray, score: np.ndarray, no_id: np.ndarray, id_: np.ndarray, key: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([group, score, no_id, id_, key], axis=1)])
        rows = rows[np.lexsort((rows[:, 4], rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        self.rows = rows[np.arange(len(rows)) - first < self.k]

    def limits(self) -> np.ndarray:
        """The last score of each full group, or the least number."""
        out = np.full(self.groups, NONE)
        full = np.bincount(self.rows[:, 0], minlength=self.groups) >= self.k
        last = np.searchsorted(self.rows[:, 0], np.flatnonzero(full), "right") - 1
        out[full] = self.rows[last, 1]
        return out


FOUND = "grp long, score long, no_id long, id long, key long"


def _scan(vectors: DataFrame, anchors: Rotated, turn: np.ndarray, best: Callable[[], Best], choose: Callable) -> DataFrame:
    """Each task's best rows for a block of anchors. ``choose(best)`` gives low and high limits of the anchors' products;
    ``choose(best, pairs)`` puts surviving pairs into groups; ``open`` of it says which labels and keys may meet."""
    width, rows_at_once = turn.shape[0], max(64, CELLS // max(1, len(anchors.whole)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = best()
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                key, label = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
                no_id = part.column(1).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                id_ = part.column(1).fill_null(0).to_numpy(zero_copy_only=False)
                rows = Rotated(_matrix(part.column(3), width), turn)
                low, high = choose.limits(kept)
                i, j, score = surviving(anchors, rows, choose.open(key, label), low, high)
                for group, pick in choose.groups(i, score):
                    n = j[pick]
                    kept.add(group, score[pick], no_id[n], id_[n], key[n])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept.rows.T], FOUND.replace(" long", "").split(", "))
        release_memory()

    return vectors.mapInArrow(run, FOUND)


class Positives:
    """Other rows of the anchor's label."""

    def __init__(self, key: np.ndarray, label: np.ndarray, floor: np.ndarray):
        self.key, self.label, self.floor = key, label, floor

    def limits(self, best: Best) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum(best.limits(), self.floor).astype(float), np.full(len(self.key), np.inf)

    def open(self, key: np.ndarray, label: np.ndarray) -> np.ndarray:
        return (self.label[:, None] == label) & (self.key[:, None] != key)

    def groups(self, i: np.ndarray, score: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield i, np.arange(len(i))


class Negatives:
    """Rows of other labels, for each positive of an anchor (score, or NONE) those in its span."""

    def __init__(self, label: np.ndarray, scores: np.ndarray, floor: np.ndarray, low: int, high: int):
        self.label, self.scores, self.floor, self.low, self.high = label, scores, floor, low, high
        there = scores != NONE
        at_least = np.where(there, -((-low * np.where(there, scores, 0)) // 100), 0)
        at_most = np.where(there, high * np.where(there, scores, 0) // 100, 0)
        self.there = there & (at_least <= at_most)
        self.least, self.most = at_least, at_most

    def _floors(self, best: Best) -> np.ndarray:
        return np.maximum(np.maximum(best.limits(), self.floor).reshape(self.scores.shape), self.least)

    def limits(self, best: Best) -> tuple[np.ndarray, np.ndarray]:
        low = np.where(self.there, self._floors(best).astype(float), np.inf)
        high = np.where(self.there, self.most.astype(float), -np.inf)
        return low.min(axis=1, initial=np.inf), high.max(axis=1, initial=-np.inf)

    def open(self, key: np.ndarray, label: np.ndarray) -> np.ndarray:
        return self.label[:, None] != label

    def groups(self, i: np.ndarray, score: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for p in range(self.scores.shape[1]):
            pick = np.flatnonzero(self.there[i, p] & (score >= self.least[i, p]) & (score <= self.most[i, p]))
            yield i[pick] * self.scores.shape[1] + p, pick


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("grp").orderBy(F.desc("score"), "no_id", "id", "key")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def _best_of(levels: list[DataFrame], groups: int, k: int, scan: Callable[[DataFrame, np.ndarray], DataFrame]) -> DataFrame:
    """(grp, score, no_id, id, key, nth) over all levels, each scanned with the limits that the ones before have left."""
    floor, found = np.full(groups, NONE), None
    for n, level in enumerate(levels):
        new = scan(level, floor)
        found = work_table(_merged(new if found is None else found.drop("nth").unionByName(new), k), "best")
        if n + 1 < len(levels):
            for r in found.where(F.col("nth") == k).select("grp", "score").collect():  # one number a group of the block
                floor[r["grp"]] = r["score"]
    return found


def _levels(vectors: DataFrame, n: int, level_rows: int, growth: int) -> list[DataFrame]:
    """The rows in disjoint parts, by a hash of their keys: each part is about ``growth`` times the one before."""
    depth = 0
    while n > level_rows * growth**depth:
        depth += 1
    h = F.pmod(F.xxhash64("key"), F.lit(growth**depth))
    bound = [growth**k for k in range(depth + 1)]
    return [vectors] if not depth else [vectors.where((h < b) & (h >= a)) for a, b in zip([0, *bound[:-1]], bound, strict=True)]


def mine_hard_negatives(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_every: int = ANCHOR_EVERY, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, block: int = BLOCK, level_rows: int = LEVEL_ROWS, growth: int = LEVEL_GROWTH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): see the module.

    A row without label or vector, or with a component that is null or not finite, takes no part; short vectors count as
    ending in zeros. Anchors are rows whose id ``anchor_every`` divides; rows that repeat an id are rows of their own, and a row
    without an id can be a positive or negative, after all others of its score. Scores must fit into 64 bits. Groups with a hot
    label or vector are never gathered: each task keeps a bounded number of rows for each anchor. An empty table gives no rows.
    """
    spark = df.sparkSession
    vectors = work_table(integer_vectors(df, id_col, vector_col, label_col, scale), "vectors")
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    turn = rotation(vectors, width, scale)
    picked = vectors.where(F.col("id") % anchor_every == 0)
    blocks = 1
    hashed = lambda: F.pmod(F.xxhash64("key"), F.lit(blocks))
    while (largest := picked.groupBy(hashed().alias("b")).count().agg(F.max("count")).first()[0] or 0) > block:
        blocks *= 2
    levels, done = _levels(vectors, n, level_rows, growth), None
    for b in range(blocks if largest else 0):
        rows = picked.where(hashed() == b).orderBy("key").toArrow()  # ``block`` rows at most
        if not rows.num_rows:
            continue
        key, ids, label = (rows.column(k).to_numpy() for k in range(3))
        anchors = Rotated(_matrix(rows.column(3).combine_chunks(), width), turn)
        m = len(key)
        near = _best_of(levels, m, positives, lambda level, floor: _scan(level, anchors, turn, lambda: Best(positives, m), Positives(key, label, floor)))
        scores = np.full((m, positives), NONE)
        names = {}
        for r in near.collect():  # ``positives`` rows an anchor of the block
            scores[r["grp"], r["nth"] - 1] = r["score"]
            names[r["grp"] * positives + r["nth"] - 1] = None if r["no_id"] else r["id"]
        chosen = lambda floor: Negatives(label, scores, floor, low, high)
        far = _best_of(levels, m * positives, negatives, lambda level, floor: _scan(level, anchors, turn, lambda: Best(negatives, m * positives), chosen(floor)))
        told = [(g, int(ids[g // positives]), p, int(scores.flat[g])) for g, p in names.items()]
        told = spark.createDataFrame(told, "grp long, anchor_id long, positive_id long, positive_score long")
        out = far.join(F.broadcast(told), "grp").select(  # ``block * positives`` rows at most
            "anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), F.when(F.col("no_id") == 0, F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        done = out if done is None else done.unionByName(out)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame([], empty) if done is None else done


def relabelled(id_: Column, label: Column) -> Column:
    """The contract's labels: where 7 divides the id, the next one of ten."""
    return F.when(id_ % 7 == 0, (label + 1) % 10).otherwise(label)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``. Nulls, ties, repeated and odd rows: see mine_hard_negatives."""
    df = read_table(spark, sf_dir, "embeddings")
    rows = df.select(df["vec_id"], df["embedding"], relabelled(df["vec_id"], df["label"].cast("long")).alias("label"))
    return mine_hard_negatives(rows)


OP12_SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM good a, good b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
FROM pos JOIN p n USING (anchor_id)
WHERE NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 10
"""
