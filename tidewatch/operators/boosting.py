"""Second-order gradient boosting over binned columns, for all folds of a plan together.

Rows become blocks of bytes (a bin for each column) in a table that is read in every pass. A pass
adds up gradients, second derivatives and rows by fold, node, column and bin for one level of
every fold's tree; the driver sees these sums only and takes the best split of each node. Trees of a
limited number of leaves are grown best leaf first: a leaf's best split does not depend on the
order, so all levels are looked at and the best leaves are picked afterwards. Every ``HOLD`` trees
the blocks are written anew with the scores so far.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.held import written

BINS, HOLD = 256, 20
#: Tasks from which on their sums are added by another stage before they reach the driver.
MANY = 32
#: Rows for which a pass has a task, about; fewer would be mostly starting it.
TASK_ROWS = 20_000


@dataclass(frozen=True)
class Settings:
    """``leaves`` None: every node of a level is split; else the best leaf is, until there are so many."""

    rounds: int = 300
    rate: float = 0.05
    depth: int = 4
    leaves: int | None = None
    rows: float = 1.0
    columns: float = 1.0
    ridge: float = 1.0
    least_hessian: float = 1.0
    least_rows: int = 0
    seed: int = 42


# The settings of the two boosted models.
LEVELS = Settings(300, 0.05, 4, None, 0.8, 0.8, 1.0, 1.0, 0)
LEAVES = Settings(300, 0.05, 6, 31, 1.0, 1.0, 0.0, 1e-3, 20)


@dataclass
class Tree:
    """Nodes in heap order (children of ``k`` are ``2 k + 1`` and ``2 k + 2``): the column (-1: a leaf) and bin of the
    split, and the value of the leaf."""

    column: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int16), np.zeros(n, np.int32), np.zeros(n))

    def nodes(self, bins: np.ndarray, single: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row reaches in ``depth`` steps. A column that is ``single`` has the bin itself on the left."""
        at = np.zeros(len(bins), np.int64)
        for _ in range(depth):
            c = self.column[at]
            inner = c >= 0
            if not inner.any():
                break
            b = bins[np.arange(len(bins)), np.maximum(c, 0)]
            left = np.where(single[np.maximum(c, 0)], b == self.bin[at], b <= self.bin[at])
            at = np.where(inner, 2 * at + 2 - left, at)
        return at


@dataclass
class Model:
    """One fold's trees; ``edges``: for each number column the largest values of its bins but the last; ``names``: the
    known values of the category; ``start``: the score before any tree."""

    edges: list[np.ndarray]
    names: list[str]
    start: float
    constant: float | None = None
    trees: list[Tree] = field(default_factory=list)

    def bins(self, numbers: list[np.ndarray], category: list[str] | None) -> np.ndarray:
        out = [np.searchsorted(e, x, "left") for e, x in zip(self.edges, numbers, strict=True)]
        if category is not None:
            place = {v: i for i, v in enumerate(self.names)}
            out.append(np.array([place.get(v, len(self.names)) for v in category], np.int64))
        return np.array(out, np.uint16).T

    def scores(self, bins: np.ndarray, single: np.ndarray, depth: int) -> np.ndarray:
        total = np.full(len(bins), self.start)
        for t in self.trees:
            total += t.value[t.nodes(bins, single, depth)]
        return 1 / (1 + np.exp(-total))


def best_splits(sums: np.ndarray, s: Settings, single: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gain, column, bin, sums of the left side) of the best split of each node, of sums (node, column, bin, three:
    gradients, second derivatives, rows). Ties go to the first column and bin; gain 0 where no split is allowed."""
    total = sums.sum(2, keepdims=True)
    left = np.where(single[None, :, None, None], sums, np.cumsum(sums, axis=2))
    right = total - left
    part = lambda x: x[..., 0] ** 2 / np.maximum(x[..., 1] + s.ridge, 1e-12)
    gain = part(left) + part(right) - part(total)
    fine = (np.minimum(left[..., 1], right[..., 1]) >= s.least_hessian) & (np.minimum(left[..., 2], right[..., 2]) >= max(1, s.least_rows))
    gain = np.where(fine & allowed[None, :, None] & (gain > 1e-10), gain, 0.0)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(1)
    at = np.arange(len(gain))
    column, b = np.divmod(best, gain.shape[2])
    return flat[at, best], column, b, left[at, column, b]


def grown(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], totals: dict[int, np.ndarray], s: Settings) -> Tree:
    """The tree of the best splits (gain, column, bin by node) of each level; with ``leaves``, of the best ones."""
    tree = Tree.empty(s.depth)
    gain_of, split_of = {}, {}
    for d, (gain, column, b) in enumerate(levels):
        for i in range(len(gain)):
            node = 2**d - 1 + i
            if gain[i] > 0 and node in totals:
                gain_of[node], split_of[node] = gain[i], (column[i], b[i])
    heap, leaves = [(-gain_of[0], 0)] if 0 in gain_of else [], 1
    while heap and (s.leaves is None or leaves < s.leaves):
        _, node = heapq.heappop(heap)
        tree.column[node], tree.bin[node] = split_of[node]
        leaves += 1
        for child in (2 * node + 1, 2 * node + 2):
            if child in gain_of:
                heapq.heappush(heap, (-gain_of[child], child))
    for node, (g, h, _) in totals.items():
        tree.value[node] = -s.rate * g / (h + s.ridge) if h + s.ridge > 0 else 0.0
    return tree


def _chosen(ids: np.ndarray, share: float, seed: int) -> np.ndarray:
    """A share of the rows by a hash of their ids, another one for each seed."""
    if share >= 1:
        return np.ones(len(ids), bool)
    x = ids ^ np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))) < np.uint64(min(int(share * 2**64), 2**64 - 1))


BLOCK = "fold long, bins binary, y binary, id binary, score binary"


def _arrays(batch: pa.RecordBatch, columns: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for fold, bins, y, ids, score in zip(*[batch.column(k) for k in range(5)], strict=True):
        get = lambda x, t: np.frombuffer(x.as_buffer(), t)
        yield fold.as_py(), get(bins, np.uint16).reshape(-1, columns), get(y, np.uint8), get(ids, np.uint64), get(score, np.float64)


def _edges(rows: DataFrame, numeric: list[str], bins: int) -> dict[int, list[np.ndarray]]:
    """By fold and column the upper edges of at most ``bins`` bins: all values where they are few, else quantiles."""
    few = rows.groupBy("_fold").agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in numeric]).collect()
    exact = {c for c in numeric if max(r[c] for r in few) <= 0.9 * bins}
    steps = [k / bins for k in range(1, bins)]
    made = [F.array_sort(F.collect_set(c)).alias(c) if c in exact else F.array_sort(F.array_distinct(F.percentile_approx(c, steps, 100 * bins))).alias(c) for c in numeric]
    out = {}
    for r in rows.groupBy("_fold").agg(*made).collect():  # at most ``bins`` values for each fold and column
        out[r["_fold"]] = [np.array(r[c][:-1] if c in exact else r[c], float) for c in numeric]
    return out


def fit(parts: list[tuple[int, DataFrame]], numeric: list[str], target: str, category: str | None = None, settings: Settings = LEVELS) -> dict[int, Model]:
    """A model for each (fold, rows). Numbers and the category have no nulls (as ``models`` fills them); rows whose
    target is null are left out; a fold with one class, or without rows, is a constant. Equal rows are drawn alike."""
    s, rows = settings, None
    for fold, train in parts:
        part = train.where(F.col(target).isNotNull()).select(F.lit(fold).cast("long").alias("_fold"), *[F.col(c).cast("double").alias(c) for c in numeric], *([F.col(category).cast("string").alias("_category")] if category else []), F.col(target).cast("int").alias("_y"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return {}
    rows = written(rows, "rows")
    stats = {r["_fold"]: (r["n"], r["m"]) for r in rows.groupBy("_fold").agg(F.count("*").alias("n"), F.avg("_y").alias("m")).collect()}
    edges = _edges(rows, numeric, BINS) if stats else {}
    names = {r["_fold"]: sorted(r["c"]) for r in rows.groupBy("_fold").agg(F.collect_set("_category").alias("c")).collect()} if category else {}
    models: dict[int, Model] = {}
    for fold, _ in parts:
        n, m = stats.get(fold, (0, None))
        constant = None if n and 0 < m < 1 else float(m or 0.0)
        models[fold] = Model(edges.get(fold, []), names.get(fold, []), 0.0 if constant is not None else float(np.log(m / (1 - m))), constant)
    active = [f for f, model in models.items() if model.constant is None]
    if not active:
        return models
    columns = len(numeric) + bool(category)
    single = np.array([False] * len(numeric) + [True] * bool(category))
    n_bins = max([2, *(len(e) + 1 for m in models.values() for e in m.edges), *(len(x) + 1 for x in names.values())])  # as many as any column has
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(models)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column(0).to_numpy(zero_copy_only=False)
            for fold in np.unique(folds):
                part = batch.filter(pa.array(folds == fold))
                numbers = [part.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(numeric))]
                model = known.value[int(fold)]
                b = model.bins(numbers, part.column(1 + len(numeric)).to_pylist() if category else None)
                y, ids = part.column(part.num_columns - 2).to_numpy(zero_copy_only=False).astype(np.uint8), part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
                values = [int(fold), np.ascontiguousarray(b).tobytes(), y.tobytes(), ids.tobytes(), np.full(len(y), model.start).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i == 0 else pa.binary()) for i, v in enumerate(values)], names=["fold", "bins", "y", "id", "score"])

    some = rows.where(F.col("_fold").isin(active))
    state = written(some.withColumn("_id", F.xxhash64(*some.columns)).mapInArrow(blocks, BLOCK), "blocks")
    enough = -(-sum(stats[f][0] for f in active) // TASK_ROWS)
    held = _held(state, columns, enough)
    fresh: dict[int, list[Tree]] = {f: [] for f in active}  # trees that the blocks' scores have not
    rng = np.random.default_rng(s.seed)

    def sums(round_: int, level: int, now: dict[int, Tree]) -> dict[int, np.ndarray]:
        """For each fold the sums (node of the level, column, bin, three)."""
        size = (2**level, columns, n_bins, 3)

        def work(blocks_: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
            found: dict[int, np.ndarray] = {}
            for fold, bins, y, ids, score in blocks_:
                keep = np.flatnonzero(_chosen(ids, s.rows, s.seed + round_))
                bins, y, f = bins[keep], y[keep], score[keep]  # noqa: PLW2901
                for t in fresh[fold]:
                    f = f + t.value[t.nodes(bins, single, s.depth)]
                p = 1 / (1 + np.exp(-f))
                node = now[fold].nodes(bins, single, level) - (2**level - 1)
                here = np.flatnonzero(node >= 0)
                g, h, node = (p - y)[here], (p * (1 - p))[here], node[here]
                out = found.setdefault(fold, np.zeros(size))
                for c in range(columns):
                    at = node * n_bins + bins[here, c]
                    for k, w in enumerate((g, h, None)):
                        out[:, c, :, k] += np.bincount(at, w, 2**level * n_bins).reshape(2**level, n_bins)
            yield from found.items()

        found = held.mapPartitions(work)
        if held.getNumPartitions() > MANY:
            found = found.map(lambda x: ((x[0], int(abs(x[1].flat[0]) * 1e6) % 8), x[1])).reduceByKey(np.add, 8 * len(active)).map(lambda x: (x[0][0], x[1]))
        out = {f: np.zeros(size) for f in active}
        for fold, x in found.collect():
            out[fold] += x
        return out

    for round_ in range(s.rounds):
        allowed = {f: np.isin(np.arange(columns), rng.permutation(columns)[: max(1, int(s.columns * columns))]) for f in active}
        now = {f: Tree.empty(s.depth) for f in active}
        totals: dict[int, dict[int, np.ndarray]] = {f: {} for f in active}
        levels: dict[int, list] = {f: [] for f in active}
        for level in range(s.depth):
            found = sums(round_, level, now)
            going = False
            for f in active:
                if level == 0:
                    totals[f][0] = found[f][0, 0].sum(0)
                gain, column, b, left = best_splits(found[f], s, single, allowed[f])
                levels[f].append((gain, column, b))
                for i in np.flatnonzero(gain > 0):
                    node = 2**level - 1 + i
                    now[f].column[node], now[f].bin[node] = column[i], b[i]
                    totals[f][2 * node + 1], totals[f][2 * node + 2] = left[i], totals[f][node] - left[i]
                    going = True
            if not going:
                break
        for f in active:
            tree = grown(levels[f], totals[f], s)
            fresh[f].append(tree)
            models[f].trees.append(tree)
        if (round_ + 1) % HOLD == 0 and round_ + 1 < s.rounds:
            held.unpersist()
            state = written(_with_scores(state, fresh, columns, single, s.depth), "blocks")
            held, fresh = _held(state, columns, enough), {f: [] for f in active}
    held.unpersist()
    return models


def _held(state: DataFrame, columns: int, tasks: int) -> RDD:
    """The blocks of ``state`` as arrays, kept by the executors: a pass is then a task's imperative work on arrays and no query.
    What an executor loses is read again from the table."""

    def arrays(rows: Iterator) -> Iterator[tuple]:
        for r in rows:
            get = lambda x, t: np.frombuffer(bytes(x), t)
            yield r["fold"], get(r["bins"], np.uint16).reshape(-1, columns), get(r["y"], np.uint8), get(r["id"], np.uint64), get(r["score"], np.float64)

    blocks = state.rdd
    return blocks.coalesce(max(1, min(tasks, blocks.getNumPartitions()))).mapPartitions(arrays).persist(StorageLevel.MEMORY_AND_DISK)


def _with_scores(state: DataFrame, fresh: dict[int, list[Tree]], columns: int, single: np.ndarray, depth: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for fold, bins, _, _, score in _arrays(batch, columns):
                f = score
                for t in fresh[fold]:
                    f = f + t.value[t.nodes(bins, single, depth)]
                scores.append(f.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(scores, pa.binary())], names=batch.schema.names)

    return state.mapInArrow(work, BLOCK)


def score(model: Model, df: DataFrame, numeric: list[str], category: str | None = None, settings: Settings = LEVELS) -> DataFrame:
    """``df`` with ``score``, the probability of the target."""
    if model.constant is not None:
        return df.withColumn("score", F.lit(model.constant))
    single = np.array([False] * len(numeric) + [True] * bool(category))
    shared = df.sparkSession.sparkContext.broadcast(model)
    n, depth = len(df.columns), settings.depth

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [batch.column(n + k).to_numpy(zero_copy_only=False) for k in range(len(numeric))]
            bins = shared.value.bins(numbers, batch.column(n + len(numeric)).to_pylist() if category else None)
            found = shared.value.scores(bins, single, depth)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found)], schema=pa.schema([*list(batch.schema)[:n], pa.field("score", pa.float64())]))

    fields = [F.col(c).cast("double").alias(f"_n{i}") for i, c in enumerate(numeric)] + ([F.col(category).cast("string").alias("_c")] if category else [])
    schema = df.withColumn("score", F.lit(0.0)).schema
    return df.select(*df.columns, *fields).mapInArrow(work, schema)
