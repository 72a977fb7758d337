"""Random forests over cells, the distinct rows of bins with their counts.

Spark counts the rows per cell; trees then grow from these counts, each in one task, many at the same
time. A bootstrap sample draws a Poisson number per cell and label, as it would for every row by itself.
Trees of one configuration that differ in depth or number are stages of one fit: a shallow tree is
the top of the deep one, and fewer trees are the first ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import decision_tree_sql
from plumbline.functions.ordered import column_quantiles
from plumbline.operators import batched

#: Trees of a task at most, and at least if there are enough tasks.
MOST_TREES, FEWEST_TREES = 100, 4
#: Combinations of bins and levels up to which a fitted forest keeps the score of each.
MOST_SCORES = 1 << 18
#: Cells of all trees that grow together.
CELLS_TOGETHER = 1 << 18


def subset_size(strategy: str, columns: int, trees: int) -> int:
    """Columns that a node may choose from, by the names and numbers that Spark takes."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt"
    named = {"all": columns, "onethird": np.ceil(columns / 3), "sqrt": np.ceil(np.sqrt(columns)),
             "log2": max(1, np.ceil(np.log2(columns)))}
    if strategy in named:
        return int(named[strategy])
    return min(int(strategy), columns) if re.fullmatch("[1-9][0-9]*", strategy) else int(np.ceil(float(strategy) * columns))


@dataclass
class ForestJob:
    """Forests of one configuration and split; ``stages`` maps (trees, depth) to a model name."""

    stages: dict[tuple[int, int], str]
    leaf: int
    strategy: str
    balanced: bool
    columns: list[tuple[int, int]]  # (feature, level) of the encoded columns; level -1: a number
    split: int
    repeat: int = 0
    fold: int = 0
    others: list[dict[tuple[int, int], str]] = field(default_factory=list)  # names of configurations that grow the same trees

    def weights(self, n: np.ndarray) -> tuple[float, float]:
        zero, one = (float(v) for v in n.sum(axis=0))
        return ((zero + one) / (2 * zero) if zero else 1.0, (zero + one) / (2 * one) if one else 1.0) if self.balanced else (1.0, 1.0)

    @property
    def depths(self) -> list[int]:
        return sorted({d for _, d in self.stages})

    @property
    def trees(self) -> list[int]:
        return sorted({n for n, _ in self.stages})


def grow(q: np.ndarray, sizes: Sequence[int], columns: Sequence[tuple[int, int]], n: np.ndarray, weights: tuple[float, float],
         subset: int, leaf: int, depths: Sequence[int], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(probability of label 1 per depth and cell, decrease of impurity per column) of one tree on counts ``n`` per cell and label."""
    out, gains = grow_together(q, sizes, columns, [n], weights, subset, leaf, depths, [rng])
    return out[0], gains[0]


def grow_together(q: np.ndarray, sizes: Sequence[int], columns: Sequence[tuple[int, int]], ns: Sequence[np.ndarray], weights: tuple[float, float],
                  subset: int, leaf: int, depths: Sequence[int], rngs: Sequence[np.random.Generator]) -> tuple[np.ndarray, np.ndarray]:
    """``grow`` for trees of one configuration, on counts and with a generator each: the nodes of a level of all trees are split at once.

    A column is a number, cut between any two bins, or a level against all others; levels of a feature are in order. Every node
    draws its columns. The split with the largest decrease of the weighted Gini impurity is taken that leaves ``leaf`` rows on
    both sides. Only bins that cells of a node have are weighed: a cut at any other one is the cut before it.
    """
    feature, ordered = np.array([f for f, _ in columns]), np.array([v < 0 for _, v in columns])
    by_feature = []
    for f in sorted(set(feature.tolist())):
        mine = np.flatnonzero(feature == f)
        column = np.full(sizes[f], mine[0] if ordered[mine[0]] else -1)  # the column that a bin or level stands for
        for c in mine[~ordered[mine]]:
            column[columns[c][1]] = c
        by_feature.append((f, mine, column))
    trees, size, (w0, w1), depths = len(ns), len(q), weights, np.array(depths)
    codes = np.ascontiguousarray(q.T, np.int32)
    flat, n0, n1 = codes.ravel(), np.stack([n[:, 0] for n in ns]).astype(float), np.stack([n[:, 1] for n in ns]).astype(float)
    a, b = n0.sum(axis=1), n1.sum(axis=1)
    # Both counts of a cell as one number, where sums of either are exact.
    one = float(1 << 26) if (a + b).max() < 1 << 26 else 0.0
    parts = [(n0 + n1 * one).ravel()] if one else [n0.ravel(), n1.ravel()]
    out, now, gains = np.zeros((len(depths), trees * size)), np.zeros(trees * size), np.zeros((trees, len(columns)))
    live, cell, node, tree = np.arange(trees * size), np.tile(np.arange(size), trees), np.repeat(np.arange(trees), size), np.arange(trees)
    more = (a + b >= 2 * leaf) & (a > 0) & (b > 0)
    if depths[-1] and not more.all():  # the trees that end at their root
        following = np.where(more, np.cumsum(more) - 1, -1)
        now[:] = ((w1 * b) / np.maximum(w0 * a + w1 * b, 1e-300))[node]
        kept = np.flatnonzero(more[node])
        live, cell, node, parts, a, b, tree = live[kept], cell[kept], following[node[kept]], [w[kept] for w in parts], a[more], b[more], tree[more]
    for depth in range(depths[-1] + 1):
        # ``a`` and ``b`` hold the rows of the nodes to be split, in which the cells ``live`` lie.
        wa, wb = w0 * a, w1 * b
        value = wb / np.maximum(wa + wb, 1e-300)
        if (depths == depth).any():
            now[live] = value[node]
            out[depths == depth] = now
        if depth == depths[-1] or not len(a):
            out[depths > depth] = now
            break
        parent = (wa * wa + wb * wb) / (wa + wb)
        best, taken, cut = parent * (1 + 1e-12) + 1e-12, np.full(len(a), -1), np.zeros(len(a), np.int64)
        a_side, b_side, allowed = np.zeros(len(a)), np.zeros(len(a)), None
        if subset < len(columns):
            each = np.bincount(tree, minlength=trees)
            allowed = _drawn(np.concatenate([r.random((k, len(columns)), np.float32) for r, k in zip(rngs, each.tolist()) if k]), subset)
        for f, mine, column in by_feature:
            some, cells, place, counts, bins = None, cell, node, parts, sizes[f]
            if allowed is not None:
                usable = reduce(np.logical_or, allowed[mine])
                wide = np.count_nonzero(usable)
                if not wide:
                    continue
                if wide < 0.6 * len(a):  # else the others are left out of the sums
                    some = np.flatnonzero(usable)
                    at = np.full(len(a), -1)
                    at[some] = np.arange(wide)
                    place = at[node]
                    here = np.flatnonzero(place >= 0)
                    place, cells, counts = place[here], cell[here], [w[here] for w in parts]
            key, la, lb = _sums(place * bins + codes[f][cells], counts, one, (len(a) if some is None else len(some)) * bins)
            if not len(key):
                continue
            where = key // bins
            code = key - where * bins
            if some is not None:
                where = some[where]
            if ordered[mine[0]]:
                # Sums up to a bin: those over all nodes, less what lies before the node.
                la, lb = np.cumsum(la), np.cumsum(lb)
                first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
                length = np.diff(first, append=len(where))
                la -= np.repeat(np.concatenate([[0.0], la[first[1:] - 1]]), length)
                lb -= np.repeat(np.concatenate([[0.0], lb[first[1:] - 1]]), length)
                fits = code < bins - 1
            else:
                fits = column[code] >= 0
            if allowed is not None and (some is None or len(mine) > 1):
                fits &= allowed[column[code], where]
            rows = la + lb
            fits &= (rows >= leaf) & ((a + b)[where] - rows >= leaf)
            fits = np.flatnonzero(fits)
            if not len(fits):
                continue
            where, code, la0, lb0 = where[fits], code[fits], la[fits], lb[fits]
            la, lb, wa_, wb_ = w0 * la0, w1 * lb0, wa[where], wb[where]
            side = la + lb
            with np.errstate(divide="ignore", invalid="ignore"):
                strength = (la * la + lb * lb) / side + ((wa_ - la) ** 2 + (wb_ - lb) ** 2) / (wa_ + wb_ - side)
            # The first of the strongest cuts of every node.
            first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            top = np.maximum.reduceat(strength, first)
            top[~(top > best[where[first]])] = np.inf
            equal = np.flatnonzero(strength == np.repeat(top, np.diff(first, append=len(where))))
            if len(equal):
                equal = equal[np.concatenate([[True], where[equal[1:]] != where[equal[:-1]]])]
                won = where[equal]
                best[won], taken[won], cut[won], a_side[won], b_side[won] = strength[equal], column[code[equal]], code[equal], la0[equal], lb0[equal]
        split = taken >= 0
        np.add.at(gains, (tree[split], taken[split]), (best - parent)[split])
        # Two places per node: rows up to the cut and above it, or of other levels and of the level; without a split the first one.
        level = split & ~ordered[taken]
        low, span = np.where(level, cut, cut + 1), np.where(level, 0, np.where(split, 1 << 20, -1))
        code = flat[(feature[taken] * size)[node] + cell] - low[node]
        slot = 2 * node + ((code >= 0) & (code <= span[node]))
        a, b = ([np.where(level, x - y, np.where(split, y, x)), np.where(level, y, x - y)] for x, y in ((a, a_side), (b, b_side)))
        a, b = np.stack(a, axis=1).ravel(), np.stack(b, axis=1).ravel()
        children = np.repeat(split, 2)
        final = np.where(children, (w1 * b) / np.maximum(w0 * a + w1 * b, 1e-300), np.repeat(value, 2))
        more = np.flatnonzero(children & (a + b >= 2 * leaf) & (a > 0) & (b > 0))
        following = np.full(len(children), -1)
        following[more] = np.arange(len(more))
        # A cell by itself can't be split, so it has its score; its node only takes part in the draws.
        following[np.bincount(slot, minlength=len(following)) == 1] = -1
        node = following[slot]
        gone, kept = np.flatnonzero(node < 0), np.flatnonzero(node >= 0)
        now[live[gone]] = final[slot[gone]]
        live, cell, node, parts, a, b, tree = live[kept], cell[kept], node[kept], [w[kept] for w in parts], a[more], b[more], tree[more // 2]
    return out.reshape(len(depths), trees, size).swapaxes(0, 1), gains


def _drawn(numbers: np.ndarray, subset: int) -> np.ndarray:
    """Per column whether it is among the ``subset`` least numbers of a node, from random numbers per node and column."""
    nodes, columns = numbers.shape
    if nodes < 512 or columns > 16:
        at = numbers.argpartition(subset - 1, axis=1)[:, :subset]
        out = np.zeros((columns, nodes), bool)
        out[at, np.arange(nodes)[:, None]] = True
        return out
    by_column, rank = np.ascontiguousarray(numbers.T), np.zeros((columns, nodes), np.int8)
    for i in range(columns):
        less = by_column[i] < by_column[i + 1:]
        rank[i + 1:] += less
        rank[i] += (columns - 1 - i) - less.sum(axis=0, dtype=np.int8)
    return rank < subset


def _sums(key: np.ndarray, counts: Sequence[np.ndarray], one: float, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys in order, at least those that have rows, and their counts per label."""
    found = [np.bincount(key, w, size) for w in counts]
    if size > 2 * len(key):
        at = np.sort(key)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    else:
        at = np.flatnonzero(found[0] != 0 if one else found[0] + found[1] != 0)
    if not one:
        return at, found[0][at], found[1][at]
    whole = found[0][at]
    second = np.floor(whole * (1 / one))
    return at, whole - second * one, second


def _chunks(jobs: Sequence[ForestJob], cores: int) -> list[tuple[int, int, int]]:
    """(job, first, end) of the trees of every task; none goes over a number of trees at which a forest is scored."""
    size = min(MOST_TREES, max(FEWEST_TREES, sum(j.trees[-1] for j in jobs) // (4 * cores)))
    return [(i, t, min(t + size, high)) for i, j in enumerate(jobs) for low, high in zip([0, *j.trees], j.trees) for t in range(low, high, size)]


def _grown(sc, q: np.ndarray, sizes: Sequence[int], fills: np.ndarray, n: np.ndarray, jobs: Sequence[ForestJob], seed: int):
    """RDD of (job, (end, sums of the probabilities per depth and cell, sums of the shares of the columns)) per task."""
    sent = sc.broadcast((q, tuple(sizes), fills, n, list(jobs)))

    def run(chunk: tuple[int, int, int]) -> tuple[int, tuple]:
        number, first, end = chunk
        q, sizes, fills, n, jobs = sent.value
        job = jobs[number]
        codes = np.where(q < 0, fills[job.split], q)
        train = n[:, job.split]
        weights, subset = job.weights(train), subset_size(job.strategy, len(job.columns), job.trees[-1])
        total, shares = 0.0, np.zeros(len(job.columns))
        together = max(1, CELLS_TOGETHER // max(len(codes), 1))
        for low in range(first, end, together):
            rngs = [np.random.default_rng((seed, job.repeat, job.fold, t)) for t in range(low, min(low + together, end))]
            for p, gains in zip(*grow_together(codes, sizes, job.columns, [rng.poisson(train) for rng in rngs], weights, subset, job.leaf, job.depths, rngs)):
                total = total + p
                shares += gains / gains.sum() if gains.sum() > 0 else 0.0
        return number, (end, total, shares)

    chunks = _chunks(jobs, sc.defaultParallelism)
    order = np.random.default_rng(seed).permutation(len(chunks))  # long and short ones side by side
    return sc.parallelize([chunks[i] for i in order], len(chunks)).map(run)


def _mean(parts: Sequence[tuple], trees: int) -> np.ndarray:
    return sum(p for end, p, _ in sorted(parts, key=lambda x: x[0]) if end <= trees) / trees


def rank_forests(e: batched.Encoded, wanted: Sequence[tuple[dict, int, str, bool]], seed: int = 42) -> DataFrame | None:
    """(model, split, roc_auc, pr_auc) on the held-out rows of all splits, from counts of cells; None if there are too many.

    ``wanted`` has (stages, leaf, strategy, balanced) per configuration, see ``ForestJob``.
    """
    table = batched.cell_table(e)
    if table is None:
        return None
    q, whole, held, fills = table
    sc, k, splits = e.rows.sparkSession.sparkContext, len({f for _, f in e.splits}), list(e.splits.values())
    sizes, nums = batched._sizes(e, batched._edges(e)), len(e.nums)
    # Names of two subset sizes may mean the same number of columns; such forests are the same ones, tree by tree.
    known: dict[tuple, ForestJob] = {}
    for stages, leaf, strategy, balanced in wanted:
        for i, s in enumerate(splits):
            columns = [(f, -1) for f in range(nums)] + [(nums + f, int(v)) for f, c in enumerate(e.cats) for v in np.flatnonzero(s.levels[c])]
            job = ForestJob(stages, leaf, strategy, balanced, columns, i, s.repeat, s.fold)
            first = known.setdefault((i, leaf, subset_size(strategy, len(columns), job.trees[-1]), balanced, tuple(sorted(stages))), job)
            if first is not job:
                first.others.append(stages)
    jobs = list(known.values())
    tested = sc.broadcast(held)

    def scored(item: tuple[int, list]) -> Iterator[tuple]:
        job, found = jobs[item[0]], list(item[1])
        counts = tested.value[:, job.split]
        here = counts.any(axis=1)
        for trees, depth in job.stages:
            ranks = batched.ranked(_mean(found, trees)[job.depths.index(depth)][here], counts[here])
            for stages in (job.stages, *job.others):
                yield stages[trees, depth], job.repeat * k + job.fold, *ranks

    grown = _grown(sc, q, sizes, fills, whole[:, None] - held, jobs, seed)
    found = grown.groupByKey(max(sc.defaultParallelism, len(jobs) // 4)).flatMap(scored).collect()  # a row per model and split
    return e.rows.sparkSession.createDataFrame(found, "model string, split int, roc_auc double, pr_auc double")


class RandomForestClassificationModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted forest as its score for every combination of bins and levels."""

    places = Param(Params._dummy(), "places", "columns with the number of the bin or level", TypeConverters.toListString)
    sizes = Param(Params._dummy(), "sizes", "numbers that each of these columns may hold", TypeConverters.toListInt)
    scores = Param(Params._dummy(), "scores", "probability of label 1 per combination, the last column runs fastest", TypeConverters.toListFloat)
    importances = Param(Params._dummy(), "importances", "share of the decrease of impurity per encoded column", TypeConverters.toListFloat)
    numTrees = Param(Params._dummy(), "numTrees", "trees of the forest", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, places=None, sizes=None, scores=None, importances=None, numTrees=None) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    @property
    def numFeatures(self) -> int:
        return len(self.getOrDefault(self.importances))

    @property
    def featureImportances(self):
        return Vectors.dense(self.getOrDefault(self.importances))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        table = np.array(self.getOrDefault(self.scores))
        at = F.lit(0).cast("long")
        for c, size in zip(self.getOrDefault(self.places), self.getOrDefault(self.sizes)):
            at = at * F.lit(size) + F.col(f"`{c}`").cast("long")

        def look(places: pd.Series) -> pd.Series:
            return pd.Series(table[places.to_numpy()])

        p = F.pandas_udf(look, "double")(at)
        return dataset.withColumn("__score", p).withColumn("probability", array_to_vector(F.array(F.lit(1.0) - F.col("__score"), F.col("__score")))).withColumn(
            "prediction", (F.col("__score") > 0.5).cast("double")).drop("__score")


def _binned(prep: PipelineModel, rows: DataFrame, nums: Sequence[str], cats: Sequence[str]) -> tuple[list, list, list[str], list[int]]:
    """Stages up to bins and levels, the stages after them, the columns with bins or levels and how many there are of each."""
    head = [s for s in prep.stages if not isinstance(s, VectorAssembler)]
    hot = [s for s in head[2:]] if cats else []
    head = head[:2] if cats else head
    places, sizes = [], []
    if nums:
        names = [f"{c}__num" for c in nums]
        found = {r["feature"]: r["q"] for r in column_quantiles(
            PipelineModel(head[:1]).transform(rows), names, [b / batched.BINS for b in range(1, batched.BINS)]).collect()}
        # A bin holds its lower edge.
        edges = [sorted({float(v) for v in found[c]}) for c in names]
        places = [f"{c}__bin" for c in nums]
        sizes = [len(e) + 1 for e in edges]
        bins = ", ".join(f"double({decision_tree_sql(c, e)}) AS `{b}`" for c, e, b in zip(names, edges, places))
        head.append(SQLTransformer(statement=f"SELECT *, {bins} FROM __THIS__"))
    if cats:
        labels = next(s for s in head if isinstance(s, StringIndexerModel)).labelsArray
        places = [*places, *[f"{c}__index" for c in cats]]
        sizes += [len(v) + 1 for v in labels]
    columns = [f"{c}__bin" for c in nums] + [f"{c}__hot" for c in cats]
    return head, [*hot, VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")], places, sizes


def fit_on_cells(prep: PipelineModel, rows: DataFrame, nums: Sequence[str], cats: Sequence[str], family: str, params: dict,
                 balanced: bool, total: int, seed: int) -> PipelineModel | None:
    """A forest, or Spark's boosted trees with the counts as weights, fitted on the cells of labelled rows.

    None if there are too many cells or combinations, or parameters it does not know.
    """
    head, tail, places, sizes = _binned(prep, rows, nums, cats)
    cells = PipelineModel(head).transform(rows).groupBy(*[f"`{c}`" for c in places], "y").agg(F.count(F.lit(1)).cast("double").alias("__n"))
    if family == "gbt":
        after = PipelineModel(tail).transform(cells)
        leaf = params.get("minInstancesPerNode", 1)
        known = {k: v for k, v in params.items() if k != "minInstancesPerNode"}
        # A node holds so many rows if its weight is above half a row less.
        model = GBTClassifier(featuresCol="features", labelCol="y", weightCol="__n", seed=seed, minInstancesPerNode=1,
                              minWeightFractionPerNode=min((leaf - 0.5) / max(total, 1), 0.49), **known).fit(after)
        return PipelineModel([*head, *tail, _as_fitted_on_rows(model, leaf)])
    if int(np.prod(np.array(sizes, float))) > MOST_SCORES:
        return None
    q = np.indices(sizes).reshape(len(sizes), -1).T.astype(np.int16)
    n = np.zeros((len(q), 1, 2))
    for r in cells.collect():  # at most two rows per combination
        n[np.ravel_multi_index([int(r[c]) for c in places], sizes), 0, int(r["y"] > 0.5)] += r["__n"]
    # The last number of a level stands for unseen ones, which are no column.
    columns = [(i, -1) for i in range(len(nums))] + [(i, v) for i in range(len(nums), len(sizes)) for v in range(sizes[i] - 1)]
    trees, depth = params.get("numTrees", 20), params.get("maxDepth", 5)
    job = ForestJob({(trees, depth): "forest"}, params.get("minInstancesPerNode", 1), params.get("featureSubsetStrategy", "sqrt"), balanced, columns, 0)
    parts = [x for _, x in _grown(rows.sparkSession.sparkContext, q, sizes, np.zeros((1, len(sizes)), np.int16), n, [job], seed).collect()]
    shares = sum(s for _, _, s in parts)
    model = RandomForestClassificationModel(
        places=places, sizes=[int(s) for s in sizes], scores=_mean(parts, trees)[0].tolist(),
        importances=(shares / shares.sum() if shares.sum() > 0 else shares).tolist(), numTrees=trees)
    return PipelineModel([*head, *tail, model])


def _as_fitted_on_rows(model: GBTClassificationModel, leaf: int) -> GBTClassificationModel:
    """The model names the least rows of a leaf, not the share of the weight that stands for it."""
    model.clear(model.weightCol)
    model.clear(model.minWeightFractionPerNode)
    model._set(minInstancesPerNode=leaf)
    return model
