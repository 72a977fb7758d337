"""Many models over many folds, one pass over the rows per step of all of them.

A row carries the fold it belongs to in every repeat, so no split copies it: a model of a split
skips the rows of its fold. Logistic models of all candidates and splits take Newton steps together;
one job sums their gradients and Hessians. Boosted trees of all candidates and splits grow
together over the distinct rows of bins, each with its counts; one job per level sums their histograms,
and candidates that differ only in the number of iterations are one fit, scored at several stages. Preparation (fills, scaling, levels) is learned per
split from sums over folds, total minus fold, and folded into the models.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import number, quoted, require_columns
from plumbline.functions.ordered import column_quantiles
from plumbline.session import forget, materialize

#: Encoded columns up to which a Hessian is formed, steps a Newton fit may take, gradient at which it ends.
MOST_COLUMNS, STEPS, TOLERANCE = 256, 60, 1e-9
#: Bins of a number, models whose histograms are counted at once, cells of a block, iterations between lineage cuts.
BINS, BLOCK, ROWS, CUT = 32, 32, 4096, 25
#: Rows of a block at most, and cells of all blocks together up to which the scores of a model meet in one task.
BLOCK_ROWS, MOST_CELLS = 1 << 18, 1 << 17
#: Doubles that the models of one batch may send per task.
BATCH_CELLS = 8 << 20
#: Bytes of the counts of samples that are sent at once.
DRAWN_BYTES = 64 << 20
#: Doubles of all tasks together that are added up on the driver; more are added up by a shuffle.
DRIVER_CELLS = 4 << 20
#: Scores that are sent at once to be ranked, that meet in one group, and that a task gathers before it sends them.
SCORES_AT_ONCE, SCORES_TOGETHER, SCORES_HELD = 1 << 27, 1 << 21, 1 << 22
#: Scores per row that may be sent at once, if these are more: a table is read twice per batch, however large it is.
SCORES_PER_ROW = 16
#: Bits that the first buckets of scores leave out (256 buckets an octave are left), and that a refinement adds.
SCORE_BITS, MORE_SCORE_BITS = 44, 11


@dataclass
class Split:
    """What the training rows of one split teach: per number (fill, mean, std), per category its mode and levels."""

    repeat: int
    fold: int
    n: int = 0
    positives: float = 0.0
    numbers: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    modes: dict[str, int] = field(default_factory=dict)
    levels: dict[str, np.ndarray] = field(default_factory=dict)


@dataclass
class Encoded:
    """Rows (ids, y, x, c, folds) and what is known of every split."""

    rows: DataFrame
    ids: list[str]
    nums: list[str]
    cats: list[str]
    levels: dict[str, list[str]]
    splits: dict[tuple[int, int], Split]
    kept: dict[str, Any] = field(default_factory=dict)  # edges of the bins and the table of cells, once they are known

    @property
    def width(self) -> int:
        return 1 + 2 * len(self.nums) + sum(len(v) + 1 for v in self.levels.values())

    def places(self) -> dict[str, int]:
        """First base column of every feature: a number and its gap, or the levels of a category and its gap."""
        out, at = {}, 1
        for c in self.nums:
            out[c], at = at, at + 2
        for c in self.cats:
            out[c], at = at, at + len(self.levels[c]) + 1
        return out


def fold_arrays(df: DataFrame, ids: Sequence[str], columns: Sequence[str], label: str) -> DataFrame:
    """One row per key with ``folds``, its fold per repeat, from one row per (key, repeat)."""
    if "folds" in df.columns:
        return df.select(*[quoted(c) for c in ids], *[quoted(c) for c in columns], quoted(label).alias(label), "folds")
    same = [F.first(quoted(c)).alias(c) for c in [*columns, label]]
    pairs = F.array_sort(F.collect_list(F.struct("repeat", "fold")))
    return df.groupBy(*[quoted(c) for c in ids]).agg(*same, pairs.alias("__folds")).withColumn(
        "folds", F.transform("__folds", lambda p: p["fold"])).drop("__folds")


def encode(df: DataFrame, nums: Sequence[str], cats: Sequence[str], ids: Sequence[str], label: str = "y") -> Encoded | None:
    """Rows as numbers, kept for all passes; None if there are too many levels for dense models."""
    require_columns(df, [*nums, *cats])
    wide = fold_arrays(df, ids, [*nums, *cats], label).filter(quoted(label).isNotNull())
    # Levels are read from the rows as they came, which costs no shuffle of all columns; one that no key keeps has no rows.
    seen = df.filter(quoted(label).isNotNull()).select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), quoted(c).cast("string").alias("v")) for i, c in enumerate(cats)])).alias("__one")).select(
        "__one.*").filter("v IS NOT NULL").distinct().limit((MOST_COLUMNS + 1) * len(cats)).collect() if cats else []
    levels = {c: sorted(r["v"] for r in seen if r["i"] == i) for i, c in enumerate(cats)}
    if any(len(v) > MOST_COLUMNS for v in levels.values()):  # at least one has that many if the limit was met
        return None

    def place(c: str):
        if not levels[c]:
            return F.lit(-1)
        known = F.create_map(*[x for i, v in enumerate(levels[c]) for x in (F.lit(v), F.lit(i))])
        return F.coalesce(F.try_element_at(known, quoted(c).cast("string")), F.lit(-1))

    tasks = max(wide.sparkSession.sparkContext.defaultParallelism, int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = materialize(wide.select(
        *[quoted(c) for c in ids], quoted(label).cast("double").alias("y"),
        F.array(*[F.coalesce(number(c), F.lit(float("nan"))) for c in nums]).cast("array<double>").alias("x"),
        F.array(*[place(c) for c in cats]).cast("array<int>").alias("c"), F.col("folds").cast("array<int>").alias("folds")).repartition(tasks))
    out = Encoded(rows, list(ids), list(nums), list(cats), levels, {})
    if out.width > MOST_COLUMNS:
        return None
    _learn_splits(out)
    return out


def _learn_splits(e: Encoded, extra: int | None = None) -> None:
    """Fill ``splits``, also of a fold ``extra`` without rows, from sums per (repeat, fold); only columns with gaps need a second job for medians."""
    each = e.rows.select("*", F.posexplode("folds").alias("repeat", "fold"))
    known = [F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]) for i in range(len(e.nums))]
    sums = each.groupBy("repeat", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"),
        *[f(x).alias(f"{n}{i}") for i, x in enumerate(known) for n, f in (("k", F.count), ("m", F.avg), ("v", F.var_pop))]).collect()
    counts = (each.select("repeat", "fold", F.posexplode("c").alias("cat", "level"))
              .groupBy("repeat", "fold", "cat", "level").agg(F.count(F.lit(1)).alias("n")).collect() if e.cats else [])
    per = {(r["repeat"], r["fold"]): r for r in sums}
    tables: dict[tuple[int, int], dict[int, np.ndarray]] = {}
    for r in counts:
        cells = tables.setdefault((r["repeat"], r["fold"]), {})
        c = e.cats[r["cat"]]
        cells.setdefault(r["cat"], np.zeros(len(e.levels[c]) + 1, np.int64))[r["level"]] += r["n"]
    gaps = [i for i in range(len(e.nums)) if any(r[f"k{i}"] < r["n"] for r in sums)]
    medians: dict[tuple[int, int, int], float] = {}
    if gaps:
        folds = sorted({f for _, f in per} | ({extra} if extra is not None else set()))
        train = each.select(F.explode(F.array(*[F.lit(f) for f in folds])).alias("held"), "repeat", "fold",
                            *[F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]).alias(f"g{i}") for i in gaps]).filter("held <> fold")
        for r in column_quantiles(train, [f"g{i}" for i in gaps], [0.5], ["repeat", "held"]).collect():
            medians[r["repeat"], r["held"], int(r["feature"][1:])] = r["q"][0]
    for repeat, fold in [*per, *([] if extra is None else [(0, extra)])]:
        others = [r for (a, f), r in per.items() if a == repeat and f != fold]
        s = Split(repeat, fold, sum(r["n"] for r in others), sum(r["p"] for r in others))
        for i, c in enumerate(e.nums):
            k, mean, m2 = 0, 0.0, 0.0
            for r in others:
                if r[f"k{i}"]:
                    total = k + r[f"k{i}"]
                    step = r[f"m{i}"] - mean
                    m2 += r[f"v{i}"] * r[f"k{i}"] + step * step * k * r[f"k{i}"] / total
                    mean, k = mean + step * r[f"k{i}"] / total, total
            fill = medians.get((repeat, fold, i), 0.0)
            # Moments after imputation: known values and a block of equal fills.
            share = k / s.n if s.n else 0.0
            both = share * mean + (1 - share) * fill
            var = (m2 / s.n if s.n else 0.0) + share * (mean - both) ** 2 + (1 - share) * (fill - both) ** 2
            s.numbers[c] = (fill, both, var ** 0.5 if var > 0 else 1.0)
        for j, c in enumerate(e.cats):
            seen = sum((tables.get((repeat, f), {}).get(j, np.zeros(len(e.levels[c]) + 1, np.int64))
                        for a, f in per if a == repeat and f != fold), np.zeros(len(e.levels[c]) + 1, np.int64))[:-1]
            s.modes[c] = int(seen.argmax()) if len(seen) else -1
            s.levels[c] = seen > 0
        e.splits[repeat, fold] = s


def whole_split(e: Encoded) -> Split:
    """The split whose training rows are all rows: a fold of the first repeat that no row is in."""
    table = Encoded(e.rows.withColumn("folds", F.array(F.lit(1))), e.ids, e.nums, e.cats, e.levels, {})
    _learn_splits(table, extra=0)
    return table.splits[0, 0]


def _arrays(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _base(batch: pa.RecordBatch, sizes: Sequence[int]) -> np.ndarray:
    """The design matrix that all models share: one, each number and its gap, each level and the gap of each category."""
    x, c = _arrays(batch, "x"), _arrays(batch, "c")
    gap = np.isnan(x)
    parts = [np.ones((batch.num_rows, 1))]
    if x.shape[1]:
        parts.append(np.stack([np.where(gap, 0.0, x), gap], axis=2).reshape(batch.num_rows, -1))
    for j, size in enumerate(sizes):
        hot = np.zeros((batch.num_rows, size + 1))
        hot[np.arange(batch.num_rows), np.where(c[:, j] < 0, size, c[:, j])] = 1.0
        parts.append(hot)
    return np.concatenate(parts, axis=1)


def _design(e: Encoded, split: Split, nums: Sequence[str], cats: Sequence[str], scaled: bool) -> tuple[np.ndarray, list[tuple[str, str]]]:
    """Rows: the encoded columns of a model of this split in terms of the base columns; and their (name, source)."""
    at, rows, names = e.places(), [], [("", "")]
    first = np.zeros(e.width)
    first[0] = 1.0
    rows.append(first)
    for c in nums:
        fill, mean, std = split.numbers[c]
        mean, std = (mean, std) if scaled else (0.0, 1.0)
        row = np.zeros(e.width)
        row[[0, at[c], at[c] + 1]] = -mean / std, 1 / std, fill / std
        rows.append(row)
        names.append((c, c))
    for c in cats:
        for i in np.flatnonzero(split.levels[c]):
            row = np.zeros(e.width)
            row[at[c] + i] = 1.0
            if i == split.modes[c]:
                row[at[c] + len(e.levels[c])] = 1.0
            rows.append(row)
            names.append((f"{c}={e.levels[c][i]}", c))
    return np.array(rows), names


@dataclass
class LogisticJob:
    """One penalised logistic model of one split."""

    name: str
    split: Split
    nums: Sequence[str]
    cats: Sequence[str]
    C: float
    balanced: bool
    scaled: bool = True
    beta: np.ndarray | None = None  # over encoded columns, intercept first
    base: np.ndarray | None = None  # the same model over base columns
    names: list[tuple[str, str]] = field(default_factory=list)
    residual: float = float("inf")  # largest entry of the gradient of the penalised loss, per training row
    steps: int = 0

    def weights(self) -> tuple[float, float]:
        n, p = self.split.n, self.split.positives
        return ((n / (2 * (n - p)) if n > p else 1.0), (n / (2 * p) if p else 1.0)) if self.balanced else (1.0, 1.0)


def fit_logistic(e: Encoded, jobs: Sequence[LogisticJob]) -> None:
    """Newton's method for all jobs at once; each iteration is one job over the rows.

    The loss is the weighted sum of log-losses plus half the squared coefficients (not the intercept)
    over C. A step that doesn't lower a model's loss is halved.
    """
    per_model = 1 + e.width + e.width * (e.width + 1) // 2
    at_once = max(1, BATCH_CELLS // per_model)
    for i in range(0, len(jobs), at_once):
        _newton(e, jobs[i:i + at_once])


def _newton(e: Encoded, jobs: Sequence[LogisticJob]) -> None:
    designs = []
    for j in jobs:
        t, j.names = _design(e, j.split, j.nums, j.cats, j.scaled)
        designs.append(t)
    state = [{"beta": np.zeros(len(t)), "at": None, "loss": np.inf, "move": np.zeros(len(t))} for t in designs]
    live = list(range(len(jobs)))
    for _ in range(STEPS):
        if not live:
            break
        trial = [state[m]["beta"] + state[m]["move"] for m in live]
        sums = _newton_sums(e, [jobs[m] for m in live], np.array([t @ designs[m] for t, m in zip(trial, live)]).T)
        left = []
        for k, m in enumerate(live):
            job, s, t = jobs[m], state[m], designs[m]
            penalty = np.full(len(t), 1.0 / job.C)
            penalty[0] = 0.0
            loss = sums[k][0] + 0.5 * penalty @ trial[k] ** 2
            if loss > s["loss"] + 1e-12 * abs(s["loss"]):
                s["move"] *= 0.5
                if np.abs(s["move"]).max() > 1e-14:
                    left.append(m)
                continue
            gradient = t @ sums[k][1:1 + e.width] + penalty * trial[k]
            hessian = np.zeros((e.width, e.width))
            hessian[np.triu_indices(e.width)] = sums[k][1 + e.width:]
            hessian = hessian + np.triu(hessian, 1).T
            job.residual, job.steps = float(np.abs(gradient).max()) / max(job.split.n, 1), job.steps + 1
            s["beta"], s["loss"] = trial[k], loss
            s["move"] = -np.linalg.lstsq(t @ hessian @ t.T + np.diag(penalty), gradient, rcond=None)[0]
            if job.residual > TOLERANCE:
                left.append(m)
        live = left
    for m, job in enumerate(jobs):
        job.beta, job.base = state[m]["beta"], state[m]["beta"] @ designs[m]


def _newton_sums(e: Encoded, jobs: Sequence[LogisticJob], betas: np.ndarray) -> list[np.ndarray]:
    """Per job (loss, gradient, upper Hessian) over base columns, summed over its training rows."""
    sizes, width = [len(e.levels[c]) for c in e.cats], e.width
    repeats, folds = np.array([j.split.repeat for j in jobs]), np.array([j.split.fold for j in jobs])
    low, high = np.array([j.weights() for j in jobs]).T
    upper = np.triu_indices(width)
    sums_size = len(jobs) * (1 + width + len(upper[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(jobs), 1 + width + len(upper[0])))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                base, y = _base(part, sizes), part.column("y").to_numpy(zero_copy_only=False)[:, None]
                eta = base @ betas
                small = np.exp(-np.abs(eta))  # one exponential for the probability and the loss
                p = np.where(eta >= 0, 1.0, small) / (1 + small)
                w = np.where(y > 0.5, high, low) * (_arrays(part, "folds")[:, repeats] != folds)
                sums[:, 0] += (w * (np.log1p(small) + np.maximum(eta, 0.0) - y * eta)).sum(axis=0)
                sums[:, 1:1 + width] += (base.T @ (w * (p - y))).T
                sums[:, 1 + width:] += ((base[:, upper[0]] * base[:, upper[1]]).T @ (w * p * (1 - p))).T
        yield _blobs(range(len(jobs)), sums)

    total = e.rows.select("y", "x", "c", "folds").mapInArrow(run, "m int, v binary").repartition(_tasks(sums_size), "m").mapInArrow(_add, "m int, v binary")
    out = [np.zeros(1 + width + len(upper[0]))] * len(jobs)
    for r in total.collect():  # a vector per model
        out[r["m"]] = np.frombuffer(r["v"])
    return out


def _tasks(cells: int) -> int:
    """Tasks that add up vectors of this many doubles in all."""
    return 1 + cells // (1 << 18)


def _blobs(numbers: Sequence[int], values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.int32()), pa.array([v.tobytes() for v in values], pa.binary())], ["m", "v"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the vectors of every model."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for m, v in zip(batch.column("m").to_pylist(), batch.column("v").to_pylist()):
            held[m] = held[m] + np.frombuffer(v) if m in held else np.frombuffer(v)
    if held:
        yield _blobs(list(held), list(held.values()))


def predict_logistic(e: Encoded, jobs: Sequence[LogisticJob], held: bool = True) -> DataFrame:
    """(ids, y, p, model, repeat, fold, split) of every job on its held-out rows, or on its training rows."""
    sizes = [len(e.levels[c]) for c in e.cats]
    betas = np.array([j.base for j in jobs]).T
    return _predictions(e, e.rows, [(j.name, j.split) for j in jobs], lambda batch: _base(batch, sizes) @ betas, held)


def rank_logistic(e: Encoded, jobs: Sequence[LogisticJob], held: bool = True) -> DataFrame:
    """(model, split, roc_auc, pr_auc) of every job on its held-out rows, or on its training rows: the metrics of ``predict_logistic``.

    No prediction is kept: scores are worked out again where they are needed. Where a model has more than ``SCORES_TOGETHER``
    of them, they are counted in buckets first, and neighbouring buckets make a range. The scores of a range meet in one group
    as sorted numbers; what lies below it is known from the counts. Models go in batches, so what is sent at once is bounded,
    and the shuffle files of a batch are removed before the next one.
    """
    spark, k = e.rows.sparkSession, len({f for _, f in e.splits})
    keys: dict[tuple[str, int], list[LogisticJob]] = {}
    for j in jobs:
        keys.setdefault((j.name, j.split.repeat * k + j.split.fold), []).append(j)
    rows = e.rows.count()
    sizes = [sum(rows - j.split.n if held else j.split.n for j in same) for same in keys.values()]
    starts = [0]
    for i in range(len(sizes)):
        if sum(sizes[starts[-1]:i + 1]) > max(SCORES_AT_ONCE, SCORES_PER_ROW * rows) and i > starts[-1]:
            starts.append(i)
    names, found = list(keys), []
    for low, high in zip(starts, [*starts[1:], len(sizes)]):
        some = [(n - low, j) for n in range(low, high) for j in keys[names[n]]]
        scores = _score_codes(e, some, held, SCORES_HELD)
        found += [(*names[low + n], *m) for n, m in _ranked_together(e.rows.select("y", "x", "c", "folds"), scores, sizes[low:high])]
        if high < len(sizes):
            forget(spark)
    return spark.createDataFrame(found, "model string, split int, roc_auc double, pr_auc double")


def rank_scores(pred: DataFrame, sizes: Sequence[int]) -> dict[int, tuple]:
    """(ROC-AUC, average precision) per number of a written table (n, y, p), with at most so many rows per number as ``sizes`` says.

    Labels are 0 or 1 and scores not negative; rows without a label or score are left out.
    """
    most = SCORES_HELD

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
        held, size = [], 0

        def flush() -> Iterator[tuple[int, list[np.ndarray]]]:
            n, y, codes = (np.concatenate(parts) for parts in zip(*held))
            order = np.argsort(2 * n + y, kind="stable")
            places, codes = (2 * n + y)[order], codes[order]
            for i in np.unique(n).tolist():
                a, b, c = np.searchsorted(places, [2 * i, 2 * i + 1, 2 * i + 2])
                yield i, [codes[a:b], codes[b:c]]

        for batch in batches:
            n, y, p = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "y", "p"))
            held.append((n.astype(np.int64), y == 1, (p + 0.0).view(np.uint64)))
            size += batch.num_rows
            if size >= most:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    rows = pred.select(F.col("n").cast("int").alias("n"), F.col("y").cast("int").alias("y"), number("p").alias("p")).dropna()
    return dict(_ranked_together(rows, scores, sizes))


def _ranked_together(rows: DataFrame, scores: Callable, sizes: Sequence[int]) -> list[tuple[int, tuple]]:
    """(number, (ROC-AUC, average precision)) per number that has scores; ``scores`` makes (number, codes per label) of batches of rows."""
    large = [n for n, size in enumerate(sizes) if size > SCORES_TOGETHER]
    ranges = _score_ranges(rows, scores, large) if large else {}
    cuts = {n: r[0] for n, r in ranges.items()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, labels in scores(batches):
            parts = [np.split(c, np.searchsorted(c, cuts[n][1:])) if n in cuts else [c] for c in map(np.sort, labels)]
            for r, pair in enumerate(zip(*parts)):
                if len(pair[0]) or len(pair[1]):
                    blobs = [b for codes in pair for b in _distinct(codes)]
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([r], pa.int32()), *[
                        pa.array([b.tobytes()], pa.binary()) for b in blobs]], ["n", "r", "neg", "neg_n", "pos", "pos_n"])

    def rank(table: pa.Table) -> pa.Table:
        n, r = table.column("n")[0].as_py(), table.column("r")[0].as_py()
        (neg, neg_n), (pos, pos_n) = [_added_up(table.column(c).to_pylist(), table.column(f"{c}_n").to_pylist()) for c in ("neg", "pos")]
        neg_start, pos_start = ranges[n][1][r] if n in ranges else (0, 0)
        n_neg, n_pos = ranges[n][2] if n in ranges else (neg_n.sum(), pos_n.sum())
        sums = np.concatenate([[0], np.cumsum(neg_n)])
        below, upto = (sums[np.searchsorted(neg, pos, side)] for side in ("left", "right"))
        wins = float((pos_n * (neg_start + (below + upto) / 2)).sum())
        hits = n_pos - (pos_start + np.cumsum(pos_n) - pos_n)
        precise = float((pos_n * hits / np.maximum(hits + n_neg - neg_start - below, 1)).sum())
        return pa.table({"n": pa.array([n], pa.int32()), "wins": [wins], "precise": [precise], "neg": [float(neg_n.sum())], "pos": [float(pos_n.sum())]})

    sent = rows.mapInArrow(send, "n int, r int, neg binary, neg_n binary, pos binary, pos_n binary")
    sums = (sent.groupBy("n", "r").applyInArrow(rank, "n int, wins double, precise double, neg double, pos double")
            .groupBy("n").agg(*[F.sum(c).alias(c) for c in ("wins", "precise", "neg", "pos")]).collect())  # one row per model
    return [(s["n"], (s["wins"] / (s["pos"] * s["neg"]) if s["pos"] * s["neg"] else None, s["precise"] / s["pos"] if s["pos"] else 0.0))
            for s in sums]


def _score_codes(e: Encoded, jobs: Sequence[tuple[int, LogisticJob]], held: bool, most: int) -> Callable:
    """A function from batches of rows to (number, codes of the scores of both labels); codes are whole numbers in the order of the scores.

    Every score is a sum over the columns in the same order, so equal rows have equal scores in any batch.
    """
    sizes = [len(e.levels[c]) for c in e.cats]
    splits: dict[tuple[int, int], list[int]] = {}
    for i, (_, j) in enumerate(jobs):
        splits.setdefault((j.split.repeat, j.split.fold), []).append(i)
    numbers, betas = [n for n, _ in jobs], np.array([j.base for _, j in jobs]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
        gathered: dict[int, tuple[list, list]] = {}
        size = 0

        def flush() -> Iterator[tuple[int, list[np.ndarray]]]:
            for n in list(gathered):
                yield n, [np.concatenate(parts) for parts in gathered.pop(n)]

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                base, y, folds = _base(part, sizes), part.column("y").to_numpy(zero_copy_only=False) > 0.5, _arrays(part, "folds")
                for (repeat, fold), mine in splits.items():
                    own = (folds[:, repeat] == fold) == held
                    x, eta = base[own].T, np.zeros((len(mine), int(own.sum())))
                    for column, b in zip(x, betas[:, mine]):
                        eta += b[:, None] * column
                    codes = (1 / (1 + np.exp(-np.clip(eta, -700, 700)))).view(np.uint64)
                    for i, c in zip(mine, codes):
                        for kept, label in zip(gathered.setdefault(numbers[i], ([], [])), (~y[own], y[own])):
                            kept.append(c[label])
                    size += codes.size
                if size >= most:
                    yield from flush()
                    size = 0
        yield from flush()
    return run


def _score_ranges(rows: DataFrame, scores: Callable, numbers: Sequence[int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per number the least codes of its ranges, the scores per label below each range, and those of all ranges.

    Buckets with more scores than a group should hold are counted again by finer steps, down to single scores.
    """
    shift, wide = SCORE_BITS, {n: None for n in numbers}
    leaves: dict[int, list[np.ndarray]] = {n: [] for n in numbers}  # least code, negatives, positives of a bucket
    while wide:
        def count(batches: Iterator[pa.RecordBatch], shift=shift, wide=wide) -> Iterator[pa.RecordBatch]:
            for n, labels in scores(batches):
                if n in wide:
                    if wide[n] is not None:
                        before, at = wide[n]
                        labels = [c[np.isin(c >> np.uint64(before), at)] for c in labels]
                    both = [np.unique(c >> np.uint64(shift), return_counts=True) for c in labels]
                    buckets = np.union1d(both[0][0], both[1][0])
                    counts = np.zeros((2, len(buckets)), np.int64)
                    for row, (found, size) in zip(counts, both):
                        row[np.searchsorted(buckets, found)] = size
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(buckets), n, np.int32)), pa.array(buckets.view(np.int64)), *map(pa.array, counts)],
                                                     ["n", "b", "neg", "pos"])

        table = (rows.mapInArrow(count, "n int, b long, neg long, pos long").groupBy("n", "b")
                 .agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toArrow())  # some thousand buckets per number
        n_of, b, neg, pos = (table.column(c).to_numpy() for c in ("n", "b", "neg", "pos"))
        finer, again = max(shift - MORE_SCORE_BITS, 0), {}
        for n in wide:
            mine = np.flatnonzero(n_of == n)
            full = (neg[mine] + pos[mine] > SCORES_TOGETHER) if shift else np.zeros(len(mine), bool)
            if full.any():
                again[n] = (shift, b[mine[full]].view(np.uint64))
            some = mine[~full]
            leaves[n].append(np.stack([b[some].view(np.uint64) << np.uint64(shift), neg[some].astype(np.uint64), pos[some].astype(np.uint64)]))
        shift, wide = finer, again
    out = {}
    for n, parts in leaves.items():
        low, *counts = np.concatenate(parts, axis=1)
        order = np.argsort(low)
        low, counts = low[order], np.array(counts, np.int64)[:, order]
        # A range ends where the next bucket would take it above the size of a group.
        first, held = [0], 0
        for i, size in enumerate(counts.sum(axis=0).tolist()):
            if held and held + size > SCORES_TOGETHER:
                first.append(i)
                held = 0
            held += size
        before = np.cumsum(counts, axis=1) - counts
        out[n] = (low[first], before[:, first].T, counts.sum(axis=1))
    return out


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of sorted ones, and how often each occurs; no counts where none repeats."""
    found, counts = np.unique(codes, return_counts=True)
    return found, counts.astype(np.int32) if len(found) < len(codes) else np.empty(0, np.int32)


def _added_up(codes: Sequence[bytes], counts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of all parts in order, with their counts."""
    values = [np.frombuffer(c, np.uint64) for c in codes]
    if not any(counts):
        return np.unique(np.concatenate(values), return_counts=True)
    sizes = np.concatenate([np.frombuffer(n, np.int32) if n else np.ones(len(v), np.int32) for v, n in zip(values, counts)])
    found, at = np.unique(np.concatenate(values), return_inverse=True)
    return found, np.bincount(at, sizes, len(found)).astype(np.int64)


def _predictions(e: Encoded, rows: DataFrame, jobs: Sequence[tuple[str, Split]], margins, held: bool) -> DataFrame:
    repeats, folds = np.array([s.repeat for _, s in jobs]), np.array([s.fold for _, s in jobs])
    k = len({f for _, f in e.splits})
    ids = e.ids
    schema = rows.select(*[quoted(c) for c in ids]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                own = _arrays(part, "folds")[:, repeats] == folds
                row, job = np.nonzero(own if held else ~own)
                p = 1 / (1 + np.exp(-np.clip(margins(part)[row, job], -700, 700)))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(take) for c in ids], part.column("y").take(take), pa.array(p), pa.array(job.astype(np.int32))],
                    [*ids, "y", "p", "job"])

    known = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(s.repeat).alias("repeat"), F.lit(s.fold).alias("fold")) for n, s in jobs])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    found = rows.mapInArrow(run, f"{fields}, y double, p double, job int").withColumn("__job", known[F.col("job")])
    return found.select(*[quoted(c) for c in ids], F.col("y").cast("int").alias("y"), "p", "__job.*").withColumn(
        "split", F.col("repeat") * k + F.col("fold"))


@dataclass
class BoostJob:
    """Boosted trees of one configuration and split; ``stages`` maps a number of iterations to a model name."""

    stages: dict[int, str]
    split: Split
    nums: Sequence[str]
    cats: Sequence[str]
    rate: float
    depth: int
    min_leaf: int
    subsample: float

    @property
    def last(self) -> int:
        return max(self.stages)

    @property
    def start(self) -> float:
        """The margin before the first tree."""
        return float(np.log(max(self.split.positives, 1e-9) / max(self.split.n - self.split.positives, 1e-9)))


def _in_batches(e: Encoded, jobs: Sequence[BoostJob], seed: int, scored: Callable) -> list:
    """Grow all jobs' trees, as many at once as a batch may send; ``scored(blocks, cells, places, jobs, t)`` at every stage.

    First-order trees on the residuals with Newton steps in the leaves. Numbers are cut at ``BINS``
    quantiles of all rows, a category splits one level from the rest. Levels of a tree take a job each,
    whatever the number of models.
    """
    edges = _edges(e)
    cells = 2 ** (max(j.depth for j in jobs) - 1) * sum(_sizes(e, edges)) * 3
    at_once = max(1, BATCH_CELLS // cells)
    splits = list({(j.split.repeat, j.split.fold): j.split for j in jobs}.values())
    places = {(s.repeat, s.fold): i for i, s in enumerate(splits)}
    blocks = _blocks(e, edges, splits).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return [x for i in range(0, len(jobs), at_once) for x in _boost(
            e, edges, blocks, places, jobs[i:i + at_once], seed,
            lambda state, t, some=jobs[i:i + at_once]: scored(blocks, state, places, some, t))]
    finally:
        blocks.unpersist()


def fit_boosted(e: Encoded, jobs: Sequence[BoostJob], seed: int = 42, held: bool = True) -> DataFrame:
    """Grow all jobs' trees together and return the predictions of every stage, as ``predict_logistic`` does."""
    return reduce(DataFrame.unionByName, _in_batches(
        e, jobs, seed, lambda blocks, state, places, some, t: materialize(_staged(e, blocks, state, some, t, held))))


def rank_boosted(e: Encoded, jobs: Sequence[BoostJob], seed: int = 42) -> DataFrame | None:
    """(model, split, roc_auc, pr_auc) of every stage on its held-out rows, from the counts of the cells.

    All rows of a cell have one score and one residual, so a task grows all trees of a model from the cells, many models at
    the same time. Trees that see samples of the rows get the counts of the samples, drawn by jobs over the rows for as many
    iterations as ``DRAWN_BYTES`` hold. None if there are more cells than one task should see; then the predictions of the
    rows have to be ranked.
    """
    table = cell_table(e)
    if table is None:
        return None
    sc, edges, splits = e.rows.sparkSession.sparkContext, _edges(e), list(e.splits.values())
    places = {(s.repeat, s.fold): i for i, s in enumerate(splits)}
    sent = sc.broadcast((table, _sizes(e, edges), len(e.nums), [*e.nums, *e.cats], list(jobs), places, len({f for _, f in e.splits})))
    found: list[tuple] = []
    try:
        whole = [i for i, j in enumerate(jobs) if j.subsample >= 1]
        if whole:
            found += _models(sc, whole).flatMap(lambda item: _advanced(item, sent.value, None, 0, None)[2]).collect()
        sampled = [i for i, j in enumerate(jobs) if j.subsample < 1]
        if sampled:
            found += _rank_sampled(e, sent, jobs, sampled, seed)
    finally:
        sent.destroy()
    return e.rows.sparkSession.createDataFrame(found, "model string, split int, roc_auc double, pr_auc double")


def _models(sc, numbers: Sequence[int]) -> RDD:
    """(number, no margins yet, no ranks yet) per model, long and short ones side by side."""
    order = np.random.default_rng(len(numbers)).permutation(np.array(numbers)).tolist()
    return sc.parallelize([(i, None, []) for i in order], min(len(order), 8 * sc.defaultParallelism))


def _rank_sampled(e: Encoded, sent, jobs: Sequence[BoostJob], numbers: Sequence[int], seed: int) -> list[tuple]:
    """Ranks of the models whose trees see samples, some iterations after the other; only their margins are kept between."""
    sc, (q, whole, _, _), splits = e.rows.sparkSession.sparkContext, cell_table(e), list(e.splits.values())
    rates, last = sorted({jobs[i].subsample for i in numbers}), max(jobs[i].last for i in numbers)
    folds = sorted({(jobs[i].split.repeat, jobs[i].split.fold) for i in numbers})
    kind = np.min_scalar_type(int(whole.max()))
    at_once = max(1, DRAWN_BYTES // (len(folds) * len(rates) * whole.size * kind.itemsize))
    blocks = _blocks(e, _edges(e), splits).map(lambda b: {n: b[n] for n in ("q", "at", "y", "folds", "r")}).persist(StorageLevel.MEMORY_AND_DISK)
    state, found, held = _models(sc, numbers), [], []
    try:
        for first in range(0, last, at_once):
            some = range(first, min(first + at_once, last))

            def draw(b: dict, some=some) -> Iterator[tuple]:
                codes = 2 * b["at"].astype(np.int64) + b["y"]
                for repeat, fold in folds:
                    mine = b["folds"][:, repeat] != fold
                    r, code = b["r"][mine], codes[mine]
                    for t in some:
                        numbers = _draws(r, _sample_seed(seed, t, repeat, fold))
                        drawn = [np.bincount(code[numbers < rate], minlength=2 * len(b["q"])).reshape(-1, 2) for rate in rates]
                        yield (repeat, fold, t), b["q"], np.array(drawn, kind)

            drawn = {(*f, t): np.zeros((len(rates), len(q), 2), kind) for f in folds for t in some}
            for key, cells, counts in blocks.flatMap(draw).collect():
                drawn[key][:, _find(q, cells)] += counts
            held.append((state, sc.broadcast((drawn, rates))))
            state = state.map(lambda item, counts=held[-1][1], first=first, end=some[-1] + 1: _advanced(
                item, sent.value, counts.value, first, end)).persist(StorageLevel.MEMORY_AND_DISK)
            found += state.flatMap(lambda item: item[2]).collect()
            held[-1][0].unpersist()
    finally:
        for rdd in (blocks, state):
            rdd.unpersist()
        for _, gone in held:  # a lost part of the margins would need them again
            gone.destroy()
    return found


def _find(q: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Numbers of cells in a sorted table that has them all."""
    rows = np.dtype([("", np.int16)] * q.shape[1])
    return np.searchsorted(np.ascontiguousarray(q, np.int16).view(rows).ravel(), np.ascontiguousarray(cells, np.int16).view(rows).ravel())


def _advanced(item: tuple, known: tuple, drawn: tuple | None, first: int, end: int | None) -> tuple[int, np.ndarray | None, list[tuple]]:
    """A model after further iterations, with the ranks of the stages among them."""
    number, f, _ = item
    (q, whole, held, fills), sizes, nums, names, jobs, places, k = known
    job = jobs[number]
    split = places[job.split.repeat, job.split.fold]
    codes = np.ascontiguousarray(np.where(q < 0, fills[split], q).T, np.int64)
    train, test = (whole - held[:, split]).astype(float), held[:, split]
    here = np.flatnonzero(test.any(axis=1))

    def counts(t: int) -> np.ndarray:
        return train if drawn is None else drawn[0][job.split.repeat, job.split.fold, t][drawn[1].index(job.subsample)].astype(float)

    ranks = []
    f = np.full(len(q), job.start) if f is None else f
    allowed = [i for i, n in enumerate(names) if n in (*job.nums, *job.cats)]
    for t in range(first, min(job.last, job.last if end is None else end)):
        f = _boosted(codes, sizes, nums, allowed, job, f, counts(t))
        if t + 1 in job.stages:
            p = 1 / (1 + np.exp(-np.clip(f[here], -700, 700)))
            ranks.append((job.stages[t + 1], job.split.repeat * k + job.split.fold, *ranked(p, test[here])))
    return number, f, ranks


def _boosted(codes: np.ndarray, sizes: Sequence[int], nums: int, allowed: Sequence[int], job: BoostJob, f: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Margins of the cells after one more tree on counts ``n`` per cell and label; ``codes`` has a row per feature, without gaps."""
    flat, size = codes.ravel(), codes.shape[1]
    p, rows = 1 / (1 + np.exp(-f)), n.sum(axis=1)
    residual, node, cells = n[:, 1] - rows * p, np.zeros(size, np.int64), np.arange(size)
    for level in range(job.depth):
        nodes = 2 ** level
        total, total_rows = np.bincount(node, residual, nodes)[:, None], np.bincount(node, rows, nodes)[:, None]
        whole = total ** 2 / np.maximum(total_rows, 1)
        best, taken, cut = np.full(nodes, 1e-12), np.full(nodes, -1), np.zeros(nodes, np.int64)
        for k in allowed:
            key = node * sizes[k] + codes[k] if level else codes[k]
            left, left_rows = (np.bincount(key, w, nodes * sizes[k]).reshape(nodes, -1) for w in (residual, rows))
            if k < nums:
                left, left_rows = np.cumsum(left, axis=1), np.cumsum(left_rows, axis=1)
            right_rows = total_rows - left_rows
            gain = left ** 2 / np.maximum(left_rows, 1) + (total - left) ** 2 / np.maximum(right_rows, 1) - whole
            gain[np.minimum(left_rows, right_rows) < job.min_leaf] = -1.0
            top = gain.argmax(axis=1)
            strength = gain[np.arange(nodes), top]
            better = strength > best
            best[better], taken[better], cut[better] = strength[better], k, top[better]
        # The codes that go left: up to the cut, the level itself, or all of them.
        low = np.where(taken >= nums, cut, -1)
        high = np.where(taken < 0, np.iinfo(np.int64).max, cut)
        code = flat[(np.maximum(taken, 0) * size)[node] + cells]
        node = 2 * node + ((code < low[node]) | (code > high[node]))
    leaves = 2 ** job.depth
    curved = np.bincount(node, rows * p * (1 - p), leaves)
    value = np.bincount(node, residual, leaves) / np.maximum(curved, 1e-12) * (np.bincount(node, rows, leaves) > 0)
    return f + job.rate * value[node]


def cell_count(e: Encoded) -> int:
    """Distinct rows of bins, counted up to one more than ``MOST_CELLS``."""
    return _coded(e, _edges(e)).select("q").distinct().limit(MOST_CELLS + 1).count()


def cell_table(e: Encoded) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """The cells of all rows, at most ``MOST_CELLS``: their codes, the rows per label, those held out per split and label; and
    the codes that gaps get, per split. None if there are more cells."""
    if "cells" not in e.kept:
        e.kept["cells"] = _cell_table(e) if cell_count(e) <= MOST_CELLS else None
    return e.kept["cells"]


def _cell_table(e: Encoded) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    edges, splits = _edges(e), list(e.splits.values())
    parts = _blocks(e, edges, splits).map(lambda b: (b["q"], b["all"], b["held"])).collect()
    q, at = np.unique(np.concatenate([p[0] for p in parts]), axis=0, return_inverse=True)
    whole, held = np.zeros((len(q), 2), np.int64), np.zeros((len(q), len(splits), 2), np.int64)
    np.add.at(whole, at.ravel(), np.concatenate([p[1] for p in parts]))
    np.add.at(held, at.ravel(), np.concatenate([p[2] for p in parts]))
    return q, whole, held, _fills(e, edges, splits)


def _fills(e: Encoded, edges: Sequence[np.ndarray], splits: Sequence[Split]) -> np.ndarray:
    """The bin that a gap falls into, per split: that of the median, or the most frequent level."""
    return np.array([[*[np.searchsorted(b, s.numbers[c][0]) for c, b in zip(e.nums, edges)], *[max(s.modes[c], 0) for c in e.cats]]
                     for s in splits], np.int16)


def ranked(p: np.ndarray, counts: np.ndarray) -> tuple[float | None, float]:
    """ROC-AUC (ties count half) and step-wise average precision of scores with counts per label, as ``ranking_metrics``."""
    values, at = np.unique(p, return_inverse=True)
    neg, pos = (np.bincount(at, counts[:, i], len(values)) for i in (0, 1))
    n_neg, n_pos = neg.sum(), pos.sum()
    neg_before = np.cumsum(neg) - neg
    hits, shown = np.cumsum(pos[::-1])[::-1], np.cumsum((neg + pos)[::-1])[::-1]
    return (float((pos * (neg_before + neg / 2)).sum() / (n_pos * n_neg)) if n_pos * n_neg else None,
            float((pos * hits / np.maximum(shown, 1)).sum() / n_pos) if n_pos else 0.0)


def _edges(e: Encoded) -> list[np.ndarray]:
    if "edges" not in e.kept:
        wide = e.rows.select(*[F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]).alias(f"g{i}") for i in range(len(e.nums))])
        found = {r["feature"]: r["q"] for r in column_quantiles(
            wide, [f"g{i}" for i in range(len(e.nums))], [b / BINS for b in range(1, BINS)]).collect()} if e.nums else {}
        e.kept["edges"] = [np.unique(found.get(f"g{i}", [0.0])) for i in range(len(e.nums))]
    return e.kept["edges"]


def _sizes(e: Encoded, edges: Sequence[np.ndarray]) -> list[int]:
    return [len(x) + 1 for x in edges] + [max(len(e.levels[c]), 1) for c in e.cats]


def _coded(e: Encoded, edges: Sequence[np.ndarray]) -> DataFrame:
    """The rows with ``q``, their bins or levels (gaps -1) as bytes, and ``r``, a random number of their key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, c = _arrays(batch, "x"), _arrays(batch, "c")
            bins = [np.where(np.isnan(x[:, i]), -1, np.searchsorted(b, x[:, i])) for i, b in enumerate(edges)]
            q = np.concatenate([np.array(bins, np.int16).T.reshape(len(c), -1), c.astype(np.int16)], axis=1)
            yield batch.drop_columns(["x", "c"]).append_column("q", pa.array([row.tobytes() for row in q], pa.binary()))

    rows = e.rows.withColumn("r", F.xxhash64(*[quoted(c) for c in e.ids]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("x", "c").schema)
    return rows.mapInArrow(run, f"{fields}, q binary")


def _blocks(e: Encoded, edges: Sequence[np.ndarray], splits: Sequence[Split]) -> RDD:
    """Blocks of rows that are sorted by cell: the codes of their cells, all counts per cell and label and the
    held-out ones per cell, split and label; per row its cell, label, folds, a random number, and the keys.

    Rows of a cell meet in one task; those of a cell with more rows than a task's share are dealt out. Equal
    cells of two blocks are harmless, they only cost time.
    """
    ids, width = e.ids, len(edges) + len(e.cats)
    places = [(s.repeat, s.fold) for s in splits]
    tasks = e.rows.rdd.getNumPartitions()
    coded = _coded(e, edges)
    share = max(e.rows.count() // tasks, ROWS)
    hot = [r["q"] for r in coded.groupBy("q").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > share).collect()]  # one per task at most
    deal = F.when(F.col("q").isin([bytes(h) for h in hot]), F.pmod("r", F.lit(tasks))).otherwise(0) if hot else F.lit(0)
    dealt = coded.withColumn("deal", deal).repartition(tasks, "q", "deal").sortWithinPartitions("q", "r").drop("deal")

    def block(rows: pa.Table, q: np.ndarray) -> dict:
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]).any(axis=1)
        at = np.cumsum(new) - 1
        y, folds = rows.column("y").to_numpy() > 0.5, rows.column("folds").combine_chunks().flatten().to_numpy().reshape(len(q), -1)
        cells = int(at[-1]) + 1
        held = np.zeros((cells, len(places), 2), np.int32)
        for s, (repeat, fold) in enumerate(places):
            mine = folds[:, repeat] == fold
            held[:, s] = np.bincount(2 * at[mine] + y[mine], minlength=2 * cells).reshape(-1, 2)
        sink = pa.BufferOutputStream()
        keys = rows.select(ids).combine_chunks()
        with pa.ipc.new_stream(sink, keys.schema) as out:
            out.write_table(keys)
        return {"ids": sink.getvalue().to_pybytes(), "q": q[new], "all": np.bincount(2 * at + y, minlength=2 * cells).reshape(-1, 2),
                "held": held, "at": at.astype(np.int32), "y": y, "folds": folds.astype(np.int16), "r": rows.column("r").to_numpy()}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(kept)
            q = np.frombuffer(b"".join(rows.column("q").to_pylist()), np.int16).reshape(len(rows), width)
            starts = np.concatenate([[0], 1 + np.flatnonzero((q[1:] != q[:-1]).any(axis=1))])[::ROWS]
            for low, high in zip(starts, [*starts[1:], len(rows)]):
                one = block(rows.slice(low, high - low), q[low:high])
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(one, 5)], pa.binary())], ["block"])

        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
                size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield from flush()
                kept, size = [], 0
        if size:
            yield from flush()

    return dealt.mapInArrow(packed, "block binary").rdd.map(lambda row: pickle.loads(row["block"]))


def _cells(block: dict, start: np.ndarray, sampled: bool) -> dict:
    """What growing needs of a block: its cells with the margins of all models, and the rows only if trees see samples of them."""
    names = ["q", "all", "held", *(["at", "y", "folds", "r"] if sampled else [])]
    return {**{n: block[n] for n in names}, "f": np.tile(start, (len(block["q"]), 1))}


def _sampled(r: np.ndarray, seed: int, rate: float) -> np.ndarray:
    """Rows of a pseudo-random sample, the same whenever a task runs again."""
    return _draws(r, seed) < rate


def _sample_seed(seed: int, iteration: int, repeat: int, fold: int) -> int:
    return (seed + iteration * 1_000_003 + repeat * 10_007 + fold) * 2 + 1


def _draws(r: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random number below 1 per row."""
    h = (r.view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2 ** 64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


class _Grower:
    """The trees that grow at the moment, sent to the tasks of the next job."""

    def __init__(self, e: Encoded, edges: Sequence[np.ndarray], jobs: Sequence[BoostJob], seed: int, places: dict[tuple[int, int], int]) -> None:
        names = [*e.nums, *e.cats]
        self.splits = np.array([places[j.split.repeat, j.split.fold] for j in jobs])  # their number in the blocks
        self.sizes, self.n_nums, self.seed = _sizes(e, edges), len(e.nums), seed
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.repeats, self.folds = np.array([j.split.repeat for j in jobs]), np.array([j.split.fold for j in jobs])
        self.depths, self.rates = np.array([j.depth for j in jobs]), np.array([j.rate for j in jobs])
        self.lasts, self.leaves = np.array([j.last for j in jobs]), np.array([j.min_leaf for j in jobs])
        self.samples = np.array([j.subsample for j in jobs])
        self.allowed = np.array([[n in (*j.nums, *j.cats) for n in names] for j in jobs])
        self.fills = _fills(e, edges, [j.split for j in jobs])
        self.start = np.array([j.start for j in jobs])
        self.iteration = 0
        self.new_tree()

    def new_tree(self) -> None:
        nodes = 2 ** int(self.depths.max())
        # Per model and node in heap order: feature (-1: all rows go left) and bin; per leaf its value.
        self.feature = np.full((len(self.depths), nodes), -1, np.int16)
        self.bin = np.zeros((len(self.depths), nodes), np.int16)
        self.value = np.zeros((len(self.depths), nodes))

    def place(self, q: np.ndarray, m: int, levels: int) -> np.ndarray:
        """Node of every row on a level of the tree of model m."""
        node = np.zeros(len(q), np.int64)
        for level in range(levels):
            heap = node + 2 ** level - 1
            f = self.feature[m, heap]
            code = q[np.arange(len(q)), np.maximum(f, 0)]
            code = np.where(code < 0, self.fills[m, np.maximum(f, 0)], code)
            b = self.bin[m, heap]
            right = np.where(f < 0, False, np.where(f < self.n_nums, code > b, code != b))
            node = 2 * node + right
        return node

    def margins(self, q: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Margins after the finished tree."""
        out = f.copy()
        for m in np.flatnonzero(self.lasts >= self.iteration):
            out[:, m] += self.rates[m] * self.value[m, self.place(q, m, self.depths[m])]
        return out

    def training(self, b: dict, models: np.ndarray, drawn: dict) -> np.ndarray:
        """Rows per cell, model and label that the trees of this iteration see."""
        out = (b["all"][:, None] - b["held"][:, self.splits[models]]).astype(float)
        for i, m in enumerate(models):
            if self.samples[m] < 1:
                key = (self.repeats[m], self.folds[m], self.samples[m])
                if key not in drawn:
                    number = _sample_seed(self.seed, self.iteration, int(self.repeats[m]), int(self.folds[m]))
                    used = (b["folds"][:, self.repeats[m]] != self.folds[m]) & _sampled(b["r"], number, self.samples[m])
                    drawn[key] = np.bincount(2 * b["at"][used] + b["y"][used], minlength=2 * len(b["q"])).reshape(-1, 2)
                out[:, i] = drawn[key]
        return out

    def histograms(self, b: dict, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(models, sums of residual, curvature and rows per model, node, bin of every feature)."""
        live = np.flatnonzero((self.lasts > self.iteration) & (self.depths > level))
        nodes, width, q = 2 ** level, int(self.starts[-1]), b["q"]
        drawn: dict[tuple[int, int, float], np.ndarray] = {}
        for at in range(0, len(live), BLOCK):
            block = live[at:at + BLOCK]
            p = 1 / (1 + np.exp(-b["f"][:, block]))
            n = self.training(b, block, drawn)
            node = np.stack([self.place(q, m, level) for m in block], axis=1) + np.arange(len(block)) * nodes
            rows = n.sum(axis=2)
            weights = [(n[..., 1] - rows * p).ravel(), (rows * p * (1 - p)).ravel(), rows.ravel()]
            out = np.zeros((len(block) * nodes, width, 3))
            for k, size in enumerate(self.sizes):
                code = q[:, k, None]
                code = np.where(code < 0, self.fills[block, k], code)
                cell = (node * size + code).ravel()
                for s, weight in enumerate(weights):
                    out[:, self.starts[k]:self.starts[k + 1], s] = np.bincount(
                        cell, weights=weight, minlength=len(block) * nodes * size).reshape(len(block) * nodes, size)
            yield block, out.reshape(len(block), nodes, width, 3)

    def best(self, m: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, bin, values of both children) per node, from the sums of one model."""
        total = sums[:, self.starts[0]:self.starts[1]].sum(axis=1)  # every feature's bins hold all rows
        left = np.empty_like(sums)
        for k in range(len(self.sizes)):
            part = slice(self.starts[k], self.starts[k + 1])
            left[:, part] = np.cumsum(sums[:, part], axis=1) if k < self.n_nums else sums[:, part]
        right = total[:, None] - left
        fit = np.minimum(left[..., 2], right[..., 2]) >= self.leaves[m]
        fit &= np.repeat(self.allowed[m], self.sizes)

        def strength(x: np.ndarray) -> np.ndarray:
            return x[..., 0] ** 2 / np.maximum(x[..., 2], 1)

        gain = np.where(fit, strength(left) + strength(right) - strength(total)[:, None], -1.0)
        at = gain.argmax(axis=1)
        nodes = np.arange(len(sums))
        split = gain[nodes, at] > 1e-12
        feature = np.where(split, np.searchsorted(self.starts, at, side="right") - 1, -1)
        sides = np.where(split[:, None, None], np.stack([left[nodes, at], right[nodes, at]], axis=1),
                         np.stack([total, np.zeros_like(total)], axis=1))
        values = sides[..., 0] / np.maximum(sides[..., 1], 1e-12) * (sides[..., 2] > 0)
        return feature, np.where(split, at - self.starts[feature], 0), values


def _boost(e: Encoded, edges: Sequence[np.ndarray], blocks: RDD, places: dict[tuple[int, int], int], jobs: Sequence[BoostJob], seed: int,
           scored: Callable[[RDD, int], Any]) -> list:
    """Grow the trees of the jobs; what ``scored`` returns of the blocks of cells at every stage."""
    sc = e.rows.sparkSession.sparkContext
    grower = _Grower(e, edges, jobs, seed, places)
    start, sampled = grower.start, bool((grower.samples < 1).any())
    state = blocks.map(lambda b: _cells(b, start, sampled)).persist(StorageLevel.MEMORY_AND_DISK)
    older: list[tuple] = []
    stages = sorted({t for j in jobs for t in j.stages})
    found = []
    try:
        for t in range(1, stages[-1] + 1):
            for level in range(int(grower.depths[grower.lasts > grower.iteration].max())):
                last = grower.depths == level + 1
                for m, feature, bins, values in _grow(state, grower, level):
                    heap = 2 ** level - 1 + np.arange(2 ** level)
                    grower.feature[m, heap], grower.bin[m, heap] = feature, bins
                    if last[m]:
                        grower.value[m, :2 ** (level + 1)] = values.ravel()
            grower.iteration = t
            sent = sc.broadcast(grower)
            older.append((state, sent))
            state = state.map(_advance(sent)).persist(StorageLevel.MEMORY_AND_DISK)
            if t % CUT == 0 or t in stages:  # nothing depends on earlier states once this one is written
                state.checkpoint()
                state.count()
                for rows, _ in older:
                    rows.unpersist()
                for _, gone in older[:-1]:  # the last one stays part of the written state
                    gone.destroy()
                older = []
            if t in stages:
                found.append(scored(state, t))
            grower.new_tree()
    finally:
        for rows, sent in [*older, (state, None)]:
            rows.unpersist()
    return found


def _advance(sent):
    def run(block: dict) -> dict:
        return {**block, "f": sent.value.margins(block["q"], block["f"])}
    return run


def _grow(state: RDD, grower: _Grower, level: int) -> list[tuple]:
    """Best split of every node of a level, per model: histograms per task, their sums per model, one choice each."""
    sent = state.context.broadcast(grower)

    def count(blocks: Iterator[dict]) -> Iterator[tuple[int, np.ndarray]]:
        held: dict[int, np.ndarray] = {}
        for b in blocks:
            for models, sums in sent.value.histograms(b, level):
                for m, s in zip(models.tolist(), sums):
                    held[m] = held[m] + s if m in held else s
        return iter(held.items())

    cells = len(grower.depths) * 2 ** level * int(grower.starts[-1]) * 3
    sums = state.mapPartitions(count)
    if cells * state.getNumPartitions() <= DRIVER_CELLS:  # the driver adds up what all tasks may send
        total: dict[int, np.ndarray] = {}
        for m, s in sums.collect():
            total[m] = total[m] + s if m in total else s
        splits = [(m, *grower.best(m, s)) for m, s in total.items()]
    else:
        splits = sums.reduceByKey(np.add, min(state.getNumPartitions(), _tasks(cells))).map(
            lambda x: (x[0], *sent.value.best(*x))).collect()  # a few numbers per node
    sent.destroy()
    return splits


def _staged(e: Encoded, blocks: RDD, state: RDD, jobs: Sequence[BoostJob], t: int, held: bool) -> DataFrame:
    """Predictions of the models that have a stage at iteration t, per row of the blocks."""
    which = np.array([i for i, j in enumerate(jobs) if t in j.stages])
    spark, ids = e.rows.sparkSession, e.ids
    pairs = blocks.map(lambda b: (b["ids"], b["y"], b["folds"], b["at"])).zip(state.map(lambda b: b["f"][:, which]))
    packed = spark.createDataFrame(pairs.map(lambda x: (bytearray(pickle.dumps((*x[0], x[1]), 5)),)), "block binary")
    schema = e.rows.select(*[quoted(c) for c in ids]).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("block"):
                keys, y, folds, at, f = pickle.loads(body.as_py())
                with pa.ipc.open_stream(keys) as stream:
                    known = stream.read_all().combine_chunks()

                def lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel(), kind))
                for low in range(0, len(y), 4096):
                    part = slice(low, low + 4096)
                    yield pa.RecordBatch.from_arrays(
                        [*[c.slice(low, 4096).combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in known.columns],
                         pa.array(y[part].astype(float)), lists(folds[part].astype(np.int32), pa.int32()), lists(f[at[part]], pa.float64())],
                        [*ids, "y", "folds", "f"])

    flat = packed.mapInArrow(rows, f"{fields}, y double, folds array<int>, f array<double>")
    return _predictions(e, flat, [(jobs[i].stages[t], jobs[i].split) for i in which], lambda batch: _arrays(batch, "f"), held)
