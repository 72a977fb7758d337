"""Probability calibration: Platt scaling, isotonic regression, cross-fitted ensembles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import number, quoted
from plumbline.operators.models import ModelSpec, fit, in_parallel, score
from plumbline.operators.splits import stratified_kfold
from plumbline.session import materialize

EPS = 1e-6
#: Steps of a sigmoid fit at most; it usually takes five to ten.
PLATT_STEPS = 100


def logit(p: Column, eps: float = EPS) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return F.log(q / (F.lit(1.0) - q))


@dataclass(frozen=True)
class PlattModel:
    """A sigmoid over the logit of a score, or with ``raw`` over the score itself."""

    intercept: float
    slope: float
    raw: bool = False
    steps: int = 0

    @property
    def coefficients(self) -> list[float]:
        return [self.slope]


def fit_platt(pred: DataFrame, label: str = "y", score_col: str = "p", C: float = 1.0,
              smooth: bool = False, raw: bool = False) -> PlattModel:
    """Newton's method for two parameters; every step is one aggregate over the distinct scores.

    ``smooth`` uses Platt's targets (n1 + 1)/(n1 + 2) and 1/(n0 + 2) and no penalty; otherwise half the
    squared slope over ``C`` is added to the log-loss. A step that doesn't lower the loss is halved.
    """
    found = pred.filter(quoted(label).isNotNull()).select(
        quoted(label).cast("double").alias("y"), (number(score_col) if raw else logit(number(score_col))).alias("z")).dropna()
    # Equal scores are one row, so hot scores cost nothing and the steps read a narrow table.
    rows = materialize(found.groupBy("z").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("pos")))
    sizes = rows.agg(F.sum("n").alias("n"), F.sum("pos").alias("p")).first()
    n, n1 = sizes["n"] or 0.0, sizes["p"] or 0.0
    high, low = ((n1 + 1) / (n1 + 2), 1 / (n - n1 + 2)) if smooth else (1.0, 0.0)
    want = F.col("pos") * high + (F.col("n") - F.col("pos")) * low
    penalty = 0.0 if smooth else 1.0 / C
    at, move, last = np.zeros(2), np.zeros(2), np.inf
    for step in range(PLATT_STEPS):
        a, b = (float(v) for v in at + move)
        eta = F.lit(a) + F.lit(b) * F.col("z")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
        off, bend = F.col("n") * p - want, F.col("n") * p * (1 - p)
        # log(1 + exp(eta)) without overflow.
        loss = F.col("n") * (F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))) - want * eta
        r = rows.agg(F.sum(loss).alias("l"), F.sum(off).alias("g0"), F.sum(off * F.col("z")).alias("g1"), F.sum(bend).alias("h0"),
                     F.sum(bend * F.col("z")).alias("h1"), F.sum(bend * F.col("z") * F.col("z")).alias("h2")).first()
        if r["l"] is None:
            break
        loss_now = r["l"] + 0.5 * penalty * b * b
        if loss_now > last + 1e-12 * abs(last):
            move = move / 2
            if np.abs(move).max() < 1e-14:
                break
            continue
        at, last = np.array([a, b]), loss_now
        gradient = np.array([r["g0"], r["g1"] + penalty * b])
        if np.abs(gradient).max() <= 1e-10 * max(n, 1.0):
            break
        move = -np.linalg.lstsq(np.array([[r["h0"], r["h1"]], [r["h1"], r["h2"] + penalty]]), gradient, rcond=None)[0]
    return PlattModel(float(at[0]), float(at[1]), raw, step + 1)


def apply_platt(pred: DataFrame, model: PlattModel, score_col: str = "p",
                out: str = "sigmoid_probability") -> DataFrame:
    """The fitted curve as a plain column expression, over what the model was fitted on."""
    x = number(score_col) if model.raw else logit(number(score_col))
    return pred.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(model.intercept) + F.lit(model.slope) * x))))


def fit_isotonic(pred: DataFrame, label: str = "y", score_col: str = "p") -> IsotonicRegressionModel:
    """Monotone fit. Equal scores are averaged first, so hot scores arrive as one weighted row."""
    rows = (pred.select(quoted(label).cast("double").alias("y"), number(score_col).alias("s"))
            .dropna().groupBy("s").agg(F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("w")))
    return IsotonicRegression(featuresCol="s", labelCol="y", weightCol="w").fit(rows)


def apply_isotonic(pred: DataFrame, model: IsotonicRegressionModel, score_col: str = "p",
                   out: str = "isotonic_probability") -> DataFrame:
    """Fitted value, constant outside the fitted range and clipped to [0, 1]."""
    cols = [quoted(c) for c in pred.columns]
    tmp = model.copy({model.featuresCol: "__s", model.predictionCol: "__iso"})
    return tmp.transform(pred.withColumn("__s", number(score_col))).select(
        *cols, F.least(F.greatest(F.col("__iso"), F.lit(0.0)), F.lit(1.0)).alias(out))


@dataclass
class CalibratedModel:
    """Average of k sigmoid-calibrated models, each calibrated on rows it was not fitted on."""

    members: list[tuple[PipelineModel, float, float]]  # model, slope, intercept

    def _member_probability(self, df: DataFrame, i: int) -> DataFrame:
        model, slope, intercept = self.members[i]
        keep = [quoted(c) for c in df.columns]
        raw = model.transform(df).select(*keep, vector_to_array("probability")[1].alias("__raw"))
        z = F.lit(intercept) + F.lit(slope) * F.col("__raw")
        return raw.select(*keep, (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias(f"__member_{i}"))

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [quoted(c) for c in df.columns]
        out = df
        for i in range(len(self.members)):
            out = self._member_probability(out, i)
        total = sum([F.col(f"__member_{i}") for i in range(len(self.members))], F.lit(0.0))
        p = total / F.lit(float(len(self.members)))
        return out.select(*keep, array_to_vector(F.array(F.lit(1.0) - p, p)).alias("probability"))

    def save(self, path: str) -> None:
        root = path.rstrip("/")
        for i, (model, _, _) in enumerate(self.members):
            model.write().overwrite().save(f"{root}/member_{i}")
        SparkSession.active().createDataFrame(
            [(i, s, b) for i, (_, s, b) in enumerate(self.members)],
            "member int, slope double, intercept double").coalesce(1).write.mode("overwrite").json(f"{root}/sigmoids")

    @classmethod
    def load(cls, path: str) -> CalibratedModel:
        root = path.rstrip("/")
        rows = SparkSession.active().read.json(f"{root}/sigmoids").orderBy("member").collect()
        return cls([(PipelineModel.load(f"{root}/member_{r['member']}"), r["slope"], r["intercept"]) for r in rows])


def calibrated_cv(df: DataFrame, spec: ModelSpec, ids: Sequence[str], k: int = 5, seed: int = 42,
                  label: str = "y", parallelism: int = 4, in_sample: bool = False) -> CalibratedModel:
    """Fit k (model, sigmoid) pairs on inner folds with Platt's smoothed targets.

    The sigmoids are curves over the members' raw probabilities, not over their logits.

    ``in_sample`` calibrates on the rows the model was fitted on, which is optimistic and
    offered only for comparison with results produced that way.
    """
    base = stratified_kfold(df.drop("fold"), label, ids, k, seed).persist()

    def job(f: int):
        def run():
            train = base.filter(F.col("fold") != f)
            model = fit(spec, train, seed, label, cache=False)
            rows = train if in_sample else base.filter(F.col("fold") == f)
            platt = fit_platt(score(rows, model), label, smooth=True, raw=True)
            return model, float(platt.coefficients[0]), float(platt.intercept)
        return run

    try:
        return CalibratedModel(in_parallel([job(f) for f in range(k)], parallelism))
    finally:
        base.unpersist()


def choose_calibration(performance: DataFrame, base: str, candidates: Sequence[str]) -> DataFrame:
    """Candidate with the least Brier + log-loss, its improvements and a status."""
    names = ["brier_score", "log_loss", "expected_calibration_error", "roc_auc"]
    pick = F.struct(*names)
    cost = F.when(F.col("method").isin(*candidates),
                  F.struct(F.col("brier_score") + F.col("log_loss"), F.col("method")))
    row = performance.agg(F.min_by(F.struct("method", *names), cost).alias("c"),
                          F.max(F.when(F.col("method") == base, pick)).alias("b"))
    d = {n: F.col(f"b.{n}") - F.col(f"c.{n}") for n in names[:3]}
    b, l, e = (d[n] > 0 for n in names[:3])
    status = (F.when(b & l & e, "CALIBRATION IMPROVEMENT SUPPORTED")
              .when(b | l, "CALIBRATION IMPROVEMENT PARTIAL").otherwise("CALIBRATION IMPROVEMENT NOT SUPPORTED"))
    return row.select(F.col("c.method").alias("selected_method"),
                      *[d[n].alias(f"{n}_improvement") for n in names[:3]],
                      (F.col("c.roc_auc") - F.col("b.roc_auc")).alias("roc_auc_change"),
                      ((F.col("c.roc_auc") - F.col("b.roc_auc")) >= -0.02).alias("ranking_preserved"),
                      status.alias("status"))
