"""Feature preparation fitted on training rows only.

Learned values are a few numbers per column. They become stages of an ML pipeline,
so a fitted preparation is saved, loaded and applied to batches and streams like
any Spark model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler, VectorSlicer,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import attach_scalars, number, per_column, quoted, value_counts
from plumbline.functions.ordered import column_quantiles


def impute_median(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact median per column: ``(feature, fill)``."""
    q = column_quantiles(train, cols, [0.5])
    return q.select("feature", F.col("q")[0].alias("fill"))


def impute_mode(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent text per column, the smallest one on ties: ``(feature, fill)``."""
    known = value_counts(train, cols).filter(F.col("value").isNotNull())
    return known.groupBy("feature").agg(
        F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("fill"))


def apply_fill(df: DataFrame, fills: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace nulls by the fitted value of each column."""
    row = fills.agg(*[F.max(F.when(F.col("feature") == c, F.col("fill"))).alias(f"__fill_{c}") for c in cols])
    filled = attach_scalars(df, row)
    return filled.withColumns({c: F.coalesce(quoted(c).cast(fills.schema["fill"].dataType),
                                             F.col(f"`__fill_{c}`")) for c in cols}
                              ).drop(*[f"__fill_{c}" for c in cols])


def scale_stats(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and population std per column."""
    return per_column(train, cols, lambda c: {"mean": F.avg(number(c)), "std": F.stddev_pop(number(c))})


def scale(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """z-scores; a constant column becomes zero."""
    row = stats.agg(*[F.max(F.when(F.col("feature") == c, F.col(s))).alias(f"__{s}_{c}")
                      for c in cols for s in ("mean", "std")])
    wide = attach_scalars(df, row)
    std = {c: F.when(F.col(f"`__std_{c}`") > 0, F.col(f"`__std_{c}`")).otherwise(F.lit(1.0)) for c in cols}
    return wide.withColumns({c: (number(c) - F.col(f"`__mean_{c}`")) / std[c] for c in cols}).drop(
        *[f"__{s}_{c}" for c in cols for s in ("mean", "std")])


def one_hot(cats: Sequence[str], drop_first: bool = False) -> Pipeline:
    """Alphabetical one-hot stages ``<col>__hot``; unseen and null become all zeros.

    ``drop_first`` also maps the first category to zeros once fitted, see
    :func:`drop_first_stages`.
    """
    index = StringIndexer(inputCols=list(cats), outputCols=[f"{c}__index" for c in cats],
                          handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"{c}__index" for c in cats],
                        outputCols=[f"{c}__all" if drop_first else f"{c}__hot" for c in cats], dropLast=True)
    return Pipeline(stages=[index, hot])


def drop_first_stages(fitted: PipelineModel, cats: Sequence[str]) -> PipelineModel:
    """Append slices that remove the first category of every column."""
    labels = fitted.stages[0].labelsArray
    cuts = [VectorSlicer(inputCol=f"{c}__all", outputCol=f"{c}__hot", indices=list(range(1, len(v))))
            for c, v in zip(cats, labels)]
    return PipelineModel(stages=[*fitted.stages, *cuts])


def _sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fit_preprocessor(train: DataFrame, nums: Sequence[str], cats: Sequence[str],
                     scaled: bool = True) -> PipelineModel:
    """Median/mode imputation, z-scaling and one-hot encoding into ``features``.

    All learned values come from ``train``; one row per column reaches the driver.
    """
    parts = []
    if nums:
        med = impute_median(train, nums)
        stats = per_column(train, nums, lambda c: {
            "n": F.count(number(c)), "rows": F.count(F.lit(1)), "mean": F.avg(number(c)),
            "var": F.var_pop(number(c))})
        learned = {r["feature"]: r for r in stats.join(med, "feature", "left").collect()}
        for c in nums:
            r = learned[c]
            fill = r["fill"] if r["fill"] is not None else 0.0
            # Moments after imputation: known values and a block of equal fills.
            share = r["n"] / r["rows"] if r["rows"] else 0.0
            known = r["mean"] if r["mean"] is not None else fill
            mean = share * known + (1 - share) * fill
            var = share * ((r["var"] or 0.0) + (known - mean) ** 2) + (1 - share) * (fill - mean) ** 2
            std = var ** 0.5 if scaled and var > 0 else 1.0
            x = f"try_cast(`{c}` AS double)"
            value = f"coalesce(if(isnan({x}), null, {x}), {fill!r}D)"
            parts.append(f"({value} - {mean!r}D) / {std!r}D AS `{c}__num`" if scaled
                         else f"{value} AS `{c}__num`")
    if cats:
        modes = {r["feature"]: r["fill"] for r in impute_mode(train, cats).collect()}
        parts += [f"coalesce(cast(`{c}` AS string), {_sql_text(modes.get(c, ''))}) AS `{c}__cat`" for c in cats]
    prepare = SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")
    stages = [prepare]
    if cats:
        stages.append(StringIndexer(inputCols=[f"{c}__cat" for c in cats],
                                    outputCols=[f"{c}__index" for c in cats],
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[f"{c}__index" for c in cats],
                                    outputCols=[f"{c}__hot" for c in cats], dropLast=True))
    stages.append(VectorAssembler(inputCols=[f"{c}__num" for c in nums] + [f"{c}__hot" for c in cats],
                                  outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages).fit(train)


def encoded_names(model: PipelineModel) -> list[tuple[str, str]]:
    """``(encoded name, source column)`` per position of the feature vector."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    labels: dict[str, Sequence[str]] = {}
    for s in model.stages:
        if isinstance(s, StringIndexerModel):
            labels = {c.removesuffix("__cat"): v for c, v in zip(s.getInputCols(), s.labelsArray)}
    out: list[tuple[str, str]] = []
    for col in assembler.getInputCols():
        if col.endswith(("__num", "__bin")):
            src = col[:-len("__num")]
            out.append((src, src))
        else:
            src = col.removesuffix("__hot")
            out += [(f"{src}={v}", src) for v in labels[src]]
    return out
