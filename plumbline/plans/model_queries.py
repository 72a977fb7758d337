"""Training, calibration, importance and scoring on the given tables.

The label follows a known risk (see ``datasets.predictions``), so models have
something to learn. Fits are iterative and have no SQL twin; they return rows whose
invariants the tests check.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import calibrate, features, importance, metrics, models, rules, splits
from plumbline.plans import datasets as d
from plumbline.plans.contract_queries import _scratch
from plumbline.plans.registry import query
from plumbline.session import materialize
from plumbline.streaming import scoring

Spark = SparkSession
IDS = ["id"]
#: The reference validates on 5 folds for each of 5 seeds and searches its grids on 5 folds for 2 of them.
FOLDS, SEEDS = 5, (42, 52, 62, 72, 82)
# The reference's grids, in the parameters of the three families; depth ``None`` is the deepest Spark allows.
LOGISTIC_GRID = {"C": [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0], "balanced": [False, True]}
GBT_GRID = {"maxIter": [50, 100, 150, 200], "stepSize": [0.01, 0.03, 0.05, 0.1], "maxDepth": [1, 2, 3],
            "minInstancesPerNode": [5, 10, 20], "subsamplingRate": [0.7, 0.85, 1.0]}
FOREST_GRID = {"numTrees": [200, 400], "maxDepth": [models.DEEPEST, 3, 5, 8], "minInstancesPerNode": [2, 5, 10, 20],
               "featureSubsetStrategy": ["sqrt", "log2", "0.7"], "balanced": [False, True]}

# The reference's candidates, logistic (C, balanced) and boosted (iterations, rate, depth, least rows in a leaf).
LOGISTIC_CANDIDATES = ((0.01, False), (0.05, False), (0.10, False), (0.50, False), (1.00, False), (2.00, False), (5.00, False),
                       (10.00, False), (0.10, True), (0.50, True), (1.00, True), (2.00, True), (5.00, True))
GBT_CANDIDATES = ((100, 0.05, 2, 2), (200, 0.05, 2, 2), (300, 0.03, 2, 2), (100, 0.05, 3, 2), (200, 0.05, 3, 2),
                  (300, 0.03, 3, 2), (200, 0.03, 3, 5), (300, 0.03, 3, 5), (200, 0.05, 4, 5))


def candidates() -> list[models.ModelSpec]:
    """The reference's list of candidates."""
    return [models.logistic(f"logistic C={c} balanced={b}", d.NUMS, d.CATS, C=c, balanced=b, maxIter=5000)
            for c, b in LOGISTIC_CANDIDATES] + [
        models.gbt(f"gbt {n} x {rate}, depth {depth}, leaf {leaf}", d.NUMS, d.CATS, iterations=n, rate=rate, depth=depth, min_leaf=leaf)
        for n, rate, depth, leaf in GBT_CANDIDATES]


def lr(name: str = "logistic") -> models.ModelSpec:
    return models.logistic(name, d.NUMS, d.CATS, C=1.0, maxIter=5000)


def rf(name: str = "forest") -> models.ModelSpec:
    return models.random_forest(name, d.NUMS, d.CATS, trees=400, depth=models.DEEPEST, min_leaf=10)


def gb(name: str = "gbt") -> models.ModelSpec:
    return models.gbt(name, d.NUMS, d.CATS, iterations=200, rate=0.05, depth=3, min_leaf=2)


def _rows(spark: Spark, sf: str) -> DataFrame:
    return d.training_orders(spark, sf)


def _folded(spark: Spark, sf: str, k: int = FOLDS, seeds=SEEDS) -> DataFrame:
    return splits.repeated_stratified_kfold(_rows(spark, sf), "y", IDS, k, seeds)


def _halves(spark: Spark, sf: str) -> tuple[DataFrame, DataFrame]:
    marked = splits.stratified_holdout(_rows(spark, sf), "y", IDS, 0.2).persist()
    return marked.filter(~F.col("is_holdout")), marked.filter("is_holdout")


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
HOT_COLS = [f"CAST(coalesce(priority = '{p}', FALSE) AS DOUBLE) AS h{i}" for i, p in enumerate(PRIORITIES)]
HOT, HOT_REST = ", ".join(HOT_COLS), ", ".join(HOT_COLS[1:])


@query("m4_one_hot", f"WITH {d.MESSY} SELECT id, {HOT} FROM messy", doubles="h0 h1 h2 h3 h4", longs="id")
def m4(spark: Spark, sf: str) -> DataFrame:
    m = d.messy_orders(spark, sf).select("id", "priority")
    out = features.one_hot(["priority"]).fit(m).transform(m)
    return out.select("id", vector_to_array("priority__hot").alias("a")).select(
        "id", *[F.col("a")[i].alias(f"h{i}") for i in range(5)])


@query("m4_one_hot_drop_first", f"WITH {d.MESSY} SELECT id, {HOT_REST} FROM messy", doubles="h1 h2 h3 h4", longs="id")
def m4b(spark: Spark, sf: str) -> DataFrame:
    m = d.messy_orders(spark, sf).select("id", "priority")
    fitted = features.drop_first_stages(features.one_hot(["priority"], drop_first=True).fit(m), ["priority"])
    return fitted.transform(m).select("id", vector_to_array("priority__hot").alias("a")).select(
        "id", *[F.col("a")[i - 1].alias(f"h{i}") for i in range(1, 5)])


@query("m5_preprocessor", f"""WITH {d.OC} SELECT id, (price - (SELECT avg(price) FROM oc)) / (SELECT stddev_pop(price) FROM oc) AS x0,
  (balance - (SELECT avg(balance) FROM oc)) / (SELECT stddev_pop(balance) FROM oc) AS x1,
  {', '.join(f"CAST(segment = '{s}' AS DOUBLE) AS x{i + 2}" for i, s in enumerate(('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')))} FROM oc""",
       doubles="x0 x1 x2 x3 x4 x5 x6", longs="id", digits=5)
def m5(spark: Spark, sf: str) -> DataFrame:
    rows = d.orders_customers(spark, sf)
    out = features.fit_preprocessor(rows, d.NUMS, ["segment"]).transform(rows)
    return out.select("id", vector_to_array("features").alias("a")).select(
        "id", *[F.col("a")[i].alias(f"x{i}") for i in range(7)])


def _holdout_metrics(spark: Spark, sf: str, *specs: models.ModelSpec) -> DataFrame:
    train, test = _halves(spark, sf)
    return models.holdout_evaluate(train, test, specs, threshold=0.5)


@query("h1_logistic")
def h1(spark: Spark, sf: str) -> DataFrame:
    return _holdout_metrics(spark, sf, lr())


@query("h2_random_forest")
def h2(spark: Spark, sf: str) -> DataFrame:
    return _holdout_metrics(spark, sf, rf())


@query("h3_gbt")
def h3(spark: Spark, sf: str) -> DataFrame:
    return _holdout_metrics(spark, sf, gb())


@query("h5_cross_validate")
def h5(spark: Spark, sf: str) -> DataFrame:
    return models.cross_validate(_folded(spark, sf), [lr()], IDS)


#: Folds that any engine can work out: per class the rank of a digest of seed and key.
FOLDS_SQL = f"""{d.PRED}, placed AS (SELECT id, y, r.repeat, row_number() OVER (PARTITION BY r.repeat, y ORDER BY
   CAST(('0x' || substr(md5(r.seed || '-' || id), 1, 15)) AS BIGINT)) - 1 AS k, count(*) OVER (PARTITION BY r.repeat, y) AS n
   FROM pred, (VALUES {', '.join(f"({i}, '{s}')" for i, s in enumerate(SEEDS))}) AS r(repeat, seed)),
 folded AS (SELECT id, y, repeat, len(list_filter([1, 2, 3, 4], lambda f: floor(n * f / 5) <= k)) AS fold FROM placed)"""


def _portable_folds(spark: Spark, sf: str) -> DataFrame:
    return splits.repeated_stratified_kfold(_rows(spark, sf), "y", IDS, FOLDS, SEEDS, portable=True)


@query("h5_cross_validate_counts", f"""WITH {FOLDS_SQL} SELECT 'logistic' AS model, repeat * 5 + fold AS split, count(*) AS rows, sum(y) AS positives,
  TRUE AS ranked FROM folded GROUP BY ALL""", longs="split rows positives")
def h5b(spark: Spark, sf: str) -> DataFrame:
    m = models.cross_validate(_portable_folds(spark, sf), [lr()], IDS)
    return m.select("model", "split", (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("rows"),
                    (F.col("fn") + F.col("tp")).alias("positives"), F.col("roc_auc").between(0.5, 1.0).alias("ranked"))


@query("h10_oof_rows", f"""WITH {FOLDS_SQL} SELECT id, y, 'logistic' AS model, repeat, fold, repeat * 5 + fold AS split, TRUE AS is_probability FROM folded""",
       longs="id y repeat fold split")
def h10b(spark: Spark, sf: str) -> DataFrame:
    pred = models.oof_pooled(_portable_folds(spark, sf), [lr()], IDS)
    inside = (F.col("p") > 0) & (F.col("p") < 1)
    return pred.select("id", "y", "model", "repeat", "fold", "split", inside.alias("is_probability"))


LEVELS_SQL = " UNION ALL ".join(
    [f"SELECT '{c}' AS encoded, '{c}' AS feature, count(*) AS rows FROM pred" for c in d.NUMS]
    + [f"SELECT '{c}=' || {c}, '{c}', count(*) FROM pred GROUP BY {c}" for c in d.CATS])


@query("h14_score_equations", f"WITH {d.PRED} SELECT *, 0.0 AS residual FROM ({LEVELS_SQL})", doubles="residual", longs="rows")
def h14c(spark: Spark, sf: str) -> DataFrame:
    """Per coefficient of a logistic fit on all rows what is left of its score equation, per row; and the rows that bear on it."""
    from plumbline.operators import batched
    rows = _rows(spark, sf)
    # Fold 0 holds no row out that the fit would need: all rows are in fold 1.
    e = batched.encode(rows.withColumn("folds", F.array(F.lit(1))), d.NUMS, d.CATS, IDS)
    whole = batched.whole_split(e)
    job = batched.LogisticJob("logistic", whole, d.NUMS, d.CATS, 1.0, False)
    batched.fit_logistic(e, [job])
    p = batched.predict_logistic(e, [job], held=False).select("id", "p")
    off = rows.join(p, "id").withColumn("off", F.col("p") - F.col("y"))
    sums = {}
    for (name, source), beta in list(zip(job.names, job.beta))[1:]:
        if source in d.NUMS:
            _, mean, std = whole.numbers[source]
            x, n = (F.col(source) - mean) / std, F.count(source)
        else:
            x = (F.col(source) == name.split("=", 1)[1]).cast("double")
            n = F.count_if(x == 1)
        sums[name] = F.struct(F.lit(name).alias("encoded"), F.lit(source).alias("feature"), n.alias("rows"),
                              ((F.sum(F.col("off") * x) + beta) / F.count(F.lit(1))).alias("residual"))
    return off.agg(F.array(*sums.values()).alias("found")).select(F.inline("found"))


@query("h6_grid_search")
def h6(spark: Spark, sf: str) -> DataFrame:
    ranked, _ = models.grid_search(_folded(spark, sf, seeds=SEEDS[:2]), lr(), LOGISTIC_GRID, IDS)
    return ranked


@query("h6_search_and_refit")
def h6r(spark: Spark, sf: str) -> DataFrame:
    ranked, _, model = models.search_and_refit(_folded(spark, sf, seeds=SEEDS[:2]), lr(), LOGISTIC_GRID, IDS)
    refitted = models.feature_importance(model).agg(F.count(F.lit(1)).alias("refitted_features"))
    return ranked.withColumn("refitted_features", F.when(F.col("rank") == 1, refitted.scalar()))


@query("h6_grid_search_gbt")
def h6b(spark: Spark, sf: str) -> DataFrame:
    ranked, _ = models.grid_search(_folded(spark, sf, seeds=SEEDS[:2]), gb(), GBT_GRID, IDS)
    return ranked


@query("h6_grid_search_forest")
def h6c(spark: Spark, sf: str) -> DataFrame:
    ranked, _ = models.grid_search(_folded(spark, sf, seeds=SEEDS[:2]), rf(), FOREST_GRID, IDS)
    return ranked


@query("h7_evaluate_candidates")
def h7(spark: Spark, sf: str) -> DataFrame:
    return models.evaluate_candidates(_folded(spark, sf), candidates(), IDS)


@query("h10_oof_pooled")
def h10(spark: Spark, sf: str) -> DataFrame:
    return models.oof_pooled(_folded(spark, sf), [lr()], IDS)


@query("h11_holdout_evaluate")
def h11(spark: Spark, sf: str) -> DataFrame:
    return _holdout_metrics(spark, sf, lr(), gb())


@query("h12_fit_production")
def h12(spark: Spark, sf: str) -> DataFrame:
    meta = models.fit_production(_rows(spark, sf), rf("production forest"), _scratch(spark) + "/model", 0.25, 5, IDS,
                                 metadata={"use": "decision support"})
    return meta.drop("trained_at")


@query("h13_score")
def h13(spark: Spark, sf: str) -> DataFrame:
    train, test = _halves(spark, sf)
    return models.score(test, models.fit(lr(), train), 0.25, lr().features).select("id", "p", "threshold", "flag")


@query("h13_score_stream")
def h13b(spark: Spark, sf: str) -> DataFrame:
    train, test = _halves(spark, sf)
    root = _scratch(spark)
    test.select(*IDS, *lr().features).write.parquet(f"{root}/in")
    model = models.fit(lr(), train)
    schema = spark.read.parquet(f"{root}/in").schema
    stream = scoring.score_stream(spark, model, f"{root}/in", schema, lr().features, 0.25)
    scoring.write_stream(stream.select("id", "p", "threshold", "flag"), f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("s10_score_files")
def s10(spark: Spark, sf: str) -> DataFrame:
    train, test = _halves(spark, sf)
    root = _scratch(spark)
    test.select(*IDS, *lr().features).write.option("header", True).csv(f"{root}/in.csv")
    return models.score_files(spark, models.fit(lr(), train), f"{root}/in.csv", f"{root}/out.csv", lr().features, 0.25)


@query("h14_coefficients")
def h14(spark: Spark, sf: str) -> DataFrame:
    return models.coefficients(models.fit(lr(), _rows(spark, sf)))


@query("h14_aggregate_coefficients")
def h14b(spark: Spark, sf: str) -> DataFrame:
    return models.aggregate_coefficients(models.coefficients(models.fit(lr(), _rows(spark, sf))))


@query("h15_feature_importance")
def h15(spark: Spark, sf: str) -> DataFrame:
    return models.feature_importance(models.fit(rf(), _rows(spark, sf)))


@query("h15_model_information")
def h15b(spark: Spark, sf: str) -> DataFrame:
    return models.model_information(models.fit(gb(), _rows(spark, sf)))


@query("h16_permutation_importance")
def h16(spark: Spark, sf: str) -> DataFrame:
    train, test = _halves(spark, sf)
    return importance.permutation_importance(test, models.fit(lr(), train), lr().features, IDS, repeats=10)


@query("h17_subset_evaluation")
def h17(spark: Spark, sf: str) -> DataFrame:
    return importance.subset_evaluation(_folded(spark, sf), [lr()], [1, 2, 3, 4], IDS)


@query("h22_compare_families")
def h22(spark: Spark, sf: str) -> DataFrame:
    return models.compare_families(_folded(spark, sf), [lr(), rf(), gb()], IDS)


# Newton's steps as a recursive query over the distinct scores; the curve at every row.
C1_SQL = f"""WITH RECURSIVE {d.PRED}, rows_ AS (SELECT id, y, pow(p, 2) AS p, ln(c / (1.0 - c)) AS z FROM
   (SELECT *, least(greatest(pow(p, 2), 1e-6), 1.0 - 1e-6) AS c FROM pred)),
 zs AS MATERIALIZED (SELECT z, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS pos FROM rows_ GROUP BY z),
 steps AS (SELECT 0 AS i, CAST(0.0 AS DOUBLE) AS a, CAST(0.0 AS DOUBLE) AS b UNION ALL
   SELECT i + 1, a - (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1), b - (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) FROM (
     SELECT i, a, b, sum(n * q - pos) AS g0, sum((n * q - pos) * z) + b AS g1, sum(n * q * (1 - q)) AS h0,
       sum(n * q * (1 - q) * z) AS h1, sum(n * q * (1 - q) * z * z) + 1.0 AS h2
     FROM (SELECT s.i, s.a, s.b, n, pos, z, 1.0 / (1.0 + exp(-(s.a + s.b * z))) AS q FROM steps s, zs WHERE s.i < 25) GROUP BY i, a, b))
SELECT id, y, p, 1.0 / (1.0 + exp(-(a + b * z))) AS sigmoid_probability FROM rows_, (SELECT a, b FROM steps WHERE i = 25)"""


@query("c1_platt", C1_SQL, doubles="p sigmoid_probability", longs="id y")
def c1(spark: Spark, sf: str) -> DataFrame:
    p = d.predictions(spark, sf).select("id", "y", F.pow("p", 2).alias("p"))
    return calibrate.apply_platt(p, calibrate.fit_platt(p))


# The fitted value of a score is the greatest over its lower neighbours of the least mean up to any upper one.
C2_SQL = f"""WITH {d.PRED}, s AS (SELECT pow(p, 2) AS p, count(*) AS n, sum(y) AS pos FROM pred GROUP BY 1),
 c AS MATERIALIZED (SELECT p, row_number() OVER (ORDER BY p) AS k, sum(n) OVER (ORDER BY p) AS n, sum(pos) OVER (ORDER BY p) AS pos FROM s),
 starts AS (SELECT 0 AS k, 0 AS n, 0 AS pos UNION ALL SELECT k, n, pos FROM c),
 least_ AS (SELECT a.k AS a, b.k AS b, min((b.pos - a.pos)::DOUBLE / (b.n - a.n)) OVER (PARTITION BY a.k ORDER BY b.k DESC) AS m
            FROM starts a JOIN c b ON b.k > a.k),
 fitted AS (SELECT b AS k, max(m) AS v FROM least_ GROUP BY b)
SELECT id, y, pow(pred.p, 2) AS p, v AS isotonic_probability FROM pred JOIN c ON c.p = pow(pred.p, 2) JOIN fitted USING (k)"""


@query("c2_isotonic", C2_SQL, doubles="p isotonic_probability", longs="id y")
def c2(spark: Spark, sf: str) -> DataFrame:
    p = d.predictions(spark, sf).select("id", "y", F.pow("p", 2).alias("p"))
    return calibrate.apply_isotonic(p, calibrate.fit_isotonic(p))


@query("c3_calibrated_cv")
def c3(spark: Spark, sf: str) -> DataFrame:
    train, test = _halves(spark, sf)
    model = calibrate.calibrated_cv(train, rf(), IDS, 5)
    both = models.score(test, model).select("y", "p", F.lit("sigmoid").alias("method")).unionByName(
        models.score(test, models.fit(rf(), train)).select("y", "p", F.lit("uncalibrated").alias("method")))
    return metrics.split_performance(materialize(both), ["method"])


@query("r6_validate_model_scores")
def r6(spark: Spark, sf: str) -> DataFrame:
    train, test = _halves(spark, sf)
    strange = test.withColumn("segment", F.when(F.col("price") > 400000, "NEVER SEEN").otherwise(F.col("segment")))
    scored = models.score(strange, models.fit(lr(), train), 0.25, lr().features)
    return rules.validate_scores(scored, strange.count(), 0.25)
