"""Rule tables: flags, gates and evidence built from metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import number, quoted
from plumbline.operators.contract import within_tolerance

#: (metric, op, bound, message): op is one of lt le gt ge eq ne between missing.
Rule = tuple


def metrics_long(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Wide metric rows as ``(keys, metric, value)``."""
    return df.select(*[quoted(k) for k in keys], F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), quoted(m).cast("double").alias("value")) for m in metrics])))


def _rule_table(spark, rules: Sequence[Rule]) -> DataFrame:
    rows = [(i + 1, m, op, float(b[0]) if isinstance(b, tuple) else None if b is None else float(b),
             float(b[1]) if isinstance(b, tuple) else None, msg)
            for i, (m, op, b, msg) in enumerate(rules)]
    return spark.createDataFrame(rows, "priority int, metric string, op string, bound double, "
                                       "upper double, message string")


def _holds(v: Column, op: Column, b: Column, u: Column) -> Column:
    return F.coalesce(
        F.when(op == "lt", v < b).when(op == "le", v <= b).when(op == "gt", v > b)
        .when(op == "ge", v >= b).when(op == "eq", v == b).when(op == "ne", v != b)
        .when(op == "between", (v >= b) & (v < u)).when(op == "missing", v.isNull()), F.lit(False))


def flags(metrics: DataFrame, rules: Sequence[Rule], keys: Sequence[str] = ()) -> DataFrame:
    """Messages of the rules that hold: ``(keys, priority, metric, value, message)``.

    The rules table is a short literal list, the metric table one row per metric.
    """
    r = F.broadcast(_rule_table(metrics.sparkSession, rules))
    return metrics.join(r, "metric").filter(
        _holds(F.col("value"), F.col("op"), F.col("bound"), F.col("upper"))).select(
        *keys, "priority", "metric", "value", "message")


def compound_flags(metrics: DataFrame, rules: Sequence[tuple[Sequence[tuple], str]], keys: Sequence[str] = ()) -> DataFrame:
    """Messages of rules over several metrics, all of whose conditions hold: ``(keys, priority, metrics, message)``.

    A rule is ``([(metric, op, bound), …], message)``. A condition on a metric that a key does not have
    does not hold, but for ``missing``, which needs a null value.
    """
    parts = [(i + 1, j, m, op, float(b[0]) if isinstance(b, tuple) else None if b is None else float(b),
              float(b[1]) if isinstance(b, tuple) else None, len(conditions), "|".join(c[0] for c in conditions), message)
             for i, (conditions, message) in enumerate(rules) for j, (m, op, b) in enumerate(conditions)]
    r = F.broadcast(metrics.sparkSession.createDataFrame(
        parts, "priority int, part int, metric string, op string, bound double, upper double, parts int, metrics string, message string"))
    hit = metrics.join(r, "metric").filter(_holds(F.col("value"), F.col("op"), F.col("bound"), F.col("upper")))
    return (hit.groupBy(*keys, "priority", "metrics", "message", "parts").agg(F.count_distinct("part").alias("__held"))
            .filter(F.col("__held") == F.col("parts")).select(*keys, "priority", "metrics", "message"))


def diagnosis(metrics: DataFrame, rules: Sequence[Rule], default: str, keys: Sequence[str] = ()) -> DataFrame:
    """The message of the first rule that holds, or ``default``: one row per key."""
    r = F.broadcast(_rule_table(metrics.sparkSession, rules))
    hit = _holds(F.col("value"), F.col("op"), F.col("bound"), F.col("upper"))
    first = F.min_by(F.when(hit, F.col("message")), F.when(hit, F.col("priority")))
    return metrics.join(r, "metric", "left").groupBy(*keys).agg(
        F.coalesce(first, F.lit(default)).alias("diagnosis"), F.count_if(hit).alias("rules_met"))


def gate(checks: DataFrame, keys: Sequence[str] = (), failed: str = "NO-GO",
         conditional: str = "CONDITIONAL GO", passed: str = "GO") -> DataFrame:
    """Verdict over ``(name, passed, blocking)`` rows.

    A failed (or unknown) blocking check stops; failed others become conditions.
    """
    ok = F.coalesce(F.col("passed"), F.lit(False))
    stop, cond = ~ok & F.col("blocking"), ~ok & ~F.col("blocking")
    status = F.when(F.count_if(stop) > 0, failed).when(F.count_if(cond) > 0, conditional).otherwise(passed)
    return checks.groupBy(*keys).agg(
        status.alias("status"), F.count(F.lit(1)).alias("checks"), F.count_if(ok).alias("passed_checks"),
        F.concat_ws("; ", F.array_sort(F.collect_list(F.when(stop, F.col("name"))))).alias("blocking_failures"),
        F.concat_ws("; ", F.array_sort(F.collect_list(F.when(cond, F.col("name"))))).alias("conditions"))


def metric_checks(metrics: DataFrame, limits: Sequence[tuple], keys: Sequence[str] = ()) -> DataFrame:
    """Checks ``(name, metric, op, bound, blocking)`` over ``(metric, value)`` rows.

    A metric that is absent fails its check.
    """
    rows = [(n, m, op, float(b), bool(k)) for n, m, op, b, k in limits]
    t = metrics.sparkSession.createDataFrame(
        rows, "name string, metric string, op string, bound double, blocking boolean")
    joined = F.broadcast(t).join(metrics, "metric", "left")
    return joined.select(*keys, "name", "metric", "value",
                         _holds(F.col("value"), F.col("op"), F.col("bound"), F.lit(None).cast("double"))
                         .alias("passed"), "blocking")


def evidence_table(metrics: DataFrame, expected: Sequence[tuple]) -> DataFrame:
    """Value against expectation: ``(category, metric, value, expected, tolerance, status)``.

    ``expected`` rows are ``(category, metric, expected, tolerance)``.
    """
    t = metrics.sparkSession.createDataFrame(
        [(c, m, float(e), float(d)) for c, m, e, d in expected],
        "category string, metric string, expected double, tolerance double")
    ok = F.coalesce(F.abs(F.col("value") - F.col("expected")) <= F.col("tolerance"), F.lit(False))
    return t.join(metrics, "metric", "left").select(
        "category", "metric", "value", "expected", "tolerance",
        F.when(ok, "PASS").otherwise("FAIL").alias("status"))


def assessment_table(metrics: DataFrame, texts: Sequence[tuple]) -> DataFrame:
    """Text variant: ``texts`` rows are ``(category, metric, bound, at_or_above, below, impact)``."""
    t = metrics.sparkSession.createDataFrame(
        [(c, m, float(b), hi, lo, i) for c, m, b, hi, lo, i in texts],
        "category string, metric string, bound double, hi string, lo string, impact string")
    text = (F.when(F.col("value").isNull(), "not available").when(F.col("value") >= F.col("bound"), F.col("hi"))
            .otherwise(F.col("lo")))
    return t.join(metrics, "metric", "left").select(
        "category", "metric", "value", text.alias("assessment"), "impact")


def availability_checks(required: Sequence[str], evidence: DataFrame) -> DataFrame:
    """Per required report: found and not empty. ``evidence`` is ``(name, available, rows)``."""
    need = evidence.sparkSession.createDataFrame([(n,) for n in required], "name string")
    found = F.coalesce(F.col("available"), F.lit(False))
    filled = found & (F.coalesce(F.col("rows"), F.lit(0)) > 0)
    return need.join(evidence, "name", "left").select(
        "name", found.alias("exists"), filled.alias("passed"), F.lit(True).alias("blocking"))


def extract_metrics(report: DataFrame, table: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Named metrics from long ``(key, value)`` sources by alias; ``table`` overrides ``report``."""
    rows = [(m, a, i) for m, names in aliases.items() for i, a in enumerate(names)]
    names = report.sparkSession.createDataFrame(rows, "metric string, alias string, preference int")

    def pick(src: DataFrame, out: str) -> DataFrame:
        v = src.select(F.lower(F.trim("key")).alias("alias"), number("value").alias("v")).filter("v IS NOT NULL")
        return v.join(F.broadcast(names), "alias").groupBy("metric").agg(
            F.min_by("v", F.struct("preference", "v")).alias(out))

    base = names.select("metric").distinct()
    return (base.join(pick(report, "__report"), "metric", "left").join(pick(table, "__table"), "metric", "left")
            .select("metric", F.coalesce("__table", "__report").alias("value")))


def validate_scores(scores: DataFrame, source_rows: int | Column, threshold: float, score: str = "p",
                    flag: str = "flag", used_threshold: str = "threshold") -> DataFrame:
    """Named checks of a scored table: complete, finite, in [0, 1], flags consistent."""
    p = quoted(score)
    n = source_rows if isinstance(source_rows, Column) else F.lit(source_rows)
    bad = F.isnan(p) | (F.abs(p) == F.lit(float("inf")))
    same = quoted(flag) == (p >= F.lit(float(threshold))).cast("int")
    checks = {
        "no_null_scores": F.count_if(p.isNull()) == 0,
        "all_finite": F.count_if(bad) == 0,
        "within_unit_interval": F.count_if((p < 0) | (p > 1)) == 0,
        "flag_matches_threshold": F.count_if(~F.coalesce(same, F.lit(False))) == 0,
        "threshold_equal": F.count_if(~within_tolerance(quoted(used_threshold), F.lit(threshold), 1e-12)) == 0,
        "row_count_matches": F.count(F.lit(1)) == n,
    }
    return scores.agg(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("passed"))
                                for k, v in checks.items()]).alias("c")).select(F.inline("c"))


def feature_contract(contract: Sequence[str], table: DataFrame, metadata: Sequence[str], model: Sequence[str]) -> DataFrame:
    """Named checks that metadata, fitted model and table agree with the production features.

    One pass over the table: each feature must be there and have a value in some row; ``detail`` names
    what is amiss. Order and repeats do not matter, other columns of the table are allowed.
    """
    wanted = list(dict.fromkeys(contract))
    there = [c for c in wanted if c in table.columns]
    facts = table.agg(F.count(F.lit(1)).alias("rows"), *[F.count(quoted(c)).alias(f"known_{i}") for i, c in enumerate(there)])

    def differ(names: Sequence[str]) -> str:
        return ", ".join(sorted(set(names) ^ set(wanted)))

    absent = ", ".join(c for c in wanted if c not in table.columns)
    empty = F.concat_ws(", ", *[F.when(F.col(f"known_{i}") == 0, F.lit(c)) for i, c in enumerate(there)])
    details = {"contract_is_distinct": F.lit(", ".join(sorted({c for c in contract if list(contract).count(c) > 1}))),
               "metadata_features_match": F.lit(differ(metadata)), "model_features_match": F.lit(differ(model)),
               "table_has_features": F.lit(absent), "features_have_values": empty,
               "table_has_rows": F.when(F.col("rows") == 0, F.lit("no rows")).otherwise(F.lit(""))}
    return facts.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("check"), (v == "").alias("passed"), v.alias("detail")) for k, v in details.items()])))
