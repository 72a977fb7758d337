"""Schema and data contracts: column, type, domain, range and consistency checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import (
    as_column, attach_scalars, missing, number, quoted, ratio, require_columns, value_counts,
)

# Accepted spellings of a binary target.
POSITIVE_TOKENS = ("yes", "y", "true", "1", "attrition", "left", "leave", "exited", "exit")
NEGATIVE_TOKENS = ("no", "n", "false", "0", "stay", "stayed", "retained", "remain", "remaining")


def audit_columns(df: DataFrame, expected: Sequence[str], strict: bool = False) -> DataFrame:
    """Compare column names with a contract; ``strict`` raises on any missing column."""
    if strict:
        require_columns(df, expected)
    spark = df.sparkSession
    actual = list(df.columns)
    missing = [c for c in expected if c not in actual]
    unexpected = [c for c in actual if c not in expected]
    row = (len(actual), len(expected), missing, unexpected,
           not missing and not unexpected, actual == list(expected))
    return spark.createDataFrame(
        [row], "actual_count int, expected_count int, missing array<string>, "
               "unexpected array<string>, names_match boolean, order_match boolean")


def audit_schema(df: DataFrame) -> DataFrame:
    """Per column: type, missing and distinct non-null values, and how often its type occurs."""
    cols = df.columns
    types = dict(df.dtypes)
    per_type = {t: list(types.values()).count(t) for t in set(types.values())}
    names = df.sparkSession.createDataFrame(
        [(c, i, types[c], per_type[types[c]], cols.count(c)) for i, c in enumerate(cols)],
        "feature string, position int, data_type string, columns_of_type int, name_count int")
    stats = value_counts(df, cols).groupBy("feature").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("count")).otherwise(0)).alias("missing"),
        F.count("value").alias("unique_values"))
    return names.join(F.broadcast(stats), "feature", "left")  # one row per column of the table


def encode_target_strict(df: DataFrame, col: str, pos: str, neg: str, out: str = "y") -> DataFrame:
    """Map two labels (trimmed, case-insensitive) to 1/0 and fail on any other value."""
    text = F.lower(F.trim(quoted(col).cast("string")))
    bad = F.raise_error(F.concat(F.lit(f"unexpected value in {col}: "),
                                 F.coalesce(quoted(col).cast("string"), F.lit("null"))))
    return df.withColumn(out, F.when(text == pos.strip().lower(), F.lit(1))
                         .when(text == neg.strip().lower(), F.lit(0)).otherwise(bad.cast("int")))


def unexpected_targets(df: DataFrame, col: str, pos: str, neg: str) -> DataFrame:
    """The values a strict encoding would reject, with their counts."""
    text = F.lower(F.trim(quoted(col).cast("string")))
    ok = F.coalesce(text.isin(pos.strip().lower(), neg.strip().lower()), F.lit(False))
    return df.filter(~ok).groupBy(quoted(col).cast("string").alias("value")).count()


def lenient_target(c: str | Column) -> Column:
    """1 / 0 from common spellings, booleans and 0/1 numbers; null for anything else."""
    raw = as_column(c)
    text = F.lower(F.trim(raw.cast("string")))
    num = raw.try_cast("double")
    return (F.when(text.isin(*POSITIVE_TOKENS), 1).when(text.isin(*NEGATIVE_TOKENS), 0)
            .when(num == 1.0, 1).when(num == 0.0, 0))


def encode_target_lenient(df: DataFrame, col: str, out: str = "y") -> DataFrame:
    """Encode a two-valued column: by meaning where both values are understood,
    otherwise the smaller value (as text) becomes 0 and the larger 1.

    Columns with more or fewer than two distinct values encode to null. The mapping
    used is added as ``mapping_method``. The facts needed are three scalars from one
    mergeable aggregation, so no distinct list of values is ever collected.
    """
    text = F.when(~missing(df, col), quoted(col).cast("string"))
    code = F.when(~missing(df, col), lenient_target(quoted(col)))
    facts = df.agg(
        F.min(text).alias("__lo"), F.max(text).alias("__hi"),
        F.min(code).alias("__min_code"), F.max(code).alias("__max_code"),
        F.count_if(code.isNull() & text.isNotNull()).alias("__unknown"))
    two = attach_scalars(df, facts)
    between = df.select(text.alias("__t")).filter(F.col("__t").isNotNull())
    # More than two values exist exactly when some value lies strictly between min and max.
    middle = attach_scalars(between, facts.select("__lo", "__hi")).agg(
        F.count_if((F.col("__t") > F.col("__lo")) & (F.col("__t") < F.col("__hi"))).alias("__middle"))
    two = attach_scalars(two, middle)
    binary = (F.col("__middle") == 0) & (F.col("__lo") < F.col("__hi"))
    semantic = (F.col("__unknown") == 0) & (F.col("__min_code") == 0) & (F.col("__max_code") == 1)
    fallback = F.when(text == F.col("__lo"), 0).when(text == F.col("__hi"), 1)
    return (two.withColumn(out, F.when(binary & semantic, code).when(binary, fallback))
            .withColumn("mapping_method", F.when(~F.coalesce(binary, F.lit(False)), "none")
                        .when(semantic, "semantic").otherwise("sorted_values"))
            .drop("__lo", "__hi", "__min_code", "__max_code", "__unknown", "__middle"))


def feature_matrix(df: DataFrame, cols: Sequence[str], label: str | None = None) -> DataFrame:
    """Only the features (and the label); identifiers and everything else dropped."""
    require_columns(df, cols)
    return df.select(*[quoted(c) for c in cols], *([quoted(label)] if label else []))


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace columns by doubles; text that is no number becomes null."""
    return df.withColumns({c: number(c) for c in cols})


def range_checks(df: DataFrame, nonneg: Sequence[str] = (),
                 ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Count negative values and values outside closed ranges, one row per check."""
    ranges = ranges or {}
    checks = [(c, "negative", number(c) < 0) for c in nonneg]
    checks += [(c, "out_of_range", (number(c) < lo) | (number(c) > hi))
               for c, (lo, hi) in ranges.items()]
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(k).alias("check"),
                              F.count_if(bad).alias("violations")) for c, k, bad in checks])
    return df.agg(rows.alias("r")).select(F.inline("r"))


def domain_checks(df: DataFrame, domains: dict[str, Sequence[str]]) -> DataFrame:
    """Per column: number of observed values, values outside the domain and their rows."""
    allowed = F.create_map(*[x for c, v in domains.items()
                             for x in (F.lit(c), F.array(*[F.lit(a) for a in v]))])
    counts = value_counts(df, list(domains)).filter(F.col("value").isNotNull())
    outside = ~F.array_contains(F.element_at(allowed, F.col("feature")), F.col("value"))
    return counts.groupBy("feature").agg(
        F.count(F.lit(1)).alias("observed_values"),
        F.count_if(outside).alias("unexpected_values"),
        F.sum(F.when(outside, F.col("count")).otherwise(0)).alias("unexpected_rows"),
        F.min(F.when(outside, F.col("value"))).alias("first_unexpected"))


def domain_violations(df: DataFrame, domains: dict[str, Sequence[str]]) -> DataFrame:
    """Every value outside its allowed set, with its row count."""
    allowed = F.create_map(*[x for c, v in domains.items()
                             for x in (F.lit(c), F.array(*[F.lit(a) for a in v]))])
    counts = value_counts(df, list(domains)).filter(F.col("value").isNotNull())
    return counts.filter(~F.array_contains(F.element_at(allowed, F.col("feature")), F.col("value")))


def consistency_rules(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """For rules "left must not exceed right": violations and their rate among full pairs."""
    def one(left: str, right: str) -> Column:
        a, b = number(left), number(right)
        both = F.count_if(a.isNotNull() & b.isNotNull())
        bad = F.count_if(a > b)
        return F.struct(F.lit(f"{left} <= {right}").alias("rule"), both.alias("checked_rows"),
                        bad.alias("violations"), ratio(bad, both, 0.0).alias("violation_rate"))
    return df.agg(F.array(*[one(a, b) for a, b in rules]).alias("r")).select(F.inline("r"))


def filter_impact(df: DataFrame, target: str) -> DataFrame:
    """Rows kept and positive rate after the usual cleaning filters.

    Rows are first reduced to distinct rows with a multiplicity; every figure then
    comes from one aggregation over those, so the table is read once.
    """
    cols = [quoted(c) for c in df.columns]
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    complete = F.lit(True)
    for c in df.columns:
        complete = complete & ~missing(df, c)
    y = lenient_target(target)

    def line(op: str, rows: Column, valid: Column, pos: Column) -> Column:
        return F.struct(F.lit(op).alias("operation"), rows.alias("rows_after"),
                        valid.alias("valid_target_rows"), pos.alias("positives"))

    def figures(op: str, weight: Column) -> Column:
        weight = weight.cast("long")
        return line(op, F.sum(weight), F.sum(F.when(y.isNotNull(), weight).otherwise(0)),
                    F.sum(F.when(y == 1, weight).otherwise(0)))

    n = F.col("__n")
    out = groups.agg(F.sum(n).alias("rows_before"), F.array(
        figures("original", n),
        figures("drop_rows_with_any_missing", F.when(complete, n).otherwise(0)),
        figures("drop_exact_duplicate_rows", F.lit(1)),
        figures("keep_rows_with_valid_target", F.when(y.isNotNull(), n).otherwise(0)),
    ).alias("r"))
    return out.select("rows_before", F.inline("r")).select(
        "operation", "rows_before", "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        (ratio(F.col("rows_after"), F.col("rows_before")) * 100).alias("retained_percent"),
        "valid_target_rows", "positives",
        (ratio(F.col("positives"), F.col("valid_target_rows")) * 100).alias("prevalence_percent"))


def flag_at(df: DataFrame, score: str, threshold: float, out: str = "flag") -> DataFrame:
    return df.withColumn(out, (quoted(score) >= F.lit(float(threshold))).cast("int"))


def pick_row(df: DataFrame, key: str, value: str | float, tol: float = 1e-8,
             contains: bool = False, order: Sequence[str] = ()) -> DataFrame:
    """The first row (by ``order``) whose key matches: text case-insensitively or by
    substring, numbers within ``tol``."""
    if isinstance(value, str):
        text = F.lower(F.trim(quoted(key)))
        want = value.strip().lower()
        hit = text.contains(want) if contains else text == want
    else:
        hit = F.abs(quoted(key) - F.lit(float(value))) <= F.lit(float(tol))
    return df.filter(hit).orderBy(*[quoted(c) for c in (order or [key])]).limit(1)


def within_tolerance(actual: Column, expected: Column, tol: float) -> Column:
    """Null-safe |actual - expected| <= tol; false when either side is missing."""
    return F.coalesce(F.abs(actual - expected) <= F.lit(float(tol)), F.lit(False))


def logistic_risk(df: DataFrame, terms: Sequence[tuple], intercept: float, out: str = "p") -> DataFrame:
    """Additive risk turned into a probability.

    Terms: ``("linear", col, centre, weight)`` adds ``(centre - x) * weight``,
    ``("slope", col, weight)`` adds ``x * weight``, ``("above", col, limit, weight)`` and
    ``("below", col, limit, weight)`` add hinge terms, ``("equals", col, value, weight)``
    adds a bonus for a category.
    """
    risk = F.lit(float(intercept))
    for kind, col, *args in terms:
        if kind == "equals":
            risk = risk + F.when(quoted(col) == args[0], F.lit(float(args[1]))).otherwise(F.lit(0.0))
            continue
        x = number(col)
        if kind == "linear":
            risk = risk + (F.lit(float(args[0])) - x) * F.lit(float(args[1]))
        elif kind == "slope":
            risk = risk + x * F.lit(float(args[0]))
        elif kind == "above":
            risk = risk + F.greatest(x - F.lit(float(args[0])), F.lit(0.0)) * F.lit(float(args[1]))
        elif kind == "below":
            risk = risk + F.greatest(F.lit(float(args[0])) - x, F.lit(0.0)) * F.lit(float(args[1]))
        else:
            raise ValueError(f"unknown term {kind}")
    return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-risk)))


def canonical_checks(df: DataFrame, spec: dict) -> DataFrame:
    """Named checks of a table against a specification, plus an ``all_passed`` row.

    ``spec`` keys: rows, columns, id, target, positive, negative, positives, negatives,
    prevalence (with tolerance), features. Distinct counts come from grouped counts,
    so duplicates of any multiplicity stay partially aggregated.
    """
    target, ident = quoted(spec["target"]).cast("string"), quoted(spec["id"])
    gaps = sum([F.count_if(missing(df, c)) for c in df.columns], F.lit(0))
    base = df.agg(
        F.count(F.lit(1)).alias("rows"), gaps.alias("missing_cells"),
        F.count_if(target == spec["positive"]).alias("pos"),
        F.count_if(target == spec["negative"]).alias("neg"),
        F.count_if(target.isNull()).alias("target_missing"))
    ids = df.groupBy(ident.alias("__id")).count().agg(F.count(F.lit(1)).alias("unique_ids"))
    rows = df.groupBy(*[quoted(c) for c in df.columns]).count().agg(
        F.sum(F.col("count") - 1).alias("duplicate_rows"))
    facts = attach_scalars(attach_scalars(base, ids), rows)
    n = F.col("rows")
    features = spec.get("features", [])
    checks = {
        "expected_rows": n == F.lit(spec["rows"]),
        "expected_columns": F.lit(len(df.columns) == spec["columns"]),
        "target_values_valid": F.col("pos") + F.col("neg") == n - F.col("target_missing"),
        "target_complete": F.col("target_missing") == 0,
        "positive_count": F.col("pos") == F.lit(spec["positives"]),
        "negative_count": F.col("neg") == F.lit(spec["negatives"]),
        "prevalence": within_tolerance(ratio(F.col("pos"), n), F.lit(spec["prevalence"]),
                                       spec.get("prevalence_tolerance", 1e-3)),
        "feature_count": F.lit(all(c in df.columns for c in features)),
        "identifier_unique": F.col("unique_ids") == n,
        "no_missing_cells": F.col("missing_cells") == 0,
        "no_duplicate_rows": F.coalesce(F.col("duplicate_rows"), F.lit(0)) == 0,
    }
    everything = F.lit(True)
    for c in checks.values():
        everything = everything & c
    structs = [F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in checks.items()]
    structs.append(F.struct(F.lit("all_passed").alias("check"), everything.alias("passed")))
    return facts.select(F.inline(F.array(*structs)))
