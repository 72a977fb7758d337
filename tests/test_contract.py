import pytest
from pyspark.sql import functions as F

from plumbline.operators import contract, text


def col(df, k, v):
    return {r[k]: r[v] for r in df.collect()}


def test_audit_columns(people):
    r = contract.audit_columns(people, ["id", "age", "salary"]).first()
    assert r.missing == ["salary"] and "income" in r.unexpected and not r.names_match
    with pytest.raises(ValueError, match="salary"):
        contract.audit_columns(people, ["salary"], strict=True)


def test_strict_target(spark):
    ok = spark.createDataFrame([(" Yes ",), ("NO",)], "t string")
    assert [r.y for r in contract.encode_target_strict(ok, "t", "yes", "no").collect()] == [1, 0]
    for bad in ("maybe", None):
        df = spark.createDataFrame([("yes",), (bad,)], "t string")
        with pytest.raises(Exception, match="unexpected value"):
            contract.encode_target_strict(df, "t", "yes", "no").collect()
    assert contract.unexpected_targets(spark.createDataFrame([("maybe",), (None,), ("no",)], "t string"),
                                       "t", "yes", "no").count() == 2


@pytest.mark.parametrize("values, expected, method", [
    (["yes", " No "], [1, 0], "semantic"), (["1", "0", None], [1, 0, None], "semantic"),
    (["LEFT", "stayed"], [1, 0], "semantic"), (["red", "blue"], [1, 0], "sorted_values"),
    (["yes", "no", "maybe"], [None] * 3, "none"), (["yes", "yes"], [None] * 2, "none")])
def test_lenient_target(spark, values, expected, method):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    rows = contract.encode_target_lenient(df, "t").orderBy("i").collect()
    assert [r.y for r in rows] == expected and {r.mapping_method for r in rows} == {method}


def test_lenient_target_numbers_and_booleans(spark):
    nums = spark.createDataFrame([(1.0,), (0.0,)], "t double")
    assert [r.y for r in contract.encode_target_lenient(nums, "t").collect()] == [1, 0]
    flags = spark.createDataFrame([(True,), (False,)], "t boolean")
    assert [r.y for r in contract.encode_target_lenient(flags, "t").collect()] == [1, 0]


def test_ranges_domains_and_rules(spark, people):
    pdf = people.toPandas()
    got = {(r.feature, r.check): r.violations for r in
           contract.range_checks(people, ["income"], {"age": (25, 50)}).collect()}
    assert got == {("income", "negative"): (pdf.income < 0).sum(),
                   ("age", "out_of_range"): ((pdf.age < 25) | (pdf.age > 50)).sum()}
    r = contract.domain_checks(people, {"dept": ["a", "b"], "tag": ["usual", "rare"]}).orderBy("feature").collect()
    assert (r[0].observed_values, r[0].unexpected_values, r[0].first_unexpected) == (3, 1, "c")
    assert (r[1].unexpected_values, r[1].unexpected_rows) == (0, 0)
    t = contract.consistency_rules(people, [("age", "income")]).first()
    both = pdf.dropna(subset=["income"])
    assert (t.checked_rows, t.violations) == (len(both), (both.age > both.income).sum())


def test_filter_impact(spark):
    df = spark.createDataFrame([("yes", 1.0), ("yes", 1.0), ("yes", 1.0), ("no", None), ("maybe", float("nan")), (None, 2.0)],
                               "t string, x double")
    got = {r.operation: r for r in contract.filter_impact(df, "t").collect()}
    assert [got[k].rows_after for k in ("original", "drop_rows_with_any_missing", "drop_exact_duplicate_rows",
                                        "keep_rows_with_valid_target")] == [6, 3, 4, 4]
    assert got["drop_exact_duplicate_rows"].prevalence_percent == 50.0
    assert got["original"].valid_target_rows == 4 and got["original"].prevalence_percent == 75.0


def test_pick_row_and_tolerance(spark):
    df = spark.createDataFrame([("Random Forest", 0.44, 1), ("Sigmoid Calibration", 0.25, 2)], "method string, threshold double, v int")
    assert contract.pick_row(df, "method", "random forest").first().v == 1
    assert contract.pick_row(df, "method", "sigmoid", contains=True).first().v == 2
    assert contract.pick_row(df, "threshold", 0.25 + 5e-9).first().v == 2
    assert contract.pick_row(df, "threshold", 0.26).count() == 0
    r = spark.createDataFrame([(1.0, 1.05), (None, 1.0)], "a double, b double").select(
        contract.within_tolerance(F.col("a"), F.col("b"), 0.1).alias("ok")).collect()
    assert [x.ok for x in r] == [True, False]


def test_logistic_risk_terms(spark):
    df = spark.createDataFrame([(4.0, "x"), (1.0, "z")], "a double, c string")
    terms = [("linear", "a", 3, 0.5), ("slope", "a", 0.1), ("above", "a", 2, 0.2), ("below", "a", 2, 0.3), ("equals", "c", "x", 1.0)]
    import math
    want = [1 / (1 + math.exp(-(-1 - 0.5 + 0.4 + 0.4 + 0 + 1))), 1 / (1 + math.exp(-(-1 + 1.0 + 0.1 + 0 + 0.3 + 0)))]
    assert [r.p for r in contract.logistic_risk(df, terms, -1).collect()] == pytest.approx(want)


def test_canonical_checks(spark, people):
    pdf = people.toPandas()
    spec = {"rows": 300, "columns": 7, "id": "id", "target": "y", "positive": "1", "negative": "0", "positives": int(pdf.y.sum()),
            "negatives": int((pdf.y == 0).sum()), "prevalence": float(pdf.y.mean()), "features": ["age"]}
    got = col(contract.canonical_checks(people, spec), "check", "passed")
    assert not got["no_missing_cells"] and not got["all_passed"]
    assert all(v for k, v in got.items() if k not in ("no_missing_cells", "all_passed"))
    clean = people.na.fill(0.0, ["income"]).na.fill("none", ["dept"])
    assert col(contract.canonical_checks(clean, spec), "check", "passed")["all_passed"]


def test_text_scan_and_replace(spark):
    df = spark.createDataFrame([(1, "a old.csv\n none\nold.csv old.csv "), (2, "nothing"), (3, None)], "id int, t string")
    got = [(r.id, r.line_number, r.hits, r.content) for r in
           text.scan_text(df, "t", {"old": r"old\.csv"}, ["id"]).orderBy("line_number").collect()]
    assert got == [(1, 1, 1, "a old.csv"), (1, 3, 2, "old.csv old.csv")]
    r = {x.id: (x.status, x.replacements) for x in text.replace_text(df, "t", r"old\.csv", "new.csv").collect()}
    assert r == {1: ("updated", 3), 2: ("already_canonical", 0), 3: ("missing", 0)}


def test_nan_is_missing_everywhere(spark):
    from plumbline.operators import contract, profile
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, float("nan")), (4, None)], "id long, y double")
    codes = {r.id: (r.t, r.mapping_method) for r in contract.encode_target_lenient(df, "y", "t").collect()}
    assert codes == {1: (0, "semantic"), 2: (1, "semantic"), 3: (None, "semantic"), 4: (None, "semantic")}
    assert profile.table_structure(df, "id").first().missing_cells == 2
    assert {r.feature: r.missing for r in profile.missingness(df).collect()} == {"id": 0, "y": 2}
    assert profile.missing_rows(df).first().rows_with_any_missing == 2
