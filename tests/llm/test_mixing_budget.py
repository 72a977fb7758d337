import numpy as np
import pytest

from plumbline.llm import mixing


def corpus(spark, tiny):
    """Cells of 2000 to 30,000 tokens; with ``tiny``, also one of two tokens in a source of its own."""
    rng = np.random.default_rng(5)
    rows = [(i, "abcd"[min(i % 13, 3)], "xyz"[i % 3], int(rng.integers(5, 60))) for i in range(6000)]
    return spark.createDataFrame(rows + [(6000, "tiny", "q", 2)] * tiny, "doc_id long, s string, l string, n long")


def mixed(df, **more):
    out = mixing.sample_to_targets(df, ["s", "l"], "doc_id", "n", power=0.7, rounds=8, **more).toPandas()
    return out, out.groupby(["s", "l"]).agg(tokens=("n", "sum"), p=("probability", "first"), rows=("n", "size"))


@pytest.mark.parametrize("budget", [0.1, 0.5, 0.9, 0.999, 1.0])
def test_budget_is_kept_whatever_the_smallest_cell(spark, budget):
    for tiny in (0, 1):
        out, cells = mixed(corpus(spark, tiny), budget=budget)
        assert len(out) == 6000 + tiny
        assert abs((cells.p * cells.tokens).sum() / cells.tokens.sum() - budget) < 1e-5
        assert abs(out[out.kept].n.sum() / out.n.sum() - budget) < 0.03
        assert cells.p.max() <= 1 and cells.p.min() > 0


def test_cells_below_the_cap_keep_the_fitted_shares(spark):
    df = corpus(spark, 1)
    _, cells = mixed(df, budget=0.6)
    _, shares = mixed(df)
    cells = cells.join(shares.p.rename("plain"))
    assert cells.p["tiny", "q"] == 1
    free = cells[cells.p < 1]
    ratio = free.p / free.plain
    assert 1 < len(free) and np.allclose(ratio, ratio.iloc[0], rtol=1e-3)
    assert ratio.iloc[0] > 1.5 and all(cells[cells.p == 1].plain * ratio.iloc[0] > 0.999)


def test_budget_with_values_without_target(spark):
    df = corpus(spark, 1)
    goal = {"s": spark.createDataFrame([("a", 0.5), ("d", 0.5)], "s string, target double"),
            "l": spark.createDataFrame([(v, 1 / 3) for v in "xyz"], "l string, target double")}
    for budget in (0.05, 0.9):
        out = mixing.sample_to_targets(df, ["s", "l"], "doc_id", "n", goal, budget=budget).toPandas()
        known = out.s.isin(["a", "d"])
        assert (out[~known].probability == 0).all()
        mass = (out.probability * out.n).sum()
        assert abs(mass - min(budget * out.n.sum(), out[known].n.sum())) < 1e-4 * out.n.sum()
    assert mixing.sample_to_targets(df.limit(0), ["s", "l"], "doc_id", "n", budget=0.5).count() == 0
    with pytest.raises(ValueError):
        mixing.sample_to_targets(df, ["s", "l"], "doc_id", "n", budget=1.5)


def test_steps_remove_the_tables_of_the_step_before(spark):
    """Tables held inside a step go when the next one begins; others stay; long words are not cached."""
    from plumbline.llm.common import LONGEST_KEPT, WordIds, hold, own_tables
    outside = hold(spark.range(3))
    with own_tables(spark, "step"):
        inside = hold(spark.range(4))
        assert inside.count() == 4
    path = inside.inputFiles()[0].rsplit("/", 1)[0]
    with own_tables(spark, "step"):
        assert hold(spark.range(5)).count() == 5
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    assert outside.count() == 3
    ids = WordIds()
    assert len(set(ids.of(["a", "b" * LONGEST_KEPT, "b" * LONGEST_KEPT + "c"]).tolist())) == 3 and len(ids) == 2
