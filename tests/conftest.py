import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("plumbline-tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "4g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def people(spark):
    """300 labelled rows with gaps, ties, negatives, a constant and a rare category."""
    import random
    r = random.Random(7)
    rows = []
    for i in range(300):
        income = r.choice([None, 10.0, 20.0, 20.0, 30.0, r.uniform(-50, 50)])
        age = r.randint(20, 60)
        dept = r.choice(["a", "b", "b", "c", None])
        y = int(r.random() < (0.2 + 0.4 * (dept == "b") + 0.004 * (age - 20)))
        rows.append((i, income, age, 5, dept, "rare" if i == 3 else "usual", y))
    return spark.createDataFrame(
        rows, "id long, income double, age int, fixed int, dept string, tag string, y int")


@pytest.fixture(scope="session")
def scores(spark):
    """Predictions with ties, scores exactly on bin edges and two methods."""
    import random
    r = random.Random(3)
    rows = []
    for i in range(400):
        p = r.choice([0.3, 0.6, 0.7, 1.0, 0.0, round(r.random(), 2)])
        rows.append((i, int(r.random() < p * 0.8 + 0.05), p, "m1" if i % 3 else "m2"))
    return spark.createDataFrame(rows, "id long, y int, p double, method string")
