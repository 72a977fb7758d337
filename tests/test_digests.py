"""Digests of many seeds worked out in blocks, against hashlib and the expression for one seed."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.functions import digests
from plumbline.operators import splits


def test_positions_are_those_of_hashlib(monkeypatch):
    texts = [f"-{i}" for i in range(0, 3000, 7)] + ["", "-" + "x" * 51, "-" + "x" * 52, "-" + "x" * 53, "-é" + "y" * 90]
    prefixes = [b"42", b"7", b"100"]
    plain = np.array([[(int(hashlib.md5(p + t.encode()).hexdigest()[:15], 16) - (1 << 59)) * 16 for p in prefixes] for t in texts])
    for rows in (16384, 100, 1):
        monkeypatch.setattr(digests, "BLOCK_ROWS", rows)
        assert np.array_equal(digests.positions(pa.array(texts), prefixes), plain)
    assert np.array_equal(digests.positions(pa.array(texts).slice(30, 50), prefixes), plain[30:80])
    assert digests.positions(pa.array([], pa.string()), prefixes).shape == (0, 3)


def test_many_holdouts_take_the_blocks(spark):
    """Keys of two columns with gaps; ``portable_position`` isn't worked out per seed any more."""
    df = spark.range(90).select(F.when(F.col("id") % 9 > 0, F.col("id")).alias("a"), F.concat(F.lit("k"), (F.col("id") % 4).cast("string")).alias("b"),
                                (F.col("id") % 3 == 0).cast("int").alias("y"))
    plain = df.select("a", "b", "y", F.posexplode(F.array(*[splits.portable_position(["a", "b"], 42 + i) for i in range(8)])).alias("split", "pos")).collect()
    found = splits.repeated_holdout(df, "y", ["a", "b"], 8, 0.3, portable=True)
    assert "md5" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.columns == ["a", "b", "y", "split", "is_holdout"]
    want = []
    for split in range(8):
        for y in (0, 1):
            mine = sorted((r for r in plain if r["split"] == split and r["y"] == y), key=lambda r: r["pos"])
            last = mine[int(np.floor(len(mine) * 0.3 + 0.5)) - 1]["pos"]
            want += [(str(r["a"]), r["b"], y, split, r["pos"] <= last) for r in mine]
    assert sorted((str(r["a"]), r["b"], r["y"], r["split"], r["is_holdout"]) for r in found.collect()) == sorted(want)
