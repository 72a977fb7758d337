import pytest
from pyspark.sql import functions as F

from plumbline.llm import queries, topk


def test_wider_vectors_are_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, None), (3, [-1.0] * 64)], "vec_id long, embedding array<float>")
    assert [r[0] for r in df.select(topk.sign_code(F.col("embedding"), whole=True)).collect()] == [-1, None, 0]
    wide = df.union(spark.createDataFrame([(4, [1.0] * 65)], df.schema))
    with pytest.raises(Exception, match="more than 64 components"):
        wide.select(topk.sign_code(F.col("embedding"), whole=True)).collect()
    wide.write.parquet(f"{tmp_path}/embeddings.parquet")
    with pytest.raises(Exception, match="more than 64 components"):
        queries.top_k_query(spark, str(tmp_path)).collect()
