from pyspark.sql import functions as F

from tessella.llm import ann


def test_each_length_has_neighbours(spark):
    rows = [(i, [1.0, float(i), 0.0]) for i in range(6)] + [(10, [1.0, 0.0]), (11, [1.0, 0.1]), (12, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [1, 2, 3, 4, 5], 10: [11, 12]}
