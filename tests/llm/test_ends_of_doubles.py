from pyspark.sql import functions as F

from dirlake.llm import embed_neardup
from dirlake.llm.common import running_sums


def test_vectors_at_the_ends_of_doubles(spark):
    rows = [(0, [1e300, 1e300], 1), (1, [1.0, 1.0], 1), (2, [1e-300, 1e-300], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (5, [1e300, 1e-300], 1), (6, [5e-324, 0.0], 1), (7, [1.7e308, -1.7e308], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_neardup.near_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert got == {**{k: (2, 0, k == 0) for k in (0, 1, 2)}, **{k: (3, 3, k == 3) for k in (3, 4, 5, 6)}, 7: (0, 7, True)}


def test_sorted_rows_go_with_the_session(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id", F.lit(1).cast("bigint").alias("v"))
    got = running_sums(df, "k", ["id"], ["v"], 4, upto=True)
    assert {(r["k"], r["id"]): (r["v_before"], r["v_upto"]) for r in got.collect()} == {(i % 3, i): (i // 3, i // 3 + 1) for i in range(100)}
