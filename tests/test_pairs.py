"""Pairs inside groups come in tiles: all of them, and a large group is the work of many tasks."""

from pyspark.sql import functions as F

from readlake.operators import match


def test_all_pairs_of_each_group(spark):
    rows = [(k % 3 if k % 11 else None, (k * 37) % 101, float(k % 7)) for k in range(101)] + [(1, 5, 0.0), (1, None, 1.0)]
    df = spark.createDataFrame(rows, "label int, id long, x double")
    got = match.group_pairs(df, "label", "id", F.col("x") > 3, 2, tile=8, most=100)
    want = sorted((g, a, x, b, y) for g, a, x in rows for h, b, y in rows if g is not None and g == h and None not in (a, b) and a < b)
    assert sorted((r["label"], r["x_id"], r["x_x"], r["y_id"], r["y_x"]) for r in got.collect()) == want


def test_one_group_is_many_tasks(spark, tmp_path):
    from readlake.plans import catalogue

    n = 1500
    vectors = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: (F.sin(F.col("vec_id") * k) / 8).cast("float"))
    spark.range(n).toDF("vec_id").select("vec_id", vectors.alias("embedding"), F.lit(1).alias("label")).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    sizes = [r["n"] for r in catalogue.pair_weights(spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == n * (n - 1) // 2
    assert max(sizes) < sum(sizes)
