from skarn.sources.reading import spread


def test_small_scans_are_spread_and_others_left(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    dealt = spread(one)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r["id"] for r in dealt.collect()) == list(range(100))
    assert spread(dealt.sparkSession.range(0, 10, 1, 9)).rdd.getNumPartitions() == 9
