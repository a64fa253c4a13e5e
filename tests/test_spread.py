from __future__ import annotations

from corpusmill.functions.spread import spread


def test_small_inputs_are_spread_and_large_ones_left(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "small"))
    small = spark.read.parquet(str(tmp_path / "small"))
    assert spread(small).rdd.getNumPartitions() == cores
    spark.range(2_000_000).selectExpr("id", "uuid() as u").write.parquet(str(tmp_path / "large"))
    large = spark.read.parquet(str(tmp_path / "large"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "65536")
    try:
        assert spread(large) is large and spread(large.where("id > 5").select("u").limit(3)) is not None
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
