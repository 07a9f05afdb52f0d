from pyspark.sql import functions as F

from bucketlane.functions.hashing import bucket_id_strcrc32
from bucketlane.sources import tables
from tests.conftest import SMALL


def test_colocated_join_has_no_exchange(spark, tmp_path):
    c = spark.read.parquet(f"{SMALL}/customer.parquet").select(F.col("c_custkey").alias("k"), bucket_id_strcrc32("c_custkey").alias("bucket_id"))
    o = spark.read.parquet(f"{SMALL}/orders.parquet").select(F.col("o_custkey").alias("k"), "o_orderkey", bucket_id_strcrc32("o_custkey").alias("bucket_id"))
    tables.save(c, "t_customers", 4, path=str(tmp_path / "c"))
    tables.save(o, "t_orders", 4, path=str(tmp_path / "o"))
    try:
        got = tables.colocated(spark, "t_customers", "t_orders", ["k"])
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.count() == c.join(o, ["bucket_id", "k"]).count() > 0
        assert spark.conf.get(tables.CO_PARTITION) == "true"  # other plans stay as they are
    finally:
        spark.sql("drop table t_customers")
        spark.sql("drop table t_orders")
