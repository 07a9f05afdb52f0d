"""Bucket-partitioned analytics on PySpark: placement, bucket-bound calls, map-reduce and rebalancing as DataFrames."""
