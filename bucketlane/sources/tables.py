"""Tables laid out by bucket: joins and aggregations on the bucket column need no shuffle, and one bucket's rows lie in
one file of each writing task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: With this at false, a table dealt by bucket_id alone also serves joins on bucket_id and further keys.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def save(df: DataFrame, name: str, files: int, column: str = "bucket_id", path: str | None = None) -> None:
    """Saves a sharded table in `files` hash files of its bucket column, sorted by it. Tables that are joined take the same
    number of files."""
    writer = df.repartition(files, column).write.bucketBy(files, column).sortBy(column).mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def colocated(spark: SparkSession, left: str, right: str, keys: list[str], column: str = "bucket_id") -> DataFrame:
    """Inner join of two saved tables on the bucket column and keys, within each bucket file. It's planned in a session of its
    own, where CO_PARTITION is false; plans of the given session stay as they are."""
    own = spark.newSession()
    for option in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(option, spark.conf.get(option))
    own.conf.set(CO_PARTITION, "false")
    return own.table(left).hint("merge").join(own.table(right), [column, *keys])
