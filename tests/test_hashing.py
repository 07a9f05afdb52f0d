import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bucketlane.functions import hashing as H


# Bucket ids of 3000 for known keys.
@pytest.mark.parametrize("key, text, packed", [(1, 477, 1614), ("1", 477, 477), ("1LL", 730, 730), ("1ULL", 982, 982)])
def test_goldens(key, text, packed):
    assert H.literal_bucket_id(key) == text
    assert H.literal_bucket_id(key, packed=True) == packed


def test_packed_goldens():
    assert H.crc_of(bytes.fromhex("cb3ff0000000000000")) % 3000 + 1 == 1411
    assert H.crc_of(bytes.fromhex("ca3f800000")) % 3000 + 1 == 193
    assert H.crc_of(bytes.fromhex("d501001c")) % 3000 + 1 == 1696
    assert H.literal_bucket_id("héé") == 1194


def test_integers_take_the_shortest_form():
    got = {n: H.packed_of(n).hex() for n in (0, 127, 128, 255, 256, 65535, 65536, 1 << 32, -1, -32, -33, -128, -129, -32768, -32769, -(1 << 31) - 1)}
    assert got[127] == "7f" and got[128] == "cc80" and got[256] == "cd0100" and got[65536] == "ce00010000" and got[1 << 32] == "cf0000000100000000"
    assert got[-1] == "ff" and got[-32] == "e0" and got[-33] == "d0df" and got[-129] == "d1ff7f" and got[-32769] == "d2ffff7fff" and got[-(1 << 31) - 1] == "d3ffffffff7fffffff"


def test_columns_equal_literals(spark):
    numbers = [0, 1, 127, 128, 255, 256, 65535, 65536, 1 << 32, -1, -32, -33, -128, -129, -32768, -32769, -(1 << 31), -(1 << 31) - 1, (1 << 63) - 1, -(1 << 63)]
    df = spark.createDataFrame(pd.DataFrame({"n": numbers, "s": [f"k{n}é" for n in numbers]}))
    got = df.select("n", "s", H.bucket_id_strcrc32("n").alias("a"), H.bucket_id_mpcrc32("n", schema=df.schema).alias("b"), H.bucket_id_strcrc32("s").alias("c"), H.bucket_id_strcrc32("s", "n").alias("d")).collect()
    for r in got:
        assert (r.a, r.b, r.c, r.d) == (H.literal_bucket_id(r.n), H.literal_bucket_id(r.n, packed=True), H.literal_bucket_id(r.s), H.literal_bucket_id([r.s, r.n]))


def test_empty_null_and_parts(spark):
    df = spark.createDataFrame([("", None), ("1", "23"), ("12", "3"), (None, "x")], "a string, b string")
    got = [r.b for r in df.select(H.bucket_id_strcrc32("a", "b").alias("b")).collect()]
    assert got[0] == H.literal_bucket_id("") and got[1] == got[2] and got[3] is None
    with pytest.raises(ValueError):
        H.literal_bucket_id(None)


def test_whole_doubles_hash_as_integers(spark):
    df = spark.createDataFrame([(1.0, True)], T.StructType([T.StructField("x", T.DoubleType()), T.StructField("t", T.BooleanType())]))
    row = df.select(H.bucket_id_mpcrc32("x", schema=df.schema).alias("p"), H.bucket_id_strcrc32("x", schema=df.schema).alias("s"), H.bucket_id_mpcrc32("t", schema=df.schema).alias("t")).first()
    assert row.p == 1614 and row.s == 477 and row.t == H.literal_bucket_id(True, packed=True)
    assert F is not None
