"""Scalar functions on maps, vector clocks, versions and addresses, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Release kinds from the earliest to the latest; none at all ranks above them.
RELEASES = ("entrypoint", "alpha", "beta", "rc")


def vclock_compare(left: Column, right: Column) -> Column:
    """1, 0 or -1 of two map<int, bigint> clocks, null if neither is ahead. Components of `left` from 1 up to its first
    gap count; what `right` lacks is 0, and what it alone has is ignored."""
    # the first gap is at most one beyond the size
    span = F.filter(F.sequence(F.lit(1), F.size(left) + 1), lambda i: F.try_element_at(left, i).isNull())
    ids = F.slice(F.sequence(F.lit(1), F.size(left) + 1), F.lit(1), F.array_min(span) - 1)
    l = lambda i: F.try_element_at(left, i)  # noqa: E731, E741
    r = lambda i: F.coalesce(F.try_element_at(right, i), F.lit(0))
    more, less = F.exists(ids, lambda i: l(i) > r(i)), F.exists(ids, lambda i: l(i) < r(i))
    return F.when(more & less, F.lit(None).cast("int")).when(more, 1).when(less, -1).otherwise(0)


def version_parse(text: Column) -> Column:
    """struct<major, middle, minor, release, number, commits> of `x.y.z[-kind[n]][-commits...]`; its order is the versions'
    order. Null where the text has no three numbers. `release` is the rank of the kind, 99 without one."""
    num = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("bigint"), F.lit(0))
    kind = F.regexp_extract(text, r"^\d+\.\d+\.\d+[^-]*-([A-Za-z]+)", 1)
    rank = F.when(kind == "", F.lit(99))
    for i, k in enumerate(RELEASES):
        rank = rank.when(kind == k, F.lit(i + 1))
    commits = F.when(kind == "", num(r"^\d+\.\d+\.\d+[^-]*-(\d+)")).otherwise(num(r"^\d+\.\d+\.\d+[^-]*-[A-Za-z]+\d*[^-]*-(\d+)"))
    parts = F.struct(
        num(r"^(\d+)").alias("major"), num(r"^\d+\.(\d+)").alias("middle"), num(r"^\d+\.\d+\.(\d+)").alias("minor"),
        rank.otherwise(F.lit(0)).alias("release"), num(r"^\d+\.\d+\.\d+[^-]*-[A-Za-z]+(\d+)").alias("number"), commits.alias("commits"),
    )
    return F.when(text.rlike(r"^\d+\.\d+\.\d+"), parts)


def version_compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1."""
    a, b = version_parse(left), version_parse(right)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def schema_version(text: Column) -> Column:
    """Four numbers of a schema version as a comparable array."""
    return F.transform(F.split(text, r"\."), lambda x: x.cast("int"))


def map_minus(left: Column, right: Column) -> Column:
    """left without the entries that right has with an equal value."""
    return F.map_filter(left, lambda k, v: ~F.coalesce(F.try_element_at(right, k).eqNullSafe(v), F.lit(False)))


def copied(m: Column) -> Column:
    """A map with the entries of m; null for null."""
    return F.map_from_entries(F.map_entries(m))


def extended(left: Column, right: Column) -> Column:
    """left with the items of right behind its own."""
    return F.concat(left, right)


def is_numeric_table(keys: Column) -> Column:
    """Whether the first key of an array of string keys is a number (an empty table is not)."""
    return F.coalesce(F.try_element_at(keys, F.lit(1)).rlike(r"^-?\d+(\.\d+)?$"), F.lit(False))


def safe_uri(uri: Column) -> Column:
    """A connection address without its password."""
    return F.regexp_replace(uri, r"^([^:@/]*):[^@/]*@", "$1@")


def uri_equal(left: Column, right: Column) -> Column:
    """Whether two addresses agree apart from what follows a question mark."""
    plain = lambda u: F.regexp_replace(u, r"\?.*$", "")
    return plain(left).eqNullSafe(plain(right))


def deep_equal(left: Column, right: Column) -> Column:
    """Null-safe equality, nested fields included."""
    return left.eqNullSafe(right)
