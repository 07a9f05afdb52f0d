"""Bucket ids: CRC-32C (reflected polynomial, start of all ones, no final inversion) of key bytes, modulo bucket count.

Two key forms: the text of the key (``strcrc32``) and its MessagePack bytes (``mpcrc32``; strings are hashed raw). Keys of
several parts are the bytes of their parts in a row, up to the first null. All of it is JVM-side: columns only, no UDF.
``crc_of``, ``text_of`` and ``packed_of`` are the driver's twins for literal keys, so filters get plain constants.
"""

from __future__ import annotations

import struct
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLYNOMIAL, START = 0x82F63B78, 0xFFFFFFFF
BUCKET_COUNT = 3000


def table() -> list[int]:
    """The 256 steps of the polynomial."""
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (POLYNOMIAL if i & 1 else 0)
        out.append(i)
    return out


_TABLE = table()


def crc_of(data: bytes) -> int:
    c = START
    for b in data:
        c = (c >> 8) ^ _TABLE[(c ^ b) & 255]
    return c


def text_of(key) -> bytes:
    """Bytes of a literal key (or a list of parts) for strcrc32."""
    if isinstance(key, (list, tuple)):
        parts = key[: key.index(None)] if None in key else key
        return b"".join(text_of(k) for k in parts)
    if key is None:
        raise ValueError("a key can't be null")
    if isinstance(key, bool):
        return b"true" if key else b"false"
    if isinstance(key, float):
        return (str(int(key)) if key.is_integer() and abs(key) < 1e14 else f"{key:.14g}").encode()
    return key if isinstance(key, bytes) else str(key).encode()


def packed_of(key) -> bytes:
    """Bytes of a literal key for mpcrc32: shortest integers, doubles that are whole as integers, strings raw."""
    if isinstance(key, (list, tuple)):
        parts = key[: key.index(None)] if None in key else key
        return b"".join(packed_of(k) for k in parts)
    if isinstance(key, str):
        return key.encode()
    if isinstance(key, bytes):
        return key
    if isinstance(key, bool):
        return b"\xc3" if key else b"\xc2"
    if key is None:
        return b"\xc0"
    if isinstance(key, (float, Decimal)):
        if key == int(key) and abs(key) < 1 << 63:
            return packed_of(int(key))
        return b"\xcb" + struct.pack(">d", key)
    for low, high, head, form in _INTEGERS:
        if low <= key <= high:
            return head + (struct.pack(form, key) if form else struct.pack(">b", key) if key < 0 else bytes([key]))
    raise ValueError(f"{key} has no integer form")


#: Integer forms in order of preference: range, head byte, layout.
_INTEGERS = [
    (0, 127, b"", ""), (-32, -1, b"", ""), (128, 255, b"\xcc", ">B"), (256, 65535, b"\xcd", ">H"), (65536, (1 << 32) - 1, b"\xce", ">I"),
    (1 << 32, (1 << 64) - 1, b"\xcf", ">Q"), (-128, -33, b"\xd0", ">b"), (-32768, -129, b"\xd1", ">h"), (-(1 << 31), -32769, b"\xd2", ">i"), (-(1 << 63), -(1 << 31) - 1, b"\xd3", ">q"),
]


def crc32c(data: Column) -> Column:
    """CRC of a binary column as long; null for null. Steps over the bytes with the table as a literal array."""
    steps = F.lit(_TABLE).cast("array<bigint>")
    each = F.decode(data, "ISO-8859-1")  # a character for each byte
    byte = lambda i: F.ascii(F.substr(each, i, F.lit(1))).cast("bigint")
    walk = F.aggregate(
        F.sequence(F.lit(1), F.octet_length(data)), F.lit(START).cast("bigint"),
        lambda c, i: F.shiftrightunsigned(c, 8).bitwiseXOR(F.element_at(steps, (c.bitwiseXOR(byte(i)).bitwiseAND(F.lit(255)) + 1).cast("int"))),
    )
    return F.when(F.octet_length(data) == 0, F.lit(START).cast("bigint")).otherwise(walk)


def _text(c: Column, kind: T.DataType | None) -> Column:
    if isinstance(kind, T.BinaryType):
        return c
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e14)
        return F.when(whole, F.floor(c).cast("string")).otherwise(c.cast("string")).cast("binary")
    return c.cast("string").cast("binary")


def _hex(n: Column, bytes_: int) -> Column:
    return F.substr(F.lpad(F.hex(n), 16, "0"), F.lit(17 - 2 * bytes_), F.lit(2 * bytes_))


def _packed_long(n: Column) -> Column:
    """MessagePack bytes of a bigint in its shortest form."""
    form = F.when(n.between(-32, 127), _hex(n, 1))
    for low, high, head, size in ((128, 255, "CC", 1), (256, 65535, "CD", 2), (65536, (1 << 32) - 1, "CE", 4), (1 << 32, (1 << 63) - 1, "CF", 8), (-128, -33, "D0", 1), (-32768, -129, "D1", 2), (-(1 << 31), -32769, "D2", 4)):
        form = form.when(n.between(low, high), F.concat(F.lit(head), _hex(n, size)))
    return F.unhex(form.otherwise(F.concat(F.lit("D3"), _hex(n, 8))))


def double_bits(d: Column) -> Column:
    """The IEEE 754 bits of a double as a bigint. Scaling by powers of two is exact, so sign, exponent and fraction come apart
    without loss; the logarithm may be off by one near powers of two and is mended."""
    x = F.abs(d)
    small = x < float.fromhex("0x1p-1022")  # subnormal: no leading one
    guess = F.floor(F.log2(x)).cast("int")
    scale = lambda e: x * F.pow(F.lit(2.0), -F.floor(e / 2)) * F.pow(F.lit(2.0), -(e - F.floor(e / 2)))
    e = F.when(scale(guess) >= 2, guess + 1).when(scale(guess) < 1, guess - 1).otherwise(guess)
    fraction = ((scale(e) - 1) * float(1 << 52)).cast("bigint")
    normal = F.shiftleft((e + 1023).cast("bigint"), 52) + fraction
    under = (x * float.fromhex("0x1p537") * float.fromhex("0x1p537")).cast("bigint")
    inf = F.lit(0x7FF << 52).cast("bigint")
    bits = F.when(F.isnan(d), F.lit(0x7FF8 << 48).cast("bigint")).when(x == float("inf"), inf).when(x == 0, F.lit(0).cast("bigint")).when(small, under).otherwise(normal)
    negative = (d < 0) | ((d == 0) & (d.cast("string") == "-0.0"))
    return F.when(negative, bits.bitwiseOR(F.lit(-(1 << 63)).cast("bigint"))).otherwise(bits)


def _packed(c: Column, kind: T.DataType | None) -> Column:
    if kind is None or isinstance(kind, (T.StringType, T.BinaryType)):
        return c.cast("binary")
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.unhex(F.lit("C3"))).otherwise(F.unhex(F.lit("C2")))
    if isinstance(kind, T.IntegralType):
        return _packed_long(c.cast("bigint"))
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < float(1 << 63))
        return F.when(whole, _packed_long(d.cast("bigint"))).otherwise(F.unhex(F.concat(F.lit("CB"), _hex(double_bits(d), 8))))
    raise TypeError(f"keys of type {kind} have no packed form")


def key_parts(keys: list) -> list[Column]:
    """The columns of a sharding key, by name or as they are."""
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def _parts(form, columns: tuple[Column, ...], kinds) -> Column:
    """Bytes of the parts up to the first null; null if the first part is null."""
    parts = [form(c, k) for c, k in zip(columns, kinds)]
    if len(parts) == 1:
        return parts[0]
    out, live = parts[0], columns[0].isNotNull()
    for c, p in zip(columns[1:], parts[1:]):
        live = live & c.isNotNull()
        out = F.when(live, F.concat(out, p)).otherwise(out)
    return out


def _kinds(columns, schema: T.StructType | None, names) -> list:
    return [schema[n].dataType if schema is not None and isinstance(n, str) else None for n in names]


def bucket_id_strcrc32(*keys, bucket_count: int = BUCKET_COUNT, schema: T.StructType | None = None) -> Column:
    """Bucket id, 1 to bucket_count, of the text of the keys (columns or names). schema tells doubles from integers."""
    columns = tuple(key_parts(list(keys)))
    return crc32c(_parts(_text, columns, _kinds(columns, schema, keys))) % bucket_count + 1


def bucket_id_mpcrc32(*keys, bucket_count: int = BUCKET_COUNT, schema: T.StructType | None = None) -> Column:
    """Bucket id of the packed keys. Without schema, keys count as strings."""
    columns = tuple(key_parts(list(keys)))
    return crc32c(_parts(_packed, columns, _kinds(columns, schema, keys))) % bucket_count + 1


def bucket_id(*keys, **options) -> Column:
    """The older name of bucket_id_strcrc32."""
    return bucket_id_strcrc32(*keys, **options)


def literal_bucket_id(key, bucket_count: int = BUCKET_COUNT, packed: bool = False) -> int:
    """Bucket id of a literal key, computed on the driver so that filters on it can prune."""
    return crc_of(packed_of(key) if packed else text_of(key)) % bucket_count + 1


def oracle_crc(data: str) -> str:
    """DuckDB SQL for the CRC of a blob expression."""
    steps = "[" + ",".join(map(str, _TABLE)) + "]"
    bytes_ = f"list_transform(range(1, CAST(octet_length({data}) AS BIGINT) + 1), lambda i: CAST(('0x' || substr(hex({data}), CAST(2 * i - 1 AS BIGINT), 2)) AS BIGINT))"
    return f"list_reduce(list_prepend(CAST({START} AS BIGINT), {bytes_}), lambda c, b: xor(c >> 8, ({steps})[(xor(c, b) & 255) + 1]))"
