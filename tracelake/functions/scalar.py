"""Scalars that Spark lacks: CRC-32C, 64-bit FNV-1a, and the order-keeping internal key; quorum arithmetic."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the two hashes: the reflected Castagnoli polynomial; FNV's offset and prime.
CASTAGNOLI = 0x82F63B78
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
MAX_U64 = (1 << 64) - 1


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte
        for _ in range(8):
            crc = crc >> 1 ^ (CASTAGNOLI if crc & 1 else 0)
        out.append(crc)
    return out


_TABLE = _crc_table()


def crc32c_bytes(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = crc >> 8 ^ _TABLE[(crc ^ byte) & 0xFF]
    return crc ^ 0xFFFFFFFF


def fnv1a64_bytes(data: bytes) -> int:
    h = FNV_OFFSET
    for byte in data:
        h = (h ^ byte) * FNV_PRIME & MAX_U64
    return h


def ikey_bytes(key: bytes, seq: int) -> bytes:
    """Bytes that sort by key ascending, then seq descending; a key sorts before its extensions.

    Each 00 of the key becomes 00 FF, 00 00 ends it, and the inverted number follows.
    """
    return key.replace(b"\0", b"\0\xff") + b"\0\0" + struct.pack(">Q", MAX_U64 - seq)


def ikey_split(data: bytes) -> tuple[bytes, int]:
    return data[:-10].replace(b"\0\xff", b"\0"), MAX_U64 - struct.unpack(">Q", data[-8:])[0]


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else crc32c_bytes(bytes(b))).astype("Int64")


@F.pandas_udf(T.StringType())
def fnv1a64(data: pd.Series) -> pd.Series:
    """Hexadecimal, since the value needs 64 unsigned bits."""
    return data.map(lambda b: None if b is None else f"{fnv1a64_bytes(bytes(b)):016x}")


def ikey_encode(key: Column, seq: Column) -> Column:
    """ikey_bytes() in built-in functions, for binary ``key`` and long ``seq``."""
    return F.concat(_escaped(key), F.unhex(F.lit("0000")), F.unhex(F.lpad(F.hex(F.bitwise_not(seq)), 16, "0")))


def _escaped(key: Column) -> Column:
    pairs = F.regexp_replace(F.hex(key), "([0-9A-F]{2})", "$1 ")
    return F.unhex(F.replace(F.replace(pairs, F.lit("00 "), F.lit("00FF ")), F.lit(" "), F.lit("")))


def payload_hash(kind: Column, payload: Column) -> Column:
    """A hash of an entry's kind and bytes, equal on replicas that hold the same entry."""
    return F.xxhash64(kind, payload)


def majority(granted: Column, voters: Column) -> Column:
    """Whether ``granted`` holds more than half of ``voters``."""
    return F.size(F.array_intersect(granted, voters)) * 2 > F.size(voters)


def joint_majority(granted: Column, voters: Column, joining: Column) -> Column:
    """A majority of the voters and, in a joint configuration (joining not null), of the new voters too."""
    return majority(granted, voters) & (joining.isNull() | majority(granted, joining))


def majority_index(values: Column, voters: Column) -> Column:
    """The greatest value that a majority of the voters has reached."""
    return F.element_at(F.array_sort(values), F.floor((F.size(voters) + 1) / 2).cast("int"))


def lease_end(promises: Column, voters: Column, itself: Column, span: Column) -> Column:
    """When a leader's lease ends: the latest promise that a majority (itself counted) has given, plus the span; 0 without one."""
    needed = F.floor(F.size(voters) / 2).cast("int") + 1 - F.when(F.array_contains(voters, itself), 1).otherwise(0)
    return F.when(needed <= 0, F.lit(None)).otherwise(F.coalesce(F.get(F.sort_array(promises, asc=False), needed - 1) + span, F.lit(0)))


def register(spark: SparkSession) -> None:
    """Makes crc32c and fnv1a64 callable from SQL."""
    spark.udf.register("crc32c", crc32c)
    spark.udf.register("fnv1a64", fnv1a64)
