"""Ring tokens and other hashes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = 1 << 63
#: Bits of a portable token.
PORTABLE_BITS = 60


def portable_token(text: Column) -> Column:
    """A 60-bit token that any engine with MD5 can make: never negative, so it sorts as it is."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def to_unsigned(token: Column) -> Column:
    """An order-preserving signed token as the unsigned number that it stands for."""
    return token.cast("decimal(20,0)") + F.lit(str(TOP)).cast("decimal(20,0)")


def to_signed(token: Column) -> Column:
    """The reverse of to_unsigned."""
    return (token.cast("decimal(20,0)") - F.lit(str(TOP)).cast("decimal(20,0)")).cast("long")


def xxh3_token(key: Column, seed: int) -> Column:
    """XXH3-64 of binary keys, as order-preserving signed longs."""
    import xxhash

    @F.pandas_udf("long")
    def run(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: None if k is None else xxhash.xxh3_64_intdigest(bytes(k), seed=seed) - TOP).astype("Int64")

    return run(key)


def vnode_token(node_id: Column, vnode: Column, seed: int, domain: bytes) -> Column:
    """The token of a member's virtual node: XXH3-64 over the ring's domain (a prefix that each kind of ring has of its own, with its closing zero byte), the name's length and bytes, and the number."""
    import xxhash

    @F.pandas_udf("long")
    def run(ids: pd.Series, vnodes: pd.Series) -> pd.Series:
        out = []
        for node, v in zip(ids, vnodes, strict=True):
            name = node.encode()
            out.append(xxhash.xxh3_64_intdigest(domain + len(name).to_bytes(8, "big") + name + int(v).to_bytes(4, "big"), seed=seed) - TOP)
        return pd.Series(out, dtype="int64")

    return run(node_id, vnode)


def big_endian_key(number: Column) -> Column:
    """A key as the eight bytes of its number."""
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def slot(key: Column, slots: int = 16384) -> Column:
    """CRC-16 (polynomial 0x1021, start 0) of a key, or of its part in braces, by slots."""

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        table = []
        for i in range(256):
            crc = i << 8
            for _ in range(8):
                crc = (crc << 1 ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
            table.append(crc)

        def one(key):
            if key is None:
                return None
            data = key.encode() if isinstance(key, str) else bytes(key)
            start = data.find(b"{")
            end = data.find(b"}", start + 1) if start >= 0 else -1
            crc = 0
            for b in data[start + 1 : end] if end > start + 1 else data:
                crc = (crc << 8 & 0xFFFF) ^ table[crc >> 8 ^ b]
            return crc % slots

        return keys.map(one).astype("Int32")

    return run(key)
