"""Scalar expressions that several operators share; all are built from SQL functions but for base58."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The base58 alphabet of addresses and instruction data.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def u64_le(data: Column, offset: Column | int) -> Column:
    """The unsigned little-endian 64-bit integer at a byte offset, as decimal(20,0); null where the bytes end before."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    eight = F.substring(data, at + 1, F.lit(8))
    pairs = F.transform(F.sequence(F.lit(8), F.lit(1), F.lit(-1)), lambda i: F.hex(F.substring(eight, i, F.lit(1))))
    return F.when(F.octet_length(data) >= at + 8, F.conv(F.array_join(pairs, ""), 16, 10).cast("decimal(20,0)"))


def byte_at(data: Column, offset: Column | int) -> Column:
    """The byte at an offset as an int, null beyond the end."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    return F.when(F.octet_length(data) > at, F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int"))


def selector(method: str) -> Column:
    """The first eight bytes, in hex, of the hash that names a method."""
    return F.upper(F.substring(F.sha2(F.lit(f"global:{method}").cast("binary"), 256), 1, 16))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is zero or null."""
    return a / F.when(b != 0, b)


def relative_difference(a: Column, b: Column) -> Column:
    """The difference as a share of the larger; null unless both are positive."""
    return F.when((a > 0) & (b > 0), F.abs(a - b) / F.greatest(a, b))


def half_up(x: Column, places: int) -> Column:
    """Rounding by cutting off after adding a half: up at ties for positive values, as cut for negative ones."""
    scaled = x * float(10**places) + 0.5
    return F.when(scaled >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)) / float(10**places)


def normalised_label(label: Column) -> Column:
    """Lower case with runs of anything but letters and digits as one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "_"), F.lit("_"))


def motif_id(front: Column, back: Column) -> Column:
    """A deterministic id from the signatures of the first front and the first back."""
    return F.sha2(F.concat(front, F.lit(":"), back).cast("binary"), 256)


def common_first(a: Column, b: Column, otherwise: Column) -> Column:
    """The least value that two arrays share, else ``otherwise``."""
    return F.coalesce(F.array_min(F.array_intersect(a, b)), otherwise)


@F.pandas_udf(T.BinaryType())
def base58_decode(values: pd.Series) -> pd.Series:
    """Bytes of base58 text; null where a character is not of the alphabet."""
    place = {c: i for i, c in enumerate(BASE58)}

    def one(text):
        if text is None or any(c not in place for c in text):
            return None
        number = 0
        for c in text:
            number = number * 58 + place[c]
        zeros = len(text) - len(text.lstrip("1"))
        return bytes(zeros) + number.to_bytes((number.bit_length() + 7) // 8, "big")

    return values.map(one, na_action="ignore")
