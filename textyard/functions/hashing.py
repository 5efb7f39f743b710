"""Reproducible draw keys and bucket numbers as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HEX_DIGITS = 15  # 60 bits: the longest md5 prefix that fits a BIGINT


def draw_key(row_id: Column, seed: int) -> Column:
    """Pseudo-random sort key of a row: equal on every engine with md5."""
    return F.md5(F.concat(row_id.cast("string"), F.lit(f":{seed}")))


def md5_int(c: Column, digits: int = HEX_DIGITS) -> Column:
    return F.conv(F.substr(F.md5(c), F.lit(1), F.lit(digits)), 16, 10).cast("bigint")


def md5_bucket(c: Column, buckets: int) -> Column:
    return F.pmod(md5_int(c), F.lit(buckets).cast("bigint"))


def fnv1a_bucket(c: Column, buckets: int) -> Column:
    """32-bit FNV-1a over the bytes of an ASCII string, modulo ``buckets``."""
    # Offset basis 2166136261, prime 16777619, 32-bit mask 4294967295.
    positions = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    hashed = F.aggregate(
        positions,
        F.lit(2166136261).cast("bigint"),
        lambda h, i: (h.bitwiseXOR(F.ascii(F.substr(c, i, F.lit(1))).cast("bigint")) * F.lit(16777619)).bitwiseAND(
            F.lit(4294967295).cast("bigint")
        ),
    )
    return F.pmod(hashed, F.lit(buckets).cast("bigint"))


BUCKET_FUNCTIONS = {"md5": md5_bucket, "fnv1a": fnv1a_bucket}
