"""Stable hashes: md5 uniforms and buckets, 32-bit FNV-1a."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 32-bit FNV-1a hash.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
#: White space of Unicode, the separators among the control characters included.
WHITE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def md5_long(text: Column) -> Column:
    """First 15 hex digits of the md5 as a non-negative long (60 bits)."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def md5_uniform(text: Column) -> Column:
    """Reproducible uniform in [0, 1), from 13 hex digits (52 bits, exact in a double)."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def md5_normal(text: Column) -> Column:
    """Reproducible standard normal: Box-Muller on two md5 uniforms."""
    u = F.lit(1.0) - md5_uniform(F.concat(text, F.lit("/u")))
    v = md5_uniform(F.concat(text, F.lit("/v")))
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0) * F.pi() * v)


def md5_bucket(word: Column, n: Column | int) -> Column:
    """First 8 hex digits of the md5, modulo ``n``."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint"), n.cast("bigint"))


def fnv1a(word: Column) -> Column:
    """32-bit FNV-1a over the code points of the word."""
    points = F.transform(
        F.filter(F.split(word, ""), lambda c: c != ""),
        # utf-32 bytes of one character are its code point
        lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("bigint"),
    )
    return F.aggregate(
        points,
        F.lit(FNV_OFFSET).cast("bigint"),
        lambda h, p: (h.bitwiseXOR(p) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")),
    )


def fnv_bucket(word: Column, n: int) -> Column:
    return F.pmod(fnv1a(word), F.lit(n).cast("bigint"))


def text_key(word: Column) -> Column:
    """Lower case without surrounding white space of any kind: the form keyword maps are keyed by."""
    return F.regexp_replace(F.lower(word), f"^{WHITE}+|{WHITE}+$", "")
