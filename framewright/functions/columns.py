"""Column functions: bits, checksums, panning, levels and codes, all on the JVM side."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(b: Column, i: Column) -> Column:
    return F.conv(F.hex(F.substring(b, i + 1, F.lit(1))), 16, 10).cast("int")


def bit_string(b: Column) -> Column:
    """Bits of a binary, first bit first."""
    n = F.octet_length(b)
    bits = F.transform(F.sequence(F.lit(1), n), lambda i: F.lpad(F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 2), 8, "0"))
    return F.when(n > 0, F.array_join(bits, "")).when(n == 0, F.lit(""))


def crc_msb(b: Column, width: int, poly: int) -> Column:
    """CRC of a binary, initial value 0, first bit first, no final xor (null: null)."""
    mask = (1 << width) - 1
    seq = F.when(F.octet_length(b) > 0, F.sequence(F.lit(0), F.octet_length(b) - 1)).otherwise(F.array().cast("array<int>"))

    def step(c: Column, x: Column) -> Column:
        def bit(d: Column, k: Column) -> Column:
            top = F.shiftright(d, width - 1).bitwiseAND(F.lit(1))
            one = F.call_function("shiftright", x, F.lit(7) - k).cast("long").bitwiseAND(F.lit(1))
            return F.shiftleft(d, 1).bitwiseAND(F.lit(mask)).bitwiseXOR(F.when(top.bitwiseXOR(one) == 1, F.lit(poly).cast("long")).otherwise(F.lit(0).cast("long")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(7)), c, bit)

    return F.when(b.isNotNull(), F.aggregate(F.transform(seq, lambda i: byte_at(b, i)), F.lit(0).cast("long"), step))


def hmac_sha256(b: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a binary with a key of up to 64 bytes, in hexadecimal."""
    if len(key) > 64:
        raise ValueError("a key has up to 64 bytes")
    k = key.ljust(64, b"\0")
    inner, outer = bytes(x ^ 0x36 for x in k).hex(), bytes(x ^ 0x5C for x in k).hex()
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(F.sha2(F.concat(F.unhex(F.lit(inner)), b), 256))), 256)


def variable_bits(v: Column, n: int) -> Column:
    """A value in groups of n bits, each with a flag whether another one follows (one to three groups)."""
    size = 1 << n
    first, second = size, size + size * size
    group = lambda x: F.lpad(F.bin(x), n, "0")
    a, b = v - first, v - second
    div = lambda x, y: F.floor(x / F.lit(y)).cast("long")
    return (
        F.when(v < first, F.concat(group(v), F.lit("0")))
        .when(v < second, F.concat(group(div(a, size)), F.lit("1"), group(a % size), F.lit("0")))
        .otherwise(F.concat(group(div(b, size * size)), F.lit("1"), group(div(b, size) % size), F.lit("1"), group(b % size), F.lit("0")))
    )


def pan_vbap(x: Column, y: Column) -> Column:
    """Gains (L, R, C, Ls, Rs) of a position: constant power between two neighbours on the ring; the centre goes to C."""
    az = F.degrees(F.atan2(x, y))
    arc = lambda lo, hi: (az - F.lit(lo)) / F.lit(hi - lo) * F.lit(math.pi / 2)
    back = F.when(az >= 110, az - 110).otherwise(az + 250) / F.lit(140.0) * F.lit(math.pi / 2)
    zero = F.lit(0.0)
    at = lambda **g: F.array(*(g.get(k, zero) for k in ("l", "r", "c", "ls", "rs")))
    return (
        F.when((x == 0) & (y == 0), at(c=F.lit(1.0)))
        .when(az.between(-110, -30), at(ls=F.cos(arc(-110.0, -30.0)), l=F.sin(arc(-110.0, -30.0))))
        .when(az.between(-30, 0), at(l=F.cos(arc(-30.0, 0.0)), c=F.sin(arc(-30.0, 0.0))))
        .when(az.between(0, 30), at(c=F.cos(arc(0.0, 30.0)), r=F.sin(arc(0.0, 30.0))))
        .when(az.between(30, 110), at(r=F.cos(arc(30.0, 110.0)), rs=F.sin(arc(30.0, 110.0))))
        .otherwise(at(rs=F.cos(back), ls=F.sin(back)))
    )


def lerp(a: str, b: str, f: Column) -> Column:
    """Component-wise interpolation of two array columns."""
    return F.zip_with(a, b, lambda u, v: u + (v - u) * f)


def rounded(v: Column, places: int) -> Column:
    """A double to so many places by its scaled value, as SQL engines do: ``F.round`` goes by the decimals it is shown with, which may be a tie that it isn't."""
    out = F.round(v * F.lit(10.0**places)) / F.lit(10.0**places)
    return F.when(F.abs(out) < F.lit(math.inf), out).otherwise(v)


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def linear_to_db(v: Column) -> Column:
    """Level in dB; null at or below zero."""
    return F.when(v > 0, F.log10(v) * 20)


def quantize_position(x: Column, y: Column, z: Column) -> Column:
    """Codes of a position in [-1, 1]: px and py 0..62 (y turned round), up, pz 0..15; halves round away from zero."""
    code = lambda v, most: F.round(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * most).cast("int")
    return F.struct(code((x + 1) / 2, 62).alias("px"), code((1 - y) / 2, 62).alias("py"), (z >= 0).alias("up"), code(F.abs(z), 15).alias("pz"))


def quantize_gain(g: Column) -> Column:
    return F.least(F.greatest(F.round(g / F.lit(0.1)) + 96, F.lit(0)), F.lit(191)).cast("int")


def dequantize_gain(code: Column) -> Column:
    return (code - 96) * F.lit(0.1)
