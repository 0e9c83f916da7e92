"""Scalar functions: modular arithmetic, parsing, processor sets, packed ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', {column})")


#: Nanoseconds of each unit of time.
UNITS = {"ns": 1, "us": 1000, "ms": 1000**2, "s": 1000**3}


def elapsed(start: str, end: str, unit: str = "us") -> Column:
    """Time from one timestamp column to another in a unit of UNITS: a whole number, but seconds are doubles."""
    between = micros(end) - micros(start)
    return between / 1e6 if unit == "s" else F.floor(between * 1000 / UNITS[unit]) if unit == "ms" else between * (1000 // UNITS[unit])


def axb_mod(a: Column, x: Column, b: Column, p: int) -> Column:
    """(a x + b) mod p, for p below 2^31."""
    return F.pmod(a * x + b, F.lit(p))


def power_mod(base: int, exponent: Column, p: int, bits: int = 40) -> Column:
    """base^exponent mod p by the exponent's bits, for exponents from 0 to 2^bits - 1; others are an error. p is below 2^31."""
    squares, b = [], base % p
    for _ in range(bits):
        squares.append(b)
        b = b * b % p
    out = F.lit(1).cast("long")
    for k, s in enumerate(squares):
        out = F.pmod(out * F.when(F.shiftright(exponent, k).bitwiseAND(F.lit(1)) == 1, s).otherwise(1), F.lit(p))
    beyond = (exponent < 0) | (exponent >= F.lit(1 << bits))
    return F.when(beyond, F.raise_error(F.lit(f"an exponent is not between 0 and 2^{bits} - 1")).cast("bigint")).otherwise(out)


def first_one(value: Column) -> Column:
    """The place of the lowest set bit, from 1; 0 where there is none."""
    return F.when(value == 0, 0).when(value == F.lit(-(1 << 63)), 64).otherwise(F.bit_count(value.bitwiseXOR(value - 1)))


def set_bit(value: Column, at: int) -> Column:
    return value.bitwiseOR(F.lit(1 << at if at < 63 else -(1 << 63)))


def unset_bit(value: Column, at: int) -> Column:
    return value.bitwiseAND(F.lit(~(1 << at) if at < 63 else (1 << 63) - 1))


def parse(text: Column, kind: str) -> Column:
    """A value of a string; null where it isn't one or is out of range. kind: bool, long, ulong, double."""
    t = F.trim(text)
    match kind:
        case "bool":
            return F.when(F.lower(t).isin("true", "1", "yes"), True).when(F.lower(t).isin("false", "0", "no"), False)
        case "long":
            return t.try_cast("bigint")
        case "ulong":
            v = t.try_cast("decimal(20,0)")
            return F.when((v >= 0) & (v <= F.lit("18446744073709551615").cast("decimal(20,0)")), v)
        case "double":
            return t.try_cast("double")
    raise ValueError(kind)


def cpu_set(text: Column) -> Column:
    """A set such as "3:9,!4": numbers and ranges, less those that a ! marks; sorted."""

    def numbers(item: Column) -> Column:
        ends = F.split(F.regexp_replace(item, "^!", ""), ":")
        low, high = ends[0].cast("int"), F.coalesce(F.get(ends, F.lit(1)), ends[0]).cast("int")
        return F.sequence(low, high)

    items = F.transform(F.split(text, ","), lambda x: F.trim(x))
    taken = F.flatten(F.transform(F.filter(items, lambda x: ~x.startswith("!") & (x != "")), numbers))
    left = F.flatten(F.transform(F.filter(items, lambda x: x.startswith("!")), numbers))
    return F.array_sort(F.array_distinct(F.array_except(taken, left)))


def pack(i: Column, j: Column, ld: int) -> Column:
    return i * ld + j


def unpack(packed: Column, ld: int) -> tuple[Column, Column]:
    return F.floor(packed / ld), packed % ld
