"""Points, polygons and multipolygons in well-known binary, by column expressions.

A double's eight bytes are its sign, exponent and fraction, which arithmetic
takes apart and puts together exactly. Bytes are cut from the value itself,
so a polygon costs in proportion to its places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT, POLYGON, MULTIPOLYGON = 1, 3, 6
_FOUND = "array<struct<at:bigint,n:bigint,little:boolean,size:bigint>>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), f).getItem(0)


def _numbers(n: Column, start: int = 0) -> Column:
    """``n`` numbers from ``start``."""
    return F.when(n > 0, F.sequence(F.lit(start).cast("long"), n + F.lit(start - 1))).otherwise(F.array().cast("array<bigint>"))


def _hex(wkb: Column, at: Column, n: int, little: Column) -> Column:
    """``n`` bytes from the place ``at``, highest first, as hexadecimal digits."""
    byte = lambda i: F.hex(F.substring(wkb, (at + F.lit(i + 1)).cast("int"), F.lit(1)))
    return F.when(little, F.concat(*[byte(i) for i in reversed(range(n))])).otherwise(F.hex(F.substring(wkb, (at + F.lit(1)).cast("int"), F.lit(n))))


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def _u32(wkb: Column, at: Column, little: Column) -> Column:
    return _number(_hex(wkb, at, 4, little))


def _double(wkb: Column, at: Column, little: Column) -> Column:
    def value(digits: Column) -> Column:
        high, low = _number(F.substring(digits, 1, 8)), _number(F.substring(digits, 9, 8))
        e = F.shiftright(high, 20).bitwiseAND(F.lit(2047))
        m = high.bitwiseAND(F.lit(0xFFFFF)) * F.lit(1 << 32) + low
        size = F.when(e == 0, m.cast("double") * F.lit(2.0**-1074)).when(e == 2047, F.when(m == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).otherwise((m + F.lit(1 << 52)).cast("double") * F.pow(F.lit(2.0), (e - 1075).cast("double")))
        return F.when(high >= F.lit(1 << 31), -size).otherwise(size)

    return let(_hex(wkb, at, 8, little), value)


def _header(wkb: Column, at: Column) -> Column:
    """little, base kind and bytes per place of the geometry that begins at a place; ISO kinds with Z, M or both have longer places."""
    little = F.substring(wkb, (at + 1).cast("int"), F.lit(1)) == F.unhex(F.lit("01"))
    kind = _u32(wkb, at + 1, little)
    extra = F.floor(kind / 1000)
    return F.struct(little.alias("little"), (kind % 1000).alias("kind"), F.when(extra == 0, 16).when(extra.isin(1, 2), 24).when(extra == 3, 32).cast("long").alias("size"))


def point_of(wkb: Column) -> Column:
    """struct<x, y> of a point; null for null, other kinds and bytes that are no geometry."""
    at = F.lit(5).cast("long")
    read = lambda h: F.when((h.kind == POINT) & (F.octet_length(wkb) == h.size + 5), F.struct(_double(wkb, at, h.little).alias("x"), _double(wkb, at + 8, h.little).alias("y")))
    return F.when(F.octet_length(wkb) >= 21, let(_header(wkb, F.lit(0).cast("long")), read))


def rings_of(wkb: Column) -> Column:
    """The rings of a polygon or multipolygon, array<array<struct<x, y>>>.

    Every part may have its own byte order; Z and M are left out. Null for
    null, other kinds, and bytes that are cut off, go on, or count more rings
    than they could hold.
    """
    total = F.octet_length(wkb).cast("long")
    nothing = F.lit(None).cast(f"struct<end:bigint,found:{_FOUND}>")

    def polygon(at: Column, found: Column) -> Column:
        def walk(h: Column) -> Column:
            def ring(state: Column, _: Column) -> Column:
                add = lambda n: F.struct((state.end + 4 + n * h.size).alias("end"), F.array_append(state.found, F.struct((state.end + 4).alias("at"), n.alias("n"), h.little.alias("little"), h.size.alias("size"))).alias("found"))
                return F.when(state.end + 4 <= total, let(_u32(wkb, state.end, h.little), add)).otherwise(nothing)

            rings = _u32(wkb, at + 5, h.little)
            start = F.struct((at + 9).cast("long").alias("end"), found.alias("found"))
            return F.when((h.kind == POLYGON) & h.size.isNotNull() & (rings * 4 <= total), F.aggregate(_numbers(rings), start, ring)).otherwise(nothing)

        return F.when(at + 9 <= total, let(_header(wkb, at), walk)).otherwise(nothing)

    zero, none = F.lit(0).cast("long"), F.array().cast(_FOUND)

    def whole(h: Column) -> Column:
        parts = _u32(wkb, F.lit(5).cast("long"), h.little)
        many = F.aggregate(_numbers(parts), F.struct(F.lit(9).cast("long").alias("end"), none.alias("found")), lambda state, _: polygon(state.end, state.found))
        return F.when(h.kind == POLYGON, polygon(zero, none)).when((h.kind == MULTIPOLYGON) & (parts * 9 <= total), many)

    def places(state: Column) -> Column:
        place = lambda r, i: F.struct(_double(wkb, r.at + i * r.size, r.little).alias("x"), _double(wkb, r.at + i * r.size + 8, r.little).alias("y"))
        return F.when(state.end == total, F.transform(state.found, lambda r: F.transform(_numbers(r.n), lambda i: place(r, i))))

    return F.when(total >= 9, let(let(_header(wkb, zero), whole), places))


def _double_digits(x: Column) -> Column:
    """The sixteen digits of a finite double; -0.0 is written as 0.0."""

    def digits(a: Column) -> Column:
        near = F.floor(F.log2(F.greatest(a, F.lit(2.0**-1022))))
        power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
        near = F.least(near, F.lit(1023).cast("long"))
        e = near + F.when(power(near) > a, -1).when((near < 1023) & (power(F.least(near + 1, F.lit(1023).cast("long"))) <= a), 1).otherwise(0)
        small = (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
        normal = let(e, lambda e: (e + 1023) * F.lit(1 << 52) + ((a * power(-e) - 1.0) * F.lit(2.0**52)).cast("long"))
        bits = F.when(a < F.lit(2.0**-1022), small).otherwise(normal)
        return F.lpad(F.hex(F.when(x < 0, bits.bitwiseOR(F.lit(-(1 << 63)))).otherwise(bits)), 16, "0")

    return let(F.abs(x.cast("double")), digits)


def _u32_digits(n: Column) -> Column:
    return F.lpad(F.hex(n.cast("long")), 8, "0")


def point(x: Column, y: Column) -> Column:
    """A point of finite numbers, highest bytes first; null where either is null."""
    return F.unhex(F.concat(F.lit("0000000001"), _double_digits(x), _double_digits(y)))


def _polygon_digits(rings: Column) -> Column:
    ring = lambda r: F.concat(_u32_digits(F.size(r)), F.array_join(F.transform(r, lambda p: F.concat(_double_digits(p.x), _double_digits(p.y))), ""))
    return F.concat(F.lit("0000000003"), _u32_digits(F.size(rings)), F.array_join(F.transform(rings, ring), ""))


def polygon(rings: Column) -> Column:
    """A polygon of array<array<struct<x, y>>>, its outer ring first; each ring ends with its first place."""
    return F.unhex(_polygon_digits(rings))


def multipolygon(polygons: Column) -> Column:
    """A multipolygon of an array of polygons' rings."""
    return F.unhex(F.concat(F.lit("0000000006"), _u32_digits(F.size(polygons)), F.array_join(F.transform(polygons, _polygon_digits), "")))
