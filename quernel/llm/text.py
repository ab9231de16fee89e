"""Column expressions on text that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: The characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Text without other than ASCII takes the faster built-in, which then does the same."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """The maximal runs of non-blank characters; an empty array for null or blank text."""
    bare = strip_blanks(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def lines(text: Column) -> Column:
    r"""The text split at ``\n``; null and empty text give one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def wide_hash(*cols: Column) -> tuple[Column, Column]:
    """128 bits as two longs: the same function from two seeds."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("second half"), *cols)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``use`` may name its argument often: a one-element transform evaluates it once."""
    return F.get(F.transform(F.array(value), use), 0)


def boxed(df: DataFrame, **inputs: str) -> DataFrame:
    """The named input columns, and the whole row as ``row``: no name of the caller's can clash with a working name."""
    return df.select(*[F.col(f"`{name}`").alias(alias) for alias, name in inputs.items()], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unboxed(df: DataFrame, columns: list[str], **results: Column) -> DataFrame:
    """The caller's columns with ``results``; a result replaces a column of the same name in place, others follow."""
    taken = {k.lower(): k for k in results}
    kept = [results[taken[c.lower()]].alias(taken[c.lower()]) if c.lower() in taken else F.col("row").getField(c).alias(c) for c in columns]
    present = {c.lower() for c in columns}
    return df.select(*kept, *[v.alias(k) for k, v in results.items() if k.lower() not in present])
