"""Bit strings as columns: MSB first, written as '0' and '1'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_list(content: Column) -> Column:
    """Bytes of a binary column as two-digit hex strings."""
    return F.regexp_extract_all(F.hex(content), F.lit(".."), F.lit(0))


def padding_bits(bits: Column) -> Column:
    return F.pmod(-F.length(bits), F.lit(8))


def pack(bits: Column) -> Column:
    """Bit string -> binary, zeros on the right up to a whole byte."""
    full = F.concat(bits, F.repeat(F.lit("0"), padding_bits(bits)))
    return F.unhex(F.array_join(F.transform(F.regexp_extract_all(full, F.lit("[01]{8}"), F.lit(0)), lambda b: F.lpad(F.conv(b, 2, 16), 2, "0")), ""))


def valid(bits: Column) -> Column:
    """Whether a string is a bit string."""
    return bits.rlike("^[01]*$")


def unpack(content: Column, padding: Column) -> Column:
    """Binary -> bit string without its padding."""
    bits = F.array_join(F.transform(byte_list(content), lambda h: F.lpad(F.conv(h, 16, 2), 8, "0")), "")
    return F.substring(bits, F.lit(1), F.greatest(F.octet_length(content) * 8 - padding, F.lit(0)))


def bit_count(content: Column, padding: Column) -> Column:
    return F.greatest(F.octet_length(content).cast("long") * 8 - padding, F.lit(0).cast("long"))


def repack(content: Column, padding: Column) -> Column:
    """The logical bits written out again; an incomplete last byte is filled with zeros."""
    return pack(unpack(content, padding))


def fixed_width(value: Column, width: Column | int) -> Column:
    """The low ``width`` bits of a value."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.right(F.lpad(F.bin(value.cast("long")), 64, "0"), width)


def read_fixed(bits: Column, at: Column | int, width: Column | int) -> Column:
    """Value of the bits from a 0-based place on; bits past the end are zeros."""
    at = F.lit(at) if isinstance(at, int) else at
    width = F.lit(width) if isinstance(width, int) else width
    return F.conv(F.rpad(F.substring(bits, at + 1, width), width, F.lit("0")), 2, 10).cast("long")


def big_endian(value: Column, n_bytes: int) -> Column:
    """An unsigned value in so many bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * n_bytes, "0"))


def unsigned(content: Column, at: Column | int, n_bytes: int) -> Column:
    """The unsigned value of bytes from a 0-based place on; null if they aren't there."""
    at = F.lit(at) if isinstance(at, int) else at
    part = F.hex(F.substring(content, at + 1, F.lit(n_bytes)))
    return F.when(F.length(part) == 2 * n_bytes, F.conv(part, 16, 10).cast("long"))
