"""Lossless tokens and hashes of words, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends, white space, words (ASCII letters, digits, underscores and anything beyond ASCII), single characters.
TOKEN = r"\r\n|[\r\n]|[ \t\x0B\f]+|[0-9A-Za-z_\x{80}-\x{10FFFF}]+|."
WORD = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]+"
# Start and multiplier of the 64-bit FNV-1a hash; the multiplier is 2^40 + 435.
FNV_HIGH, FNV_LOW, FNV_SMALL = 0xCBF29CE4, 0x84222325, 435
_MASK = 0xFFFFFFFF


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def kind(token: Column) -> Column:
    return (
        F.when(token.rlike(r"^[\r\n]"), "newline")
        .when(token.rlike(r"^[ \t\x0B\f]"), "whitespace")
        .when(token.rlike(r"^[0-9]+$"), "number")
        .when(token.rlike(rf"^{WORD}$"), "word")
        .otherwise("symbol")
    )


def first_word(value: Column) -> Column:
    """The first word of a line that is not a number, or the empty string."""
    words = F.filter(F.regexp_extract_all(value, F.lit(WORD), F.lit(0)), lambda w: ~w.rlike("^[0-9]+$"))
    return F.coalesce(F.get(words, F.lit(0)), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fnv1a(text: Column) -> Column:
    """FNV-1a over the bytes of the ASCII-lowered text, the unsigned value in a BIGINT's bits.

    Two 32-bit halves are carried, so no product leaves 64 bits.
    """
    digits = F.hex(F.encode(ascii_lower(text), "UTF-8"))
    data = F.transform(F.filter(F.sequence(F.lit(0), F.octet_length(text)), lambda i: i < F.octet_length(text)), lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))

    def step(state: Column, byte: Column) -> Column:
        low = state["low"].bitwiseXOR(byte)
        product = low * FNV_SMALL
        high = state["high"] * FNV_SMALL + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(_MASK).alias("high"), product.bitwiseAND(_MASK).alias("low"))

    start = F.struct(F.lit(FNV_HIGH).cast("long").alias("high"), F.lit(FNV_LOW).cast("long").alias("low"))
    return F.aggregate(data, start, step, lambda s: F.shiftleft(s["high"], 32).bitwiseOR(s["low"]))


def unsigned_mod(value: Column, modulus: int) -> Column:
    """Remainder of the unsigned value of a BIGINT's bits."""
    rest = pow(2, 64, modulus)
    return F.pmod(F.pmod(value, F.lit(modulus)) + F.when(value < 0, rest).otherwise(0), F.lit(modulus))


def unsigned_order(value: Column) -> Column:
    """A BIGINT that sorts as the unsigned value of its bits."""
    return value.bitwiseXOR(F.lit(-(1 << 63)))
