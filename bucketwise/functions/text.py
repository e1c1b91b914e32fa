"""Text: trimming, literal substring search, attribute values as text."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that entries are trimmed of (fixed values: ECMAScript's set).
SPACE = "\t\n\x0b\f\r\u0020\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def like_escaped(text: str) -> str:
    """``text`` as a LIKE pattern that means itself, with ``\\`` as escape."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def contains_text(column: Column, text: str) -> Column:
    """Case-insensitive literal substring; the empty text is in every value."""
    return F.contains(F.lower(column), F.lower(F.lit(text)))


def contains_ilike(column: Column, text: str) -> Column:
    """The same through ILIKE and escaping."""
    return F.ilike(column, F.lit(f"%{like_escaped(text)}%"), F.lit("\\"))


def number_text(value: float) -> str:
    """A JSON number as attribute filters see it: the shortest digits that
    give the same double, without exponent or a trailing ``.0``."""
    value = float(value)
    if value == 0 or math.isnan(value) or math.isinf(value):
        return "0" if value == 0 else repr(value)
    digits = repr(value)
    if "e" not in digits:
        return digits.removesuffix(".0")
    sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
    mantissa, exponent = digits.split("e")
    whole, _, part = mantissa.partition(".")
    point, digits = len(whole) + int(exponent), whole + part
    if point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    digits = digits.ljust(point, "0")
    return sign + digits[:point] + ("." + digits[point:] if digits[point:] else "")


def number_text_column(value: Column) -> Column:
    """:func:`number_text` of a double column, exact below 1e23 in magnitude
    and to 15 places."""
    plain = value.cast("string")
    wide = F.regexp_replace(F.regexp_replace(value.try_cast("decimal(38,15)").cast("string"), r"0+$", ""), r"\.$", "")
    return (
        F.when(value == 0, F.lit("0"))
        .when(plain.contains("E"), F.coalesce(wide, plain))
        .when(plain.endswith(".0"), F.substring(plain, F.lit(1), F.length(plain) - 2))
        .otherwise(plain)
    )


def variant_text(value: Column) -> Column:
    """A scalar VARIANT as text: strings as they are, numbers canonical."""
    kind = F.schema_of_variant(value)
    number = number_text_column(F.try_variant_get(value, "$", "double"))
    return F.when(kind.isin("STRING", "BOOLEAN"), F.try_variant_get(value, "$", "string")).otherwise(number)
