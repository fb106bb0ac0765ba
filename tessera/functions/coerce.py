"""Values of a source column as the target's type: expressions, no Python on the rows.

Values that the target cannot hold become NULL, as the loader's rule is;
`lost` counts them so that no loss is silent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = {"tinyint": (-(1 << 7), (1 << 7) - 1), "smallint": (-(1 << 15), (1 << 15) - 1), "int": (-(1 << 31), (1 << 31) - 1), "bigint": (-(1 << 63), (1 << 63) - 1)}


def strip_nul(c: Column) -> Column:
    """Text without NUL characters."""
    return F.replace(c, F.lit("\0"), F.lit(""))


def to_bool(c: Column, source: T.DataType) -> Column:
    """Numbers: not zero. Bytes: '1', 't', 'true', 'y' or 'yes', or a number that is not zero. Text: a number that is not zero."""
    if isinstance(source, T.BooleanType):
        return c
    if isinstance(source, T.NumericType):
        return c != 0
    if isinstance(source, T.BinaryType):
        text = F.lower(F.decode(c, "ISO-8859-1"))
        one_byte = F.conv(F.hex(c), 16, 10).cast("decimal(38,0)") != 0
        printable = text.rlike("^[ -~]+$")
        by_text = text.isin("t", "true", "y", "yes") | F.coalesce(text.try_cast("double") != 0, F.lit(False))
        return F.when(c.isNull(), None).when(F.octet_length(c) == 0, False).when(printable, by_text).otherwise(F.when(F.octet_length(c) <= 8, one_byte).otherwise(True))
    return F.when(c.isNull(), None).otherwise(F.coalesce(c.cast("string").try_cast("double") != 0, F.lit(False)))


def to_int(c: Column, source: T.DataType, target: str) -> Column:
    """NULL where the value does not parse or fit; fractions are cut off."""
    if isinstance(source, T.BooleanType):
        return c.cast(target)
    if isinstance(source, (T.FloatType, T.DoubleType, T.DecimalType)):
        low, high = _INTS[target]
        bound = lambda x: F.expr(f"CAST('{x}' AS DECIMAL(20,0))")
        # the fraction is cut off, toward zero; a double holds the least bigint but nothing just below it
        return F.when(((c > bound(low - 1)) | (c >= bound(low))) & (c < bound(high + 1)), c).try_cast(target)
    text = F.decode(c, "UTF-8") if isinstance(source, T.BinaryType) else c
    return F.trim(text.cast("string")).try_cast(target) if not isinstance(source, T.IntegralType) else c.try_cast(target)


def to_text(c: Column, source: T.DataType) -> Column:
    """Text without NULs; bytes that are not UTF-8 as bits; timestamps as RFC 3339."""
    if isinstance(source, T.BinaryType):
        return F.when(F.is_valid_utf8(F.decode(c, "ISO-8859-1")) & _utf8(c), strip_nul(F.decode(c, "UTF-8"))).otherwise(bits(c))
    if isinstance(source, T.TimestampType):  # of the session's zone
        c = F.convert_timezone(None, F.lit("UTC"), c.cast("timestamp_ntz"))
    if isinstance(source, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    if isinstance(source, T.StringType):
        return strip_nul(c)
    return c.cast("string")


def _utf8(c: Column) -> Column:
    """Whether bytes are UTF-8."""
    return F.is_valid_utf8(c.cast("string"))


def bits(c: Column) -> Column:
    """Bytes as '0' and '1', eight a byte."""
    nibble = F.create_map(*[F.lit(x) for i in range(16) for x in (f"{i:X}", f"{i:04b}")])
    return F.when(c.isNull(), None).otherwise(F.array_join(F.transform(F.filter(F.split(F.hex(c), ""), lambda d: d != ""), lambda d: F.element_at(nibble, d)), ""))


def to_set(c: Column) -> Column:
    """'a,b' as an array; '' as an empty one."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))


def to_time(c: Column) -> Column:
    """A time of day as text; negative times, hours over 23 and '' are NULL."""
    text = F.trim(c)
    good = text.rlike(r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?$")
    return F.when(good, F.when(text.rlike(r"^\d:"), F.concat(F.lit("0"), text)).otherwise(text))


def to_year_month(c: Column) -> Column:
    """'[+-]YY-MM' as months."""
    part = lambda i: F.regexp_extract(c, r"^\s*([+-]?)(\d+)-(\d+)\s*$", i)
    months = part(2).try_cast("int") * 12 + part(3).try_cast("int")
    return F.when(part(1) == "-", -months).otherwise(months)


def to_day_second(c: Column) -> Column:
    """'[+-]DD HH:MI:SS[.f]' as microseconds; the fraction is filled or cut to six digits."""
    pattern = r"^\s*([+-]?)(\d+) (\d+):(\d+):(\d+)(?:\.(\d+))?\s*$"
    part = lambda i: F.regexp_extract(c, pattern, i)
    whole = ((part(2).try_cast("bigint") * 24 + part(3).try_cast("bigint")) * 60 + part(4).try_cast("bigint")) * 60 + part(5).try_cast("bigint")
    micros = whole * 1_000_000 + F.rpad(part(6), 6, "0").try_cast("bigint")
    return F.when(part(1) == "-", -micros).otherwise(micros)


def coerce(c: Column, source: T.DataType, target: str) -> Column:
    """A column as a target type, given as Spark DDL."""
    t = target.lower()
    if t == "boolean":
        return to_bool(c, source)
    if t in _INTS:
        return to_int(c, source, t)
    if t.startswith(("string", "varchar", "char")):
        return to_text(c, source)
    if t == "array<string>" and isinstance(source, T.StringType):
        return to_set(c)
    if t.startswith("time("):
        return to_time(c.cast("string"))
    if t.startswith("interval year"):
        return F.make_ym_interval(F.lit(0), to_year_month(c).cast("int")) if isinstance(source, T.StringType) else c
    if t.startswith("interval day"):
        return F.make_dt_interval(secs=(to_day_second(c) / 1_000_000).cast("decimal(18,6)")) if isinstance(source, T.StringType) else c
    if t == "variant":
        return F.try_parse_json(strip_nul(c.cast("string")))
    return c.try_cast(target)


def lost(before: Column, after: Column) -> Column:
    """1 where a value became NULL."""
    return (before.isNotNull() & after.isNull()).cast("long")
