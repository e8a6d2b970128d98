"""JSON text of any column, with a space behind commas and colons and with nulls, as services write it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import bound

#: Control characters that ``to_json`` writes with capital hex digits.
_RARE = [0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)]


def _string(x: Column) -> Column:
    """A quoted string; characters beyond ASCII stay."""
    plain = lambda v: F.regexp_extract(F.to_json(F.array(v)), r"(?s)^\[(.*)\]$", 1)
    # Text with one of them is escaped piece by piece, so that only the characters themselves are replaced.
    unit = lambda c: F.when(c.isin(*map(chr, _RARE)), F.concat(F.lit("\\u00"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0")))).otherwise(F.regexp_extract(plain(c), r'(?s)^"(.*)"$', 1))
    rare = F.concat(F.lit('"'), F.array_join(F.transform(F.split(x, ""), unit), ""), F.lit('"'))
    return F.when(x.rlike(r"[\x0B\x0E\x0F\x1A-\x1F]"), rare).otherwise(plain(x))


def _float(x: Column) -> Column:
    """The shortest text of a number: positional from 10^-4 up to 10^16, else with an exponent of two digits at least."""
    text = x.cast("string")
    places = F.regexp_replace(x.cast("decimal(38,20)").cast("string"), r"0+$", "")
    positional = F.when(places.endswith("."), F.concat(places, F.lit("0"))).otherwise(places)
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^([^E]*)E", 1), r"\.0$", "")
    power = F.regexp_extract(text, r"E(-?)(\d+)$", 2)
    scientific = F.concat(mantissa, F.lit("e"), F.when(text.contains("E-"), "-").otherwise("+"), F.lpad(power, F.greatest(F.length(power), F.lit(2)), F.lit("0")))
    return F.when(~text.contains("E"), text).when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), positional).otherwise(scientific)


def json_text(x: Column, kind: T.DataType) -> Column:
    """A column of the type as JSON; types without a JSON form of their own are strings."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(("" if i == 0 else ", ")), _string(F.lit(f.name)), F.lit(": "), json_text(x.getField(f.name), f.dataType)) for i, f in enumerate(kind.fields)]
        text = F.concat(F.lit("{"), *parts, F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: json_text(v, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(_string(e["key"].cast("string")), F.lit(": "), json_text(e["value"], kind.valueType))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(x), entry), ", "), F.lit("}"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        text = bound(x.cast("double"), _float)
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = x.cast("string")
    else:
        text = _string(x.cast("string"))
    return F.coalesce(text, F.lit("null"))


def ascii_bytes(text: Column) -> Column:
    """Bytes of JSON text once characters beyond ASCII are written as \\uXXXX, two of them beyond the first plane."""
    return F.length(text) + 5 * F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")) + 6 * F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))
