"""Lines of JSON: which are blank, and how long a value is as compact JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a blank line may hold: Unicode White_Space.
_BLANK = r"^[\s\u0085   -     　]*$"
_STRING = r'"(?:[^"\\]|\\.)*+"'
#: Numbers that are no whole ones of 64 bits, as Spark prints JSON; whole ones are tried by size.
_NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?(?:E-?[0-9]+)?)"
_DOUBLE = r"^-?([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$"
#: Text that may hold a number with a point or an exponent, or one beyond 64 bits.
MAYBE_FLOAT = r"[0-9][.eE][0-9+-]|[0-9]{19}"


def blank(line: Column) -> Column:
    return line.rlike(_BLANK)


def _float_length(number: Column) -> Column:
    """Characters of a double in the shortest form with a point, or with an exponent where the point would be over 16 digits to the right or 5 to the left."""
    text = number.cast("double").cast("string")
    part = lambda k: F.regexp_extract(text, _DOUBLE, k)
    digits = F.concat(part(1), part(2))
    bare = F.regexp_replace(digits, "^0+", "")
    point = F.length(part(1)) + F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0)) - (F.length(digits) - F.length(bare))
    n = F.length(F.regexp_replace(bare, "0+$", ""))
    exponent = F.length((point - 1).cast("string")) + F.when(n == 1, 2).otherwise(n + 2)
    size = F.when(n == 0, 3).when((point >= n) & (point <= 16), point + 2).when((point > 0) & (point <= 16), n + 1).when((point > -5) & (point <= 0), 2 - point + n).otherwise(exponent)
    return size + F.when(F.startswith(text, F.lit("-")), 1).otherwise(0)


def compact_bytes(json: Column) -> Column:
    """Bytes of JSON text without white space (as ``get_json_object`` prints it) with every number that is no whole one of 64 bits in its shortest form as a double; of others nothing changes. The few doubles that Java prints with a digit too many keep it."""
    numbers = F.regexp_extract_all(F.regexp_replace(json, _STRING, '""'), F.lit(_NUMBER), F.lit(1))
    wide = lambda x: (F.length(x) >= 19) & ~x.try_cast("decimal(38,0)").between(F.lit("-9223372036854775808").cast("decimal(38,0)"), F.lit("18446744073709551615").cast("decimal(38,0)"))
    floats = F.filter(numbers, lambda x: x.rlike("[.E]") | F.coalesce(wide(x), F.lit(True)))
    return F.octet_length(json) + F.aggregate(floats, F.lit(0), lambda total, x: total + _float_length(x) - F.length(x))
