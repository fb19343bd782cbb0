"""Column expressions for cell text, normalisation, type tests and tokens.

All of these are built-in Spark SQL expressions, so they stay inside
whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (text rules of the profile and of the embedding texts).
# Null tokens a CSV reader treats as missing by default:
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# Text accepted as a number (decimal, optional exponent, inf/infinity),
# surrounding whitespace allowed:
NUMERIC_PATTERN = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
# Text accepted as a whole number:
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"
# Text read as a boolean by a CSV reader:
BOOLEAN_TEXTS = ("True", "TRUE", "true", "False", "FALSE", "false")
# Whitespace removed by "strip" (Unicode white space incl. the ASCII
# separators 0x1C-0x1F); the same pattern is valid for Java regex and RE2:
STRIP_PATTERN = r"^[\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]+|[\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]+$"
# Token separator of the hashed embedder: any run of non letters/digits.
TOKEN_SPLIT_PATTERN = r"[^\p{L}\p{N}]+"
# ---------------------------------------------------------------------------

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType,
)

# Source classes of a lake column.
SRC_NUMERIC = "numeric"  # typed number/boolean: always 'numeric'
SRC_TEXT = "text"        # free text (parquet string): numeric iff all values parse
SRC_CSV = "csv"          # CSV text: also numeric when all values are booleans
SRC_OTHER = "other"      # dates, timestamps, binary, nested: always 'string'


def source_class(dtype: T.DataType, from_csv: bool = False) -> str:
    if isinstance(dtype, NUMERIC_TYPES):
        return SRC_NUMERIC
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return SRC_CSV if from_csv else SRC_TEXT
    return SRC_OTHER


def quoted(name: str) -> str:
    """A column name for ``F.col``, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def cell_text(name: str, dtype: T.DataType) -> Column:
    """Text form of a cell, the value every profile and text is built on."""
    c = F.col(quoted(name))
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.FloatType, T.DoubleType)):
        # a vector as a typed reader prints a list of numbers
        shown = F.transform(c, lambda x: F.when(x.isNull(), "NULL").when(F.isnan(x), "nan").otherwise(float_text(x)))
        return F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return c
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        # a floating NaN is a missing value, like a null
        return F.when(F.isnan(c), F.lit(None).cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def forms_stay_distinct(dtype: T.DataType) -> bool:
    """Whether different texts of a typed column stay different in lower case and
    stripped: numbers, booleans, dates and times have no blanks at their ends and
    each letter in one case only."""
    return isinstance(dtype, (*NUMERIC_TYPES, T.DateType, T.TimestampType, T.TimestampNTZType))


def null_tokens_to_null(c: Column) -> Column:
    """CSV null normalisation: default NA tokens become SQL NULL."""
    return F.when(c.isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


STRIP_CHAR_PATTERN = r"^[\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]$"


def strip(c: Column) -> Column:
    """Remove leading/trailing white space.  The regex runs only when the first
    or last character is white space, so long texts are not scanned."""
    edge = F.substring(c, 1, 1).rlike(STRIP_CHAR_PATTERN) | F.substring(c, -1, 1).rlike(STRIP_CHAR_PATTERN)
    return F.when(edge, F.regexp_replace(c, STRIP_PATTERN, "")).otherwise(c)


def normalize_value(c: Column) -> Column:
    """Text -> lower -> strip (the value-set key)."""
    return strip(F.lower(c))


def is_numeric_text(c: Column) -> Column:
    return c.rlike(NUMERIC_PATTERN)


def is_integer_text(c: Column) -> Column:
    """Text read as a whole number of 64 bits."""
    return c.rlike(INTEGER_PATTERN) & F.trim(c).try_cast("bigint").isNotNull()


def _let(body, **values: Column) -> Column:
    """``body`` of a struct of ``values``, each evaluated once."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body)[0]


def float_text(x: Column) -> Column:
    """A double as a typed reader prints it: shortest digits, positional from
    1e-4 up to 1e16, else with an exponent of two digits at least."""

    def parts(s):  # digits before and after the point, and the exponent
        mantissa = F.substring_index(s["plain"], "E", 1)
        e = F.when(F.contains(s["plain"], F.lit("E")), F.substring_index(s["plain"], "E", -1).cast("int")).otherwise(F.lit(0))
        return F.struct(F.substring_index(mantissa, ".", 1).alias("whole"), F.substring_index(mantissa, ".", -1).alias("part"), e.alias("e"))

    def placed(s):  # all digits without leading zeros, and the place of the point
        raw = F.concat(s["whole"], s["part"])
        kept = F.ltrim(raw, F.lit("0"))
        point = F.char_length(s["whole"]) + s["e"] - F.char_length(raw) + F.char_length(kept)
        return F.struct(F.rtrim(kept, F.lit("0")).alias("digits"), point.alias("point"))

    def written(s):
        digits, point, n, power = s["digits"], s["point"], F.char_length(s["digits"]), s["point"] - 1
        big = F.concat(F.rpad(digits, point, "0"), F.lit("."), F.when(n > point, F.substr(digits, point + 1)).otherwise(F.lit("0")))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
        scientific = F.concat(
            F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, 2, 400))).otherwise(F.lit("")),
            F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
        return (F.when(digits == "", F.lit("0.0")).when((power < -4) | (power >= 16), scientific)
                .when(point > 0, big).otherwise(small))

    text = _let(lambda s: _let(lambda t: _let(lambda u: written(u["v"]), v=placed(t["v"])), v=parts(s)), plain=F.abs(x).cast("string"))
    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    return F.when(F.abs(x) == F.lit(float("inf")), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, text))


def typed_text(value: Column, kind: Column) -> Column:
    """The text of a CSV cell after its column is read as ``kind``."""
    trimmed = F.trim(value)
    infinite = F.when(F.startswith(trimmed, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    number = F.when(F.contains(F.lower(trimmed), F.lit("inf")), infinite).otherwise(trimmed.try_cast("double"))
    return (F.when(kind == "int", F.coalesce(trimmed.try_cast("bigint").cast("string"), value))
            .when(kind == "float", F.coalesce(_let(lambda s: float_text(s["x"]), x=number), value))
            .when(kind == "bool", F.initcap(F.lower(value))).otherwise(value))


def is_boolean_text(c: Column) -> Column:
    return c.isin(*BOOLEAN_TEXTS)


def tokens(c: Column) -> Column:
    """Array of non-empty lower-cased tokens of a text."""
    return F.filter(F.split(F.lower(c), TOKEN_SPLIT_PATTERN), lambda t: t != F.lit(""))


def token_bucket(tok: Column, dim: int) -> Column:
    """Feature-hashing bucket: first 32 bits of md5(token) modulo ``dim``."""
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
