"""Tab-separated topic lines <-> typed columns, as JVM-side expressions.

A topic message is one row: every field of the declared schema, in schema
order, rendered as text and joined by TAB; a null field is printed ``null``
and no message key is written.  Decoding splits on TAB and parses field *i*
by declared type *i*; extra trailing fields are ignored and trailing empty
fields are dropped, as ``String.split`` does.

Every expression is built as one SQL expression per field (``F.expr``):
it stays inside whole-stage codegen, never touches Python per row, and
costs one parser call on the driver instead of a dozen function lookups.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The field separator, the text of a null field, and the
# declared types a topic schema may use (anything else is rejected up front).
SEPARATOR = "\t"
NULL_TEXT = "null"
TOPIC_TYPES = (
    T.IntegerType, T.LongType, T.ByteType, T.ShortType,
    T.DoubleType, T.FloatType, T.BooleanType, T.StringType,
)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_SEP_SQL = "'\\t'"


def check_topic_schema(schema: T.StructType) -> None:
    for f in schema.fields:
        if not isinstance(f.dataType, TOPIC_TYPES):
            raise TypeError(
                f"topic field {f.name!r} has type {f.dataType.simpleString()}; "
                "topics carry int, long, byte, short, double, float, boolean or string")


@lru_cache(maxsize=256)
def parse_schema(ddl: str) -> T.StructType:
    """``"id int, name string"`` -> StructType, parsed once per text."""
    return T._parse_datatype_string(ddl)


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_str(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# --------------------------------------------------------------------- encode (K1)
def _field_text(name: str) -> str:
    return f"coalesce(CAST({ident(name)} AS STRING), {sql_str(NULL_TEXT)})"


def encode_line(*cols: str) -> Column:
    """Join fields by TAB in the given order, null printed as ``null``."""
    return F.expr(f"concat_ws({_SEP_SQL}, {', '.join(_field_text(c) for c in cols)})")


def line_is_clean(*cols: str) -> Column:
    """True when no field holds a TAB or line break that would corrupt the line.

    Pass only text columns: numbers, booleans and timestamps never hold one.
    """
    if not cols:
        return F.lit(True)
    bad = " OR ".join(
        f"coalesce(contains({ident(c)}, {ch}), false)" for c in cols for ch in (_SEP_SQL, "'\\n'", "'\\r'"))
    return F.expr(f"NOT ({bad})")


def row_text(*cols: str) -> Column:
    """``[a,b,c]`` -- the text a Row prints as, nulls shown as ``null`` (M4)."""
    return F.expr(f"concat('[', concat_ws(',', {', '.join(_field_text(c) for c in cols)}), ']')")


# --------------------------------------------------------------------- decode (K2)
def split_line(line: str) -> Column:
    """Fields of a line column, split the way a JVM ``String.split`` does.

    Trailing empty fields are dropped (so a line ending in TAB is short and
    fails a strict decode, as in the reference), inner empty fields are kept,
    and a line of only TABs has no fields.  Only lines that end in a TAB pay
    for the regular expression.
    """
    return F.expr(_split_sql(line))


def _split_sql(line: str) -> str:
    c = ident(line)
    return (f"CASE WHEN NOT endswith({c}, {_SEP_SQL}) THEN split({c}, {_SEP_SQL}, -1) "
            f"WHEN {c} RLIKE '^\\t+$' THEN CAST(array() AS ARRAY<STRING>) "
            f"ELSE split(regexp_replace({c}, '\\t+$', ''), {_SEP_SQL}, -1) END")


def _valid_sql(text: str, dtype: T.DataType) -> str:
    """Whether ``text`` parses as ``dtype`` the way a JVM number parser would.

    Integers: optional sign and digits only (no blanks, no decimal point),
    and inside the type's range (``try_cast`` gives null on overflow).
    """
    if isinstance(dtype, _INTEGRAL):
        return f"({text} RLIKE '^[+-]?[0-9]+$' AND try_cast({text} AS {dtype.simpleString()}) IS NOT NULL)"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return f"(try_cast({text} AS DOUBLE) IS NOT NULL)"
    if isinstance(dtype, T.BooleanType):
        return f"(lower({text}) IN ('true', 'false'))"
    return "true"


def _parse_sql(text: str, dtype: T.DataType) -> str:
    if isinstance(dtype, T.StringType):
        return text
    if isinstance(dtype, T.BooleanType):
        return f"(lower({text}) = 'true')"
    return f"try_cast({text} AS {dtype.simpleString()})"


def decode_columns(line: str, schema: T.StructType, strict: bool = True, presplit: bool = False) -> list[Column]:
    """Typed columns for ``schema`` from the TAB line in column ``line``.

    strict: a missing field or a bad number/boolean raises, failing the job.
    Otherwise the field becomes null and :func:`reject_reason` names it.
    With ``presplit`` the column already holds the array of :func:`split_line`.
    """
    check_topic_schema(schema)
    parts = ident(line) if presplit else _split_sql(line)
    out = []
    for i, f in enumerate(schema.fields):
        text = f"get({parts}, {i})"
        typ = f.dataType.simpleString()
        if strict:
            missing = sql_str(f"topic line is missing field {i} ({f.name})")
            bad = sql_str(f"bad {typ} in field {f.name}: ")
            body = (f"CASE WHEN {text} IS NULL THEN raise_error({missing}) "
                    f"WHEN NOT {_valid_sql(text, f.dataType)} THEN raise_error(concat({bad}, {text})) "
                    f"ELSE {_parse_sql(text, f.dataType)} END")
        else:
            body = (f"CASE WHEN {text} IS NOT NULL AND {_valid_sql(text, f.dataType)} "
                    f"THEN {_parse_sql(text, f.dataType)} END")
        out.append(F.expr(f"CAST({body} AS {typ})").alias(f.name))
    return out


def reject_reason(line: str, schema: T.StructType, presplit: bool = False) -> Column:
    """First problem with a line, or null when it decodes cleanly."""
    parts = ident(line) if presplit else _split_sql(line)
    branches = []
    for i, f in enumerate(schema.fields):
        text = f"get({parts}, {i})"
        branches.append(f"WHEN {text} IS NULL THEN {sql_str(f'missing field {f.name}')}")
        branches.append(f"WHEN NOT {_valid_sql(text, f.dataType)} "
                        f"THEN {sql_str(f'bad {f.dataType.simpleString()} in field {f.name}')}")
    return F.expr("CASE " + " ".join(branches) + " END")
