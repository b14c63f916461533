"""Strict JSON reading on VARIANT.

``from_json`` is not used for readings: it accepts trailing text, turns the number 7 into the
string "7" and reads "NaN" as a double. Here every field is checked by its JSON type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calendar date, 'T', time of day and a zone are all demanded. The first pattern is
# the common spelling, which Spark reads as it is; the second allows for the rarer ones.
_CLOCK = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
PLAIN_TIME_PATTERN = _CLOCK + r"(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})\z"
TIME_PATTERN = _CLOCK + r"([.,]\d{1,9})?(Z|[+-]\d{2}(:?\d{2})?)\z"

MEMBERS = "map<string,variant>"

# Texts that may hold a number beyond double precision: a long exponent or very many digits.
HUGE_NUMBER = r"[0-9](?:[eE]\+?[0-9]{3}|[0-9]{199})"
NUMBER = r"-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"

NUMBER_TYPES = r"\A(BIGINT|DOUBLE|FLOAT|DECIMAL.*)\z"


def parse_document(text: Column) -> Column:
    """VARIANT of ``text`` when it is exactly one JSON value, else NULL.

    The parser stops at the end of the first value and ignores what follows, so the text must
    also be a list of one element when put in brackets: junk breaks that list. Only a text that
    itself contains ``]`` could close the list early; such texts must also be an object's only
    member. A number out of range, which the parser reads as infinite, makes the text invalid; what
    stands in strings is no number.
    """
    elements = F.json_array_length(F.concat(F.lit("["), text, F.lit("]")))
    keys = F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = (elements == 1) & (~F.contains(text, F.lit("]")) | (F.size(keys) == 1))
    in_range = ~F.coalesce(F.when(text.rlike(HUGE_NUMBER), _infinite(text)), F.lit(False))
    return F.when(F.is_valid_utf8(text) & alone & in_range, F.try_parse_json(text))


def _infinite(text: Column) -> Column:
    """Whether a number outside strings is beyond double precision. Escapes go first, then strings."""
    unescaped = F.regexp_replace(text, F.lit(r"\\(?s:.)"), F.lit(""))
    bare = F.regexp_replace(unescaped, F.lit('"[^"]*"'), F.lit('""'))
    numbers = F.regexp_extract_all(bare, F.lit(NUMBER), F.lit(0))
    return F.exists(numbers, lambda n: F.abs(n.cast("double")) == float("inf"))


def members(document: Column) -> Column:
    """Top-level members as MAP<STRING, VARIANT>; NULL when the document is not an object."""
    return F.try_variant_get(document, "$", MEMBERS)


def named_members(document: Column, names: list[str]) -> Column:
    """STRUCT of the named members as VARIANT; NULL when the document is not an object."""
    fields = ", ".join(f"`{name}`: variant" for name in names)
    return F.try_variant_get(document, "$", f"struct<{fields}>")


def json_type(value: Column) -> Column:
    """JSON type of a VARIANT: STRING, BIGINT, DECIMAL(p,s), DOUBLE, BOOLEAN, VOID, ..."""
    return F.schema_of_variant(value)


def is_number(value: Column, kind: Column | None = None) -> Column:
    return (json_type(value) if kind is None else kind).rlike(NUMBER_TYPES)


def as_number(value: Column, kind: Column | None = None) -> Column:
    """Double of a finite JSON number; NULL for anything else.

    Here and below, ``kind`` is the value's JSON type where it is already known.
    """
    number = F.try_variant_get(value, "$", "double")
    return F.when(is_number(value, kind) & (F.abs(number) < F.lit(float("inf"))), number)


def as_text(value: Column, kind: Column | None = None) -> Column:
    """String of a JSON string; NULL for any other JSON type."""
    kind = json_type(value) if kind is None else kind
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))


def as_integer(
    value: Column, kind: Column | None = None, spark_type: str = "bigint"
) -> Column:
    """Integer of a JSON integer that fits ``spark_type``; NULL for anything else."""
    kind = json_type(value) if kind is None else kind
    return F.when(kind == "BIGINT", F.try_variant_get(value, "$", spark_type))


def as_time(value: Column, kind: Column | None = None) -> Column:
    """Timestamp of a JSON string in ISO-8601 with zone; NULL for anything else."""
    text = as_text(value, kind)
    spelled = F.regexp_replace(text, ",", ".")
    spelled = F.regexp_replace(spelled, r"([+-]\d{2})(\d{2})$", "$1:$2")
    spelled = F.regexp_replace(spelled, r"(T.*[+-]\d{2})$", "$1:00")
    return F.when(text.rlike(PLAIN_TIME_PATTERN), F.try_to_timestamp(text)).when(
        text.rlike(TIME_PATTERN), F.try_to_timestamp(spelled)
    )


def quoted(text: Column) -> Column:
    """JSON string literal of a string column."""
    wrapped = F.to_json(F.struct(text.alias("s")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


READERS = {
    "string": as_text,
    "long": as_integer,
    "int": lambda value, kind=None: as_integer(value, kind, "int"),
    "double": as_number,
    "timestamp": as_time,
}
