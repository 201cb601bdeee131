"""Reading JSON payloads with bilingual keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Decimal or exponent notation, or a special value, with space around it.
_NUMBER = r"(?i)^\s*([+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|nan|inf(?:inity)?))\s*$"


def number(text: Column) -> Column:
    """Text to double; null where the text is not a plain number."""
    return F.regexp_extract(text, _NUMBER, 1).try_cast("double")


# Epoch milliseconds of the years 1 to 9999.
_FIRST_MS, _LAST_MS = -62_135_596_800_000, 253_402_300_799_999


def instant(millis: Column) -> Column:
    """Epoch milliseconds to a timestamp; null for what is no time (not a number,
    infinite, out of range)."""
    usable = (millis >= _FIRST_MS) & (millis <= _LAST_MS)
    return F.timestamp_millis(F.when(usable, millis).try_cast("bigint"))


def with_fields(raw: DataFrame, keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """Adds ``fields``: what the payload holds under the names of ``keys``.

    ``fields`` is null unless the payload is exactly one JSON object (wrapping
    it in an array makes trailing text malformed too). Each name is a struct of
    ``present`` (one of its keys is there), ``empty`` (there with a null value)
    and ``number``. Of a key given twice the last one counts.

    The struct comes out of a generator with one row per payload, because the
    optimizer would copy a plain column's parsing into every filter and
    expression that uses it.
    """
    wrapped = F.concat(F.lit("["), F.col("payload"), F.lit("]"))
    parses, place = [], {}
    # Names that differ in case only can't be told apart in one struct.
    for spelling in dict.fromkeys(key for spellings in keys.values() for key in spellings):
        number_of = sum(known.lower() == spelling.lower() for known in place)
        place[spelling] = number_of
        if number_of == len(parses):
            parses.append([])
        parses[number_of].append(spelling)

    def schema(names: Sequence[str]) -> T.ArrayType:
        return T.ArrayType(T.StructType([T.StructField(name, T.StringType()) for name in names]))

    parsed = [F.from_json(wrapped, schema(names)).alias(f"p{i}") for i, names in enumerate(parses)]
    names = F.json_object_keys("payload").alias("names")

    def read(one: Column) -> Column:
        found = []
        for name, spellings in keys.items():
            text: Column | None = None
            present = F.lit(False)
            for key in spellings:  # the first key the object holds, even with a null value
                there = F.array_contains(one["names"], key)
                value = one[f"p{place[key]}"][0][key]
                text = F.when(there, value) if text is None else text.when(there, value)
                present = present | there
            field = F.struct(
                present.alias("present"),
                (present & text.isNull()).alias("empty"),
                number(text).alias("number"),
            )
            found.append(field.alias(name))
        single = (F.size(one["p0"]) == 1) & one["p0"][0].isNotNull() & one["names"].isNotNull()
        return F.when(single, F.struct(*found))

    once = F.array(F.struct(*parsed, names))
    return raw.select("*", F.explode(F.transform(once, read)).alias("fields"))


def decode_text(raw: Column) -> Column:
    """Bytes to text."""
    return F.decode(raw, "UTF-8")
