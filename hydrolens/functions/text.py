"""Text expressions: keys, messages, summary lines and glob patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrolens import constants as C


def kpi_key(window_start: Column) -> Column:
    return F.concat(F.lit(C.KPI_KEY_PREFIX), F.date_format(window_start, C.KPI_KEY_FORMAT))


def ranking_member(millis: Column) -> Column:
    return F.concat(F.lit(C.RANKING_MEMBER_PREFIX), millis.cast("string"))


def stream_id_millis(stream_id: Column) -> Column:
    """Milliseconds part of an ``ms-seq`` id."""
    return F.split_part(stream_id, F.lit("-"), F.lit(1)).try_cast("bigint")


def fixed(value: Column, digits: int | None = 2) -> Column:
    """A double as text, with a fixed number of decimals or, without one, in full.

    What no decimal holds (not a number, infinite, huge) is shown as it is.
    """
    plain = value.cast("string")
    return plain if digits is None else F.coalesce(value.try_cast(f"decimal(38,{digits})").cast("string"), plain)


def alert_message(ph: Column, digits: int | None = None) -> Column:
    """The alert's text; the value in full, so that it never reads as inside the band."""
    return F.concat(F.lit(C.ALERT_TEXT), fixed(ph, digits))


def summary_line(
    temperature: Column, ph: Column, conductivity: Column, litres: Column, digits: int = 2
) -> Column:
    """One reading as a line of text; an absent measure shows as None."""

    def show(value: Column) -> Column:
        return F.coalesce(fixed(value, digits), F.lit("None"))

    return F.concat(
        F.lit("T="), show(temperature), F.lit("C, pH="), show(ph), F.lit(", EC="),
        show(conductivity), F.lit(", Nível="), show(litres), F.lit("L"),
    )


def glob_to_regex(pattern: str) -> str:
    """Anchored regular expression for a key glob.

    ``*`` any text, ``?`` one character, ``[ab]`` ``[a-c]`` ``[^a]`` one of or none
    of a set, a backslash takes the next character as it is.
    """
    out, rest = [], pattern
    while rest:
        bracket = re.match(r"\[(\^?)((?:\\.|[^\]\\])*)\]", rest, re.S)
        if rest[0] == "*":
            piece, rest = ".*", rest[1:]
        elif rest[0] == "?":
            piece, rest = ".", rest[1:]
        elif rest[0] == "\\" and len(rest) > 1:
            piece, rest = re.escape(rest[1]), rest[2:]
        elif bracket:
            body = re.sub(
                r"\\(.)|([\[&^~])", lambda m: re.escape(m[1]) if m[1] else "\\" + m[2], bracket[2]
            )
            if body:
                piece = f"[{bracket[1]}{body}]"
            else:
                piece = "." if bracket[1] else "(?!)"
            rest = rest[bracket.end():]
        else:
            piece, rest = re.escape(rest[0]), rest[1:]
        out.append(piece)
    return "(?s)\\A" + "".join(out) + "\\z"


def glob_match(text: Column, pattern: str) -> Column:
    return text.rlike(glob_to_regex(pattern))
