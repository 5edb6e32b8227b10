"""What a cell's text is: a number in some locale, a date, or text; and units."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import trim_all

_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_SPECIAL = r"^([+-]?(?i:inf|infinity)|(?i:nan))$"
# The units a header may end in after a blank, dash or underscore, and what is converted.
SUFFIX_UNITS = ("mg/L", "g/L", "ug/L", "°C", "°F", "Brix", "%", "ppm", "ppb")
UNIT_TARGETS = {"g/L": "mg/L", "ug/L": "mg/L", "°F": "°C"}


def plain_number(value: Column, decimal: str | None = None, thousands: str | None = None) -> Column:
    """A trimmed text as it would be spelled with a full stop as decimal mark and without grouping.

    Per cent signs go. Without ``decimal`` the later of comma and full stop is the decimal mark, and
    a lone comma is one too. Without ``thousands`` every other of comma, full stop and blank goes."""
    text = F.trim(F.translate(value, "\u00a0%", " "))

    def spelled(mark: str, group: str | None) -> Column:
        gone = group.replace(mark, "") if group else ",. ".replace(mark, "")
        return F.translate(text, mark + gone, ".")

    if decimal:
        return spelled(decimal, thousands)
    comma, stop = F.instr(F.reverse(value), ","), F.instr(F.reverse(value), ".")
    both = F.when(comma < stop, spelled(",", ".")).otherwise(spelled(".", ","))
    return F.when((comma > 0) & (stop > 0), both).when(comma > 0, spelled(",", thousands)).otherwise(spelled(".", thousands))


def to_number(plain: Column) -> Column:
    """The number that a plain spelling stands for, else null; too large ones are null too."""
    number = plain.try_cast("double")
    special = F.regexp_replace(F.lower(plain), "^\\+", "").try_cast("double")
    return F.when(plain.rlike(_DECIMAL), F.when(F.abs(number) < float("inf"), number)).when(plain.rlike(_SPECIAL), special)


def parse_numeric(value: Column, decimal: str | None = None, thousands: str | None = None) -> Column:
    """The number that a text spells in some locale, else null; see ``plain_number``."""
    return to_number(plain_number(trim_all(value), decimal, thousands))


def _valid_day(year: Column, month: Column, day: Column) -> Column:
    year, month, day = (x.try_cast("int") for x in (year, month, day))
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    longest = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return month.between(1, 12) & day.between(F.lit(1), longest)


_CLOCK = r"([01]?\d|2[0-3]):[0-5]\d"
_SECONDS = r":[0-5]\d([.,]\d+)?"
_YEAR_FIRST = rf"^\d{{4}}(/\d{{2}}/\d{{2}}|-\d{{2}}-\d{{2}}( {_CLOCK}({_SECONDS})?|T{_CLOCK}{_SECONDS}(Z|[+-]\d{{2}}:\d{{2}}))?)$"
_YEAR_LAST = r"^\d{2}/\d{2}/\d{4}$"
_MONTH_FIRST = rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}} {_CLOCK}({_SECONDS})?$"


def is_datetime(text: Column) -> Column:
    """Whether a trimmed text is a date, or a date with a time, in one of the known layouts and on the calendar."""
    part = F.split(text, "[/ ]")
    first = text.rlike(_YEAR_FIRST) & _valid_day(F.substring(text, 1, 4), F.substring(text, 6, 2), F.substring(text, 9, 2))
    a, b, year = F.substring(text, 1, 2), F.substring(text, 4, 2), F.substring(text, 7, 4)
    last = text.rlike(_YEAR_LAST) & (_valid_day(year, b, a) | _valid_day(year, a, b))
    month = text.rlike(_MONTH_FIRST) & _valid_day(F.get(part, F.lit(2)), F.get(part, F.lit(0)), F.get(part, F.lit(1)))
    return F.coalesce(first, F.lit(False)) | F.coalesce(last, F.lit(False)) | F.coalesce(month, F.lit(False))


def split_unit(header: str) -> tuple[str, str]:
    """(name, unit) of a header: a unit in parentheses or brackets at its end, or one of ``SUFFIX_UNITS``
    after any run of blanks, dashes and underscores."""
    for pattern in (r"^(.*?)\s*\(([^()]+)\)\s*$", r"^(.*?)\s*\[([^\[\]]+)\]\s*$", rf"^(.*?)[_ -]+({'|'.join(map(re.escape, SUFFIX_UNITS))})\s*$"):
        found = re.match(pattern, header.strip())
        if found and found[1].strip() and found[2].strip():
            return found[1].strip(), found[2].strip()
    return header.strip(), ""


def convert_unit(value: Column, unit: str, targets: dict[str, str] | None = None) -> tuple[Column, str]:
    """(value, unit) in the target unit, if there is one for ``unit``."""
    target = (UNIT_TARGETS if targets is None else targets).get(unit)
    if (unit, target) == ("g/L", "mg/L"):
        return value * 1000, target
    if (unit, target) == ("ug/L", "mg/L"):
        return value / 1000, target
    if (unit, target) == ("°F", "°C"):
        return (value - 32) * 5.0 / 9.0, target
    return value, unit
