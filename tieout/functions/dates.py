"""Calendar dates as the books keep them (Indian Standard Time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tieout.functions.text import let, quoted, strip

IST_OFFSET_SECONDS = 19800
_EXCEL_EPOCH = "1899-12-30"
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Written dates and times that are understood (fixed values).
_ISO_DAY = "(\\d{4}-\\d{2}-\\d{2}|\\d{8}|\\d{4}-W\\d{2}(?:-\\d)?|\\d{4}W\\d{2}\\d?)"
_ISO_TIME = "(\\d{2})(?::?(\\d{2})(?::?(\\d{2})(?:[.,]\\d+)?)?)?"
_ISO_ZONE = "(?:([+-])(\\d{2})(?::?(\\d{2})(?::?(\\d{2})(?:\\.\\d+)?)?)?)?"
_ISO = f"^{_ISO_DAY}(?:.{_ISO_TIME}{_ISO_ZONE})?$"
_TIME_SUFFIX = "(?i)[ T]\\d{1,2}:\\d{2}(?::\\d{2}(?:\\.\\d+)?)?\\s*(?:am|pm)?\\s*(?:Z|[+-]\\d{2}:?\\d{2})?$"

_SLASH = "^(\\d{1,2})/(\\d{1,2})/(\\d{4})$"
_DASHED = "^(\\d{1,2})-([A-Za-z]{3})-(\\d{2})$"
_YMD = "^(\\d{4})-(\\d{1,2})-(\\d{1,2})$"


def _int(text: Column) -> Column:
    return text.try_cast("int")


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where the calendar has no such day."""
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(year >= 1, F.try_to_date(text, "yyyy-MM-dd"))


def _iso_day(text: Column) -> Column:
    plain = F.when(text.rlike("^\\d{4}-\\d{2}-\\d{2}$"), text).when(
        text.rlike("^\\d{8}$"), F.regexp_replace(text, "^(\\d{4})(\\d{2})(\\d{2})$", "$1-$2-$3"))
    calendar = F.when(~text.startswith("0000"), F.try_to_date(plain, "yyyy-MM-dd"))
    return F.when(text.contains("W"), _week_day(text)).otherwise(calendar)


def _week_day(text: Column) -> Column:
    week = "^(\\d{4})-?W(\\d{2})-?(\\d?)$"
    year, number = _int(F.regexp_extract(text, week, 1)), _int(F.regexp_extract(text, week, 2))
    weekday = F.coalesce(_int(F.regexp_extract(text, week, 3)), F.lit(1))
    fourth = _day(year, F.lit(1), F.lit(4))  # always in week 1
    day = let(fourth, lambda d: F.date_add(d, (number - 1) * 7 + weekday - 1 - F.weekday(d)))
    # Week 53 exists only where it still belongs to the year it is counted in.
    return let(day, lambda d: F.when(number.between(1, 53) & weekday.between(1, 7) & (
        F.year(F.date_add(d, 3 - F.weekday(d))) == year), d))


def _iso_date(text: Column) -> Column:
    """The IST date of an ISO date or instant; null when the text is neither."""
    def instant(part: Column) -> Column:
        def number(i: int) -> Column:
            return F.coalesce(_int(F.get(part, F.lit(i))), F.lit(0))
        hour, minute, second = number(1), number(2), number(3)
        sign = F.when(F.get(part, F.lit(4)) == "-", -1).otherwise(1)
        offset = (number(5) * 3600 + number(6) * 60 + number(7)) * sign
        legal = (hour <= 23) & (minute <= 59) & (second <= 59) & (F.abs(offset) < 86400)
        shift = F.when(F.get(part, F.lit(4)) == "", 0).otherwise(
            F.floor((hour * 3600 + minute * 60 + second - offset + IST_OFFSET_SECONDS) / 86400)).cast("int")
        return F.when(legal, F.date_add(_iso_day(F.get(part, F.lit(0))), shift))

    groups = "|".join(f"${i}" for i in range(1, 9))
    return let(F.regexp_replace(text, "[Zz]$", "+00:00"), lambda zoned: F.when(
        zoned.rlike(_ISO), let(F.split(F.regexp_replace(zoned, _ISO, groups), "\\|"), instant)))


def _shaped_date(bare: Column) -> Column:
    """`struct(day, problem)` for the written shapes that are not ISO."""
    def group(pattern: str, index: int) -> Column:
        return F.regexp_extract(bare, pattern, index)

    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(group(_DASHED, 2))).cast("int")
    day = (F.when(bare.rlike(_SLASH), _day(_int(group(_SLASH, 3)), _int(group(_SLASH, 2)), _int(group(_SLASH, 1))))
           .when(bare.rlike(_DASHED), _day(2000 + _int(group(_DASHED, 3)), month, _int(group(_DASHED, 1))))
           .when(bare.rlike(_YMD), _day(_int(group(_YMD, 1)), _int(group(_YMD, 2)), _int(group(_YMD, 3)))))
    problem = (F.when(bare.rlike(_DASHED) & (month == 0), F.lit("unrecognised month: "))
               .when(bare.rlike(_SLASH) | bare.rlike(_DASHED) | bare.rlike(_YMD), F.lit("invalid calendar date: "))
               .otherwise(F.lit("unrecognised date shape: ")))
    return F.struct(day.alias("day"), problem.alias("problem"))


def parse_date(text: Column) -> Column:
    """`struct(day, error)`: exactly one side is set."""
    def checked(trimmed: Column) -> Column:
        shaped = let(strip(F.regexp_replace(trimmed, _TIME_SUFFIX, "")), _shaped_date)
        read = let(_iso_date(trimmed), lambda iso: F.when(
            iso.isNotNull(), F.struct(iso.alias("day"), F.lit("").alias("problem"))).otherwise(shaped))
        return let(read, lambda r: F.struct(r["day"].alias("day"), F.when(
            trimmed == "", F.lit("empty date")).when(
            r["day"].isNull(), F.concat(r["problem"], quoted(text))).alias("error")))
    return let(strip(F.coalesce(text, F.lit(""))), checked)


def excel_date(serial: Column) -> Column:
    """A numeric spreadsheet serial, fraction cut."""
    return F.date_add(F.lit(_EXCEL_EPOCH).cast("date"), serial.cast("int"))


def ist_text(instant: Column) -> Column:
    """`01 Sep 2026, 11:04 pm IST`; a dash where there is no instant."""
    local = F.from_utc_timestamp(instant, "Asia/Kolkata")
    text = F.concat(F.date_format(local, "dd MMM yyyy, hh:mm "), F.lower(F.date_format(local, "a")), F.lit(" IST"))
    return F.coalesce(text, F.lit("-"))
