"""Cells of text tables to numbers and dates, and back to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands for a missing value, whatever the case.
MISSING = ["", "na", "nan", "null", "n/a", "-", "--", "---", "none", "missing"]
# Month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def bound(x: Column, f) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def numeric_cell(raw: Column) -> Column:
    """A number with a decimal point or comma. With both marks the last is the decimal one and the other groups thousands; a lone
    comma groups thousands if every group has three digits, else it is the decimal mark."""
    return bound(F.trim(raw), _number)


def _number(t: Column) -> Column:
    commas, points = F.regexp_count(t, F.lit(",")), F.regexp_count(t, F.lit(r"\."))
    comma_last = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
    both = F.when(comma_last, F.when(commas == 1, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))).otherwise(F.when(points == 1, F.replace(t, F.lit(","), F.lit(""))))
    only = F.when(t.rlike(r"^[+-]?\d{1,3}(,\d{3})+$"), F.replace(t, F.lit(","), F.lit(""))).when(commas == 1, F.replace(t, F.lit(","), F.lit(".")))
    plain = F.when((commas > 0) & (points > 0), both).when(commas > 0, only).otherwise(t)
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def value_cell(raw: Column, missing: float | None = None) -> Column:
    """A finite number, or NULL for missing tokens, broken cells and the declared missing value."""
    v = F.when(~F.lower(F.trim(raw)).isin(MISSING), numeric_cell(raw))
    v = F.when(F.abs(v) != float("inf"), v)
    return v if missing is None else F.nullif(v, F.lit(float(missing)))


def pivot_year(y: Column) -> Column:
    """Two digits: 00 to 68 are 2000 to 2068, 69 to 99 are 1969 to 1999."""
    return F.when(y > 99, y).when(y <= 68, y + 2000).otherwise(y + 1900)


def _year(t: Column, pattern: str, i: int) -> Column:
    """A year of one or two digits counts from its pivot."""
    y = _part(t, pattern, i)
    return F.when(F.length(F.regexp_extract(t, pattern, i)) > 2, y).otherwise(pivot_year(y))


def _part(t: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(t, pattern, i), F.lit("")).try_cast("int")


def _stamp(y: Column, m: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """NULL where a field is out of range; times are optional."""
    z = F.lit(0)
    return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), F.try_make_timestamp(y, m, d, F.coalesce(h, z), F.coalesce(mi, z), F.coalesce(s, z)))


# The shapes of dates that are read, each with an optional time.
ISO = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?)?"
NUMERIC = r"^(\d{1,4})[/\-.](\d{1,2})[/\-.](\d{1,4})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}))?)?$"
JULIAN = r"^(\d{4})[-_ ]?(\d{3})$"
DAY_NAME = r"^(\d{1,2})[-/. ]([A-Za-z]{3,9})[-/. ]+(\d{2,4})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}))?)?$"
NAME_DAY = r"^([A-Za-z]{3,9})[-/. ]+(\d{1,2})(?:,\s*|[-/. ]+)(\d{2,4})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}))?)?$"


def iso_date(raw: Column) -> Column:
    """A date that starts with a year of four digits."""
    return bound(F.trim(raw), lambda t: F.when(t.rlike(ISO), _stamp(*[_part(t, ISO, i) for i in range(1, 7)])).when(t.rlike(r"^\d{4}\D"), _numeric(t, "ymd")))


def numeric_date(raw: Column, order: str) -> Column:
    """a/b/c with the given order, dmy, mdy or ymd; four leading digits always mean year, month, day."""
    return bound(F.trim(raw), lambda t: _numeric(t, order))


def _numeric(t: Column, order: str) -> Column:
    a, b, c, h, mi, s = (_part(t, NUMERIC, i) for i in range(1, 7))
    day, month, year = {"dmy": (a, b, _year(t, NUMERIC, 3)), "mdy": (b, a, _year(t, NUMERIC, 3)), "ymd": (c, b, _year(t, NUMERIC, 1))}[order]
    return F.when(t.rlike(r"^\d{4}"), _stamp(a, b, c, h, mi, s)).otherwise(_stamp(year, month, day, h, mi, s))


def month_number(name: Column) -> Column:
    """Three letters or more of a month's name, or sept."""
    n = F.lower(name)
    out = F.lit(None).cast("int")
    for i, full in enumerate(MONTHS, 1):
        out = F.when((F.length(n) >= 3) & F.lit(full).startswith(n), i).otherwise(out)
    return out


def named_date(raw: Column) -> Column:
    """5-Mar-2001, 05.March.01, March 5, 2001 or Mar-05-2001; a month and a year alone are no date."""
    return bound(F.trim(raw), _named)


def _named(t: Column) -> Column:
    first = _stamp(_year(t, DAY_NAME, 3), month_number(F.regexp_extract(t, DAY_NAME, 2)), _part(t, DAY_NAME, 1), *[_part(t, DAY_NAME, i) for i in (4, 5, 6)])
    second = _stamp(_year(t, NAME_DAY, 3), month_number(F.regexp_extract(t, NAME_DAY, 1)), _part(t, NAME_DAY, 2), *[_part(t, NAME_DAY, i) for i in (4, 5, 6)])
    return F.when(t.rlike(DAY_NAME), first).when(t.rlike(NAME_DAY), second)


def julian_date(raw: Column) -> Column:
    """Year and day of the year: 2001-365, 2001365."""
    return bound(F.trim(raw), _julian)


def _julian(t: Column) -> Column:
    y, doy = _part(t, JULIAN, 1), _part(t, JULIAN, 2)
    days = F.dayofyear(F.last_day(F.try_make_timestamp(y, F.lit(12), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")))
    start = F.try_make_timestamp(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return F.when(doy.between(1, days), F.date_add(start, doy - 1).cast("timestamp"))


def date_format_of(rows: DataFrame, column: str) -> str:
    """julian, iso, mixed, month-name, dmy, mdy or ambiguous, from all cells of a column (one aggregation)."""
    t = F.trim(F.col(column))
    a, b = _part(t, NUMERIC, 1), _part(t, NUMERIC, 2)
    all_ = lambda p: F.bool_and(t.rlike(p))
    name = DAY_NAME + "|" + NAME_DAY
    r = rows.where((t != "") & t.isNotNull()).agg(
        all_(JULIAN).alias("julian"), all_(ISO).alias("iso"), all_(name).alias("named"), F.bool_and(t.rlike(ISO) | t.rlike(r"^\d{4}[/\-.]") | t.rlike(name)).alias("mixed"),
        F.max(F.when(~t.rlike(r"^\d{4}"), a) > 12).alias("first"), F.max(F.when(~t.rlike(r"^\d{4}"), b) > 12).alias("second"),
    ).collect()[0]
    for kind in ("julian", "iso", "named", "mixed"):
        if r[kind]:
            return "month-name" if kind == "named" else kind
    if bool(r["first"]) == bool(r["second"]):
        return "ambiguous"
    return "dmy" if r["first"] else "mdy"


def parsed_date(raw: Column, kind: str) -> Column:
    """A cell's date. With a given order (ymd, mdy, dmy) dates that tell their own order are read, too."""
    if kind in ("dmy", "mdy", "ymd"):
        return F.coalesce(iso_date(raw), named_date(raw), numeric_date(raw, kind))
    return {"julian": julian_date(raw), "iso": iso_date(raw), "month-name": named_date(raw)}.get(kind, F.coalesce(iso_date(raw), numeric_date(raw, "dmy"), named_date(raw)))


def shown_number(v: Column, digits: int) -> Column:
    """Fixed digits, n/a for what is missing or not finite, and no minus before zero."""
    text = F.format_string(f"%.{digits}f", v)
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "n/a").otherwise(F.regexp_replace(text, r"^-(0(\.0*)?)$", "$1"))


def shown_stamp(ts: Column, step_ms: Column) -> Column:
    """A date for steps of a day or more, else minutes, or seconds for steps under a minute."""
    return F.when(step_ms >= 86_400_000, F.date_format(ts, "yyyy-MM-dd")).when(step_ms >= 60_000, F.date_format(ts, "yyyy-MM-dd HH:mm")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))


def safe_cell(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula; numbers stay as they are."""
    return F.when(c.rlike(r"^[=+\-@\t\r]") & ~c.rlike(NUMBER), F.concat(F.lit("'"), c)).otherwise(c)
