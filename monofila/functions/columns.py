"""Column helpers: cleaning, dates, percentages and labels.

Everything here is a plain Column expression, so it stays inside code generation
and never moves a row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from monofila.rules import CHANNEL_LABELS, DEPARTMENT_LABELS, MONTHS


# Every character that counts as whitespace at the ends of a loaded field.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_blank(c: Column) -> Column:
    """Remove surrounding whitespace of any kind; nothing left means NULL."""
    return F.nullif(F.btrim(c, F.lit(WHITESPACE)), F.lit(""))


def blank_to_null(c: Column) -> Column:
    """Trim spaces only; nothing left means NULL."""
    return F.nullif(F.trim(c), F.lit(""))


def flag(predicate: Column) -> Column:
    """1 when the predicate holds, 0 when it is false or unknown."""
    return F.when(predicate, 1).otherwise(0)


def parse_dmy(c: Column) -> Column:
    """``dd/mm/yy`` to a timestamp without zone; anything else is NULL.

    Two-digit years from 70 on belong to the 1900s. Casting the rearranged text does
    not raise on impossible dates, and depends on no session zone.
    """
    text = F.trim(c)
    iso = F.regexp_replace(text, r"^(\d{1,2})/(\d{1,2})/(\d{2})$", "20$3-$2-$1")
    dated = F.nullif(iso, text).try_cast("timestamp_ntz")
    return F.when(F.year(dated) >= 2070, dated - F.make_ym_interval(F.lit(100))).otherwise(dated)


def parse_iso(c: Column) -> Column:
    """``yyyy-mm-dd hh:mm:ss`` to a timestamp without zone; anything else is NULL."""
    text = blank_to_null(c)
    shape = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
    return F.when(text.rlike(shape), text).try_cast("timestamp_ntz")


def period(c: Column) -> Column:
    """Month of a timestamp as ``yyyy-MM``."""
    return F.date_format(c, "yyyy-MM")


def pct(part: Column, total: Column) -> Column:
    """Percentage with two decimals, half up; NULL when the total is zero or NULL."""
    return _half_up(part, total, 100)


def pct1(part: Column, total: Column) -> Column:
    """Percentage with one decimal, half up; 0 when the total is zero."""
    return F.coalesce(_half_up(part, total, 10), F.lit(0.0))


def _half_up(part: Column, total: Column, scale: int) -> Column:
    """Rounded in integers, so that exact halves never depend on binary fractions. Halves
    go up for negative parts too: the division takes the floor."""
    p, t = part.cast("bigint"), F.nullif(total.cast("bigint"), F.lit(0).cast("bigint"))
    above, below = F.lit(200 * scale) * p + t, F.lit(2) * t
    return F.call_function("div", above - F.pmod(above, below), below).cast("double") / F.lit(float(scale))


def lookup(c: Column, names: Mapping[str, str]) -> Column:
    """Value of a small fixed mapping, NULL when absent. No join, no broadcast."""
    entries = [F.lit(x) for pair in names.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), c)


def channel_label(c: Column) -> Column:
    return F.coalesce(lookup(c, CHANNEL_LABELS), c)


def department_label(c: Column, blank: str | None) -> Column:
    """Department name by the first two characters, ``Código x`` when unknown."""
    code = F.trim(F.coalesce(c, F.lit("")))
    named = F.coalesce(lookup(F.left(code, F.lit(2)), DEPARTMENT_LABELS), F.concat(F.lit("Código "), code))
    return F.when(code == "", F.lit(blank).cast("string")).otherwise(named)


def month_label(c: Column) -> Column:
    """``2026-01`` as ``ene 2026``."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    return F.concat(F.try_element_at(names, F.substring(c, 6, 2).try_cast("int")), F.lit(" "), F.left(c, F.lit(4)))


def serial_date(c: Column) -> Column:
    """Days since 1899-12-30, the spreadsheet day number."""
    return F.datediff(c.cast("date"), F.lit("1899-12-30").cast("date"))


def traffic_light(value: Column, good: float, fair: float, higher_is_better: bool) -> Column:
    ok = value >= good if higher_is_better else value <= good
    warn = value >= fair if higher_is_better else value <= fair
    return F.when(ok, "bien").when(warn, "alerta").otherwise("mal")


def thousands(c: Column) -> Column:
    """Printed number: separators, a dash for NULL."""
    return F.coalesce(F.format_number(c, 0), F.lit("—"))
