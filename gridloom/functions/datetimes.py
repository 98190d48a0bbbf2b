"""Dates and business days in closed form: whole weeks by arithmetic, the rest by a literal week mask."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"Y": "year", "M": "month", "W": "week", "D": "day", "h": "hour", "m": "minute", "s": "second"}


def _days(d: Column) -> Column:
    """Days since Monday, 29 December 1969."""
    return F.datediff(d, F.to_date(F.lit("1969-12-29")))


def _mask(weekmask: str | Sequence[int]) -> list[int]:
    mask = [int(c) for c in weekmask]
    if len(mask) != 7 or not any(mask):
        raise ValueError("a week mask has seven places and a business day")
    return mask


def _holidays(days: Sequence[str], mask: list[int]) -> list[int]:
    import datetime

    numbers = sorted({(datetime.date.fromisoformat(d) - datetime.date(1969, 12, 29)).days for d in days if d})
    return [n for n in numbers if mask[n % 7]]


def _count_to(n: Column, mask: list[int], holidays: list[int]) -> Column:
    """Business days before day number n."""
    per_week = sum(mask)
    week = F.floor(n / 7)
    prefix = F.element_at(F.array(*[F.lit(sum(mask[:k])) for k in range(7)]), (n - week * 7 + 1).cast("int"))
    out = week * per_week + prefix
    if holidays:
        out = out - F.size(F.filter(F.array(*map(F.lit, holidays)), lambda h: h < n))
    return out


def is_busday(d: Column, weekmask="1111100", holidays: Sequence[str] = ()) -> Column:
    mask = _mask(weekmask)
    n = _days(d)
    out = F.element_at(F.array(*[F.lit(bool(m)) for m in mask]), (F.pmod(n, F.lit(7)) + 1).cast("int"))
    off = _holidays(holidays, mask)
    return out & ~n.isin(off) if off else out


def busday_count(begin: Column, end: Column, weekmask="1111100", holidays: Sequence[str] = ()) -> Column:
    """Business days in [begin, end); a reversed range counts negative, from the day after its end."""
    mask = _mask(weekmask)
    off = _holidays(holidays, mask)
    a, b = _days(begin), _days(end)
    forward = _count_to(b, mask, off) - _count_to(a, mask, off)
    back = _count_to(a + 1, mask, off) - _count_to(b + 1, mask, off)
    return F.when(b >= a, forward).otherwise(-back).cast("long")


def _roll_days(d: Column, step: int, weekmask, holidays) -> Column:
    """The nearest business day from d on, in the direction of ``step``."""
    reach = 7 + 2 * len(holidays)
    tries = F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda k: F.date_add(d, (k * step).cast("int")))
    return F.filter(tries, lambda x: is_busday(x, weekmask, holidays))[0]


def roll(d: Column, how: str, weekmask="1111100", holidays: Sequence[str] = ()) -> Column:
    ahead, behind = _roll_days(d, 1, weekmask, holidays), _roll_days(d, -1, weekmask, holidays)
    if how in ("forward", "following"):
        return ahead
    if how in ("backward", "preceding"):
        return behind
    if how == "modifiedfollowing":
        return F.when(F.month(ahead) == F.month(d), ahead).otherwise(behind)
    if how == "modifiedpreceding":
        return F.when(F.month(behind) == F.month(d), behind).otherwise(ahead)
    valid = is_busday(d, weekmask, holidays)
    if how == "nat":
        return F.when(valid, d)
    if how == "raise":
        return F.when(valid | d.isNull(), d).otherwise(F.raise_error(F.lit("not a business day")).cast("date"))
    raise ValueError(f"unknown roll {how}")


def busday_offset(d: Column, n: int, how: str = "raise", weekmask="1111100", holidays: Sequence[str] = ()) -> Column:
    """The n-th business day from the rolled date, by searching the days that n can reach."""
    start = roll(d, how, weekmask, holidays)
    mask = _mask(weekmask)
    reach = (abs(n) // sum(mask) + 2) * 7 + 7 * len(_holidays(holidays, mask))
    if n == 0:
        return start
    step = 1 if n > 0 else -1
    days = F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda k: F.date_add(start, (k * step).cast("int")))
    return F.filter(days, lambda x: is_busday(x, weekmask, holidays))[abs(n) - 1]


def truncate(d: Column, unit: str) -> Column:
    return F.date_trunc(UNITS[unit], d)


def datetime_as_string(d: Column, unit: str = "s") -> Column:
    return F.date_format(d, {"Y": "yyyy", "M": "yyyy-MM", "D": "yyyy-MM-dd", "h": "yyyy-MM-dd'T'HH", "m": "yyyy-MM-dd'T'HH:mm", "s": "yyyy-MM-dd'T'HH:mm:ss"}[unit])
