"""Dates, times, date-times and durations.

A duration is one number: the epoch second at which the duration ends if it
begins at the epoch. Its parts (years, months, days and seconds) are read back
from the calendar, so month arithmetic rolls over instead of clamping.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import types as T
from ..plans.values import Val, null
from . import register

DAY = 86400


def _l(c: Column) -> Column:
    return c.cast("bigint")


def _day_number(d: Column) -> Column:
    return F.unix_date(d).cast("bigint")


def _rolled(year: Column, month: Column, day: Column) -> Column:
    """A date from a year, a month of any size and a day that may overflow."""
    months = year.cast("bigint") * 12 + month.cast("bigint") - 1
    first = F.make_date(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))
    return F.date_add(first, (day - 1).cast("int"))


def _week_date(year: Column, week: Column, day: Column) -> Column:
    """ISO week dates: the Monday of week 1 holds January 4."""
    fourth = F.make_date(year.cast("int"), F.lit(1), F.lit(4))
    return F.date_add(fourth, (-F.weekday(fourth) + (week - 1) * 7 + day - 1).cast("int"))


def _group(s: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(s, pattern, n).try_cast("bigint")


def _date_text(s: Column) -> Column:
    one = lambda p, make: (s.rlike(f"\\A{p}\\z"), make(*(_group(s, f"^{p}$", i + 1) for i in range(p.count("(")))))
    fine_month = lambda m: (m >= 1) & (m <= 12)
    fine_day = lambda d: (d >= 1) & (d <= 31)
    first = F.lit(1)
    ymd = lambda y, m, d: F.when(fine_month(m) & fine_day(d), _rolled(y, m, d))
    week = lambda y, w, d: F.when((w >= 1) & (w <= 53) & (d >= 1) & (d <= 7), _week_date(y, w, d))
    cases = [
        one(r"(\d{4})-(\d{2})-(\d{2})", ymd),
        one(r"(\d{4})(\d{2})(\d{2})", ymd),
        one(r"(\d{4})-(\d{2})", lambda y, m: ymd(y, m, first)),
        one(r"(\d{4})(\d{2})", lambda y, m: ymd(y, m, first)),
        one(r"(\d{4})-?W(\d{2})-?(\d)", week),
        one(r"(\d{4})-?W(\d{2})", lambda y, w: week(y, w, first)),
        one(r"(\d{4})(\d{3})", lambda y, d: F.when((d >= 1) & (d <= 366), _rolled(y, first, d))),
        one(r"(\d{4})", lambda y: _rolled(y, first, first)),
    ]
    out = F.when(*cases[0])
    for c in cases[1:]:
        out = out.when(*c)
    return out


def _time_text(s: Column) -> Column:
    bare = F.regexp_replace(s, r"(\d)\.\d+$", "$1")
    p = r"(\d{2}):?(\d{2})?:?(\d{2})?"
    h, m, x = (F.coalesce(_group(bare, f"^{p}$", i), F.lit(0)) for i in (1, 2, 3))
    return F.when(bare.rlike(f"\\A{p}\\z") & (h < 24) & (m < 60) & (x < 60), h * 3600 + m * 60 + x)


def _stamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def seconds_of(v: Val) -> Column:
    """Epoch seconds (of a time: seconds since midnight)."""
    if v.type == T.DATE:
        return _day_number(v.col) * DAY
    if v.type == T.DATETIME:
        whole = v.col.cast("timestamp_ntz")
        return F.datediff(whole, F.lit("1970-01-01").cast("date")).cast("bigint") * DAY + _l(F.hour(whole)) * 3600 + _l(F.minute(whole)) * 60 + _l(F.second(whole))
    return v.col


def _fields(m: Val, known: tuple[str, ...], what: str) -> dict[str, Column]:
    out = {}
    for k, _ in m.type[1]:
        if k not in known:
            raise T.TypeProblem(f"{what}: unknown component {k}")
        out[k] = m.col[k]
    return out


_DATE_KEYS = ("year", "month", "day", "week", "dayOfWeek", "quarter", "dayOfQuarter", "ordinalDay")
_TIME_KEYS = ("hour", "minute", "second", "millisecond", "microsecond", "nanosecond")


def _date_map(f: dict[str, Column]) -> Column:
    get = lambda k, d=1: F.coalesce(f[k].cast("bigint"), F.lit(d)) if k in f else F.lit(d)
    year = get("year", 1970)
    if "week" in f:
        return _week_date(year, get("week"), get("dayOfWeek"))
    if "quarter" in f:
        return _rolled(year, (get("quarter") - 1) * 3 + 1, get("dayOfQuarter"))
    if "ordinalDay" in f:
        return _rolled(year, F.lit(1), get("ordinalDay"))
    return _rolled(year, get("month"), get("day"))


def _time_map(f: dict[str, Column]) -> Column:
    get = lambda k: F.coalesce(f[k].cast("bigint"), F.lit(0)) if k in f else F.lit(0)
    return get("hour") * 3600 + get("minute") * 60 + get("second")


@register("date")
def date(x: Val | None = None) -> Val:
    if x is None:
        return Val(F.current_date(), T.DATE)
    if x.type == T.STR:
        return Val(_date_text(x.col), T.DATE)
    if x.type in (T.DATE, T.DATETIME):
        return Val(x.col.cast("date"), T.DATE)
    if T.kind(x.type) == "map":
        return Val(_date_map(_fields(x, _DATE_KEYS, "date()")), T.DATE)
    return null(T.DATE)


@register("localtime")
def localtime(x: Val | None = None) -> Val:
    if x is None:
        now = F.current_timestamp()
        return Val(_l(F.hour(now)) * 3600 + _l(F.minute(now)) * 60 + _l(F.second(now)), T.TIME)
    if x.type == T.STR:
        return Val(_time_text(x.col), T.TIME)
    if x.type == T.DATETIME:
        return Val(F.pmod(seconds_of(x), F.lit(DAY)), T.TIME)
    if T.kind(x.type) == "map":
        return Val(_time_map(_fields(x, _TIME_KEYS, "localtime()")), T.TIME)
    return null(T.TIME)


@register("localdatetime")
def localdatetime(x: Val | None = None) -> Val:
    if x is None:
        return Val(F.date_trunc("second", F.current_timestamp()).cast("timestamp_ntz"), T.DATETIME)
    if x.type == T.STR:
        both = F.split(x.col, "T", 2)
        clock = F.when(F.size(both) > 1, _time_text(F.get(both, F.lit(1)))).otherwise(F.lit(0))
        return Val(_stamp(_day_number(_date_text(F.get(both, F.lit(0)))) * DAY + clock), T.DATETIME)
    if x.type in (T.DATE, T.DATETIME):
        return Val(x.col.cast("timestamp_ntz"), T.DATETIME)
    if T.kind(x.type) == "map":
        f = _fields(x, _DATE_KEYS + _TIME_KEYS, "localdatetime()")
        return Val(_stamp(_day_number(_date_map(f)) * DAY + _time_map(f)), T.DATETIME)
    return null(T.DATETIME)


def _duration(parts: dict[str, Column]) -> Column:
    get = lambda k: F.coalesce(parts[k].cast("double"), F.lit(0.0)) if k in parts else F.lit(0.0)
    whole = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))
    y, m = get("years"), get("months")
    months = whole(y) * 12 + whole(m)
    extra = (y - whole(y)) * 365.25 + (m - whole(m)) * 30.44
    base = _day_number(_rolled(F.lit(1970), months + 1, F.lit(1))) * DAY
    rest = (get("weeks") * 7 + get("days") + extra) * DAY + get("hours") * 3600 + get("minutes") * 60 + get("seconds")
    return base + whole(rest).cast("bigint")


@register("duration")
def duration(x: Val) -> Val:
    if x.type == T.STR:
        number = r"(-?\d+)"
        p = rf"P(?:{number}Y)?(?:{number}M)?(?:{number}W)?(?:{number}D)?(?:T(?:{number}H)?(?:{number}M)?(?:{number}S)?)?"
        names = ("years", "months", "weeks", "days", "hours", "minutes", "seconds")
        return Val(F.when(x.col.rlike(f"\\A{p}\\z"), _duration({k: _group(x.col, f"^{p}$", i + 1) for i, k in enumerate(names)})), T.DURATION)
    if T.kind(x.type) == "map":
        return Val(_duration(_fields(x, ("years", "months", "weeks", "days", "hours", "minutes", "seconds"), "duration()")), T.DURATION)
    return x if x.type == T.DURATION else null(T.DURATION)


def duration_parts(secs: Column) -> dict[str, Column]:
    d = F.date_from_unix_date(F.floor(secs / DAY).cast("int"))
    clock = F.pmod(secs, F.lit(DAY))
    return {
        "years": _l(F.year(d)) - 1970, "months": _l(F.month(d)) - 1, "days": _l(F.dayofmonth(d)) - 1,
        "hours": F.floor(clock / 3600), "minutes": F.pmod(F.floor(clock / 60), F.lit(60)), "seconds": F.pmod(clock, F.lit(60)),
    }


def component(v: Val, key: str) -> Val:
    """``value.key``; names are matched without case."""
    k = key.lower()
    if v.type == T.DURATION:
        parts = duration_parts(v.col)
        if k == "weeks":
            return Val(F.when(v.col.isNotNull(), F.lit(0.0)), T.FLOAT)
        if k in parts:
            return Val(parts[k].cast("double"), T.FLOAT)
    clock = seconds_of(v) if v.type != T.DATE else None
    if v.type in (T.DATE, T.DATETIME):
        d = v.col.cast("date")
        until = F.get(F.array(*map(F.lit, (0, 90, 181, 273))), (F.quarter(d) - 1).cast("int"))
        thursday = F.date_add(d, (F.lit(3) - F.weekday(d)).cast("int"))
        made = {
            "year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "dayofweek": F.dayofweek(d) - 1, "weekday": F.weekday(d) + 1,
            "ordinalday": F.dayofyear(d), "quarter": F.quarter(d), "week": F.weekofyear(d), "weekyear": F.year(thursday),
            "dayofquarter": F.dayofyear(d) - until + 1, "quarterday": F.dayofyear(d) - until + 1,
        }
        if k in made:
            return Val(_l(made[k]), T.INT)
    if v.type in (T.TIME, T.DATETIME):
        s = F.pmod(clock, F.lit(DAY))
        made = {"hour": F.floor(s / 3600), "minute": F.pmod(F.floor(s / 60), F.lit(60)), "second": F.pmod(s, F.lit(60))}
        if v.type == T.DATETIME:
            made |= dict.fromkeys(("millisecond", "microsecond", "nanosecond"), F.when(s.isNotNull(), F.lit(0)))
        if k in made:
            return Val(_l(made[k]), T.INT)
    raise T.TypeProblem(f"unknown {T.NAMES[v.type]} component {key}")


def shifted(v: Val, by: Val, sign: int) -> Val:
    """A temporal value plus or minus a duration."""
    p = {k: c * sign for k, c in duration_parts(by.col).items()}
    clock = p["hours"] * 3600 + p["minutes"] * 60 + p["seconds"]
    if v.type == T.DURATION:
        mine = duration_parts(v.col)
        return Val(_duration({k: mine[k] + p[k] for k in mine}), T.DURATION)
    if v.type == T.TIME:
        return Val(F.pmod(v.col + clock, F.lit(DAY)), T.TIME)
    d = v.col.cast("date")
    moved = _day_number(_rolled(_l(F.year(d)) + p["years"], _l(F.month(d)) + p["months"], _l(F.dayofmonth(d)) + p["days"])) * DAY
    if v.type == T.DATE:
        return Val(F.date_from_unix_date(F.floor((moved + clock) / DAY).cast("int")), T.DATE)
    return Val(_stamp(moved + F.pmod(seconds_of(v), F.lit(DAY)) + clock), T.DATETIME)


def _clock_text(s: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.pmod(F.floor(s / 60), F.lit(60))), two(F.pmod(s, F.lit(60))))


def text_of(v: Val) -> Column:
    if v.type == T.DATE:
        return F.date_format(v.col, "yyyy-MM-dd")
    if v.type == T.TIME:
        return F.when(v.col.isNotNull(), _clock_text(v.col))
    if v.type == T.DATETIME:
        return F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss")
    p = duration_parts(v.col)
    part = lambda k, c: F.when(p[k] != 0, F.concat(p[k].cast("string"), F.lit(c))).otherwise(F.lit(""))
    clock = F.concat(part("hours", "H"), part("minutes", "M"), part("seconds", "S"))
    return F.concat(F.lit("P"), part("years", "Y"), part("months", "M"), part("days", "D"), F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise(F.lit("")))
