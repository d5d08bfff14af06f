"""Dates. A time is an ISO text; offsets are kept in texts and dropped in arithmetic."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import Args, Value, fn

#: Strptime codes as Java patterns.
CODES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "z": "xx", "Z": "z", "j": "DDD", "%": "%"}


def java_pattern(code: str) -> str:
    """A strptime format as a Java pattern; other letters are quoted."""
    out = re.sub(r"%(.)|([A-Za-z]+)", lambda m: CODES[m[1]] if m[1] in CODES else f"'{m[2]}'" if m[2] else m[0], code)
    return out


def quote_letters(pattern: str) -> str:
    """A pattern in which the T between date and time, and a final Z, stand for themselves."""
    if "'" in pattern:
        return pattern
    return re.sub(r"T(?=[Hhk])", "'T'", re.sub(r"(?<=s)Z$", "XXX", pattern))


def moment(s: Column) -> Column:
    """An ISO text as a timestamp without its offset."""
    return F.regexp_replace(s, r"(Z|[+-]\d\d:?\d\d)$", "").try_cast("timestamp_ntz")


def iso(t: Column) -> Column:
    s = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.regexp_replace(s, r"\.000000$", "")


def _parse(a: Args, pattern: str) -> Value:
    s = a.text("valueParameter")
    zoned = bool(re.search(r"X+$|x+$", pattern))
    at = F.try_to_timestamp(s, F.lit(pattern)) if zoned else s.try_cast("timestamp_ntz") if pattern == "" else F.try_to_timestamp(s, F.lit(pattern)).cast("timestamp_ntz")
    return Value(F.concat(iso(at), F.lit("+00:00")) if zoned else iso(at))


@fn("grel.ttl#date_toDate")
def to_date(a: Args) -> Value:
    return _parse(a, quote_letters(a.constant("p_string_pattern")))


@fn("built-in.ttl#date_toDate")
def to_date_strptime(a: Args) -> Value:
    return _parse(a, java_pattern(a.constant("p_string_pattern")))


@fn("grel.ttl#date_now")
def now(a: Args) -> Value:
    """The time of the query: one for all its rows."""
    return Value(iso(F.localtimestamp()))


def _unit(a: Args, name: str) -> Column:
    return F.lower(F.regexp_replace(a.text(name), r"(?<=\w\w)s$", ""))


_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


@fn("grel.ttl#date_diff")
def diff(a: Args) -> Value:
    """Whole units between two times, absolute; weeks are a fraction. Unknown units have no result."""
    x, y = (moment(a.text(n)) for n in ("p_datetime_d", "p_datetime_d2"))
    seconds = F.abs(F.unix_seconds(x.cast("timestamp")) - F.unix_seconds(y.cast("timestamp")))
    unit, out = _unit(a, "p_string_timeunit"), None
    for name, n in _SECONDS.items():
        v = Value((F.floor(seconds / 86400) / 7).cast("double"), "double").text() if name == "week" else F.floor(seconds / n).cast("string")
        out = F.when(unit == name, v) if out is None else out.when(unit == name, v)
    return Value(out)


@fn("grel.ttl#date_datePart")
def part(a: Args) -> Value:
    t, unit = moment(a.text("p_date_d")), F.lower(a.text("p_string_unit"))
    micros = F.unix_micros(t.cast("timestamp"))
    parts = {
        ("year", "years"): F.year(t), ("month", "months"): F.month(t), ("week", "weeks", "w"): F.floor((F.dayofmonth(t) - 1) / 7) + 1,
        ("day", "days", "d"): F.dayofmonth(t), ("weekday",): F.date_format(t, "EEEE"), ("hour", "hours", "h"): F.hour(t),
        ("minute", "minutes", "min"): F.minute(t), ("second", "seconds", "sec", "s"): F.second(t),
        ("millisecond", "milliseconds", "ms", "s."): F.floor(F.pmod(micros, F.lit(1000000)) / 1000), ("nanos", "nano", "n"): F.pmod(micros, F.lit(1000000)) * 1000, ("time",): F.floor(micros / 1000),
    }
    out = None
    for names, v in parts.items():
        out = (F if out is None else out).when(unit.isin(*names), v.cast("string"))
    return Value(out)


@fn("grel.ttl#date_inc")
def inc(a: Args) -> Value:
    """A time later by n units; months and years keep the day where the month has it, else its last one."""
    t, n, unit = moment(a.text("p_date_d")), a.whole("p_dec_n").cast("int"), _unit(a, "p_string_unit")
    zero = F.lit(0)
    moved = {
        "year": F.make_interval(years=n), "month": F.make_interval(months=n), "week": F.make_interval(weeks=n), "day": F.make_interval(days=n),
        "hour": F.make_interval(hours=n), "minute": F.make_interval(mins=n), "second": F.make_interval(years=zero, secs=n.cast("decimal(18,6)")),
    }
    out = None
    for name, by in moved.items():
        out = (F if out is None else out).when(unit == name, F.replace(iso(t + by), F.lit("T"), F.lit(" ")))
    return Value(out)
