"""List functions."""

from pyspark.sql import functions as F

from .registry import Args, Value, fn


def slice_of(x, start, end, size):
    """x[start:end] as Python slices: negative positions count from the end."""
    a = F.greatest(F.when(start < 0, size + start).otherwise(start), F.lit(0))
    b = size if end is None else F.least(F.when(end < 0, size + end).otherwise(end), size)
    return a.cast("int"), F.greatest(b - a, F.lit(0)).cast("int")


@fn("grel.ttl#array_get")
def array_get(a: Args) -> Value:
    start = a.whole("param_int_i_from")
    end = a.whole("param_int_i_opt_to") if a.has("param_int_i_opt_to") else None
    if a.is_list("p_array_a"):
        x = a.list("p_array_a")
        if end is not None:
            at, n = slice_of(x, start, end, F.size(x))
            return Value(F.slice(x, at + 1, n), "list")
        return Value(F.get(x, F.when(start < 0, F.size(x) + start).otherwise(start).cast("int")))
    s, x = a.text("p_array_a"), a.list("p_array_a")
    if end is not None:
        at, n = slice_of(s, start, end, F.length(s))
        return Value(F.substring(s, at + 1, n))
    at = lambda size: F.when(start < 0, size + start).otherwise(start).cast("int")
    return Value(F.when(x.isNotNull(), F.get(x, at(F.size(x)))).otherwise(F.nullif(F.substring(s, at(F.length(s)) + 1, F.lit(1)), F.lit(""))))


@fn("grel.ttl#array_length")
def array_length(a: Args) -> Value:
    x = a.list("p_array_a")
    return Value(F.when(x.isNotNull(), F.size(x)), "int")


@fn("grel.ttl#array_sum")
def array_sum(a: Args) -> Value:
    x = a.list("p_array_a")
    total = F.aggregate(x, F.lit(0.0), lambda s, e: s + F.coalesce(e.try_cast("double"), F.lit(0.0)))
    whole = F.forall(x, lambda e: e.try_cast("double").isNull() | e.rlike(r"^\s*[+-]?\d+\s*$"))
    return Value(F.when(whole, total.cast("long").cast("string")).otherwise(Value(total, "double").text()))


@fn("grel.ttl#array_slice")
def array_slice(a: Args) -> Value:
    x = a.list("p_array_a")
    end = a.whole("param_int_i_opt_to") if a.has("param_int_i_opt_to") else None
    at, n = slice_of(x, a.whole("param_int_i_from"), end, F.size(x))
    return Value(Value(F.slice(x, at + 1, n), "list").text())


@fn("grel.ttl#array_join")
def array_join(a: Args) -> Value:
    x, sep = a.list("p_array_a"), a.text("p_string_sep")
    joined = F.aggregate(x, F.lit(None).cast("string"), lambda s, e: F.when(s.isNull(), e).otherwise(F.concat(s, sep, e)))
    joined = F.coalesce(joined, F.lit(""))
    if a.compat:
        joined = F.when(sep == "", F.lit("")).otherwise(joined)
    return Value(joined if a.is_list("p_array_a") else F.when(x.isNotNull(), joined).otherwise(a.text("p_array_a")))


@fn("grel.ttl#array_reverse")
def array_reverse(a: Args) -> Value:
    return Value(F.reverse(a.list("p_array_a")), "list") if a.is_list("p_array_a") else _either(a, F.reverse)


def _either(a: Args, f) -> Value:
    x = a.list("p_array_a")
    return Value(F.coalesce(Value(f(x), "list").text(), a.text("p_array_a")))


@fn("grel.ttl#array_uniques")
def array_uniques(a: Args) -> Value:
    if a.is_list("p_array_a"):
        return Value(F.array_distinct(a.list("p_array_a")), "list")
    chars = F.filter(F.split(a.text("p_array_a"), ""), lambda c: c != "")
    return Value(F.array_distinct(F.coalesce(a.list("p_array_a"), chars)), "list")


@fn("grel.ttl#array_sort")
def array_sort(a: Args) -> Value:
    return Value(F.sort_array(a.list("p_array_a")), "list")
