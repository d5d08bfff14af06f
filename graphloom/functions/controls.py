"""Conditions and booleans; conditions are texts, read without evaluating code."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import Args, Value, fn

_COMPARISON = r"""^\s*(?:'([^']*)'|"([^"]*)"|([-+.\w]+))\s*(==|!=|<=|>=|<|>)\s*(?:'([^']*)'|"([^"]*)"|([-+.\w]+))\s*$"""


def truth(s: Column) -> Column:
    """true or false, or a comparison of two literals (numbers by value, texts as such); null for anything else."""
    part = lambda *g: F.concat(*(F.regexp_extract(s, _COMPARISON, i) for i in g))
    parts = F.struct(part(1, 2, 3).alias("a"), part(4).alias("op"), part(5, 6, 7).alias("b"), part(1, 2, 5, 6).alias("quoted"))

    def sign(r: Column) -> Column:
        x, y = r["a"].try_cast("double"), r["b"].try_cast("double")
        by_text = F.when(r["a"] < r["b"], -1.0).when(r["a"] > r["b"], 1.0).otherwise(0.0)
        return F.struct(r["op"].alias("op"), F.when(x.isNotNull() & y.isNotNull() & (r["quoted"] == ""), F.signum(x - y)).otherwise(by_text).alias("c"))

    # each step's value is bound once, not copied into every use
    told = F.transform(F.transform(F.array(parts), sign), lambda r: F.when(r["c"] < 0, r["op"].isin("<", "<=", "!=")).when(r["c"] > 0, r["op"].isin(">", ">=", "!=")).otherwise(r["op"].isin("==", "<=", ">=")))
    compared = F.get(told, F.lit(0))
    low = F.lower(F.trim(s))
    return F.when(low.isin("true", "false"), low == "true").when(s.rlike(_COMPARISON), compared)


def _pick(test: Column, a: Args) -> Value:
    other = a.text("any_false") if a.has("any_false") else F.lit(None).cast("string")
    return Value(F.when(test, a.text("any_true")).when(~test, other))


@fn("grel.ttl#controls_if")
def controls_if(a: Args) -> Value:
    return _pick(truth(a.text("bool_b")), a)


@fn("built-in.ttl#controls_if_cast")
def controls_if_cast(a: Args) -> Value:
    s = a.text("bool_b")
    low = F.lower(F.coalesce(s, F.lit("")))
    return _pick(F.when(low.isin("true", "yes", "on", "1"), True).when(low.isin("", "false", "no", "off", "0"), False).otherwise(truth(s)), a)


def _bool(x: Column) -> Value:
    return Value(x.cast("string"))


def _inputs(a: Args) -> Column:
    return F.transform(a.list("param_rep_b") if a.is_list("param_rep_b") else F.array(a.text("param_rep_b")), lambda x: F.lower(x) == "true")


@fn("grel.ttl#boolean_and")
def boolean_and(a: Args) -> Value:
    return _bool(F.forall(_inputs(a), lambda x: x))


@fn("grel.ttl#boolean_or")
def boolean_or(a: Args) -> Value:
    return _bool(F.exists(_inputs(a), lambda x: x))


@fn("grel.ttl#boolean_xor")
def boolean_xor(a: Args) -> Value:
    return _bool(F.aggregate(_inputs(a), F.lit(False), lambda s, x: s != x))


@fn("grel.ttl#boolean_not")
def boolean_not(a: Args) -> Value:
    return _bool(F.lower(a.text("bool_b")) != "true")
