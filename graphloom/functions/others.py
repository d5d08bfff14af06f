"""Types, identifiers, coalescing."""

from pyspark.sql import functions as F

from ..terms import percent_encode
from .registry import Args, Value, fn

#: Names that types go by.
NAMES = {"text": "str", "int": "int", "double": "float", "bool": "bool", "list": "list", "ints": "list"}


@fn("grel.ttl#other_type")
def type_name(a: Args) -> Value:
    return Value(F.lit(NAMES[a.value("p_any_e").kind]))


@fn("toUpperCaseURL", "function#toUpperCaseURL")
def upper_url(a: Args) -> Value:
    """An absolute URL in upper case, percent-encoded but for the scheme's colon and slashes; http:// is put before others."""
    s = a.text("str")
    has = s.rlike(r"(?i)^https?://")
    if a.compat:
        start = F.when(s.startswith("https"), F.substring(s, 1, 8)).otherwise(F.substring(s, 1, 7))
        return Value(F.when(has, percent_encode(F.upper(start), ":/")).otherwise(F.concat(F.lit("http://"), percent_encode(F.upper(s), ":/"))))
    return Value(F.when(has, percent_encode(F.upper(s), ":/")).otherwise(F.concat(F.lit("http://"), percent_encode(F.upper(s), ":/"))))


@fn("built-in.ttl#uuid")
def uuid(a: Args) -> Value:
    return Value(F.expr("uuid()"))


@fn("built-in.ttl#other_coalesce")
def coalesce(a: Args) -> Value:
    values = a.given.get("p_any_rep_e") or a.given.get("p_any_rep_element") or []
    return Value(F.coalesce(*(F.nullif(v.text(), F.lit("")) for v in values)))


