"""String functions."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import Args, Value, fn


def _flag(x: Column) -> Value:
    return Value(x.cast("string"))


def _chain(s: Column, pairs) -> Column:
    for a, b in pairs:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


#: The characters that HTML and XML texts escape.
HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


@fn("grel.ttl#escape")
def escape(a: Args) -> Value:
    s, mode = a.text("valueParameter", "p_string"), F.lower(a.text("modeParameter"))
    url = F.replace(F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")), F.lit("%2F"), F.lit("/"))
    quoted = F.to_json(F.struct(s.alias("s")))
    csv = F.when(s.rlike(r'[",\n\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)
    return Value(F.when(mode == "html", _chain(s, HTML)).when(mode == "xml", _chain(s, XML)).when(mode == "url", url).when(mode == "javascript", quoted.substr(F.lit(7), F.length(quoted) - 8)).when(mode == "csv", csv))


@fn("grel.ttl#string_unescape")
def unescape(a: Args) -> Value:
    s, mode = a.text("valueParameter"), F.lower(a.text("modeParameter"))
    html = _chain(s, [(b, c) for c, b in reversed(HTML)] + [("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " ")])
    js = F.get_json_object(F.concat(F.lit('{"s":"'), s, F.lit('"}')), "$.s")
    url = F.url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))
    return Value(F.when(mode == "html", html).when(mode == "xml", _chain(s, reversed([(b, c) for c, b in XML]))).when(mode == "url", url).when(mode == "javascript", js))


@fn("grel.ttl#string_contains")
def contains(a: Args) -> Value:
    return _flag(a.text("valueParameter").contains(a.text("string_sub")))


@fn("grel.ttl#string_startsWith")
def starts(a: Args) -> Value:
    return _flag(a.text("valueParameter").startswith(a.text("string_sub")))


@fn("grel.ttl#string_endsWith")
def ends(a: Args) -> Value:
    return _flag(a.text("valueParameter").endswith(a.text("string_sub")))


@fn("grel.ttl#string_indexOf")
def index_of(a: Args) -> Value:
    return Value(F.position(a.text("string_sub"), a.text("valueParameter")) - 1, "int")


def last_index(s: Column, sub: Column) -> Column:
    at = F.position(F.reverse(sub), F.reverse(s))
    return F.when(at == 0, -1).otherwise(F.length(s) - F.length(sub) - at + 1)


@fn("grel.ttl#string_lastIndexOf")
def last_index_of(a: Args) -> Value:
    return Value(last_index(a.text("valueParameter"), a.text("string_sub")), "int")


@fn("grel.ttl#string_toNumber")
def to_number(a: Args) -> Value:
    return Value(a.text("p_any_e").try_cast("double"), "double")


@fn("grel.ttl#string_toString")
def to_string(a: Args) -> Value:
    return Value(a.text("p_any_e"))


@fn("grel.ttl#string_diff")
def difference(a: Args) -> Value:
    p, s = a.text("valueParameter"), a.text("valueParameter2")
    return Value(F.when(s.startswith(p), F.substring(s, F.length(p) + 1, F.length(s))).otherwise(s))


@fn("grel.ttl#string_length")
def length(a: Args) -> Value:
    return Value(F.length(a.text("valueParameter")), "int")


@fn("grel.ttl#string_splitByLengths")
def by_lengths(a: Args) -> Value:
    s, n, m, k = a.text("valueParameter"), a.whole("p_int_i").cast("int"), a.whole("p_int_i2").cast("int"), a.whole("p_rep_i").cast("int")
    return Value(Value(F.array(F.substring(s, F.lit(1), n), F.substring(s, n + 1, m), F.substring(s, n + m + 1, k)), "list").text())


def split_literal(s: Column, sep: Column) -> Column:
    return F.split(s, F.concat(F.lit("\\Q"), sep, F.lit("\\E")), -1)


@fn("grel.ttl#string_split", "built-in.ttl#string_split_explode")
def split(a: Args) -> Value:
    return Value(split_literal(a.text("valueParameter"), a.text("p_string_sep")), "list")


@fn("grel.ttl#string_smartSplit")
def smart_split(a: Args) -> Value:
    s = a.text("valueParameter")
    if a.has("p_opt_sep"):
        return Value(split_literal(s, a.text("p_opt_sep")), "list")
    return Value(F.when(s.contains("\t"), F.split(s, "\t")).when(s.contains(","), F.split(s, ",")).otherwise(F.array(s)), "list")


@fn("grel.ttl#string_substring")
def substring(a: Args) -> Value:
    from .arrays import slice_of

    s = a.text("valueParameter")
    end = a.whole("param_int_i_opt_to") if a.has("param_int_i_opt_to") else None
    at, n = slice_of(s, a.whole("param_int_i_from"), end, F.length(s))
    return Value(F.substring(s, at + 1, n))


@fn("grel.ttl#string_splitByCharType")
def by_char_type(a: Args) -> Value:
    return Value(F.regexp_extract_all(a.text("valueParameter"), F.lit(r"([A-Z]+|[a-z]+|\s|[0-9])"), 1), "list")


def _parts(a: Args, at: Column, s: Column, f: Column) -> Value:
    omit = F.lower(a.text("p_bool_opt_b")) == "true" if a.has("p_bool_opt_b") else F.lit(False)
    before, after = F.substring(s, F.lit(1), at), F.substring(s, at + F.length(f) + 1, F.length(s))
    return Value(F.when(at < 0, F.array(F.lit(""), s)).when(omit, F.array(before, after)).otherwise(F.array(before, f, after)), "list")


@fn("grel.ttl#string_partition")
def partition(a: Args) -> Value:
    s, f = a.text("valueParameter"), a.text("p_fragment")
    return _parts(a, F.position(f, s) - 1, s, f)


@fn("grel.ttl#string_rpartition")
def rpartition(a: Args) -> Value:
    s, f = a.text("valueParameter"), a.text("p_fragment")
    return _parts(a, last_index(s, f), s, f)


@fn("grel.ttl#string_chomp")
def chomp(a: Args) -> Value:
    s, e = a.text("valueParameter"), a.text("p_string_sep")
    return Value(F.when(s.endswith(e), F.substring(s, F.lit(1), F.length(s) - F.length(e))).otherwise(s))


@fn("grel.ttl#reverse")
def reverse(a: Args) -> Value:
    return Value(F.reverse(a.text("valueParameter")))


@fn("grel.ttl#string_replace", "grel.ttl#string_replaceChars")
def replace(a: Args) -> Value:
    return Value(F.replace(a.text("valueParameter"), a.text("p_string_find"), a.text("p_string_replace")))


@fn("grel.ttl#string_match")
def match(a: Args) -> Value:
    """All matches; of a pattern with a group, the group."""
    pattern = a.constant("p_string_regex")
    pattern = pattern[1:-1] if len(pattern) > 1 and pattern[0] == pattern[-1] == "/" else pattern
    return Value(F.regexp_extract_all(a.text("valueParameter"), F.lit(pattern), 1 if re.compile(pattern).groups else 0), "list")


@fn("built-in.ttl#concat", "built-in.ttl#string_concat")
def concat(a: Args) -> Value:
    return Value(F.concat(a.text("valueParameter1"), a.text("p_string_sep") if a.has("p_string_sep") else F.lit(""), a.text("valueParameter2")))


@fn("grel.ttl#string_trim", "grel.ttl#string_strip")
def trim(a: Args) -> Value:
    return Value(F.regexp_replace(a.text("valueParameter"), r"(?U)^\s+|\s+$", ""))


@fn("grel.ttl#toLowerCase")
def lower(a: Args) -> Value:
    return Value(F.lower(a.text("valueParameter")))


@fn("grel.ttl#toUpperCase")
def upper(a: Args) -> Value:
    return Value(F.upper(a.text("valueParameter")))


@fn("grel.ttl#string_toTitlecase")
def title(a: Args) -> Value:
    """A letter after any non-letter becomes a capital, others small."""
    pieces = F.regexp_extract_all(a.text("valueParameter"), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return Value(F.array_join(F.transform(pieces, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))), ""))


@fn("grel.ttl#string_md5")
def md5(a: Args) -> Value:
    return Value(F.md5(a.text("valueParameter").cast("binary")))


@fn("grel.ttl#string_sha1")
def sha1(a: Args) -> Value:
    return Value(F.sha1(a.text("valueParameter").cast("binary")))


@fn("grel.ttl#unicodestring-s", "grel.ttl#string_unicode")
def code_points(a: Args) -> Value:
    chars = F.filter(F.split(a.text("valueParameter"), ""), lambda c: c != "")
    return Value(F.transform(chars, lambda c: F.ascii(c)), "ints")


@fn("built-in.ttl#hash")
def sha256(a: Args) -> Value:
    return Value(F.sha2(a.text("valueParameter").cast("binary"), 256))


@fn("built-in.ttl#hash_iri")
def sha256_iri(a: Args) -> Value:
    return Value(F.concat(F.lit("http://example.com/ns#"), F.sha2(a.text("valueParameter").cast("binary"), 256)))
