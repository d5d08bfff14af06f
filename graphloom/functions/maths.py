"""Mathematics. Whole inputs give whole results where the function keeps them whole."""

from pyspark.sql import functions as F

from .registry import Args, Value, fn

#: IRI name: Spark function of a double
_PLAIN = {"acos": F.acos, "sin": F.sin, "sinh": F.sinh, "tan": F.tan, "tanh": F.tanh, "asin": F.asin, "cos": F.cos, "cosh": F.cosh, "atan": F.atan, "degrees": F.degrees, "radians": F.radians, "exp": F.exp, "ln": F.ln, "log": F.log10}

for _name, _f in _PLAIN.items():
    fn(f"grel.ttl#math_{_name}")(lambda a, f=_f: Value(f(a.number("p_dec_n")), "double"))


def _kept(double, whole) -> Value:
    """A number's text: without a point if ``whole``."""
    return Value(F.when(whole, double.cast("decimal(38,0)").cast("string")).otherwise(Value(double, "double").text()))


@fn("grel.ttl#math_abs")
def math_abs(a: Args) -> Value:
    return _kept(F.abs(a.number("p_dec_n")), a.is_whole("p_dec_n"))


@fn("grel.ttl#math_atan2")
def math_atan2(a: Args) -> Value:
    return Value(F.atan2(a.number("p_dec_n"), a.number("param_n2")), "double")


@fn("grel.ttl#math_ceil")
def math_ceil(a: Args) -> Value:
    return Value(F.ceil(a.number("p_dec_n")), "int")


@fn("grel.ttl#math_floor")
def math_floor(a: Args) -> Value:
    return Value(F.floor(a.number("p_dec_n")), "int")


def _big(x):
    return x.cast("decimal(38,0)")


def _product(low, high, f=lambda x: x):
    """f(low) * ... * f(high); null beyond 38 digits."""
    steps = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, _big(F.lit(1)), lambda s, x: F.try_multiply(s, f(x).cast("decimal(20,0)")).try_cast("decimal(38,0)"))


@fn("grel.ttl#math_combin")
def math_combin(a: Args) -> Value:
    """n over k, one factor after another: each partial result is whole."""
    n, k = a.whole("p_int_i"), a.whole("p_int_i2")
    k = F.least(k, n - k)
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    c = F.aggregate(steps, _big(F.lit(1)), lambda s, i: F.floor(F.try_divide(F.try_multiply(s, (n - k + i).cast("decimal(19,0)")), i.cast("decimal(19,0)"))).try_cast("decimal(38,0)"))
    return Value(F.when(k < 0, "0").otherwise(c.try_cast("decimal(38,0)").cast("string")))


@fn("grel.ttl#math_fact")
def math_fact(a: Args) -> Value:
    return Value(_product(F.lit(1).cast("long"), a.whole("p_int_i")).cast("string"))


@fn("grel.ttl#math_factn")
def math_factn(a: Args) -> Value:
    x, y = a.whole("p_int_i"), a.whole("p_int_i2")
    return Value(_product(F.least(x, y), F.greatest(x, y) - 1).cast("string"))


@fn("grel.ttl#math_even")
def math_even(a: Args) -> Value:
    return Value(F.pmod(F.floor(a.number("p_dec_n")), F.lit(2)) == 0, "bool")


@fn("grel.ttl#math_odd")
def math_odd(a: Args) -> Value:
    return Value(F.pmod(F.floor(a.number("p_dec_n")), F.lit(2)) == 1, "bool")


def gcd(x, y):
    """Euclid's algorithm; 92 steps are enough for any two longs."""
    start = F.struct(F.abs(x).alias("a"), F.abs(y).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["a"]


@fn("grel.ttl#math_gcd")
def math_gcd(a: Args) -> Value:
    return Value(gcd(a.whole("p_int_i"), a.whole("p_int_i2")), "int")


@fn("grel.ttl#math_lcm")
def math_lcm(a: Args) -> Value:
    x, y = a.whole("p_int_i"), a.whole("p_int_i2")
    return Value(F.when((x == 0) | (y == 0), F.lit(0).cast("long")).otherwise(F.abs(F.floor(F.try_divide(x, gcd(x, y))) * y)), "int")


@fn("grel.ttl#math_mod")
def math_mod(a: Args) -> Value:
    """The rest has the divisor's sign."""
    x, y = a.whole("p_int_i"), a.whole("p_int_i2")
    r = F.try_mod(x, y)
    return Value(F.when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r), "int")


@fn("grel.ttl#math_multinomial")
def math_multinomial(a: Args) -> Value:
    """The product of the binomials (sum so far over each part)."""
    parts = F.transform(a.list("p_array_a"), lambda x: x.try_cast("long"))
    one = F.struct(F.lit(0).cast("long").alias("n"), _big(F.lit(1)).alias("c"))

    def add(s, k):
        n = s["n"] + k
        steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
        c = F.aggregate(steps, s["c"], lambda c, i: F.floor(F.try_divide(F.try_multiply(c, (n - k + i).cast("decimal(19,0)")), i.cast("decimal(19,0)"))).try_cast("decimal(38,0)"))
        return F.struct(n.alias("n"), c.alias("c"))

    return Value(F.aggregate(parts, one, add)["c"].cast("string"))


@fn("grel.ttl#math_pow")
def math_pow(a: Args) -> Value:
    return Value(F.pow(a.number("p_dec_n"), a.number("p_any_exp")), "double")


@fn("grel.ttl#math_quotient")
def math_quotient(a: Args) -> Value:
    return Value(F.floor(F.try_divide(a.number("p_dec_n"), a.number("param_n2"))), "int")


@fn("grel.ttl#math_max")
def math_max(a: Args) -> Value:
    x, y = a.number("p_dec_n"), a.number("param_n2")
    return _kept(F.greatest(x, y), F.when(x >= y, a.is_whole("p_dec_n")).otherwise(a.is_whole("param_n2")))


@fn("grel.ttl#math_min")
def math_min(a: Args) -> Value:
    x, y = a.number("p_dec_n"), a.number("param_n2")
    return _kept(F.least(x, y), F.when(x <= y, a.is_whole("p_dec_n")).otherwise(a.is_whole("param_n2")))


@fn("grel.ttl#math_randomNumber")
def math_random(a: Args) -> Value:
    low, high = a.number("p_int_i"), a.number("p_int_i2")
    return Value(low + F.rand() * (high - low), "double")


@fn("grel.ttl#math_round")
def math_round(a: Args) -> Value:
    """Accepts 4,894.57 and 10,7; halves go to the even neighbour."""
    s = a.text("p_dec_n")
    s = F.when(s.contains(".") | s.rlike(r",\d{3}(,|$)"), F.replace(s, F.lit(","), F.lit(""))).otherwise(F.replace(s, F.lit(","), F.lit(".")))
    return Value(F.bround(s.try_cast("double"), 0).cast("long").cast("string"))
