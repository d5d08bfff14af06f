"""SPARQL algebra as DataFrame plans over mapped sources.

A solution column is a term struct. A variable that comes from one rule's
invertible template also keeps its source columns, and joins of such
variables compare those instead of built IRIs, so filters and joins reach
the scans. Constants select rules by their templates and become conditions
on source columns. Patterns that read the same rows of a keyed source are
answered by one scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import count
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frontend.mapping import template_parts
from ..model import IRI, Literal, Rule, TermMap
from ..operators.materialize import Engine
from ..plans.fixpoint import closure, reached
from ..plans.partition import apart, invariant, invertible
from ..terms import TERM, escape, node_text, references
from .expressions import EXACT, Expressions, V, constant, operands
from .parser import Parser, Query, QueryError, Var, variables


@dataclass
class Frame:
    """Solutions: columns v_<name>; ``maybe``: variables that may be unbound; ``keys``: source columns behind a variable."""

    df: DataFrame
    vars: list[str]
    maybe: set[str] = field(default_factory=set)
    keys: dict[str, tuple[tuple, list[str]]] = field(default_factory=dict)


def col(name: str) -> Column:
    return F.col(f"`v_{name}`")


def term_text(c: Column) -> Column:
    """A struct's N-Triples form."""
    body = F.concat(F.lit('"'), escape(c["v"]), F.lit('"'))
    tail = F.when(c["l"].isNotNull(), F.concat(F.lit("@"), c["l"])).when(c["d"].isNotNull(), F.concat(F.lit("^^<"), c["d"], F.lit(">"))).otherwise("")
    return F.when(c["t"] == "I", F.concat(F.lit("<"), c["v"], F.lit(">"))).when(c["t"] == "B", F.concat(F.lit("_:"), c["v"])).when(c["t"] == "S", c["v"]).otherwise(F.concat(body, tail))


def template_match(t: TermMap, value: str) -> dict[str, str] | None:
    """The columns' values that make a template's value, if one assignment does."""
    pattern, names = "", []
    for is_ref, text in template_parts(str(t.value)):
        if is_ref:
            pattern += "(.+?)"
            names.append(text)
        else:
            pattern += re.escape(text)
    m = re.fullmatch(pattern, value, re.DOTALL)
    if not m:
        return None
    out: dict[str, str] = {}
    for n, v in zip(names, m.groups(), strict=True):
        if out.setdefault(n, v) != v:
            return None
    return {n: unquote(v) for n, v in out.items()}


class Evaluator:
    def __init__(self, engine: Engine, rules: list[Rule], keys: dict[str, tuple[str, ...]] | None = None) -> None:
        self.e, self.rules, self.unique = engine, [r for r in rules if r.asserted], keys or {}
        self.spark = engine.sources.spark
        self.n = count()

    # -- queries

    def query(self, text: str) -> DataFrame:
        q = Parser(text).parse()
        if q.form == "SELECT":
            f = self.select(q)
            return f.df.select(*(term_text(col(v)).alias(v) for v in f.vars if not v.startswith("_")))
        f = self.pattern(q.where)
        if q.form == "ASK":
            return f.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
        if q.form == "CONSTRUCT":
            f = self.sliced(self.ordered(f, q), q)
            parts = []
            for s, p, o in q.template:
                terms = [self.template_term(x, f) for x in (s, p, o)]
                part = f.df.select(*(t.alias(n) for t, n in zip(terms, "spo", strict=True)))
                parts.append(part.where("s is not null and p is not null and o is not null"))
            return reduce(DataFrame.unionByName, parts).dropDuplicates()
        parts = []
        for x in q.describe:
            if isinstance(x, Var):
                about = self.pattern(("bgp", [(x, Var("p"), Var("o"))]))
                found = self.join(Frame(f.df.select(col(x)).distinct(), [str(x)], f.maybe & {str(x)}), about)
                parts.append(found.df.select(term_text(col(x)).alias("s"), term_text(col("p")).alias("p"), term_text(col("o")).alias("o")))
            else:
                found = self.pattern(("bgp", [(x, Var("p"), Var("o"))]))
                parts.append(found.df.select(F.lit(node_text(x)).alias("s"), term_text(col("p")).alias("p"), term_text(col("o")).alias("o")))
        return reduce(DataFrame.unionByName, parts).dropDuplicates()

    def template_term(self, x, f: Frame) -> Column:
        if isinstance(x, Var):
            if str(x).startswith("_b_"):  # a new blank node for each solution
                whole = F.to_json(F.struct(*(col(v) for v in f.vars)))
                return F.concat(F.lit("_:"), F.md5(F.concat(whole, F.lit(str(x))).cast("binary")))
            return term_text(col(x)) if str(x) in f.vars else F.lit(None).cast("string")
        return F.lit(node_text(x))

    def select(self, q: Query) -> Frame:
        f = self.pattern(q.where)
        if q.group or any(self.aggregated(e) for _, e in q.project if e is not None) or q.having:
            f, q = self.grouped(f, q)
        names = [str(v) for v, _ in q.project] or [v for v in f.vars if not v.startswith("_")]
        for v, e in q.project:
            if e is not None:
                f = self.extend(f, str(v), e)
        for v in names:
            if v not in f.vars:
                f = Frame(f.df.withColumn(f"v_{v}", F.lit(None).cast(TERM)), [*f.vars, v], f.maybe | {v}, f.keys)
        if not q.distinct:
            f = self.sliced(self.ordered(f, q, names), q)
            return Frame(f.df.select(*(col(v) for v in names)), names, f.maybe & set(names))
        f = Frame(f.df.select(*(col(v) for v in names)).distinct(), names, f.maybe & set(names))
        return self.sliced(self.ordered(f, q, names), q)

    def aggregated(self, e) -> bool:
        return isinstance(e, tuple) and (e[:1] == ("agg",) or any(self.aggregated(x) for x in e)) or isinstance(e, list) and any(self.aggregated(x) for x in e)

    def grouped(self, f: Frame, q: Query) -> tuple[Frame, Query]:
        keys = []
        for i, (e, v) in enumerate(q.group):
            name = str(v) if v else str(e[1]) if e[0] == "var" else f"_g{i}"
            if e[0] != "var":
                f = self.extend(f, name, e)
            elif name not in f.vars:
                f = Frame(f.df.withColumn(f"v_{name}", F.lit(None).cast(TERM)), [*f.vars, name], f.maybe | {name}, f.keys)
            keys.append(name)
        found: dict[tuple, str] = {}

        def pull(e):
            """The expression with its aggregates as variables."""
            if isinstance(e, tuple):
                if e[:1] == ("agg",):
                    key = repr(e)
                    if key not in found:
                        found[key] = f"_a{len(found)}"
                        aggs.append((found[key], e))
                    return ("var", Var(found[key]))
                return tuple(pull(x) for x in e)
            return [pull(x) for x in e] if isinstance(e, list) else e

        aggs: list = []
        project = [(v, None if e is None else pull(e)) for v, e in q.project]
        having, order = [pull(h) for h in q.having], [(pull(e), d) for e, d in q.order]
        x = self.expressions(f)
        made, after = [], []
        for name, (_, kind, distinct, e, sep) in aggs:
            v = x.of(e) if e is not None else None
            if kind == "COUNT":
                whole = F.struct(*(col(n) for n in f.vars if not n.startswith("_"))) if e is None and distinct else None
                c = F.count(F.lit(1)) if e is None and not distinct else F.count_distinct(whole) if e is None else F.count_distinct(v.term()) if distinct else F.count(v.term())
                made.append(c.alias(name))
                after.append((name, V("num", F.col(name).cast("double"), F.lit(0)).term()))
                continue
            t = v.term()
            if kind in ("SUM", "AVG"):
                num, rank = v.num(), v.ranked()
                bad = F.count_if(t.isNotNull() & num.isNull())
                exact = v.exact()
                if distinct:  # there is no distinct try_sum: values that could overflow before a million of them are summed as doubles
                    exact = F.when(F.abs(exact) < F.lit(10**18), exact)
                    total, n, fine = F.sum_distinct(num), F.count_distinct(num), F.sum_distinct(exact)
                else:
                    total, n, fine = F.sum(num), F.count(num), F.try_sum(exact)
                rough = F.count_if(num.isNotNull() & exact.isNull()) > 0
                fine = F.when(~rough, F.coalesce(fine.try_cast(EXACT), F.when(n == 0, F.lit(0).cast(EXACT))))
                if kind == "AVG":
                    total, fine = F.try_divide(F.coalesce(fine.cast("double"), total), n), F.lit(None).cast(EXACT)
                value = F.coalesce(total, F.lit(0.0))
                top = F.coalesce(F.max(F.when(t.isNotNull(), rank)), F.lit(0))
                made.append(F.struct(F.when(bad == 0, value).alias("x"), F.when(bad == 0, fine).alias("e"), (F.greatest(top, F.lit(1)) if kind == "AVG" else top).alias("r")).alias(name))
                after.append((name, V("num", F.col(name)["x"], F.col(name)["r"], F.col(name)["e"]).term()))
            elif kind in ("MIN", "MAX"):
                rank = F.when(t["t"] == "B", 0).when(t["t"] == "I", 1).otherwise(2)
                key = F.when(t.isNotNull(), F.struct(rank.alias("r"), v.num().alias("n"), v.exact().alias("e"), v.instant().alias("i"), t.alias("t")))
                made.append((F.min if kind == "MIN" else F.max)(key).alias(name))
                after.append((name, F.col(name)["t"]))
            elif kind == "SAMPLE":
                made.append(F.min(t).alias(name))  # any will do; the least is the same on each run
                after.append((name, F.col(name)))
            else:
                texts = F.array_sort(F.collect_set(v.text()) if distinct else F.collect_list(v.text()))
                made.append(F.array_join(texts, sep).alias(name))
                after.append((name, V("str", F.col(name)).term()))
        df = f.df.groupBy(*(col(k) for k in keys)).agg(*made) if made else f.df.select(*(col(k) for k in keys)).distinct()
        for name, c in after:
            df = df.withColumn(f"v_{name}", c).drop(name)
        out = Frame(df, keys + [n for n, _ in aggs], (f.maybe & set(keys)) | {n for n, _ in aggs})
        for h in having:
            out = Frame(out.df.where(F.coalesce(self.expressions(out).of(h).ebv(), F.lit(False))), out.vars, out.maybe)
        return out, replace(q, project=project, having=[], order=order, group=[])

    def ordered(self, f: Frame, q: Query, names: list[str] | None = None) -> Frame:
        if not q.order:
            return f
        x, keys = self.expressions(f), []
        for e, down in q.order:
            v = x.of(e)
            t = v.term()
            rank = F.when(t.isNull(), 0).when(t["t"] == "B", 1).when(t["t"] == "I", 2).otherwise(3)
            for k in (rank, v.num(), v.exact(), v.instant(), t["v"]):
                keys.append(k.desc_nulls_last() if down else k.asc_nulls_first())
        return Frame(f.df.orderBy(*keys), f.vars, f.maybe, f.keys)

    def sliced(self, f: Frame, q: Query) -> Frame:
        df = f.df.offset(q.offset) if q.offset else f.df
        return Frame(df.limit(q.limit) if q.limit is not None else df, f.vars, f.maybe, f.keys)

    def expressions(self, f: Frame) -> Expressions:
        return Expressions(lambda v: col(v) if v in f.vars else F.lit(None).cast(TERM))

    def extend(self, f: Frame, name: str, e) -> Frame:
        if e == ("var", name):
            return f
        if name in f.vars:
            raise QueryError(f"?{name} is bound already")
        # numbers are read often, by operators and by their texts: projections of their own keep the generated code small
        df, i, x = f.df, next(self.n), self.expressions(f)
        found = sorted(operands(e) & set(f.vars))
        made = {v: x.of(("var", v)) for v in found}
        df = df.withColumns({f"{k}{i}_{j}": c for j, v in enumerate(found) for k, c in (("n", made[v].num()), ("e", made[v].exact()), ("r", made[v].ranked()))})
        x.numbers = {v: V("num", F.col(f"n{i}_{j}"), F.col(f"r{i}_{j}"), F.col(f"e{i}_{j}")) for j, v in enumerate(found)}
        v = x.of(e)
        if v.kind == "num":
            df = df.withColumns({f"n{i}": v.col, f"e{i}": v.exact(), f"r{i}": v.rank})
            df = df.withColumn(f"v_{name}", V("num", F.col(f"n{i}"), F.col(f"r{i}"), F.col(f"e{i}")).term())
        else:
            df = df.withColumn(f"v_{name}", v.term())
        df = df.drop(*(f"{k}{i}{end}" for k in "ner" for end in ("", *(f"_{j}" for j in range(len(found))))))
        return Frame(df, [*f.vars, name], f.maybe | {name}, f.keys)

    # -- algebra

    def pattern(self, a: tuple, graph=None) -> Frame:
        kind = a[0]
        if kind == "unit":
            return Frame(self.spark.range(1).select(F.lit(1).alias("_unit")), [])
        if kind == "bgp":
            return self.bgp(a[1], graph)
        if kind == "path":
            return self.path(a[1], a[2], a[3], graph)
        if kind == "join":
            return self.join(self.pattern(a[1], graph), self.pattern(a[2], graph))
        if kind == "left":
            return self.left(self.pattern(a[1], graph), self.pattern(a[2], graph), a[3])
        if kind == "union":
            x, y = self.pattern(a[1], graph), self.pattern(a[2], graph)
            names = list(dict.fromkeys(x.vars + y.vars))
            part = lambda f: f.df.select(*(col(v) if v in f.vars else F.lit(None).cast(TERM).alias(f"v_{v}") for v in names), F.lit(1).alias("_unit"))
            return Frame(part(x).unionByName(part(y)), names, x.maybe | y.maybe | set(x.vars) ^ set(y.vars))
        if kind == "minus":
            return self.minus(self.pattern(a[1], graph), self.pattern(a[2], graph))
        if kind == "filter":
            return self.filter(self.pattern(a[2], graph), a[1], graph)
        if kind == "extend":
            return self.extend(self.pattern(a[1], graph), str(a[2]), a[3])
        if kind == "graph":
            return self.pattern(a[2], a[1])
        if kind == "values":
            names = [str(v) for v in a[1]]
            rows = [F.struct(*((F.lit(None).cast(TERM) if x is None else constant(x).cast(TERM)).alias(f"v_{v}") for v, x in zip(names, r, strict=True))) for r in a[2]]
            one = self.spark.range(1)
            df = one.select(F.inline(F.array(*rows))) if rows else one.select(*(F.lit(None).cast(TERM).alias(f"v_{v}") for v in names)).limit(0)
            return Frame(df, names, {v for i, v in enumerate(names) if any(r[i] is None for r in a[2])})
        if kind == "select":
            return self.select(a[1])
        raise QueryError(f"{kind} is not supported")

    def filter(self, f: Frame, e, graph) -> Frame:
        if e[0] == "and":
            return self.filter(self.filter(f, e[1], graph), e[2], graph)
        if e[0] in ("exists", "notexists") or e[0] == "!" and e[1][0] in ("exists", "notexists"):
            flip = e[0] == "!"
            inner = e[1] if flip else e
            return self.semi(f, self.inner(inner[1], f, graph), (inner[0] == "exists") != flip)
        return Frame(f.df.where(F.coalesce(self.expressions(f).of(e).ebv(), F.lit(False))), f.vars, f.maybe, f.keys)

    def inner(self, a: tuple, f: Frame, graph) -> Frame:
        """An EXISTS pattern; a filter in it that reads outer variables is joined with them first."""
        if a[0] == "filter" and not variables(a[1]) <= set(self.pattern(a[2], graph).vars):
            outer = Frame(f.df.select(*(col(v) for v in f.vars)).distinct(), f.vars, f.maybe)
            joined = self.join(outer, self.pattern(a[2], graph))
            return self.filter(joined, a[1], graph)
        return self.pattern(a, graph)

    def loose(self, f: Frame, g: Frame) -> str | None:
        """A shared variable that may be unbound, where no shared one is sure to be bound: the join would have no key."""
        shared = [v for v in f.vars if v in g.vars]
        return shared[0] if shared and all(v in f.maybe | g.maybe for v in shared) else None

    def split(self, f: Frame, v: str) -> list[Frame]:
        """The solutions that bind v, and those that don't, without it."""
        if v not in f.maybe:
            return [f]
        bound = Frame(f.df.where(col(v).isNotNull()), f.vars, f.maybe - {v}, f.keys)
        rest = [x for x in f.vars if x != v]
        keys = {x: k for x, k in f.keys.items() if x != v}
        raw = list(dict.fromkeys(c for _, cols in keys.values() for c in cols))
        free = f.df.where(col(v).isNull()).select(*(col(x) for x in rest), *(F.col(f"`{c}`") for c in raw), F.lit(1).alias("_one"))
        return [bound, Frame(free, rest, f.maybe - {v}, keys)]

    def together(self, parts: list[Frame], names: list[str]) -> Frame:
        df = reduce(DataFrame.unionByName, (p.df.select(*(col(v) if v in p.vars else F.lit(None).cast(TERM).alias(f"v_{v}") for v in names), F.lit(1).alias("_unit")) for p in parts))
        return Frame(df, names, {v for v in names if any(v in p.maybe or v not in p.vars for p in parts)})

    def semi(self, f: Frame, g: Frame, keep: bool) -> Frame:
        if v := self.loose(f, g):
            parts = []
            for x in self.split(f, v):
                sides = self.split(g, v) if v in x.vars else [Frame(g.df, [n for n in g.vars if n != v], g.maybe - {v}, {n: k for n, k in g.keys.items() if n != v})]
                for y in sides:  # rows that meet one side are settled
                    if keep:
                        parts.append(self.semi(x, y, True))
                    x = self.semi(x, y, False) if not keep or y is not sides[-1] else x
                parts += [] if keep else [x]
            return self.together(parts, f.vars)
        g, names = self.renamed(g)
        condition = self.compatible(f, g, names)
        return Frame(f.df.join(g.df, condition if condition is not None else F.lit(True), "left_semi" if keep else "left_anti"), f.vars, f.maybe, f.keys)

    def renamed(self, g: Frame) -> tuple[Frame, dict[str, str]]:
        """g under names that no other frame has."""
        i = next(self.n)
        names = {v: f"r{i}_{v}" for v in g.vars}
        keys = {v: (s, [f"r{i}_{c}" for c in cols]) for v, (s, cols) in g.keys.items()}
        raw = list(dict.fromkeys(c for _, cols in g.keys.values() for c in cols))
        df = g.df.select(*(col(v).alias(names[v]) for v in g.vars), *(F.col(f"`{c}`").alias(f"r{i}_{c}") for c in raw), F.lit(1).alias(f"r{i}__one"))
        return Frame(df, g.vars, g.maybe, keys), names

    def compatible(self, f: Frame, g: Frame, names: dict[str, str]) -> Column | None:
        """Shared variables agree; where one may be unbound, that is agreement too."""
        out = None
        for v in f.vars:
            if v not in names:
                continue
            left, right = col(v), F.col(f"`{names[v]}`")
            a, b = f.keys.get(v), g.keys.get(v)
            if a and b and a[0] == b[0] and v not in f.maybe | g.maybe:
                c = reduce(lambda p, q: p & q, (F.col(f"`{x}`") == F.col(f"`{y}`") for x, y in zip(a[1], b[1], strict=True)))
            else:
                c = left == right
                if v in f.maybe:
                    c = left.isNull() | c
                if v in g.maybe:
                    c = right.isNull() | c
            out = c if out is None else out & c
        return out

    def join(self, f: Frame, g: Frame, how: str = "inner", more=None) -> Frame:
        if not f.vars and "_unit" in f.df.columns and how == "inner":
            return g
        if not g.vars and "_unit" in g.df.columns:
            return f
        if v := self.loose(f, g):
            names = list(dict.fromkeys(f.vars + g.vars))
            if how == "inner":
                return self.together([self.join(x, y, how, more) for x in self.split(f, v) for y in self.split(g, v)], names)
            if v in f.maybe:
                return self.together([self.join(x, g, how, more) for x in self.split(f, v)], names)
            if more is None:
                return self.together([self.join(f, g), self.semi(f, g, False)], names)
        g, names = self.renamed(g)
        condition = self.compatible(f, g, names)
        shared = [v for v in f.vars if v in names]
        if more is not None:
            # the condition reads both sides
            both = Expressions(lambda v: F.coalesce(col(v), F.col(f"`{names[v]}`")) if v in f.vars and v in names else col(v) if v in f.vars else F.col(f"`{names[v]}`") if v in names else F.lit(None).cast(TERM))
            c = F.coalesce(both.of(more).ebv(), F.lit(False))
            condition = c if condition is None else condition & c
        df = f.df.join(g.df, condition, how) if condition is not None else f.df.join(g.df, F.lit(True), how)
        keep = [F.coalesce(col(v), F.col(f"`{names[v]}`")).alias(f"v_{v}") if v in shared and v in f.maybe else col(v) for v in f.vars]
        new = [v for v in g.vars if v not in shared]
        keep += [F.col(f"`{names[v]}`").alias(f"v_{v}") for v in new]
        keys = dict(f.keys)
        if how == "inner":
            keys |= {v: k for v, k in g.keys.items() if v not in keys}
        raw = list(dict.fromkeys(c for _, cols in keys.values() for c in cols))
        df = df.select(*keep, *(F.col(f"`{c}`") for c in raw))
        maybe = (f.maybe - (set(shared) - g.maybe)) | (g.maybe & set(new) if how == "inner" else set(new))
        if how != "inner":
            maybe |= f.maybe
        return Frame(df, f.vars + new, maybe, keys)

    def left(self, f: Frame, g: Frame, condition) -> Frame:
        return self.join(f, g, "left", condition)

    def minus(self, f: Frame, g: Frame) -> Frame:
        shared = [v for v in f.vars if v in g.vars]
        if not shared:
            return f
        g, names = self.renamed(g)
        condition = self.compatible(f, g, names)
        if all(v in f.maybe | g.maybe for v in shared):  # some shared variable must be bound on both sides
            condition = condition & reduce(lambda a, b: a | b, (col(v).isNotNull() & F.col(f"`{names[v]}`").isNotNull() for v in shared))
        return Frame(f.df.join(g.df, condition, "left_anti"), f.vars, f.maybe, f.keys)

    # -- basic graph patterns

    def bgp(self, triples: list, graph=None) -> Frame:
        choices = self.choices(triples, graph)
        # patterns with more constants and fewer rules first
        left = sorted(choices, key=lambda x: (sum(isinstance(y, Var) for y in x[0]), len(x[1])))
        frames: list[Frame] = []
        used: set[int] = set()
        for i, x in enumerate(left):
            if i in used:
                continue
            together = [x]
            for j in range(i + 1, len(left)):
                if j not in used and self.same_scan(x, left[j], graph):
                    together.append(left[j])
                    used.add(j)
            frames.append(self.triples(together, graph))
        out = frames.pop(0)
        while frames:  # connected frames first: products only where nothing is shared
            i = next((i for i, f in enumerate(frames) if set(f.vars) & set(out.vars)), 0)
            out = self.join(out, frames.pop(i))
        return out

    def choices(self, triples: list, graph) -> list[tuple[tuple, list[Rule]]]:
        """Each pattern's rules, less those that cannot agree on a variable with any rule of another pattern."""
        parts = ("subject", "predicate", "object")
        rules = [self.matching(t, graph) for t in triples]
        places: dict[str, list[tuple[int, str]]] = {}
        for i, t in enumerate(triples):
            for x, part in zip(t, parts, strict=True):
                if isinstance(x, Var):
                    places.setdefault(str(x), []).append((i, part))
        changed = True
        while changed:
            changed = False
            for at in places.values():
                for i, part in at:
                    for j, other in at:
                        if i == j:
                            continue
                        there = [invariant(getattr(r, other)) for r in rules[j]]
                        kept = [r for r in rules[i] if any(not apart(invariant(getattr(r, part)), y) for y in there)]
                        changed |= len(kept) < len(rules[i])
                        rules[i] = kept
        return list(zip(triples, rules, strict=True))

    def matching(self, t: tuple, graph=None) -> list[Rule]:
        return [r for r in self.rules if all(self.may_be(getattr(r, n), x) for n, x in zip(("subject", "predicate", "object"), t, strict=True)) and self.graph_ok(r, graph)]

    def graph_ok(self, r: Rule, graph) -> bool:
        if graph is None:
            return True
        return r.graph is not None and self.may_be(r.graph, graph)

    def may_be(self, t: TermMap, x) -> bool:
        if isinstance(x, Var):
            return True
        if t.kind == "parent":
            t = t.value.subject
        kind = "literal" if isinstance(x, Literal) else "iri"
        if t.term != kind:
            return False
        if t.kind == "constant":
            return node_text(t.value) == node_text(x)
        if kind == "literal":
            if t.lang is not None and t.lang.kind == "constant" and str(t.lang.value).lower() != (x.lang or ""):
                return False
            if t.datatype is not None and t.datatype.kind == "constant" and (x.datatype or "http://www.w3.org/2001/XMLSchema#string") != str(t.datatype.value):
                return False
        return t.kind != "template" or kind == "literal" or template_match(t, str(x)) is not None or not re.match(r"[A-Za-z][\w+.-]*:", str(t.value))

    def same_scan(self, a: tuple[tuple, list[Rule]], b: tuple[tuple, list[Rule]], graph) -> bool:
        """Both patterns are about one variable and each is one rule's, over the same rows of a keyed source."""
        (t, x), (u, y) = a, b
        if not isinstance(t[0], Var) or t[0] != u[0] or graph is not None or len(x) != 1 or len(y) != 1:
            return False
        x, y = x[0], y[0]
        key = self.unique.get(x.source.location)
        plain = not any(self.e.explodes(r) or r.subject.kind in ("quoted", "function") or r.object.joins for r in (x, y))
        shared = [v for v in u[1:] if isinstance(v, Var) and v in t]
        return plain and x.source == y.source and x.subject == y.subject and key is not None and set(key) <= set(references(x.subject)) and invertible(x.subject, self.e.o.safe) and not shared

    def triples(self, together: list[tuple[tuple, list[Rule]]], graph) -> Frame:
        patterns = [t for t, _ in together]
        parts = [self.rule_frame(patterns, [r], graph) for r in together[0][1]] if len(together) == 1 else [self.rule_frame(patterns, [r[0] for _, r in together], graph)]
        names = list(dict.fromkeys(str(x) for t in patterns for x in (*t, *([graph] if graph is not None else [])) if isinstance(x, Var)))
        if not parts:
            return Frame(self.spark.range(1).select(*(F.lit(None).cast(TERM).alias(f"v_{v}") for v in names), F.lit(1).alias("_unit")).limit(0), names)
        if len(parts) == 1:
            f, unique = parts[0]
            return f if unique else Frame(f.df.dropDuplicates(), f.vars, f.maybe, f.keys)
        df = reduce(DataFrame.unionByName, (f.df.select(*(col(v) for v in names), F.lit(1).alias("_unit")) for f, _ in parts))
        return Frame(df.dropDuplicates(), names)

    def rule_frame(self, triples: list, rules: list[Rule], graph) -> tuple[Frame, bool]:
        """Solutions of patterns about one subject, one rule each over the same source; and whether rows are unique already."""
        first = rules[0]
        if any(self.e.explodes(r) for r in rules) or any(t.kind == "quoted" for r in rules for t in (r.subject, r.object)):
            return self.text_frame(triples[0], first, graph), False
        if len(rules) > 1:
            refs = list(dict.fromkeys(c for r in rules for c in self.e.columns_of(r)))
            df, types = self.e.rows(first.source, refs, [c for r in rules for c in self.e.required(r)])
            prefixes: dict[str, str] = {}
        else:
            df, prefixes, types = self.e.joined(first, (), self.e.required(first))
        there = set(df.columns)
        conditions: list[Column] = []
        out: dict[str, Column] = {}
        keys: dict[str, tuple[tuple, list[tuple[str, Column]]]] = {}
        need: list[Column] = []
        for (s, p, o), r in zip(triples, rules, strict=True):
            parts = [(s, r.subject, ""), (p, r.predicate, ""), (o, r.object, prefixes.get("object", ""))]
            if graph is not None and r.graph is not None:
                parts.append((graph, r.graph, ""))
            for x, t, prefix in parts:
                if t.kind == "parent":
                    t = t.value.subject
                c = self.e.compiler(prefix, types, r.base).term(t)
                if t.kind != "constant":
                    need += [F.col(f"`{prefix}{ref}`").isNotNull() for ref in references(t) if prefix or ref not in self.e.required(r)] if t.kind != "function" else [c.value.isNotNull()]
                    if t.kind == "reference" and t.term == "iri":
                        need.append(c.value.isNotNull())
                if not isinstance(x, Var):
                    conditions += self.equal(t, x, prefix, c, there)
                    continue
                v = str(x)
                made = c.struct()
                if v in out:
                    conditions.append(out[v] == made)
                    continue
                out[v] = made
                if invertible(t, self.e.o.safe):
                    # whole numbers are compared as numbers: their columns' kind is part of the signature
                    whole = lambda ref, prefix=prefix: f"{prefix}#{ref}" in there
                    signature = tuple(("ref", whole(text)) if is_ref else text for is_ref, text in template_parts(str(t.value)))
                    keys[v] = (signature, [(f"k{next(self.n)}", F.col(f"`{prefix}{'#' if whole(ref) else ''}{ref}`")) for ref in references(t)])
        for c in [*need, *conditions]:
            df = df.where(c)
        df = df.select(*(c.cast(TERM).alias(f"v_{v}") for v, c in out.items()), *(c.alias(n) for _, cols in keys.values() for n, c in cols), F.lit(1).alias("_unit"))
        frame = Frame(df, list(out), set(), {v: (s, [n for n, _ in cols]) for v, (s, cols) in keys.items()})
        key = self.unique.get(first.source.location)
        kept = {ref for v in out for t, _ in [(r.subject, 0) for r in rules] if v == str(triples[0][0]) for ref in references(t)}
        unique = key is not None and set(key) <= kept and invertible(first.subject, self.e.o.safe) and not any(r.object.joins for r in rules)
        unique = unique or key is not None and bool(rules[0].object.joins) and set(key) <= kept and self.parent_unique(rules[0])
        return frame, unique and all(isinstance(x, Var) or r.predicate.kind == "constant" for (_, x, _), r in zip(triples, rules, strict=True))

    def parent_unique(self, r: Rule) -> bool:
        key = self.unique.get(r.object.value.source.location)
        return key is not None and set(key) <= {p for _, p in r.object.joins}

    def equal(self, t: TermMap, x, prefix: str, c, there: set[str]) -> list[Column]:
        """Conditions under which a term map gives a constant, on source columns where that is possible."""
        if t.kind == "constant":
            return []
        if isinstance(x, IRI) and invertible(t, self.e.o.safe):
            values = template_match(t, str(x))
            number = lambda n, v: f"{prefix}#{n}" in there and re.fullmatch(r"0|-?[1-9]\d{0,17}", v)
            return [F.col(f"`{prefix}#{n}`") == int(v) if number(n, v) else F.col(f"`{prefix}{n}`") == v for n, v in (values or {}).items()] or [F.lit(values is not None)]
        if isinstance(x, Literal) and t.kind == "reference" and (t.datatype is None or t.datatype.kind == "constant") and t.lang is None and not self.e.o.infer_datatypes and x.lang is None:
            return [c.value == x.value] if (x.datatype or None) == (None if t.datatype is None else str(t.datatype.value)) or x.datatype is None and t.datatype is None else [F.lit(False)]
        return [c.struct().cast(TERM) == constant(x).cast(TERM)]

    def text_frame(self, t: tuple, r: Rule, graph) -> Frame:
        """A rule with lists or quoted triples, by its quads; terms are read back from their texts."""
        quads = self.e.of([replace(r, asserted=True)])
        out: dict[str, Column] = {}
        for x, c in zip((*t, *([graph] if graph is not None else [])), "spog", strict=False):
            made = parsed(F.col(c))
            if isinstance(x, Var):
                if str(x) in out:
                    quads = quads.where(out[str(x)] == made)
                out.setdefault(str(x), made)
            else:
                quads = quads.where(F.col(c) == node_text(x))
        return Frame(quads.select(*(c.alias(f"v_{v}") for v, c in out.items()), F.lit(1).alias("_unit")), list(out))

    # -- property paths

    def other_than(self, s, banned: list[str], o, graph) -> Frame:
        """Triples under any predicate but these."""
        pred = Var(f"_m{next(self.n)}")
        f = self.bgp([(s, pred, o)], graph)
        return Frame(f.df.where(~col(pred)["v"].isin(*banned)).drop(f"v_{pred}"), [v for v in f.vars if v != pred])

    def path(self, s, p, o, graph) -> Frame:
        if not isinstance(p, tuple):
            return self.bgp([(s, p, o)], graph)
        kind = p[0]
        if kind == "inverse":
            return self.path(o, p[1], s, graph)
        if kind == "sequence":
            mids = [Var(f"_m{next(self.n)}") for _ in p[2:]]
            ends = [s, *mids, o]
            f = reduce(self.join, (self.path(ends[i], step, ends[i + 1], graph) for i, step in enumerate(p[1:])))
            names = [v for v in f.vars if v not in mids]
            return Frame(f.df.select(*(col(v) for v in names), F.lit(1).alias("_unit")), names, f.maybe)
        if kind == "alternative":
            parts = [self.path(s, x, o, graph) for x in p[1:]]
            df = reduce(DataFrame.unionByName, (f.df.select(*(col(v) for v in f.vars), F.lit(1).alias("_unit")) for f in parts))
            return Frame(df, parts[0].vars)
        if kind == "not":
            ahead, back = [str(x) for x in p[1] if not isinstance(x, tuple)], [str(x[1]) for x in p[1] if isinstance(x, tuple)]
            parts = [self.other_than(s, ahead, o, graph)] if ahead or not back else []
            parts += [self.other_than(o, back, s, graph)] if back else []
            names = parts[0].vars
            df = reduce(DataFrame.unionByName, (f.df.select(*(col(v) for v in names), F.lit(1).alias("_unit")) for f in parts))
            return Frame(df, names)
        a, b = Var(f"_m{next(self.n)}"), Var(f"_m{next(self.n)}")
        f = self.path(a, p[1], b, graph)
        edges = f.df.select(col(a).alias("a"), col(b).alias("b")).distinct()
        pairs = edges
        if kind in ("star", "plus"):  # from a constant end only what it reaches is found, not all pairs
            if not isinstance(s, Var):
                pairs = reached(edges, constant(s).cast(TERM))
            elif not isinstance(o, Var):
                pairs = reached(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), constant(o).cast(TERM)).select(F.col("b").alias("a"), F.col("a").alias("b"))
            else:
                pairs = closure(edges)
        if kind in ("star", "maybe"):
            ends = [x for x in (s, o) if not isinstance(x, Var)]
            nodes = edges.select("a").union(edges.select("b"))
            for x in ends:
                nodes = nodes.union(self.spark.range(1).select(constant(x).cast(TERM)))
            pairs = pairs.union(nodes.distinct().toDF("a").select("a", F.col("a").alias("b"))).distinct()
        out: dict[str, Column] = {}
        for x, c in ((s, F.col("a")), (o, F.col("b"))):
            if not isinstance(x, Var):
                pairs = pairs.where(c == constant(x).cast(TERM))
            elif str(x) in out:
                pairs = pairs.where(F.col("a") == F.col("b"))
            else:
                out[str(x)] = c
        return Frame(pairs.select(*(c.alias(f"v_{v}") for v, c in out.items()), F.lit(1).alias("_unit")), list(out))


def parsed(c: Column) -> Column:
    """A struct from an N-Triples text."""
    literal = r'^"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$'
    body = F.regexp_extract(c, literal, 1)
    for e, ch in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\\\", "\\")):
        body = F.replace(body, F.lit(e), F.lit(ch))
    empty = lambda x: F.nullif(x, F.lit(""))
    null = F.lit(None).cast("string")

    def made(t: str, v: Column, d: Column = null, lang: Column = null) -> Column:
        return F.struct(F.lit(t).alias("t"), v.alias("v"), d.alias("d"), lang.alias("l"))

    return (
        F.when(c.startswith("<<"), made("S", c))
        .when(c.startswith("<"), made("I", F.substring(c, F.lit(2), F.length(c) - 2)))
        .when(c.startswith("_:"), made("B", F.substring(c, F.lit(3), F.length(c))))
        .when(c.isNotNull(), made("L", body, empty(F.regexp_extract(c, literal, 3)), empty(F.regexp_extract(c, literal, 2))))
    )
