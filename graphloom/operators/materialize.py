"""Rules as DataFrames of quads: s, p, o, g in N-Triples form, g null for the default graph.

Rules over one source share one scan: each row makes an array of quads that
is unnested. Referencing objects and quoted triples with conditions are
equi-joins on the source columns, before any term is made.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import Functions
from ..model import MappingError, Rule, TermMap
from ..plans.partition import disjoint_groups, invertible
from ..sources import Sources
from ..terms import Options, TermCompiler, na, present, references, text_of

QUAD = "struct<s:string,p:string,o:string,g:string>"


class Engine:
    """Compiles rules against sources."""

    def __init__(self, sources: Sources, options: Options | None = None, keys: dict[str, tuple[str, ...]] | None = None) -> None:
        self.sources, self.o, self.keys = sources, options or Options(), keys or {}
        self.functions = Functions(self.o.compat)
        self.o.call = lambda call, column: self.functions.value(call, column).text()

    # -- rows

    def columns_of(self, rule: Rule, joins: Iterable[tuple[str, str]] = ()) -> list[str]:
        """Source columns that the rule's own row gives."""
        out: list[str] = [c for c, _ in joins]
        for t in (rule.subject, rule.predicate, rule.object, rule.graph):
            if t is None:
                continue
            out += [c for c, _ in t.joins]
            if t.kind == "quoted" and not t.joins:
                out += self.columns_of(t.value)
            elif t.kind == "parent" and not t.joins:
                out += references(t.value.subject)
            elif t.kind not in ("quoted", "parent"):
                out += references(t)
        return list(dict.fromkeys(out))

    def rows(self, source, refs: list[str], needed: Iterable[str] = ()) -> tuple[DataFrame, dict[str, T.DataType]]:
        """The references as texts, NA values as null; and the types that they had.

        Rows without a ``needed`` reference are left out at the scan. Whole
        numbers come a second time, as such, under #name: joins and constants
        on them need no texts.
        """
        df = self.sources.read(source, refs)
        types = {f.name: f.dataType for f in df.schema}
        if not refs:
            return df, types
        needed = set(needed)
        for r in refs:
            if r in needed:
                df = df.where(present(F.col(f"`{r}`"), self.o.na_values, types[r]))
        text = lambda r: text_of(F.col(f"`{r}`"), types[r])
        out = [(text(r) if r in needed else na(text(r), self.o.na_values, types[r])).alias(r) for r in refs]
        return df.select(*out, *(F.col(f"`{r}`").cast("long").alias("#" + r) for r in refs if isinstance(types[r], T.IntegralType))), types

    def same(self, df: DataFrame, other: DataFrame, child: str, parent: str, prefix: str) -> Column:
        """Equality of a child's and a parent's column: of numbers if both are whole, else of texts."""
        if "#" + child in df.columns and f"{prefix}#{parent}" in other.columns:
            child, parent = "#" + child, "#" + parent
        return F.col(f"`{child}`") == F.col(f"`{prefix}{parent}`")

    def compiler(self, prefix: str, types: dict, base: str) -> TermCompiler:
        return TermCompiler(lambda r: F.col(f"`{prefix}{r}`"), self.o, base, types)

    def joined(self, rule: Rule, more: Iterable[str] = (), needed: Iterable[str] = ()) -> tuple[DataFrame, dict[str, str], dict]:
        """The rule's rows with those of the maps that it joins, under prefixed names."""
        children = [c for t in (rule.subject, rule.object) for c, _ in t.joins]
        df, types = self.rows(rule.source, list(dict.fromkeys([*self.columns_of(rule), *more])), {*needed, *children})
        prefixes: dict[str, str] = {}
        for position in ("subject", "object"):
            t: TermMap = getattr(rule, position)
            if t.kind not in ("parent", "quoted") or not t.joins:
                if t.kind == "parent" and t.value.source != rule.source:
                    raise MappingError("a referencing object map over another source needs a join condition")
                continue
            prefix = f"{position[0]}."
            other = self.joined_value(t, prefix)
            df = df.join(other, [self.same(df, other, c, p, prefix) for c, p in t.joins])
            prefixes[position] = prefix
        return df, prefixes, types

    def joined_value(self, t: TermMap, prefix: str) -> DataFrame:
        """Rows of a parent or quoted map: what its term needs, and the join's columns, prefixed."""
        target: Rule = t.value
        keys = list(dict.fromkeys(p for _, p in t.joins))
        if t.kind == "parent":
            refs = list(dict.fromkeys(keys + references(target.subject)))
            df, _ = self.rows(target.source, refs, refs)
            df = df if set(self.keys.get(target.source.location, ("",))) <= set(refs) else df.dropDuplicates()
            return df.select(*(F.col(f"`{c}`").alias(prefix + c) for c in df.columns))
        df, prefixes, types = self.joined(target, keys, keys)
        text = self.quoted_text(target, prefixes, types, "")
        whole = [c for c in df.columns if c in {"#" + k for k in keys}]
        out = df.select(*(F.col(f"`{c}`").alias(prefix + c) for c in [*keys, *whole]), text.alias(prefix + "_quoted"))
        return out.where(F.col(f"`{prefix}_quoted`").isNotNull()).dropDuplicates()

    def required(self, rule: Rule) -> list[str]:
        """Source columns without which the rule's row makes no quad: those of templates and references."""
        maps = [t for t in (rule.subject, rule.predicate, rule.object, rule.graph) if t is not None]
        return [c for t in maps if t.kind in ("template", "reference") for c in references(replace(t, datatype=None, lang=None))]

    # -- terms

    def position(self, rule: Rule, position: str, prefixes: dict[str, str], types: dict, prefix: str = "") -> Column:
        """N-Triples text of the subject or object; null where the row has none."""
        t: TermMap = getattr(rule, position)
        if t.kind == "quoted":
            if position in prefixes:
                return F.col(f"`{prefixes[position]}_quoted`")
            return self.quoted_text(t.value, {}, types, prefix)
        if t.kind == "parent":
            return self.compiler(prefixes.get(position, prefix), types, rule.base).term(t.value.subject).text(self.o)
        return self.compiler(prefix, types, rule.base).term(t).text(self.o)

    def quoted_text(self, rule: Rule, prefixes: dict[str, str], types: dict, prefix: str) -> Column:
        s, o = (self.position(rule, x, prefixes, types, prefix) for x in ("subject", "object"))
        p = self.compiler(prefix, types, rule.base).term(rule.predicate).text(self.o)
        return F.concat(F.lit("<< "), s, F.lit(" "), p, F.lit(" "), o, F.lit(" >>"))

    def quad(self, rule: Rule, prefixes: dict[str, str], types: dict) -> Column:
        """A quad struct; s, p or o is null where the row makes no quad. Each term is in the plan once."""
        c = self.compiler("", types, rule.base)
        s, o = (self.position(rule, x, prefixes, types) for x in ("subject", "object"))
        p = c.term(rule.predicate).text(self.o)
        g = F.lit(None).cast("string")
        if rule.graph is not None:
            g = c.term(rule.graph).text(self.o)
            p = F.when(g.isNotNull(), p)
        return F.struct(s.alias("s"), p.alias("p"), o.alias("o"), g.alias("g"))

    @staticmethod
    def whole(quads: DataFrame) -> DataFrame:
        """Rows of one column q that are quads."""
        return quads.select("q.*").where("s is not null and p is not null and o is not null")

    def explodes(self, rule: Rule) -> list[str]:
        return [x for x in ("subject", "predicate", "object", "graph") if (t := getattr(rule, x)) is not None and t.kind == "function" and self.functions.explode(t.value)]

    def exploded(self, rule: Rule) -> DataFrame:
        """A rule with a list-valued function: the list's elements become rows, under a column of their own."""
        df, prefixes, types = self.joined(rule)
        df = df.select(*(F.col(f"`{c}`") for c in df.columns))
        for position in self.explodes(rule):
            t: TermMap = getattr(rule, position)
            name = f"_list_{position}"
            v = self.functions.value(t.value, lambda r: F.col(f"`{r}`"))
            df = df.withColumn(name, F.explode(v.col.cast("array<string>")))
            df = df.where(na(F.col(name), self.o.na_values).isNotNull())
            rule = replace(rule, **{position: replace(t, kind="reference", value=name)})
        return self.whole(df.select(self.quad(rule, prefixes, types).alias("q")))

    # -- rules

    def of(self, rules: list[Rule]) -> DataFrame:
        """All quads of the asserted rules, duplicates included."""
        shared: dict = defaultdict(list)
        parts = []
        for r in rules:
            if not r.asserted:
                continue
            if self.explodes(r):
                parts.append(self.exploded(r))
                continue
            if any(t.kind in ("parent", "quoted") and t.joins for t in (r.subject, r.object)) or r.source.kind in ("json", "xml", "http", "memory"):
                df, prefixes, types = self.joined(r)
                parts.append(self.whole(df.select(self.quad(r, prefixes, types).alias("q"))))
                continue
            shared[r.source].append(r)
        for source, own in shared.items():
            constant = [r for r in own if not self.columns_of(r)]
            own = [r for r in own if self.columns_of(r)]
            if constant:
                one = self.sources.spark.range(1)
                parts.append(self.whole(one.select(F.explode(F.array(*(self.quad(r, {}, {}) for r in constant))).alias("q"))))
            if own:
                refs = list(dict.fromkeys(c for r in own for c in self.columns_of(r)))
                df, types = self.rows(source, refs)
                quads = [self.quad(r, {}, types) for r in own]
                if len(quads) == 1:
                    df, types = self.rows(source, refs, self.required(own[0]))
                    quads = [self.quad(own[0], {}, types)]
                    parts.append(self.whole(df.select(quads[0].alias("q"))))
                else:
                    parts.append(self.whole(df.select(F.explode(F.array(*quads)).alias("q"))))
        if not parts:
            return self.sources.spark.createDataFrame([], "s string, p string, o string, g string")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def row_unique(self, rule: Rule) -> bool:
        """No two rows of the rule make the same quad: the subject determines a key of its source, and a join finds one parent at most."""
        key = self.keys.get(rule.source.location)
        if key is None or not invertible(rule.subject, self.o.safe) or not set(key) <= set(references(rule.subject)) or self.explodes(rule):
            return False
        if not rule.object.joins:
            return True
        parents = self.keys.get(rule.object.value.source.location)
        return parents is not None and set(parents) <= {p for _, p in rule.object.joins}

    def materialize(self, rules: list[Rule]) -> DataFrame:
        """The set of quads. Only quads that could come twice are shuffled to remove duplicates."""
        groups = disjoint_groups(rules)
        free = [g[0] for g in groups.values() if len(g) == 1 and self.row_unique(g[0])]
        rest = [r for r in rules if r.asserted and r not in free]
        if not free:
            return self.of(rest).dropDuplicates(["s", "p", "o", "g"])
        if not rest:
            return self.of(free)
        return self.of(free).unionByName(self.of(rest).dropDuplicates(["s", "p", "o", "g"]))

    def grouped(self, rules: list[Rule], each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Quads with ``mapping_partition``: groups of rules that cannot make equal quads, each a set by itself."""
        out = None
        for name, group in disjoint_groups(rules).items():
            part = self.materialize(group).withColumn("mapping_partition", F.lit(name))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.of([]).withColumn("mapping_partition", F.lit("none"))
