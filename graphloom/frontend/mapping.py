"""From the triples of an R2RML, RML or legacy RML mapping to rules.

All vocabularies are read through one table of names, so each construct has
one reader; shortcuts become term maps, classes become rdf:type rules, and
the product of subject, predicates, objects and graphs becomes flat rules.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import replace

from ..model import RDF, BNode, Call, IRI, Literal, MappingError, Node, Rule, Source, TermMap

#: The namespaces whose names mean the same here.
NAMESPACES = (
    "http://w3id.org/rml/",
    "http://www.w3.org/ns/r2rml#",
    "http://semweb.mmlab.be/ns/rml#",
    "http://semweb.mmlab.be/ns/fnml#",
    "http://semweb.mmlab.be/ns/ql#",
    "https://w3id.org/function/ontology#",
    "http://www.w3.org/ns/formats/",
    "http://www.w3.org/2011/http#",
    "https://w3id.org/okn/o/sd#",
)
#: Older names and the names that they have now.
RENAMED = {
    "logicalTable": "logicalSource",
    "sqlQuery": "query",
    "column": "reference",
    "parentTriplesMap": "parentTriplesMap",
    "functionValue": "functionValue",
    "execution": "functionExecution",
    "executes": "function",
    "langMap": "languageMap",
    "subject": "subject",
    "quotedTriplesMap": "quotedTriplesMap",
    "starMap": "quotedTriplesMap",
    "predicates": "predicate",
    "returnMap": "returnMap",
    "valueMap": "inputValueMap",
    "value": "inputValue",
}
TYPES = {"IRI": "iri", "URI": "iri", "BlankNode": "bnode", "Literal": "literal", "RDFstarTriple": "star", "StarTriple": "star"}
EXTENSIONS = {
    "csv": "csv", "tsv": "tsv", "json": "json", "geojson": "json", "xml": "xml", "parquet": "parquet", "geoparquet": "geoparquet", "orc": "orc",
    "feather": "feather", "dta": "stata", "xpt": "sas", "sas7bdat": "sas", "sav": "spss", "shp": "shapefile",
    "xls": "excel", "xlsx": "excel", "xlsm": "excel", "xlsb": "excel", "ods": "ods", "fods": "ods",
}


def local(iri: Node | None) -> str:
    """The name of a term of any known vocabulary; other IRIs as they are."""
    s = str(iri)
    for ns in NAMESPACES:
        if s.startswith(ns):
            name = s[len(ns) :]
            return RENAMED.get(name, name)
    return s


class Graph:
    def __init__(self, triples: list[tuple[Node, Node, Node]]) -> None:
        self.out: dict[Node, dict[str, list[Node]]] = defaultdict(lambda: defaultdict(list))
        for s, p, o in dict.fromkeys(triples):
            self.out[s][local(p)].append(o)

    def all(self, s: Node, name: str) -> list[Node]:
        return self.out[s][name] if s in self.out and name in self.out[s] else []

    def one(self, s: Node, name: str) -> Node | None:
        found = self.all(s, name)
        if len(found) > 1:
            raise MappingError(f"{name} is given {len(found)} times")
        return found[0] if found else None


def template_parts(template: str) -> list[tuple[bool, str]]:
    """(is a reference, text) in order; \\{ and \\} are braces, not references."""
    parts: list[tuple[bool, str]] = []
    text, i = "", 0
    while i < len(template):
        c = template[i]
        if c == "\\" and i + 1 < len(template) and template[i + 1] in "{}\\":
            text, i = text + template[i + 1], i + 2
        elif c == "{":
            end = i + 1
            while end < len(template) and (template[end] != "}" or template[end - 1] == "\\"):
                end += 1
            if end >= len(template):
                raise MappingError(f"a brace of {template!r} is not closed")
            if text:
                parts.append((False, text))
            parts.append((True, _plain(re.sub(r"\\([{}])", r"\1", template[i + 1 : end]))))
            text, i = "", end + 1
        else:
            text, i = text + c, i + 1
    if text:
        parts.append((False, text))
    return parts


def _plain(reference: str) -> str:
    """A reference without SQL's delimiters."""
    return reference[1:-1] if len(reference) > 1 and reference[0] == reference[-1] == '"' else reference


#: how an absolute IRI begins
SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*:"


def resolved(template: str, base: str, safe: str = "") -> str:
    """An IRI template with the base before it where no row can make it absolute by itself; else as it is."""
    parts = template_parts(template)
    start = parts[0][1] if parts and not parts[0][0] else ""
    if not re.match(SCHEME, base) or re.match(SCHEME, start):
        return template
    texts = [text for is_ref, text in parts if not is_ref]
    if re.match(r"[A-Za-z0-9+.-]*[^A-Za-z0-9+.:-]", start) or not any(":" in t for t in (*texts, safe)):
        return re.sub(r"([\\{}])", r"\\\1", base) + template
    return template


class Builder:
    def __init__(self, triples: list[tuple[Node, Node, Node]], base: str = "", section: str = "", override: str = "", db: bool = False, safe: str = "") -> None:
        self.g, self.base, self.section, self.override, self.db, self.safe = Graph(triples), base, section, override, db, safe
        self.building: set[Node] = set()

    def rules(self) -> list[Rule]:
        maps = [s for s in list(self.g.out) if self.g.all(s, "logicalSource")]
        out = []
        for m in maps:
            out += self.of(m)
        return out

    def asserted(self, m: Node) -> bool:
        return "NonAssertedTriplesMap" not in map(local, self.g.all(m, RDF + "type"))

    def source(self, m: Node) -> Source:
        g = self.g
        if len(g.all(m, "logicalSource")) != 1:
            raise MappingError("a triples map needs one logical source")
        node = g.one(m, "logicalSource")
        location, query, table = g.one(node, "source"), g.one(node, "query"), g.one(node, "tableName")
        iterator, formulation = g.one(node, "iterator"), local((g.all(node, "referenceFormulation") or [None])[-1])
        http: tuple[tuple[str, str], ...] = ()
        where = str(location or "")
        if isinstance(location, BNode | IRI) and location in g.out:
            if uri := g.one(location, "absoluteURI"):
                where = str(uri)
                headers = [h for x in g.all(location, "headers") for h in ([x] if x not in g.out or not g.all(x, RDF + "first") else self.items(x))]
                http = tuple((str(g.one(h, "fieldName")), str(g.one(h, "fieldValue"))) for h in headers)
                return Source("http", where, str(iterator or ""), "", self.section, http)
            name = g.one(location, "name") or g.one(location, "path") or g.one(location, "root")
            where = "{" + str(name) + "}" if g.one(location, "name") else str(name or "")
        where = self.override or where
        if table is not None:
            return Source("table", _plain(str(table)), "", "", self.section)
        if query is not None:
            kind = "table" if self.db else "cypher" if formulation.lower().startswith("cypher") else "query"
            return Source(kind, "", "", str(query).strip().rstrip(";"), self.section)
        if where.startswith("{"):
            return Source("memory", where[1:-1], str(iterator or ""), "", self.section)
        ext = where.split("?")[0].rsplit(".", 1)[-1].lower()
        kind = EXTENSIONS.get(ext) or {"csv": "csv", "jsonpath": "json", "xpath": "xml"}.get(formulation.lower(), "csv" if not self.db else "table")
        if where.startswith(("http://", "https://")) and kind == "csv" and formulation == "JSONPath":
            kind = "http"
        return Source(kind, where, str(iterator or ""), "", self.section)

    def items(self, head: Node) -> list[Node]:
        out = []
        while head in self.g.out and (first := self.g.one(head, RDF + "first")) is not None:
            out.append(first)
            head = self.g.one(head, RDF + "rest")
        return out

    def maps(self, node: Node, name: str) -> list[Node | tuple[str, Node]]:
        """Term map nodes of a position, shortcuts among them as (constant, node)."""
        return [*self.g.all(node, name + "Map"), *(("constant", x) for x in self.g.all(node, name))]

    def term(self, spec: Node | tuple[str, Node], position: str) -> TermMap:
        if isinstance(spec, tuple):
            return self.checked(TermMap("constant", spec[1], self.kind_of(spec[1])), position)
        g = self.g
        given = [n for n in ("constant", "template", "reference", "functionExecution", "functionValue", "quotedTriplesMap", "parentTriplesMap", "function") if g.all(spec, n)]
        if len(given) != 1:
            raise MappingError(f"a {position} map needs one of constant, template, reference, function or triples map; it has {given or 'none'}")
        kind, value = given[0], g.one(spec, given[0])
        joins = tuple((_plain(str(g.one(j, "child"))), _plain(str(g.one(j, "parent")))) for j in g.all(spec, "joinCondition"))
        langs, datatypes = self.maps(spec, "language"), self.maps(spec, "datatype")
        lang = self.term(langs[0], "language") if langs else None
        datatype = self.term(datatypes[0], "datatype") if datatypes else None
        if lang and lang.kind == "constant" and not re.fullmatch(r"[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*", str(lang.value)):
            raise MappingError(f"{lang.value!r} is not a language tag")
        if lang and lang.kind == "constant" and str(lang.value).lower() in ("english", "spanish", "french", "german"):
            raise MappingError(f"{lang.value!r} is not a language tag")
        named = g.one(spec, "termType")
        if kind == "parentTriplesMap":
            return TermMap("parent", value, "iri", joins=joins)
        if kind == "quotedTriplesMap":
            return TermMap("quoted", value, "star", joins=joins)
        if kind == "constant":
            if isinstance(value, Literal) and local(g.one(spec, "termType")) in ("IRI", "URI"):
                value = IRI(value.value)
            return self.checked(TermMap("constant", value, self.kind_of(value)), position)
        if named is not None:
            if local(named) not in TYPES:
                raise MappingError(f"unknown term type {named}")
            term = TYPES[local(named)]
        elif position == "object" and (kind in ("reference", "functionExecution", "functionValue") or lang or datatype) or position in ("language", "argument"):
            term = "literal"
        else:
            term = "iri"
        if kind == "template":
            template_parts(str(value))
            made = TermMap("template", resolved(str(value), self.base, self.safe) if term == "iri" else str(value), term, datatype, lang)
        elif kind == "reference":
            made = TermMap("reference", _plain(str(value)), term, datatype, lang)
        else:
            made = TermMap("function", self.call(value if kind != "function" else spec, kind), term, datatype, lang)
        return self.checked(made, position)

    def kind_of(self, node: Node) -> str:
        return "literal" if isinstance(node, Literal) else "bnode" if isinstance(node, BNode) else "iri"

    def checked(self, t: TermMap, position: str) -> TermMap:
        allowed = {"subject": ("iri", "bnode", "star"), "predicate": ("iri",), "graph": ("iri",), "datatype": ("iri", "literal")}.get(position)
        if allowed and t.term not in allowed:
            raise MappingError(f"a {position} can't be a {t.term}")
        if t.term != "literal" and (t.datatype or t.lang):
            raise MappingError("only literals have a datatype or language")
        return t

    def call(self, node: Node, kind: str) -> Call:
        g = self.g
        if kind == "functionValue":  # the legacy form: a nested triples map whose predicate-object maps are the arguments
            function, inputs = None, []
            for pom in g.all(node, "predicateObjectMap"):
                name = str(g.one(pom, "predicate") or g.one(g.one(pom, "predicateMap"), "constant"))
                for o in self.maps(pom, "object"):
                    t = self.term(o, "argument")
                    if local(name) == "function":
                        function = str(t.value)
                    else:
                        inputs.append((re.split(r"[#/]", name)[-1], t))
            if not function:
                raise MappingError("a function value without a function")
            return Call(function, tuple(inputs))
        functions = [x[1] if isinstance(x, tuple) else self.g.one(x, "constant") for x in self.maps(node, "function")]
        if len(functions) != 1:
            raise MappingError("an execution needs one function")
        inputs = []
        for i in g.all(node, "input"):
            parameter = [x[1] if isinstance(x, tuple) else g.one(x, "constant") for x in self.maps(i, "parameter")]
            values = [*g.all(i, "inputValueMap"), *(("constant", x) for x in g.all(i, "inputValue"))]
            if len(parameter) != 1 or len(values) != 1:
                raise MappingError("an input needs one parameter and one value")
            inputs.append((re.split(r"[#/]", str(parameter[0]))[-1], self.term(values[0], "argument")))
        return Call(str(functions[0]), tuple(inputs))

    def of(self, m: Node) -> list[Rule]:
        """A triples map's rules, or one without predicate for a map that only serves as a parent."""
        g, source = self.g, self.source(m)
        subjects = self.maps(m, "subject")
        if len(subjects) != 1:
            raise MappingError(f"a triples map needs one subject map; {m} has {len(subjects)}")
        subject = self.term(subjects[0], "subject")
        node = subjects[0] if not isinstance(subjects[0], tuple) else None
        shared = [self.term(x, "graph") for x in self.maps(node, "graph")] if node is not None else []
        out = []
        name = str(m)

        def add(p: TermMap, o: TermMap, graphs: list[TermMap]) -> None:
            for one in graphs or [None]:
                default = one is None or one.kind == "constant" and local(one.value) == "defaultGraph"
                out.append(Rule(name, source, subject, p, o, None if default else one, self.asserted(m), self.base))

        for c in g.all(node, "class") if node is not None else []:
            add(TermMap("constant", IRI(RDF + "type")), TermMap("constant", c, self.kind_of(c)), shared)
        for pom in g.all(m, "predicateObjectMap"):
            predicates, objects = self.maps(pom, "predicate"), self.maps(pom, "object")
            if not predicates or not objects:
                raise MappingError("a predicate-object map needs a predicate and an object")
            graphs = shared + [self.term(x, "graph") for x in self.maps(pom, "graph")]
            for p in predicates:
                for o in objects:
                    add(self.term(p, "predicate"), self.term(o, "object"), graphs)
        return [r for x in out for r in self.linked(x)]

    def linked(self, rule: Rule) -> list[Rule]:
        """Parents and quoted maps in place of their names; a map that is quoted with k rules gives k rules."""
        out = [rule]
        for position in ("subject", "object"):
            more = []
            for r in out:
                t = getattr(r, position)
                if t.kind == "parent":
                    target = t.value
                    if not self.g.all(target, "logicalSource"):
                        raise MappingError(f"the parent {target} is no triples map")
                    subject = self.term(self.maps(target, "subject")[0], "subject")
                    parent = Rule(str(target), self.source(target), subject, subject, subject, None, False, self.base)
                    more.append(replace(r, **{position: replace(t, value=parent, term=subject.term)}))
                elif t.kind == "quoted":
                    if t.value in self.building:
                        raise MappingError(f"{t.value} quotes itself")
                    self.building.add(t.value)
                    more += [replace(r, **{position: replace(t, value=q)}) for q in self.of(t.value)]
                    self.building.discard(t.value)
                else:
                    more.append(r)
            out = more
        return out


def without_self_joins(rules: list[Rule]) -> list[Rule]:
    """Parents over the same source become the same row's subject where that cannot change the result.

    That is so without join conditions, and where each condition equates a
    column with itself and the parent's subject uses no other column.
    """
    from ..terms import references

    out = []
    for r in rules:
        o = r.object
        if o.kind == "parent" and o.value.source == r.source:
            same = all(c == p for c, p in o.joins)
            if not o.joins or same and set(references(o.value.subject)) <= {c for c, _ in o.joins}:
                r = replace(r, object=o.value.subject)
        out.append(r)
    return out
