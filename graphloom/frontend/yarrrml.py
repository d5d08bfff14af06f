"""YARRRML documents as RML triples (N-Triples text)."""

from __future__ import annotations

import re
from typing import Any

from ..model import RDF, BNode, IRI, Literal, MappingError, Node

RML = "http://w3id.org/rml/"
GREL = "http://users.ugent.be/~bjdmeest/function/grel.ttl#"
#: Prefixes that need no declaration.
PREFIXES = {
    "rdf": RDF, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "xsd": "http://www.w3.org/2001/XMLSchema#",
    "skos": "http://www.w3.org/2004/02/skos/core#", "foaf": "http://xmlns.com/foaf/0.1/", "dc": "http://purl.org/dc/terms/", "dcterms": "http://purl.org/dc/terms/",
    "dct": "http://purl.org/dc/terms/", "dcat": "http://www.w3.org/ns/dcat#", "schema": "http://schema.org/", "geo": "http://www.opengis.net/ont/geosparql#",
    "sosa": "http://www.w3.org/ns/sosa/", "ssn": "http://www.w3.org/ns/ssn/", "prov": "http://www.w3.org/ns/prov#", "void": "http://rdfs.org/ns/void#",
    "vcard": "http://www.w3.org/2006/vcard/ns#", "org": "http://www.w3.org/ns/org#", "time": "http://www.w3.org/2006/time#", "sd": "http://www.w3.org/ns/sparql-service-description#",
    "rr": "http://www.w3.org/ns/r2rml#", "rml": RML, "ql": "http://semweb.mmlab.be/ns/ql#", "fno": "https://w3id.org/function/ontology#", "fnml": "http://semweb.mmlab.be/ns/fnml#",
    "grel": GREL, "csvw": "http://www.w3.org/ns/csvw#", "qb": "http://purl.org/linked-data/cube#", "gr": "http://purl.org/goodrelations/v1#", "sioc": "http://rdfs.org/sioc/ns#",
    "cc": "http://creativecommons.org/ns#", "rif": "http://www.w3.org/2007/rif#", "wdr": "http://www.w3.org/2007/05/powder#", "xhv": "http://www.w3.org/1999/xhtml/vocab#",
}
#: Other names of the keys.
KEYS = {
    "subject": "subjects", "s": "subjects", "po": "predicateobjects", "predicateobject": "predicateobjects", "p": "predicates", "predicate": "predicates", "o": "objects",
    "object": "objects", "v": "value", "source": "sources", "mapping": "mappings", "m": "mappings", "fn": "function", "f": "function", "pms": "parameters", "g": "graphs", "graph": "graphs",
    "conditions": "condition", "lang": "language", "inversepredicate": "inversepredicates", "i": "inversepredicates", "nonassertedquoted": "quotedNonAsserted",
}
KINDS = {"iri": "IRI", "literal": "Literal", "blanknode": "BlankNode"}
FORMULATIONS = {"csv": "CSV", "jsonpath": "JSONPath", "xpath": "XPath", "mysql": "SQL2008", "postgresql": "SQL2008", "sqlite": "SQL2008"}


def _listed(x: Any) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def _keys(x: Any, inside: str = "") -> Any:
    """Key names unified; names of mappings and sources are left alone."""
    if isinstance(x, dict):
        named = inside in ("mappings", "sources", "prefixes", "external")
        out = {}
        for k, v in x.items():
            key = k if named else KEYS.get(str(k).lower(), str(k))
            out[key] = _keys(v, key if not named and inside == "" else "-")
        return out
    return [_keys(y, "-") for y in x] if isinstance(x, list) else x


class Translator:
    def __init__(self, doc: dict) -> None:
        self.doc = {("mappings" if k in ("mapping", "m") else k): v for k, v in doc.items()}
        self.prefixes = PREFIXES | {str(k): str(v) for k, v in (self.doc.get("prefixes") or {}).items()}
        self.external = {str(k): str(v) for k, v in (self.doc.get("external") or {}).items()}
        self.triples: list[tuple[Node, Node, Node]] = []
        self.n = 0
        self.base = str(self.doc.get("base") or "")
        self.mappings = {str(k): _keys(v) for k, v in (self.doc.get("mappings") or {}).items()}

    def add(self, s: Node, p: str, o: Node) -> None:
        self.triples.append((s, IRI(p if ":" in p else RML + p), o))

    def fresh(self, label: str = "n") -> BNode:
        self.n += 1
        return BNode(f"{label}{self.n}")

    def name(self, mapping: str) -> IRI:
        return IRI("http://mapping.example.com/" + mapping)

    def substituted(self, s: Any) -> str:
        s = "true" if s is True else "false" if s is False else str(s)
        return re.sub(r"\$\(_(\w+)\)", lambda m: self.external.get(m[1], m[0]), s)

    def expanded(self, s: str) -> str:
        m = re.match(r"([A-Za-z][\w-]*|):(?!//)(.*)$", s, re.DOTALL)
        return self.prefixes[m[1]] + m[2] if m and m[1] in self.prefixes else s

    def run(self) -> list[tuple[Node, Node, Node]]:
        for name, m in self.mappings.items():
            if not isinstance(m, dict):
                raise MappingError(f"mapping {name} is empty")
            sources = _listed(m.get("sources"))
            if sources and isinstance(sources[0], str) and len(sources) > 1 and "~" in sources[0]:
                sources = [sources]
            for i, source in enumerate(sources or [None]):
                for j, subject in enumerate(_listed(m.get("subjects")) or [None]):
                    node = self.name(name if i + j == 0 else f"{name}_{i}_{j}")
                    self.mapping(node, m, source, subject)
        return self.triples

    def mapping(self, node: IRI, m: dict, source: Any, subject: Any) -> None:
        self.add(node, RDF + "type", IRI(RML + "TriplesMap"))
        if source is not None:
            self.add(node, "logicalSource", self.source(source))
        quoted = isinstance(subject, dict) and ("quoted" in subject or "quotedNonAsserted" in subject)
        sub = self.fresh("s")
        self.add(node, "subjectMap", sub)
        if quoted:
            self.quote(sub, subject)
        elif isinstance(subject, dict) and "function" in subject:
            self.function(sub, subject, "IRI")
        elif subject is None:
            self.add(sub, "template", Literal("_" + node.rsplit("/", 1)[-1]))
            self.add(sub, "termType", IRI(RML + "BlankNode"))
        else:
            self.value(sub, subject if not isinstance(subject, dict) else subject.get("value"), "IRI", subject if isinstance(subject, dict) else {})
        for g in _listed(m.get("graphs")):
            gm = self.fresh("g")
            self.add(sub, "graphMap", gm)
            self.value(gm, g, "IRI", {})
        for po in _listed(m.get("predicateobjects")):
            self.po(node, po)

    def source(self, source: Any) -> BNode:
        if isinstance(source, str) and source in (self.doc.get("sources") or {}):
            source = self.doc["sources"][source]
        if isinstance(source, list) and len(source) == 1 and isinstance(source[0], list):
            source = source[0]
        node = self.fresh("src")
        if isinstance(source, str):
            source = [source]
        if isinstance(source, list):
            access, _, formulation = self.substituted(source[0]).rpartition("~") if "~" in str(source[0]) else (self.substituted(source[0]), "", "csv")
            spec = {"access": access, "referenceFormulation": formulation, "iterator": source[1] if len(source) > 1 else None}
        else:
            spec = source
        formulation = str(spec.get("referenceFormulation") or "csv").lower()
        self.add(node, "referenceFormulation", IRI(RML + FORMULATIONS.get(formulation, "SQL2008")))
        if spec.get("query"):
            self.add(node, "query", Literal(self.substituted(spec["query"])))
        elif spec.get("table"):
            self.add(node, "tableName", Literal(self.substituted(spec["table"])))
        elif spec.get("access") is not None:
            self.add(node, "source", Literal(self.substituted(spec["access"])))
        if spec.get("iterator"):
            self.add(node, "iterator", Literal(self.substituted(spec["iterator"])))
        return node

    def value(self, node: BNode, value: Any, kind: str, more: dict) -> None:
        """A term map from a value with $(references), a final ~kind and options."""
        text = self.substituted(value)
        m = re.search(r"~(iri|literal|blanknode)$", text)
        if m:
            text, kind = text[: m.start()], KINDS[m[1]]
        if t := more.get("type"):
            kind = KINDS.get(str(t).lower(), kind)
        refs = re.findall(r"(?<!\\)\$\(((?:[^()\\]|\\.)+)\)", text)
        if not refs:
            full = self.expanded(text)
            if kind != "Literal" or re.match(r"[A-Za-z][\w-]*:", text) and full != text:
                self.add(node, "constant", IRI(full))
                if kind == "Literal":
                    kind = "IRI"
            else:
                self.add(node, "constant", Literal(text.replace("\\", "")))
        elif re.fullmatch(r"\$\((?:[^()\\]|\\.)+\)", text):
            self.add(node, "reference", Literal(re.sub(r"\\([()])", r"\1", refs[0])))
        else:
            full = self.expanded(text)
            if full != text and kind == "Literal" and not more.get("type"):
                kind = "IRI"
            body = re.sub(r"(?<!\\)\$\(((?:[^()\\]|\\.)+)\)", lambda m: "\0" + m[1] + "\1", full)
            body = body.replace("{", "\\{").replace("}", "\\}").replace("\0", "{").replace("\1", "}")
            self.add(node, "template", Literal(re.sub(r"\\([()])", r"\1", body)))
        self.add(node, "termType", IRI(RML + kind))
        if (d := more.get("datatype")) is not None:
            self.add(node, "datatype", IRI(self.expanded(self.substituted(d))))
        if (lang := more.get("language")) is not None:
            refs = re.findall(r"\$\((.+?)\)", self.substituted(lang))
            if refs:
                lm = self.fresh("l")
                self.add(node, "languageMap", lm)
                self.value(lm, lang, "Literal", {})
            else:
                self.add(node, "language", Literal(self.substituted(lang)))

    def po(self, node: IRI, po: Any) -> None:
        if isinstance(po, list):
            objects = po[1]
            more: dict = {}
            if len(po) > 2:
                third = str(po[2])
                more = {"language": third[:-5]} if third.endswith("~lang") else {"datatype": third}
            if isinstance(objects, list) and len(objects) > 1 and isinstance(objects[1], str) and len(po) == 2 and objects[1].endswith("~lang"):
                objects = [objects]
            po = {"predicates": po[0], "objects": [o if isinstance(o, list) else [o, *([f"{more['language']}~lang"] if "language" in more else [more["datatype"]] if "datatype" in more else [])] if not isinstance(o, dict) else o for o in _listed(objects)]}
        po = _keys(po) if isinstance(po, dict) else po
        pom = self.fresh("pom")
        for p in _listed(po.get("predicates")):
            pm = self.fresh("p")
            self.add(pom, "predicateMap", pm)
            if p == "a":
                self.add(pm, "constant", IRI(RDF + "type"))
            else:
                self.value(pm, p, "IRI", {})
        for g in _listed(po.get("graphs")):
            gm = self.fresh("g")
            self.add(pom, "graphMap", gm)
            self.value(gm, g, "IRI", {})
        made = False
        objects = po.get("objects")
        if isinstance(objects, list) and objects and not isinstance(objects[0], list | dict) and len(objects) == 2 and (str(objects[1]).endswith("~lang") or re.fullmatch(r"xsd:\w+", str(objects[1]))):
            objects = [objects]
        is_type = _listed(po.get("predicates")) == ["a"]
        for o in _listed(objects):
            om = self.fresh("o")
            kind = "IRI" if is_type else "Literal"
            if isinstance(o, dict) and ("mappings" in o or "quoted" in o or "quotedNonAsserted" in o):
                if "mappings" in o:
                    self.add(om, "parentTriplesMap", self.name(str(o["mappings"])))
                    self.conditions(om, o.get("condition"))
                else:
                    self.quote(om, o)
            elif isinstance(o, dict) and "function" in o:
                self.function(om, o, kind)
            elif isinstance(o, dict):
                self.value(om, o.get("value"), kind, o)
            else:
                o = _listed(o)
                more = {}
                if len(o) > 1:
                    more = {"language": str(o[1])[:-5]} if str(o[1]).endswith("~lang") else {"datatype": o[1]}
                self.value(om, o[0], kind, more)
            self.add(pom, "objectMap", om)
            made = True
        if made:
            self.add(node, "predicateObjectMap", pom)

    def conditions(self, node: BNode, conditions: Any) -> None:
        for c in _listed(conditions):
            given = {}
            for p in c.get("parameters") or []:
                name, value = (p[0], p[1]) if isinstance(p, list) else (p["parameter"], p["value"])
                given[str(name).rsplit(":", 1)[-1]] = re.sub(r"^\$\((.*)\)$", r"\1", self.substituted(value))
            if "str1" not in given or "str2" not in given:
                raise MappingError("a condition needs str1 and str2")
            j = self.fresh("j")
            self.add(node, "joinCondition", j)
            self.add(j, "child", Literal(given["str1"]))
            self.add(j, "parent", Literal(given["str2"]))

    def quote(self, node: BNode, spec: dict) -> None:
        target = str(spec.get("quoted") or spec.get("quotedNonAsserted"))
        self.add(node, "quotedTriplesMap", self.name(target))
        if "quotedNonAsserted" in spec:
            self.add(self.name(target), RDF + "type", IRI(RML + "NonAssertedTriplesMap"))
        self.conditions(node, spec.get("condition"))

    def function(self, node: BNode, spec: dict, kind: str) -> None:
        execution = self.fresh("x")
        self.add(node, "functionExecution", execution)
        kind = KINDS.get(str(spec.get("type", "")).lower(), kind)
        self.add(node, "termType", IRI(RML + kind))
        if "datatype" in spec:
            self.add(node, "datatype", IRI(self.expanded(str(spec["datatype"]))))
        if "language" in spec:
            self.add(node, "language", Literal(str(spec["language"])))
        self.execution(execution, spec)

    def execution(self, execution: BNode, spec: dict) -> None:
        text = str(spec["function"])
        inline = re.fullmatch(r"([^()]+)\((.*)\)", text, re.DOTALL)
        parameters: list = list(_listed(spec.get("parameters")))
        if inline:
            text = inline[1]
            prefix = text.rpartition(":")[0]
            for part in re.split(r",\s*(?=[\w:]+\s*=)", inline[2]):
                k, _, v = part.partition("=")
                parameters.append([k.strip() if ":" in k else f"{prefix}:{k.strip()}", v.strip().strip('"')])
        self.add(execution, "function", IRI(self.expanded(text)))
        for p in parameters:
            name, value = (p[0], p[1]) if isinstance(p, list) else (p.get("parameter"), p.get("value"))
            i = self.fresh("i")
            self.add(execution, "input", i)
            self.add(i, "parameter", IRI(self.expanded(str(name))))
            vm = self.fresh("v")
            self.add(i, "inputValueMap", vm)
            if isinstance(value, dict) and "function" in value:
                inner = self.fresh("x")
                self.add(vm, "functionExecution", inner)
                self.execution(inner, value)
            else:
                value = _listed(value)[0] if isinstance(value, list) else value
                text = self.substituted(value)
                if "$(" in text:
                    self.value(vm, value, "Literal", {"type": "literal"})
                else:
                    self.add(vm, "constant", Literal(self.expanded(text)))


def translate(text: str) -> str:
    import yaml

    from ..terms import node_text

    doc = yaml.load(text, Loader=yaml.BaseLoader)
    if not isinstance(doc, dict):
        raise MappingError("not a YARRRML document")
    return "".join(f"{node_text(s)} {node_text(p)} {node_text(o)} .\n" for s, p, o in Translator(doc).run())
