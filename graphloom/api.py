"""The library's surface: load mappings, materialise, query, write."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import config as configuration
from .frontend import mapping, turtle
from .functions.registry import load_udfs
from .model import MappingError, Rule
from .operators.materialize import Engine
from .sources import Sources


def read_mapping(text: str, name: str = "", section: str = "", override: str = "", db: bool = False, safe: str = "") -> list[Rule]:
    """Rules of one mapping document; ``name`` tells YARRRML by its extension."""
    if name.lower().endswith((".yarrrml", ".yml", ".yaml")):
        from .frontend.yarrrml import translate

        text = translate(text)
    triples, base = turtle.parse(text)
    return mapping.without_self_joins(mapping.Builder(triples, base, section, override, db, safe).rules())


def mapping_files(paths: str, root: str = "") -> list[str]:
    """A file, a directory, or a comma-separated list of these."""
    out: list[str] = []
    for p in (x.strip() for x in paths.split(",") if x.strip()):
        p = p if os.path.isabs(p) or not root else os.path.join(root, p)
        out += sorted(os.path.join(p, f) for f in os.listdir(p)) if os.path.isdir(p) else [p]
    return out


@dataclass
class KnowledgeGraph:
    """A configured graph: ``quads()``, ``sparql(text)``, ``write(path)``."""

    spark: SparkSession
    rules: list[Rule]
    engine: Engine
    config: configuration.Config = field(default_factory=configuration.Config)
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def from_config(cls, spark: SparkSession, source: str, memory: dict[str, object] | None = None, root: str = "") -> KnowledgeGraph:
        c = configuration.load(source, root)
        if c.udfs:
            load_udfs(c.udfs if os.path.isabs(c.udfs) else os.path.join(root, c.udfs))
        rules: list[Rule] = []
        seen: dict[str, str] = {}
        for name, options in c.sections.items():
            for path in mapping_files(options["mappings"], root):
                with open(path, encoding="utf-8") as f:
                    found = read_mapping(f.read(), path, name, options.get("file_path", ""), "db_url" in options, c.options.safe)
                for r in {r.name for r in found}:
                    if seen.setdefault(r, name) != name:
                        raise MappingError(f"triples map {r} is in two sections")
                rules += found
        sources = Sources(spark, dict(memory or {}), c.sections, root)
        keys = {k: tuple(x.strip() for x in v.split(",")) for o in c.sections.values() for k, _, v in (p.partition(":") for p in o.get("keys", "").split(";")) if v}
        return cls(spark, rules, Engine(sources, c.options, keys), c, keys)

    @classmethod
    def from_mapping(cls, spark: SparkSession, text: str, memory: dict[str, object] | None = None, root: str = "", yarrrml: bool = False, **options) -> KnowledgeGraph:
        """From mapping text. ``keys``: source location -> unique columns, which lets queries skip duplicate removal."""
        from .terms import Options

        keys = options.pop("keys", {})
        rules = read_mapping(text, "m.yml" if yarrrml else "m.ttl", safe=options.get("safe", ""))
        return cls(spark, rules, Engine(Sources(spark, dict(memory or {}), {}, root), Options(**options), keys), keys=keys)

    def quads(self) -> DataFrame:
        """s, p, o, g as N-Triples texts, each quad once."""
        return self.engine.materialize(self.rules)

    def sparql(self, text: str) -> DataFrame:
        """Solutions (one column of N-Triples text a variable; a boolean for ASK; s, p, o for CONSTRUCT and DESCRIBE)."""
        from .sparql.evaluate import Evaluator

        return Evaluator(self.engine, self.rules, self.keys).query(text)

    def write(self, path: str = "", single_file: bool = False) -> str:
        from .sinks import write

        return write(self, path, single_file)


def materialize_set(kg: KnowledgeGraph) -> set[str]:
    """Statements as texts without final dots, gathered: for graphs that fit in memory."""
    from .sinks import statements

    return {r[0][:-2] for r in statements(kg.quads()).collect()}


def translate_to_rml(path: str) -> str:
    """A mapping file in N-Triples, with YARRRML translated."""
    from .terms import node_text

    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.lower().endswith((".yarrrml", ".yml", ".yaml")):
        from .frontend.yarrrml import translate

        text = translate(text)
    return "".join(f"{node_text(s)} {node_text(p)} {node_text(o)} .\n" for s, p, o in turtle.parse(text)[0])
