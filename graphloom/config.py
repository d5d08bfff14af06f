"""Configuration: INI text or file; a CONFIGURATION section and one section for each data source."""

from __future__ import annotations

import configparser
import os
from dataclasses import dataclass, field

from .model import MappingError
from .terms import Options

FORMATS = {"N-TRIPLES": ".nt", "N-QUADS": ".nq", "JELLY": ".jelly"}


@dataclass
class Config:
    options: Options = field(default_factory=Options)
    output_dir: str = ""
    output_file: str = "knowledge-graph"
    output_format: str = "N-TRIPLES"
    partitioning: str = "PARTIAL-AGGREGATIONS"
    udfs: str = ""
    kafka_server: str = ""
    kafka_topic: str = ""
    keys: dict[str, list[str]] = field(default_factory=dict)
    sections: dict[str, dict[str, str]] = field(default_factory=dict)
    root: str = ""


def _yes(s: str) -> bool:
    return s.strip().lower() in ("yes", "true", "on", "1")


def load(source: str, root: str = "") -> Config:
    """A path to an INI file, or INI text. Mapping and file paths in it are relative to ``root``."""
    parser = configparser.ConfigParser(interpolation=configparser.ExtendedInterpolation())
    if "\n" not in source and os.path.exists(source):
        with open(source, encoding="utf-8") as f:
            parser.read_string(f.read())
    else:
        parser.read_string(source)
    c = Config(root=root)
    main = next((dict(parser.items(s)) for s in parser.sections() if s.upper() == "CONFIGURATION"), {})
    o = c.options
    if "na_values" in main:
        o.na_values = tuple(main["na_values"].split(",")) if main["na_values"] else ()
    o.escaping = main.get("literal_escaping_chars", o.escaping)
    o.printable_only = _yes(main.get("only_printable_chars", main.get("only_printable_characters", "no")))
    o.safe = main.get("safe_percent_encoding", "")
    o.infer_datatypes = _yes(main.get("infer_sql_datatypes", "no"))
    o.compat = _yes(main.get("compat", "no"))
    c.output_dir, c.output_file = main.get("output_dir", ""), main.get("output_file", c.output_file)
    c.output_format = main.get("output_format", c.output_format).upper()
    if c.output_format not in FORMATS:
        raise MappingError(f"output_format must be one of {', '.join(FORMATS)}")
    c.partitioning = main.get("mapping_partitioning", main.get("mapping_partition", c.partitioning)).upper()
    if c.partitioning not in ("PARTIAL-AGGREGATIONS", "MAXIMAL", "NO", "FALSE", "OFF", "0"):
        raise MappingError(f"unknown mapping_partitioning {c.partitioning}")
    c.udfs, c.kafka_server, c.kafka_topic = main.get("udfs", ""), main.get("output_kafka_server", ""), main.get("output_kafka_topic", "")
    c.sections = {s: dict(parser.items(s)) for s in parser.sections() if s.upper() != "CONFIGURATION"}
    for s, options in c.sections.items():
        if "mappings" not in options:
            raise MappingError(f"section {s} names no mappings")
    return c
