"""The registered queries: mappings over the driver's tables, graph queries over them, and the same in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import KnowledgeGraph

PREFIXES = """@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix rml: <http://w3id.org/rml/> . @prefix ex: <http://ex.org/> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
@prefix grel: <http://users.ugent.be/~bjdmeest/function/grel.ttl#> . @prefix fx: <http://ex.org/function/built-in.ttl#> . @base <http://ex.org/map/> .
"""
XSD = "http://www.w3.org/2001/XMLSchema#"
#: unique columns of the tables
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id"}


def source(table: str) -> str:
    return f'rml:logicalSource [ rml:source "@DIR@/{table}.parquet" ]'


def view(sql: str) -> str:
    return f'rml:logicalSource [ rml:query """{sql}""" ; rml:referenceFormulation rml:SQL2008 ]'


def po(predicate: str, *parts: str) -> str:
    return f"rml:predicateObjectMap [ rml:predicate {predicate} ; rml:objectMap [ {' ; '.join(parts)} ] ]"


def ref(column: str, datatype: str = "") -> str:
    return f'rml:reference "{column}"' + (f" ; rml:datatype {datatype}" if datatype else "")


def subject(template: str, *more: str) -> str:
    return f"rml:subjectMap [ {' ; '.join([f'rml:template "http://ex.org/{template}"', *more])} ]"


def triples_map(name: str, *parts: str) -> str:
    return f"<#{name}> {' ; '.join(parts)} ."


def parent(name: str, child: str, of: str) -> str:
    return f'rml:parentTriplesMap <#{name}> ; rml:joinCondition [ rml:child "{child}" ; rml:parent "{of}" ]'


CUSTOMER = triples_map("C", source("customer"), subject("customer/{c_custkey}", "rml:class ex:Customer"), po("ex:name", ref("c_name")), po("ex:segment", ref("c_mktsegment")), po("ex:balance", ref("c_acctbal", "xsd:double")), po("ex:nation", parent("N", "c_nationkey", "n_nationkey")))
NATION = triples_map("N", source("nation"), subject("nation/{n_nationkey}", "rml:class ex:Nation"), po("ex:label", ref("n_name")), po("ex:region", parent("R", "n_regionkey", "r_regionkey")))
REGION = triples_map("R", source("region"), subject("region/{r_regionkey}", "rml:class ex:Region"), po("ex:label", ref("r_name")))
ORDER = triples_map("O", source("orders"), subject("order/{o_orderkey}", "rml:class ex:Order"), po("ex:status", ref("o_orderstatus")), po("ex:total", ref("o_totalprice", "xsd:double")), po("ex:priority", ref("o_orderpriority")), po("ex:customer", parent("C", "o_custkey", "c_custkey")))
SUPPLIER = triples_map("S", source("supplier"), subject("supplier/{s_suppkey}", "rml:class ex:Supplier"), po("ex:name", ref("s_name")), po("ex:nation", parent("N", "s_nationkey", "n_nationkey")))
SHOP = "\n".join((CUSTOMER, NATION, REGION, ORDER, SUPPLIER))


def graph(spark: SparkSession, sf_dir: str, mapping: str, **options) -> KnowledgeGraph:
    keys = {f"{sf_dir}/{t}.parquet": (k,) for t, k in KEYS.items()}
    for t in KEYS | {"lineitem": ""}:
        if f"<<{t}>>" in mapping:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"view_{t}")
            mapping = mapping.replace(f"<<{t}>>", f"view_{t}")
    return KnowledgeGraph.from_mapping(spark, PREFIXES + mapping.replace("@DIR@", sf_dir), keys=keys, **options)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def mapped(name: str, mapping: str, sql: str, graphs: bool = False, **options) -> None:
    """A query for all quads of a mapping; sql gives s, p, o (and g)."""
    columns = ("s", "p", "o", "g") if graphs else ("s", "p", "o")
    QUERIES[name] = lambda spark, sf_dir: graph(spark, sf_dir, mapping, **options).quads().select(*columns)
    ORACLES[name] = f"SELECT DISTINCT {', '.join(columns)} FROM ({sql}) WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL"


def asked(name: str, mapping: str, query: str, sql: str) -> None:
    text = "PREFIX ex: <http://ex.org/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n" + query
    QUERIES[name] = lambda spark, sf_dir: graph(spark, sf_dir, mapping).sparql(text)
    ORACLES[name] = sql


def iri(template: str) -> str:
    """SQL for an IRI with {column} references, percent-encoded."""
    out, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        column, _, rest = tail.partition("}")
        out += [f"'{head}'", f"url_encode(CAST({column} AS VARCHAR))"]
    out.append(f"'{rest}'")
    return "'<http://ex.org/' || " + " || ".join(out) + " || '>'"


def lit(sql: str, datatype: str = "") -> str:
    tail = f" || '^^<{XSD}{datatype}>'" if datatype else ""
    escaped = f"replace(replace(replace(replace(CAST({sql} AS VARCHAR), chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), '\"', chr(92) || '\"')"
    return f"'\"' || {escaped} || '\"'{tail}"


RDF_TYPE = "'<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>'"


def p(name: str) -> str:
    return f"'<http://ex.org/{name}>'"


def rows(*parts: tuple[str, str, str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {s} AS s, {pr} AS p, {o} AS o FROM {t}" for s, pr, o, t in parts)


# -- sources, terms, joins

_c, _o, _n, _r, _s = iri("customer/{c_custkey}"), iri("order/{o_orderkey}"), iri("nation/{n_nationkey}"), iri("region/{r_regionkey}"), iri("supplier/{s_suppkey}")

mapped(
    "customer_triples",
    triples_map("C", source("customer"), subject("customer/{c_custkey}", "rml:class ex:Customer"), po("ex:name", ref("c_name")), po("ex:segment", ref("c_mktsegment"))),
    rows((_c, RDF_TYPE, p("Customer"), "customer"), (_c, p("name"), lit("c_name"), "customer"), (_c, p("segment"), lit("c_mktsegment"), "customer")),
)
mapped(
    "order_customer_edge",
    "\n".join((triples_map("O", source("orders"), subject("order/{o_orderkey}"), po("ex:customer", parent("C", "o_custkey", "c_custkey"))), triples_map("C", source("customer"), subject("customer/{c_custkey}")))),
    rows((_o, p("customer"), _c, "orders JOIN customer ON o_custkey = c_custkey")),
)
mapped(
    "nation_region_graph",
    triples_map("N", source("nation"), subject("nation/{n_nationkey}", 'rml:graphMap [ rml:template "http://ex.org/graph/{n_regionkey}" ]'), po("ex:label", ref("n_name"))),
    f"SELECT {_n} AS s, {p('label')} AS p, {lit('n_name')} AS o, {iri('graph/{n_regionkey}')} AS g FROM nation",
    graphs=True,
)
mapped(
    "join_two_conditions",
    "\n".join((triples_map("C", source("customer"), subject("customer/{c_custkey}"), po("ex:peer", 'rml:parentTriplesMap <#S> ; rml:joinCondition [ rml:child "c_custkey" ; rml:parent "s_suppkey" ] , [ rml:child "c_nationkey" ; rml:parent "s_nationkey" ]')), triples_map("S", source("supplier"), subject("supplier/{s_suppkey}")))),
    rows((_c, p("peer"), _s, "customer JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey")),
)
mapped(
    "join_non_key",
    "\n".join((triples_map("S", source("supplier"), subject("supplier/{s_suppkey}"), po("ex:neighbour", parent("T", "s_nationkey", "s_nationkey"))), triples_map("T", source("supplier"), subject("supplier/{s_suppkey}")))),
    rows((iri("supplier/{a.s_suppkey}"), p("neighbour"), iri("supplier/{b.s_suppkey}"), "supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")),
)
mapped(
    "typed_literals",
    triples_map("O", source("orders"), subject("order/{o_orderkey}"), po("ex:total", ref("o_totalprice", "xsd:double")), po("ex:date", ref("o_orderdate", "xsd:dateTime")), po("ex:key", ref("o_orderkey", "xsd:integer"))),
    rows((_o, p("total"), lit("o_totalprice", "double"), "orders"), (_o, p("date"), lit("strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')", "dateTime"), "orders"), (_o, p("key"), lit("o_orderkey", "integer"), "orders")),
)
mapped(
    "natural_datatypes",
    triples_map("P", source("part"), subject("part/{p_partkey}"), po("ex:size", ref("p_size")), po("ex:price", ref("p_retailprice")), po("ex:brand", ref("p_brand"))),
    rows((iri("part/{p_partkey}"), p("size"), lit("p_size", "integer"), "part"), (iri("part/{p_partkey}"), p("price"), lit("p_retailprice", "double"), "part"), (iri("part/{p_partkey}"), p("brand"), lit("p_brand"), "part")),
    infer_datatypes=True,
)
mapped(
    "language_map",
    triples_map("D", source("documents"), subject("document/{doc_id}"), po("ex:source", ref("source"), 'rml:languageMap [ rml:reference "lang" ]')),
    f"SELECT {iri('document/{doc_id}')} AS s, {p('source')} AS p, {lit('source')} || '@' || lower(lang) AS o FROM documents",
)
mapped(
    "long_text_literals",
    triples_map("D", source("documents"), subject("document/{doc_id}"), po("ex:text", ref("text"))),
    f"SELECT {iri('document/{doc_id}')} AS s, {p('text')} AS p, {lit('text')} AS o FROM documents WHERE text <> ''",
)
mapped(
    "blank_nodes",
    triples_map("E", source("events"), 'rml:subjectMap [ rml:template "event{event_id}" ; rml:termType rml:BlankNode ]', po("ex:type", ref("event_type")), po("ex:user", 'rml:template "http://ex.org/user/{user_id}"')),
    rows(("'_:event' || event_id", p("type"), lit("event_type"), "events"), ("'_:event' || event_id", p("user"), iri("user/{user_id}"), "events")),
)
mapped(
    "percent_encoding",
    triples_map("P", source("part"), subject("name/{p_name}/{p_type}"), po("ex:brand", 'rml:template "{p_brand} & {p_size}" ; rml:termType rml:Literal')),
    rows((iri("name/{p_name}/{p_type}"), p("brand"), lit("p_brand || ' & ' || p_size"), "part")),
)
mapped(
    "duplicate_subjects",
    triples_map("L", source("lineitem"), subject("line/{l_orderkey}/{l_linenumber}", "rml:class ex:Line"), po("ex:flag", ref("l_returnflag"))),
    rows((iri("line/{l_orderkey}/{l_linenumber}"), RDF_TYPE, p("Line"), "lineitem"), (iri("line/{l_orderkey}/{l_linenumber}"), p("flag"), lit("l_returnflag"), "lineitem")),
)
mapped(
    "predicate_template",
    triples_map("E", source("events"), subject("user/{user_id}"), 'rml:predicateObjectMap [ rml:predicateMap [ rml:template "http://ex.org/did/{event_type}" ] ; rml:objectMap [ rml:template "http://ex.org/event/{event_id}" ] ]'),
    rows((iri("user/{user_id}"), iri("did/{event_type}"), iri("event/{event_id}"), "events")),
)
mapped(
    "constants_and_na",
    triples_map("O", source("orders"), subject("order/{o_orderkey}"), po("ex:open", 'rml:constant "yes"'), po("ex:status", ref("o_orderstatus"))),
    rows((_o, p("open"), "'\"yes\"'", "orders"), (_o, p("status"), lit("o_orderstatus"), "orders WHERE o_orderstatus NOT IN ('F')")),
    na_values=("", "nan", "F"),
)
mapped(
    "shop_graph",
    SHOP,
    rows(
        (_c, RDF_TYPE, p("Customer"), "customer"), (_c, p("name"), lit("c_name"), "customer"), (_c, p("segment"), lit("c_mktsegment"), "customer"), (_c, p("balance"), lit("c_acctbal", "double"), "customer"), (_c, p("nation"), _n, "customer JOIN nation ON c_nationkey = n_nationkey"),
        (_n, RDF_TYPE, p("Nation"), "nation"), (_n, p("label"), lit("n_name"), "nation"), (_n, p("region"), _r, "nation JOIN region ON n_regionkey = r_regionkey"), (_r, RDF_TYPE, p("Region"), "region"), (_r, p("label"), lit("r_name"), "region"),
        (_o, RDF_TYPE, p("Order"), "orders"), (_o, p("status"), lit("o_orderstatus"), "orders"), (_o, p("total"), lit("o_totalprice", "double"), "orders"), (_o, p("priority"), lit("o_orderpriority"), "orders"), (_o, p("customer"), _c, "orders JOIN customer ON o_custkey = c_custkey"),
        (_s, RDF_TYPE, p("Supplier"), "supplier"), (_s, p("name"), lit("s_name"), "supplier"), (_s, p("nation"), _n, "supplier JOIN nation ON s_nationkey = n_nationkey"),
    ),
)
mapped(
    "quoted_same_row",
    "\n".join(("<#Q> a rml:NonAssertedTriplesMap .", triples_map("Q", source("orders"), subject("order/{o_orderkey}"), po("ex:status", ref("o_orderstatus"))), triples_map("T", source("orders"), "rml:subjectMap [ rml:quotedTriplesMap <#Q> ]", po("ex:on", ref("o_orderdate", "xsd:dateTime"))))),
    f"SELECT '<< ' || {_o} || ' ' || {p('status')} || ' ' || {lit('o_orderstatus')} || ' >>' AS s, {p('on')} AS p, {lit("strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')", 'dateTime')} AS o FROM orders",
)
mapped(
    "quoted_join",
    "\n".join(("<#Q> a rml:NonAssertedTriplesMap .", triples_map("Q", source("nation"), subject("nation/{n_nationkey}"), po("ex:label", ref("n_name"))), triples_map("T", source("customer"), subject("customer/{c_custkey}"), 'rml:predicateObjectMap [ rml:predicate ex:knows ; rml:objectMap [ rml:quotedTriplesMap <#Q> ; rml:joinCondition [ rml:child "c_nationkey" ; rml:parent "n_nationkey" ] ] ]'))),
    f"SELECT {_c} AS s, {p('knows')} AS p, '<< ' || {_n} || ' ' || {p('label')} || ' ' || {lit('n_name')} || ' >>' AS o FROM customer JOIN nation ON c_nationkey = n_nationkey",
)

# -- file formats: a table is written in the format, then mapped


def exported(spark: SparkSession, df: DataFrame, kind: str) -> str:
    """A folder with df in a format; in the shared folder where one is set."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        top = tempfile.mkdtemp(prefix="graphloom-")
    path = f"{top.rstrip('/')}/{uuid.uuid4().hex}.{kind}"
    if kind in ("csv", "tsv"):
        df.write.option("header", True).option("sep", "," if kind == "csv" else "\t").option("escape", '"').csv(path)
    elif kind == "orc":
        df.write.orc(path)
    elif kind == "json":
        df.agg(F.to_json(F.struct(F.collect_list(F.struct(*df.columns)).alias("rows"))).alias("value")).write.text(path)
    else:
        cells = F.concat(*(F.concat(F.lit(f"<{c}>"), F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit(f"</{c}>")) for c in df.columns[1:]))
        row = F.concat(F.lit(f'<row {df.columns[0]}="'), F.col(df.columns[0]).cast("string"), F.lit('">'), cells, F.lit("</row>"))
        df.agg(F.concat(F.lit("<rows>"), F.array_join(F.collect_list(row), ""), F.lit("</rows>")).alias("value")).write.text(path)
    return path


def from_format(kind: str, table: str, key: str, column: str, attributes: str = "", at: str = "") -> None:
    mapping = triples_map("F", f'rml:logicalSource [ rml:source "@OUT@" {attributes} ]', subject(f"{table}/{{{at}{key}}}"), po("ex:label", ref(column)))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = exported(spark, spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, column), kind)
        return graph(spark, sf_dir, mapping.replace("@OUT@", path)).quads().select("s", "p", "o")

    QUERIES[f"source_{kind}"] = query
    ORACLES[f"source_{kind}"] = f"SELECT DISTINCT {iri(f'{table}/{{{key}}}')} AS s, {p('label')} AS p, {lit(column)} AS o FROM {table} WHERE {column} <> ''"


from_format("csv", "documents", "doc_id", "text")
from_format("tsv", "customer", "c_custkey", "c_name")
from_format("orc", "orders", "o_orderkey", "o_orderpriority")
from_format("json", "nation", "n_nationkey", "n_name", '; rml:referenceFormulation rml:JSONPath ; rml:iterator "$.rows[*]"')
from_format("xml", "nation", "n_nationkey", "n_name", '; rml:referenceFormulation rml:XPath ; rml:iterator "/rows/row"', "@")

# -- SQL views

mapped("view_groupby", triples_map("V", view("SELECT l_returnflag, count(*) AS n, sum(l_linenumber) AS t FROM <<lineitem>> GROUP BY l_returnflag"), subject("flag/{l_returnflag}"), po("ex:n", ref("n", "xsd:integer")), po("ex:t", ref("t", "xsd:integer"))), "WITH v AS (SELECT l_returnflag, count(*) AS n, sum(l_linenumber) AS t FROM lineitem GROUP BY 1) " + rows((iri("flag/{l_returnflag}"), p("n"), lit("n", "integer"), "v"), (iri("flag/{l_returnflag}"), p("t"), lit("t", "integer"), "v")))
mapped("view_window_rank", triples_map("V", view("SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM <<orders>>) WHERE k <= 3"), subject("customer/{o_custkey}"), po("ex:top", 'rml:template "http://ex.org/order/{o_orderkey}/{k}"')), rows((iri("customer/{o_custkey}"), p("top"), iri("order/{o_orderkey}/{k}"), "(SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3)")))
mapped("view_rollup", triples_map("V", view("SELECT coalesce(l_returnflag, 'all') AS f, coalesce(l_linestatus, 'all') AS t, count(*) AS n FROM <<lineitem>> GROUP BY ROLLUP (l_returnflag, l_linestatus)"), subject("cell/{f}/{t}"), po("ex:n", ref("n", "xsd:integer"))), rows((iri("cell/{f}/{t}"), p("n"), lit("n", "integer"), "(SELECT coalesce(l_returnflag, 'all') AS f, coalesce(l_linestatus, 'all') AS t, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus))")))
mapped("view_case_join", triples_map("V", view('SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN \'debtor\' ELSE \'creditor\' END AS "kind", n_name FROM <<supplier>>, <<nation>> WHERE s_nationkey = n_nationkey'), subject("supplier/{s_suppkey}", ), po("ex:kind", ref("kind")), po("ex:in", ref("n_name"))), rows((_s, p("kind"), lit("CASE WHEN s_acctbal < 0 THEN 'debtor' ELSE 'creditor' END"), "supplier JOIN nation ON s_nationkey = n_nationkey"), (_s, p("in"), lit("n_name"), "supplier JOIN nation ON s_nationkey = n_nationkey")))
mapped("view_json_props", triples_map("V", view("SELECT event_id, json_extract_string(props, '$.k') AS k FROM <<events>>"), subject("event/{event_id}"), po("ex:k", ref("k", "xsd:integer"))), rows((iri("event/{event_id}"), p("k"), lit("json_extract_string(props, '$.k')", "integer"), "events")))

# -- functions


def call(function: str, *inputs: tuple[str, str]) -> str:
    given = " , ".join(f"[ rml:parameter {'' if ':' in n else 'grel:'}{n} ; {value} ]" for n, value in inputs)
    return f"[ rml:function {function}" + (f" ; rml:input {given} ]" if inputs else " ]")


def column(name: str) -> str:
    return f'rml:inputValueMap [ rml:reference "{name}" ]'


def const(text: str) -> str:
    return f'rml:inputValue "{text}"'


def nested(c: str) -> str:
    return f"rml:inputValueMap [ rml:functionExecution {c} ]"


def functions(name: str, table: str, key: str, cases: dict[str, tuple[str, str]]) -> None:
    """One rule a case: a call, and the SQL of its text."""
    mapping = triples_map("F", source(table), subject(f"{table}/{{{key}}}"), *(po(f"ex:{c}", f"rml:functionExecution {x}") for c, (x, _) in cases.items()))
    mapped(name, mapping, rows(*((iri(f"{table}/{{{key}}}"), p(c), lit(sql), f"{table} WHERE ({sql}) IS NOT NULL AND CAST(({sql}) AS VARCHAR) <> ''") for c, (_, sql) in cases.items())))


def fn1(function: str, parameter: str, col: str, *more: tuple[str, str]) -> str:
    return call(function, (parameter, column(col)), *more)


def _explode(sql: str, table: str, key: str, name: str) -> str:
    return f"SELECT {iri(f'{table}/{{{key}}}')} AS s, {p(name)} AS p, {lit('x')} AS o FROM (SELECT {key}, unnest({sql}) AS x FROM {table}) WHERE x <> ''"


V = "valueParameter"
functions("fn_strings", "part", "p_partkey", {
    "upper": (fn1("grel:toUpperCase", V, "p_name"), "upper(p_name)"),
    "lower": (fn1("grel:toLowerCase", V, "p_type"), "lower(p_type)"),
    "title": (fn1("grel:string_toTitlecase", V, "p_brand"), "upper(p_brand[1]) || lower(p_brand[2:])"),
    "length": (fn1("grel:string_length", V, "p_name"), "length(p_name)"),
    "reverse": (fn1("grel:reverse", V, "p_name"), "reverse(p_name)"),
    "contains": (fn1("grel:string_contains", V, "p_name", ("string_sub", const("1"))), "CASE WHEN contains(p_name, '1') THEN 'true' ELSE 'false' END"),
    "starts": (fn1("grel:string_startsWith", V, "p_brand", ("string_sub", const("Brand"))), "CASE WHEN starts_with(p_brand, 'Brand') THEN 'true' ELSE 'false' END"),
    "ends": (fn1("grel:string_endsWith", V, "p_brand", ("string_sub", const("3"))), "CASE WHEN ends_with(p_brand, '3') THEN 'true' ELSE 'false' END"),
    "index": (fn1("grel:string_indexOf", V, "p_name", ("string_sub", const("a"))), "instr(p_name, 'a') - 1"),
    "last": (fn1("grel:string_lastIndexOf", V, "p_name", ("string_sub", const("a"))), "CASE WHEN contains(p_name, 'a') THEN length(p_name) - instr(reverse(p_name), 'a') ELSE -1 END"),
    "replace": (fn1("grel:string_replace", V, "p_brand", ("p_string_find", const("Brand")), ("p_string_replace", const("Mark"))), "replace(p_brand, 'Brand', 'Mark')"),
    "sub": (fn1("grel:string_substring", V, "p_name", ("param_int_i_from", const("1")), ("param_int_i_opt_to", const("4"))), "p_name[2:4]"),
    "chomp": (fn1("grel:string_chomp", V, "p_brand", ("p_string_sep", const("1"))), "CASE WHEN ends_with(p_brand, '1') THEN left(p_brand, length(p_brand) - 1) ELSE p_brand END"),
    "concat": (call("fx:concat", ("valueParameter1", column("p_brand")), ("valueParameter2", column("p_type")), ("p_string_sep", const("/"))), "p_brand || '/' || p_type"),
    "md5": (fn1("grel:string_md5", V, "p_name"), "md5(p_name)"),
    "sha1": (fn1("grel:string_sha1", V, "p_name"), "sha1(p_name)"),
    "sha256": (fn1("fx:hash", V, "p_name"), "sha256(p_name)"),
    "nested": (call("grel:toUpperCase", (V, nested(fn1("grel:string_replace", V, "p_brand", ("p_string_find", const("r")), ("p_string_replace", const("-")))))), "upper(replace(p_brand, 'r', '-'))"),
})
functions("fn_maths", "part", "p_partkey", {
    "abs": (fn1("grel:math_abs", "p_dec_n", "p_size"), "abs(p_size)"),
    "floor": (fn1("grel:math_floor", "p_dec_n", "p_retailprice"), "CAST(floor(p_retailprice) AS BIGINT)"),
    "ceil": (fn1("grel:math_ceil", "p_dec_n", "p_retailprice"), "CAST(ceil(p_retailprice) AS BIGINT)"),
    "even": (fn1("grel:math_even", "p_dec_n", "p_size"), "CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END"),
    "odd": (fn1("grel:math_odd", "p_dec_n", "p_size"), "CASE WHEN p_size % 2 = 1 THEN 'true' ELSE 'false' END"),
    "mod": (call("grel:math_mod", ("p_int_i", column("p_partkey")), ("p_int_i2", const("7"))), "p_partkey % 7"),
    "gcd": (call("grel:math_gcd", ("p_int_i", column("p_partkey")), ("p_int_i2", column("p_size"))), "gcd(p_partkey, p_size)"),
    "lcm": (call("grel:math_lcm", ("p_int_i", column("p_partkey")), ("p_int_i2", column("p_size"))), "lcm(p_partkey, p_size)"),
    "max": (call("grel:math_max", ("p_dec_n", column("p_size")), ("param_n2", const("20"))), "greatest(p_size, 20)"),
    "min": (call("grel:math_min", ("p_dec_n", column("p_size")), ("param_n2", const("20"))), "least(p_size, 20)"),
    "quotient": (call("grel:math_quotient", ("p_dec_n", column("p_partkey")), ("param_n2", const("3"))), "p_partkey // 3"),
    "combin": (call("grel:math_combin", ("p_int_i", column("p_size")), ("p_int_i2", const("2"))), "p_size * (p_size - 1) // 2"),
    "fact": (call("grel:math_fact", ("p_int_i", nested(call("grel:math_mod", ("p_int_i", column("p_size")), ("p_int_i2", const("15")))))), "CAST(factorial(p_size % 15) AS BIGINT)"),
    "pow": (call("grel:math_pow", ("p_dec_n", column("p_size")), ("p_any_exp", const("2"))), "CAST(p_size * p_size AS DOUBLE)"),
})
functions("fn_dates", "orders", "o_orderkey", {
    "year": (call("grel:date_datePart", ("p_date_d", column("o_orderdate")), ("p_string_unit", const("years"))), "year(o_orderdate)"),
    "month": (call("grel:date_datePart", ("p_date_d", column("o_orderdate")), ("p_string_unit", const("months"))), "month(o_orderdate)"),
    "weekday": (call("grel:date_datePart", ("p_date_d", column("o_orderdate")), ("p_string_unit", const("weekday"))), "dayname(o_orderdate)"),
    "week": (call("grel:date_datePart", ("p_date_d", column("o_orderdate")), ("p_string_unit", const("week"))), "(day(o_orderdate) - 1) // 7 + 1"),
    "later": (call("grel:date_inc", ("p_date_d", column("o_orderdate")), ("p_dec_n", const("3")), ("p_string_unit", const("days"))), "strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d %H:%M:%S')"),
    "age": (call("grel:date_diff", ("p_datetime_d", column("o_orderdate")), ("p_datetime_d2", const("2000-01-01T00:00:00")), ("p_string_timeunit", const("days"))), "abs(epoch(o_orderdate) - epoch(TIMESTAMP '2000-01-01')) // 86400"),
    "iso": (call("grel:date_toDate", (V, column("o_orderdate")), ("p_string_pattern", const("yyyy-MM-dd HH:mm:ss"))), "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"),
    "strptime": (call("fx:date_toDate", (V, column("o_orderdate")), ("p_string_pattern", const("%Y-%m-%d %H:%M:%S"))), "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"),
})
ORACLES["fn_dates"] = ORACLES["fn_dates"].replace("abs(epoch(o_orderdate) - epoch(TIMESTAMP '2000-01-01')) // 86400", "CAST(floor(abs(epoch(o_orderdate) - epoch(TIMESTAMP '2000-01-01')) / 86400) AS BIGINT)")
_words = call("grel:string_split", (V, column("p_name")), ("p_string_sep", const(" ")))
functions("fn_arrays", "part", "p_partkey", {
    "first": (call("grel:array_get", ("p_array_a", nested(_words)), ("param_int_i_from", const("0"))), "string_split(p_name, ' ')[1]"),
    "final": (call("grel:array_get", ("p_array_a", nested(_words)), ("param_int_i_from", const("-1"))), "string_split(p_name, ' ')[-1]"),
    "size": (call("grel:array_length", ("p_array_a", nested(_words))), "len(string_split(p_name, ' '))"),
    "joined": (call("grel:array_join", ("p_array_a", nested(call("grel:array_reverse", ("p_array_a", nested(_words))))), ("p_string_sep", const("-"))), "array_to_string(list_reverse(string_split(p_name, ' ')), '-')"),
    "sorted": (call("grel:array_join", ("p_array_a", nested(call("grel:array_sort", ("p_array_a", nested(_words))))), ("p_string_sep", const("+"))), "array_to_string(list_sort(string_split(p_name, ' ')), '+')"),
})
functions("fn_controls", "customer", "c_custkey", {
    "rich": (call("grel:controls_if", ("bool_b", 'rml:inputValueMap [ rml:template "{c_acctbal} > 5000" ]'), ("any_true", const("rich")), ("any_false", const("poor"))), "CASE WHEN c_acctbal > 5000 THEN 'rich' ELSE 'poor' END"),
    "cast": (call("fx:controls_if_cast", ("bool_b", nested(call("grel:string_contains", (V, column("c_name")), ("string_sub", const("7"))))), ("any_true", column("c_name"))), "CASE WHEN contains(c_name, '7') THEN c_name END"),
    "both": (call("grel:boolean_and", ("param_rep_b", nested(call("grel:string_contains", (V, column("c_name")), ("string_sub", const("1"))))), ("param_rep_b", nested(call("grel:string_contains", (V, column("c_name")), ("string_sub", const("2")))))), "CASE WHEN contains(c_name, '1') AND contains(c_name, '2') THEN 'true' ELSE 'false' END"),
    "known": (call("fx:other_coalesce", ("p_any_rep_e", const("")), ("p_any_rep_e", column("c_mktsegment"))), "c_mktsegment"),
})
mapped("fn_split_explode", triples_map("F", source("part"), subject("part/{p_partkey}"), po("ex:word", "rml:functionExecution " + call("fx:string_split_explode", (V, column("p_name")), ("p_string_sep", const(" "))))), _explode("string_split(p_name, ' ')", "part", "p_partkey", "word"))
mapped("fn_subject", triples_map("F", source("nation"), f"rml:subjectMap [ rml:functionExecution {call('fx:hash_iri', (V, column('n_name')))} ; rml:termType rml:IRI ]", po("ex:label", ref("n_name"))), f"SELECT '<http://example.com/ns#' || sha256(n_name) || '>' AS s, {p('label')} AS p, {lit('n_name')} AS o FROM nation")

# -- graph queries

asked("sparql_order_customer_nation", SHOP, "SELECT ?o ?c ?l WHERE { ?o ex:customer ?c . ?c ex:nation ?n . ?n ex:label ?l }", f"SELECT {_o} AS o, {_c} AS c, {lit('n_name')} AS l FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
asked("sparql_star_scan", SHOP, 'SELECT ?c ?n ?b WHERE { ?c a ex:Customer ; ex:name ?n ; ex:balance ?b ; ex:segment "BUILDING" }', f"SELECT {_c} AS c, {lit('c_name')} AS n, {lit('c_acctbal', 'double')} AS b FROM customer WHERE c_mktsegment = 'BUILDING'")
asked("sparql_constant_iri", SHOP, "SELECT ?p ?v WHERE { <http://ex.org/customer/17> ?p ?v }", f"SELECT p, v FROM (SELECT {RDF_TYPE} AS p, {p('Customer')} AS v, c_custkey AS k FROM customer UNION ALL SELECT {p('name')}, {lit('c_name')}, c_custkey FROM customer UNION ALL SELECT {p('segment')}, {lit('c_mktsegment')}, c_custkey FROM customer UNION ALL SELECT {p('balance')}, {lit('c_acctbal', 'double')}, c_custkey FROM customer UNION ALL SELECT {p('nation')}, {_n}, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE k = 17")
asked("sparql_filter", SHOP, 'SELECT ?o ?t WHERE { ?o ex:total ?t ; ex:status ?s FILTER(?t > 100000 && (?s = "O" || ?s IN ("P", "X")) && !(?t >= 300000)) }', f"SELECT {_o} AS o, {lit('o_totalprice', 'double')} AS t FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('O', 'P', 'X') AND o_totalprice < 300000")
asked("sparql_string_filter", SHOP, 'SELECT ?n WHERE { ?c ex:name ?n . ?c a ex:Customer FILTER(CONTAINS(?n, "11") && REGEX(?n, "1$") && STRSTARTS(STR(?c), "http://ex.org/customer/")) }', f"SELECT {lit('c_name')} AS n FROM customer WHERE contains(c_name, '11') AND c_name LIKE '%1'")
asked("sparql_optional", SHOP, "SELECT ?c ?o WHERE { ?c a ex:Customer OPTIONAL { ?o ex:customer ?c ; ex:total ?t FILTER(?t > 200000) } }", f"SELECT {_c} AS c, CASE WHEN o_orderkey IS NOT NULL THEN {_o} END AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000")
asked("sparql_union", SHOP, "SELECT ?x ?n WHERE { { ?x a ex:Customer ; ex:name ?n } UNION { ?x a ex:Supplier ; ex:name ?n } }", f"SELECT {_c} AS x, {lit('c_name')} AS n FROM customer UNION ALL SELECT {_s}, {lit('s_name')} FROM supplier")
asked("sparql_minus", SHOP, 'SELECT ?c WHERE { ?c a ex:Customer MINUS { ?o ex:customer ?c ; ex:status "F" } }', f"SELECT {_c} AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
asked("sparql_not_exists", SHOP, "SELECT ?c WHERE { ?c a ex:Customer FILTER NOT EXISTS { ?o ex:customer ?c } }", f"SELECT {_c} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
asked("sparql_exists", SHOP, "SELECT ?n WHERE { ?n a ex:Nation FILTER EXISTS { ?s ex:nation ?n . ?s a ex:Supplier } }", f"SELECT {_n} AS n FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
asked("sparql_values", SHOP, 'SELECT ?c ?s WHERE { VALUES ?s { "BUILDING" "MACHINERY" } ?c ex:segment ?s }', f"SELECT {_c} AS c, {lit('c_mktsegment')} AS s FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
asked("sparql_bind", SHOP, 'SELECT ?o ?k ?u WHERE { ?o ex:total ?t ; ex:priority ?p BIND(IF(?t > 150000, "big", "small") AS ?k) BIND(CONCAT(LCASE(?p), "!") AS ?u) }', f"SELECT {_o} AS o, CASE WHEN o_totalprice > 150000 THEN '\"big\"' ELSE '\"small\"' END AS k, {lit("lower(o_orderpriority) || '!'")} AS u FROM orders")
asked("sparql_group", SHOP, "SELECT ?l (COUNT(?c) AS ?n) WHERE { ?c ex:nation ?x . ?c a ex:Customer . ?x ex:label ?l } GROUP BY ?l HAVING (COUNT(?c) > 3)", f"SELECT {lit('n_name')} AS l, {lit('count(*)', 'integer')} AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 3")
asked("sparql_min_max", SHOP, "SELECT ?s (MIN(?t) AS ?a) (MAX(?t) AS ?b) (COUNT(DISTINCT ?p) AS ?k) WHERE { ?o ex:status ?s ; ex:total ?t ; ex:priority ?p } GROUP BY ?s", f"SELECT {lit('o_orderstatus')} AS s, {lit('min(o_totalprice)', 'double')} AS a, {lit('max(o_totalprice)', 'double')} AS b, {lit('count(DISTINCT o_orderpriority)', 'integer')} AS k FROM orders GROUP BY o_orderstatus")
asked("sparql_group_concat", SHOP, 'SELECT ?r (GROUP_CONCAT(?l; SEPARATOR="|") AS ?all) WHERE { ?n ex:region ?r . ?n ex:label ?l } GROUP BY ?r', f"SELECT {_r} AS r, {lit("string_agg(n_name, '|' ORDER BY n_name)")} AS \"all\" FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
asked("sparql_top_k", SHOP, "SELECT ?o ?t WHERE { ?o ex:total ?t } ORDER BY DESC(?t) ?o LIMIT 20 OFFSET 5", f"SELECT {_o} AS o, {lit('o_totalprice', 'double')} AS t FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, {_o} LIMIT 20 OFFSET 5)")
asked("sparql_distinct", SHOP, "SELECT DISTINCT ?s ?p WHERE { ?o ex:status ?s ; ex:priority ?p }", f"SELECT DISTINCT {lit('o_orderstatus')} AS s, {lit('o_orderpriority')} AS p FROM orders")
asked("sparql_subselect", SHOP, "SELECT ?n ?k WHERE { ?c ex:name ?n { SELECT ?c (COUNT(?o) AS ?k) WHERE { ?o ex:customer ?c } GROUP BY ?c } FILTER(?k > 12) }", f"SELECT {lit('c_name')} AS n, {lit('k', 'integer')} AS k FROM (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1 HAVING count(*) > 12) JOIN customer ON o_custkey = c_custkey")
asked("sparql_path_sequence", SHOP, "SELECT ?o ?r WHERE { ?o ex:customer/ex:nation/ex:region ?r }", f"SELECT {_o} AS o, {_r} AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
asked("sparql_path_alternative", SHOP, "SELECT ?x ?l WHERE { ?x (ex:label|ex:name) ?l . ?x a ex:Nation }", f"SELECT {_n} AS x, {lit('n_name')} AS l FROM nation")
asked("sparql_path_inverse", SHOP, "SELECT ?n ?s WHERE { ?n ^ex:nation ?s . ?s a ex:Supplier }", f"SELECT {_n} AS n, {_s} AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey")
asked("sparql_path_plus", SHOP, "SELECT DISTINCT ?s ?x WHERE { ?s (ex:nation|ex:region)+ ?x . ?s a ex:Supplier }", f"SELECT {_s} AS s, {_n} AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT {_s}, {_r} FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
asked("sparql_construct", SHOP, "CONSTRUCT { ?n ex:home ?c } WHERE { ?c ex:nation ?n . ?c a ex:Customer }", f"SELECT {_n} AS s, {p('home')} AS p, {_c} AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
asked("sparql_describe", SHOP, "DESCRIBE <http://ex.org/nation/3>", f"SELECT {_n} AS s, {RDF_TYPE} AS p, {p('Nation')} AS o FROM nation WHERE n_nationkey = 3 UNION ALL SELECT {_n}, {p('label')}, {lit('n_name')} FROM nation WHERE n_nationkey = 3 UNION ALL SELECT {_n}, {p('region')}, {_r} FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 3")
asked("sparql_ask", SHOP, 'ASK { ?c ex:segment "BUILDING" }', "SELECT count(*) > 0 AS ask FROM customer WHERE c_mktsegment = 'BUILDING'")
asked("sparql_variable_predicate", SHOP, "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o . ?s a ex:Order } GROUP BY ?p", f"SELECT p, {lit('count(*)', 'integer')} AS n FROM (SELECT {p('status')} AS p FROM orders UNION ALL SELECT {p('total')} FROM orders UNION ALL SELECT {p('priority')} FROM orders UNION ALL SELECT {RDF_TYPE} FROM orders UNION ALL SELECT {p('customer')} FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY p")
asked("sparql_named_graph", triples_map("N", source("nation"), subject("nation/{n_nationkey}", 'rml:graphMap [ rml:template "http://ex.org/graph/{n_regionkey}" ]'), po("ex:label", ref("n_name"))), "SELECT ?g ?l WHERE { GRAPH ?g { ?n ex:label ?l } }", f"SELECT {iri('graph/{n_regionkey}')} AS g, {lit('n_name')} AS l FROM nation")


# -- exact values, bases, literals in views

_big = triples_map("B", view("SELECT o_orderkey, o_orderstatus, 9007199254740992 + o_orderkey AS b FROM <<orders>>"), subject("order/{o_orderkey}"), po("ex:big", ref("b", "xsd:integer")), po("ex:status", ref("o_orderstatus")))
asked("sparql_exact_sum", _big, "SELECT ?s (SUM(?b) AS ?all) (MAX(?b) AS ?top) WHERE { ?o ex:big ?b ; ex:status ?s } GROUP BY ?s", f"SELECT {lit('o_orderstatus')} AS s, {lit('sum(9007199254740992 + o_orderkey)', 'integer')} AS \"all\", {lit('max(9007199254740992 + o_orderkey)', 'integer')} AS top FROM orders GROUP BY o_orderstatus")
asked("sparql_exact_filter", _big, "SELECT ?o ?c WHERE { ?o ex:big ?b FILTER(?b = 9007199254740993 || ?b = 9007199254740994) BIND(?b + 1 AS ?c) }", f"SELECT {_o} AS o, {lit('9007199254740993 + o_orderkey', 'integer')} AS c FROM orders WHERE o_orderkey IN (1, 2)")
_tenths = triples_map("D", view("SELECT n_nationkey, concat('0.', n_nationkey) AS d FROM <<nation>>"), subject("nation/{n_nationkey}"), po("ex:d", ref("d", "xsd:decimal")))
_tenth = "CAST('0.' || n_nationkey AS DECIMAL(10, 2))"


def _decimal(sql: str) -> str:
    return lit(f"regexp_replace(CAST({sql} AS VARCHAR), '([.][0-9]+?)0+$', '\\1')", "decimal")


asked("sparql_decimals", _tenths, "SELECT ?n (?d + 0.2 AS ?e) (?d * 3 AS ?m) WHERE { ?n ex:d ?d FILTER(?d + 0.1 != 0.3) }", f"SELECT {_n} AS n, {_decimal(f'{_tenth} + 0.2')} AS e, {_decimal(f'{_tenth} * 3')} AS m FROM nation WHERE {_tenth} <> 0.2")
asked("sparql_decimal_sum", _tenths, "SELECT (SUM(?d) AS ?s) (SUM(DISTINCT ?d) AS ?u) WHERE { ?n ex:d ?d }", f"SELECT {_decimal(f'sum({_tenth})')} AS s, {_decimal(f'sum(DISTINCT {_tenth})')} AS u FROM nation")
asked("sparql_instants", triples_map("T", view("SELECT n_nationkey, concat('2020-01-02T0', n_nationkey % 3, ':00:00', CASE WHEN n_nationkey % 2 = 0 THEN 'Z' ELSE '-05:00' END) AS t FROM <<nation>>"), subject("nation/{n_nationkey}"), po("ex:at", ref("t", "xsd:dateTime"))), 'SELECT ?n WHERE { ?n ex:at ?t FILTER(?t > "2020-01-02T01:00:00Z"^^xsd:dateTime && ?t <= "2020-01-02T06:00:00Z"^^xsd:dateTime) }', f"SELECT {_n} AS n FROM nation WHERE n_nationkey % 3 + 5 * (n_nationkey % 2) > 1 AND n_nationkey % 3 + 5 * (n_nationkey % 2) <= 6")
_relative = "\n".join((triples_map("R", source("nation"), 'rml:subjectMap [ rml:template "n/{n_nationkey}" ]', po("ex:label", ref("n_name"))), triples_map("A", source("nation"), 'rml:subjectMap [ rml:template "http://ex.org/map/n/{n_nationkey}" ]', po("ex:label", ref("n_name")), po("ex:of", ref("n_regionkey", "xsd:integer")))))
asked("sparql_relative_base", _relative, "SELECT ?x ?l ?r WHERE { ?x ex:label ?l . ?x ex:of ?r }", f"SELECT {iri('map/n/{n_nationkey}')} AS x, {lit('n_name')} AS l, {lit('n_regionkey', 'integer')} AS r FROM nation")
mapped("relative_base", _relative, rows((iri("map/n/{n_nationkey}"), p("label"), lit("n_name"), "nation"), (iri("map/n/{n_nationkey}"), p("of"), lit("n_regionkey", "integer"), "nation")))
asked("sparql_path_not_inverse", SHOP, "SELECT ?x ?y WHERE { ?x !(^ex:nation) ?y . ?x a ex:Region }", f"SELECT {_r} AS x, {_n} AS y FROM nation JOIN region ON n_regionkey = r_regionkey")
asked("sparql_join_after_optional", SHOP, "SELECT ?n ?m ?r WHERE { ?n a ex:Nation OPTIONAL { ?n ex:region ?r FILTER(?r = <http://ex.org/region/1>) } ?m ex:region ?r }", f"SELECT {iri('nation/{a}')} AS n, {iri('nation/{b}')} AS m, {iri('region/{r}')} AS r FROM (SELECT x.n_nationkey AS a, y.n_nationkey AS b, y.n_regionkey AS r FROM nation x, nation y WHERE x.n_regionkey <> 1 OR y.n_regionkey = 1)")
mapped("view_literals", triples_map("V", view("SELECT n_nationkey, 'say \"hi\", it''s from ''a.csv''' AS v FROM <<nation>> WHERE n_name <> 'x \"y\"'"), subject("nation/{n_nationkey}"), po("ex:v", ref("v"))), rows((_n, p("v"), lit("'say \"hi\", it''s from ''a.csv'''"), "nation")))

# -- the other functions


def rounded(function: str, *inputs: tuple[str, str]) -> str:
    """The whole degrees of a function's result: its digits, but not the last bits in which libraries differ."""
    return call("grel:math_round", ("p_dec_n", nested(call("grel:math_degrees", ("p_dec_n", nested(call(f"grel:math_{function}", *inputs)))))))


_m = nested(call("grel:math_mod", ("p_int_i", column("p_size")), ("p_int_i2", const("5"))))
_deg = "CAST(round_even(degrees({}), 0) AS BIGINT)"
functions("fn_trigonometry", "part", "p_partkey", {
    f: (rounded(f, ("p_dec_n", column("p_size"))), _deg.format(f"{f}(CAST(p_size AS DOUBLE))")) for f in ("sin", "cos", "tan", "tanh", "atan")
} | {"atan2": (rounded("atan2", ("p_dec_n", column("p_size")), ("param_n2", const("3"))), _deg.format("atan2(CAST(p_size AS DOUBLE), 3)"))})
functions("fn_inverses", "part", "p_partkey", {
    f: (rounded(f, ("p_dec_n", nested(call("grel:math_sin", ("p_dec_n", column("p_size")))))), _deg.format(f"{f}(sin(CAST(p_size AS DOUBLE)))")) for f in ("asin", "acos")
} | {f: (rounded(f, ("p_dec_n", _m)), _deg.format(f"{f}(CAST(p_size % 5 AS DOUBLE))")) for f in ("sinh", "cosh", "exp", "radians")})
functions("fn_logarithms", "part", "p_partkey", {
    "ln": (rounded("ln", ("p_dec_n", column("p_size"))), _deg.format("ln(CAST(p_size AS DOUBLE))")),
    "log": (rounded("log", ("p_dec_n", column("p_size"))), _deg.format("log10(CAST(p_size AS DOUBLE))")),
    "round": (fn1("grel:math_round", "p_dec_n", "p_retailprice"), "CAST(round_even(p_retailprice, 0) AS BIGINT)"),
    "factn": (call("grel:math_factn", ("p_int_i", _m), ("p_int_i2", const("8"))), "CASE WHEN p_size % 5 = 0 THEN 0 ELSE CAST(factorial(7) / factorial(p_size % 5 - 1) AS BIGINT) END"),
    "multinomial": (call("grel:math_multinomial", ("p_array_a", nested(call("grel:string_split", (V, nested(call("fx:concat", ("valueParameter1", _m), ("valueParameter2", const("2")), ("p_string_sep", const(" "))))), ("p_string_sep", const(" ")))))), "(p_size % 5 + 1) * (p_size % 5 + 2) // 2"),
    "random": (call("grel:math_randomNumber", ("p_int_i", const("3")), ("p_int_i2", const("3"))), "CAST(3 AS DOUBLE)"),
})
_pair = nested(call("grel:string_split", (V, nested(call("fx:concat", ("valueParameter1", column("p_size")), ("valueParameter2", column("p_partkey")), ("p_string_sep", const(" "))))), ("p_string_sep", const(" "))))


def joined(c: str) -> str:
    return call("grel:array_join", ("p_array_a", nested(c)), ("p_string_sep", const("|")))


functions("fn_lists", "part", "p_partkey", {
    "sum": (call("grel:array_sum", ("p_array_a", _pair)), "p_size + p_partkey"),
    "slice": (joined(call("grel:array_slice", ("p_array_a", nested(_words)), ("param_int_i_from", const("0")), ("param_int_i_opt_to", const("-1")))), "array_to_string(string_split(p_name, ' ')[1:len(string_split(p_name, ' ')) - 1], '|')"),
    "uniques": (call("grel:array_length", ("p_array_a", nested(call("grel:array_uniques", ("p_array_a", nested(_words)))))), "len(list_distinct(string_split(p_name, ' ')))"),
    "codes": (joined(fn1("grel:unicodestring-s", V, "p_brand")), "array_to_string([unicode(x) for x in string_split(p_brand, '')], '|')"),
    "lengths": (joined(fn1("grel:string_splitByLengths", V, "p_brand", ("p_int_i", const("2")), ("p_int_i2", const("3")), ("p_rep_i", const("1")))), "p_brand[1:2] || '|' || p_brand[3:5] || '|' || p_brand[6:6]"),
    "smart": (joined(fn1("grel:string_smartSplit", V, "p_name", ("p_opt_sep", const(" ")))), "replace(p_name, ' ', '|')"),
})
functions("fn_pieces", "part", "p_partkey", {
    "types": (joined(fn1("grel:string_splitByCharType", V, "p_brand")), "array_to_string(regexp_extract_all(p_brand, '[A-Z]+|[a-z]+|\\s|[0-9]'), '|')"),
    "partition": (joined(fn1("grel:string_partition", V, "p_brand", ("p_fragment", const("#")))), "replace(p_brand, '#', '|#|')"),
    "rpartition": (joined(fn1("grel:string_rpartition", V, "p_brand", ("p_fragment", const("#")), ("p_bool_opt_b", const("true")))), "replace(p_brand, '#', '|')"),
    "match": (joined(fn1("grel:string_match", V, "p_name", ("p_string_regex", const("[aeiou]")))), "array_to_string(regexp_extract_all(p_name, '[aeiou]'), '|')"),
    "chars": (fn1("grel:string_replaceChars", V, "p_name", ("p_string_find", const("e")), ("p_string_replace", const("3"))), "replace(p_name, 'e', '3')"),
    "trim": (call("grel:string_trim", (V, nested(call("fx:concat", ("valueParameter1", const(" ")), ("valueParameter2", column("p_name")), ("p_string_sep", const(" ")))))), "p_name"),
})
_marked = nested(call("fx:concat", ("valueParameter1", column("p_brand")), ("valueParameter2", const("<a&b>")), ("p_string_sep", const(" "))))
functions("fn_texts", "part", "p_partkey", {
    "html": (call("grel:escape", (V, _marked), ("modeParameter", const("html"))), "p_brand || ' &lt;a&amp;b&gt;'"),
    "url": (call("grel:escape", (V, _marked), ("modeParameter", const("url"))), "replace(p_brand, '#', '%23') || '%20%3Ca%26b%3E'"),
    "plain": (call("grel:string_unescape", (V, nested(call("grel:escape", (V, _marked), ("modeParameter", const("xml"))))), ("modeParameter", const("xml"))), "p_brand || ' <a&b>'"),
    "number": (fn1("grel:string_toNumber", "p_any_e", "p_size"), "CAST(p_size AS DOUBLE)"),
    "text": (fn1("grel:string_toString", "p_any_e", "p_size"), "p_size"),
    "diff": (call("grel:string_diff", (V, const("Brand")), ("valueParameter2", column("p_brand"))), "p_brand[6:]"),
    "type": (fn1("grel:other_type", "p_any_e", "p_name"), "'str'"),
    "uuid": (call("grel:string_length", (V, nested(call("fx:uuid")))), "36"),
    "now": (call("grel:string_length", (V, nested(call("grel:string_substring", (V, nested(call("grel:date_now"))), ("param_int_i_from", const("0")), ("param_int_i_opt_to", const("10")))))), "10"),
})
_has = {x: nested(call("grel:string_contains", (V, column("c_name")), ("string_sub", const(x)))) for x in "123"}
functions("fn_booleans", "customer", "c_custkey", {
    "either": (call("grel:boolean_or", *(("param_rep_b", _has[x]) for x in "12")), "CASE WHEN contains(c_name, '1') OR contains(c_name, '2') THEN 'true' ELSE 'false' END"),
    "odd": (call("grel:boolean_xor", *(("param_rep_b", _has[x]) for x in "123")), "CASE WHEN (CAST(contains(c_name, '1') AS INT) + CAST(contains(c_name, '2') AS INT) + CAST(contains(c_name, '3') AS INT)) % 2 = 1 THEN 'true' ELSE 'false' END"),
    "none": (call("grel:boolean_not", ("bool_b", _has["1"])), "CASE WHEN contains(c_name, '1') THEN 'false' ELSE 'true' END"),
    "shout": (call("<http://example.com/idlab/function/toUpperCaseURL>", ("<http://example.com/idlab/function/str>", column("c_name"))), "'http://' || replace(upper(c_name), '#', '%23')"),
})
