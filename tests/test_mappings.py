"""Mappings end to end: fixtures of our own, results as sets of statements."""

import json
import sqlite3

import pytest

from graphloom.api import KnowledgeGraph, materialize_set, translate_to_rml
from graphloom.model import MappingError, Source
from graphloom.sources import SourceError

HEAD = """@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix rml: <http://w3id.org/rml/> . @prefix ql: <http://semweb.mmlab.be/ns/ql#> .
@prefix ex: <http://ex/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix sd: <https://w3id.org/okn/o/sd#> . @base <http://base/> .
"""


def made(spark, mapping, root="", **options):
    return materialize_set(KnowledgeGraph.from_mapping(spark, HEAD + mapping, root=str(root), **options))


@pytest.fixture
def people(spark):
    spark.createDataFrame([(1, "Ann", 10.5, True, None), (2, "Bob \"B\"", 1e7, False, 1), (2, "Bob \"B\"", 1e7, False, 1), (3, "", 1e-5, None, 9)], "id int, name string, pay double, ok boolean, boss int").createOrReplaceTempView("people")


def test_terms(spark, people):
    got = made(spark, '<#P> rr:logicalTable [ rr:tableName "people" ] ; rr:subjectMap [ rr:template "http://ex/p/{id}" ; rr:class ex:P ] ; rr:predicateObjectMap [ rr:predicate ex:name ; rr:objectMap [ rr:column "name" ] ] , [ rr:predicate ex:pay ; rr:objectMap [ rr:column "pay" ; rr:datatype xsd:double ] ] , [ rr:predicate ex:ok ; rr:objectMap [ rr:column "ok" ; rr:datatype xsd:boolean ] ] .')
    d, b = "^^<http://www.w3.org/2001/XMLSchema#double>", "^^<http://www.w3.org/2001/XMLSchema#boolean>"
    rdf = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://ex/P>"
    assert got == {f"<http://ex/p/{i}> {rdf}" for i in (1, 2, 3)} | {
        '<http://ex/p/1> <http://ex/name> "Ann"', '<http://ex/p/2> <http://ex/name> "Bob \\"B\\""',
        f'<http://ex/p/1> <http://ex/pay> "10.5"{d}', f'<http://ex/p/2> <http://ex/pay> "10000000.0"{d}', f'<http://ex/p/3> <http://ex/pay> "1e-05"{d}',
        f'<http://ex/p/1> <http://ex/ok> "true"{b}', f'<http://ex/p/2> <http://ex/ok> "false"{b}',
    }


def test_joins_and_graphs(spark, people):
    got = made(spark, '<#P> rr:logicalTable [ rr:tableName "people" ] ; rr:subjectMap [ rr:template "http://ex/p/{id}" ; rr:graph ex:g ] ; rr:predicateObjectMap [ rr:predicate ex:boss ; rr:objectMap [ rr:parentTriplesMap <#P> ; rr:joinCondition [ rr:child "boss" ; rr:parent "id" ] ] ] .')
    assert got == {"<http://ex/p/2> <http://ex/boss> <http://ex/p/1> <http://ex/g>"}


def test_blank_nodes_languages_base(spark):
    spark.createDataFrame([("a b", "EN-gb", "rel/x"), ("c", None, "http://abs/y"), ("d", "fr", "not an iri")], "v string, l string, u string").createOrReplaceTempView("t_lang")
    got = made(spark, '<#L> rr:logicalTable [ rr:tableName "t_lang" ] ; rr:subjectMap [ rr:column "v" ; rr:termType rr:BlankNode ] ; rr:predicateObjectMap [ rr:predicate ex:v ; rr:objectMap [ rr:column "v" ; rml:languageMap [ rml:reference "l" ] ] ] , [ rr:predicate ex:u ; rr:objectMap [ rr:column "u" ; rr:termType rr:IRI ] ] .')
    assert got == {'_:a%20b <http://ex/v> "a b"@en-gb', '_:d <http://ex/v> "d"@fr', "_:a%20b <http://ex/u> <http://base/rel/x>", "_:c <http://ex/u> <http://abs/y>"}


def test_quoted_triples(spark, people):
    got = made(spark, '<#Q> a rml:NonAssertedTriplesMap ; rml:logicalSource [ rml:tableName "people" ] ; rml:subjectMap [ rml:template "http://ex/p/{id}" ] ; rml:predicateObjectMap [ rml:predicate ex:name ; rml:objectMap [ rml:reference "name" ] ] . <#T> rml:logicalSource [ rml:tableName "people" ] ; rml:subjectMap [ rml:quotedTriplesMap <#Q> ; rml:joinCondition [ rml:child "boss" ; rml:parent "id" ] ] ; rml:predicateObjectMap [ rml:predicate ex:by ; rml:objectMap [ rml:template "http://ex/p/{id}" ] ] .')
    assert got == {'<< <http://ex/p/1> <http://ex/name> "Ann" >> <http://ex/by> <http://ex/p/2>'}


def test_self_join_is_not_an_identity_on_other_columns(spark):
    spark.createDataFrame([(1, "x"), (2, "x")], "id int, k string").createOrReplaceTempView("t_self")
    got = made(spark, '<#A> rr:logicalTable [ rr:tableName "t_self" ] ; rr:subjectMap [ rr:template "http://ex/{id}" ] ; rr:predicateObjectMap [ rr:predicate ex:k ; rr:objectMap [ rr:parentTriplesMap <#A> ; rr:joinCondition [ rr:child "k" ; rr:parent "k" ] ] ] .')
    assert len(got) == 4


def mapping_of(source, subject="http://ex/{id}", ref="name"):
    return f'<#M> rml:logicalSource [ {source} ] ; rml:subjectMap [ rml:template "{subject}" ] ; rml:predicateObjectMap [ rml:predicate ex:n ; rml:objectMap [ rml:reference "{ref}" ] ] .'


WANT = {'<http://ex/1> <http://ex/n> "Ann, A"', '<http://ex/2> <http://ex/n> "Bé"'}


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"Ann, A"\n2,Bé\n3,\n')
    (tmp_path / "b.csv").write_text('id;name\n1;"Ann, A"\n2;Bé\n')
    (tmp_path / "c.tsv").write_text("id\tname\n1\tAnn, A\n2\tBé\n")
    for f in ("a.csv", "b.csv", "c.tsv"):
        assert made(spark, mapping_of(f'rml:source "{f}"'), tmp_path) == WANT
    with pytest.raises(SourceError):
        made(spark, mapping_of('rml:source "a.csv"', ref="nosuch"), tmp_path)


def test_column_files(spark, tmp_path):
    import pandas as pd

    frame = pd.DataFrame({"id": [1, 2], "name": ["Ann, A", "Bé"]})
    frame.to_parquet(tmp_path / "a.parquet")
    frame.to_feather(tmp_path / "a.feather")
    frame.assign(name=["Ann, A", "Be"]).to_stata(tmp_path / "a.dta", write_index=False)
    spark.createDataFrame(frame).write.orc(str(tmp_path / "a.orc"))
    for f in ("a.parquet", "a.feather", "a.orc"):
        assert made(spark, mapping_of(f'rml:source "{f}"'), tmp_path) == WANT
    assert len(made(spark, mapping_of('rml:source "a.dta"'), tmp_path)) == 2


def test_json(spark, tmp_path):
    doc = {"people": [{"id": 1, "name": "Ann, A", "tags": ["x", "y"], "in": {"city": "P"}}, {"id": 2, "name": "Bé"}, {"id": 3, "name": None}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    src = 'rml:source "a.json" ; rml:referenceFormulation ql:JSONPath ; rml:iterator "$.people[*]"'
    assert made(spark, mapping_of(src), tmp_path) == WANT
    assert made(spark, mapping_of(src, ref="tags"), tmp_path) == {'<http://ex/1> <http://ex/n> "x"', '<http://ex/1> <http://ex/n> "y"'}
    assert made(spark, mapping_of(src, ref="in.city"), tmp_path) == {'<http://ex/1> <http://ex/n> "P"'}
    assert made(spark, mapping_of(src.replace("$.people[*]", "$..people[?(@.id > 1)]")), tmp_path) == {'<http://ex/2> <http://ex/n> "Bé"'}
    assert made(spark, mapping_of('rml:source [ sd:name "d" ] ; rml:iterator "$.people[*]"'), memory={"d": doc}) == WANT


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<r xmlns:k="urn:k"><p id="1"><name>Ann, A</name><k:x v="7"/></p><p id="2"><name>Bé</name></p><p id="3"/></r>')
    src = 'rml:source "a.xml" ; rml:referenceFormulation ql:XPath ; rml:iterator "/r/p"'
    assert made(spark, mapping_of(src, "http://ex/{@id}"), tmp_path) == WANT
    assert made(spark, mapping_of(src, "http://ex/{@id}", "k:x@v"), tmp_path) == {'<http://ex/1> <http://ex/n> "7"'}
    assert made(spark, mapping_of(src.replace("/r/p", "//p[@id='2']"), "http://ex/{@id}"), tmp_path) == {'<http://ex/2> <http://ex/n> "Bé"'}


def test_memory_and_views(spark, tmp_path):
    import pandas as pd

    frame = pd.DataFrame({"id": [1, 2], "name": ["Ann, A", "Bé"]})
    src = 'rml:source [ sd:name "f" ]'
    for x in (frame, spark.createDataFrame(frame), [(1, "Ann, A"), (2, "Bé")]):
        assert made(spark, mapping_of(src), memory={"f": x}) == WANT
    (tmp_path / "a.csv").write_text('id,name\n1,"Ann, A"\n2,Bé\n')
    (tmp_path / "b.csv").write_text("k,v\n1,one\n1,uno\n")
    sql = "SELECT \\\"id\\\", count(*) AS n FROM 'a.csv' JOIN 'b.csv' ON id = k GROUP BY id"
    assert made(spark, mapping_of(f'rml:query "{sql}" ; rml:referenceFormulation rml:SQL2008', ref="n"), tmp_path) == {'<http://ex/1> <http://ex/n> "2"'}


def test_spreadsheets_and_geometry(spark, tmp_path):
    import struct
    import zipfile

    from graphloom.sources.geometry import to_wkt

    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>1</v></c><c r="B2" t="inlineStr"><is><t>Ann, A</t></is></c></row><row><c r="A3"><v>2</v></c><c r="B3" t="inlineStr"><is><t>Bé</t></is></c></row></sheetData></worksheet>'
    strings = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>id</t></si><si><t>name</t></si></sst>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", strings)
    assert made(spark, mapping_of('rml:source "a.xlsx"'), tmp_path) == WANT
    t, x = "urn:oasis:names:tc:opendocument:xmlns:table:1.0", "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
    cells = "".join("<t:table-row>" + "".join(f"<t:table-cell><x:p>{v}</x:p></t:table-cell>" for v in r) + "</t:table-row>" for r in (("id", "name"), ("1", "Ann, A"), ("2", "Bé")))
    with zipfile.ZipFile(tmp_path / "a.ods", "w") as z:
        z.writestr("content.xml", f'<d xmlns:t="{t}" xmlns:x="{x}"><t:table>{cells}</t:table></d>')
    assert made(spark, mapping_of('rml:source "a.ods"'), tmp_path) == WANT
    assert to_wkt(struct.pack("<BI2d", 1, 1, 1.0, 2.5)) == "POINT (1 2.5)"
    assert to_wkt(struct.pack(">BII4d", 0, 2, 2, 0, 0, 1, 1)) == "LINESTRING (0 0, 1 1)"


def test_sqlite_and_config(spark, tmp_path):
    with sqlite3.connect(tmp_path / "d.db") as c:
        c.execute("CREATE TABLE t (ID INTEGER, name TEXT)")
        c.executemany("INSERT INTO t VALUES (?, ?)", [(1, "Ann, A"), (2, "Bé"), (3, None)])
    (tmp_path / "m.ttl").write_text(HEAD + mapping_of('rml:tableName "t"'))
    kg = KnowledgeGraph.from_config(spark, f"[CONFIGURATION]\nna_values=,nan\noutput_format=N-QUADS\n[D]\nmappings={tmp_path}/m.ttl\ndb_url=sqlite:///{tmp_path}/d.db\n")
    assert materialize_set(kg) == WANT
    out = kg.write(str(tmp_path / "out"), single_file=True)
    assert {line[:-2] for line in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")).splitlines()} == WANT and out
    with pytest.raises(MappingError):
        KnowledgeGraph.from_config(spark, "[CONFIGURATION]\noutput_format=TURTLE\n")


YARRRML = """
prefixes:
  ex: http://ex/
mappings:
  person:
    sources:
      - [people.csv~csv]
    s: http://ex/$(id)
    po:
      - [a, ex:Person]
      - [ex:name, $(name), en~lang]
      - [ex:age, $(age), xsd:integer]
      - [ex:page, http://site/$(name)~iri]
      - p: ex:boss
        o:
          mapping: person
          condition:
            function: equal
            parameters: [[str1, $(boss)], [str2, $(id)]]
      - p: ex:shout
        o:
          function: grel:toUpperCase
          parameters: [[grel:valueParameter, $(name)]]
"""


def test_yarrrml(spark, tmp_path):
    (tmp_path / "people.csv").write_text("id,name,age,boss\n1,Ann,30,\n2,Bob,40,1\n")
    (tmp_path / "m.yml").write_text(YARRRML)
    got = materialize_set(KnowledgeGraph.from_mapping(spark, YARRRML, root=str(tmp_path), yarrrml=True))
    assert '<http://ex/1> <http://ex/name> "Ann"@en' in got and '<http://ex/2> <http://ex/boss> <http://ex/1>' in got
    assert '<http://ex/2> <http://ex/shout> "BOB"' in got and "<http://ex/1> <http://ex/page> <http://site/Ann>" in got
    assert len(got) == 11
    assert "logicalSource" in translate_to_rml(str(tmp_path / "m.yml"))


@pytest.mark.parametrize("bad", [
    'rml:subjectMap [ rml:constant "x" ]', 'rml:subjectMap [ rml:template "http://ex/{id" ]', 'rml:subjectMap [ rml:template "a" ] , [ rml:template "b" ]',
    'rml:subjectMap [ rml:template "http://ex/{id}" ] ; rml:predicateObjectMap [ rml:predicate "p" ; rml:object ex:o ]',
    'rml:subjectMap [ rml:template "http://ex/{id}" ] ; rml:predicateObjectMap [ rml:predicate ex:p ]',
    'rml:subjectMap [ rml:template "http://ex/{id}" ] ; rml:predicateObjectMap [ rml:predicate ex:p ; rml:objectMap [ rml:reference "n" ; rml:language "not a tag" ] ]',
    'rml:subjectMap [ rml:template "http://ex/{id}" ; rml:graph "g" ] ; rml:predicateObjectMap [ rml:predicate ex:p ; rml:object ex:o ]',
])
def test_invalid_mappings(spark, bad):
    with pytest.raises(MappingError):
        KnowledgeGraph.from_mapping(spark, HEAD + f'<#M> rml:logicalSource [ rml:source "x.csv" ] ; {bad} .')


def test_udf(spark, tmp_path):
    from graphloom.functions.registry import load_udfs

    (tmp_path / "udf.py").write_text('@udf(fun_id="http://ex/twice", text="http://ex/p/value")\ndef twice(text):\n    return text * 2\n')
    load_udfs(str(tmp_path / "udf.py"))
    got = made(spark, '<#M> rml:logicalSource [ rml:source [ sd:name "f" ] ] ; rml:subjectMap [ rml:template "http://ex/{id}" ] ; rml:predicateObjectMap [ rml:predicate ex:n ; rml:objectMap [ rml:functionExecution [ rml:function ex:twice ; rml:input [ rml:parameter <http://ex/p/value> ; rml:inputValueMap [ rml:reference "name" ] ] ] ] ] .', memory={"f": [("1", "ab"), ("2", None)]})
    assert '<http://ex/1> <http://ex/n> "abab"' in got


def test_streaming(spark, tmp_path):
    from graphloom.streaming import quads_of_stream

    spark.createDataFrame([(1, "Ann, A"), (2, "Bé")], "id int, name string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, name string").parquet(str(tmp_path / "in"))
    kg = KnowledgeGraph.from_mapping(spark, HEAD + mapping_of('rml:source [ sd:name "f" ]'), memory={"f": stream})
    q = quads_of_stream(kg).writeStream.format("memory").queryName("stream_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {f"{r.s} {r.p} {r.o}" for r in spark.table("stream_out").collect()} == WANT


def test_partitions_are_disjoint(spark, people):
    kg = KnowledgeGraph.from_mapping(spark, HEAD + '<#P> rr:logicalTable [ rr:tableName "people" ] ; rr:subjectMap [ rr:template "http://ex/p/{id}" ; rr:class ex:P ] ; rr:predicateObjectMap [ rr:predicate ex:name ; rr:objectMap [ rr:column "name" ] ] , [ rr:predicate ex:name ; rr:objectMap [ rr:column "boss" ] ] .')
    from graphloom.plans.partition import disjoint_groups

    assert sorted(map(len, disjoint_groups(kg.rules).values())) == [1, 2]
    assert kg.engine.grouped(kg.rules).select("s", "p", "o", "g").exceptAll(kg.engine.materialize(kg.rules)).count() == 0


def test_optional_joins_have_keys_and_keep_solutions(spark):
    """Joins, MINUS and EXISTS on a variable that may be unbound, against nested loops over solutions."""
    rows = [(1, "a", None, "b"), (2, None, "a", None), (3, "b", "b", "a"), (4, None, None, "c"), (5, "c", "a", None)]
    spark.createDataFrame(rows, "id int, a string, b string, c string").createOrReplaceTempView("t_opt")
    kg = KnowledgeGraph.from_mapping(spark, HEAD + '<#A> rr:logicalTable [ rr:tableName "t_opt" ] ; rr:subjectMap [ rr:template "http://ex/{id}" ; rr:class ex:T ] ; ' + " ; ".join(f'rr:predicateObjectMap [ rr:predicate ex:{c} ; rr:objectMap [ rr:column "{c}" ] ]' for c in "abc") + " .", keys={"t_opt": ("id",)})

    def bound(name, i, v):
        return {name: f"<http://ex/{i}>"} | ({"v": f'"{v}"'} if v else {})

    a, b, c = [bound("x", r[0], r[1]) for r in rows], [bound("y", r[0], r[2]) for r in rows if r[2]], [bound("z", r[0], r[3]) for r in rows]

    def agree(p, q):
        return all(p[k] == q[k] for k in p if k in q)

    def join(p, q):
        return [x | y for x in p for y in q if agree(x, y)]

    def left(p, q):
        return [m for x in p for m in ([x | y for y in q if agree(x, y)] or [x])]

    A, C = "?x a ex:T OPTIONAL { ?x ex:a ?v }", "{ ?z a ex:T OPTIONAL { ?z ex:c ?v } }"
    for names, pattern, want in (
        ("xyv", f"{A} ?y ex:b ?v", join(a, b)),
        ("xzv", f"{{ {A} }} {C}", join(a, c)),
        ("xyv", f"{A} OPTIONAL {{ ?y ex:b ?v }}", left(a, b)),
        ("yzv", f"?y ex:b ?v OPTIONAL {C}", left(b, c)),
        ("xzv", f"{A} OPTIONAL {C}", left(a, c)),
        ("xv", f"{A} MINUS {{ ?y ex:b ?v }}", [p for p in a if not any(agree(p, q) and p.keys() & q.keys() for q in b)]),
        ("xv", f"{A} FILTER EXISTS {{ ?y ex:b ?v }}", [p for p in a if any(agree(p, q) for q in b)]),
        ("xv", f"{A} FILTER NOT EXISTS {{ ?y ex:b ?v }}", [p for p in a if not any(agree(p, q) for q in b)]),
    ):
        got = kg.sparql(f"PREFIX ex: <http://ex/> SELECT {' '.join('?' + n for n in names)} WHERE {{ {pattern} }}")
        assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(repr(tuple(p.get(n) for n in names)) for p in want), pattern


def test_csv_is_split_unless_a_record_spans_lines(spark, tmp_path):
    (tmp_path / "plain.csv").write_text('id,"a name"\n' + "".join(f'{i},"n {i}"\n' for i in range(4000)))
    (tmp_path / "lines.csv").write_text('id,"a name"\n1,"two\nlines"\n2,"say ""hi"""\n')
    from graphloom.sources import Sources

    sources = Sources(spark, root=str(tmp_path))
    assert not sources.records_span_lines(f"{tmp_path}/plain.csv") and sources.records_span_lines(f"{tmp_path}/lines.csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = sources.read_csv(Source("csv", "plain.csv"), ["id"])
        assert df.rdd.getNumPartitions() > 1 and df.count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {tuple(r) for r in sources.read_csv(Source("csv", "lines.csv"), []).collect()} == {("1", "two\nlines"), ("2", 'say "hi"')}


def test_templates_that_a_row_can_make_absolute_keep_their_answers(spark):
    spark.createDataFrame([("ab", 1), ("x", 2)], "k string, n int").createOrReplaceTempView("t_rel")
    m = '<#A> rr:logicalTable [ rr:tableName "t_rel" ] ; rr:subjectMap [ rr:template "{k}:z" ] ; rr:predicateObjectMap [ rr:predicate ex:n ; rr:objectMap [ rr:column "n" ] ] . <#B> rr:logicalTable [ rr:tableName "t_rel" ] ; rr:subjectMap [ rr:template "{k}/z" ] ; rr:predicateObjectMap [ rr:predicate ex:m ; rr:objectMap [ rr:column "n" ] ] .'
    assert made(spark, m) == {'<ab:z> <http://ex/n> "1"', '<x:z> <http://ex/n> "2"', '<http://base/ab/z> <http://ex/m> "1"', '<http://base/x/z> <http://ex/m> "2"'}
    kg = KnowledgeGraph.from_mapping(spark, HEAD + m)
    assert [r[0] for r in kg.sparql("SELECT ?n WHERE { <ab:z> <http://ex/n> ?n }").collect()] == ['"1"']
    assert [r[0] for r in kg.sparql("SELECT ?n WHERE { <http://base/x/z> <http://ex/m> ?n }").collect()] == ['"2"']


def test_paths_from_a_constant_end(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 4), (6, 6)]
    spark.createDataFrame(edges, "a int, b int").createOrReplaceTempView("t_path")
    kg = KnowledgeGraph.from_mapping(spark, HEAD + '<#A> rr:logicalTable [ rr:tableName "t_path" ] ; rr:subjectMap [ rr:template "http://ex/{a}" ] ; rr:predicateObjectMap [ rr:predicate ex:to ; rr:objectMap [ rr:template "http://ex/{b}" ] ] .')

    def asked(pattern):
        return sorted(r[0][len("<http://ex/"):-1] for r in kg.sparql(f"PREFIX ex: <http://ex/> SELECT ?x WHERE {{ {pattern} }}").collect())

    assert asked("<http://ex/1> ex:to+ ?x") == ["1", "2", "3", "4"]
    assert asked("<http://ex/5> ex:to* ?x") == ["4", "5"]
    assert asked("?x ex:to+ <http://ex/4>") == ["1", "2", "3", "5"]
    assert asked("?x ex:to* <http://ex/6>") == ["6"]
    assert asked("<http://ex/4> ex:to+ ?x") == []
