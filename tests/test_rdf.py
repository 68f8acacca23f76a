"""The same small ontology in three syntaxes, and the odd corners of each."""

import os
import subprocess
import sys

import pytest

from tallyweave.sources import files, rdf

XML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:oboInOwl="http://www.geneontology.org/formats/oboInOwl#" xmlns:obo="http://purl.obolibrary.org/obo/">
<owl:Class rdf:about="http://purl.obolibrary.org/obo/X_1"><rdfs:label>one "1"</rdfs:label><oboInOwl:hasExactSynonym>uno</oboInOwl:hasExactSynonym><oboInOwl:hasExactSynonym>eins; a.b</oboInOwl:hasExactSynonym><rdfs:subClassOf rdf:resource="http://purl.obolibrary.org/obo/X_0"/><obo:IAO_0000115>first # of all</obo:IAO_0000115></owl:Class>
<owl:Class rdf:about="http://purl.obolibrary.org/obo/X_2"><rdfs:label>two</rdfs:label><owl:deprecated>true</owl:deprecated></owl:Class>
</rdf:RDF>"""
TURTLE = '''@prefix : <http://purl.obolibrary.org/obo/> .
PREFIX owl: <http://www.w3.org/2002/07/owl#>
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . # a comment with a . in it
@prefix o: <http://www.geneontology.org/formats/oboInOwl#>.
:X_1 a owl:Class ; rdfs:label "one \\"1\\""@en , "later" ;
  o:hasExactSynonym "uno", """eins; a.b""" ;;
  rdfs:subClassOf :X_0 , [ a owl:Restriction ; owl:onProperty :R ; owl:someValuesFrom ( :X_3 "x" 4.5 ) ] ;
  :IAO_0000115 'first # of all' .
[] a owl:Class ; rdfs:label "no address" .
@base <http://purl.obolibrary.org/obo/> .
<X_2> a owl:Class . <X_2> rdfs:label "two"; owl:deprecated true .
:X_9 rdfs:label "not a class" .
'''
O = "http://purl.obolibrary.org/obo/"
NT = f'''# a comment
<{O}X_1> <{rdf.NAMESPACES["rdf"]}type> <{rdf.NAMESPACES["owl"]}Class> .
<{O}X_1> <{rdf.NAMESPACES["rdfs"]}label> "one \\"1\\""@en .

<{O}X_2> <{rdf.NAMESPACES["rdf"]}type> <{rdf.NAMESPACES["owl"]}Class> . # another
<{O}X_1> <{rdf.NAMESPACES["oboInOwl"]}hasExactSynonym> "uno" .
<{O}X_1> <{rdf.NAMESPACES["oboInOwl"]}hasExactSynonym> "eins; a.b"^^<{rdf.NAMESPACES["xsd"]}string> .
<{O}X_1> <{rdf.NAMESPACES["rdfs"]}subClassOf> <{O}X_0> .
<{O}X_1> <{rdf.NAMESPACES["rdfs"]}subClassOf> _:b1 .
_:b1 <{rdf.NAMESPACES["rdf"]}type> <{rdf.NAMESPACES["owl"]}Class> .
<{O}X_1> <{O}IAO_0000115> "first # of all" .
<{O}X_2> <{rdf.NAMESPACES["rdfs"]}label> "two" .
<{O}X_2> <{rdf.NAMESPACES["owl"]}deprecated> "true"^^<{rdf.NAMESPACES["xsd"]}boolean> .
'''


@pytest.mark.parametrize("obsolete", [False, True])
def test_three_syntaxes_give_equal_rows(spark, tmp_path, obsolete):
    for name, body in (("a.owl", XML), ("a.ttl", TURTLE), ("a.nt", NT)):
        (tmp_path / name).write_text(body)
    rows = lambda df: sorted(map(tuple, df.select("id", "label", "synonyms", "definition", "parents", "obsolete").collect()))
    want = rows(files.owl_records(spark, str(tmp_path / "a.owl"), include_obsolete=obsolete))
    assert len(want) == 1 + obsolete and want[0][:2] == ("X:1", 'one "1"')
    for syntax, name in (("turtle", "a.ttl"), ("nt", "a.nt")):
        assert rows(rdf.rdf_records(spark, str(tmp_path / name), syntax, include_obsolete=obsolete)) == want
    assert rdf.rdf_records(spark, str(tmp_path / "a.nt"), "nt", id_prefix="Y:").count() == 0


def test_escapes(spark, tmp_path):
    texts = {'a\\"b': 'a"b', "tab\\tnew\\nend": "tab\tnew\nend", "\\u00e9\\U0001F600\\U000000e9": "é😀é", "\\\\u0041 \\\\\\\\": "\\u0041 \\\\", "it\\'s": "it's", "raw é 😀": "raw é 😀", "": "", "\\\\U0001F600": "\\U0001F600", "end\\\\": "end\\"}
    (tmp_path / "e.nt").write_text("".join(f'<s> <p{i}> "{t}" .\n' for i, t in enumerate(texts)))
    (tmp_path / "e.ttl").write_text("".join(f'<s> <p{i}> "{t}" .\n' for i, t in enumerate(texts)))
    for reader, name in ((rdf.n_triples, "e.nt"), (rdf.turtle, "e.ttl")):
        got = {r.predicate: r.object for r in reader(spark, str(tmp_path / name)).collect()}
        assert got == {f"p{i}": t for i, t in enumerate(texts.values())}


def test_faults_fail_the_read(spark, tmp_path):
    for name, body in (("a.nt", "<s> <p> .\n"), ("b.ttl", "x:a x:b x:c ."), ("c.ttl", "<s> <p> <o>"), ("d.ttl", "<s> <p> ~ .")):
        (tmp_path / name).write_text(body)
        with pytest.raises(Exception, match="not a triple|KeyError|no end|not Turtle"):
            (rdf.n_triples if name.endswith("nt") else rdf.turtle)(spark, str(tmp_path / name)).collect()
    with pytest.raises(ValueError, match="unknown syntax"):
        rdf.rdf_records(spark, "x", "n3")
    (tmp_path / "empty.ttl").write_text("")
    (tmp_path / "empty.nt").write_text("\n")
    assert rdf.turtle(spark, str(tmp_path / "empty.ttl")).count() == 0 == rdf.n_triples(spark, str(tmp_path / "empty.nt")).count()


def test_statements_of_many_groups_keep_their_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rdf, "STATEMENTS", 3)
    head = "@prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
    (tmp_path / "m.ttl").write_text(head + "".join(f'<http://x/obo/A_{i % 10}> a owl:Class ; rdfs:label "n{99 - i}" .\n' for i in range(40)))
    got = {r.id: r.label for r in rdf.rdf_records(spark, str(tmp_path / "m.ttl"), "turtle").collect()}
    assert got == {f"A:{i}": f"n{99 - i}" for i in range(10)}


CUT = '''@prefix
 e: # <no> .
 <http://e/>
.
PREFIX
f:
<http://f/>
e:a e:p """one. \\"""
@prefix e: <http://no/> .
two ''' + "'''" + ''' PREFIX e: <http://no/>
.""" , f:b.c # """
;
  e:q [ e:r ( 1.5
"x. y" ) ] .
@prefix e: <http://g/> . e:a e:p "last"@prefix
.
'''


@pytest.mark.parametrize("piece", [1, 30, 1 << 20])
def test_turtle_is_read_whole_wherever_it_is_cut(spark, tmp_path, piece):
    (tmp_path / "a.ttl").write_text(CUT)
    (tmp_path / "b.ttl").write_text("<http://x> <http://y> 'z' .")
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(held, ("120", "1"), strict=True):
            spark.conf.set(k, v)
        rows = rdf.turtle(spark, str(tmp_path), piece).orderBy("place").collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    names = {}
    name = lambda x: names.setdefault(x, f"_:{len(names)}") if x.startswith("_:") else x
    got = [(name(r.subject), r.predicate, name(r.object), r.is_iri) for r in rows]
    text = "one. \"\"\"\n@prefix e: <http://no/> .\ntwo ''' PREFIX e: <http://no/>\n."
    R = rdf.NAMESPACES["rdf"]
    assert got[:3] == [("http://e/a", "http://e/p", text, False), ("http://e/a", "http://e/p", "http://f/b.c", True), ("http://e/a", "http://e/q", "_:0", False)]
    assert sorted((p, o) for s, p, o, _ in got[3:8] if not o.startswith("_:")) == [(R + "first", "1.5"), (R + "first", "x. y"), (R + "rest", R + "nil")]
    assert got[8:] == [("http://g/a", "http://g/p", "last", False), ("http://x", "http://y", "z", False)]


def test_no_task_holds_a_whole_turtle_file(tmp_path):
    """200 MB, nearly all of it comments, read by a JVM with 512 MB of heap."""
    with (tmp_path / "a.ttl").open("w") as out:
        out.write("@prefix e: <http://e/> .\n")
        for i in range(200):
            out.write(("# " + "c" * 997 + "\n") * 1000 + f"e:s e:p {i} .\n")
    body = f"""
from pyspark.sql import SparkSession
from tallyweave.sources import rdf
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.memory", "512m").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).config("spark.local.dir", {str(tmp_path / "local")!r}).getOrCreate()
print("numbers", rdf.turtle(s, {str(tmp_path / "a.ttl")!r}).selectExpr("sum(cast(object as int)) as n").first().n)
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", body], env=env, capture_output=True, text=True, timeout=300)
    assert f"numbers {sum(range(200))}" in done.stdout, done.stderr[-2000:]
