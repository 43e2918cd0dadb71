import pytest

from weftgraph.graph import Graph
from weftgraph.operators import dictionary, index, signature, update
from weftgraph.plans.compile import query
from weftgraph.service import Catalog, parse_command, run_command
from weftgraph.sources import sinks, turtle
from weftgraph.streaming.intake import answer_stream

TRIPLES = "s string, p string, o string"
TTL = """@prefix e: <http://e/> .
@base <http://b/> .
e:a e:p "x\\ty" , 'z'@en ; a <T> .
this is broken e:x .
e:a e:q [ e:r 5 ] , ( "1" true ) .
[ e:s e:a ] .
_:n e:p "5"^^<http://www.w3.org/2001/XMLSchema#integer> ; .   # comment
e:b e:p \"\"\"long "quoted"
text\"\"\" .
"""


def test_turtle(spark):
    p = turtle.TurtleParser()
    got = list(p.parse(TTL))
    assert got[:3] == [("<http://e/a>", "<http://e/p>", '"x\ty"'), ("<http://e/a>", "<http://e/p>", '"z"@en'), ("<http://e/a>", f"<{turtle.RDF}type>", "<http://b/T>")]
    assert ("<_:_1>", "<http://e/r>", '"5"') in got and ("<_:n>", "<http://e/p>", '"5"') in got
    assert sum(x[1] == f"<{turtle.RDF}first>" for x in got) == 2 and sum(x[1] == f"<{turtle.RDF}rest>" for x in got) == 2
    assert got[-1][2] == '"long "quoted"\ntext"'
    assert len(p.errors) == 1 and "line 4" in p.errors[0]
    # prefixes stay for the next text
    assert list(p.parse("e:a e:p e:b .")) == [("<http://e/a>", "<http://e/p>", "<http://e/b>")]


def test_ntriples(spark):
    lines = ["<a> <p> <b> .", '<a> <p> "t\\"q\\\\n"@en .  # c', "_:x <p> _:y .", "broken", "# comment", "", '<a> <p> "\\u00e9" .', '<a> <p> "5"^^<int> .']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = sorted(tuple(r) for r in turtle.ntriples(df).collect())
    assert got == sorted([("<a>", "<p>", "<b>"), ("<a>", "<p>", '"t"q\\n"@en'), ("<_:x>", "<p>", "<_:y>"), ("<a>", "<p>", '"é"'), ("<a>", "<p>", '"5"')])
    assert [r.value for r in turtle.corrupt(df).collect()] == ["broken"]


@pytest.fixture
def triples(spark):
    return spark.createDataFrame([("<a>", "<p>", "<b>"), ("<a>", "<p>", '"t"'), ("<b>", "<q>", "<a>")], TRIPLES)


def test_save_load_append(spark, triples, tmp_path):
    path = str(tmp_path / "g")
    Graph.of_triples(triples).save(path)
    g = Graph.load(spark, path)
    assert g.names == {"<p>", "<q>"} and query(g, "SELECT * { ?x <p> ?y }").count() == 2
    assert query(g, "SELECT * { ?x <zzz> ?y }").count() == 0
    update.append(path, spark.createDataFrame([("<a>", "<p>", "<b>"), ("<c>", "<r>", "<a>")], TRIPLES))
    assert Graph.load(spark, path).stored.count() == 4


def test_update(triples, spark):
    new = spark.createDataFrame([("<a>", "<p>", "<b>"), ("<n>", "<p>", "<b>"), ("<n>", "<p>", "<b>")], TRIPLES)
    assert update.insert(triples, new).count() == 4
    assert update.remove(triples, new).count() == 2


def test_index_and_lists(triples, spark):
    assert [r.o for r in index.lookup(triples, "sp2o", "<a>", "<p>").collect()] == ['"t"', "<b>"]
    assert index.lookup(triples, "s2o", "<zz>").count() == 0
    assert {r.term: r.degree for r in index.degree(triples).collect()} == {"<a>": 3, "<b>": 2, '"t"': 1}
    assert index.exists(triples, "<b>", "<q>", "<a>") and not index.exists(triples, "<b>", "<q>", "<b>")
    df = spark.createDataFrame([([1, 3, 5], [3, 4, 5])], "a array<int>, b array<int>")
    got = df.select(index.intersect("a", "b"), index.union("a", "b"), index.member("a", 3), index.position("a", 9), index.insert("a", 4), index.insert("a", 3), index.remove("a", 3), index.erase_from("a", 1)).first()
    assert tuple(got) == ([3, 5], [1, 3, 4, 5], True, -1, [1, 3, 4, 5], [1, 3, 5], [1, 5], [1])


def test_dictionary(triples):
    d = dictionary.dictionary(triples)
    assert {(r.kind, r.term, r.id) for r in d.collect()} == {("entity", "<a>", 0), ("entity", "<b>", 1), ("predicate", "<p>", 0), ("predicate", "<q>", 1), ("literal", '"t"', 0)}
    assert {(r.term, r.id) for r in dictionary.ids_of(d, ["<b>", "<x>"], "entity").collect()} == {("<b>", 1), ("<x>", -1)}
    assert {(r.id, r.term) for r in dictionary.terms_of(d, [0, 7], "predicate").collect()} == {(0, "<p>"), (7, "")}
    assert {(r.s_id, r.p_id, r.o_id) for r in sinks.six_tuples(triples).collect()} == {(0, 0, 1), (0, 0, 1_000_000_000), (1, 1, 0)}


@pytest.mark.parametrize("few", [100_000, 3])
def test_tables_are_encoded_as_their_terms_are(spark, tmp_path, monkeypatch, few):
    from weftgraph.sources.tables import tables_graph

    monkeypatch.setattr(dictionary, "FEW", few)
    made = {
        "customer": "values (1, 'a', 7, 'x'), (10, 'é', 7, null), (2, 'a', null, 'x'), (null, 'b', 7, 'x') t(c_custkey, c_name, c_nationkey, c_mktsegment)",
        "lineitem": "values (1L, 5L, 2L, 1, 'A'), (1L, 5L, 2L, 1, 'A'), (1L, 5L, 2L, 1, 'B'), (10L, null, 2L, 1, 'A'), (9L, 5L, 3L, 2, null), (11L, 6L, 3L, 2, '\\'A') t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag)",
        "orders": "values (1L, 10L, 'A'), (2L, 77L, 'O'), (33L, null, null) t(o_orderkey, o_custkey, o_orderstatus)",
    }
    for name, rows in made.items():
        spark.sql(f"select * from {rows}").write.parquet(f"{tmp_path}/{name}.parquet")
    g = tables_graph(spark, str(tmp_path), tuple(made))
    names = ["<c_name>", "<c_nationkey>", "<c_mktsegment>", "<l_orderkey>", "<l_partkey>", "<l_suppkey>", "<l_returnflag>", "<o_custkey>", "<o_orderstatus>"]
    rows = g.triples(names).where("s is not null").distinct()
    monkeypatch.setattr(Graph, "triples", None)  # no triple is written out before it is encoded
    got = sinks.six_tuples_of_tables(g, names)
    want = sinks.six_tuples(rows)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    for a, b in zip(sinks.reencoded_tables(g, names), sinks.reencoded(rows)):
        assert a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_signature_has_no_false_negatives(triples):
    sig = signature.signatures(triples)
    hit = sig.where(signature.covers(signature.pattern([("<p>", True, "<b>")]))).select("term").collect()
    assert ("<a>",) in [tuple(r) for r in hit]


def test_sinks(spark, triples, tmp_path):
    df = spark.createDataFrame([("<a>", None)], "x string, y string")
    assert sinks.result_lines(df).first().value == "<a> \t"
    sinks.write_result(df.where("false"), str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == [sinks.EMPTY]
    lines, names, counts = sinks.reencoded(triples)
    assert tuple(counts.first()) == (3, 3) and lines.count() == 3 and names.count() == 2
    assert {r.p for r in sinks.predicate_names(spark.createDataFrame([("a <p> b",), (" x <q> y",), ("z",)], "value string")).collect()} == {"<p>", "<q>"}


def test_catalog_and_commands(spark, tmp_path):
    (tmp_path / "in.nt").write_text("<a> <p> <b> .\n<b> <p> <c> .\n")
    (tmp_path / "more.ttl").write_text("<c> <p> <d> .")
    c = Catalog(spark, str(tmp_path / "root"))
    assert c.show() == []
    run_command(c, f"import g {tmp_path / 'in.nt'}")
    assert run_command(c, "show databases") == "g"
    run_command(c, "load g")
    assert run_command(c, "query SELECT ?x { ?x <p> <c> }") == "<b>"
    assert run_command(c, "query SELECT ?x { ?x <p> <zz> }") == sinks.EMPTY
    run_command(c, f"insert g {tmp_path / 'more.ttl'}")
    assert [len(x) for x in c.query_batch(["SELECT * { ?x <p> ?y }", "SELECT * { ?x <p> ?y . ?y <p> ?z }"])] == [3, 2]
    assert c.stats.triples == {"<p>": 3}
    c.remove("g", spark.createDataFrame([("<a>", "<p>", "<b>")], TRIPLES))
    assert c.query("SELECT * { ?x <p> ?y }").count() == 2
    run_command(c, "unload g")
    with pytest.raises(ValueError):
        c.query("SELECT * { ?x <p> ?y }")
    with pytest.raises(ValueError):
        parse_command("frobnicate x")
    with pytest.raises(ValueError):
        parse_command("import onlyone")
    run_command(c, "drop g")
    assert c.show() == []


def test_stream_of_queries(spark, triples, tmp_path):
    folder = tmp_path / "q"
    folder.mkdir()
    (folder / "a.rq").write_text("SELECT ?x { ?x <p> <b> }")
    (folder / "b.rq").write_text("SELECT nonsense")
    (folder / "c.rq").write_text("server_exit")
    got = {}
    running = answer_stream(Graph.of_triples(triples), str(folder), lambda name, df: got.update({name: df.collect()}), str(tmp_path / "cp"), available_now=True)
    running.awaitTermination(60)
    assert [r.x for r in got["a.rq"]] == ["<a>"] and "error" in got["b.rq"][0].asDict() and running.exit_seen
