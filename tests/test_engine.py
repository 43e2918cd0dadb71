"""Sums of any size, text files with errors, list parts, signatures, swaps and predicate variables by kind."""

import pytest

from weftgraph.graph import Graph
from weftgraph.operators import index, signature, update
from weftgraph.plans.compile import query
from weftgraph.queries import QUERIES, links
from weftgraph.service import Catalog
from weftgraph.sources import turtle
from weftgraph.sources.tables import tables_graph

TRIPLES = "s string, p string, o string"


def test_sums_of_any_size(spark):
    rows = [("<a>", "<k>", f'"{x}"') for x in ("0.0000004", "0.00000040")] + [("<b>", "<k>", '"1e25"'), ("<b>", "<k>", '"2"'), ("<c>", "<k>", '"0.1"'), ("<c>", "<k>", '"0.2"'), ("<d>", "<k>", '"x"'), ("<d>", "<k>", '"3"')]
    g = Graph.of_triples(spark.createDataFrame(rows, TRIPLES))
    got = {r.s: (r.n, r.m) for r in query(g, "SELECT ?s (SUM(?o) AS ?n) (AVG(?o) AS ?m) { ?s <k> ?o } GROUP BY ?s").collect()}
    assert got == {"<a>": (8e-07, 4e-07), "<b>": (1e25, 5e24), "<c>": (0.3, 0.15), "<d>": (3.0, 3.0)}


def test_blank_nodes_and_errors_of_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.nt").write_text('_:x <p> "\\u00e9" .\n_:x <p> _:y .\nbroken\n# fine\n')
        (tmp_path / f"{name}.ttl").write_text("_:x <p> 1 .\nbroken here .\n_:x <p> 2 .\n")
    rows = turtle.read_ntriples(spark, str(tmp_path / "*.nt")).collect()
    assert len(rows) == 4 and len({r.s for r in rows}) == 2
    assert [r.error for r in turtle.ntriples_errors(spark, str(tmp_path / "*.nt")).collect()] == ["not a triple: broken"] * 2
    assert len({r.s for r in turtle.read_turtle(spark, str(tmp_path / "*.ttl")).collect()}) == 2
    found = turtle.turtle_errors(spark, str(tmp_path / "*.ttl")).collect()
    assert {r.path.rsplit("/", 1)[1] for r in found} == {"a.ttl", "b.ttl"} and all("line 2" in r.error for r in found)
    catalog = Catalog(spark, str(tmp_path / "root"))
    assert catalog.build("g", str(tmp_path / "a.nt")).count() == 1


def test_escapes_are_read_alike(spark):
    texts = [r"x\by\fz", r"\\n", r"\\\n", r"\t\\", r"\\\\t", "\x01", r"\"q\"", r"it\'s"]
    lines = spark.createDataFrame([(f'<a> <p> "{t}" .',) for t in texts], "value string")
    want = {o for t in texts for _, _, o in turtle.TurtleParser().parse(f'<a> <p> "{t}" .')}
    assert {r.o for r in turtle.ntriples(lines).collect()} == want and len(want) == len(texts)


@pytest.mark.parametrize("name", list(index.INDEXES))
def test_index_in_parts(spark, sf, name):
    rows = links(spark, sf).where("p in ('<c_nationkey>', '<n_name>', '<o_custkey>')")
    keys, _ = index.INDEXES[name]
    whole = {tuple(r[k] for k in keys): r.list for r in index.index(rows, name).collect()}
    parts: dict = {}
    for r in index.index_parts(rows, name, size=20).collect():
        assert r.size == len(r.list) == len(set(r.list)) < 80
        parts.setdefault(tuple(r[k] for k in keys), []).extend(r.list)
    assert {k: sorted(v) for k, v in parts.items()} == whole


@pytest.mark.parametrize("name", [n for n, (_, values) in index.INDEXES.items() if values[-1] == "s"])
def test_lists_of_subjects_are_made_from_their_parts(spark, tmp_path, monkeypatch, name):
    made = {
        "customer": "values (1, 'a', 7, 'x'), (10, 'a', 7, null), (2, 'x', null, 'x'), (-3, 'x', 7, 'x'), (100, 'a', 7, 'x'), (12345, 'a', 1, 'x'), (1234, 'a', 7, 'x'), (null, 'b', 7, 'x') t(c_custkey, c_name, c_nationkey, c_mktsegment)",
        "lineitem": "values (1L, 5L, 2L, 1, 'A', 'A'), (1L, 5L, 2L, 1, 'A', 'B'), (1L, 5L, 2L, 1, 'B', 'A'), (10L, null, 2L, 1, 'A', 'A'), (9L, 5L, 3L, 2, null, 'A'), (11L, 6L, 3L, 2, '\\'A', ',') t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus)",
        "documents": "values (1L, 'x', '1'), (2L, '1', null), (30L, '0', '0') t(doc_id, lang, source)",
        "labels": "values (1L, 1, 1), (2L, 1, 0), (30L, null, 0) t(doc_id, quality, toxic)",
        "region": "select 1L as r_regionkey, 'x' as r_name where false",
    }
    for table, rows in made.items():
        spark.sql(rows if rows.startswith("select") else f"select * from {rows}").write.parquet(f"{tmp_path}/{table}.parquet")
    g = tables_graph(spark, str(tmp_path), tuple(made))
    names = ["<c_name>", "<c_nationkey>", "<c_mktsegment>", "<l_orderkey>", "<l_partkey>", "<l_suppkey>", "<l_returnflag>", "<l_linestatus>", "<lang>", "<source>", "<quality>", "<toxic>", "<r_name>"]
    keys, values = index.INDEXES[name]
    want = {}
    for r in g.triples(names).where("s is not null").distinct().collect():
        want.setdefault(tuple(r[k] for k in keys), set()).add(" ".join(r[v] for v in values))
    monkeypatch.setattr(index, "RANGE", 2)
    parts = index.subject_texts(g, names, name)
    # no triples of all tables are made distinct, no list of a key is gathered as terms
    monkeypatch.setattr(Graph, "triples", None)
    got = {tuple(r[k] for k in keys): (r.list, r.size) for r in index.subject_lists(g, names, name).collect()}
    assert got == {k: (",".join(sorted(v)), len(v)) for k, v in want.items()}
    held = {}
    for r in sorted(parts.collect(), key=lambda r: r.text):
        assert 0 < r.size < 8
        held.setdefault(tuple(r[k] for k in keys), []).append(r.text)
    assert {k: ",".join(v) for k, v in held.items()} == {k: v[0] for k, v in got.items()}
    assert max(map(len, held.values())) > 3


@pytest.mark.parametrize("name", ["p2s", "o2s", "o2ps"])
def test_index_queries_gather_no_triples(spark, sf, monkeypatch, name):
    monkeypatch.setattr(Graph, "triples", None)
    assert QUERIES[f"index_{name}"](spark, sf).count() > 20


def test_signatures_let_few_others_pass(spark, sf):
    rows = links(spark, sf)
    hit = signature.signatures(rows).where(signature.covers(signature.pattern([("<c_nationkey>", True, "<nation/3>")]))).select("term").collect()
    true = {r.s for r in rows.where("p = '<c_nationkey>' and o = '<nation/3>'").collect()}
    hit = {r.term for r in hit}
    others = rows.select("s").distinct().count() - len(true)
    assert true and true <= hit and len(hit - true) <= 0.02 * others


def test_a_swap_that_was_cut_short(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    Graph.of_triples(spark.createDataFrame([("<a>", "<p>", "<b>")], TRIPLES)).save_triples(catalog.path("g"))
    (tmp_path / "g").rename(tmp_path / "g.old")
    (tmp_path / "g.new").mkdir()
    assert catalog.show() == ["g"]
    catalog.load("g")
    assert catalog.query("SELECT * { ?x <p> ?y }").count() == 1
    with pytest.raises(ValueError):
        catalog.path("g.old")


def test_append_to_a_frequent_predicate(spark, tmp_path):
    path = str(tmp_path / "g")
    Graph.of_triples(spark.createDataFrame([("<a>", "<p>", "<b>")], TRIPLES)).save_triples(path)
    update.append(path, spark.range(500).selectExpr("concat('<s', id, '>') as s", "'<p>' as p", "'<o>' as o"))
    assert Graph.load(spark, path).stored.count() == 501


@pytest.mark.parametrize(
    "text",
    [
        "SELECT ?s ?p ?n { ?s ?p ?n . ?n <n_regionkey> <region/3> }",
        "SELECT ?c ?p ?x { ?c <c_nationkey> <nation/3> . ?c ?p ?x }",
        "SELECT ?a ?p ?b { ?a <n_regionkey> ?r . ?b <r_name> ?m . ?a ?p ?b }",
        "SELECT ?p ?q { ?n <n_name> ?x . ?s ?p ?n . ?n ?q ?x }",
        "SELECT ?p { ?n ?p ?n }",
        "SELECT ?c ?p { ?c ?p <nation/3> . ?c <c_mktsegment> ?m }",
    ],
)
def test_predicate_variables_by_kind(spark, sf, text):
    tables = ("region", "nation", "customer", "supplier")
    g = tables_graph(spark, sf, tables)
    stored = Graph.of_triples(g.triples())
    for match in ("homo", "iso"):
        a, b = (sorted(map(tuple, query(x, text, match=match).collect())) for x in (g, stored))
        assert a == b


def test_statistics_of_tables_are_those_of_their_terms(spark, sf):
    from weftgraph.plans.stats import Stats

    g = tables_graph(spark, sf, ("nation", "customer", "supplier", "orders", "documents", "labels"))
    terms = Graph.of_triples(g.triples(), distinct=False)
    for predicates in (None, ["<o_custkey>", "<c_nationkey>", "<s_nationkey>", "<lang>"]):
        a, b = Stats.of(g, predicates), Stats.of(terms, predicates)
        assert (a.triples, a.ends, a.common) == (b.triples, b.ends, b.common) and a.common


def test_statistics_of_tables_write_no_terms(spark, sf, monkeypatch):
    from weftgraph.plans.stats import Stats

    monkeypatch.setattr(Graph, "triples", None)
    s = Stats.of(tables_graph(spark, sf), ["<l_orderkey>", "<l_suppkey>"])
    assert s.common["<l_orderkey>", "s", "<l_suppkey>", "s"] == s.ends["<l_orderkey>", "s"] > 0


def test_a_frequent_value_does_not_join_early():
    from weftgraph.plans.planner import Scan, order
    from weftgraph.plans.stats import Stats
    from weftgraph.sparql.ast import Pattern

    # 60,000 suppliers and 900,000 customers of 25 nations: pairs by nation outnumber everything else
    triples = {"<l_orderkey>": 36_000_000, "<l_suppkey>": 36_000_000, "<o_custkey>": 9_000_000, "<c_nationkey>": 900_000, "<s_nationkey>": 60_000}
    ends = {("<l_orderkey>", "o"): 9_000_000, ("<l_suppkey>", "o"): 60_000, ("<o_custkey>", "o"): 900_000, ("<c_nationkey>", "o"): 25, ("<s_nationkey>", "o"): 25}
    stats = Stats(triples, ends | {(p, "s"): n for p, n in triples.items()})
    parts = [[("?l", "<l_orderkey>", "?o"), ("?l", "<l_suppkey>", "?s")], [("?o", "<o_custkey>", "?c")], [("?c", "<c_nationkey>", "?n")], [("?s", "<s_nationkey>", "?n")]]
    scans = [Scan([Pattern(*p) for p in x], frozenset(t for p in x for t in p if t[0] == "?")) for x in parts]
    assert [s.patterns[0].p for s in order(scans, stats)] == ["<s_nationkey>", "<l_orderkey>", "<o_custkey>", "<c_nationkey>"]


def test_unbound_rows_meet_in_many_parts(spark):
    from pyspark.sql import functions as F

    from weftgraph.operators.bindings import Rel, join
    from weftgraph.terms import TERM

    side = lambda v, n: Rel(spark.range(n).select(F.concat(F.lit(f"<{v}"), "id", F.lit(">")).alias(f"v_{v}"), F.when(F.col("id") % 10 == 0, F.lit('"q"')).alias("v_q")), {f"?{v}": TERM, "?q": TERM}, frozenset(["?q"]))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("false", "-1")):
            spark.conf.set(k, v)
        rel = join(side("a", 6000), side("b", 50))
        found = rel.df.withColumn("at", F.spark_partition_id()).groupBy("at").agg(F.count("*").alias("n"), F.count_distinct("v_a", "v_b").alias("d"), F.count("v_q").alias("q")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(r.n for r in found) == sum(r.d for r in found) == 5400 * 45 + 600 * 5 and sum(r.q for r in found) == 600 * 5
    assert rel.maybe == {"?q"} and max(r.n for r in found) < 0.6 * 5400 * 45
