"""Small graphs, one for each rule of the semantics; and a property test against a naive matcher."""

from itertools import product

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from weftgraph.graph import Graph
from weftgraph.plans.compile import Compiler, ask, construct, count, query
from weftgraph.plans.stats import Stats
from weftgraph.sparql.ast import Pattern
from weftgraph.sparql.parser import SparqlError

TRIPLES = "s string, p string, o string"


def graph(spark, text):
    rows = [tuple(f"<{x}>" if x[0] not in '"<' else x for x in line.split()) for line in text.strip().split("\n")]
    return Graph.of_triples(spark.createDataFrame(rows, TRIPLES))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def cycle(spark):
    return graph(spark, "a k b\nb k c\nc k a\nb k c")


def test_cycle_iso_and_homo(cycle):
    triangle = "SELECT * { ?x <k> ?y . ?y <k> ?z . ?z <k> ?x }"
    assert count(cycle, triangle, match="iso") == count(cycle, triangle, match="homo") == 3
    assert count(cycle, "SELECT * { ?x <k> ?y . ?y <k> ?x }") == 0
    # two patterns of one predicate may bind the same edge only without injectivity
    assert count(cycle, "SELECT * { ?x <k> ?y . ?z <k> ?y }", match="homo") == 3
    assert count(cycle, "SELECT * { ?x <k> ?y . ?z <k> ?y }", match="iso") == 0


def test_duplicates_are_one_triple(cycle):
    assert count(cycle, "SELECT * { ?x <k> ?y }") == 3


def test_self_loop(spark):
    g = graph(spark, "a k a\na k b")
    assert rows(query(g, "SELECT ?x { ?x <k> ?x }", match="iso")) == [("<a>",)]
    assert count(g, "SELECT * { ?x <k> ?y }", match="iso") == 1


def test_predicate_variables_are_exempt_and_multiply(spark):
    g = graph(spark, "a k b\na m b")
    assert rows(query(g, "SELECT ?p { <a> ?p <b> }", match="iso")) == [("<k>",), ("<m>",)]
    assert count(g, "SELECT ?x { ?x <PU1> ?y . ?x <PU1> ?y }", match="iso") == 2
    assert count(g, "SELECT ?x { ?x ?p ?y . ?x ?q ?y }", match="iso") == 4


def test_unknown_predicate_and_constant(cycle):
    assert count(cycle, "SELECT ?x { ?x <nope> ?y }") == 0
    assert count(cycle, "SELECT ?x { <nope> <k> ?x }") == 0


def test_constant_patterns_are_existence_tests(cycle):
    assert count(cycle, "SELECT ?x { <a> <k> <b> . ?x <k> <c> }") == 1
    assert count(cycle, "SELECT ?x { <a> <k> <c> . ?x <k> <c> }") == 0
    assert ask(cycle, "ASK { <a> <k> <b> }") and not ask(cycle, "ASK { <b> <k> <a> }")


def test_disconnected_is_a_cross_product(cycle):
    assert count(cycle, "SELECT * { ?a <k> ?b . ?c <k> ?d }", match="homo") == 9
    assert count(cycle, "SELECT * { { ?a <k> ?b } { ?c <k> ?d } }") == 9


def test_unbound_joins_only_with_unbound(spark):
    g = graph(spark, 'a k b\nc k d\na m "x"\ne n "x"\nf n "y"')
    got = rows(query(g, "SELECT ?s ?v ?t { { ?s <k> ?o OPTIONAL { ?s <m> ?v } } { ?t <n> ?v } }"))
    assert got == [("<a>", '"x"', "<e>")]
    both = query(g, "SELECT ?s ?t { { ?s <k> ?o OPTIONAL { ?s <m> ?v } } { ?t <k> ?u OPTIONAL { ?t <m> ?v } } }")
    assert rows(both) == [("<a>", "<a>"), ("<c>", "<c>")]


def test_filters_compare_text_without_the_leading_quote(spark):
    g = graph(spark, 'a k "10"\nb k "9"\nc k "5"')
    assert rows(query(g, 'SELECT ?x { ?x <k> ?v FILTER(?v < "9") }')) == [("<a>",), ("<c>",)]
    # a bare number never equals a term, whose trailing quote stays
    assert count(g, "SELECT ?x { ?x <k> ?v FILTER(?v = 5) }") == 0
    assert count(g, "SELECT ?x { ?x <k> ?v FILTER(?v = 5) }", filter_mode="typed") == 1
    assert rows(query(g, "SELECT ?x { ?x <k> ?v FILTER(?v > 5) }", filter_mode="typed")) == [("<a>",), ("<b>",)]


def test_filter_on_unbound_and_missing_variables(spark):
    g = graph(spark, 'a k b\nc k d\na m "x"')
    text = 'SELECT ?s { ?s <k> ?o OPTIONAL { ?s <m> ?v } FILTER(?v != "x") }'
    assert rows(query(g, text)) == [("<c>",)]
    assert count(g, 'SELECT ?s { ?s <k> ?o FILTER(?zz != "x") }') == 2
    assert rows(query(g, "SELECT ?s ?zz { ?s <m> ?o }")) == [("<a>", "")]
    assert rows(query(g, "SELECT ?s { ?s <k> ?o OPTIONAL { ?s <m> ?v } FILTER(!BOUND(?v)) }")) == [("<c>",)]


def test_optional_without_shared_variable_is_a_cross_product(spark):
    g = graph(spark, "a k b\nc m d\ne m f")
    assert count(g, "SELECT * { ?x <k> ?y OPTIONAL { ?u <m> ?v } }") == 2


def test_union_pads_and_keeps_duplicates(spark):
    g = graph(spark, "a k b\na m b")
    assert rows(query(g, "SELECT ?x { { ?x <k> ?y } UNION { ?x <m> ?z } }")) == [("<a>",), ("<a>",)]


def test_closure(spark):
    g = graph(spark, "a k b\nb k c\nc k d\nd k b\nx k y")
    assert rows(query(g, "SELECT ?y { <a> <k>+ ?y }")) == [("<b>",), ("<c>",), ("<d>",)]
    assert rows(query(g, "SELECT ?y { <a> <k>* ?y }")) == [("<a>",), ("<b>",), ("<c>",), ("<d>",)]
    assert rows(query(g, "SELECT ?y { ?y <k>+ <y> }")) == [("<x>",)]
    assert rows(query(g, "SELECT ?x { ?x <k>+ ?x }")) == [("<b>",), ("<c>",), ("<d>",)]
    assert rows(query(g, "SELECT ?y { <a> <k>? ?y }")) == [("<a>",), ("<b>",)]


def test_negated_path(spark):
    g = graph(spark, "a k b\na m c\nd k a")
    assert rows(query(g, "SELECT ?y { <a> !<k> ?y }")) == [("<c>",)]
    assert rows(query(g, "SELECT ?y { <a> !(^<m>) ?y }")) == [("<d>",)]


def test_aggregates_over_nothing_and_expressions(spark):
    g = graph(spark, 'a k "3"\na k "4"\nb k "x"')
    assert rows(query(g, "SELECT (COUNT(*) AS ?n) { ?s <none> ?o }")) == [(0,)]
    assert rows(query(g, "SELECT ?s (SUM(?o) AS ?n) (MAX(?o) AS ?m) { ?s <k> ?o } GROUP BY ?s")) == [("<a>", 7.0, '"4.0"'), ("<b>", 0.0, '"x"')]
    assert rows(query(g, 'SELECT (CONCAT(STR(?s), "-", ?o) AS ?v) { ?s <k> ?o FILTER(ISNUMERIC(?o) && ?o * 2 > 6) }')) == [("a-4",)]
    with pytest.raises(SparqlError):
        query(g, "SELECT ?s { ?s <k> ?o FILTER(NOPE(?o)) }")


def test_construct_and_subselect(spark):
    g = graph(spark, "a k b\nb k c")
    assert rows(construct(g, "CONSTRUCT { ?y <of> ?x } WHERE { ?x <k> ?y }")) == [("<b>", "<of>", "<a>"), ("<c>", "<of>", "<b>")]
    assert rows(query(g, "SELECT ?x ?n { ?x <k> <b> { SELECT ?x (COUNT(*) AS ?n) { ?x <k> ?y } GROUP BY ?x } }")) == [("<a>", '"1"')]


def test_variables_differ_by_case(spark):
    g = graph(spark, "a k b")
    assert rows(query(g, "SELECT ?x { ?x <k> ?X }")) == [("<a>",)]


NODES, PREDICATES = ["<a>", "<b>", "<c>"], ["<p>", "<q>"]
_edge = st.tuples(st.sampled_from(NODES), st.sampled_from(PREDICATES), st.sampled_from(NODES))
_term = st.sampled_from(["?x", "?y", "?z", "<a>"])
_pattern = st.tuples(_term, st.sampled_from([*PREDICATES, "?p"]), _term)


def naive(edges, patterns, iso):
    names = list(dict.fromkeys(t for p in patterns for t in p if t.startswith("?")))
    nodes = [v for v in names if v != "?p"]
    out = []
    for values in product(*[PREDICATES if v == "?p" else NODES for v in names]):
        env = dict(zip(names, values))
        if all(tuple(env.get(t, t) for t in p) in edges for p in patterns):
            bound = [env[v] for v in nodes]
            if not iso or len(set(bound)) == len(bound):
                out.append(tuple(env[v] for v in sorted(names)))
    return sorted(out)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_edge, min_size=1, max_size=7, unique=True), st.lists(_pattern, min_size=1, max_size=3), st.booleans())
def test_matches_a_naive_matcher(spark, edges, patterns, iso):
    g = Graph.of_triples(spark.createDataFrame(edges, TRIPLES))
    rel = Compiler(g, match="iso" if iso else "homo").bgp([Pattern(*p) for p in patterns]).as_terms()
    got = sorted(tuple(r) for r in rel.df.select(*[rel.col(v) for v in sorted(rel.kinds)]).collect())
    assert got == naive(set(edges), patterns, iso)


def test_statistics_and_order(spark):
    from weftgraph.plans.planner import order

    g = graph(spark, "\n".join(f"n{i} big m{i % 7}" for i in range(30)) + "\nn3 small x")
    s = Stats.of(g)
    assert s.triples == {"<big>": 30, "<small>": 1} and s.ends["<big>", "o"] == 7
    assert s.common["<big>", "s", "<small>", "s"] == 1
    c = Compiler(g, stats=s)
    scans = order(c.scans([Pattern("?a", "<big>", "?b"), Pattern("?a", "<small>", "?c")]), s)
    assert scans[0].patterns[0].p == "<small>"
