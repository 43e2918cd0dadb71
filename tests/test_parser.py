import pytest

from weftgraph.sparql.ast import Ask, Construct, Pattern, Select, Union, variables
from weftgraph.sparql.parser import SparqlError, parse


def test_prefixes_lists_and_a():
    q = parse('PREFIX x: <http://e/> SELECT ?s WHERE { ?s a x:T ; x:p "v"@en , 5 . [] x:q ?s }')
    assert q.where.items[0] == Pattern("?s", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<http://e/T>")
    assert [i.o for i in q.where.items[1:3]] == ['"v"@en', '"5"']
    assert variables(q.where) == ["?s"]


def test_datatype_is_dropped_and_dollar_variables_work():
    q = parse('SELECT $x { $x <p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> }')
    assert q.items == ["?x"] and q.where.items[0].o == '"5"'


def test_paths_and_modifiers():
    q = parse("SELECT DISTINCT * { ?a ^<p>/<q>*|!(<r>|^<s>) ?b } ORDER BY DESC(?a) ?b LIMIT 3 OFFSET 2")
    assert q.where.items[0].p == ("|", ("/", ("^", "<p>"), ("*", "<q>")), ("!", ["<r>", ("^", "<s>")]))
    assert (q.distinct, q.limit, q.offset, [u for _, u in q.order_by]) == (True, 3, 2, [False, True])


def test_forms():
    assert isinstance(parse("ASK { ?a <p> ?b }"), Ask)
    assert isinstance(parse("CONSTRUCT WHERE { ?a <p> ?b }"), Construct)
    q = parse("SELECT (COUNT(DISTINCT ?a) AS ?n) { { ?a <p> ?b } UNION { ?b <p> ?a } UNION { ?a <q> ?b } } GROUP BY ?b HAVING(COUNT(*) > 1)")
    assert isinstance(q, Select) and isinstance(q.where.items[0], Union) and len(q.where.items[0].groups) == 3


@pytest.mark.parametrize(
    ("text", "says"),
    [
        ("DESCRIBE <a>", "DESCRIBE"),
        ("SELECT ?x { GRAPH <g> { ?x <p> ?y } }", "GRAPH"),
        ("SELECT ?x FROM <g> { ?x <p> ?y }", "FROM"),
        ("SELECT ?x { ?x y:p ?z }", "prefix"),
        ("SELECT ?x { ?x <p> ?y ", "before"),
        ("SELECT { ?x <p> ?y }", "SELECT needs"),
        ("INSERT DATA { <a> <b> <c> }", "INSERT"),
        ("SELECT ?x { ?x <p> ?y } nonsense", "unexpected"),
    ],
)
def test_refusals(text, says):
    with pytest.raises(SparqlError, match=says):
        parse(text)
