"""The DOT reader, case by case."""

import pytest

from patchloom.sources import dot, patches

CASES = [
    ("digraph g { a -> b -> c; }", [("a", "b", {}), ("b", "c", {})], {"a": {}, "b": {}, "c": {}}),
    ('strict graph "x y" {\n  a\n  --\n  b [w=1,\n  label="two\\nlines"]\n}', [("a", "b", {"w": "1", "label": "two\nlines"})], None),
    ("digraph { a -> {b c} -> d [k=v]; }", [("a", "b", {"k": "v"}), ("a", "c", {"k": "v"}), ("b", "d", {"k": "v"}), ("c", "d", {"k": "v"})], None),
    ("digraph { subgraph s { node [shape=box]; edge [c=red]; a -> b; } c -> d }", [("a", "b", {"c": "red"}), ("c", "d", {})], {"a": {"shape": "box"}, "b": {"shape": "box"}, "c": {}, "d": {}}),
    ('digraph { "a->b" -> "c;d" [t="]}"] }', [("a->b", "c;d", {"t": "]}"})], None),
    ("digraph { a:p:n -> b:q; rankdir = LR; x [l=<<b>x</b> y>]; -1.5 -> .5 }", [("a", "b", {}), ("-1.5", ".5", {})], {"a": {}, "b": {}, "x": {"l": "<b>x</b> y"}, "-1.5": {}, ".5": {}}),
    ('digraph { a [l="1" + "2" flag]; a -> a }', [("a", "a", {})], {"a": {"l": "12", "flag": "true"}}),
    ('digraph { n1 [label="say "hi" now"]; n1 -> "q"r"; }', [("n1", 'q"r', {})], {"n1": {"label": 'say "hi" now'}, 'q"r': {}}),
    ('digraph { "\\"x\\\\" -> b }', [('"x\\', "b", {})], None),
    ("digraph { { a b } -> { c { d } } ; { e } }", [("a", "c", {}), ("a", "d", {}), ("b", "c", {}), ("b", "d", {})], {x: {} for x in "abcde"}),
    ("", [], {}), ("digraph {}", [], {}), ("digraph { ;; }", [], {}),
]


@pytest.mark.parametrize(("text", "edges", "nodes"), CASES)
def test_graphs(text, edges, nodes):
    n, e = dot.parse(text)
    assert e == edges and (nodes is None or n == nodes)


@pytest.mark.parametrize("text", ["digraph", "digraph {", "digraph { a -> }", "digraph { a -> ; }", "digraph { a [x=] }", "digraph { \x01 }", "digraph { a [l=<x }", "digraph { subgraph s a }"])
def test_what_is_no_graph(text):
    with pytest.raises(dot.DotError):
        dot.parse(text)


def test_comments():
    assert dot.parse("digraph { // no -> edge\n /* x -> y */ a\n# not -> this\n }") == ({"a": {}}, [])


def test_deep_graphs_need_no_deep_stack():
    n, e = dot.parse("digraph {" + "{" * 5000 + "a" + "}" * 5000 + "-> b }")
    assert e == [("a", "b", {})] and set(n) == {"a", "b"}


def test_rows(spark):
    texts = [(1, "digraph { a -> b -> c [w=2] }"), (2, "digraph { a -> }"), (3, None), (4, "")]
    got = dot.dot_rows(spark.createDataFrame(texts, "k int, text string"), "k").collect()
    assert {(r["k"], r["kind"], r["pos"], r["src"], r["dst"]) for r in got} == {(1, "edge", 0, "a", "b"), (1, "edge", 1, "b", "c"), (1, "node", 0, "a", None), (1, "node", 1, "b", None), (1, "node", 2, "c", None), (2, "error", 0, None, None)}
    assert {r["problem"] for r in got if r["k"] == 2} == {"'}' on line 1 is not understood"} and [r["attributes"] for r in got if r["kind"] == "edge"] == [{"w": "2"}] * 2
    rows = spark.createDataFrame([(1, 'x"y\\', "a b"), (1, "p\nq", "r")], "k int, src string, dst string")
    back = dot.dot_rows(patches.to_dot(rows, "k"), "k", text="dot").where("kind = 'edge'")
    assert {(r["src"], r["dst"]) for r in back.collect()} == {('x"y\\', "a b"), ("p\nq", "r")}
