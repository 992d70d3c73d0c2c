"""Flows, ranks around seeds, the scanner, pattern queries and the alignment, each against a plain rule."""

import itertools
import random
import time

import pytest

from patchloom.functions import align, scan
from patchloom.functions import text as T
from patchloom.operators import diff as D
from patchloom.operators import flows as W
from patchloom.operators import graph as G
from patchloom.operators import syntax as Q


def shortest(edges, key, source):
    """{node: (hops, path)} by a walk in rounds; a node keeps the least node it can come from."""
    out, new = {source: (0, [source])}, [source]
    while new:
        step = {}
        for k, a, b in edges:
            if k == key and a in new and b is not None and b not in out:
                step[b] = min(a, step.get(b, a))
        for b, a in step.items():
            out[b] = (out[a][0] + 1, [*out[a][1], b])
        new = list(step)
    return out


@pytest.mark.parametrize("prune", [True, False])
def test_flows_against_a_walk(spark, prune):
    rng = random.Random(3)
    edges = [(k, rng.randrange(30), rng.randrange(30)) for k in (1, 2) for _ in range(55)] + [(1, 3, 3), (1, None, 4), (2, 5, None)]
    sources = [(k, n, n * 10) for k in (1, 2) for n in (0, 1, 2, 7)] + [(3, 1, 10)]
    sinks = [(k, n, n * 10) for k in (1, 2) for n in range(0, 30, 2)]
    want = {(k, s, n, h, tuple(p)) for k, s, line in sources for n, (h, p) in shortest(edges, k, s).items() if n != s and (k, n, n * 10) in sinks and line < n * 10 < line + 200}
    from pyspark.sql import functions as F

    e, a, z = spark.createDataFrame(edges, "k int, src int, dst int"), spark.createDataFrame(sources, "k int, node int, line int"), spark.createDataFrame(sinks, "k int, node int, line int")
    window = (F.col("d.line") > F.col("s.line")) & (F.col("d.line") < F.col("s.line") + 200)
    got = W.flows(e, a, z, "k", window=window, prune=prune).collect()
    assert len(got) == len(want) and {(r["k"], r["source"], r["sink"], r["hops"], tuple(r["path"])) for r in got} == want
    near = W.flows(e, a, z, "k", window=window, prune=prune, hops=2).collect()
    assert {(r["source"], r["sink"], r["k"]) for r in near} == {(s, n, k) for k, s, n, h, _ in want if h <= 2}
    assert W.flows(e.limit(0), a, z, "k").count() == 0


def test_a_long_flow_around_a_cycle(spark):
    edges = [(i, i + 1) for i in range(20)] + [(20, 0)]
    got = W.flows(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(0,), (15,)], "node int"), spark.createDataFrame([(14,), (0,)], "node int"))
    assert {(r["source"], r["sink"]): r["path"] for r in got.collect()} == {(0, 14): list(range(15)), (15, 14): [*range(15, 21), *range(15)], (15, 0): [*range(15, 21), 0]}


def test_ranks_near_seeds_against_dense_iteration(spark):
    rng = random.Random(8)
    edges = {(k, rng.randrange(40), rng.randrange(40)) for k in (1, 2) for _ in range(50)}
    seeds = [(1, "x", 3), (1, "x", 4), (1, "y", 4), (2, "x", 3), (2, "z", 99)]
    got = {(r["k"], r["set"], r["node"]): r["rank"] for r in W.seeded_ranks(spark.createDataFrame(list(edges), "k int, src int, dst int"), spark.createDataFrame(seeds, "k int, set string, node int"), "k", jumps=2, rounds=7).collect()}
    want = {}
    for k, s in {x[:2] for x in seeds}:
        own = {n for a, b, n in seeds if (a, b) == (k, s)}
        near = set(own)
        for _ in range(2):
            near |= {b for q, a, b in edges if q == k and a in near} | {a for q, a, b in edges if q == k and b in near}
        e = [(a, b) for q, a, b in edges if q == k and a in near and b in near]
        rank = {n: (n in own) / len(own) for n in near}
        for _ in range(7):
            lost = sum(r for n, r in rank.items() if not any(a == n for a, _ in e))
            rank = {n: (n in own) / len(own) * (0.15 + 0.85 * lost) + 0.85 * sum(rank[a] / sum(x == a for x, _ in e) for a, b in e if b == n) for n in near}
        assert sum(rank.values()) == pytest.approx(1)
        want |= {(k, s, n): r for n, r in rank.items()}
    assert got == pytest.approx(want)


def test_lines_of_paths_by_version(spark):
    g = G.build_graph(spark.createDataFrame([("pre", "a", "b", 1, 2), ("post", "a", "b", 7, 8)], "version string, src string, dst string, src_line int, tgt_line int"), "version")
    paths = spark.createDataFrame([("pre", ["a", "b"]), ("post", ["a", "b"]), ("pre", ["a"])], "version string, node_path array<string>")
    got = {(r["version"], len(r["node_path"])): [(e["caller"], e["callee"], [tuple(p) for p in e["source_tgt_pairs"]]) for e in r["edge_path"] or []] for r in G.paths_with_lines(paths, g, "version").collect()}
    assert got == {("pre", 2): [("a", "b", [(1, 2)])], ("post", 2): [("a", "b", [(7, 8)])], ("pre", 1): []}


def tree(code):
    nodes = scan.scan(code.encode())
    return [(x[3], x[2], code.encode()[x[4] : x[5]].decode()) for x in nodes]


def test_scanner():
    code = 'int f(int a)\n{\n  if (a > g(1)) b = 1; else if (c) { d(); } else return 2;\n  do s(); while (t);\n  /* if (no) */ x = "if (no) y;"; // if (no)\n}\n'
    got = tree(code)
    assert [t for k, _, t in got if k == "if_statement"] == ["if (a > g(1)) b = 1; else if (c) { d(); } else return 2;", "if (c) { d(); } else return 2;"]
    assert [(f, t) for k, f, t in got if f in ("consequence", "alternative")] == [("consequence", "b = 1;"), ("alternative", "else if (c) { d(); } else return 2;"), ("consequence", "{ d(); }"), ("alternative", "else return 2;")]
    assert [t for k, f, t in got if f == "function"] == ["f", "g", "d", "s"] and [t for k, _, t in got if k == "assignment_expression"] == ["b = 1", 'x = "if (no) y;"']
    assert [t for k, _, t in got if k == "function_definition"] == [code.rstrip("\n")]
    assert [(k, f, t) for k, f, t in tree('#include <a.h>\n# include "b.h"\n#define M(x) if (x) \\\n  y;\n') if f == "path"] == [("system_lib_string", "path", "<a.h>"), ("string_literal", "path", '"b.h"')]
    assert not [k for k, _, _ in tree("#define M(x) if (x) \\\n  y;\n") if k == "if_statement"]
    for odd in ("", "}", "if", "if (", "else ;", "{{{", "a(b[c{d)e", "case 1", "do x; while", "'", '"', "for (;;)", "x = {1, {2}};", "é(ü);", "if (a) ) b;", "\\"):
        nodes = scan.scan(odd.encode())
        assert all(0 <= x[4] <= x[5] <= len(odd.encode()) for x in nodes) and all(x[1] is None or nodes[x[1]][4] <= x[4] and x[5] <= nodes[x[1]][5] for x in nodes), odd
    deep = "if (x) " * 5000 + "y;"
    assert sum(x[3] == "if_statement" and x[5] == len(deep) for x in scan.scan(deep.encode())) == 5000


def test_bodies():
    bracketed = lambda c, **o: T.add_brackets(c, scan.bodies(c, **o))
    assert bracketed("if (a)\n  b();\nc();\n") == "if (a)\n  {\nb();\n}\nc();\n"
    assert bracketed("if (a) bb; else if (c) { d; } else ee;") == "if (a) {\nbb; }\nelse if (c) { d; } else {\nee;}\n"
    assert bracketed("if (a)\nif (b) cc;\nelse dd;\nee;") == "if (a)\n{\nif (b) {\ncc;\n}\nelse {\ndd;\n}\n}\nee;"
    assert bracketed("while (a) bb;\n") == "while (a) bb;\n" and bracketed("while (a) bb;\n", loops=True) == "while (a) {\nbb;\n}\n"
    assert bracketed("#define X if (a) bb;\nint y;") == "#define X if (a) bb;\nint y;"
    assert bracketed(None) is None and scan.bodies(None) == []


def test_formatted_with_brackets(spark):
    df = spark.createDataFrame([(1, "if (x) // why\n  a();\nelse\n  b(c,\n    d);\n\n"), (2, None), (3, "")], "id int, code string")
    got = {r["id"]: r["code"] for r in T.formatted(df, "code", "id").collect()}
    assert got[2] is None and got[3] == "" and got[1].count("{") == got[1].count("}") == 2
    assert "{" not in {r["id"]: r["code"] for r in T.formatted(df, "code", "id", brackets=False).collect()}[1]


def matches(nodes, p):
    """[(id, captures)] of all matches of a pattern, one combination of children after the other."""
    if p.choices:
        found = [(i, c) for x in p.choices for i, c in matches(nodes, x)]
    else:
        found = []
        for i, (_, _, kind, _) in nodes.items():
            if p.types and kind not in p.types:
                continue
            kids = [j for j in sorted(nodes, key=lambda j: nodes[j][3]) if nodes[j][0] == i]
            per = [[(j, c) for j, c in matches(nodes, x) if j in kids] for x in p.children]
            for combo in itertools.product(*per):
                at = [kids.index(j) for j, _ in combo]
                if all(a < b for a, b in zip(at, at[1:], strict=False)):
                    found.append((i, set().union(*(c for _, c in combo), set())))
    return [(i, c | {(x, i) for x in p.captures}) for i, c in found if p.name is None or nodes[i][1] == p.name]


QUERIES = [
    "(a) @x (b) @y", "(_) @any", "(a (b) @x)", "(a (b) @x (c) @y) @z", "(a (b) @x (b) @y)", "(a f: (b) @x)", "(a f: (b (c) @u) @x (_) @v)",
    "[(a) (b)] @x", "(a [(b) (c (a) @w)] @x (a) @y)", "(c f: [(a) g: (b)] @x)", "(a (b (c)) (c) @x (b) @y)", "(_ (a) @x f: _ @y)", "; nothing\n(a\n  g: (c) @x.y-z)",
]


@pytest.mark.parametrize("seed", range(2))
def test_patterns_against_all_combinations(spark, seed):
    rng = random.Random(seed)
    docs = {}
    for d in range(3):
        docs[d] = {0: (None, None, rng.choice("abc"), 0)}
        for i in range(1, 26):
            docs[d][i] = (rng.randrange(max(0, i - 9), i), rng.choice([None, "f", "g"]), rng.choice("abc"), i)
    rows = [(d, i, *x[:3], x[3], x[3] + 1) for d, t in docs.items() for i, x in t.items()]
    df = spark.createDataFrame(rows, "doc int, id int, parent int, field string, type string, start_byte int, end_byte int")
    for q in QUERIES:
        want = {(d, c, i) for d, t in docs.items() for p in Q.parse(q) for _, found in matches(t, p) for c, i in found}
        got = [(r["doc"], r["capture"], r["id"]) for r in Q.query(df, q, "doc").collect()]
        assert len(got) == len(set(got)) and set(got) == want, q


def test_queries_on_scanned_code(spark):
    code = [(1, '#include "a.h"\nint f() { if (x) y = g(); }'), (2, "for (;;) if (a) { h(b); }"), (3, None)]
    n = scan.syntax_nodes(spark.createDataFrame(code, "doc int, code string"), "code", "doc")
    ask = lambda q, **o: {(r["doc"], r["capture"], r["type"]) for r in Q.query(n, q, "doc", **o).collect()}
    assert ask("(if_statement)@name (while_statement)@name (for_statement)@name") == {(1, "name", "if_statement"), (2, "name", "if_statement"), (2, "name", "for_statement")}
    assert ask("(preproc_include (system_lib_string)@s)(preproc_include path: (string_literal)@s)") == {(1, "s", "string_literal")}
    assert ask("(assignment_expression)@name (function_definition)@method") == {(1, "name", "assignment_expression"), (1, "method", "function_definition")}
    inner = Q.query(n, "(compound_statement) @b", "doc")
    assert ask("(call_expression) @c", within=inner.where("doc = 2")) == {(2, "c", "call_expression")}
    first = Q.first_captured(Q.query(n, "(if_statement) @i (identifier) @i", "doc"), "doc").collect()
    assert {(r["doc"], r["type"]) for r in first} == {(1, "identifier"), (2, "if_statement")}
    assert Q.query(n, "", "doc").count() == 0
    for bad in ("(a", "a)", "(a b)", "@x", "(a)+", '("if")', "(a .)"):
        with pytest.raises(ValueError):
            Q.parse(bad)


def aligned(a, b):
    ops, out, i, j = align.opcodes(a, b), [], 0, 0
    for tag, i1, i2, j1, j2 in ops:
        assert (i1, j1) == (i, j) and (i2 > i1) == (tag != "insert") and (j2 > j1) == (tag != "delete")
        assert tag != "equal" or a[i1:i2] == b[j1:j2]
        out += a[i1:i2] if tag == "equal" else b[j1:j2]
        i, j = i2, j2
    assert (i, j) == (len(a), len(b)) and out == b and all((x[0] == "equal") != (y[0] == "equal") for x, y in zip(ops, ops[1:], strict=False))
    return sum(x[2] - x[1] for x in ops if x[0] == "equal")


def test_alignment():
    rng = random.Random(1)
    for n in range(1500):
        v = rng.choice([2, 3, 8, 40])
        a = [rng.randrange(v) for _ in range(rng.randrange(30))]
        aligned(a, [x for x in a if rng.random() > 0.2] if n % 2 else [rng.randrange(v) for _ in range(rng.randrange(30))])
    # the rare line stays, though the frequent ones around it would make a longer match
    a, b = list("}}}}}x"), list("x}}}}}")
    assert ("equal", 5, 6, 0, 1) in align.opcodes(a, b)
    # frequent elements alone: a shortest path
    a = [rng.randrange(2) for _ in range(600)]
    assert aligned(a, a[1:300] + a[310:]) == 589
    assert align.opcodes([], []) == [] and align.opcodes(["a"], []) == [("delete", 0, 1, 0, 0)]


def test_alignment_of_long_texts_takes_time_in_proportion():
    rng, took = random.Random(2), []
    for n in (25_000, 100_000):
        a = [f"l{rng.randrange(n // 3)}" if rng.random() < 0.7 else "}" for _ in range(n)]
        b = [x if rng.random() > 0.01 else "new" + x for x in a if rng.random() > 0.01]
        start = time.process_time()
        assert aligned(a, b) > 0.97 * n
        took.append(time.process_time() - start)
    assert took[1] < 16 * max(took[0], 0.05)
    hard = [[rng.randrange(5) for _ in range(6000)] for _ in range(2)]
    assert aligned(*hard) > 1000


def test_diffs_of_long_texts_apply(spark):
    rng = random.Random(3)
    a = [f"line {rng.randrange(900)}" for _ in range(3000)]
    b = [x for x in a if rng.random() > 0.05]
    b[100:100] = ["new", "new"]
    old, new = "\n".join(a), "\n".join(b)
    d = D.unified(old, new, 3, ignore_space=False)
    changed = D.parse_diff(spark.createDataFrame([(1, d)], "id int, text string"), "id").collect()
    assert D.apply_diff(old, [(r["side"], r["line_no"], r["text"]) for r in changed]) == new


@pytest.mark.parametrize("width", [7, 65_536])
def test_points_outside_spans(spark, width):
    rng = random.Random(width)
    points = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-50, 200)]), i) for i in range(300)]
    spans = [(rng.choice(["a", "b", None]), s, s + rng.choice([-1, 0, 3, 40])) for s in (rng.randrange(-60, 200) for _ in range(12))] + [("a", None, 5), ("b", 3, None), ("c", 0, 9)]
    p, s = spark.createDataFrame(points, "k string, n int, _range int"), spark.createDataFrame(spans, "k string, run_start int, run_end int")
    want = [r for r in points if r[0] is None or r[1] is None or not any(k == r[0] and a is not None and b is not None and a <= r[1] <= b for k, a, b in spans)]
    got = [tuple(r) for r in D.uncovered(p, s, "k", n="n", width=width).collect()]
    low = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=low) == sorted(want, key=low) and D.uncovered(p, s, "k", n="n").columns == ["k", "n", "_range"]
    none = D.uncovered(spark.createDataFrame([(5,), (9,)], "n int"), spark.createDataFrame([(4, 6)], "run_start int, run_end int"), n="n", width=width)
    assert [r["n"] for r in none.collect()] == [9]


def test_a_hot_key_is_swept_in_ranges(spark):
    """A million positions of one key: the largest window has no more than a range's rows."""
    p = spark.range(1_000_000).selectExpr("'u' AS k", "id AS n")
    s = spark.range(50_000).selectExpr("'u' AS k", "id * 20 AS run_start", "id * 20 + 9 AS run_end").unionByName(spark.createDataFrame([("u", 400_000, 700_000)], "k string, run_start long, run_end long"))
    got = D.uncovered(p, s, "k", n="n")
    assert got.count() == 350_000 and "Window" in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
