"""Lines matched as the plain rule does, keyed paths, names in DOT, nulls in traces, formatting."""

import random

from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.operators import diff as D
from patchloom.operators import graph as G
from patchloom.operators import merge as M
from patchloom.sources import patches as P


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return row[-1]


def plain_matches(a, b, least):
    free = list(range(len(b)))
    for i, x in enumerate(a):
        best, at = -1.0, -1
        for j in free:
            x_, y_ = x or "", b[j] or ""
            s = 2.0 * subsequence(x_, y_) / (len(x_) + len(y_)) if x_ or y_ else 1.0
            if s > best:
                best, at = s, j
        if at >= 0 and best >= least:
            free.remove(at)
            yield i, at, best


def test_best_lines_equal_the_plain_rule():
    rng = random.Random(1)
    line = lambda: rng.choice([None, "".join(rng.choice("abc") for _ in range(rng.randrange(7)))])
    for _ in range(400):
        a, b = ([line() for _ in range(rng.randrange(7))] for _ in range(2))
        least = rng.choice([0, 0.5, 0.6, 1.0])
        assert list(D.best_lines(a, b, least)) == list(plain_matches(a, b, least))
    assert D.ratio("x" * 5000, "x" * 4000 + "y") == 8000 / 9001


def test_drop_consecutive_keeps_nulls_that_follow_values(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "b"), (5, None), (6, "b"), (7, "b")], "o int, v string")
    assert [r["o"] for r in M.drop_consecutive(df.withColumn("k", F.lit(1)), "v", ["o"], "k").orderBy("o").collect()] == [1, 2, 4, 5, 6]


def test_simple_paths_of_many_graphs_and_any_length(spark):
    long_ = [("l", f"n{i}", f"n{i + 1}") for i in range(120)]
    e = spark.createDataFrame([*long_, ("a", "x", "y"), ("a", "y", "z"), ("b", "x", "z"), ("b", "z", "x")], "k string, src string, dst string")
    starts = spark.createDataFrame([("l", "n0"), ("a", "x"), ("b", "x")], "k string, node string")
    stops = spark.createDataFrame([("l", "n120"), ("a", "z"), ("b", "z")], "k string, node string")
    got = {r["k"]: r["node_path"] for r in G.simple_paths(e, starts, stops, "k", prune=False).collect()}
    assert got == {"l": [f"n{i}" for i in range(121)], "a": ["x", "y", "z"], "b": ["x", "z"]}


def test_window_flows_cross_buckets(spark):
    df = spark.createDataFrame([(1, "t", i) for i in range(0, 200, 7)], "k int, name string, line int")
    got = {tuple(r) for r in G.window_flows(df, "k", "name", "line", F.col("s.line") - 20, F.col("s.line") + 30, span=16).select("src_line", "dst_line").collect()}
    lines = range(0, 200, 7)
    assert got == {(a, b) for a in lines for b in lines if a - 20 < b < a + 30}


def test_suffixes_and_parts(spark):
    points = spark.createDataFrame([(2, "a/b/c"), (1, "z/b/c"), (3, "b/c"), (4, None), (5, "")], "pos int, node string")
    wanted = spark.createDataFrame([("c",), ("b/c",), ("x",), (None,)], "name string")
    assert {tuple(r) for r in G.resolve_suffix(points, wanted).collect()} == {("c", "z/b/c"), ("b/c", "z/b/c")}
    assert {r["node"] for r in G.seeds_containing(points, spark.createDataFrame([("/b",), ("q",), (None,)], "name string")).collect()} == {"a/b/c", "z/b/c"}
    # an empty name is part of every point
    assert G.seeds_containing(points, spark.createDataFrame([("",)], "name string")).count() == 4


def test_dot_names(spark):
    names = ['a"b', "c\\", 'd\\"e', "f\ng", "\\n"]
    e = spark.createDataFrame([(1, a, b) for a in names for b in names], "k int, src string, dst string")
    back = P.dot_edges(P.to_dot(e, "k").withColumnRenamed("dot", "text"), "k")
    assert {(r["src"], r["dst"]) for r in back.collect()} == {(a, b) for a in names for b in names}
    bad = spark.createDataFrame([(1, 'digraph {\n"a"b" -> "c\\"d";\n"x" [label="y"z"];\n}')], "k int, text string")
    fixed = bad.withColumn("text", P.escape_dot(F.col("text")))
    assert fixed.first()["text"] == 'digraph {\n"a\\"b" -> "c\\"d";\n"x" [label="y\\"z"];\n}'
    assert [(r["src"], r["dst"]) for r in P.dot_edges(fixed, "k").collect()] == [('a"b', 'c"d')]


def test_splices_and_java(spark):
    df = spark.createDataFrame([("a \\\n  b \\\nc\nd", "@A\nx\n .y()\n  .z();\n@B\nint i\n= 1;")], "c string, j string")
    assert df.select(T.splice_lines(F.col("c"))).first()[0] == "a  b  c\nd"
    assert T.statement_lines(df.first()["j"], "java") == "@A\nx .y() .z();\n\n\n@B\nint i = 1;\n"


def test_pre_order_and_captures(spark):
    df = spark.createDataFrame([(0, 0, "f", 0, 9), (1, 1, "g", 0, 9), (2, 2, "h", 0, 4), (3, 2, "h", 5, 9), (4, 1, None, 9, 9)], "id int, depth int, type string, start_byte int, end_byte int").withColumn("doc", F.lit(1))
    assert [r["id"] for r in G.pre_order(df, "doc").orderBy("order").collect()] == [0, 1, 2, 3, 4]
    assert {(r["capture"], r["id"]) for r in G.captures(df, {"a": ("h",), "b": ("h", "f")}, "doc").collect()} == {("a", 2), ("a", 3), ("b", 2), ("b", 3), ("b", 0)}


def test_contexts_of_diffs():
    old = "\n".join(["int f()", "{", " a", " b", "}", "", "int g()", "{", " c", "}", "int h()", " d"])
    new = old.replace(" b", " B")
    body = lambda c: D.unified(old, new, c).split("\n")[3:-1]
    assert body(1) == ["@@ -3,3 +3,3 @@", "  a", "- b", "+ B", " }"]
    assert body("function") == ["@@ -1,6 +1,6 @@", " int f()", " {", "  a", "- b", "+ B", " }", " "]
    assert len(body("full")) == 1 + 13
    both = old.replace(" b", " B").replace(" d", " D")
    assert [x for x in D.unified(old, both, "function").split("\n") if x.startswith("@@")] == ["@@ -1,6 +1,6 @@", "@@ -11,2 +11,2 @@"]
    assert [x for x in D.unified(old, both, 0).split("\n") if x.startswith("@@")] == ["@@ -4,1 +4,1 @@", "@@ -12,1 +12,1 @@"]
    rng = random.Random(5)
    for _ in range(200):
        x, y = ("\n".join(rng.choice(["a", " b", "c", " d"]) for _ in range(rng.randrange(1, 12))) for _ in range(2))
        for c in (0, 1, 3, "function", "full"):
            changes, i, j = [], 0, 0
            for line in D.unified(x, y, c, ignore_space=False).split("\n")[3:-1]:
                if line.startswith("@@"):
                    i, j = (int(p[1:].split(",")[0]) - (p.endswith(",0") is False) for p in line.split(" ")[1:3])
                    continue
                if line[0] != "+":
                    i += 1
                if line[0] != "-":
                    j += 1
                changes += [("delete", i, line[1:])] if line[0] == "-" else [("add", j, line[1:])] if line[0] == "+" else []
            assert D.apply_diff(x, changes) == y


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "w.csv").write_text('CVE_ID,patch,TOOL_R2\nC1,"https://github.com/o/r/commit/aa#diff-1\nhttps://github.com/o/r/commit/bb",x\n')
    row = P.read_work(spark, f"file://{tmp_path}/w.csv").first()
    assert (row["repo_name"], row["pre_commit"], row["post_commit"], row["tool_results"]) == ("o@@r", "aa", "bb", "x")
    df = spark.createDataFrame([("a/b.c", "int x;")], "path string, text string")
    P.write_json(df, f"file://{tmp_path}/j")
    assert [tuple(r) for r in spark.read.json(f"file://{tmp_path}/j").select("path", "text").collect()] == [("a/b.c", "int x;")]
    (tmp_path / "g.json").write_text('{"pre": {"points": ["a"], "edges": [["a", "b", "1", "2"]]}, "post": null}')
    points, edges = P.call_graph(P.read_json(spark, f"file://{tmp_path}/g.json", P.CALL_GRAPH))
    assert [tuple(r) for r in points.collect()] == [("pre", "a")] and [tuple(r) for r in edges.collect()] == [("pre", "a", "b", 1, 2)]
