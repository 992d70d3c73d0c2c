"""What the third round's findings ask for."""

from pyspark.sql import functions as F


def jobs_and_operators(spark, df):
    """How many operators the executed plan of df has."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("\n")


def test_query_reads_nodes_once_a_level(spark):
    """The scanner of a query's nodes runs once, however many patterns and captures there are; a group of choices at the top
    holds what fits a choice with children."""
    from patchloom.operators import syntax as Q

    scanned = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def typed(x):
        scanned.add(1)
        return x

    rows = [(1, None, None, "a", 0, 9), (2, 1, "f", "b", 1, 2), (3, 1, None, "c", 3, 4), (4, 3, None, "b", 3, 4), (5, None, None, "d", 10, 12)]
    n = spark.createDataFrame(rows, "id int, parent int, field string, type string, start_byte int, end_byte int").withColumns({"doc": F.lit(1), "type": typed("type")})
    n = n.withColumn("type", F.concat("type", F.lit("")))
    found = Q.query(n, "[(a f: (b) @one (c (b) @deep)) @two (d) @three] @any (b) @each (c (_) @below)", "doc")
    got = {(r["capture"], r["id"]) for r in found.collect()}
    assert got == {("one", 2), ("deep", 4), ("two", 1), ("three", 5), ("any", 1), ("any", 5), ("each", 2), ("each", 4), ("below", 4)}
    assert scanned.value <= 4 * len(rows)
    assert jobs_and_operators(spark, found) < 60


def test_query_of_one_level_is_one_shuffle(spark):
    """tree_patterns: nodes of both sides of a pattern meet without a join, from one read."""
    from patchloom.operators import syntax as Q
    from patchloom.plans.syntax_bindings import TREE_QUERY

    n = spark.createDataFrame([(1, 8, None, None, "O", 0, 9), (1, 9, 8, "status", "R", 1, 2), (1, 10, 8, None, "N", 2, 3)], "doc int, id int, parent int, field string, type string, start_byte int, end_byte int")
    found = Q.query(n, TREE_QUERY, "doc")
    assert {(r["capture"], r["id"]) for r in found.collect()} == {("both", 8), ("late", 9), ("new", 10)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") == 1


def operators(df, *names):
    """How often each operator stands in the physical plan of df before it runs."""
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return [plan.count(n) for n in names]


def test_patches_are_parsed_without_sorting(spark):
    """diff_files_hunks: no line is sorted, and numbers, lengths left out, long numbers, nulls and empty texts count as before."""
    from patchloom.operators import diff as D

    rows = [
        (1, "--- a/x\n+++ b/y\n@@ -3 +4,2 @@\n-a\n+--\n+b\n+beyond\n--- z\n@@ -0000000001,1 +12345678901 @@\n-c\n+d\n"),
        (2, None), (3, ""), (4, "diff --git a/q b/q\n+no hunk\n@@ -x +1 @@\n+n"), (None, "@@ -7,0 +8 @@\n+e"),
        (5, "diff --git a/q b/q\n@@ -1 +1 @@\n-f\n+g\ndiff --git a/r b/r\n--- /dev/null\n@@ -0,0 +1 @@\n+ä\r\nend"),
    ]
    df = spark.createDataFrame(rows, "k int, text string").repartition(2)
    got = D.parse_diff(df, "k")
    assert operators(got, "Sort", "Window") == [0, 0]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        (1, 1, "x", "y", 3, "delete", 3, "a"), (1, 1, "x", "y", 4, "add", 4, "--"), (1, 1, "x", "y", 5, "add", 5, "b"),
        (1, 1, "z", "y", 9, "delete", 0, "c"), (1, 1, "z", "y", 10, "add", 0, "d"), (None, 1, None, None, 1, "add", 8, "e"),
        (5, 1, None, None, 2, "delete", 1, "f"), (5, 1, None, None, 3, "add", 1, "g"), (5, 2, "/dev/null", None, 7, "add", 1, "ä\r"),
    ], key=str)
    loose = {(r["side"], r["line_no"], r["text"]) for r in D.parse_diff(df.where("k = 1"), "k", compat=True).collect()}
    assert ("add", 6, "beyond") in loose and D.parse_diff(df.where("k < 0"), "k").count() == 0


def test_answers_are_read_without_sorting(spark):
    """mixed_answers: lines of answers are neither sorted nor joined back."""
    from patchloom.sources import patches as P

    rows = [(1, "```diff\n-a\n```\nb\n```diff\n+c"), (2, None), (3, ""), (4, "```\nx"), (5, "diff --git a b\n+d\n```diff\n+e\n```"), (6, "```diff\n\n```"), (None, "```diff\n+f"), (7, "```diff\n+g\n```\n```")]
    got = P.answer_diffs(spark.createDataFrame(rows, "k int, text string").repartition(2), "k")
    assert operators(got, "Sort", "Window", "Join") == [0, 0, 0]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "-a\n+c", "found"), (2, None, "not_found"), (3, None, "wrong_answer"), (4, None, "wrong_answer"), (5, "+e", "found"), (6, None, "wrong_answer"), (None, "+f", "found"), (7, None, "wrong_answer")], key=str)


def test_code_without_conditions_is_not_scanned(spark, monkeypatch):
    """mixed_formats: one pass of Python, and only code that names a condition is scanned."""
    from patchloom.functions import text as T

    rows = [(1, "a =\n  1;\n"), (2, "if (p)\n  q(2);\n"), (3, None), (4, ""), (5, "if (a) b(); else\n c();\n")]
    got = T.formatted(spark.createDataFrame(rows, "k int, code string"), "code", "k")
    assert operators(got, "ArrowEvalPython", "MapInPandas") == [0, 0]
    assert sorted(map(tuple, got.collect())) == [(1, "a = 1;\n"), (2, "if (p)\n  {\nq(2);\n}\n"), (3, None), (4, ""), (5, "if (a) {\nb(); }\nelse {\nc();\n}\n")]


def test_call_graphs_shuffle_orders_once(spark):
    """mixed_call_graphs: points are counted and joined by order, without a shuffle of points or edges."""
    from patchloom.plans.varied_bindings import mixed_call_graphs

    plan = mixed_call_graphs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "version" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_pivots_meet_by_key_without_a_join(spark):
    """unmapped_lines, patch_hunks: both sides of a pivot are sorted once, by key; nulls match nothing."""
    from patchloom.operators import diff as D

    a = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 3), (2, 5), (None, 1)], "k int, line_no int")
    m = spark.createDataFrame([(1, 2), (1, 2), (2, 4), (None, 1), (1, None)], "k int, line_no int")
    got = D.context_pivot(a, m, "k")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 1, 1), (1, 3, 2), (1, 3, 3), (2, 5, 1), (None, 1, 1)]


def test_snippets_are_gathered_in_their_task(spark):
    """gap_merge_lines: one join, on the name of base lines; repeated marked lines of a gap count once."""
    from patchloom.operators import merge as M

    rows = [(1, 1, " a\n+x\n+x\nb\n-y"), (1, 2, "a\n+x\nb"), (1, 3, "c"), (1, 4, None), (1, 5, "")]
    got = M.merged_lines(spark.createDataFrame(rows, "g int, s int, text string"), "g", "s")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1, 1, True, 1, 1, "+x"), (1, 1, 2, True, 1, 4, "-y"), (1, 1, 1, True, 2, 1, "+x"), (1, 1, 0, False, None, 0, "a"), (1, 1, 1, False, None, 1, "b")], key=str)


def test_walk_back_from_sinks_ends_with_the_hops(spark, monkeypatch):
    """flow_to_returns, flow_to_same_name: a chain longer than the flows is not walked back to its start."""
    from patchloom.operators import flows as W
    from patchloom.operators import graph as G

    sizes, reach = [], G.reach
    monkeypatch.setattr(G, "reach", lambda *a, **o: sizes.append((r := reach(*a, **o)).count()) or r)
    e = spark.range(30).selectExpr("1 AS k", "cast(id AS int) AS src", "cast(id + 1 AS int) AS dst")
    node = lambda *xs: spark.createDataFrame([(1, x) for x in xs], "k int, node int")
    got = W.flows(e, node(27, 28, 30), node(30), "k", hops=2).collect()
    assert [(r["source"], r["sink"], r["path"]) for r in got] == [(28, 30, [28, 29, 30])] and sizes == [2]
