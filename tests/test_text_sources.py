from pyspark.sql import functions as F

from patchloom.functions import text as T
from patchloom.sources import patches as P


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_comments(spark):
    code = 'a = "// no"; // yes\n/* b\n c */ d = \'"\'; // e'
    assert one(spark, T.remove_comments, code) == 'a = "// no"; \n d = \'"\'; '
    assert one(spark, T.code_only, code) == one(spark, T.remove_comments, code)
    assert one(spark, T.comments, code) == sorted(["// yes", "/* b\n c */", "// e"])
    assert one(spark, T.normalize, " a /* x */ b\n") == "ab" and one(spark, T.remove_comments, None) is None


def test_lines_and_macros(spark):
    assert one(spark, T.remove_empty_lines, "a\n \t\nb\n") == "a\nb\n"
    assert one(spark, T.remove_param_linebreaks, "f(a,\n   b)") == "f(a, b)"
    assert one(spark, T.del_macros, "#include <x>\n#define IN 1\nINLINE int INx(IN a) \\\n  {}") == "#include <x>\n\n int INx( a)  {}"
    assert "x(" in one(spark, lambda c: T.del_macros(c, compat=True), "int INx(IN a)")
    assert one(spark, lambda c: T.line_offset(c, F.lit(3)), "ab\nc\nd") == 4 and one(spark, lambda c: T.offset_line(c, F.lit(4)), "ab\nc\nd") == 2


def test_statement_lines_and_brackets():
    assert T.statement_lines("int a =\n  1;\nif (x\n  && y)\n#if 1\nb;") == "int a = 1;\n\nif (x && y)\n\n#if 1\nb;"
    assert T.statement_lines("a // why\n = 1;") == "a // why\n = 1;" and T.statement_lines(None) is None  # a comment ends a line
    assert T.add_brackets("if(a)bc;", [(5, 7)]) == "if(a){\nbc;}\n" and T.add_brackets("x", None) == "x"


def test_addresses(spark):
    raw = spark.createDataFrame([("C1", "https://github.com/a/b/commit/11\nhttps://github.com/a/b/commit/22#diff-x", "r"), ("C2", "https://gitlab.com/g/h/-/commit/3", None), ("C3", "https://git.ghostscript.com/?p=x.git;h=abc", None), ("C4", None, None)], P.WORK)
    got = {r[0]: tuple(r)[1:5] for r in P.work_items(raw).collect()}
    assert got["C1"] == ("a@@b", "11", "22", "github") and got["C2"] == ("g@@h", "3", "3", "gitlab")
    assert got["C3"] == ("ghostscript@@ghostscript", "abc", "abc", "ghostscript")


def test_answers(spark):
    rows = [("fenced", "hi\n```diff\n+a\n```\nbye"), ("bare", "diff --git a b\n+a"), ("bad", "```\n+a"), ("none", "no diff"), ("gone", None)]
    got = {r[0]: (r[1], r[2]) for r in P.answer_diffs(spark.createDataFrame(rows, "k string, text string"), "k").collect()}
    assert got == {"fenced": ("+a", "found"), "bare": ("diff --git a b\n+a", "found"), "bad": (None, "wrong_answer"), "none": (None, "wrong_answer"), "gone": (None, "not_found")}


def test_logs_and_formats(spark):
    logs = spark.createDataFrame([("c", "fuzz_result.md", "# aflgo\nfound at 12 sec.\n# beacon\nfound at 7 sec."), ("d", "becon_x.md", "found at 3 sec.")], "case_id string, file string, text string")
    assert sorted((r["case_id"], r["tool"], r["found_sec"]) for r in P.fuzz_events(logs, "case_id").collect()) == [("c", "aflgo", 12), ("c", "beacon", 7), ("d", "beacon", 3)]
    n = spark.createDataFrame([("aflgo-id:000077,311650,sig:06,src:000004,op:havoc,rep:64",)], "x string").select(*P.crash_name(F.col("x"))).first()
    assert tuple(n) == ("000077", 311650, 6, "000004", "havoc", 64)
    d = P.normal_diff(spark.createDataFrame([("c", "1,2c3\n< a\n< b\n---\n> c\n9d8\n< z")], "id string, text string"), "id")
    assert [(r["op"], r["old_start"], r["old_end"], r["new_start"], r["side"], r["text"]) for r in d.orderBy("pos").collect()] == [("c", 1, 2, 3, "<", "a"), ("c", 1, 2, 3, "<", "b"), ("c", 1, 2, 3, ">", "c"), ("d", 9, 9, 8, "<", "z")]
    m = P.node_mapping(spark.createDataFrame([("c", "name: f  @ 3 @ name: g  @ 5 @ ")], "id string, text string"), "id").first()
    assert (m["src_kind"], m["src_line"], m["dst_kind"], m["dst_line"]) == ("name: f", 3, "name: g", 5)
    e = spark.createDataFrame([("g", 'a "x', "b"), ("g", "b", "c")], "id string, src string, dst string")
    back = P.dot_edges(P.to_dot(e, "id").withColumnRenamed("dot", "text"), "id")
    assert sorted((r["src"], r["dst"]) for r in back.collect()) == [('a "x', "b"), ("b", "c")]


def test_call_graphs_and_files(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"pre": {"points": ["a#f"], "edges": [["a#f", "b#g", 1, 2]]}, "post": {"points": [], "edges": []}}')
    points, edges = P.call_graph(P.read_json(spark, str(tmp_path / "g.json"), P.CALL_GRAPH).withColumn("id", F.lit(1)), "id")
    assert [tuple(r)[1:] for r in points.collect()] == [("pre", "a#f")] and [tuple(r)[1:] for r in edges.collect()] == [("pre", "a#f", "b#g", 1, 2)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.diff").write_bytes("é".encode("latin-1"))
    assert P.read_texts(spark, str(tmp_path / "p")).first()["text"] == "é"
    P.write_code_tree(spark.createDataFrame([("a", "1")], "path string, text string"), str(tmp_path / "t"))
    P.write_code_tree(spark.createDataFrame([("a", "2")], "path string, text string"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).first()["text"] == "1"
    assert spark.createDataFrame([("a.C",), ("b.py",), ("c",)], "n string").where(P.allowed(F.col("n"))).count() == 1


def test_syntax_stand_ins(spark):
    code = '#include <a.h>\nint f() { /* g() */ if (x) return h(1); s("k()"); goto end; }'
    assert one(spark, T.calls, code) == ["f", "h", "s"]
    assert one(spark, T.jumps, code) == ["return h(1)"] and one(spark, lambda c: T.jumps(c, "goto"), code) == ["goto end"]
    assert one(spark, T.includes, code) == ["<a.h>"]


def test_code_tokens(spark):
    import random
    import re

    token = re.compile(r"""//.*?$|/\*.*?\*/|('(?:\\.|[^\\'])*'|"(?:\\.|[^\\"])*"|.[^/'"]*)""", re.DOTALL | re.MULTILINE)
    rng = random.Random(3)
    codes = ["a / b", "x /* open", "'", '"// in"', "", *("".join(rng.choice(["/", "*", "'", '"', "\\", "a", "\n", "/*", "*/", "//"]) for _ in range(25)) for _ in range(200))]
    got = spark.createDataFrame(list(enumerate(codes)), "i int, x string").select("i", T.code_tokens(F.col("x")).alias("t"), T.code_only(F.col("x")).alias("c")).collect()
    for r in got:
        want = [m.group(1) for m in token.finditer(codes[r["i"]]) if m.group(1)]
        assert (r["t"], r["c"]) == (want, "".join(want)), codes[r["i"]]


def test_small_source_operators(spark):
    from patchloom.operators import graph as G

    a = spark.createDataFrame([(1, "x", "t"), (1, "y", "t"), (1, "z", "u"), (2, "x", "t")], "k int, name string, text string")
    assert sorted(map(tuple, P.compare_artifacts(a, [("x", "y"), ("x", "z")], "k").collect())) == [(1, "x", "y", True), (1, "x", "z", False)]
    files = spark.createDataFrame([("r", "c1", "c2", "f", "g")], "repo string, pre_commit string, post_commit string, old_file string, new_file string")
    blobs = spark.createDataFrame([("r", "c1", "f", "old"), ("r", "c1", "g", "no")], "repo string, commit string, path string, text string")
    r = P.with_blobs(files, blobs).first()
    assert (r["old_text"], r["new_text"]) == ("old", None)
    node = "struct<file: string, method: string, lineNumber: int>"
    traces = spark.createDataFrame([(1, [[("f", "m", 3), ("g", None, 4)], []], [])], f"k int, pre array<array<{node}>>, post array<array<{node}>>")
    assert sorted(map(tuple, P.taint_nodes(traces, "k").collect())) == [(1, "pre", 0, 0, "f", "m", 3), (1, "pre", 0, 1, "g", None, 4)]
    diags = spark.createDataFrame([(1, "Error", "n", ("bad", 7)), (1, "Warning", "n", ("w", 8))], "k int, Level string, DiagnosticName string, DiagnosticMessage struct<Message: string, FileOffset: int>")
    assert [tuple(x) for x in P.errors_of(diags, "k").collect()] == [(1, "Error", "n", "bad", 7)]
    nodes = spark.createDataFrame([(1, "call", 5), (1, "call", 2), (2, "if", 1)], "id int, type string, o int")
    assert G.select_nodes(nodes, "call").count() == 2
    assert sorted(map(tuple, G.distinct_nodes(nodes, "o").collect())) == [(1, "call", 2), (2, "if", 1)]
