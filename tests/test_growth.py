"""That what one task sorts or gathers does not grow with the tables."""

from pyspark.sql import functions as F


def test_rows_are_dealt_by_their_number(spark):
    from patchloom.session import dealt

    sizes = lambda n: [r["count"] for r in dealt(spark.range(n), "id", rows=100).groupBy(F.spark_partition_id()).count().collect()]
    small, large = sizes(1000), sizes(8000)
    assert sum(small) == 1000 and sum(large) == 8000
    assert len(small) == 10 and len(large) == 80 and max(large) < 200
    assert sizes(0) == []


def test_order_lines_are_gathered_where_they_are_dealt(spark):
    """mixed_answers, mixed_call_graphs: no aggregation before the shuffle, whose sort a file's part would bound."""
    from patchloom.plans.varied_bindings import mixed_answers

    plan = mixed_answers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(plan) if "Exchange" in x)
    assert "REPARTITION_BY_NUM" in plan[at] and not any("Aggregate" in x for x in plan[at:])


def test_marks_of_patterns_are_bits(spark):
    """tree_patterns: no row carries arrays that each pattern searches, and a pattern of n children takes two passes less."""
    from patchloom.operators import syntax as Q
    from patchloom.plans.syntax_bindings import TREE_QUERY

    n = spark.createDataFrame([(1, 8, None, None, "O", 0, 9), (1, 9, 8, "status", "R", 1, 2), (1, 10, 8, None, "N", 2, 3)], "doc int, id int, parent int, field string, type string, start_byte int, end_byte int")
    plan = Q.query(n, TREE_QUERY, "doc")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and "filter(" not in plan and sum(x.lstrip(":+- ").startswith("Window ") for x in plan.splitlines()) == 4


def test_more_patterns_than_bits_of_a_word(spark):
    """Patterns beyond 62 and beyond 124, with children and as choices, capture what they do alone."""
    from patchloom.operators import syntax as Q

    rows = [(1, 1, None, None, "t", 0, 9)] + [(1, 2 + i, 1, None, f"k{i}", i, i + 1) for i in range(80)]
    n = spark.createDataFrame(rows, "doc int, id int, parent int, field string, type string, start_byte int, end_byte int")
    kids = " ".join(f"(t (k{i}) @c{i})" for i in range(80))
    got = {(r["capture"], r["id"]) for r in Q.query(n, kids + " [(k3) (t (k5) (k70))] @some (k9) @one (t (k7) (k6) @never)", "doc").collect()}
    assert got == {(f"c{i}", 2 + i) for i in range(80)} | {("some", 5), ("some", 1), ("one", 11)}


def test_words_are_encoded_many_at_once():
    """op2_sentence_pieces: one call of the model for many words, words with line feeds of their own by themselves."""
    import numpy as np
    import pytest

    pytest.importorskip("sentencepiece")
    pytest.importorskip("public_tokenizers")
    from patchloom.llm import sentence_pieces as S

    model, calls = S.Pieces(S.model_path(), S.ALPHA), []
    texts = ["some words\nand\n\nlines \n of  them", None, "", "\n", "x" * 300 + " ﬁ ä \U0001f600\ud800 z", " ".join(f"w{i}a" for i in range(300))]

    class Counted:
        def encode(self, lines, **o):
            calls.append(len(lines))
            return plain.encode(lines, **o)

    plain, model.sp = model.sp, Counted()
    want = [plain.encode((t or "").encode("utf-8", "replace").decode()) for t in texts]
    got = S.encode(model, [t.replace("\ud800", "?") if t else t for t in texts])
    assert [x.tolist() for x in got] == want and sum(calls) < 40
    model.joined[model.pair(np.array([ord("d")], np.uint32), np.array([10], np.uint32))] = True  # a word of several characters with a line feed
    again = S.encode(model, [t.replace("\ud800", "?") if t else t for t in texts])
    assert [x.tolist() for x in again] == want


def test_queries_copy_no_rows_they_are_compared_with():
    """op6_lsh_search: all near rows of the visited buckets come from products of many queries at once."""
    import numpy as np
    import pytest

    pytest.importorskip("patchloom.llm.lsh_search")
    from patchloom.llm import lsh_search as L

    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((900, 8)), rng.standard_normal((L.STEP + 40, 8))
    x[7], q[5] = np.inf, 0.0
    size = np.array([300, 1, 299, 200, 100])
    visited = rng.random((len(q), len(size))) < 0.6
    visited[3], visited[4] = False, [False, True, False, False, False]
    visits, copied = [np.flatnonzero(v).tolist() for v in visited], []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if self.shape == (900, 8):
                copied.append(at)
            return super().__getitem__(at)

    with np.errstate(invalid="ignore"):
        bad = [r.tolist() for r in L.close(q, x, visits, size, 20)]
    assert bad == [np.flatnonzero(np.repeat(v, size)).tolist() for v in visited]
    x[7] = 0.5
    got = [r.tolist() for r in L.close(q, x.view(Watched), visits, size, 20)]
    assert copied == [] and len(got) == len(q)
    for i, near in enumerate(got):
        rows = np.flatnonzero(np.repeat(visited[i], size))
        products = x[rows] @ q[i]
        assert set(rows[np.argsort(-products)[:20]]) <= set(near) <= set(rows)
        assert i == 5 or len(near) == min(20, len(rows))


def test_unmapped_lines_are_shuffled_once(spark):
    """unmapped_lines: orders are dealt out once, and no join, union or second shuffle follows."""
    from patchloom.plans.bindings import unmapped_lines

    plan = unmapped_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "Join" not in plan and "Union" not in plan


def test_unpaired_lines_are_those_of_no_hunk(spark):
    """unpaired() against runs, pivots, hunks and unmapped(), on texts of both sides; a text without a key pairs nothing."""
    import random

    from patchloom.operators import diff as D

    rng, rows = random.Random(8), []
    for k in [None, *range(60)]:
        for side in ("delete", "add"):
            rows += [(k, side, n, rng.choice((True, False, False, None) if k == 5 else (True, False))) for n in range(1, 1 + rng.randrange(12))]
    lines = spark.createDataFrame(rows, "k int, side string, line_no int, changed boolean")
    old, new = (lines.where(F.col("side") == s) for s in ("delete", "add"))
    gone, added = (x.where("changed").select("k", "line_no") for x in (old, new))
    m = D.line_map(D.context_pivot(old, gone, "k"), D.context_pivot(new, added, "k"), "k").where("k is not null")
    a, d = D.unmapped(added, gone, D.hunk_map(D.runs(gone, "line_no", "k"), D.runs(added, "line_no", "k"), m, "k"), "k")
    want = [(r["k"], s, r["line_no"]) for x, s in ((d, "delete"), (a, "add")) for r in x.collect()]
    got = [tuple(r) for r in D.unpaired(lines, "k").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and 100 < len(got) < sum(1 for r in rows if r[3])


def test_short_flows_are_those_of_long_ones(spark, monkeypatch):
    """flow_to_returns, flow_to_same_name: paths are carried, in one checkpoint a round, and are those found backwards."""
    import random

    from patchloom.operators import flows as W

    rng = random.Random(4)
    e = spark.createDataFrame([(k, rng.randrange(14), rng.randrange(14)) for k in range(6) for _ in range(30)], "k int, src int, dst int")
    ends = lambda: spark.createDataFrame([(k, x) for k in range(6) for x in rng.sample(range(14), 5)], "k int, node int")
    a, z, cut, made = ends(), ends(), W.checkpointed, []
    monkeypatch.setattr(W, "checkpointed", lambda df: made.append(1) or cut(df))
    got = sorted(map(tuple, W.flows(e, a, z, "k", hops=4, prune=False).collect()))
    assert len(made) == 5
    monkeypatch.setattr(W, "EVERY", 2)
    assert got == sorted(map(tuple, W.flows(e, a, z, "k", hops=4, prune=False).collect())) and max(r[3] for r in got) == 4


def test_captures_meet_their_code_without_a_join(spark, tmp_path):
    """syntax_captures: no table of code is broadcast or joined; parts of one key and equal parts are each captured alone."""
    from patchloom.plans.syntax_bindings import syntax_captures

    rows = [(10, 5), (10, 5), (10, 77), (4, 3)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = syntax_captures(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    want = [(10, c, t) for z in (5, 5, 77) for c, t in (("condition", f"if (x) a = {z};\nelse b();"), ("assigned", f"a = {z}"), ("called", "b"), ("tested", "(x)"), ("otherwise", "b();"))]
    want += [(4, "condition", "if (u) break;"), *((4, "called", x) for x in ("f3", "s", "v"))]
    assert sorted(map(tuple, got.collect())) == sorted(want)
