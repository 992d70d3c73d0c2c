import random

import pytest
from pyspark.sql import functions as F

from patchloom.operators import diff as D

PATCH = """diff --git a/x.c b/x.c
index 1..2 100644
--- a/x.c
+++ b/x.c
@@ -1,4 +1,4 @@
 int a;
-int b;
--- dropped;
+int c;
+++ raised;
 int d;
\\ No newline at end of file
@@ -10 +10 @@ f()
-old
+new
diff --git a/y.c b/y.c
--- a/y.c
+++ b/y.c
@@ -0,0 +1,2 @@
+one
+two"""


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_headers_inside_a_hunk_are_lines(spark):
    df = D.parse_diff(spark.createDataFrame([("p", PATCH), ("none", None), ("empty", "")], "id string, text string"), "id")
    got = rows(df.select("file_idx", "new_file", "side", "line_no", "text"))
    assert got == sorted([
        (1, "x.c", "delete", 2, "int b;"), (1, "x.c", "delete", 3, "-- dropped;"), (1, "x.c", "add", 2, "int c;"), (1, "x.c", "add", 3, "++ raised;"),
        (1, "x.c", "delete", 10, "old"), (1, "x.c", "add", 10, "new"), (2, "y.c", "add", 1, "one"), (2, "y.c", "add", 2, "two")], key=str)


def test_compat_takes_signs_for_headers(spark):
    df = D.parse_diff(spark.createDataFrame([("p", PATCH)], "id string, text string"), "id", compat=True).where("file_idx = 1 and line_no < 9")
    assert [r["text"] for r in df.orderBy("pos").collect()] == ["int b;", "int c;"]


def test_split_files_compat_drops_last_lines(spark):
    p = spark.createDataFrame([("p", "diff --git a\n1\n2\ndiff --git b\n3\n4")], "id string, text string")
    assert [r["section"] for r in D.split_files(p, "id").orderBy("file_idx").collect()] == ["diff --git a\n1\n2", "diff --git b\n3\n4"]
    assert [r["section"] for r in D.split_files(p, "id", compat=True).orderBy("file_idx").collect()] == ["diff --git a\n1", "diff --git b\n3\n4"]


def test_runs_partition_their_input(spark):
    rng = random.Random(1)
    data = [(k, rng.randrange(30)) for k in range(5) for _ in range(20)]
    got = D.runs(spark.createDataFrame(data, "k int, n int"), "n", "k").collect()
    for k in range(5):
        mine = sorted(n for q, n in data if q == k)
        want, last = [], None
        for n in mine:
            if last is not None and n == last + 1:
                want[-1] = (want[-1][0], n, want[-1][2] + 1)
            else:
                want.append((n, n, 1))
            last = n
        assert sorted((r["run_start"], r["run_end"], r["run_len"]) for r in got if r["k"] == k) == sorted(want)


def test_hunks_touching_the_end_do_not_pair(spark):
    one = lambda r, s: spark.createDataFrame(r, s)
    m = one([("p", 1, 1), ("p", 3, 3)], "id string, src int, dst int")
    d, a = (one([("p", s, e) for s, e in x], "id string, run_start int, run_end int") for x in ([(2, 2), (4, 4)], [(2, 2), (4, 5)]))
    assert rows(D.hunk_map(d, a, m, "id")) == [("p", 2, 2, 2, 2)]


def test_uncovered_sides(spark):
    h = spark.createDataFrame([("p", 1, 1, 5, 6)], "id string, a_start int, a_end int, b_start int, b_end int")
    n = spark.createDataFrame([("p", 1), ("p", 5)], "id string, line_no int")
    add, gone = D.unmapped(n, n, h, "id")
    assert [r[1] for r in add.collect()] == [1] and [r[1] for r in gone.collect()] == [5]
    add, gone = D.unmapped(n, n, h, "id", compat=True)
    assert [r[1] for r in add.collect()] == [5] and [r[1] for r in gone.collect()] == [1]


@pytest.mark.parametrize("seed", range(40))
def test_apply_undoes_diff(spark, seed):
    rng = random.Random(seed)
    a = [rng.choice("abcde") for _ in range(rng.randrange(12))]
    b = [x for x in a if rng.random() < 0.7] + [rng.choice("xyz") for _ in range(rng.randrange(3))]
    rng.shuffle(b)
    old, new = "\n".join(a), "\n".join(b)
    d = D.unified(old, new, 1, ignore_space=False)
    assert (d == "") == (old == new)
    if seed < 4 and d:
        p = D.parse_diff(spark.createDataFrame([(0, d)], "id int, text string"), "id")
        assert D.apply_diff(old, [(r["side"], r["line_no"], r["text"]) for r in p.collect()]) == new


def test_similarity_counts_insertions_and_deletions():
    assert D.ratio("abc", "abd") == pytest.approx(4 / 6) and D.ratio("", "") == 1.0 and D.ratio("a", "") == 0.0


def test_first_of_equal_lines_wins(spark):
    h = spark.createDataFrame([(1, ["ab", "ab"], ["zz", "ab", "ab"])], "id int, a_lines array<string>, b_lines array<string>")
    assert rows(D.match_lines(h, "id")) == [(1, 0, 1, 1.0), (1, 1, 2, 1.0)]


def test_statements_in_step(spark):
    h = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "x", "c", "d"])], "id int, a_lines array<string>, b_lines array<string>")
    got = {(r["kind"], r["a_idx"], r["b_idx"]) for r in D.map_statements(h, "id").collect()}
    assert got == {("equal", 0, 0), ("replace", 1, 1), ("equal", 2, 2), ("insert", None, 3)}


def test_map_inversion_and_back_transform(spark):
    m = spark.createDataFrame([("p", 1, 2), ("p", 3, 2), ("p", 0, 0), ("p", 4, 0)], "id string, src int, dst int")
    assert rows(D.invert_map(m, "id")) == [("p", 0, 0), ("p", 2, 3)]
    d = spark.createDataFrame([(["a", "b"], {"a": "A"})], "s array<string>, m map<string,string>")
    assert d.select(D.transform_back(F.col("s"), F.col("m"))).first()[0] == "A\nb"
