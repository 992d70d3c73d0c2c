import itertools
import random

import pytest
from pyspark.sql import functions as F

from patchloom.operators import graph as G
from patchloom.operators import merge as M
from patchloom.operators import metrics as E


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def nodes_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def brute_paths(pairs, starts, stops):
    out, nxt = set(), {}
    for a, b in pairs:
        nxt.setdefault(a, set()).add(b)

    def walk(path):
        if path[-1] in stops:
            out.add(tuple(path))
            return
        for b in nxt.get(path[-1], ()):
            if b not in path:
                walk([*path, b])

    for s in starts:
        walk([s])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_simple_paths(spark, seed):
    rng = random.Random(seed)
    names = "abcdefg"
    pairs = [p for p in itertools.permutations(names, 2) if rng.random() < 0.25] + [("a", "a")]
    e = edges_of(spark, pairs)
    got = {tuple(r[0]) for r in G.simple_paths(e, nodes_of(spark, "ab"), nodes_of(spark, "fg")).collect()}
    want = brute_paths(pairs, "ab", "fg")
    assert got == want
    got = {tuple(r[0]) for r in G.simple_paths(e, nodes_of(spark, "ab"), nodes_of(spark, "fg"), through="d").collect()}
    assert got == {p for p in want if "d" in p}


def test_ends_reach_and_lines(spark):
    e = spark.createDataFrame([("pre", "a", "b", 2, 1), ("pre", "a", "b", 1, 1), ("pre", "b", "a", 1, 1), ("pre", "c", "d", 1, 2)], "version string, src string, dst string, src_line int, tgt_line int")
    g = G.build_graph(e, "version")
    assert g.where("src = 'a'").first()["pairs"] == [(1, 1), (2, 1)]
    lone = spark.createDataFrame([("pre", "z")], "version string, node string")
    assert sorted((r["node"], r["is_source"], r["is_sink"]) for r in G.ends(lone, e, "version").collect()) == [("c", True, False), ("d", False, True), ("z", True, True)]
    assert {r["node"] for r in G.reach(e, nodes_of(spark, "b")).collect()} == {"a", "b"}
    assert {r["node"] for r in G.reach(e, nodes_of(spark, "d"), directed=False).collect()} == {"c", "d"}
    p = G.paths_with_lines(spark.createDataFrame([(["a", "b"],)], "node_path array<string>"), g).first()
    assert p["edge_path"][0]["callee"] == "b" and len(p["edge_path"][0]["source_tgt_pairs"]) == 2
    assert G.touching(e, nodes_of(spark, "a")).count() == 3


def test_pagerank_sums_to_one(spark):
    r = {x["node"]: x["rank"] for x in G.pagerank(edges_of(spark, [("a", "b"), ("b", "c"), ("a", "c")]), rounds=15).collect()}
    assert sum(r.values()) == pytest.approx(1.0) and r["c"] > r["b"] > r["a"]


def test_merge(spark):
    s = spark.createDataFrame([("k", 1, "x\n+a\n+a\ny"), ("k", 2, "x\n-b\n+a\ny\n+c"), ("k", 3, "x\ny"), ("k", 4, "+z\nq"), ("k", 5, None)], "k string, s int, text string")
    got = {(r["first_snippet"], r["n_snippets"], r["merged"]) for r in M.merge_snippets(s, "k", "s").collect()}
    assert got == {(1, 2, "x\n+a\n-b\n+a\ny\n+c"), (4, 1, "+z\nq")}
    kept = M.merge_snippets(s, "k", "s", keep_unmarked=True)
    assert {r["n_snippets"] for r in kept.collect()} == {3, 1}
    again = M.merge_snippets(spark.createDataFrame([("k", 1, "x\n+a\n-b\ny")], "k string, s int, text string"), "k", "s").first()["merged"]
    assert again == "x\n+a\n-b\ny"


def test_recover_and_faults(spark):
    rows = spark.createDataFrame([(1, ["a"], ["b", "c", "d"]), (2, ["x"], [" "] * 9), (3, None, None)], "k int, base array<string>, pool array<string>")
    got = {r["k"]: (r["recovered"], r["used"]) for r in M.recover(rows, lambda t: "c" in t, "k").collect()}
    assert got == {1: (True, 2), 2: (False, 5), 3: (False, 0)}
    d = spark.createDataFrame([(1, 0, "Warning", "n", "w"), (1, 1, "Error", "n", "use of undeclared identifier 'MAX_1'"), (1, 2, "Error", "n", "skip"), (1, 3, "Error", "n", "bad")], "k int, o int, level string, name string, message string")
    assert M.first_fault(d, spark.createDataFrame([("skip",)], "message string"), "o", "k").first()["message"] == "bad"


def test_metrics_edges(spark):
    s = spark.createDataFrame([(1, ["a", "a"], ["a"]), (2, None, []), (3, ["x"], ["y", "z"])], "k int, p array<string>, t array<string>")
    c = {r["k"]: tuple(r)[1:] for r in E.set_counts(s, "p", "t", "k").collect()}
    assert c == {1: (1, 0, 0, True), 2: (0, 0, 0, True), 3: (0, 1, 2, False)}
    t = spark.createDataFrame([("f", 10.0, 5.0), ("f", -1.0, 7.0), ("f", float("nan"), None)], "fam string, a double, b double")
    r = E.time_to_event(t, "fam", "a", "b").first()
    assert (r["n"], r["n_both"], r["mean_a"], r["rate_a"], r["rate_b"], r["time_change"]) == (3, 1, 10.0, 1 / 3, 2 / 3, 0.5)
    a = spark.createDataFrame([(2, 1.0), (1, 1.0), (3, 0.5)], "n int, f double")
    assert tuple(E.argmax_first(a, "f", "n").first()) == (1, 1.0)
    k = spark.createDataFrame([("d", 1, "fix buffer overflow", "buffer overflow here"), ("d", 2, "fix buffer overflow", "docs")], "k string, id int, q string, x string")
    assert [r["id"] for r in E.rank_by_overlap(k, "q", "x", "id", "k").orderBy("rank").collect()] == [1, 2]
    x = spark.createDataFrame([(["src/f.c"], ["a/f.c"])], "p array<string>, t array<string>")
    assert x.select(E.covered(F.col("p"), F.col("t"))).first()[0]


def test_orders_graph_holds_all_orders(spark, tmp_path):
    from patchloom.plans import bindings

    orders = [(1, 7, 1500.0), (2, 8, 90_000.0), (3, 8, 400_000.0), (4, 15, 50_000.0), (5, 9, 1900.0)]
    lines = [(1, 11), (2, 11), (3, 22), (4, 33), (5, 44), (5, 44)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    sf = f"file://{tmp_path}"
    assert {r["node"] for r in bindings.graph_component(spark, sf).collect()} == {"s11", "c7", "c8", "s22"}
    assert {tuple(r) for r in bindings.graph_filter(spark, sf).collect()} == {("c15", "s33")}
