"""Scorers, ranks and the closure of classes, against plain rules."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from patchloom.operators import ranking as R
from patchloom.operators import syntax as Q


def test_scorers():
    a = pa.array(["the big cat sat", "", "a b a b", "x"])
    assert R.shared_words(a, pa.array(["the cat", "", "B b A", "y z"])).tolist() == [0.5, 0.0, 1.0, 0.0]
    assert R.common_runs(a, pa.array(["big cat the", "a", "b a c", "x"])).tolist() == [0.5, 0.0, 0.5, 0.0]


def test_in_step_against_all_choices():
    rng = random.Random(2)
    for _ in range(150):
        text = " ".join(rng.choice("abcd") for _ in range(rng.randrange(6)))
        steps = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(3))) for _ in range(rng.randrange(5))]
        places = [[None, *(p for p, w in enumerate(text.split()) if w in s.split())] for s in steps]
        best = max((sum(p is not None for p in c) for c in itertools.product(*places) if all(x < y for x, y in itertools.pairwise([p for p in c if p is not None]))), default=0)
        assert R.in_step(pa.array([text]), pa.array([steps], pa.list_(pa.string()))).tolist() == [best / len(steps) if steps else 0.0]


def test_ranks_of_sequences_and_own_scorers(spark):
    rows = [(1, i, "open then read then close", s) for i, s in enumerate([["f close", "g open"], ["open", "read", "close"], [], None, ["read", "x"]])] + [(2, 0, None, ["a"])]
    df = spark.createDataFrame(rows, "k int, i int, asked string, steps array<string>")
    got = {(r["k"], r["rank"]): (r["i"], r["score"]) for r in R.ranked(df, "asked", "steps", "i", "k", scorer=R.in_step).collect()}
    assert got == {(1, 1): (1, 1.0), (1, 2): (0, 0.5), (1, 3): (4, 0.5), (1, 4): (2, 0.0), (1, 5): (3, 0.0), (2, 1): (0, 0.0)}

    def length(_, steps):
        n = steps.to_pandas().map(len).to_numpy().astype(float)
        return np.where(n == 0, np.nan, -n)

    mine = {(r["k"], r["rank"]): (r["i"], r["score"]) for r in R.ranked(df, "asked", "steps", "i", "k", scorer=length).collect()}
    assert mine[(1, 1)] == (0, -2.0) and mine[(1, 4)] == (2, None)
    with pytest.raises(ValueError, match="key"):
        R.ranked(df, "asked", "steps", "i")


def test_supertypes(spark):
    closure = {(r["type"], r["super"]) for r in Q.supertypes(Q.lattice(spark)).collect()}
    direct = {}
    for kind, *ups in map(str.split, Q.LATTICE.strip().splitlines()):
        direct[kind] = ups

    def up(kind):
        return {kind}.union(*(up(x) for x in direct.get(kind, [])))

    assert closure == {(k, s) for k in [*direct, "NODE"] for s in up(k)} and len(direct) == 41
    nodes = spark.createDataFrame([(1, "CALL"), (2, "METHOD_PARAMETER_IN"), (3, "TYPE"), (4, None), (5, "OTHER")], "id int, type string")
    of = lambda *t: {r["id"] for r in Q.of_supertype(nodes, Q.supertypes(Q.lattice(spark)), *t).collect()}
    assert of("CFG_NODE") == {1, 2} and of("DECLARATION", "CALL_REPR") == {1, 2} and of("NODE") == {1, 2, 3} and of() == set()
    cycle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "type string, extends string")
    assert {tuple(r) for r in Q.supertypes(cycle).collect()} == set(itertools.product("abc", "abc"))
