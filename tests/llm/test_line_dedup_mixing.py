import random

import pytest

from patchloom.llm import line_dedup, mixing


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(docs, least=line_dedup.MIN_NEAR_CHARS):
    seen, out = [], {}
    for d, t in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        if t is None:
            out[d] = None
            continue
        keep = []
        for line in t.split("\n"):
            if line.strip(" \t\r\f\v") == "":
                keep.append(line)
                continue
            if line not in seen and not (len(line) >= least and any(len(s) >= least and near(s, line) for s in seen)):
                keep.append(line)
            seen.append(line)
        out[d] = "\n".join(keep)
    return out


def random_docs(seed, n=40):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([5, 19, 20, 21, 33, 64, 65, 100]))) for _ in range(12)]
    docs = []
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(6)):
            s = rng.choice(base)
            for _ in range(rng.randrange(3)):
                p = rng.randrange(len(s) + 1)
                s = rng.choice([s[:p] + "x" + s[p:], s[:p] + s[p + 1 :], s[:p] + "y" + s[p + 1 :]])
            lines.append(s)
        docs.append((i * 3, rng.choice(["\n", "\n\n"]).join(lines)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_brute_force(spark, seed):
    docs = [*random_docs(seed), (900, None), (901, ""), (None, "last one of all, long enough to count")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs)


def test_long_single_line_and_clashing_columns(spark):
    s = "".join(random.Random(3).choice("abcdefgh") for _ in range(5000))
    docs = spark.createDataFrame([(1, s, 7, 1), (2, s[:2500] + "!" + s[2500:], 7, 1), (3, s[:100] + s[102:], 7, 1)], "doc_id long, text string, n_lines int, _x int")
    got = {r["doc_id"]: (r["text"] == "", r["n_removed"], r["_x"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: (False, 0, 1), 2: (True, 1, 1), 3: (False, 0, 1)}


def test_exact_only_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a\na"), (1, "a\na"), (2, "a\nb")], "doc_id long, text string")
    assert sorted(r["text"] for r in line_dedup.dedup_lines(docs, max_edits=0).collect()) == ["a", "a", "b"]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(docs, max_edits=2)
    kept = line_dedup.stage(spark, spark.createDataFrame([(1, "a b"), (2, "a b"), (3, ""), (4, None)], "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def fill(sizes, share=1.5, most=2.0, cycle=(5, 2, 1)):
    """Targets by repeated sharing: what is above a cap is given to the others by weight until none is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        t = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if t[s] > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] for s in capped} | t
        capped |= over


def test_mix(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice(["a", "a", "b", "é", "Z", "z", None]), " ".join(["w"] * rng.randrange(1, 40))) for i in range(900)]
    docs += [(1000, "a", None), (1001, "b", " \t\n"), (None, "b", "one two")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = mixing.mix(df).collect()
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(df.repartition(7)).collect()}
    assert len(got) == len(docs) and {(r["doc_id"], r["taken"]) for r in got} == again
    sizes, taken = {}, {}
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    want = fill(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s in want:
        assert abs(taken[s] - want[s]) <= 20


def test_mix_by_weight_and_empty(spark):
    df = spark.createDataFrame([(i, "s" if i % 2 else "t", "a b c d", 9.0 if i < 100 else 1.0) for i in range(1000)], "doc_id long, source string, text string, q double")
    got = mixing.mix(df, share=0.5, weight="q").collect()
    top = sum(r["taken"] for r in got if r["doc_id"] < 100) / sum(r["taken"] for r in got)
    assert top > 0.25
    assert mixing.mix(df.limit(0)).count() == 0
    none = mixing.mix(spark.createDataFrame([(1, "s", "")], "doc_id long, source string, text string")).first()
    assert (none["taken"], none["target"]) == (0, 0.0)
