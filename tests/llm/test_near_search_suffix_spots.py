import hashlib
import random

import numpy as np
import pytest

from patchloom.llm import lsh_search, near_dedup, spot_signatures, suffix_dedup
from patchloom.llm.components import components
from patchloom.llm.shingles import exact_shingles, shingles


def words(rng, n, prefix="w"):
    return [f"{prefix}{rng.randrange(5000)}" for _ in range(n)]


def classes(texts):
    """Least id reachable over pairs of likeness 0.8 or more; texts without words stay alone."""
    first, h, c = shingles([t for _, t in texts])
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    part = [(h[first[i] : first[i + 1]], c[first[i] : first[i + 1]]) for i in range(len(texts))]
    for i in range(len(texts)):
        for j in range(i):
            if near_dedup.likeness(part[i], part[j]) >= 0.8 - 1e-9:
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return {texts[i][0]: texts[find(i)][0] for i in range(len(texts))}


def test_near_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SKETCHES", 16)
    monkeypatch.setattr(near_dedup, "TEXTS", 8)
    rng = random.Random(1)
    docs = []
    for f in range(6):
        base = words(rng, 120, f"f{f}x")
        for _ in range(25):
            t = list(base)
            for _ in range(rng.randrange(8)):
                t[rng.randrange(len(t))] = f"new{rng.randrange(10**6)}"
            docs.append(" ".join(t))
    docs += ["short one", "short one", "SHORT  one", "", None, " \n", "rep eat rep eat rep eat " * 30, "rep eat rep eat rep eat " * 29]
    texts = list(enumerate(docs))
    got = near_dedup.near_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["_k"]: r["class_id"] for r in got} == classes(texts)


def thue_morse(n, swap=False):
    return "".join("ab"[(i.bit_count() + swap) % 2] for i in range(n))


def test_words_are_told_apart(spark):
    """Polynomials modulo 2 ** 64 give these two words one value; hashes and comparisons must not."""
    a, b = thue_morse(2048), thue_morse(2048, True)
    _, h, _ = shingles([a, b])
    assert h[0] != h[1]
    assert near_dedup.alike([a, b, a], np.arange(3))[0].tolist() == [0]
    first, names, count = exact_shingles(["a b c d e f a b c d e", "A b c d e", "x", "", None, a, b])
    assert first.tolist() == [0, 6, 7, 8, 8, 8, 9, 10] and count.tolist() == [2, 1, 1, 1, 1, 1, 1, 1, 1, 1]
    assert names[0] == names[6] and len(set(names[6:].tolist())) == 4


def test_large_family_equals_brute_force(spark):
    """3000 near copies of one short text, many of them less than 0.8 alike, and as many blocks as the defaults give."""
    rng = random.Random(7)
    base, docs = words(rng, 60), []
    for _ in range(3000):
        t = list(base)
        for _ in range(rng.randrange(6)):
            t[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        docs.append(t)
    sets = [{tuple(t[i : i + 5]) for i in range(56)} for t in docs]
    index = {}
    column = np.array([index.setdefault(s, len(index)) for x in sets for s in x])
    row = np.repeat(np.arange(3000), [len(x) for x in sets])
    size = np.bincount(row)
    common = np.zeros((3000, 3000), np.float32)
    for c in range(0, len(index), 4096):
        m = np.zeros((3000, 4096), np.float32)
        here = (column >= c) & (column < c + 4096)
        m[row[here], column[here] - c] = 1
        common += m @ m.T
    near = common / (size[:, None] + size[None, :] - common) >= 0.8 - 1e-6
    label = np.arange(3000)
    while ((new := np.array([label[r].min() for r in near])) != label).any():
        label = new
    got = near_dedup.near_classes(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string"))
    assert {r["_k"]: r["class_id"] for r in got.collect()} == dict(enumerate(label.tolist()))


def test_near_classes_ignore_clashing_columns(spark):
    t = " ".join(words(random.Random(3), 60))
    docs = spark.createDataFrame([(1, t, "mine", "a"), (2, t, "x", "b"), (2, t, "x", "b"), (None, t, "y", "c")], "doc_id long, text string, _k string, class_id string")
    assert sorted((r["_k"], r["class_id"]) for r in near_dedup.near_classes(docs).collect()) == [(1, 1), (2, 1), (2, 1), ((1 << 63) - 1, 1)]
    out = near_dedup.stage(spark, docs, "")
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, t, "mine", "a")]


def test_likeness_and_estimate():
    a, b = (np.array([1, 2, 3], np.uint64), np.array([1, 1, 2])), (np.array([2, 3, 4], np.uint64), np.array([1, 4, 1]))
    want = 0.0
    x, y = {1: 1, 2: 1, 3: 2}, {2: 1, 3: 4, 4: 1}
    for i in (2, 3):
        want += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in (1, 2, 3, 4))
    assert near_dedup.likeness(a, b) == pytest.approx(want)
    rng = np.random.default_rng(0)
    one, two = rng.integers(1, 1 << 60, 400).astype(np.uint64), rng.integers(1, 1 << 60, 100).astype(np.uint64)
    h = np.concatenate([np.sort(one), np.sort(np.concatenate([one[:300], two]))])
    sig = near_dedup.signatures(np.array([0, 400, 800]), h, np.ones(800, np.int64), 2000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(0.6, abs=0.05)


def test_stage_keeps_one_of_a_class(spark):
    t = " ".join(words(random.Random(2), 60))
    docs = spark.createDataFrame([(5, t, "b"), (5, t, "b"), (9, t, "a"), (7, "", "c"), (8, "", "c"), (10, None, "c")], "doc_id long, text string, source string")
    assert sorted(r["doc_id"] for r in near_dedup.stage(spark, docs, "").collect()) == [5, 7, 8, 10]
    assert near_dedup.near_classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("finish", [1 << 20, 4, 0])
def test_components(spark, monkeypatch, finish):
    from patchloom.llm import components as module

    monkeypatch.setattr(module, "FINISH", finish)
    links = spark.createDataFrame([(5, 9), (9, 2), (7, 7), (None, 3), (11, 12), (2, 5)] + [(i, i + 1) for i in range(100, 112)], "a long, b long")
    got = {r["id"]: r["comp"] for r in components(links).collect()}
    assert got == {2: 2, 5: 2, 9: 2, 11: 11, 12: 11} | {i: 100 for i in range(100, 113)}


def test_search_equals_brute_force_where_it_must(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((5, 16))
    v = np.concatenate([centres[rng.integers(0, 5, 400)] + 0.05 * rng.standard_normal((400, 16)), rng.standard_normal((400, 16))])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(2000 + i, [float(x) for x in v[0]]) for i in range(50)]
    rows += [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] + [1.0] * 15), (3060, [None] + [1.0] * 15), (3080, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = lsh_search.search(df, df.where("vec_id % 20 = 0"), k=10).collect()
    good = [(i, np.array(r)) for i, r in rows if i < 3000]
    ids, x = np.array([i for i, _ in good]), np.array([r for _, r in good])
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = np.zeros(len(x))
        for j in range(16):
            s += x[ids == q][0][j] * x[:, j]
        order = np.lexsort((ids, -s))
        order = order[ids[order] != q][:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        score = dict(zip(ids.tolist(), s.tolist(), strict=True))
        assert all(score[v_] == sc for _, v_, sc in mine)
        assert [m[1] for m in mine] == [v_ for v_, _ in sorted(((m[1], m[2]) for m in mine), key=lambda z: (-z[1], z[0]))]
        hit += len({m[1] for m in mine} & set(ids[order].tolist()))
        total += 10
    assert {r["query_id"] for r in out} == set(ids[ids % 20 == 0].tolist()) and hit / total >= 0.9
    few = lsh_search.search(df.where("vec_id < 5"), df.where("vec_id = 0"), k=10).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert lsh_search.search(df.limit(0), df.limit(0)).count() == 0


def nearest(rows, k):
    """Each query's k nearest of its own length, by brute force."""
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q and len(y) == len(x))
            out[q] = [(i, -v) for v, i in s[:k]]
    return out


def test_search_in_blocks_and_parts(spark, monkeypatch):
    """Many blocks and parts, ties at the last rank, rows of another length, clashing columns."""
    monkeypatch.setattr(lsh_search, "BLOCK", 40)
    monkeypatch.setattr(lsh_search, "QUERIES", 4)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(300)]
    rows = [(i, v if any(v) else [1.0] * 6) for i, v in rows] + [(400 + i, [float(x) for x in rng.integers(1, 4, 3)]) for i in range(100)]
    df = spark.createDataFrame([(i, v, "mine", i) for i, v in rows], "vec_id long, embedding array<double>, bucket string, block int")
    got = {}
    for r in lsh_search.search(df, df.where("vec_id % 20 = 0"), k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = nearest(rows, 10)
    assert got.keys() == want.keys()
    assert all(got[q] == want[q] for q in want if q >= 400)
    assert all(v == sorted(v, key=lambda x: (-x[1], x[0])) and len(v) == 10 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_search_takes_large_vectors(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(30)] + [(100, [1e200, 1e200]), (101, [-1e200, 1.0])]
    got = lsh_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame([rows[0], rows[30]], "vec_id long, embedding array<double>"), k=3).collect()
    mine = {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 100)}
    assert mine[0] == [(100, 2e200), (29, 31.0), (28, 30.0)]
    assert mine[100] == [(29, 3.1e201), (28, 3e201), (27, 2.9e201)]


def test_shape_follows_the_number_of_vectors():
    shapes = [lsh_search.shape(n) for n in (0, 1000, 99_999, 100_000, 10**6, 10**9, 10**12)]
    assert shapes[0] == shapes[2] == (4, 16) and [f for f, _ in shapes] == sorted(f for f, _ in shapes) and all(s**f <= lsh_search.BUCKETS for f, s in shapes)


def brute_suffix(rows, least=100):
    seen, out = set(), {}
    for d, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if b[i : i + least] in seen:
                cover[i : i + least] = b"\1" * least
            seen.add(b[i : i + least])
        spans = sum(1 for i in range(len(b)) if cover[i] and not (i and cover[i - 1]))
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out[d] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("group", [20_000, 2])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdé ") for _ in range(300))
    docs = []
    for i in range(40):
        own = "".join(rng.choice("xyzuv ") for _ in range(rng.randrange(200)))
        a, b = sorted((rng.randrange(300), rng.randrange(300)))
        docs.append((i * 2, own + passage[a:b] + own[: rng.randrange(150)]))
    docs += [(500, "a" * 700), (501, "ab" * 300), (502, None), (503, ""), (504, "a" * 99), (505, "a" * 100)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute_suffix(docs)


def test_suffix_dedup_odd_rows(spark):
    rng = random.Random(6)
    t = "q" * 5 + "".join(rng.choice("abcdefgh") for _ in range(150))
    docs = spark.createDataFrame([(None, t, 1), (-3, t, 1), (-3, t, 1), (4, "x" + t, 1)], "doc_id long, text string, n_spans int")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_removed"]) for r in suffix_dedup.remove_repeats(docs, keep_bytes=True).collect())
    assert got == [((False, -3), 0), ((False, -3), 0), ((False, 4), len(t)), ((True, 0), len(t))]
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def spots_of(t):
    """A text's signatures by a walk over its words: chains after anchors, and stretches that no anchor reaches."""
    low = "".join(ch if ch.isalnum() else " " for ch in t.lower()).split()
    out, rest, since = set(), [[]], None
    for i, w in enumerate(low):
        if w in spot_signatures.ANCHORS:
            out.add((w, *[x for x in [*low[i + 1 :], "", ""] if x not in spot_signatures.ANCHORS][: spot_signatures.CHAIN]))
            since = 0
            rest.append([])
        else:
            since = None if since is None else since + 1
            if since is None or since > spot_signatures.CHAIN:
                rest[-1].append(w)
    for r in rest:
        if len(r) >= spot_signatures.WORDS:
            out |= {" ".join(r[i : i + 2]) for i in range(len(r))}
        for s in [" ".join(r)] * (0 < len(r) < spot_signatures.WORDS) + [w for w in r if len(w) > spot_signatures.LONG] * (len(r) >= spot_signatures.WORDS):
            x = [s[i : i + 3] for i in range(len(s) - 2)] or [s]
            out |= {y for i, y in enumerate(x) if (i == 0 or x[i - 1] >= y) and (i + 1 == len(x) or x[i + 1] > y)}
    return out or {()}


def test_spots(spark):
    from pyspark.sql import functions as F

    sets = spots_of
    rng = random.Random(7)
    vocabulary = ["the", "of", "and", "la", "der", "más", "für", *(f"c{i}é" for i in range(30))]
    docs = [(i * 7, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(60)] + [(1000, None), (1001, ""), (1002, "The the THE"), (1003, "ab🎉cd\n" * 9)]
    got = {r["doc_id"]: r for r in spot_signatures.compare_edited(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    order = sorted(docs, reverse=True)
    like = lambda a, b: len(a & b) / len(a | b)
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(sets(t), sets(edited))) and r["near_next"] == pytest.approx(like(sets(t), sets(nxt)))
        assert len(r["fingerprint"].split()) == len(sets(t))
    lone = spark.createDataFrame([(None, "x y the a b c d e f")], "doc_id long, text string")
    assert spot_signatures.compare_edited(lone).first()["near_next"] == 1.0
    assert spot_signatures.compare_edited(lone.limit(0)).count() == 0
    s = spark.createDataFrame(docs, "id long, text string").select("id", spot_signatures.signatures(F.col("text")).alias("signature"))
    found = spot_signatures.similar_to(s.withColumnRenamed("id", "query_id"), s.withColumnRenamed("id", "doc_id"), 0.3).collect()
    texts = {d: sets(t or "") for d, t in docs}
    assert {(r[0], r[1]) for r in found} == {(a, b) for a in texts for b in texts if like(texts[a], texts[b]) >= 0.3}


def test_texts_without_anchors_keep_their_likeness(spark):
    """Chinese, Russian and marks: one more character at the end leaves most signatures; other texts share few."""
    pairs = [("今天天气很好我们去公园散步吧", "今天天气很好我们去公园散步吧啊"), ("Быстрая лиса прыгает через ленивую собаку", "Быстрая лиса прыгает через ленивую собаку!а"), ("हिन्दी में लिखा", "हिन्दी में लिखाई"), ("今天天气很好我们去公园散步吧", "机器学习模型需要大量训练数据"), ("ab", "ab "), ("", None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(spot_signatures.likeness(spot_signatures.signatures(df["a"]), spot_signatures.signatures(df["b"]))).collect()]
    assert all(x > 0.5 for x in got[:3]) and got[3] == 0.0 and got[4:] == [1.0, 1.0]


def test_one_spot_more_leaves_the_rest(spark):
    """Texts without anchors, with one sentence that has some: most signatures stay, and an edited third leaves the others."""
    rng = random.Random(4)
    chinese = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(900))
    clauses = ",".join(chinese[i : i + 9] for i in range(0, 900, 9))
    english = " ".join("".join(rng.choice("bcdfghklmnprstvw") for _ in range(6)) for _ in range(150))
    pairs = [(t, t + more) for t in (chinese, clauses, english) for more in (" the big cat", ". The company announced results.")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert all(r[0] > 0.9 for r in df.select(spot_signatures.likeness(spot_signatures.signatures(df["a"]), spot_signatures.signatures(df["b"]))).collect())
    docs = spark.createDataFrame(list(enumerate(x for p in pairs for x in p)), "doc_id long, text string")
    assert all(r["near_edited"] > 0.25 for r in spot_signatures.compare_edited(docs).collect())
    long = spark.createDataFrame([(1, english * 300), (2, clauses * 300)], "doc_id long, text string")
    assert {r["n_chars"] for r in spot_signatures.compare_edited(long).collect()} == {len(english) * 300, len(clauses) * 300}


@pytest.mark.parametrize("odd", [[1e308], [1e306, -1e306], [1e-200], [1e308, 1e-308, 1e200, 1e-200, 5e-324], []])
def test_search_scores_vectors_of_any_size(spark, odd):
    """A few huge or tiny vectors among ordinary ones leave the others' scores as they are: products of original components."""
    from fractions import Fraction

    rng = random.Random(len(odd))
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(70)] + [(1000 + i, [x * rng.choice([1, 0.5, -1]) for _ in range(6)]) for i, x in enumerate(odd)]
    rows += [(2000, [1e-3 * x for x in rows[3][1]]), (2001, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in lsh_search.search(df, df.where("vec_id % 10 = 0"), k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, v in rows:
        if q % 10:
            continue
        want = sorted(((-sum(Fraction(a) * Fraction(b) for a, b in zip(v, w, strict=True)), i, w) for i, w in rows if i != q), key=lambda x: x[:2])
        mine = sorted(got[q])
        assert [r[0] for r in mine] == [1, 2, 3, 4, 5]
        whole = {i: -s for s, i, _ in want}
        for rank, i, score in mine:
            top = abs(whole[i]) < Fraction(1.7e308)
            assert score == pytest.approx(float(whole[i]), rel=1e-9, abs=1e-12) if top else score == (float("inf") if whole[i] > 0 else float("-inf"))
        least = -want[4][0]
        hits = sum(whole[i] >= least - abs(least) * Fraction(1, 10**9) - Fraction(1, 10**300) for _, i, _ in mine)
        assert hits >= 4
