"""Log reassembly, importance resampling and BPE against brute force and the tokenizers library."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from patchloom.llm import bpe_tree, log_replay, target_resampling

LOG = "pos long, source string, op string, key long, value long"


def replay(log, epoch):
    """One record after the other: (undone changes, states)."""
    open_, shared, undone, states, commits = {}, {}, [], [], 0
    low = lambda v: (v is not None, v)
    state = lambda: states.append((len(states) + 1, len(shared), sum(v or 0 for v in shared.values())))
    for pos, s, op, key, value in sorted((r for r in log if r[0] is not None), key=lambda r: (r[0], "" if r[1] is None else "=" + r[1], low(r[2]), low(r[3]), low(r[4]))):
        changes, marks = open_.setdefault(s, ([], []))
        if op in ("set", "delete"):
            changes.append((pos, op, key, value))
        elif op == "savepoint":
            marks.append(len(changes))
        elif op == "rollback":
            at = marks.pop() if marks else 0
            undone += [("rollback", p, pos, k) for p, _, k, _ in changes[at:]]
            del changes[at:]
        elif op in ("commit", "abort"):
            for p, what, k, v in changes:
                if op == "abort":
                    undone.append(("abort", p, pos, k))
                elif what == "set":
                    shared[k] = v
                else:
                    shared.pop(k, None)
            open_[s] = ([], [])
            if op == "commit":
                commits += 1
                if commits % epoch == 0:
                    state()
    if commits % epoch:
        state()
    undone += [("abort", p, None, k) for changes, _ in open_.values() for p, _, k, _ in changes]
    return undone, states, shared


def same(found, states, log, epoch):
    undone, want, shared = replay(log, epoch)
    full = lambda rows: sorted(tuple((x is not None, x) for x in r) for r in rows)
    assert full(tuple(r) for r in found.where("kind <> 'commit'").select("kind", "at", "by", "key").collect()) == full(undone)
    assert sorted(tuple(r) for r in states.collect()) == want
    assert full(tuple(r) for r in log_replay.store(found.where("kind = 'commit'")).collect()) == full(shared.items())


@pytest.mark.parametrize("seed", range(4))
def test_log_against_one_record_after_the_other(spark, seed):
    rng = random.Random(seed)
    ends = (0.02, 0.3)[seed % 2]
    log = []
    for i in range(400):
        op = rng.choices(["commit", "abort", "savepoint", "rollback", "set", "delete", "other", None], [ends, ends / 3, 0.2, 0.25, 0.6, 0.1, 0.02, 0.02])[0]
        log.append((i * 3 if rng.random() > 0.05 else i, rng.choice(["a", "a", "a", "b", "", None]), op, rng.choice([1, 2, 3, 4, None]) if op in ("set", "delete") else None, rng.choice([None, 5, 7, 1 << 33]) if op == "set" else None))
    log += [log[7], log[7], (None, "a", "commit", None, None)]
    rng.shuffle(log)
    df = spark.createDataFrame(log, LOG).withColumn("seg", F.lit(9)).withColumn("kind", F.lit("x"))
    same(*log_replay.reassemble(df, segment=11, epoch=3, block=2), log, 3)
    same(*log_replay.reassemble(df), log, 64)


def test_log_of_one_transaction_over_all_ranges(spark):
    """A third and more of the records in one transaction that never ends but for the log, and one that commits at the end."""
    log = [(i, "a" if i % 3 else "b", "set", i % 5, i) for i in range(300)] + [(100, "a", "savepoint", None, None), (250, "a", "rollback", None, None), (500, "b", "commit", None, None)]
    found, states = log_replay.reassemble(spark.createDataFrame(log, LOG), segment=16, epoch=2, block=1)
    same(found, states, log, 2)
    assert found.where("kind = 'rollback' and by = 250").count() == 100
    empty = log_replay.reassemble(spark.createDataFrame([], LOG))
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_documents_as_a_log(spark):
    long = "wort " * 40_000
    docs = [(i, ("", "text é", None, long)[i % 4], ("x", None)[i % 2]) for i in range(-40, 300)]
    labels = [(i, 1 if i % 5 == 0 else 0) for i in range(0, 400, 3)] * 2 + [(None, 1)]
    got = {r["pos"]: tuple(r)[1:] for r in log_replay.of_documents(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, toxic int"), keys=7).collect()}
    assert len(got) == len(docs)
    for i, text, source in docs:
        h = zlib.crc32(str(i).encode())
        op = ["commit"] * 2 + ["abort"] + ["savepoint"] * 2 + ["rollback"] * 2
        if h % 17 < 7:
            assert got[i] == (source, op[h % 17], None, None)
        else:
            key, gone = h // 100 % 7, text is None or (i % 15 == 0 and i >= 0)
            assert got[i] == (source, "delete" if gone else "set", key, None if gone else zlib.crc32(f"{key}:{text}".encode()))


def drawn(docs, target, percent, least, runs, buckets):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    feats = lambda t: [" ".join(w[i : i + k]) for w in [words(t)] for k in range(runs[0], runs[1] + 1) for i in range(len(w) - k + 1)]
    b = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for n, texts in ((s, [d[1] for d in docs]), (t, target)):
        for x in texts:
            for f in feats(x):
                n[b(f)] += 1
    gain = [math.floor(1000 * math.log((t[i] + 1.0) * (sum(s) + buckets) / ((s[i] + 1.0) * (sum(t) + buckets)))) for i in range(buckets)]
    out = []
    for d in docs:
        h = int(hashlib.sha256(f"2024:{'null' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b(f)] for f in feats(d[1]))
        out.append([d[0], len(feats(d[1])), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(d[1]))])
    long = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    k = percent * len(long) // 100
    ranks = [(*r[:4], i + 1) for i, r in enumerate(long[:k])]
    rest = [(*r[:4], None) for r in [*long[k:], *(r for r in out if r[4] < least)]]
    return ranks, rest


@pytest.mark.parametrize(("runs", "percent"), [((1, 1), 30), ((1, 2), 50), ((2, 3), 100)])
def test_resampling(spark, runs, percent):
    rng = random.Random(5)
    vocabulary = ["Alpha", "béta", "gamma", "δέλτα", "epsilon", "x1", "今天", "Über", "don't", "a-b"]
    docs = [(i * 3 - 50, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12)))) for i in range(120)]
    docs += [(None, "alpha gamma gamma x1"), (7000, None), (7001, ""), (7002, "\x85 ..."), (7003, "gamma " * 30_000), docs[5], docs[5], docs[5], (docs[9][0], "alpha alpha alpha alpha")]
    target = ["alpha gamma", "gamma alpha x1", None, "今天 alpha"]
    df = spark.createDataFrame([(*d, "kept", 1) for d in docs], "doc_id long, text string, _b string, rank int").withColumnRenamed("_b", "_row")
    got = target_resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent, 4, runs, 50)
    assert got.columns == ["doc_id", "_row", "n_features", "weight", "score", "rank"]
    rows = [tuple(r) for r in got.drop("_row").collect()]
    ranks, rest = drawn(docs, target, percent, 4, runs, 50)
    full = lambda rows: sorted(tuple((x is not None, x) for x in r) for r in rows)
    ranked = [r for r in rows if r[4] is not None]
    assert [r[4] for r in sorted(ranked, key=lambda r: r[4])] == list(range(1, len(ranks) + 1))
    assert sorted(r[3] for r in ranked) == sorted(r[3] for r in ranks) and full(rows_without_ranks(rows)) == full(rows_without_ranks(ranks + rest))
    # rows of one id may differ in text: their order is by a hash, so they are left out here
    once = {d[0] for d in docs if [x[0] for x in docs].count(d[0]) == 1}
    assert full(r for r in rows if r[0] in once) == full(r for r in ranks + rest if r[0] in once)


def rows_without_ranks(rows):
    return [r[:4] for r in rows]


def test_resampling_odd_tables(spark):
    docs = spark.createDataFrame([(i, "one two three") for i in range(10)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert target_resampling.resample(docs, none, 100, 1).agg(F.count("rank")).first()[0] == 10
    assert target_resampling.resample(docs, none, 0, 1).agg(F.count("rank")).first()[0] == 0
    assert target_resampling.resample(docs, none, 100, 4).agg(F.count("rank")).first()[0] == 0
    assert target_resampling.resample(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_radix_selection(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice([-5, 0, 3, 1 << 62, -(1 << 63), (1 << 63) - 1]), rng.randrange(-9, 9)) for _ in range(60)]
    df = spark.createDataFrame(rows, "a long, b long").cache()
    order = sorted(rows)
    for k in (1, 2, 17, 30, 59, 60):
        assert target_resampling.kth(df, ["a", "b"], k, bits) == dict(zip("ab", order[k - 1], strict=True))
    assert target_resampling.kth(df, ["a"], 61, bits) is None and target_resampling.kth(df, ["a"], 0, bits) is None


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_tree.model_path())


WORDS = ["internationalization", "hello", "straße", "é", "x̣́", "İ", "Σας", "<|endoftext|>", "it's", "12", "!!!", "—", " ", "́", "你好世界", "🎉🎉", "'re", " ", "</w>", "a", "<|END", " ", "\n", "\t", "\u0085", "​", "ﬁ", "\x00"]


def test_bpe_joins_give_what_the_whole_gives():
    m, t = bpe_tree.Bpe(bpe_tree.model_path()), library()
    rng = random.Random(3)
    for n in range(300):
        u = "".join(rng.choice("abcdehilnorstu") for _ in range(rng.randrange(1, 200))) if n % 2 else "a" * rng.randrange(1, 300)
        want = t.encode(u, add_special_tokens=False).ids
        assert m.unit(u, leaf=rng.choice([1, 2, 7])) == want
        k = rng.randrange(1, len(u) + 1)
        if k < len(u):
            assert m.joined(m.unit(u[:k], False), m.unit(u[k:]), True) == want
    for _ in range(200):
        x = "".join(rng.choice(WORDS) for _ in range(rng.randrange(40)))
        for leaf in (3, 64):
            m.known.clear()
            assert m.texts([x, None, "", x[::-1]], leaf).to_pylist() == [t.encode(y, add_special_tokens=False).ids for y in (x, "", "", x[::-1])]


@pytest.mark.parametrize(("part", "width"), [(bpe_tree.PART, bpe_tree.WIDTH), (40, 2), (7, 3)])
def test_bpe_against_the_library(spark, part, width):
    t, rng = library(), random.Random(part)
    texts = ["".join(rng.choice([*WORDS, " "]) for _ in range(rng.randrange(60))) for _ in range(60)]
    unsplit = "".join(rng.choice("etaoinshrdlu") for _ in range(700))
    texts += [None, "", " \t\n", "a" * 500, unsplit, f"x {unsplit} y {unsplit[::-1]}<|startoftext|>{unsplit[:90]}", "你好" * 300, "7" * 300, texts[0], texts[0]]
    df = spark.createDataFrame([(i, x, "kept", 3) for i, x in enumerate(texts)], "id int, text string, _u string, n_tokens int")
    got = bpe_tree.decode(bpe_tree.encode(df, part=part, width=width, leaf=16)).collect()
    assert got[0].__fields__ == ["id", "_u", "n_tokens", "ids", "decoded"] and len(got) == len(texts)
    for r in got:
        ids = t.encode(texts[r["id"]] or "", add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (ids, len(ids), t.decode(ids, skip_special_tokens=False)), r["id"]
    assert bpe_tree.encode(df.limit(0)).count() == 0


def test_bpe_of_a_very_long_text(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("etaoin") for _ in range(150_000)) + " end. " * 40_000
    r = bpe_tree.encode(spark.createDataFrame([(text,)], "text string")).first()
    assert r["ids"] == library().encode(text, add_special_tokens=False).ids


def test_decode_of_odd_ids(spark):
    got = bpe_tree.decode(spark.createDataFrame([(None,), ([],), ([-1, 320, 10**6, 49407],)], "ids array<int>")).collect()
    assert [r["decoded"] for r in got] == [None, "", library().decode([320, 49407], skip_special_tokens=False)]
