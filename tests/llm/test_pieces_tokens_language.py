import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchloom.llm import language_id, token_ledger, training_order
from patchloom.llm import sentence_pieces as S

TEXTS = ["", "a", " hello  wörld\n\nx \t\x00é漢字🎉", None, "The and, of it. " * 20, "x" * 300, "\n", "  ", "don't\r\nstop"]


@pytest.fixture(scope="module")
def model():
    return S.pieces(S.model_path(), S.ALPHA)


def test_encode_is_the_models_own_and_decodes(model):
    for t, ids in zip(TEXTS, S.encode(model, TEXTS), strict=True):
        assert ids.tolist() == model.sp.encode(t or "")
        assert S.decode(model, ids) == (t or "")


def segmentations(model, text):
    """All segmentations of a text into pieces or bytes, with their probabilities, by listing."""
    piece = {model.sp.id_to_piece(i): i for i in range(model.sp.get_piece_size()) if model.raw[i] and not model.sp.is_byte(i)}
    s, found = "▁" + text.replace(" ", "▁"), []

    def walk(at, ids, w):
        if at == len(s):
            found.append((tuple(ids), w))
            return
        for k in range(1, model.longest + 1):
            p = piece.get(s[at : at + k])
            if at + k <= len(s) and p is not None:
                walk(at + k, [*ids, p], w + model.weight[p])

    walk(0, [], 0.0)
    z = math.log(sum(math.exp(w) for _, w in found))
    return {i: math.exp(w - z) for i, w in found}


def test_first_samples_follow_the_lattice(model):
    want = segmentations(model, "of it")
    n = 3000
    keys = np.random.default_rng(0).integers(-(2**62), 2**62, n)
    drawn = S.sample(model, ["of it"] * n, keys, 3)
    got = Counter(tuple(d[0][0].tolist()) for d in drawn)
    for ids, p in want.items():
        assert abs(got[ids] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 2e-3
    # the second, given the first, follows what is left
    first = max(want, key=want.get)
    rest = Counter(tuple(d[1][0].tolist()) for d in drawn if tuple(d[0][0].tolist()) == first)
    m = sum(rest.values())
    for ids, p in want.items():
        if ids != first:
            q = p / (1 - want[first])
            assert abs(rest[ids] / m - q) < 4 * math.sqrt(q * (1 - q) / m) + 2e-3


def test_samples_are_distinct_ordered_and_whole(model):
    for k in (1, 2, 5):
        for t, d in zip(TEXTS, S.sample(model, TEXTS, np.arange(len(TEXTS)), k), strict=True):
            assert len({tuple(x[0].tolist()) for x in d}) == len(d) <= k
            assert all(S.decode(model, x[0]) == (t or "") for x in d)
            assert all(a[2] > b[2] for a, b in itertools.pairwise(d)) and all(x[3] <= 0 for x in d)
    every = segmentations(model, "of")
    d = S.sample(model, ["of"], np.array([4]), 50)[0]
    assert {tuple(x[0].tolist()) for x in d} == set(every) and all(x[3] == 0.0 for x in d)
    assert all(x[1] == pytest.approx(math.log(every[tuple(x[0].tolist())])) for x in d)
    # inclusion scores make estimates unbiased: probability over inclusion sums to 1 on average
    for k in (2, 4):
        drawn = S.sample(model, ["of it"] * 3000, np.arange(3000), k)
        assert np.mean([sum(math.exp(x[1] - x[3]) for x in y) for y in drawn]) == pytest.approx(1.0, abs=0.04)


def test_batches_do_not_matter(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS * 3)), "doc_id long, text string").withColumn("rank", F.lit(9))
    a, b = ({(r["doc_id"], r["rank"], r["ids_sha256"]) for r in S.encode_documents(x, digest=True).collect()} for x in (df, df.repartition(5)))
    assert a == b
    rows = S.encode_documents(df).where("rank = 0")
    assert all(r["text"] == (TEXTS[r["doc_id"] % len(TEXTS)] or "") for r in S.decode_rows(rows).collect())
    assert S.encode_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000, 70_001])
def test_feistel_is_a_permutation(n):
    x = np.arange(n)
    y = training_order.feistel(x, n, 4)
    assert (np.sort(y) == x).all() and (training_order.feistel(y, n, 4, back=True) == x).all()
    if n > 1000:
        assert (y != training_order.feistel(x, n, 5)).mean() > 0.9 and np.corrcoef(x, y)[0, 1] < 0.1


def test_training_order_round_trip(spark, model, tmp_path):
    rng = random.Random(8)
    docs = [(i * 3, " ".join(rng.choice(["alpha", "beta", "of", "x1"]) for _ in range(rng.randrange(80)))) for i in range(60)] + [(999, None), (None, "tail text")]
    docs += [docs[7], docs[7], docs[9], (None, "tail text")]  # copies keep places of their own
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    options = dict(length=16, per_shard=8)
    shards = training_order.write_shards(df, f"file://{tmp_path}/s", **options)
    total = shards.agg(F.sum("n_sequences")).first()[0]
    got = training_order.read_slots(shards, 0, total, per_shard=8).orderBy("slot").collect()
    want, number = {}, 0
    for d, t in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        ids = model.sp.encode(t or "")
        for j in range(0, len(ids), 16):
            want[number] = (d, ids[j : j + 16])
            number += 1
    slots = training_order.feistel(np.arange(number), number, 4)
    assert total == number and [r["slot"] for r in got] == list(range(number))
    for i, s in enumerate(slots):
        assert (got[s]["doc_id"], got[s]["tokens"]) == want[i]
    part = training_order.read_slots(shards, 5, 9, per_shard=8).orderBy("slot").collect()
    assert [r["tokens"] for r in part] == [r["tokens"] for r in got[5:14]]
    assert all(r["n_sequences"] == 8 for r in shards.orderBy("shard").collect()[:-1])
    again = training_order.materialise(df, only=spark.createDataFrame([(1,)], "shard int"), **options).collect()
    assert [r["sha256"] for r in again] == [r["sha256"] for r in shards.where("shard = 1").collect()]
    assert all(hashlib.sha256(bytes(r["payload"])).hexdigest() == r["sha256"] for r in shards.collect())
    assert training_order.materialise(df.limit(0)).count() == 0


def test_a_mix_keeps_its_copies_in_training_order(spark, model):
    from patchloom.llm import mixing

    rng = random.Random(3)
    docs = [(i, "ab"[i % 7 == 0], " ".join(rng.choice(["alpha", "beta", "of", "x1"]) for _ in range(rng.randrange(1, 40)))) for i in range(80)]
    mixed = mixing.stage(spark, spark.createDataFrame(docs, "doc_id long, source string, text string"), "").cache()
    assert mixed.count() > mixed.distinct().count()
    want = sum(len(model.sp.encode(r["text"])) for r in mixed.collect())
    assert training_order.materialise(mixed, length=8, per_shard=16).agg(F.sum("n_tokens")).first()[0] == want
    long = spark.createDataFrame([(1, "alpha beta of " * 60_000)] * 2, "doc_id long, text string")
    assert training_order.materialise(long).agg(F.sum("n_tokens")).first()[0] == 2 * len(model.sp.encode("alpha beta of " * 60_000))


def test_interrupted_shards_go_on(spark, tmp_path):
    """Of three waves the second is lost: only its folder is written anew, with the bytes that it had."""
    docs = spark.createDataFrame([(i, "alpha beta " * (i % 30), i, "mine") for i in range(40)], "doc_id long, text string, slot int, _k string")
    options = dict(length=16, per_shard=8, per_wave=4)
    path = f"{tmp_path}/s"
    first = {r["shard"]: r["sha256"] for r in training_order.write_shards(docs, f"file://{path}", **options).collect()}
    waves = sorted(p.name for p in (tmp_path / "s").glob("wave=*"))
    assert len(waves) >= 3 and len(first) == len(set(first.values())) > 8
    (tmp_path / "s/wave=1/_SUCCESS").unlink()
    for f in (tmp_path / "s/wave=1").glob("part-*"):
        f.write_bytes(b"broken")
    old = {f: f.stat().st_mtime_ns for w in ("wave=0", "wave=2", "_plan/tokens", "_plan/base") for f in (tmp_path / "s" / w).iterdir()}
    again = {r["shard"]: r["sha256"] for r in training_order.write_shards(docs, f"file://{path}", **options).collect()}
    assert again == first and all(f.stat().st_mtime_ns == t for f, t in old.items())


def test_ledger(spark, tmp_path):
    led = token_ledger.TokenLedger(spark, f"file://{tmp_path}/ledger")
    assert led.totals().count() == 0
    schema = "kind string, source string, lang string, version string, n_tokens long, old_source string, old_lang string, old_version string, old_n_tokens long"
    one = spark.createDataFrame([("insert", "a", "en", "v", 5, *[None] * 4), ("insert", "a", "en", "v", 7, *[None] * 4), ("insert", None, "en", "v", None, *[None] * 4)], schema)
    two = spark.createDataFrame([("delete", "a", "en", "v", 5, *[None] * 4), ("revise", "b", "en", "w", 9, "a", "en", "v", 7)], schema)
    assert led.commit("one", one) and led.commit("two", two) and not led.commit("one", two)
    totals = lambda: sorted(map(tuple, led.totals().collect()), key=str)
    want = sorted([(None, "en", "v", 1, 0), ("b", "en", "w", 1, 9)], key=str)
    assert totals() == want
    led.compact()
    assert totals() == want and not led.commit("two", two) and totals() == want
    led.commit("three", one)
    led.compact()
    assert not led.commit("one", one) and ("a", "en", "v", 2, 12) in totals()
    # a write that broke off doesn't count, and can be made again
    (tmp_path / "ledger" / "delta-broken").mkdir()
    assert len(totals()) == 3 and led.commit("broken", two)
    with pytest.raises(Exception, match="unknown kind"):
        led.commit("bad", one.withColumn("kind", F.lit("upsert")))
    with pytest.raises(ValueError):
        led.commit("a/b", one)


def test_ledger_query_equals_recount(spark, model):
    sf = "/root/testdata/sf0.001"
    got = {tuple(r)[:3]: tuple(r)[3:] for r in token_ledger.op8_token_ledger(spark, sf).collect()}
    want = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for v, n in ((token_ledger.WORDS, len(r["text"].split())), (token_ledger.PIECES, len(model.sp.encode(r["text"])))):
            want[(r["source"], r["lang"], v), 0] += 1
            want[(r["source"], r["lang"], v), 1] += n
    assert got == {k: (want[k, 0], want[k, 1]) for k, _ in want}


def test_ledger_query_counts_every_row(spark, model, tmp_path):
    texts = ["one two", "one two", None, None, "", "three", "one two"]
    docs = [(i, t, "s1" if i < 3 else "s2", "EN" if i % 2 else "en") for i, t in enumerate(texts)] + [(None, "four five six", None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in token_ledger.op8_token_ledger(spark, f"file://{tmp_path}").collect()}
    n_docs, n_tokens = Counter(), Counter()
    for _, t, source, lang in docs:
        for v, n in ((token_ledger.WORDS, len((t or "").split())), (token_ledger.PIECES, len(model.sp.encode(t or "")))):
            key = (source, lang and lang.lower(), v)
            n_docs[key] += 1
            n_tokens[key] += n
    assert got == {k: (n_docs[k], n_tokens[k]) for k in n_docs}


SAMPLE = {"en": "the quick brown fox and the lazy dog were with that which", "fr": "le renard brun et les chiens que nous avons dans une maison", "de": "der schnelle braune fuchs und die hunde mit einem haus nicht"}


def test_language(spark):
    rng = random.Random(9)
    make = lambda lang, n: " ".join(rng.choice(SAMPLE[lang].split()) for _ in range(n))
    docs = [(i, make(lang, 30), lang, f"h{i % 4}") for i, lang in enumerate(["en", "fr", "de"] * 40)]
    held = [(1000 + i, make(lang, 25), None, "new") for i, lang in enumerate(["en", "fr", "de"] * 10)]
    odd = [(2000, None, None, None), (2001, "", "en", "h0"), (2002, "1234 !!! ----", None, "h1"), (2003, "zqxj qjzx xqzj vvkq jjqz kxqv " * 5, None, None)]
    df = spark.createDataFrame([*docs, *held, *odd], "doc_id long, text string, lang string, source string")
    m = language_id.fit(df)
    got = {r["doc_id"]: r for r in language_id.identify(language_id.document_rows(df), m, suffix=None).collect()}
    assert len(got) == len(docs) + len(held) + len(odd)
    assert all(got[d]["detected"] == lang and got[d]["accepted"] for d, _, lang, _ in docs)
    assert all(got[1000 + i]["detected"] == lang for i, lang in enumerate(["en", "fr", "de"] * 10))
    assert not any(got[d]["accepted"] for d in (2000, 2002, 2003))
    kept = language_id.stage(spark, df, "")
    assert kept.columns == df.columns and {d[0] for d in docs} <= {r["doc_id"] for r in kept.collect()}
    assert language_id.identify(language_id.document_rows(df.limit(0)), m, suffix=None).count() == 0


def test_priors_decide_where_text_does_not(spark):
    m = (["aa", "bb", "und"], np.log(np.full((language_id.BUCKETS, 3), 1 / language_id.BUCKETS)).astype(np.float32))
    strong = m[1].copy()
    code = language_id._codes(["xxxx"])[1]
    strong[code, 0] = np.log(0.2)
    rows = [(i, "xxxx", "AA", "com", "h") for i in range(30)] + [(100, "yyyy", None, None, "h"), (101, "yyyy", "aa", None, None)]
    df = spark.createDataFrame(rows, "id int, text string, declared string, suffix string, host string")
    got = {r["id"]: r["detected"] for r in language_id.identify(df, (m[0], strong)).collect()}
    assert got[100] == "aa" and got[101] == "aa"


def test_pages(spark):
    pages = spark.createDataFrame([(1, "https://a.b.example.FR:80/x?y", '<html lang="fr-CA"><script>var x</script>Bonjour &amp; <b>toi</b></html>'), (2, None, None)], "page_id long, url string, html string")
    a, b = language_id.page_rows(pages).orderBy("page_id").collect()
    assert (a["declared"], a["suffix"], a["host"], a["domain"], a["text"].split()) == ("fr", "fr", "a.b.example.fr", "example.fr", ["Bonjour", "toi"])
    assert b["declared"] is None and b["host"] is None


def test_every_language_is_modelled(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    docs, i = [], 0
    for k in range(204):
        words = ["".join(rng.choice(letters) for _ in range(5)) for _ in range(12)]
        for _ in range(2 if k < 203 else 1):
            docs.append((i, " ".join(rng.choice(words) for _ in range(40)), f"l{k:03d}", None))
            i += 1
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    m = language_id.fit(df)
    assert m[0] == [f"l{k:03d}" for k in range(204)] + ["und"] and m[1].shape == (language_id.BUCKETS, 205)
    last = df.where("lang >= 'l198'")
    got = {r["doc_id"]: (r["detected"], r["accepted"]) for r in language_id.identify(language_id.document_rows(last), m, suffix=None).collect()}
    assert got == {d: (lang, True) for d, _, lang, _ in docs if lang >= "l198"}


def test_copies_count_once_in_the_fit(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(200)]
    once = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    # one text that the sample below draws, and one that it doesn't, become the hot group in turn
    unit = {r["text"]: r["u"] for r in once.select("text", language_id.C.hash_unit("text", seed=9).alias("u")).collect()}
    low, high = min(texts, key=unit.get), max(texts, key=unit.get)
    langs, want = language_id.fit(once, sample=100)
    for hot in (low, high):
        copies = spark.createDataFrame([(1000 + i, hot, "aa") for i in range(400)], once.schema)
        got = language_id.fit(once.unionByName(copies), sample=100)
        assert got[0] == langs and np.array_equal(got[1], want)


def test_declared_language_is_the_primary_subtag(spark):
    tags = {"fil": "fil", "haw-US": "haw", "ast-Latn-ES": "ast", "de-AT": "de", "fi": "fi", "": None}
    pages = spark.createDataFrame([(i, None, f'<html class="x" lang="{t}">text') for i, t in enumerate(tags)], "page_id long, url string, html string")
    assert [r["declared"] for r in language_id.page_rows(pages).orderBy("page_id").collect()] == list(tags.values())


def test_words_that_share_a_polynomial_hash_stay_apart():
    """A text and its complement of two letters, whose polynomials modulo 2 ** 64 agree for any odd base."""
    m = S.pieces(S.model_path(), S.ALPHA)
    texts = ["".join("ab"[(i.bit_count() + k) % 2] for i in range(2048)) for k in (0, 1)] * 2
    assert [x.tolist() for x in S.encode(m, texts)] == m.sp.encode(texts)
    for text, found in zip(texts, S.sample(m, texts, np.arange(4), 3), strict=True):
        assert len({x[0].tobytes() for x in found}) == 3 and all(S.decode(m, x[0]) == text for x in found)
    flat = np.concatenate(S.encode(m, texts))
    size, raw = np.array([len(x) for x in S.encode(m, texts)]), [(" " + t).encode() for t in texts]
    assert S.spells(m, flat, size, raw).all()
    assert S.spells(m, flat, size, [raw[1], raw[1], raw[0], b"x"]).tolist() == [False, True, True, False]


def test_all_segmentations_of_short_words_are_distinct():
    """As many as there are, none twice, however little probability is left."""
    m = S.pieces(S.model_path(), S.ALPHA)
    for text in ("ab", "the", "aaa", "thing"):
        found = S.sample(m, [text], np.array([5]), 400)[0]
        ways = {x[0].tobytes() for x in found}
        b = S.Batch(m, [text])
        total = 1
        for w in b.word:
            total *= b.ways(int(w), 10**6)[int(b.base[w])]
        assert len(ways) == len(found) == min(400, total)
        assert all(S.decode(m, x[0]) == text for x in found)
