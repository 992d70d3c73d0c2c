"""Language fusion and every stage of the pipeline against brute force, each on what its predecessor kept."""

import hashlib
import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from patchloom.llm import language_id as L
from patchloom.llm import line_dedup, mixing, near_dedup
from patchloom.llm import sentence_pieces as S
from tests.llm.test_line_dedup_mixing import brute_lines

SF = "/root/testdata/sf0.001"


def soft(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def brute_identify(rows, model):
    """(detected, probability) of rows (text, declared, suffix, host, domain): every sum over all other rows."""
    langs, table = model
    k = len(langs)
    ll = np.zeros((len(rows), k))
    for i, r in enumerate(rows):
        _, codes = L._codes([r[0]])
        if len(codes) and any(map(str.isalpha, r[0] or "")):
            ll[i] = table[codes].sum(axis=0, dtype=np.float64) * (L.EVIDENCE / (len(codes) + L.EVIDENCE))
        else:
            ll[i, -1] = L.NO_LETTERS
    p = np.array([soft(x) for x in ll])
    base = p.sum(axis=0) + 1e-9
    base /= base.sum()
    base[:-1] *= (1 - L.NONE_PRIOR) / base[:-1].sum()
    base[-1] = L.NONE_PRIOR

    def others(c, i, same=True):
        return sum((p[j] for j, r in enumerate(rows) if j != i and r[c] is not None and (not same or r[c] == rows[i][c])), np.zeros(k))

    out = []
    for i, r in enumerate(rows):
        prior = base
        for c in (4, 3):
            mine = others(c, i) if r[c] is not None else np.zeros(k)
            prior = (mine + L.LEAN * prior) / (mine.sum() + L.LEAN)
        score = ll[i] + np.log(np.maximum(prior, 1e-12))
        for c in (1, 2):
            if r[c] is not None:
                spread = 1 / len({x[c] for x in rows if x[c] is not None})
                here, whole = others(c, i), others(c, i, False)
                ev = np.log((here + spread) / (whole + 1))
                ev[-1] = math.log((here.sum() + spread) / (whole.sum() + 1))
                score = score + ev
        post = soft(score)
        out.append((langs[int(np.argmax(post))], float(post.max())))
    return out


def likeness(a, b):
    """Probability Jaccard of two counters."""
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


def runs(text, k=5):
    w = (text or "").lower().encode().split()
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def brute_near(docs):
    """Ids that stay of (id, text): one of each class of linked texts; texts without words all stay."""
    bags = [(i, runs(t)) for i, t in docs]
    holders = defaultdict(list)
    for x, (_, bag) in enumerate(bags):
        for s in bag:
            holders[s].append(x)
    root = list(range(len(bags)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in {(x, y) for h in holders.values() for x in h for y in h if x < y}:
        if likeness(bags[x][1], bags[y][1]) >= 0.8 - 1e-9:
            a, b = sorted((find(x), find(y)))
            root[b] = a
    least = {}
    for x, (i, _) in enumerate(bags):
        least[find(x)] = min(i, least.get(find(x), i))
    return sorted(i for x, (i, bag) in enumerate(bags) if not bag or least[find(x)] == i)


def brute_mix(docs, seed=20):
    """Copies of (id, source, text) by Pareto ranks: whole copies first, then the least odds ratios until a source is full."""
    size = {d: len((t or "").encode().split()) for d, _, t in docs}
    weight = {d: max(size[d], 1).bit_length() for d in size}
    of = defaultdict(list)
    for d, s, _ in docs:
        of[s].append(d)
    order = sorted(of, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    cap = {s: 2 * sum(size[d] for d in of[s]) for s in order}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > cap[s]}
        for s in full or open_:
            target[s] = cap[s] if full else level * w[s]
        left -= sum(target[s] for s in full)
        open_ -= full or set(open_)
    copies = {}
    for s in order:
        heavy, need = set(), target[s]
        while True:
            rest = [d for d in of[s] if weight[d] not in heavy]
            mass = sum(size[d] * weight[d] for d in rest)
            level = (target[s] - 2 * sum(size[d] for d in of[s] if weight[d] in heavy)) / mass if mass else math.inf
            over = [weight[d] for d in rest if level * weight[d] > 2]
            if not over:
                break
            heavy.add(max(over))
        ranked = []
        for d in of[s]:
            e = 2.0 if weight[d] in heavy else min(2.0, level * weight[d]) if level < math.inf else 2.0
            copies[d] = math.floor(e)
            need -= copies[d] * size[d]
            if pi := e - math.floor(e):
                u = (int(hashlib.md5("|".join([str(seed), str(d), *([s] if s is not None else [])]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                ranked.append(((u / (1 - u)) / (pi / (1 - pi)), d))
        taken = 0
        for _, d in sorted(ranked):
            if taken + size[d] / 2 > need:
                break
            taken += size[d]
            copies[d] += 1
    return {d: n if size[d] else 0 for d, n in copies.items()}


def test_fusion_equals_brute_force(spark):
    words = {"en": "the cat sat on a mat and saw the dog", "fr": "le chat est sur la table et il dort bien", "de": "der hund und die katze sind nicht hier"}
    rows = []
    for i in range(90):
        lang = ("en", "fr", "de")[i % 3]
        text = " ".join(words[lang].split()[i % 4 : 3 + i % 7])
        rows.append((text, lang if i % 5 else None, ("com", lang, None)[i % 3], f"h{i % 4}.x" if i % 7 else None, "x" if i % 7 and i % 2 else None))
    rows += [(None, "en", "com", "h0.x", "x"), ("", None, None, None, None), ("123 !", "fr", None, "h1.x", None), ("qq", "zz", "zz", "lone", "lone")]
    df = spark.createDataFrame([(i, *r, "mine") for i, r in enumerate(rows)], "id int, text string, declared string, suffix string, host string, domain string, _p string")
    model = L.fit(df.select("text", df["declared"].alias("lang")).where("declared <> 'zz'"))
    got = {r["id"]: (r["detected"], r["lang_prob"]) for r in L.identify(df, model, domain="domain").collect()}
    for i, (lang, prob) in enumerate(brute_identify(rows, model)):
        assert got[i] == (lang, pytest.approx(prob, abs=1e-6)), rows[i]


def test_domains(spark):
    urls = {"http://www.bbc.co.uk/x": ("bbc.co.uk", "uk"), "http://10.0.0.7/": ("10.0.0.7", None), "http://a.b.example.org": ("example.org", "org"), "http://x.com.br": ("x.com.br", "br"), "http://localhost/": ("", "localhost")}
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert [(r["domain"], r["suffix"]) for r in L.page_rows(df).orderBy("page_id").collect()] == list(urls.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages_equal_brute_force(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id is not null")
    odd = [(90001, None, "en", "web", 0), (90002, "", "en", None, 0), (90003, "é " * 4000, "fr", "web", 8000), (90004, "same line twice\nsame line twice", "en", None, 31)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
    rows = {r["doc_id"]: r for r in docs.collect()}

    model = L.fit(docs)
    found = dict(zip(rows, brute_identify([(r["text"], r["lang"] and r["lang"].lower(), None, r["source"], None) for r in rows.values()], model), strict=True))
    one = stages["language_id"](spark, docs, SF)
    got = {r["doc_id"]: r for r in one.collect()}
    assert {d: r["lang"] for d, r in got.items()} == {d: lang for d, (lang, prob) in found.items() if lang != L.UNKNOWN and prob >= 0.5}
    assert all(r["text"] == rows[d]["text"] for d, r in got.items())

    two = {r["doc_id"]: r for r in stages["line_dedup"](spark, one, SF).collect()}
    want = brute_lines([(d, r["text"]) for d, r in got.items()], line_dedup.STAGE_NEAR_CHARS)
    assert {d: r["text"] for d, r in two.items()} == {d: t for d, t in want.items() if t is None or t == got[d]["text"] or t.strip()}
    assert all(r["n_chars"] == len(r["text"] or "") for r in two.values())

    three_in = spark.createDataFrame([tuple(r) for r in two.values()], docs.schema)
    three = {r["doc_id"]: r for r in stages["near_dedup"](spark, three_in, SF).collect()}
    assert sorted(three) == brute_near([(d, r["text"]) for d, r in two.items()])

    four_in = spark.createDataFrame([tuple(r) for r in three.values()], docs.schema)
    four = stages["mixing"](spark, four_in, SF)
    copies = brute_mix([(d, r["source"], r["text"]) for d, r in three.items()])
    mixed = Counter(r["doc_id"] for r in four.collect())
    assert dict(mixed) == {d: n for d, n in copies.items() if n}

    model = S.pieces(S.model_path(), S.ALPHA)
    seen = defaultdict(dict)
    for r in stages["sentence_pieces"](spark, four_in, SF).collect():
        seen[r["doc_id"]][r["rank"]] = list(r["ids"])
    assert seen.keys() == three.keys()
    for d, ranks in seen.items():
        text = three[d]["text"] or ""
        assert ranks[0] == model.sp.encode(text) and all(S.decode(model, np.array(x)) == text for x in ranks.values())
        drawn = [tuple(x) for r, x in ranks.items() if r]
        assert len(set(drawn)) == len(drawn) and (len(drawn) == S.SAMPLES or not text)


def test_columns_with_names_in_use(spark):
    """Columns named like anything inside pass through every stage."""
    own = ["_k", "_t", "_row", "held", "size", "copies", "_h", "_p", "line", "sketch", "key", "_c1", "class_id", "has_words", "line_no"]
    docs = spark.createDataFrame([(i, f"text number {i} is the one of all that is here", "en", f"s{i % 2}", 9, *[f"{c}{i}" for c in own]) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in own))
    for name, stage in (("language", L.stage), ("lines", line_dedup.stage), ("near", near_dedup.stage), ("mixing", mixing.stage)):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert [r[c] for c in own] == [f"{c}{r['doc_id']}" for c in own], name
