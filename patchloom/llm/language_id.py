"""Language identification by Bayesian evidence fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import common as C
from patchloom.llm.shingles import chunks, tidy
from patchloom.session import prepared

#: Buckets of hashed byte trigrams in the text model.
BUCKETS = 1 << 15
#: Labelled texts a language that the text model is fitted on, in expectation: the only bound on what is looked at.
SAMPLE = 2000
#: No language: its text likelihood is even over the buckets.
UNKNOWN = "und"
#: Neighbouring trigrams repeat each other's evidence: n of them count as n * EVIDENCE / (n + EVIDENCE), so nearly all in
#: a short text, and ever fewer of further ones. A parameter of the model; README has what other values change.
EVIDENCE = 150
#: Second-level labels under which countries register names: a host's domain then has three labels. Fixed values.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "govt", "ltd", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch")
#: Rows of prior weight with which a host leans on its domain, and a domain on all.
LEAN = 20.0
#: Log-odds for no language where a text has no letters.
NO_LETTERS = 10.0
#: Share of rows that are taken to have no language, before any evidence.
NONE_PRIOR = 0.01


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(first trigram of each text and the end, bucket of each trigram) of lower-cased letters, other runs as one blank."""
    import re

    raw = [(" " + re.sub(r"[\W\d_]+", " ", (t or "").lower()).strip() + " ").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    ends = np.cumsum([len(x) for x in raw])
    if len(data) < 3:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint32)
    gram = data[:-2] | (data[1:-1] << np.uint32(8)) | (data[2:] << np.uint32(16))
    bucket = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)
    inside = np.ones(len(gram), bool)
    for back in (1, 2):
        at = ends[:-1] - back
        inside[at[(at >= 0) & (at < len(gram))]] = False
    counts = np.maximum(np.array([len(x) for x in raw]) - 2, 0)
    return np.concatenate([[0], np.cumsum(counts)]), bucket[inside]


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability of each bucket under each of them and, last, under none).

    labelled has text and lang, all values of which are told apart. About `sample` distinct texts of each language are
    drawn by hash and counted once each, however many copies they have; only the table of languages times buckets comes
    to the driver, a language at a time, 128 KB each in the model. Rows without text or lang are left out. Without any row left, there is only UNKNOWN.
    """
    rows = prepared(labelled).select("text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = C.cut(rows.groupBy("lang").agg(F.countDistinct(F.xxhash64("text")).alias("n")), "langs")
    share = C.side(sizes).select(F.col("lang").alias("_l"), (F.lit(float(sample)) / F.col("n")).alias("_share"))
    drawn = rows.join(share, F.col("lang") == F.col("_l")).where(C.hash_unit("text", seed=9) < F.col("_share")).select("lang", "text").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                first, bucket = _codes(texts[a:b])
                for i in range(b - a):
                    n = np.bincount(bucket[first[i] : first[i + 1]], minlength=BUCKETS)
                    total[langs[a + i]] = total.get(langs[a + i], 0) + n
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    found = drawn.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = C.cut(found.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")), "langcounts")
    logs: dict[str, np.ndarray] = {}
    for row in found.toLocalIterator():
        counts = np.full(BUCKETS, 0.02)
        counts[np.array(row["b"])] += np.array(row["n"])
        logs[row["lang"]] = np.log(counts / counts.sum()).astype(np.float32)
    langs = sorted(logs)
    table = np.full((BUCKETS, len(langs) + 1), -np.log(BUCKETS), np.float32)
    for i, lang in enumerate(langs):
        table[:, i] = logs[lang]
    return [*langs, UNKNOWN], table


def text_likelihood(rows: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """rows with _ll, the log-likelihoods of the text under each of the model's languages, tempered (see EVIDENCE).

    The whole text is read. Text without letters, null included, is even evidence for none: all zeros but for a plus on
    UNKNOWN.
    """
    from pyspark.sql import types as T

    langs, table = model

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text)).to_pylist()
            out = np.zeros((len(texts), len(langs)))
            for a, b in chunks(texts):
                first, bucket = _codes(texts[a:b])
                n = np.diff(first)
                for i in range(b - a):
                    if n[i] and has_letters(texts[a + i]):
                        out[a + i] = table[bucket[first[i] : first[i + 1]]].sum(axis=0, dtype=np.float64) * (EVIDENCE / (n[i] + EVIDENCE))
                    else:
                        out[a + i, -1] = NO_LETTERS
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(out), pa.list_(pa.float64()))], [*batch.schema.names, "_ll"])
        tidy()

    return rows.mapInArrow(score, T.StructType([*rows.schema.fields, T.StructField("_ll", T.ArrayType(T.DoubleType()))]))


def has_letters(text: str | None) -> bool:
    """Whether the text has a letter."""
    return any(map(str.isalpha, text or ""))


def _soft(scores: Column) -> Column:
    """Probabilities in proportion to exp(scores)."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], declared: str | None = "declared", suffix: str | None = "suffix", host: str | None = "host", domain: str | None = None, keep_text: bool = False, min_prob: float = 0.5) -> DataFrame:
    """rows with lang, lang_prob and accepted: the language by all evidence, its probability, and whether to keep the row.

    The evidence, multiplied: the text's likelihood; the probability of the declared markup language and of the
    address suffix under each language; the host's prior over languages. These tables are sums over all rows of the
    text's own posterior, made by grouped aggregations: P(value | language) with one row spread over the values as
    smoothing, and host priors that lean on the domain's, which lean on the overall shares, by LEAN rows each. A row's
    own share is taken out of all these sums before it is judged, so that no row votes for itself there. (A row that was
    drawn for the text model is one of some SAMPLE texts of its language in it.) Each text is scored once; what follows
    reads the scores back.
    Accepted is a row whose best language isn't UNKNOWN and has at least min_prob.

    Null or missing declared language, suffix or host: that evidence is left out (the prior is then the overall one).
    Null or letterless text: the other evidence decides, against a plus for UNKNOWN. Rows stay as they are, repeated
    ones too; an empty table gives an empty table. Result columns of the same name are replaced, others kept whatever
    their names.
    """
    langs, _ = model
    k = len(langs)
    rows = prepared(rows).drop("lang_prob", "accepted", "detected")
    own = [c for c in rows.columns if keep_text or c != "text"]
    null = F.lit(None).cast("string")
    pick = {"_d": F.lower(F.col(declared).cast("string")) if declared else null, "_s": F.lower(F.col(suffix).cast("string")) if suffix else null, "_h": F.col(host).cast("string") if host else null}
    pick["_o"] = F.col(domain).cast("string") if domain else null
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row") if own else F.struct(F.lit(0).alias("_none")).alias("_row")
    scored = text_likelihood(rows.select(row, "text", *[c.alias(n) for n, c in pick.items()]), model).drop("text")
    scored = C.cut(scored, "langscores").withColumn("_p", _soft(F.col("_ll")))
    sums = [F.sum(F.col("_p")[i]).alias(f"_{i}") for i in range(k)]
    # one pass: sums by (host, domain, declared, suffix); everything else is a sum of these
    cells = C.cut(scored.groupBy("_h", "_o", "_d", "_s").agg(*sums), "langcells")
    back = F.array(*[F.col(f"_{i}") for i in range(k)])
    again = [F.sum(f"_{i}").alias(f"_{i}") for i in range(k)]

    def by(col: str, name: str) -> DataFrame:
        return C.cut(cells.where(F.col(col).isNotNull()).groupBy(col).agg(*again).select(col, back.alias(name)), "langby")

    total = cells.agg(*again).first()
    n = [float(x or 0.0) for x in total]
    base = np.array(n) + 1e-9
    base = base / base.sum()
    base[-1] = NONE_PRIOR if k > 1 else 1.0
    base[:-1] = base[:-1] / max(base[:-1].sum(), 1e-12) * (1 - base[-1])
    shares = F.array(*[F.lit(float(x)) for x in base])

    out, zero = scored, F.array(*[F.lit(0.0)] * k)
    less = lambda a, b: F.greatest(a - b, F.lit(0.0))
    joint = F.col("_ll")
    for col, name in (("_d", "_ed"), ("_s", "_es")):
        t = by(col, name)
        spread = 1.0 / max(1, t.count())
        whole = [float(x or 0.0) for x in t.agg(*[F.sum(F.col(name)[i]) for i in range(k)]).first()]
        out = out.join(C.side(t.withColumnRenamed(col, f"{col}_")), F.col(col) == F.col(f"{col}_"), "left").drop(f"{col}_")
        # log P(value | language) without the row itself; no language says nothing about what is declared, its
        # probability is that over all languages
        of = F.zip_with(F.zip_with(F.col(name), F.col("_p"), less), F.zip_with(F.array(*map(F.lit, whole)), F.col("_p"), less), lambda a, b: F.log((a + spread) / (b + 1.0)))
        sum_ = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
        none = F.log((less(sum_(F.col(name)), F.lit(1.0)) + spread) / (F.lit(max(sum(whole) - 1.0, 0.0)) + 1.0))
        joint = F.zip_with(joint, F.when(F.col(name).isNull(), zero).otherwise(F.concat(F.slice(of, 1, k - 1), F.array(none))), lambda a, b: a + b)
    for col, name in (("_o", "_no"), ("_h", "_nh")):
        t = by(col, name).withColumnRenamed(col, f"{col}_")
        out = out.join(C.side(t), F.col(col) == F.col(f"{col}_"), "left").drop(f"{col}_")

    def leant(counts: str, on: Column) -> Column:
        """Shares by the sums without the row's own part, leaning on another distribution."""
        mine = F.zip_with(F.coalesce(F.col(counts), F.col("_p")), F.col("_p"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
        size = F.aggregate(mine, F.lit(0.0), lambda a, x: a + x)
        return F.transform(F.zip_with(mine, on, lambda a, b: a + b * LEAN), lambda x: x / (size + LEAN))

    out = out.withColumn("_po", leant("_no", shares)).withColumn("_ph", leant("_nh", F.col("_po")))
    joint = F.zip_with(joint, F.col("_ph"), lambda a, b: a + F.log(F.greatest(b, F.lit(1e-12))))
    out = out.withColumn("_post", _soft(joint)).withColumn("lang_prob", F.array_max("_post"))
    out = out.withColumn("detected", F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("_post", F.col("lang_prob")).cast("int")))
    return out.withColumn("accepted", (F.col("detected") != UNKNOWN) & (F.col("lang_prob") >= min_prob)).select(*[F.col(f"_row.`{c}`") for c in own], "detected", "lang_prob", "accepted")


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, suffix, host, domain) of raw pages: text without markup, the primary subtag of the html
    element's lang (all before the first hyphen), and parts of the address. The domain is the host's last two labels, or
    three where a country registers names under the second (SECOND_LEVEL); an address in numbers is a domain of its own
    and has no suffix. Null pages and addresses give empty texts and no evidence."""
    html = F.coalesce(F.col("html"), F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", " ")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    declared = F.substring_index(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z-]+)", 1), "-", 1)
    numbers = host.rlike(r"^[0-9.]+$|^\[")
    registered = rf"((?:[^.]+\.(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}|[^.]+\.[^.]+))$"
    return pages.select("page_id", text.alias("text"), F.when(declared != "", declared).alias("declared"), F.when(~numbers, F.element_at(F.split(host, r"\."), -1)).alias("suffix"), host.alias("host"), F.when(numbers, host).otherwise(F.regexp_extract(host, registered, 1)).alias("domain"))


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as rows for identify(): the declared language is lang, the host is the source; they have no address."""
    return docs.withColumns({"declared": F.col("lang"), "host": F.col("source")})


def held_rows(docs: DataFrame) -> DataFrame:
    """Documents as rows for identify(), with all their columns in one, held, so that none is replaced."""
    return docs.select(F.struct("*").alias("held"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() over all documents and all pages: one row each, with doc_id or page_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = fit(docs)
    a = document_rows(docs.select("doc_id", "text", "lang", "source")).select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", "declared", F.lit(None).cast("string").alias("suffix"), "host", F.lit(None).cast("string").alias("domain"))
    b = page_rows(pages).select(F.lit(None).cast("long").alias("doc_id"), "page_id", "text", "declared", "suffix", "host", "domain")
    out = identify(a.unionByName(b), model, domain="domain")
    return out.select("doc_id", "page_id", "detected", "lang_prob", "accepted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; lang is then the language found."""
    out = identify(held_rows(docs), fit(docs), suffix=None).where("accepted")
    return out.select(*[F.col("detected").alias("lang") if c == "lang" else F.col(f"held.`{c}`") for c in docs.columns])
