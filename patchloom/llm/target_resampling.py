"""Importance resampling: documents drawn by how much likelier their features are in a target text set than in the corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchloom.llm import common as C

#: Fixed by the contract of the query: words, run lengths, buckets, the seed's year, the least words and the percentage drawn.
WORD, RUNS, BUCKETS, SEED, LEAST_WORDS, PERCENT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (1, 1), 10_000, 2024, 20, 10
#: Bits of a key that one pass of the radix selection settles: at most 2 ** BITS counts come to the driver.
BITS = 12


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case: runs of characters that are no ASCII marks, blanks or controls. Null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def features(found: Column, runs: tuple[int, int] = RUNS) -> Column:
    """All runs of runs[0] to runs[1] consecutive words, each joined by one blank, as often as they occur."""
    if runs == (1, 1):
        return found
    of = lambda k: F.when(F.size(found) >= k, F.transform(F.sequence(F.lit(1), F.size(found) - k + 1), lambda i: F.array_join(F.slice(found, i, k), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[of(k) for k in range(runs[0], runs[1] + 1)])


def bucketed(found: Column, runs: tuple[int, int], buckets: int) -> Column:
    """The bucket of each feature: the CRC-32 of its UTF-8 bytes, modulo the number of buckets."""
    return F.transform(features(found, runs), lambda x: (F.crc32(x.cast("binary")) % buckets).cast("int"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """1000 times the logarithm of how much likelier a feature of each bucket is in the target than in the corpus, floored.

    Both tables hold _buckets, arrays of bucket numbers. Counts are smoothed by one a bucket. They are added up before
    any shuffle, so a frequent word is a row a task; what comes to the driver is a number a bucket.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode("_buckets").alias("_b")).groupBy("_b").agg(F.count(F.lit(1)).alias(name))

    both = counted(corpus, "s").join(counted(target, "t"), "_b", "full").na.fill(0, ["s", "t"])
    # a row for each bucket, so that all have a gain
    both = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("_b")).join(both, "_b", "left").na.fill(0, ["s", "t"])
    totals = both.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    d = lambda x: x.cast("double")
    ratio = d(F.col("t") + 1) * F.lit(float(totals["S"] + buckets)) / (d(F.col("s") + 1) * F.lit(float(totals["T"] + buckets)))
    out = [0] * buckets
    for r in both.select("_b", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("g")).collect():
        out[r["_b"]] = r["g"]
    return out


def kth(df: DataFrame, keys: Sequence[str], k: int, bits: int = BITS) -> dict[str, int] | None:
    """The k-th row, from 1, in ascending order of the long columns `keys`, as its keys; None if there are fewer rows.

    Radix selection: one pass counts the rows by the highest digit of the first key, which tells the digit of the k-th
    row and its place among the rows with that digit; the next pass looks at these rows only, at the next digit, then
    at the next key. A pass reads the table once and brings at most 2 ** bits counts to the driver, however many rows
    there are, and rows are counted before they are shuffled.
    """
    if k < 1:
        return None
    found: dict[str, int] = {}
    for key in keys:
        among = df
        for name, value in found.items():
            among = among.where(F.col(name) == F.lit(value))
        ends = among.agg(F.min(key).alias("a"), F.max(key).alias("b"), F.count(F.lit(1)).alias("n")).first()
        if ends["n"] < k:
            return None
        low, high, shift = ends["a"], ends["b"], 0
        while (high >> shift) - (low >> shift) >= 1 << bits:
            shift += 1
        while low < high:
            counts = among.where(F.col(key).between(low, high)).groupBy(F.shiftright(key, shift).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
            for r in sorted(counts, key=lambda r: r["d"]):
                if k <= r["n"]:
                    break
                k -= r["n"]
            low, high = max(low, r["d"] << shift), min(high, ((r["d"] + 1) << shift) - 1)
            shift = max(0, shift - bits)
        found[key] = low
    return found


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, runs: tuple[int, int] = RUNS,
    buckets: int = BUCKETS, seed: int = SEED, keep: Sequence[str] | None = None,
) -> DataFrame:
    """docs (doc_id, text, ...) with n_features, weight, score and rank: a sample without replacement towards the target (text).

    A document's features are runs of its words, hashed to buckets; its weight is the sum of their buckets' gains, see
    gains(), looked up in one array. Its score adds Gumbel noise, drawn from its id, to the weight, so the highest
    scores are a sample without replacement with odds by weight. Of the n documents with at least `least_words` words
    the floor(percent * n / 100) highest are drawn, ties to the smaller doc_id. The score and id of the last one drawn
    are found by radix selection, see kth(); only drawn rows are sorted by range and numbered. Others have no rank.

    keep names the columns that come along, by default all but text; they keep their names, whatever these are, but
    columns named like results are replaced.

    Null texts are empty: weight 0, no words. Null ids come last among ties and draw their noise as the id "null".
    Rows equal in id and text are documents of their own, with equal scores and ranks one after the other. An empty
    target leaves weights by rarity; empty docs give no rows; so does a percentage of 0 give no ranks.
    """
    docs, spark = C.prepared(docs), docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("text", "n_features", "weight", "score", "rank")]
    found = words(F.col("text"))
    along = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("struct<_:int>")
    bag: list[str] = []
    sized = docs.select(along.alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_t"), found.alias("_found"))
    # the words are found once; buckets are small numbers, so the table is a fraction of the texts
    sized = C.cut(sized.select("_row", "_id", "_t", F.size("_found").cast("long").alias("_words"), bucketed(F.col("_found"), runs, buckets).alias("_buckets")), "dsir", bag)
    gain = gains(sized, target.select(bucketed(words(F.col("text")), runs, buckets).alias("_buckets")), buckets)
    table = F.lit(gain).cast(T.ArrayType(T.LongType()))
    weight = F.aggregate("_buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, b + 1))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = sized.select("_row", "_id", "_t", "_words", F.size("_buckets").cast("long").alias("n_features"), weight.alias("weight")).withColumn("score", F.col("weight") + noise)
    # ascending keys: highest score, smallest id, null ids last; then the text and a number that this table keeps
    keys = {"_k1": -F.col("score"), "_k2": F.coalesce("_id", F.lit(C.NULL_ID)), "_k3": F.col("_t"), "_k4": F.monotonically_increasing_id()}
    scored = C.cut(scored.withColumns(keys), "dsirs")
    C.drop_bag(spark, bag)
    long_enough = scored.where(F.col("_words") >= least_words)
    last = kth(long_enough, list(keys), percent * long_enough.count() // 100)
    out = [*[F.col(f"_row.`{c}`").alias(c) for c in keep], F.col("n_features"), F.col("weight"), F.col("score")]
    if last is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    upto = F.struct(*keys) <= F.struct(*[F.lit(last[c]).cast("long").alias(c) for c in keys])
    drawn = (F.col("_words") >= least_words) & upto
    ranked, _ = C.dense_index(scored.where(drawn), [F.col(c) for c in keys])
    return ranked.select(*out, (F.col("_i") + 1).cast("long").alias("rank")).unionByName(scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resample() of all documents towards the texts of benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"), keep=["doc_id"])


#: The same by words as rows. CRC-32 is folded over the bytes of each distinct word; its table of remainders follows from the polynomial.
SQL = r"""
WITH c AS (SELECT list(v ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b))),
x AS (SELECT 0 AS k, doc_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 1, row_number() OVER (), coalesce(text, '') FROM benchmark),
w AS (SELECT k, doc_id, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM x),
u AS (SELECT DISTINCT word FROM w),
b AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda y: ('0x' || y)::bigint)), lambda a, y: xor(a >> 8, tab[(xor(a, y) & 255) + 1])), 4294967295) % 10000 AS b FROM u, c),
f AS (SELECT k, doc_id, b FROM w JOIN b USING (word)),
n AS (SELECT b, count(*) FILTER (k = 0) AS s, count(*) FILTER (k = 1) AS t FROM f GROUP BY b),
g AS (SELECT b, floor(1000 * ln(((t + 1)::double * (sum(s) OVER () + 10000)::double) / ((s + 1)::double * (sum(t) OVER () + 10000)::double)))::bigint AS gain FROM n),
v AS (SELECT doc_id, count(*) AS n_features, sum(gain)::bigint AS weight FROM f JOIN g USING (b) WHERE k = 0 GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(n_features, 0)::bigint AS n_features, coalesce(weight, 0)::bigint AS weight,
  coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint AS score FROM documents LEFT JOIN v USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM d WHERE n_features >= 20)
SELECT d.*, CASE WHEN r <= 10 * n // 100 THEN r END::bigint AS rank FROM d LEFT JOIN r USING (doc_id)
"""
