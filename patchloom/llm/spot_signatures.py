"""Document fingerprints of spot signatures. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import common as C

#: Common words of four languages: the spots at which signatures begin.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was were with you "
    "au aux ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "als auf das dem den der die ein eine er für ich im ist mit nicht sich sie und von zu "
    "al como con del el es las los no más o por se su sus un una y"
).split()
#: Content words in a chain; characters in the pieces of stretches that no chain reaches, and words from which on these have
#: pairs of words; characters beyond which a word has pieces of its own.
CHAIN, PIECE, WORDS, LONG = 2, 3, 4, 16
MARK, END = "\x01", "\x02"


def _any_of(words: list[str]) -> str:
    """A pattern that matches any of the words, common beginnings tried once."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    parts = []
    for h, rest in heads.items():
        tails = [r for r in rest if r]
        parts.append(h + ("" if not tails else _any_of(tails) + "?" * ("" in rest)))
    return f"(?:{'|'.join(parts)})"


def signatures(text: Column, anchors: list[str] | None = None, chain: int = CHAIN) -> Column:
    """The sorted distinct hashes of a text's signatures, their CRC-32: array<int>.

    Words are runs of letters, marks and digits, lower case. Each anchor with the next `chain` words after it that are
    no anchors makes a signature; the text's end counts as so many words more. Words that no anchor reaches, over `chain`
    after the last one or before the first, have signatures of their own, so that a text in a language without these
    anchors, or a long stretch without any, is no less told apart, and an anchor more or less changes what is near it
    alone: a stretch of WORDS such words and more has each with the next one; a shorter one, and any word of over LONG
    characters, which may be a sentence without blanks, those runs of PIECE characters that are below their neighbours,
    about one in three. Equal texts are equal and small changes leave most signatures; null counts as empty, and a text
    without words has one signature.
    """
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))
    spots = _any_of(anchors or ANCHORS)
    marked = F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), f" (?={spots} )", f" {MARK}")
    skip, content, passed = f"(?: {MARK}[^ ]++)*+", f" [^ {MARK}]++", f" {MARK}[^ ]++"
    # what is used twice is bound to a variable, as an array of one, so that it is made once
    bound = lambda x, use: F.flatten(F.transform(F.array(x), use))
    pairs = lambda x: F.regexp_extract_all(x, F.lit("(?<![^ ])(?=([^ ]++(?: [^ ]++)?))"), F.lit(1))
    runs = lambda x: F.regexp_extract_all(x, F.lit(f"(?=({'.' * PIECE}))"), F.lit(1))
    lowest = lambda r: F.filter(r, lambda x, i: (F.coalesce(F.get(r, i - 1), x) >= x) & F.coalesce(F.get(r, i + 1) > x, F.lit(True)))
    short = lambda x: F.when(F.length(x) < PIECE, F.array(x)).otherwise(bound(runs(x), lowest))
    long = lambda x: F.flatten(F.transform(F.regexp_extract_all(x, F.lit(f"[^ ]{{{LONG + 1},}}+"), F.lit(0)), lambda w: bound(runs(w), lowest)))
    several = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) >= WORDS - 1

    def all_of(m: Column) -> Column:
        found = F.regexp_extract_all(F.concat(m, F.lit(f"{END} " * chain)), F.lit(f"{MARK}(?=([^ ]++{f'{skip}{content}' * chain}))"), F.lit(1))
        clean = F.transform(found, lambda x: F.when(F.contains(x, F.lit(f" {MARK}")), F.regexp_replace(x, passed, "")).otherwise(x))
        rest = F.regexp_replace(m, f"(?:{passed})++(?:{content}){{0,{chain}}}+", f" {MARK}")
        stretches = F.filter(F.transform(F.split(rest, f" ?{MARK} ?"), lambda x: F.trim(x)), lambda x: x != "")
        others = F.flatten(F.transform(stretches, lambda x: F.when(several(x), F.concat(pairs(x), long(x))).otherwise(short(x))))
        none = F.when(m == "  ", F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(clean, F.transform(F.concat(others, none), lambda x: F.concat(F.lit(MARK), x)))

    low = F.transform(bound(marked, all_of), lambda x: (F.crc32(x.cast("binary")) - F.lit(1 << 31)).cast("int"))
    return F.sort_array(F.array_distinct(low))


def to_string(signature: Column) -> Column:
    """A fingerprint as text: its hashes in ascending order, eight hexadecimal digits each, with blanks between."""
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x.cast("long") + F.lit(1 << 31)), 8, "0")), " "))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 without a look at the members if their sizes alone rule out `least`."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(small < F.lit(least) * large, F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both)).cast("double")


def length_class(size: Column, least: float) -> Column:
    """The partition of a set by its size: sets at least `least` alike lie in one partition or in neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / least)) + F.lit(1e-9)).cast("int")


def similar_to(queries: DataFrame, corpus: DataFrame, least: float = 0.8) -> DataFrame:
    """(query_id, doc_id, likeness) for rows of (query_id, signature) and (doc_id, signature) at least `least` alike.

    A stated set of queries against all rows. Both sides are partitioned by set length, a query looking into its own
    partition and the neighbours. Within one, only sets that share one of the query's first size - ceil(least * size) + 1
    signatures, or the like of the other, meet (by hash value, the order all sets are kept in), and sizes too far apart
    are pruned before members are compared. Empty or null sets match nothing. Copies among the queries meet alike.
    """
    def prefix(df: DataFrame) -> DataFrame:
        n = F.size("signature")
        keep = n - F.ceil(n * F.lit(least) - 1e-9) + 1
        return df.where(n > 0).withColumns({"n": n, "part": length_class(n, least), "head": F.explode(F.slice("signature", 1, keep.cast("int")))})

    q = prefix(queries).withColumn("part", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)))
    d = prefix(corpus)
    pairs = q.select("query_id", "part", "head", F.col("n").alias("qn")).join(d.select("doc_id", "part", "head", "n"), ["part", "head"])
    pairs = pairs.where(F.least("n", "qn") >= F.lit(least) * F.greatest("n", "qn") - 1e-9).select("query_id", "doc_id").distinct()
    a = queries.select("query_id", F.col("signature").alias("_a"))
    b = corpus.select("doc_id", F.col("signature").alias("_b"))
    out = pairs.join(a, "query_id").join(b, "doc_id").withColumn("likeness", likeness(F.col("_a"), F.col("_b"), least))
    return out.where(F.col("likeness") >= least - 1e-12).select("query_id", "doc_id", "likeness")


def compare_edited(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Rows are put in descending order of doc_id by a distributed numbering of ids (no text); each sends the front of its
    text, as long as asked for, and its signatures to the row before it, so the texts are shuffled once. The edited
    text is a text with its last floor(n_chars / 3) characters replaced by the first as many (or all) of the next one.

    Null text counts as empty. Null ids come last. Rows with one id are ordered by a hash of their texts, and rows equal
    in both are one document and share a result. A single document is its own next. Empty in, empty out.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *C.identity()).withColumn("n_chars", F.length("text").cast("long"))
    last = F.col("_k") == F.lit(C.NULL_ID)
    index, n = C.dense_index(keyed.select("_k", "_t", "n_chars").distinct(), [last.asc(), F.col("_k").desc(), F.col("_t").asc()])
    index = C.cut(index, "index")
    n = max(n, 1)
    want = index.select(F.pmod(F.col("_i") + 1, F.lit(n)).alias("_i"), F.floor(F.col("n_chars") / 3).cast("int").alias("_want"))
    index = C.cut(index.select("_k", "_t", "_i").join(want, "_i"), "index")
    placed = keyed.join(C.side(index), ["_k", "_t"])
    sign = signatures(F.col("text"))
    own = placed.select("doc_id", "_i", "text", "n_chars")
    front = placed.dropDuplicates(["_i"]) if index.count() < docs.count() else placed
    front = front.select(F.pmod(F.col("_i") - 1, F.lit(n)).alias("_i"), F.expr("left(text, _want)").alias("_front"), sign.alias("_next"))
    both = own.join(front, "_i").withColumn("_own", sign)
    edited = F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 3) as int))"), "_front")
    both = both.withColumn("_text", edited).withColumn("_edited", signatures(F.col("_text")))
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("_text").cast("binary"), 256).alias("edited_sha256"),
        to_string(F.col("_own")).alias("fingerprint"), to_string(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edited")).alias("near_edited"), likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )


def op10_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compare_edited() over all documents."""
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same by words as rows: each anchor meets the next content words by their running number.
SQL = """
WITH o0 AS (SELECT doc_id, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC) AS nx, first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC) AS top FROM documents),
e AS (SELECT doc_id, t, left(t, length(t) - length(t) // 3) || left(coalesce(nx, top), length(t) // 3) AS ed, lead(doc_id) OVER (ORDER BY doc_id DESC) AS nid, max(doc_id) OVER () AS top_id FROM o0),
x AS (SELECT doc_id, 0 AS k, t FROM e UNION ALL SELECT doc_id, 1, ed FROM e),
n AS (SELECT doc_id, k, trim(regexp_replace(lower(t), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g')) AS s FROM x),
w AS (SELECT doc_id, k, unnest(string_split(s, ' ') || [chr(2), chr(2)]) AS word, generate_subscripts(string_split(s, ' ') || [chr(2), chr(2)], 1) AS pos FROM n WHERE s <> ''),
a AS (SELECT *, word IN (ANCHORS) AS anchor FROM w),
c AS (SELECT *, sum((NOT anchor)::int) OVER (PARTITION BY doc_id, k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS r, sum(anchor::int) OVER (PARTITION BY doc_id, k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS m FROM a),
g AS (SELECT p.doc_id, p.k, p.word || ' ' || q.word || ' ' || z.word AS sig FROM c p JOIN c q ON q.doc_id = p.doc_id AND q.k = p.k AND q.r = p.r + 1 AND NOT q.anchor
  JOIN c z ON z.doc_id = p.doc_id AND z.k = p.k AND z.r = p.r + 2 AND NOT z.anchor WHERE p.anchor),
o AS (SELECT doc_id, k, m, word, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k, m ORDER BY pos) AS nth FROM c WHERE NOT anchor AND word <> chr(2)) WHERE m = 0 OR nth > 2),
t AS (SELECT doc_id, k, list(word ORDER BY pos) AS ws, string_agg(word, ' ' ORDER BY pos) AS s FROM o GROUP BY doc_id, k, m),
l AS (SELECT doc_id, k, s FROM t WHERE len(ws) < 4 AND length(s) >= 3 UNION ALL SELECT doc_id, k, word FROM (SELECT doc_id, k, unnest(ws) AS word FROM t WHERE len(ws) >= 4) WHERE length(word) > 16),
q AS (SELECT doc_id, k, unnest(list_transform(range(1, len(ws) + 1), lambda i: ws[i] || coalesce(' ' || ws[i + 1], ''))) AS piece FROM t WHERE len(ws) >= 4
  UNION ALL SELECT doc_id, k, s FROM t WHERE len(ws) < 4 AND length(s) < 3
  UNION ALL SELECT doc_id, k, x[i] FROM (SELECT doc_id, k, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, k, list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)) AS x FROM l))
    WHERE (i = 1 OR x[i - 1] >= x[i]) AND (i = len(x) OR x[i + 1] > x[i])),
y AS (SELECT doc_id, k, sig FROM g UNION ALL SELECT doc_id, k, chr(1) || piece FROM q UNION ALL SELECT doc_id, k, chr(1) FROM n WHERE s = ''),
z AS (SELECT list(v ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM (SELECT unnest(range(256)) AS b))),
h AS (SELECT sig, printf('%08x', xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(sig)), '..'), lambda y: ('0x' || y)::bigint)), lambda a, y: xor(a >> 8, tab[(xor(a, y) & 255) + 1])), 4294967295)) AS h FROM (SELECT DISTINCT sig FROM y), z),
f AS (SELECT doc_id, k, list_sort(list(DISTINCT h)) AS f FROM y JOIN h USING (sig) GROUP BY doc_id, k)
SELECT e.doc_id, length(t) AS n_chars, sha256(ed) AS edited_sha256, array_to_string(a.f, ' ') AS fingerprint, array_to_string(b.f, ' ') AS edited_fingerprint,
  len(list_intersect(a.f, b.f)) / (len(a.f) + len(b.f) - len(list_intersect(a.f, b.f))) AS near_edited,
  len(list_intersect(a.f, c.f)) / (len(a.f) + len(c.f) - len(list_intersect(a.f, c.f))) AS near_next
FROM e JOIN f a ON a.doc_id = e.doc_id AND a.k = 0 JOIN f b ON b.doc_id = e.doc_id AND b.k = 1 JOIN f c ON c.doc_id = coalesce(nid, top_id) AND c.k = 0
""".replace("ANCHORS", ", ".join(f"'{w}'" for w in ANCHORS))
