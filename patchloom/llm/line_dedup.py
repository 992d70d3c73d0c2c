"""Line dedup by a deletion-neighbourhood join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import common as C

#: Lines of at least so many characters are compared with near ones: all that are longer than the edit bound.
MIN_NEAR_CHARS = 2
#: What the pipeline asks for instead: one edit turns list marks and other very short lines into each other.
STAGE_NEAR_CHARS = 20
#: Characters in a segment: only a segment in which two lines can differ emits its deletion variants.
SEGMENT = 32


def _lines(docs: DataFrame) -> DataFrame:
    """(_k, _t, pos, line): every line of every text; null texts have none."""
    return docs.select("_k", "_t", F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line"))


def _hashes(line: Column) -> list[Column]:
    """Two independent 64-bit hashes, together a line's identity."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(77), line).alias("h2")]


def _half_keys(line: Column, n: Column) -> Column:
    """Four keys of which lines within one edit share one.

    For the shorter line's length c, one edit leaves c // 2 characters equal at the front or at the back. Each line
    takes part with c = its own length and c = its length less 1.
    """
    def of(c: Column, tag: int) -> list[Column]:
        half = F.floor(c / 2).cast("int")
        return [
            F.xxhash64(F.lit(1), c, F.substring(line, 1, half)),
            F.xxhash64(F.lit(2), c, F.substring(line, n - half + 1, half)),
        ]

    return F.array(*of(n, 0), *of(n - 1, 1))


def _segments(line: Column, n: Column) -> Column:
    """For each segment and both roles (own length c = n, or the longer line with c = n - 1): key of all but the segment."""
    def one(s: Column, c: Column) -> Column:
        cut_ = F.least((s + 1) * SEGMENT, c)
        tail = c - cut_
        key = F.xxhash64(F.lit(3), c, s, F.substring(line, 1, s * SEGMENT), F.substring(line, n - tail + 1, tail))
        return F.struct(s.alias("seg"), c.alias("c"), key.alias("key"))

    def role(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(c, F.lit(1)) - 1) / SEGMENT).cast("int")), lambda s: one(s, c))

    return F.concat(role(n), role(n - 1))


def _variants(line: Column, n: Column, seg: Column, c: Column) -> Column:
    """The deletion variants of the line that delete in one segment, as structs (v, at).

    v hashes the variant cut as (before the segment, segment without a character, after it), so that each costs a
    segment's length; `at` is the deleted place, -1 for pairs of different length. Equal-length pairs delete at the
    same place; of two lengths the longer deletes one character and the shorter none.
    """
    begin = seg * SEGMENT
    before = F.substring(line, 1, begin)
    end_same = F.least(begin + SEGMENT, n)
    end_long = F.least(begin + SEGMENT, n - 1) + 1

    def less_one(i: Column, end: Column) -> Column:
        mid = F.concat(F.substring(line, begin + 1, i), F.substring(line, begin + i + 2, end - begin - i - 1))
        return F.xxhash64(F.lit(4), n - 1, seg, before, mid, F.substring(line, end + 1, n))

    same = F.transform(F.sequence(F.lit(0), end_same - begin - 1), lambda i: F.struct(less_one(i, end_same).alias("v"), i.alias("at"), F.lit(False).alias("whole")))
    longer = F.transform(F.sequence(F.lit(0), end_long - begin - 1), lambda i: F.struct(less_one(i, end_long).alias("v"), F.lit(-1).alias("at"), F.lit(False).alias("whole")))
    keep = end_same - begin
    itself = F.xxhash64(F.lit(4), n, seg, before, F.substring(line, begin + 1, keep), F.substring(line, begin + keep + 1, n))
    shorter = F.array(F.struct(itself.alias("v"), F.lit(-1).alias("at"), F.lit(True).alias("whole")))
    return F.when(c == n, F.concat(same, shorter)).otherwise(longer)


def dedup_lines(docs: DataFrame, max_edits: int = 1, min_near_chars: int = MIN_NEAR_CHARS) -> DataFrame:
    """docs with text rebuilt from the lines that stay, and n_lines, n_removed.

    Lines are the parts between line feeds; carriage returns belong to them. A line stays if it is blank (nothing but
    white space), or if no earlier line, by (doc_id, place in the text), equals it or, for lines of at least
    min_near_chars characters and max_edits = 1, is within one inserted, deleted or replaced character of it. "Earlier"
    looks at the input: whether the earlier line stays itself makes no difference, so the result does not depend on the
    order of work. max_edits = 0 compares exactly.

    Equal lines meet in an aggregation of 128-bit hashes that combines before the shuffle. For near ones, two counts
    of shared keys first discard lines, then segments, that cannot have a partner (without loss: see _half_keys);
    segments left emit all variants that delete one character, each a hashed key. Equal keys meet in an aggregation
    that keeps the earliest line of each key, so a key with very many lines costs no pairs; each line is then compared
    with those earliest ones by edit distance. Text is read again for the lines that stay.

    Null text: no lines, stays null. Empty text: one blank line. Ties: rows equal in id and text are one document and
    get the same result; null ids come last. Empty tables give empty results. Columns of docs named like the results
    are replaced, others kept, whatever their names.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    docs = C.prepared(docs).drop("n_lines", "n_removed")
    keyed = C.held(docs, "text")
    line, n = F.col("line"), F.col("n")
    ord_ = F.struct("_k", "_t", "pos")
    every = _lines(keyed).withColumn("blank", F.trim(F.translate(line, "\t\r\f\x0b", "    ")) == "").withColumn("n", F.length(line))
    distinct = (
        every.where(~F.col("blank"))
        .select(*_hashes(line), ord_.alias("first"), "n", _half_keys(line, n).alias("keys"))
        .groupBy("h1", "h2").agg(F.min("first").alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    )
    if max_edits:
        distinct = C.cut(distinct, "lines")
        near = C.cut(_near(keyed, distinct, min_near_chars), "linesn")
        C.release(docs.sparkSession)
        distinct = distinct.join(C.side(near), ["h1", "h2"], "left_anti")
    stay = distinct.select("first._k", "first._t", "first.pos").unionByName(every.where("blank").select("_k", "_t", "pos").distinct())
    stay = C.cut(stay.groupBy("_k", "_t").agg(F.array_sort(F.collect_list("pos")).alias("_stay")), "linesk")
    C.release(docs.sparkSession)
    out = keyed.join(C.side(stay), ["_k", "_t"], "left")
    parts = F.split(F.col("text"), "\n")
    kept = F.coalesce(F.col("_stay"), F.array().cast("array<int>"))
    out = out.withColumn("_parts", parts).withColumns({
        "n_lines": F.coalesce(F.size("_parts"), F.lit(0)),
        "text": F.when(F.col("text").isNotNull(), F.array_join(F.transform(kept, lambda i: F.get(F.col("_parts"), i)), "\n")),
    })
    out = out.withColumn("n_lines", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.col("n_lines")))
    out = out.withColumn("n_removed", F.col("n_lines") - F.size(kept))
    return out.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns], "n_lines", "n_removed")


def _near(keyed: DataFrame, distinct: DataFrame, least: int) -> DataFrame:
    """(h1, h2) of distinct lines with an earlier line one edit away."""
    line, n = F.col("line"), F.col("n")
    long_ = distinct.where(n >= least)
    # a line one edit away may be one character below the least; such a line takes no part
    keys = long_.select("h1", "h2", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("m > 1 and lo < hi").select("key")
    shared = C.cut(shared, "linesh")
    cand = keys.join(C.side(shared), "key", "left_semi").select("h1", "h2").distinct()
    cand = C.cut(cand.join(long_.select("h1", "h2", "first", "n"), ["h1", "h2"]).select("h1", "h2", "n", "first._k", "first._t", "first.pos"), "linesc")
    # their texts: read from where each first stands
    texts = _lines(keyed).join(C.side(cand), ["_k", "_t", "pos"]).dropDuplicates(["h1", "h2"])
    texts = C.cut(texts, "linest")
    C.release(keyed.sparkSession)
    seg = texts.select("h1", "h2", F.explode(_segments(line, n)).alias("s")).select("h1", "h2", "s.*")
    open_ = seg.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    seg = C.cut(seg.join(C.side(C.cut(open_, "lineso")), "key", "left_semi").select("h1", "h2", "seg", "c").distinct(), "liness")
    v = texts.join(seg, ["h1", "h2"]).select(
        F.struct("_k", "_t", "pos").alias("ord"), "h1", "h2", F.explode(_variants(line, n, F.col("seg"), F.col("c"))).alias("x")
    ).select("ord", "h1", "h2", "x.*")
    v = C.cut(v, "linesv")
    me = F.struct("ord", "h1", "h2")
    least_of = v.groupBy("v", "at").agg(F.min(me).alias("any"), F.min(F.when(F.col("whole"), me)).alias("w"), F.min(F.when(~F.col("whole"), me)).alias("d"))
    # at >= 0: all differ in one place; at = -1: the shorter line against those that delete, never these among themselves
    met = v.join(least_of, ["v", "at"]).withColumn("wit", F.when(F.col("at") >= 0, F.col("any")).when(F.col("whole"), F.col("d")).otherwise(F.col("w")))
    pairs = met.where(F.col("wit").isNotNull() & (F.col("wit.ord") < F.col("ord"))).select("h1", "h2", F.col("wit.h1").alias("g1"), F.col("wit.h2").alias("g2")).distinct()
    a = texts.select("h1", "h2", F.col("line").alias("a"))
    b = texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("b"))
    return pairs.join(a, ["h1", "h2"]).join(b, ["g1", "g2"]).where((F.levenshtein("a", "b", 1) >= 0) & (F.length("b") >= least)).select("h1", "h2").distinct()


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_lines() over all documents; the text that stays as a digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").alias("n_chars_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with repeated lines taken out; a document none of whose words is left goes, one that had none stays."""
    own = docs.columns
    docs = docs.select(F.struct("*").alias("held"), "doc_id", "text")
    out = dedup_lines(docs, min_near_chars=STAGE_NEAR_CHARS)
    out = out.where((F.col("n_removed") == 0) | F.col("text").isNull() | F.col("text").rlike(r"\S"))
    size = F.coalesce(F.length("text"), F.lit(0))
    new = {"text": F.col("text")} | ({"n_chars": size.cast(docs.schema["held"].dataType["n_chars"].dataType)} if "n_chars" in own else {})
    return out.select(*[new[c].alias(c) if c in new else F.col(f"held.`{c}`") for c in own])


#: The same decisions: candidates by equal halves, then every place where the one edit can be.
SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL
), solid AS (
  SELECT * FROM lines WHERE NOT regexp_full_match(line, '[ \t\r\f\v]*')
), firsts AS (
  SELECT line, length(line) AS n, min(struct_pack(d := doc_id, p := pos)) AS ord FROM solid GROUP BY line
), longs AS (SELECT * FROM firsts WHERE n >= {MIN_NEAR_CHARS}),
keys AS (
  SELECT line, n, ord, c, unnest([(1, left(line, (c // 2)::int)), (2, right(line, (c // 2)::int))]) AS k
  FROM (SELECT line, n, ord, unnest([n, n - 1]) AS c FROM longs)
), pairs AS (
  SELECT DISTINCT a.line AS a, b.line AS b FROM keys a JOIN keys b ON a.c = b.c AND a.k = b.k AND a.ord > b.ord AND abs(a.n - b.n) <= 1
), near AS (
  SELECT DISTINCT a FROM pairs WHERE list_bool_or(list_transform(range(0, greatest(length(a), length(b))::bigint), lambda i:
    CASE WHEN length(a) = length(b) THEN left(a, i) = left(b, i) AND substr(a, i + 2) = substr(b, i + 2)
         WHEN length(a) > length(b) THEN left(a, i) = left(b, i) AND substr(a, i + 2) = substr(b, i + 1)
         ELSE left(a, i) = left(b, i) AND substr(a, i + 1) = substr(b, i + 2) END))
), stay AS (
  SELECT l.doc_id, l.pos, l.line FROM lines l LEFT JOIN firsts f ON f.line = l.line
  WHERE f.line IS NULL OR (f.ord.d = l.doc_id AND f.ord.p = l.pos AND l.line NOT IN (SELECT a FROM near))
), kept AS (SELECT doc_id, count(*) AS m, string_agg(line, chr(10) ORDER BY pos) AS t FROM stay GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines,
  coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(m, 0) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN length(coalesce(t, '')) END AS n_chars_kept,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(t, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
