"""Repeated passages by longest previous factors in suffix order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import common as C
from patchloom.llm.shingles import CHUNK, U, part_hash, prefix_hash, tidy

#: Bytes that a repeated passage has at least, and bytes of the grams that anchor it.
LEAST, GRAM = 100, 24
#: Contexts of one anchor that go to one task; an anchor with more compares its windows by hash instead.
GROUP = 20_000
#: Bytes of contexts that are suffix-sorted at once, beyond which only a single anchor's may go.
SORTED = 1 << 20
#: Anchors that occur more than once are broadcast up to this size, four million of them: a shuffle of all runs of windows
#: instead takes an executor of 3 GB to its limit on half a GB of texts.
ANCHORS = 192 << 20


def _parts(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[list[int], list[bytes]]]:
    """(ids, texts as bytes) of about `size` bytes together, from batches (id, text)."""
    ids, texts, n = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append((t or "").encode("utf-8", "surrogatepass"))
            n += len(texts[-1])
            if n >= size:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def anchors(texts: list[bytes], least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text's index, first window, windows, anchor's hash, context's hash) of each run of windows with one anchor.

    A window is a string of `least` bytes; its anchor is its gram of least hash, the leftmost of equals. Equal windows
    have equal anchors at the same place, so a window can only equal windows under the same anchor hash. The context
    of a run is all bytes of its windows.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    if n < least:
        return none
    h = prefix_hash(data)
    at = np.arange(n - gram + 1)
    g = part_hash(h, at, at + gram)
    bits = 32  # the same for all pieces of work: equal windows must choose alike
    low = (g & ~U((1 << bits) - 1)) | at.astype(U)
    span = least - gram + 1
    done = 1
    while done * 2 <= span:
        low = np.minimum(low[: len(low) - done], low[done:])
        done *= 2
    if done < span:
        low = np.minimum(low[: len(low) - (span - done)], low[span - done :])
    where = (low & U((1 << bits) - 1)).astype(np.int64)
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(texts)), np.maximum(lengths - least + 1, 0))
    begins = ends - lengths
    start = np.arange(len(doc)) - (np.cumsum(np.maximum(lengths - least + 1, 0)) - np.maximum(lengths - least + 1, 0))[doc] + begins[doc]
    if not len(start):
        return none
    where = where[start]
    new = np.ones(len(start), bool)
    new[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    lo, a = start[first], where[first]
    c = part_hash(h, lo, lo + count + least - 1) ^ ((a - lo).astype(U) * U(0xD1B54A32D192ED03))
    return doc[first], lo - begins[doc[first]], count, g[a].view(np.int64), c.view(np.int64)


def ranks(data: np.ndarray, least: int = LEAST) -> dict[int, np.ndarray]:
    """The rank of each suffix by its first bytes, for 8, 16, 32 ... and `least` bytes, and its first 8 bytes themselves (1).

    Prefix doubling: equal ranks are equal strings, ranks follow byte order. Suffixes that end early count as if zero
    bytes followed.
    """
    n = len(data)
    wide = np.zeros(n + 8, U)
    wide[:n] = data
    key = np.zeros(n, U)
    for i in range(8):
        key = (key << U(8)) | wide[i : i + n]
    out = {1: key}
    _, r = np.unique(key, return_inverse=True)
    size = 8
    out[size] = r
    while size < least:
        step = min(size, least - size)
        pad = np.full(n, -1, np.int64)
        pad[: n - step] = r[step:]
        _, r = np.unique(r.astype(np.int64) * (n + 1) + pad + 1, return_inverse=True)
        size += step
        out[size] = r
    return out


def common_prefixes(levels: dict[int, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each two suffixes how many bytes agree at their begins, up to the depth of ranks()."""
    least, n = max(levels), len(levels[1])
    met = np.zeros(len(i), np.int64)
    for size in sorted((s for s in levels if 8 <= s < least), reverse=True):
        x, y = i + met, j + met
        inside = np.maximum(x, y) < n
        r = levels[size]
        met += size * (inside & (r[np.minimum(x, n - 1)] == r[np.minimum(y, n - 1)]))
    x, y = i + met, j + met
    differ = levels[1][np.minimum(x, n - 1)] ^ levels[1][np.minimum(y, n - 1)]
    for byte in range(7):
        met += (differ >> U(56 - 8 * byte)) == 0
    met += differ == 0
    return np.where(levels[least][i] == levels[least][j], least, np.minimum(met, least - 1))


def longest_previous_factors(pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For suffixes in suffix order, given their positions and common prefixes with the one before: the longest previous
    factor of each, the longer of its common prefixes with the previous and the next smaller position in suffix order.

    Suffixes leave the order from the largest position on; the neighbours of the one that leaves are then its previous
    and next smaller positions, and the common prefix of what comes together is the shorter of the two.
    """
    n = len(pos)
    # the first and the last place hold nothing
    before, after = list(range(-1, n + 1)), list(range(1, n + 3))
    lengths, out = [0, *lcp.tolist(), 0], [0] * (n + 2)
    for k in (np.argsort(-pos, kind="stable") + 1).tolist():
        p, q = before[k], after[k]
        x, y = lengths[k], lengths[q]
        if x > y:
            out[k], lengths[q] = x, y
        else:
            out[k], lengths[q] = y, x
        after[p], before[q] = q, p
    return np.array(out[1:-1], np.int64)


def previous_factors(levels: dict[int, np.ndarray], at: np.ndarray, group: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The longest previous factor of the suffixes at `at`, among those of their group, by position `pos`; up to the depth
    of the ranks. A position listed twice is one position."""
    order = np.lexsort((pos, group))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(group[order]) != 0) | (np.diff(pos[order]) != 0)
    one, back = order[new], np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    at, group, pos = at[one], group[one], pos[one]
    order = np.lexsort((pos, levels[max(levels)][at], group))
    at, group, pos = at[order], group[order], pos[order]
    lcp = np.zeros(len(at), np.int64)
    lcp[1:] = np.where(group[1:] == group[:-1], common_prefixes(levels, at[1:], at[:-1]), 0)
    out = np.empty(len(at), np.int64)
    out[order] = longest_previous_factors(pos, lcp)
    return out[back]


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(flag.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, pos, ctx) in order of g to (pos, n): runs of windows that a smaller position has too."""

    def out(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        # two anchors in one piece of work are kept apart by comparing windows under one anchor only
        groups = np.array([r[0] for r in rows], np.int64)
        begin = np.array([r[1] for r in rows], np.int64)
        sizes = np.array([len(r[2]) for r in rows], np.int64)
        data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        first = np.cumsum(sizes) - sizes
        n = sizes - LEAST + 1
        row = np.repeat(np.arange(len(rows)), n)
        place = np.arange(int(n.sum())) - (np.cumsum(n) - n)[row]
        _, gi = np.unique(groups, return_inverse=True)
        flag = previous_factors(ranks(data), first[row] + place, gi[row], begin[row] + place) >= LEAST
        # runs end with their row
        cut_ = np.zeros(len(flag) + len(rows), bool)
        cut_[np.arange(len(flag)) + row] = flag
        s, e = _runs(cut_)
        r = np.searchsorted(np.cumsum(n + 1), s, side="right")
        return pa.RecordBatch.from_arrays([pa.array(begin[r] + s - (np.cumsum(n + 1) - n - 1)[r]), pa.array((e - s).astype(np.int32))], ["pos", "n"])

    rows: list[tuple[int, int, bytes]] = []
    size = 0
    for batch in batches:
        for g, pos, ctx in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if size >= SORTED and g != rows[-1][0]:
                yield out(rows)
                rows, size = [], 0
            rows.append((g, pos, ctx))
            size += len(ctx)
    if rows:
        yield out(rows)
    tidy()


def _numbered(docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    """(_row, text, _u): docs' columns as one, and a number in the order of (doc_id, text's hash), and the bits that an offset in a text needs.

    Where doc_id is unique and not negative and leaves room, it is the number itself; otherwise rows are numbered.
    """
    keyed = C.prepared(docs).select(F.struct("*").alias("_row"), F.col(text), *C.identity(text))
    s = keyed.agg(F.max(F.octet_length(text)).alias("n"), F.max("_k").alias("hi"), F.min("_k").alias("lo")).first()
    bits = max(1, int(s["n"] or 0).bit_length())
    twice = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("m")).where("m > 1").limit(1).count()
    if s["hi"] is None or (not twice and s["lo"] >= 0 and int(s["hi"]).bit_length() + bits <= 62):
        return keyed.withColumn("_u", F.col("_k")), bits
    ids, _ = C.dense_index(keyed.select("_k", "_t").distinct(), [F.col("_k"), F.col("_t")])
    ids = C.cut(ids.withColumnRenamed("_i", "_u"), "ids")
    return keyed.join(C.side(ids), ["_k", "_t"]), bits


def repeated_spans(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((_row, text, _u), (_u, spans)), _row being docs' columns: for each text the byte spans that are covered by a string of 100 bytes which also
    starts earlier, as an array of [begin, end, begin, end, ...] of maximal runs; texts without any are left out.

    1. Each window of 100 bytes is anchored at its gram of least hash. Anchors that occur once can hold no repeat.
    2. Runs of windows with equal anchor and equal context are equal throughout: all but the earliest are repeats.
       This is an aggregation that combines before the shuffle, so thousands of copies leave one context.
    3. Different contexts under one anchor are suffix-sorted together, and windows whose longest previous factor
       reaches 100 bytes are repeats. An anchor with more than GROUP different contexts compares hashes of its windows
       in an aggregation instead, so that no task gets an unbounded group.
    Positions are judged on the input: a repeat counts even if its earlier copy is removed too.
    """
    keyed, bits = _numbered(docs, text)
    base = keyed.select("_u", F.coalesce(F.col(text), F.lit("")).alias("_x"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _parts(batches):
            d, lo, n, g, c = anchors(texts)
            pos = (np.array(ids, np.int64)[d] << bits) | lo
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), pa.array(pos), pa.array(n.astype(np.int16))], ["g", "c", "pos", "n"])
        tidy()

    every = base.mapInArrow(scan, "g long, c long, pos long, n short")
    often = C.cut(every.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("g"), "often")
    rows = C.cut(every.join(C.side(often, ANCHORS), "g", "left_semi"), "rows")
    C.release(docs.sparkSession)
    firsts = C.cut(rows.groupBy("g", "c").agg(F.min("pos").alias("first"), F.first("n").alias("n"), F.count(F.lit(1)).alias("m")), "firsts")
    copied = firsts.where("m > 1").select("g", "c", "first")
    same = rows.join(copied, ["g", "c"]).where("pos > first").select("pos", F.col("n").cast("int").alias("n"))
    kinds = C.cut(firsts.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "kinds")
    mixed = firsts.join(C.side(kinds.select("g", (F.col("m") > GROUP).alias("hot"))), "g")
    mask = (1 << bits) - 1
    want = mixed.select(F.shiftright("first", bits).alias("_u"), F.struct("g", (F.col("first").bitwiseAND(mask)).alias("lo"), F.col("n").cast("int").alias("n"), "hot").alias("w"))
    want = C.cut(want.groupBy("_u").agg(F.collect_list("w").alias("w")), "want")
    C.release(docs.sparkSession)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, texts, wants = (batch.column(i).to_pylist() for i in range(3))
            g, pos, ctx = [], [], []
            for u, t, w in zip(us, texts, wants, strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                for x in w:
                    lo, n = x["lo"], x["n"]
                    if x["hot"]:  # a row a window, with its hash for g
                        h = prefix_hash(np.frombuffer(raw[lo : lo + n + LEAST - 1], np.uint8))
                        at = np.arange(n)
                        g += part_hash(h, at, at + LEAST).view(np.int64).tolist()
                        pos += [(u << bits) | (lo + i) for i in range(n)]
                        ctx += [None] * n
                    else:
                        g.append(x["g"])
                        pos.append((u << bits) | lo)
                        ctx.append(raw[lo : lo + n + LEAST - 1])
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(pos, pa.int64()), pa.array(ctx, pa.binary())], ["g", "pos", "ctx"])

    # the texts are dealt by document here and at the end, never broadcast against: both grow alike
    found = base.join(want.hint("shuffle_hash"), "_u").select("_u", "_x", "w").mapInArrow(fetch, "g long, pos long, ctx binary")
    marks = same
    hot = kinds.where(F.col("m") > GROUP).limit(1).count() > 0
    if hot:
        found = C.cut(found, "found")
        win = found.where("ctx is null").select("g", "pos")
        least = C.cut(win.groupBy("g").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1"), "least")
        marks = marks.unionByName(win.join(least, "g").where("pos > first").select("pos", F.lit(1).alias("n")))
        found = found.where("ctx is not null")
    sorted_ = found.repartition("g").sortWithinPartitions("g").mapInArrow(_factor, "pos long, n int")
    marks = marks.unionByName(sorted_)
    lists = marks.select(F.shiftright("pos", bits).alias("_u"), F.struct(F.col("pos").bitwiseAND(mask).alias("lo"), "n").alias("w")).groupBy("_u").agg(F.collect_list("w").alias("w"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column(1)
            ends = w.offsets.to_numpy()
            lo = w.values.field(0).to_numpy(zero_copy_only=False)
            hi = lo + w.values.field(1).to_numpy(zero_copy_only=False) + LEAST - 1
            spans = []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                o = np.argsort(lo[a:b], kind="stable")
                s, e = lo[a:b][o], np.maximum.accumulate(hi[a:b][o])
                new = np.ones(len(s), bool)
                new[1:] = s[1:] > e[:-1]
                last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
                spans.append(np.stack([s[new], e[last]], axis=1).reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.int64()))], ["_u", "spans"])

    spans = C.cut(lists.mapInArrow(merge, "_u long, spans array<long>"), "spans")
    for done in (often, rows, firsts, kinds, want):
        C.drop_cut(done)
    C.release(docs.sparkSession)
    return keyed, spans


def remove_repeats(docs: DataFrame, text: str = "text", keep_bytes: bool = False) -> DataFrame:
    """docs without the text but with n_bytes, n_removed, n_spans, kept_sha256, and kept (bytes) if asked for.

    A null text has no bytes, an empty one neither. Rows equal in doc_id and text are one document; others with one
    doc_id are ordered by a hash of their texts; a null doc_id comes last. What is kept may begin or end inside a
    character, so it is given as bytes. Columns of docs named like the results are replaced. Empty in, empty out.
    """
    from pyspark.sql import types as T

    new = T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
    docs = docs.drop(*new.names)
    own = [c for c in docs.columns if c != text]
    keyed, spans = repeated_spans(docs, text)
    joined = keyed.join(spans.hint("shuffle_hash"), "_u", "left").select(*[F.col(f"_row.`{c}`") for c in own], F.coalesce(F.col(text), F.lit("")).alias("_x"), F.col("spans").alias("_spans"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, s in zip(batch.column(len(own)).to_pylist(), batch.column(len(own) + 1).to_pylist(), strict=True):
                raw, s = t.encode("utf-8", "surrogatepass"), s or []
                edges = [0, *s, len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(s) // 2, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))][: len(own) + len(new)], [*own, *new.names])

    return joined.mapInArrow(cut_out, T.StructType([f for f in docs.schema.fields if f.name != text] + new.fields))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeats() over all documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The contract word for word: every window of 100 bytes (as hexadecimal digits), its first place, and what is covered.
SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM t)),
f AS (SELECT s, min(doc_id * 100000000 + i) AS first FROM w GROUP BY s HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id * 100000000 + i > first),
g AS (SELECT doc_id, i, sum(CASE WHEN i <= prev + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS prev FROM r)),
s AS (SELECT doc_id, run, min(i) AS b, max(i) + 100 AS e FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, count(*) AS n, sum(e - b) AS removed, list(b ORDER BY b) AS bs, list(e ORDER BY b) AS es FROM s GROUP BY doc_id)
SELECT t.doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0)::bigint AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE
    array_to_string(list_transform(range(0, n + 1), lambda j: substr(h, 2 * coalesce(es[j], 0) + 1, 2 * (coalesce(bs[j + 1], length(h) // 2) - coalesce(es[j], 0)))), '') END)) AS kept_sha256
FROM t LEFT JOIN k ON k.doc_id = t.doc_id
"""
